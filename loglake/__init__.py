"""Structured application logs on Spark: ingest, search, counts, retention."""

from .operators.aggregate import aggregate_logs
from .operators.page import LogsPage, all_pages, fetch_page, page_rows
from .operators.retention import expired, survivors
from .operators.rollup import aggregate_rollup, build_rollup
from .operators.validate import accepted_logs, rejects, summarize, validate
from .plans.cursor import Cursor, decode_cursor, encode_cursor
from .plans.errors import InvalidQuery
from .plans.predicates import filter_predicate
from .plans.specs import AggregateQuery, LogsQuery, RetentionOptions
from .session import configure, local_session
from .sources.envelopes import read_body_files, read_envelopes, stream_body_files, stream_envelopes
from .sources.table import LogTable
from .streaming.ingest import ingest_batch, read_rejects, stream_ingest

__all__ = [
    "AggregateQuery", "Cursor", "InvalidQuery", "LogTable", "LogsPage", "LogsQuery",
    "RetentionOptions", "accepted_logs", "aggregate_logs", "aggregate_rollup", "all_pages",
    "build_rollup", "configure", "decode_cursor", "encode_cursor", "expired", "fetch_page",
    "filter_predicate", "ingest_batch", "local_session", "page_rows", "read_body_files",
    "read_envelopes", "read_rejects", "rejects", "stream_body_files", "stream_envelopes", "stream_ingest",
    "summarize", "survivors", "validate",
]
