"""Newest-first pages with keyset positions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.isotime import iso_micros_text, iso_millis_text
from ..plans.cursor import Cursor, cursor_column, encode_cursor
from ..plans.predicates import filter_predicate
from ..plans.specs import LogsQuery
from .numbering import number_rows

_FIRST_WINDOW = 3_600_000_000
_WINDOW_GROWTH = 8


@dataclass(frozen=True)
class LogsPage:
    logs: list[dict]
    next_cursor: str | None


def present(logs: DataFrame) -> DataFrame:
    """Output columns: text id, millisecond timestamp, typed attributes as JSON."""
    return logs.select(
        F.col("id").cast("string").alias("id"),
        iso_millis_text(F.col("timestamp")).alias("timestamp"),
        "level",
        "service",
        "message",
        F.col("attributes_json").alias("attributes"),
    )


def newest(logs: DataFrame, limit: int) -> DataFrame:
    """The newest rows; each task keeps only ``limit`` of its own."""
    return logs.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def page_rows(logs: DataFrame, query: LogsQuery, partitioned: bool = False) -> DataFrame:
    """One page as a DataFrame, without the extra row that tells of more."""
    return present(newest(logs.filter(filter_predicate(query, partitioned)), query.limit))


def fetch_page(logs: DataFrame, query: LogsQuery, partitioned: bool = False) -> LogsPage:
    """One page and the cursor of the next, read in one job."""
    matching = logs.filter(filter_predicate(query, partitioned))
    return as_page(_collect(matching, query.limit + 1), query.limit)


def fetch_recent_page(
    scan: Callable[[int, int], DataFrame], query: LogsQuery, oldest: int, end: int
) -> LogsPage:
    """One page from a time-partitioned table, reading the newest part first.

    ``scan(since, until)`` yields the table between two instants.  The window
    grows until the page is full or ``oldest`` is reached, so a page of recent
    records reads an hour and a rare match still searches everything.
    """
    rows: list = []
    for since, until in time_windows(oldest, end):
        matching = scan(since, until).filter(filter_predicate(query, partitioned=True))
        rows += _collect(matching, query.limit + 1 - len(rows))
        if len(rows) > query.limit:
            break
    return as_page(rows, query.limit)


def time_windows(oldest: int, end: int) -> Iterator[tuple[int, int]]:
    """Adjacent windows from ``end`` back to ``oldest``, each wider than the last."""
    width = _FIRST_WINDOW
    while end > oldest:
        since = max(oldest, end - width)
        yield since, end
        end, width = since, width * _WINDOW_GROWTH


def all_pages(logs: DataFrame, limit: int) -> DataFrame:
    """Every row with the page and position a walk by cursor would give it.

    The whole walk is one range-partitioned sort, not one job per page.
    """
    keys = logs.select("timestamp", "id")
    ordered = number_rows(keys, "_row", [F.desc("timestamp"), F.desc("id")])
    zero_based = F.col("_row") - 1
    return ordered.select(
        F.floor(zero_based / limit).alias("page"),
        (zero_based % limit).alias("position"),
        F.col("id").cast("string").alias("id"),
        iso_micros_text(F.col("timestamp")).alias("timestamp"),
    )


def row_cursors(logs: DataFrame) -> DataFrame:
    """The cursor that would continue after each row."""
    return logs.select(
        F.col("id").cast("string").alias("id"),
        cursor_column(F.col("timestamp"), F.col("id")).alias("cursor"),
    )


def _collect(matching: DataFrame, limit: int) -> list:
    top = newest(matching, limit)
    return top.select(
        F.col("id").cast("string").alias("id"),
        iso_millis_text(F.col("timestamp")).alias("shown"),
        iso_micros_text(F.col("timestamp")).alias("exact"),
        "level", "service", "message", "attributes_json",
    ).collect()


def as_page(rows: list, limit: int) -> LogsPage:
    shown, more = rows[:limit], len(rows) > limit
    logs = [
        {
            "id": row["id"],
            "timestamp": row["shown"],
            "level": row["level"],
            "service": row["service"],
            "message": row["message"],
            "attributes": json.loads(row["attributes_json"]),
        }
        for row in shown
    ]
    last = shown[-1] if more else None
    return LogsPage(logs, encode_cursor(Cursor(last["exact"], last["id"])) if last else None)
