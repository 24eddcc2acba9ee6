"""Ingest of landed requests, as one batch or as a stream."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.numbering import SLOT, slotted
from ..operators.validate import rejects, validate
from ..schema import LOG_COLUMNS, REJECTS
from ..session import delete_path, materialize
from ..sources.table import LogTable


@dataclass(frozen=True)
class Ingested:
    accepted: int
    rejected: int


def ingest_batch(
    envelopes: DataFrame,
    table: LogTable,
    *,
    now: dt.datetime | Column | None = None,
    rejects_path: str | None = None,
    source: str | None = None,
    order_by: tuple[Column, ...] = (),
    chunk_rows: int | None = None,
    before_chunk: Callable[[int], None] = lambda chunk: None,
) -> Ingested:
    """Validate requests once and store what is accepted.

    The judged items are written to shared storage first: ids, records, rollup
    and rejects all read that, so bodies are parsed a single time.  A batch of
    the same ``source`` replaces its earlier records and rejects.  ``order_by``
    (of request_id, index and the records' columns) makes ids follow that
    order; ``chunk_rows`` and ``before_chunk`` are those of ``LogTable.append``.
    """
    source = source or f"ingest-{uuid.uuid4().hex}"
    judged, path = materialize(slotted(validate(envelopes, now), order_by), "ingest")
    try:
        refused = rejects(judged)
        if rejects_path is not None:
            refused.write.mode("overwrite").parquet(f"{rejects_path}/source={source}")
        count = refused.count()
        kept = judged.filter(F.col("reason").isNull()).select(SLOT, *LOG_COLUMNS)
        return Ingested(table.append_slotted(kept, path, source, chunk_rows, before_chunk), count)
    finally:
        delete_path(envelopes.sparkSession, path)


def read_rejects(spark: SparkSession, rejects_path: str) -> DataFrame:
    """All refused items kept so far, with the batch each came in."""
    return spark.read.schema(REJECTS).parquet(rejects_path)


def stream_ingest(
    envelopes: DataFrame,
    table: LogTable,
    checkpoint: str,
    *,
    now: dt.datetime | Column | None = None,
    rejects_path: str | None = None,
    chunk_rows: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Feed a stream of requests into the table; by default what is there now.

    There is no watermark, as late records of any age are kept.  A micro-batch
    is stored under the query's id and its own number, both of which live in
    the checkpoint; replayed after a failure, it overwrites the partitions that
    it wrote before.  A new checkpoint reads everything again.
    """
    def store(batch: DataFrame, epoch: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if query is None:
            raise RuntimeError("the stream's query id is unknown, so a replay could not be told")
        ingest_batch(
            batch, table, now=now, rejects_path=rejects_path, source=f"{query}-{epoch:012d}", chunk_rows=chunk_rows)

    return (
        envelopes.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
