"""Minute rollup: counts by minute, service and level.

It answers every aggregate that filters on nothing but service, level and
whole minutes, from a table far smaller than the records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import BUCKET_MICROS, bucket_start
from ..functions.isotime import micros_literal
from ..plans.predicates import day_literal, utc_day
from ..plans.specs import AggregateQuery
from .aggregate import count_buckets

MINUTE = BUCKET_MICROS["1m"]


def build_rollup(logs: DataFrame, *partition_columns: str) -> DataFrame:
    """Counts per minute, service and level (and per given partition column)."""
    minute = bucket_start(F.col("timestamp"), "1m").alias("start_1m")
    return logs.groupBy(minute, "service", "level", *partition_columns).agg(
        F.count("*").alias("count")
    ).select("start_1m", "service", "level", "count", *partition_columns)


def rollup_answers(query: AggregateQuery) -> bool:
    """Whether the rollup holds everything the query needs."""
    whole_minutes = query.since_micros % MINUTE == 0 and query.until_micros % MINUTE == 0
    return whole_minutes and query.q is None and not query.attributes


def aggregate_rollup(rollup: DataFrame, query: AggregateQuery, partitioned: bool = False) -> DataFrame:
    """The result of ``aggregate_logs``, read from the rollup."""
    if not rollup_answers(query):
        raise ValueError("the query needs the records themselves")
    rows = rollup.filter(
        (F.col("start_1m") >= micros_literal(query.since_micros))
        & (F.col("start_1m") < micros_literal(query.until_micros))
    )
    if partitioned:
        rows = rows.filter(
            F.col("log_date").between(
                day_literal(utc_day(query.since_micros)), day_literal(utc_day(query.until_micros))
            )
        )
    if query.service is not None:
        rows = rows.filter(F.col("service") == F.lit(query.service))
    if query.level is not None:
        rows = rows.filter(F.col("level") == F.lit(query.level))
    return count_buckets(rows, query, F.col("start_1m"), F.sum("count"))
