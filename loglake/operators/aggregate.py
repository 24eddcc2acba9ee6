"""Counts per time bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import bucket_start
from ..functions.isotime import iso_millis_text
from ..plans.predicates import filter_predicate
from ..plans.specs import AggregateQuery


def aggregate_logs(logs: DataFrame, query: AggregateQuery, partitioned: bool = False) -> DataFrame:
    """(start, group, count) per non-empty bucket, ascending.

    The first bucket may start before ``since``.
    """
    matching = logs.filter(filter_predicate(query, partitioned))
    return count_buckets(matching, query, F.col("timestamp"), F.count("*"))


def count_buckets(rows: DataFrame, query: AggregateQuery, moment: Column, count: Column) -> DataFrame:
    keys = [bucket_start(moment, query.bucket).alias("_start")]
    if query.group_by:
        keys.append(F.col(query.group_by).alias("group"))
    counted = rows.groupBy(*keys).agg(count.alias("count"))
    group = F.col("group") if query.group_by else F.lit(None).cast("string").alias("group")
    ordered = counted.orderBy("_start", *(["group"] if query.group_by else []))
    return ordered.select(iso_millis_text(F.col("_start")).alias("start"), group, "count")
