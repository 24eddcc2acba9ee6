"""Landed requests: JSON bodies of the form ``{"logs": [item, ...]}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ENVELOPE


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Requests landed as Parquet rows (request_id, body, received_at)."""
    return spark.read.schema(ENVELOPE).parquet(path)


def stream_envelopes(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The same as a stream; ``maxFilesPerTrigger`` / ``maxBytesPerTrigger`` bound a batch."""
    return spark.readStream.schema(ENVELOPE).options(**options).parquet(path)


def read_body_files(spark: SparkSession, path: str) -> DataFrame:
    """One request per text file; the file's own time is the arrival time."""
    return _from_files(spark.read.option("wholetext", "true").text(path))


def stream_body_files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return _from_files(spark.readStream.options(wholetext="true", **options).text(path))


def _from_files(files: DataFrame) -> DataFrame:
    return files.select(
        F.col("_metadata.file_path").alias("request_id"),
        F.col("value").alias("body"),
        F.col("_metadata.file_modification_time").alias("received_at"),
    )


def explode_items(envelopes: DataFrame) -> DataFrame:
    """One row per item with its position; an unusable body keeps one row without both.

    The parser stops after the first JSON value.  Text behind it would show up
    as a second array element or a syntax error in one of the two wrappings.
    """
    body = F.col("body")
    listed = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    keys = F.json_object_keys(F.concat(F.lit('{"w":'), body, F.lit("}")))
    second = F.try_variant_get("_listed", "$[1]", "variant")
    items = F.try_variant_get("_listed", "$[0].logs", "array<variant>")
    usable = F.col("_second").isNull() & (keys == F.array(F.lit("w"))) & (F.size("_items") > 0)
    return (
        envelopes.withColumn("_listed", listed)
        .withColumns({"_items": items, "_second": second})
        .withColumn("_logs", F.when(usable, F.col("_items")))
        # Ids come from outside and may repeat; the row itself is the request.
        .withColumn("request", F.monotonically_increasing_id())
        .select("request", "request_id", "received_at", F.posexplode_outer("_logs").alias("index", "item"))
    )
