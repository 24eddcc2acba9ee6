"""Declared schemas.  Nothing in the library infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

# The accepted log levels.
LEVELS = ("debug", "info", "warn", "error")

_TEXT = T.StringType()

# One landed request: the raw JSON body and the instant it arrived.
ENVELOPE = T.StructType([
    T.StructField("request_id", _TEXT),
    T.StructField("body", _TEXT),
    T.StructField("received_at", T.TimestampType()),
])

# A validated record before it has an id.
LOG = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("level", _TEXT),
    T.StructField("service", _TEXT),
    T.StructField("message", _TEXT),
    T.StructField("attributes", T.MapType(_TEXT, _TEXT)),
    T.StructField("attributes_json", _TEXT),
])
LOG_COLUMNS = LOG.fieldNames()

# A stored record; the last three columns are the partition columns.
STORED = T.StructType([
    T.StructField("id", T.LongType()),
    *LOG.fields,
    T.StructField("log_date", T.DateType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("source", _TEXT),
])

ROLLUP = T.StructType([
    T.StructField("start_1m", T.TimestampType()),
    T.StructField("service", _TEXT),
    T.StructField("level", _TEXT),
    T.StructField("count", T.LongType()),
    T.StructField("log_date", T.DateType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("source", _TEXT),
])

REJECTS = T.StructType([
    T.StructField("request_id", _TEXT),
    T.StructField("index", T.IntegerType()),
    T.StructField("reason", _TEXT),
    T.StructField("raw", _TEXT),
    T.StructField("source", _TEXT),
])
