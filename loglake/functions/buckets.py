"""Fixed-length time buckets counted from 1970-01-01 UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket names and their widths in microseconds.
BUCKET_MICROS = {
    "1m": 60_000_000,
    "5m": 300_000_000,
    "1h": 3_600_000_000,
    "1d": 86_400_000_000,
}


def bucket_start(timestamp: Column, bucket: str) -> Column:
    """Start of the bucket; rounds down before 1970 as well, in any session zone."""
    micros = F.unix_micros(timestamp)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(BUCKET_MICROS[bucket])))
