"""Steps of a long job, each written to the shared folder before the next begins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, label: str) -> DataFrame:
    """As ``settled_at``, for steps that stay until the end."""
    return settled_at(df, label)[0]


def settled_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written once and read back, without the shuffle files it took, and where it is.

    Once the step is written nobody reads its shuffles again; otherwise Spark
    keeps them until the driver's JVM happens to collect the plan, and the
    files of all steps pile up on the executors' disks.
    """
    conf = df.sparkSession.conf
    before = conf.get(_FREE_SHUFFLES, None)
    conf.set(_FREE_SHUFFLES, "true")
    try:
        return materialize(df, label)
    finally:
        conf.unset(_FREE_SHUFFLES) if before is None else conf.set(_FREE_SHUFFLES, before)


def row_hash(docs: DataFrame, row: str = "row") -> Column:
    """64 bits of all columns of ``docs``, which are the fields of ``row``; columns of maps count as JSON."""
    fields = [F.col(f"{row}.`{field.name}`") for field in docs.schema]
    return F.xxhash64(*(
        F.to_json(F.struct(column)) if _holds_map(field.dataType) else column
        for column, field in zip(fields, docs.schema)))


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(field.dataType) for field in kind)
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    return isinstance(kind, T.MapType)
