"""Session settings and shared scratch space."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that go to a Python worker at a time, where the session names no limit of its own.
BATCH_BYTES = 2 << 20
#: Bytes of a row group in scratch files: what a task holds of a file that it writes or reads.
ROW_GROUP_BYTES = 16 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"

_local_base: str | None = None


def configure(spark: SparkSession) -> SparkSession:
    """Pin the two SQL settings the library's results depend on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Repeated JSON keys keep the last value instead of failing the parse.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def bound_batches(spark: SparkSession) -> None:
    """Let rows reach Python in batches of ``BATCH_BYTES``; the row that passes it is a batch's last.

    By default a batch has 10,000 rows, most of a file's texts: they stand whole
    beside the executor's heap and again in the worker.  It is the session's
    setting because a result is computed only when its reader asks for it.
    """
    if spark.conf.get(_BATCH_LIMIT, None) is None:
        spark.conf.set(_BATCH_LIMIT, str(BATCH_BYTES))


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("loglake")
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def require_utc(spark: SparkSession) -> None:
    """Dates and texts of instants are UTC only in a session that ``configure`` has seen."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "Z", "+00:00"):
        raise RuntimeError(f"the session time zone is {zone}; call configure(spark) first")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` or the context's checkpoint folder.

    Only a session on one machine that names none gets a local one; on a
    cluster each executor would write to a disk the others cannot read.
    """
    global _local_base
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_base is None:
        _local_base = tempfile.mkdtemp(prefix="loglake-")
        atexit.register(shutil.rmtree, _local_base, True)
    return _local_base


def hadoop_path(spark: SparkSession, path: str):
    """The (file system, path) pair Hadoop resolves ``path`` to."""
    jvm = spark.sparkContext._jvm
    resolved = jvm.org.apache.hadoop.fs.Path(path)
    return resolved.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), resolved


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/loglake-{label}-{uuid.uuid4().hex}"
    fs, resolved = hadoop_path(spark, path)
    fs.mkdirs(resolved.getParent())
    fs.deleteOnExit(resolved)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    fs, resolved = hadoop_path(spark, path)
    fs.delete(resolved, True)
    fs.cancelDeleteOnExit(resolved)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of all files under a path."""
    fs, resolved = hadoop_path(spark, path)
    return fs.getContentSummary(resolved).getLength() if fs.exists(resolved) else 0


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` once to shared storage and read it back.

    Consumers then see the same rows whatever executor is lost, prune columns,
    and never repeat the work above this point.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
