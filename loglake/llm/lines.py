"""Line dedup over overlapping windows of three lines.

Every three consecutive lines of a text are hashed to 128 bits; the first
place of each hash in (document, position) order stays, and the lines that
later places cover are removed, overlapping places merged into runs.  Hot
windows are reduced by map-side minima; only windows seen more than once are
joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
_SALT = 0x5EED


def _windows(docs: DataFrame, key: str, text: str) -> DataFrame:
    lines = F.split(F.col(text), "\n", -1)
    held = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("version"), lines.alias("lines")).filter(
        F.size("lines") >= WINDOW)

    def window(at):
        each = [F.get("lines", at + step) for step in range(WINDOW)]
        return F.struct(
            at.alias("pos"),
            F.xxhash64(*each).alias("h1"),
            F.xxhash64(F.lit(_SALT), *each).alias("h2"),
            (F.trim(F.concat(*each)) == "").alias("blank"),
        )

    starts = F.sequence(F.lit(0), F.size("lines") - WINDOW)
    rows = held.select("id", "version", F.inline(F.transform(starts, window)))
    return rows.filter(~F.col("blank")).drop("blank")


def repeated_places(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, version, starts): sorted places of windows that occurred before."""
    windows = _windows(docs, key, text)
    first = windows.groupBy("h1", "h2").agg(
        F.min(F.struct("id", "pos")).alias("first"), F.count("*").alias("times")
    ).filter(F.col("times") > 1).drop("times")
    later = windows.join(first, ["h1", "h2"]).filter(F.struct("id", "pos") > F.col("first"))
    return later.groupBy("id", "version").agg(F.sort_array(F.collect_set("pos")).alias("starts"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of ``docs`` as ``row``, with kept text, n_lines and n_removed.

    Lines end at "\\n" and are compared as they are.  Texts of fewer than three
    lines and windows of blank lines alone stay; an empty text is one empty
    line; null text has none and stays null.  Places are ordered by ``key``
    (null first), then position; rows with equal keys and texts count as one
    place, so all or none of them lose a line.  Extra columns travel in
    ``row``.  A removed line's text always remains at an earlier place.
    """
    marks = repeated_places(docs, key, text).withColumnRenamed("id", "_id").withColumnRenamed("version", "_v")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(key).alias("id"), F.col(text).alias("text"))
    joined = rows.join(
        marks, F.col("id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_v")), "left"
    ).select("row", "id", "text", "starts", F.split("text", "\n", -1).alias("lines"))
    count = F.size("lines")
    starts = F.col("starts")

    def gap(start, at):
        """What lies between one covered run's end and the next start."""
        next_start = F.coalesce(F.get(starts, at + 1), count)
        return F.slice("lines", start + WINDOW + 1, F.greatest(next_start - start - WINDOW, F.lit(0)))

    kept = F.flatten(F.concat(
        F.array(F.slice("lines", F.lit(1), F.get(starts, F.lit(0)))), F.transform(starts, gap)))
    cut = joined.withColumn("kept", F.when(starts.isNull(), F.col("lines")).otherwise(kept))
    n_lines = F.coalesce(count, F.lit(0)).cast("long")
    return cut.select(
        "row", "id",
        F.when(starts.isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.when(starts.isNull(), 0).otherwise(count - F.size("kept")).cast("long").alias("n_removed"),
    )
