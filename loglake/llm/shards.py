"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised, documents are sorted by the index
of their cell on a Hilbert curve, and the order is cut into runs whose counts
differ by one at most.  Neighbours on the curve are neighbours in every
dimension, so each shard covers a small box of the metadata space and a reader
that filters on any of the dimensions skips most shards by their statistics.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import SLOT, number_rows, slotted
from ..session import delete_path, materialize
from .steps import row_hash

LEVEL_BITS = 5
#: Characters of a category by which it is ordered; values equal so far share a level.
PREFIX = 64
LAW = "rows"


def _transitions(dims: int) -> tuple[list[int], list[int]]:
    """Digit and next state for each (state, octant); a state is entry * dims + direction."""
    cells, mask = 1 << dims, (1 << dims) - 1

    def turn(value: int, by: int) -> int:
        by %= dims
        return ((value << by) | (value >> (dims - by))) & mask

    def gray(value: int) -> int:
        return value ^ (value >> 1)

    ordinal = {gray(w): w for w in range(cells)}
    digits, following = [], []
    for state in range(cells * dims):
        entry, direction = divmod(state, dims)
        for octant in range(cells):
            w = ordinal[turn(octant ^ entry, -(direction + 1))]
            low = w if w % 2 else max(w - 1, 0)
            trailing_ones = (~low & (low + 1)).bit_length() - 1 if w else 0
            entered = gray(2 * ((w - 1) // 2)) if w else 0
            digits.append(w)
            following.append(
                (entry ^ turn(entered, direction + 1)) * dims
                + (direction + trailing_ones % dims + 1) % dims
            )
    return digits, following


def hilbert_index(levels: Sequence[Column], bits: int = LEVEL_BITS) -> Column:
    """Position on the curve of the cell with these levels, each of [0, 2^bits)."""
    dims = len(levels)
    digits, following = (F.array(*map(F.lit, table)) for table in _transitions(dims))

    def descend(at: Column, bit: Column) -> Column:
        octant = sum(
            F.call_function("shiftright", level.cast("int"), bit).bitwiseAND(F.lit(1)) * (1 << axis)
            for axis, level in enumerate(levels)
        )
        entry = at["state"] * (1 << dims) + octant
        return F.struct(
            (at["index"] * (1 << dims) + F.get(digits, entry)).alias("index"),
            F.get(following, entry).alias("state"),
        )

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    order = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
    return F.aggregate(order, start, descend, lambda at: at["index"])


def _category(value: Column) -> Column:
    return F.substring(value.cast("string"), 1, PREFIX)


def category_starts(docs: DataFrame, value: Column, bits: int = LEVEL_BITS) -> list[str]:
    """The first value of each level of a category, in code point order.

    Few values have a level each; otherwise a level takes on values until it
    has its even share of all rows, so levels are ranges and a hot value has
    one to itself.  Values are counted first, and the counts added up within
    tasks of a range sort and then over tasks.
    """
    levels = (1 << bits) - 1
    counted = docs.select(_category(value).alias("value")).filter(F.col("value").isNotNull()).groupBy("value").agg(
        F.count("*").alias("rows"))
    stored, path = materialize(slotted(counted, [F.col("value")]), "categories")
    values, total = stored.agg(F.count("*"), F.sum("rows")).first()
    if values <= levels:
        starts = stored.select("value")
    else:
        stored = stored.withColumn("task", F.shiftright(SLOT, 33))
        earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
        offsets = stored.groupBy("task").agg(F.sum("rows").alias("held")).select(
            "task", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset"))
        within = Window.partitionBy("task").orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("rows").over(within), F.lit(0)).alias("before")
        level = F.floor((F.col("before") + F.col("offset")) * levels / total)
        starts = stored.select("task", "value", before).join(offsets, "task").groupBy(level).agg(
            F.min("value").alias("value"))
    found = sorted(row["value"] for row in starts.collect())
    delete_path(docs.sparkSession, path)
    return found


def category_level(value: Column, starts: Sequence[str]) -> Column:
    """Number of the last level that starts at the value or before it; null has level 0 to itself."""
    if not starts:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, starts)), lambda start: start <= _category(value)))


def size_steps(bits: int = LEVEL_BITS) -> list[int]:
    """Where each size level but the first begins: half powers of two above eight."""
    return [math.ceil(8 * 2 ** (step / 2)) for step in range(1, 1 << bits)]


def size_level(size: Column, bits: int = LEVEL_BITS) -> Column:
    """The last level holds everything larger."""
    return F.size(F.filter(F.array(*map(F.lit, size_steps(bits))), lambda step: step <= size))


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def curve_of_documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> Column:
    """Curve index of a row of ``docs`` by source, language and size."""
    categories = [category_level(F.col(name), category_starts(docs, F.col(name))) for name in (source, lang)]
    return hilbert_index([*categories, size_level(text_size(F.col(text)))])


def assign_shards(
    docs: DataFrame, shards: int, curve: Column | None = None, key: str = "doc_id"
) -> DataFrame:
    """Every row of ``docs`` with its ``curve``, ``shard`` and ``slot``.

    Rows are ordered by curve index, then ``key``, then all their values, so
    reruns agree; rows equal in all of them are interchangeable.  Counts of two
    shards differ by one at most and slots count from 0 without gaps.  With
    fewer rows than shards the last shards stay empty; an empty table gives an
    empty result; nulls have levels of their own.  Columns of ``docs`` that
    bear the names of the three new ones are replaced.

    The range sort splits a hot cell by key and value, so no task grows with a
    group of equal metadata.
    """
    curve = curve_of_documents(docs) if curve is None else curve
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), curve.alias("curve"))
    numbered = number_rows(packed, "rank", [F.asc("curve"), F.asc(f"row.{key}"), row_hash(docs).asc()], base=-1)
    total = numbered.count()
    small, larger = divmod(total, shards)
    edge = larger * (small + 1)
    rank = F.col("rank")
    if small:
        in_small = F.floor((rank - edge) / small)
        shard = F.when(rank < edge, F.floor(rank / (small + 1))).otherwise(larger + in_small)
    else:
        shard = rank
    start = F.col("shard") * small + F.least(F.col("shard"), F.lit(larger))
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("curve", "shard", "slot")]
    return numbered.withColumn("shard", shard.cast("int")).select(
        *kept, "curve", "shard", (rank - start).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in curve order, so file statistics are tight.

    A shard is cut by slot into as many files as its rows need; ``slot`` in the
    range keeps one large shard from being one task.
    """
    order = ["shard", "slot"]
    (sharded.repartitionByRange(*order).sortWithinPartitions(*order)
     .write.partitionBy("shard").parquet(path))
