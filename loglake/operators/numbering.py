"""Dense row numbers without a global window.

The rows are written once together with their (task, position) slot.  Row
counts per task become prefix offsets, a table with one row per task, and each
row's number is its task's offset plus its position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

SLOT = "_slot"
# monotonically_increasing_id keeps the task above bit 33.
_POSITION_BITS = 33
# One row of two longs per task; beyond this many tasks the offsets are joined
# by shuffle instead of being broadcast.
_MAX_BROADCAST_TASKS = 1_000_000


def slotted(df: DataFrame, order_by: Sequence[Column] = ()) -> DataFrame:
    """Add each row's slot; with ``order_by``, slots follow that global order.

    The range partitioning splits by value, so a hot value range is spread over
    many tasks; with a unique last key even equal values are.
    """
    if order_by:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    return df.withColumn(SLOT, F.monotonically_increasing_id())


def slot_task() -> Column:
    """The task that gave a row its slot."""
    return F.shiftright(SLOT, _POSITION_BITS).alias("_task")


def slot_offsets(stored: DataFrame) -> DataFrame:
    """(task, offset, rows) for slotted rows that have been materialised."""
    position = F.col(SLOT).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    counts = stored.groupBy(slot_task()).agg(F.max(position).alias("_last"), F.count("*").alias("_rows"))
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    width = F.col("_last") + 1
    return counts.select(
        "_task", F.coalesce(F.sum(width).over(earlier), F.lit(0)).alias("_offset"), width.alias("_width"), "_rows"
    )


def number_slots(stored: DataFrame, name: str, base: int = 0, tasks: int | None = None) -> DataFrame:
    """Replace the slot by ``base`` + 1, 2, 3 ... in slot order.

    When rows were dropped after slotting, their numbers stay unused.
    """
    offsets = slot_offsets(stored).select("_task", "_offset")
    if tasks is None:
        tasks = len(stored.inputFiles())  # every task that had rows wrote a file
    if tasks <= _MAX_BROADCAST_TASKS:
        offsets = F.broadcast(offsets)
    position = F.col(SLOT).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    joined = stored.withColumn("_task", slot_task()).join(offsets, "_task")
    number = F.col("_offset") + position + 1 + F.lit(base)
    kept = [c for c in stored.columns if c != SLOT]
    return joined.select(number.alias(name), *kept)


def number_rows(
    df: DataFrame, name: str, order_by: Sequence[Column] = (), base: int = 0
) -> DataFrame:
    """Number the rows of ``df`` from ``base`` + 1 without gaps."""
    stored, _ = materialize(slotted(df, order_by), "numbering")
    return number_slots(stored, name, base)
