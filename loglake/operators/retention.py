"""Retention by age, bounded by a number of rows.

Both forms come down to one position: every row at or below (timestamp, id)
goes.  No id list, no anti join, no rewriting of the rows that stay.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.isotime import micros_literal, micros_of
from ..plans.specs import RetentionOptions
from .numbering import number_rows
from .rollup import MINUTE, build_rollup

_DAY_MICROS = 86_400_000_000
_MAX_ID = 2 ** 63 - 1
# Up to this many rows one task may keep; more are ordered by range partitions.
_ONE_TASK_ROWS = 100_000


@dataclass(frozen=True)
class Position:
    """A place in oldest-first (timestamp, id) order."""

    micros: int
    id: int = _MAX_ID

    def covers(self) -> Column:
        """Rows at or before the position."""
        edge = micros_literal(self.micros)
        at_edge = (F.col("timestamp") == edge) & (F.col("id") <= F.lit(self.id))
        return (F.col("timestamp") < edge) | at_edge


def cutoff_micros(now: dt.datetime, options: RetentionOptions) -> int:
    """Rows strictly older than this have expired; one exactly at it stays."""
    return micros_of(now) // 1000 * 1000 - options.days * _DAY_MICROS


def expired(logs: DataFrame, cutoff: int) -> DataFrame:
    return logs.filter(F.col("timestamp") < micros_literal(cutoff))


def survivors(
    logs: DataFrame, now: dt.datetime, options: RetentionOptions, bounded: bool = True
) -> DataFrame:
    """What one retention run leaves; ``bounded=False`` deletes all that expired."""
    cutoff = cutoff_micros(now, options)
    position = Position(cutoff - 1)
    if bounded:
        old = expired(logs, cutoff)
        _, nth = nth_oldest(old, options.max_rows, build_rollup(old))
        position = nth or position
    return logs.filter(~position.covers())


def nth_oldest(logs: DataFrame, n: int, minutes: DataFrame) -> tuple[int, Position | None]:
    """The number of rows, and the position of the n-th oldest if there are that many.

    ``minutes`` holds the counts of ``logs`` per minute (``start_1m, count``).
    They lead to the day, then to the minute.  Only that minute's rows are put
    in order, and a minute that holds most of the table is ordered by range
    partitions, not in one task.
    """
    day = _slice_of("start_1m", _DAY_MICROS)
    days = _counts(minutes, day)
    total = sum(count for _, count in days)
    if total < n:
        return total, None
    chosen_day, left = _find(days, n)
    minute = _slice_of("start_1m", MINUTE)
    in_day = _counts(minutes.filter(day == chosen_day), minute)
    chosen_minute, left = _find(in_day, left)
    rows = logs.filter(
        (F.col("timestamp") >= micros_literal(chosen_minute * MINUTE))
        & (F.col("timestamp") < micros_literal((chosen_minute + 1) * MINUTE))
    ).select(F.unix_micros("timestamp").alias("micros"), "id")
    order = [F.asc("micros"), F.asc("id")]
    if left <= _ONE_TASK_ROWS:
        row = rows.orderBy(*order).limit(left).orderBy(F.desc("micros"), F.desc("id")).first()
    else:
        row = number_rows(rows, "_rank", order).filter(F.col("_rank") == left).first()
    return total, Position(row["micros"], row["id"])


def _slice_of(column: str, width: int) -> Column:
    micros = F.unix_micros(column)
    return ((micros - F.pmod(micros, F.lit(width))) / width).cast("long")


def _counts(minutes: DataFrame, slices: Column) -> list[tuple[int, int]]:
    """Rows per day of the calendar, or per minute of one day: a short list."""
    counted = minutes.groupBy(slices.alias("slice")).agg(F.sum("count").alias("count"))
    return sorted(tuple(row) for row in counted.collect())


def _find(counts: list[tuple[int, int]], n: int) -> tuple[int, int]:
    """The slice the n-th row falls in and its number within the slice."""
    for place, count in counts:
        if n <= count:
            return place, n
        n -= count
    raise ValueError("fewer rows than asked for")
