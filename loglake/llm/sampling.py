"""Samples of bounded size: the rows of lowest hash in each group.

The hash covers key and text, so neither a shared nor a missing key draws rows
together.  Rows equal in both stay one row with a count until the task that
learns from them, which cuts at the limit.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FOLD_BITS = 62


def fold(*columns: str) -> Column:
    """A hash of 62 bits."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << _FOLD_BITS) - 1))


def among_lowest(rows: DataFrame, group: str, limit: int) -> tuple[list, Column]:
    """All groups, and a condition that holds for their ``limit`` rows of lowest ``fold``.

    It looks at the length of the hash, so that one count by length finds it,
    and holds for about twice as many different hashes at most.
    """
    length = F.length(F.bin("fold"))
    counted = rows.groupBy(F.col(group).alias("group"), length.alias("length")).agg(F.count("*").alias("n")).collect()
    held: dict = {}
    needed: dict = {}
    for row in sorted(counted, key=lambda row: row.length):
        if held.get(row.group, 0) < limit:
            needed[row.group] = row.length
        held[row.group] = held.get(row.group, 0) + row.n
    if not needed:
        return [], F.lit(False)
    lengths = F.create_map(*(F.lit(x) for pair in needed.items() for x in pair))
    return sorted(needed), length <= lengths[F.col(group)]


def cut(groups: Sequence, folds: Sequence[int], times: Sequence[int], limit: int) -> np.ndarray:
    """Places of the ``limit`` rows of lowest fold in each group, as often as they count, in order of fold."""
    left: dict = {}
    places = []
    for at in np.argsort(np.array(folds, np.int64), kind="stable").tolist():
        taken = min(times[at], left.setdefault(groups[at], limit))
        left[groups[at]] -= taken
        places += [at] * taken
    return np.array(places, np.int64)
