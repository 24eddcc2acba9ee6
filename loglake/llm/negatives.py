"""Hard negatives with bounds handed down a spanning tree of anchors.

Anchors and candidates are cut into blocks, and every pair of blocks is a task.
A minimum spanning tree joins the anchors of a block.  Going down the tree, the
score of a candidate at the parent, give or take the edge's length times the
candidate's norm, bounds its score at the child; only candidates whose bounds
reach into a window that the child still looks for are scored again, which
makes their bounds exact.  The others hand their bounds on.

The first round finds the positives of each anchor, whose windows are open
upwards from the least positive so far; the second finds the negatives in the
windows that the positives' scores make.  Blocks only keep what may be among
the first of all, and a window over each anchor's few finds merges them.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from .steps import settled

POSITIVES = 5
NEGATIVES = 3
#: A negative's score lies between these percentages of its positive's.
LEAST_PERCENT, MOST_PERCENT = 50, 95
#: Rows of a block; a task holds one of each kind.
ANCHOR_BLOCK = 2048
CANDIDATE_BLOCK = 8192

#: From this bound of scores on doubles are not exact, and whole numbers of any size take their place.
_EXACT = float(1 << 53)
#: If more than one in so many candidates must be scored again, all are: that takes no copy, and bounds get tighter.
_WORTH_ALL = 8
_FOUND = "anchor long, window int, score decimal(38,0), id long, row long"
_LARGEST = 10 ** 38 - 1


def _quantised(embedding: Column) -> Column:
    return F.transform(embedding.cast("array<double>"), lambda x: F.floor(x * 256))


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, length of the edge to it) of a minimum spanning tree by Euclidean distance.

    Every vector comes after its parent; of its children the one with the
    largest subtree comes last, so that few bounds are held at any time.  The
    root is its own parent.
    """
    n = len(vectors)
    squares = (vectors * vectors).sum(axis=1)
    apart = np.maximum(squares[:, None] + squares - 2 * (vectors @ vectors.T), 0)
    parent, nearest = np.zeros(n, np.int64), apart[0].copy()
    outside = np.ones(n, bool)
    outside[0] = False
    joined = [0]
    for _ in range(n - 1):
        at = int(np.where(outside, nearest, np.inf).argmin()) if np.isfinite(nearest[outside]).any() else int(
            np.flatnonzero(outside)[0])
        outside[at] = False
        joined.append(at)
        closer = outside & (apart[at] < nearest)
        nearest[closer], parent[closer] = apart[at][closer], at
    below = np.ones(n, np.int64)
    for at in reversed(joined[1:]):
        below[parent[at]] += below[at]
    children: list[list[int]] = [[] for _ in range(n)]
    for at in joined[1:]:
        children[parent[at]].append(at)
    order, stack = [], [0]
    while stack:
        at = stack.pop()
        order.append(at)
        stack += sorted(children[at], key=lambda child: -below[child])
    edges = np.linalg.norm(vectors - vectors[parent], axis=1)
    return np.array(order), parent, edges


class _Block:
    """Rows of a group as arrays."""

    def __init__(self, table: pa.Table):
        self.row = table.column("row").to_numpy()
        ids = table.column("id").combine_chunks()
        self.no_id = np.asarray(ids.is_null())
        self.id = ids.fill_null(0).to_numpy(zero_copy_only=False)
        label = table.column("label").combine_chunks().dictionary_encode()
        self.labels, self.codes = label.dictionary.to_pylist(), label.indices.to_numpy(zero_copy_only=False)
        vectors = table.column("vector").combine_chunks()
        self._sizes = np.asarray(vectors.value_lengths(), np.int64)
        self._flat = vectors.flatten().to_numpy(zero_copy_only=False)

    def width(self) -> int:
        return int(self._sizes.max(initial=0))

    def matrix(self, width: int, kind=np.float64) -> np.ndarray:
        """Shorter vectors end in zeros, as components that one of two vectors lacks add nothing."""
        flat = self._flat.astype(kind)
        if (self._sizes == width).all():
            return flat.reshape(len(self._sizes), width)
        matrix = np.zeros((len(self._sizes), width), kind)
        columns = np.arange(len(flat)) - np.repeat(np.cumsum(self._sizes) - self._sizes, self._sizes)
        matrix[np.repeat(np.arange(len(self._sizes)), self._sizes), columns] = flat
        return matrix


def _scores(block: _Block, rows: np.ndarray, anchor: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Exact scores of some rows: whole numbers as doubles, or as Python's if they might be too large for these."""
    if matrix.dtype == np.float64:
        return matrix[rows] @ anchor
    return matrix[rows].dot(anchor)


def _first(scores: np.ndarray, block: _Block, at: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` by score, id and row; rows without an id come behind."""
    near = np.arange(len(at))
    if len(at) > 4 * most and scores.dtype == np.float64:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - most)[len(scores) - most])
    rows = at[near]
    by_id = np.lexsort((block.row[rows], block.id[rows], block.no_id[rows]))
    by_score = sorted(by_id.tolist(), key=lambda place: -scores[near[place]])
    return near[by_score[:most]]


def _search(windows_of, most: int, same_label: bool):
    """A function for cogroups of anchors and candidates.

    ``windows_of`` gives an anchor's windows as (number, least score, largest
    score), of which the first ``most`` candidates each are found.
    """
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = _descend(left, right, windows_of, most, same_label) if left.num_rows and right.num_rows else []
        kinds = (pa.int64(), pa.int32(), pa.decimal128(38), pa.int64(), pa.int64())
        columns = list(zip(*made)) or [()] * len(kinds)
        return pa.Table.from_arrays(
            [pa.array(list(values), kind) for values, kind in zip(columns, kinds)],
            ["anchor", "window", "score", "id", "row"])

    return run


def _decimal(score) -> Decimal:
    """A score of 38 digits at most."""
    return Decimal(max(-_LARGEST, min(_LARGEST, int(score))))


def _descend(left: pa.Table, right: pa.Table, windows_of, most: int, same_label: bool) -> list[tuple]:
    anchors, block = _Block(left), _Block(right)
    width = max(anchors.width(), block.width())
    a, c = anchors.matrix(width), block.matrix(width)
    norms = np.linalg.norm(c, axis=1)
    # No partial sum of a score is larger than this.
    largest = np.linalg.norm(a, axis=1).max() * norms.max()
    exact = bool(largest < _EXACT)
    order, parent, edges = spanning_tree(a)
    rows_c, rows_a = (c, a) if exact else (block.matrix(width, object), anchors.matrix(width, object))
    code_of = {label: at for at, label in enumerate(block.labels)}
    waiting = np.bincount(parent[order[1:]], minlength=len(a))
    # Bounds at each anchor that still has children to come.
    held: dict[int, tuple] = {}
    made: list[tuple] = []
    for at in order.tolist():
        if not exact:
            low, high = np.full(len(c), -np.inf), np.full(len(c), np.inf)
        elif at == order[0]:
            low = high = c @ a[at]
        else:
            # Rounding of the edge and the norm must not cut a bound short.
            slack = edges[at] * norms * (1 + 1e-9) + 1e-6 * largest / _EXACT + 1e-6
            low, high = held[parent[at]][0] - slack, held[parent[at]][1] + slack
        if at != order[0]:
            waiting[parent[at]] -= 1
            if not waiting[parent[at]]:
                held.pop(parent[at], None)
        code = code_of.get(anchors.labels[anchors.codes[at]], -1)
        fits = ((block.codes == code) if same_label else (block.codes != code)) & (block.row != anchors.row[at])
        windows = windows_of(left, at)
        asked = np.zeros(len(c), bool)
        for _, least, top in windows:
            sure = low[fits & (low >= least) & (high <= top)]
            if len(sure) >= most:
                # So many lie in the window for certain that none below the last of them is among the first.
                least = max(least, np.partition(sure, len(sure) - most)[len(sure) - most])
            asked |= fits & (high >= least) & (low <= top)
        asked = np.flatnonzero(asked)
        if exact and len(asked) > len(c) // _WORTH_ALL:
            low = high = c @ a[at]
            scores = low[asked]
        else:
            scores = _scores(block, asked, rows_a[at], rows_c)
            if exact and at != order[0]:
                low[asked] = high[asked] = scores
        for number, least, top in windows:
            inside = np.flatnonzero((scores >= least) & (scores <= top))
            for place in inside[_first(scores[inside], block, asked[inside], most)].tolist():
                row = asked[place]
                made.append((
                    int(anchors.row[at]), number, _decimal(scores[place]),
                    None if block.no_id[row] else int(block.id[row]), int(block.row[row])))
        if waiting[at]:
            held[at] = (low, high)
    return made


def _blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """Rows with the number of their block, and the number of blocks."""
    n = rows.count()
    return rows.withColumn(name, F.floor((F.col("number") - 1) / size)), -(-n // size)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, key: str = "vec_id", embedding: str = "embedding", label: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, anchor_block: int = ANCHOR_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), all in whole numbers.

    A row's score at an anchor is the inner product of both vectors, whose
    components x are taken as floor(256 x).  An anchor's positives are the
    first ``positives`` other rows of its label, its negatives for each of them
    the first ``negatives`` rows of other labels whose score is 50 % to 95 % of
    the positive's.  Higher scores come first, then smaller ids, rows without
    an id last, and of rows with equal ids any order that stays the same.

    Rows with a null label or vector, or with a null or non-finite component,
    take no part; empty vectors score 0 with all others.  Of vectors of unequal
    length the common part counts.  Components end at the limits of a long,
    and scores that do not fit in one are null in the result.  Repeated rows are rows of their own: one
    may be the other's positive.  Extra columns are not read.  ``is_anchor``
    is a condition on ``vectors``; null is false.
    """
    finite = F.coalesce(F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                                 & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    usable = vectors.filter(F.col(label).isNotNull() & F.col(embedding).isNotNull() & finite).select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
        _quantised(F.col(embedding)).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = settled(number_rows(usable, "row"), "vectors")
    # Anchors of one label lie side by side, so that edges of their trees are short.
    chosen = settled(number_rows(
        rows.filter("anchor").drop("anchor"), "number", [F.asc("label"), F.asc("row")]), "anchors")
    anchors, anchor_blocks = _blocks(chosen, anchor_block, "i")
    candidates, candidate_blocks = _blocks(
        rows.drop("anchor").withColumn("number", F.col("row")), candidate_block, "j")
    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(blocks - 1, 0)).cast("long")))

    right = candidates.drop("number").select("*", every(anchor_blocks).alias("i"))

    def met(left: DataFrame, search) -> DataFrame:
        dealt = left.select("*", every(candidate_blocks).alias("j"))
        return dealt.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(search, _FOUND)

    def best(found: DataFrame, most: int, *group: str) -> DataFrame:
        order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)

    near = best(met(anchors.drop("number"), _search(_all_scores, positives, True)), positives, "anchor")
    near = settled(near.select("anchor", F.col("rank").alias("window"), F.col("score").alias("positive_score"),
                               F.col("id").alias("positive_id")), "positives")
    told = near.groupBy("anchor").agg(F.sort_array(F.collect_list(
        F.struct("window", "positive_score"))).alias("windows"))
    asking = anchors.drop("number").join(told, F.col("row") == F.col("anchor")).drop("anchor")
    far = best(met(asking, _search(_score_windows, negatives, False)), negatives, "anchor", "window")
    ids = chosen.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return far.join(near, ["anchor", "window"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"),
        F.col("positive_score").try_cast("long").alias("positive_score"),
        F.col("score").try_cast("long").alias("negative_score"))


def _all_scores(anchors: pa.Table, at: int) -> list[tuple[int, float, float]]:
    return [(0, -float("inf"), float("inf"))]


def _score_windows(anchors: pa.Table, at: int) -> list[tuple[int, int, int]]:
    """Whole scores n with 50 p <= 100 n <= 95 p, for each positive score p."""
    windows = []
    for told in anchors.column("windows")[at].as_py():
        score = int(told["positive_score"])
        least, top = -(-LEAST_PERCENT * score // 100), MOST_PERCENT * score // 100
        if least <= top:
            windows.append((told["window"], least, top))
    return windows
