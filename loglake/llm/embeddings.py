"""Near-duplicate vectors by sorted projection passes.

In each pass a vector's key is the concatenation of the signs of its random
projections.  Vectors of one label are ordered by key; each is compared with a
bounded window of its neighbours in that order, and vectors whose keys share
their first ``cell_bits`` are compared in any case: cells longer than the
window are cut into blocks, and every pair of blocks is a task of its own.
The cosine, in double precision, decides.

A pair can be met in several passes.  It is counted in the first one that
covers it, which every task can tell from the positions and keys the rows
carry; so links are counted without listing them.  Identical vectors are one
row with a count, numbered in order of their smallest id.

Cells grow finer with the largest label, and passes are added with them, so
that the chance to miss a pair is the same at every size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from ..session import materialize
from .components import components

COSINE = 0.98
#: Passes at least; at 12 bits a pair at the limit shares no cell in any of them with probability 5e-7.
PASSES = 24
#: A pair at the limit shares no cell with at most this probability, whatever the bits of a cell.
MISSED = 1e-6
WINDOW = 32
_KEY_BITS = 31
_CELL_BITS = 12
#: Rows of the largest label in a cell, on average, from which cells are finer.
_CELL_ROWS = 64
#: Rows of one task that slides the window, and of one block of a long cell.
_CHUNK = 4096
_BLOCK = 1024
_SEED = 20240229

_VECTORS = "id long, label long, dim int, vec binary, keys array<int>"
_FOUND = "rep long, links long, root long"


def plan_passes(rows: int, cosine: float = COSINE, passes: int = PASSES) -> tuple[int, int]:
    """(bits of a cell, passes) for a largest label of ``rows`` vectors."""
    bits = min(_KEY_BITS, max(_CELL_BITS, math.ceil(math.log2(max(rows, 2) / _CELL_ROWS))))
    if cosine >= 1:
        return bits, passes
    apart = math.log1p(-((1 - math.acos(cosine) / math.pi) ** bits))
    return bits, max(passes, math.ceil(math.log(MISSED) / apart))


def _units(rows: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so no square overflows."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _key_maker(passes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(_KEY_BITS - 1, -1, -1)
        for batch in batches:
            lists = batch.column("embedding")
            sizes = np.diff(lists.offsets.to_numpy())
            numbers = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                units = _units(numbers[starts[at][:, None] + np.arange(dim)])
                if dim not in planes:
                    planes[dim] = np.random.default_rng([_SEED, dim]).standard_normal((dim, passes * _KEY_BITS))
                signs = (units @ planes[dim] > 0).reshape(len(at), passes, _KEY_BITS)
                keys = (signs * powers).sum(axis=2).astype(np.int32)
                picked = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([
                    picked.column("id"), picked.column("label"),
                    pa.array(np.full(len(at), dim, np.int32)),
                    pa.array([row.tobytes() for row in units], pa.binary()),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(at) + 1, dtype=np.int32) * passes), pa.array(keys.ravel())),
                ], ["id", "label", "dim", "vec", "keys"])

    return run


class _Rows:
    """Rows of one task as arrays; all compared rows share label and dimension."""

    def __init__(self, table: pa.Table):
        self.rep = table.column("rep").to_numpy()
        self.weight = table.column("weight").to_numpy()
        self.vectors = np.frombuffer(
            b"".join(table.column("vec").to_pylist()), np.float64).reshape(len(self.rep), -1)
        rows = len(self.rep)
        self.keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(rows, -1)
        self.places = table.column("places").combine_chunks().flatten().to_numpy().reshape(rows, -1)
        self.links = np.zeros(rows, np.int64)
        self.root = np.arange(rows)

    def compare(self, left: np.ndarray, right: np.ndarray, turn: int, wide: bool, cosine: float, cell: int) -> None:
        """Count pairs of ``left`` x ``right`` rows that rule (pass ``turn``, window or cell) is the first to cover."""
        near = self.vectors[left] @ self.vectors[right].T >= cosine
        i, j = np.nonzero(near)
        i, j = left[i], right[j]
        once = i < j if left is right else i != j
        i, j = i[once], j[once]
        close = np.abs(self.places[i] - self.places[j]) <= WINDOW
        same = (self.keys[i] >> cell) == (self.keys[j] >> cell)
        covered = same[:, turn] if wide else close[:, turn]
        i, j, close, same = i[covered], j[covered], close[covered], same[covered]
        fresh = ~(close[:, :turn] | same[:, :turn]).any(axis=1)
        if wide:
            fresh &= ~close[:, turn]
        np.add.at(self.links, i[fresh], self.weight[j[fresh]])
        np.add.at(self.links, j[fresh], self.weight[i[fresh]])
        self._join(i, j)

    def _join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Hang linked rows of the task on one of them."""
        root = self.root
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root[...] = root[root]

    def found(self) -> pa.Table:
        told = (self.links > 0) | (self.root != np.arange(len(self.root)))
        return pa.table({
            "rep": pa.array(self.rep[told]), "links": pa.array(self.links[told]),
            "root": pa.array(self.rep[self.root[told]])})


def _slide(cosine: float, cell: int):
    """Each row of a chunk against the next ``WINDOW`` rows; the chunk's tail is the next one's head."""
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("place").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        turns, labels = table.column("turn").to_numpy(), table.column("label").to_numpy()
        dims, own = table.column("dim").to_numpy(), table.column("own").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(turns) != 0) | (np.diff(labels) != 0) | (np.diff(dims) != 0)) + 1
        parts = []
        for low, high in zip(np.append(0, cuts), np.append(cuts, table.num_rows)):
            rows = _Rows(table.slice(low, high - low))
            mine = int(own[low:high].sum())
            for at in range(0, mine, WINDOW):
                block = np.arange(at, min(at + WINDOW, mine))
                rows.compare(block, block, int(turns[low]), False, cosine, cell)
                after = np.arange(block[-1] + 1, min(block[-1] + 1 + WINDOW, high - low))
                if len(after):
                    rows.compare(block, after, int(turns[low]), False, cosine, cell)
            parts.append(rows.found())
        return pa.concat_tables(parts)

    return run


def _meet(cosine: float, cell: int):
    """Two blocks of one long cell, or one block with itself."""
    def run(table: pa.Table) -> pa.Table:
        rows = _Rows(table)
        turn = int(table.column("turn")[0].as_py())
        side = table.column("side").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        for low in range(0, len(left), 256):
            part = left[low:low + 256]
            if len(right):
                rows.compare(part, right, turn, True, cosine, cell)
            else:
                rows.compare(part, part, turn, True, cosine, cell)
                if low + 256 < len(left):
                    rows.compare(part, left[low + 256:], turn, True, cosine, cell)
        return rows.found()

    return run


def _valid(embedding: str) -> Column:
    whole = F.col(embedding)
    fine = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < math.inf))
    return whole.isNotNull() & fine & F.exists(whole, lambda x: x != 0)


def near_duplicate_vectors(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label",
    cosine: float = COSINE, passes: int = PASSES,
) -> DataFrame:
    """(id, n_links, component_id) of every row of ``vectors``.

    Two vectors are linked when their labels are equal and not null, they have
    as many components, and their cosine is at least ``cosine``.  Null, empty
    and zero vectors, and those with a null or non-finite component, link with
    nothing; so do rows without a key.  Repeated rows are vectors of their own
    and link with each other.  Extra columns are not read.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), embedding)
    usable = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(_valid(embedding), F.lit(False)))
    largest = usable.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    cell_bits, passes = plan_passes(largest or 0, cosine, passes)
    cell = _KEY_BITS - cell_bits
    keyed, _ = materialize(
        usable.select("id", "label", F.col(embedding).cast("array<double>").alias("embedding")).mapInArrow(
            _key_maker(passes), _VECTORS), "keys")
    # Identical vectors share their keys; the bytes themselves decide.
    alike = keyed.groupBy("label", "dim", "vec").agg(
        F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("keys").alias("keys"))
    # One id may have several vectors, so each is told by a number of its own.
    order = [F.asc(c) for c in ("id", "label", "dim", "vec")]
    distinct, _ = materialize(number_rows(alike.withColumnRenamed("rep", "id"), "rep", order), "vectors")

    turns = distinct.select("label", "dim", "rep", F.posexplode("keys").alias("turn", "key"))
    ordered = number_rows(turns, "place", [F.asc(c) for c in ("turn", "label", "dim", "key", "rep")], base=-1)
    places, _ = materialize(ordered, "places")
    gathered = places.groupBy("rep").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("turn", "place"))), lambda x: x["place"]).alias("places"))
    full, _ = materialize(distinct.drop("id").join(gathered, "rep"), "placed")

    chunk = F.floor(F.col("place") / _CHUNK)
    # Rows that open a chunk are also what the chunk before it slides into.
    head = F.when(F.col("place") % _CHUNK < 2 * WINDOW, F.array(chunk, chunk - 1)).otherwise(F.array(chunk))
    at_turn = full.select("*", F.posexplode("places").alias("turn", "place"))
    dealt = at_turn.select("*", F.explode(head).alias("chunk")).withColumn("own", (chunk == F.col("chunk")).cast("int"))
    columns = ["rep", "label", "dim", "weight", "vec", "keys", "places", "turn", "place", "own", "chunk"]
    found = dealt.select(*columns).filter(F.col("chunk") >= 0).groupBy("chunk").applyInArrow(_slide(cosine, cell), _FOUND)

    prefix = F.shiftright("key", cell).alias("prefix")
    cells = places.groupBy("turn", "label", "dim", prefix).agg(
        F.min("place").alias("low"), F.count("*").alias("n")).filter(F.col("n") > WINDOW)
    own_prefix = F.shiftright(F.get("keys", F.col("turn")), cell).alias("prefix")
    inside = at_turn.select("*", own_prefix).join(cells, ["turn", "label", "dim", "prefix"])
    block = F.floor((F.col("place") - F.col("low")) / _BLOCK)
    last = F.floor((F.col("n") - 1) / _BLOCK)
    # A row of block b meets blocks b .. last on the left side, 0 .. b-1 on the right.
    meets = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda other: F.struct(
        F.least(F.col("block"), other).alias("one"), F.greatest(F.col("block"), other).alias("two"),
        (other < F.col("block")).cast("int").alias("side")))
    pairs = inside.withColumn("block", block).select(
        "rep", "weight", "vec", "keys", "places", "turn", "low", F.inline(meets))
    found = found.unionByName(
        pairs.groupBy("low", "one", "two").applyInArrow(_meet(cosine, cell), _FOUND))
    found, _ = materialize(found, "links")

    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).filter("a <> b").distinct())
    heads = distinct.select(F.col("rep").alias("component"), F.col("id").alias("component_id"))
    named = joined.join(heads, "component").select(F.col("node").alias("rep"), "component_id")
    reps = distinct.select("label", "dim", "vec", "rep", "id", "weight").join(counted, "rep", "left").join(
        named, "rep", "left")
    facts = reps.select(
        "label", "dim", "vec", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"))
    linked = keyed.select("id", "label", "dim", "vec").join(facts, ["label", "dim", "vec"]).select(
        "id", "n_links", "component_id")
    others = rows.filter(~(F.col("id").isNotNull() & F.col("label").isNotNull()
                           & F.coalesce(_valid(embedding), F.lit(False))))
    return linked.unionByName(others.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
