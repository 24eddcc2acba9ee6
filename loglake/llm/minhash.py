"""Near-dedup by ProbMinHash, banding and verification.

A document is the multiset of its shingles of five words; a shingle's weight
is how often it occurs.  Every shingle lets points arrive in a Poisson process
of its weight's rate, each at a random register; a register keeps the shingle
of its earliest point, and a document's processes stop at the time by which
all its registers are filled.  Two documents agree in a register with their
probability Jaccard similarity

    J = sum over common i of 1 / sum over j of max(a_j / a_i, b_j / b_i),

which for equal weights is the Jaccard similarity.  Bands of registers give
candidates and J itself, from whole texts, decides.

Identical shingle multisets are one node from the start, numbered in order of
their smallest key; keys name classes only at the end, so a key may hold
several texts.  In each bucket all nodes are compared with the smallest, which settles most.  A bucket that then
still holds several components is cut into blocks, and every pair of blocks is
a task that compares its nodes of different components where they lie: a bound
from one matrix product leaves few pairs, J decides, and pairs that the task
has connected already are passed over.  So no group of copies is expanded into
rows of pairs, and no link between components is given up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from ..session import bound_batches, materialize
from .components import components
from .steps import row_hash
from .texts import by_piece, give_back, mixed, window_hashes, windows, words_of

WIDTH = 5
SIMILARITY = 0.8
#: 24 bands of 5 registers: a pair at J = 0.8 is missed with probability 7e-5.
BANDS = 24
ROWS = 5

#: Nodes in one block of a bucket that is not settled yet.
_BLOCK = 256
#: Shingles looked at together when shares of two blocks' nodes are bounded.
_COLUMNS = 1 << 14
_SIGNED = "id long, print long, c1 long, c2 long, bands array<long>"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def weighted_shingles(column, width: int = WIDTH):
    """Distinct shingles of several texts: (bounds, hashes, weights), sorted by hash in each text.

    A text of fewer words is one shingle of them all; without words it has none.
    """
    words = words_of(column)
    hashes, counts = words.hashes(), words.counts
    starts, bounds = windows(words.bounds, width)
    found = window_hashes(hashes, starts, width)
    owner = np.repeat(np.arange(len(counts)), np.diff(bounds))
    for text in np.flatnonzero((counts > 0) & (counts < width)):
        own = hashes[words.bounds[text]:words.bounds[text + 1]]
        whole = window_hashes(own, np.zeros(1, np.int64), len(own), salt=len(own))
        found, owner = np.append(found, whole), np.append(owner, text)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    weights = np.diff(np.append(first, len(found)))
    return np.searchsorted(owner[first], np.arange(len(counts) + 1)), found[first], weights


def signatures(bounds, hashes, weights, registers: int) -> np.ndarray:
    """ProbMinHash signatures, one row per text; 0 where a text has no shingle."""
    texts = len(bounds) - 1
    owner = np.repeat(np.arange(texts), np.diff(bounds))
    earliest = np.full(texts * registers, np.inf)
    kept = np.zeros(texts * registers, np.uint64)
    at = np.zeros(len(hashes))
    rate, points, draws = weights.astype(float), 0, 1
    while len(hashes):
        limit = earliest.reshape(texts, registers).max(axis=1)
        for _ in range(draws):
            points += 1
            bits = mixed(hashes + np.uint64(points * int(_STEP) % (1 << 64)))
            at = at - np.log(((bits >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / rate
            low = mixed(bits + _STEP) >> np.uint64(32)
            place = owner * registers + ((low * np.uint64(registers)) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(earliest, place, at)
            won = earliest[place] == at
            kept[place[won]] = hashes[won]
        limit = earliest.reshape(texts, registers).max(axis=1)
        # A process whose last point came after all registers are filled has ended.
        alive = at < limit[owner]
        hashes, owner, at, rate = hashes[alive], owner[alive], at[alive], rate[alive]
        draws = min(2 * draws, 64) if points > 2 else 1
    return kept.reshape(texts, registers)


def similarity(one, other) -> float:
    """Probability Jaccard of two (hashes, weights), hashes sorted."""
    (left, a), (right, b) = one, other
    if not len(left) or not len(right):
        return 0.0
    _, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    if a.max() == 1 and b.max() == 1:
        return len(i) / (len(left) + len(right) - len(i))
    # Shares by falling a/b: of those above a common shingle's own a/b the
    # a side is the larger, of the others the b side.
    only_b = np.delete(b, j)
    common_a, common_b = a[i].astype(float), b[j].astype(float)
    order = np.argsort(-common_a / common_b, kind="stable")
    common_a, common_b = common_a[order], common_b[order]
    above = np.delete(a, i).sum() + np.cumsum(common_a)
    below = only_b.sum() + common_b.sum() - np.cumsum(common_b)
    return float((1 / (above / common_a + below / common_b)).sum())


def _sign(batch: pa.RecordBatch, bands: int, rows: int) -> pa.RecordBatch:
    bounds, hashes, weights = weighted_shingles(batch.column("text"))
    registers = signatures(bounds, hashes, weights, bands * rows)
    texts = len(bounds) - 1
    keys = registers.reshape(texts * bands, rows)
    keys = window_hashes(keys.ravel(), np.arange(0, keys.size, rows), rows).reshape(texts, bands)
    keys = mixed(keys + np.arange(bands, dtype=np.uint64) * _STEP)
    sums = []
    for salt in (1, 2):
        each = mixed(hashes + np.uint64(salt)) * weights.astype(np.uint64)
        totals = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
        sums.append((totals[bounds[1:]] - totals[bounds[:-1]]).view(np.int64))
    filled = np.diff(bounds) > 0
    # A text without words is a content of its key alone and in no bucket.
    ids = batch.column("id")
    first = np.where(filled, sums[0], ids.fill_null(0).to_numpy())
    offsets = np.concatenate([[0], np.cumsum(filled * bands)]).astype(np.int32)
    band_lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64)[filled].ravel()))
    return pa.RecordBatch.from_arrays(
        [ids, batch.column("print"), pa.array(first), pa.array(sums[1]), band_lists],
        ["id", "print", "c1", "c2", "bands"])


def _verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of texts at or above the threshold."""
    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            batch = whole.slice(start, 256)
            sides = []
            for name in ("text_a", "text_b"):
                encoded = batch.column(name).dictionary_encode()
                bounds, hashes, weights = weighted_shingles(encoded.dictionary)
                at = encoded.indices.to_numpy(zero_copy_only=False)
                sides.append((bounds, hashes, weights, at))
            (ba, ha, wa, ia), (bb, hb, wb, ib) = sides
            near = [
                similarity((ha[ba[x]:ba[x + 1]], wa[ba[x]:ba[x + 1]]), (hb[bb[y]:bb[y + 1]], wb[bb[y]:bb[y + 1]]))
                >= threshold
                for x, y in zip(ia, ib)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))
    give_back()


def near_duplicate_classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text",
    similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """(id, class_id, kept) of every row of ``docs``; a class's id is its smallest ``key``.

    Texts at or above the similarity, and all connected through such pairs,
    form a class, of which one row is kept: one with the smallest key.  Null,
    empty and blank texts are classes by themselves, one for each key; so is
    a row without a key, whose class is null.  Rows that share a key are told
    apart by their texts; classes of different texts with the same smallest
    key have the same id and a kept row each.
    """
    signed, contents, found = _classes(docs, key, text, similarity, bands, rows)
    named = contents.select("node", "c1", "c2", "slot").join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    heads = contents.select(F.col("node").alias("component"), F.col("id").alias("class_id"))
    named = named.join(heads, "component")
    kept = (F.col("node") == F.col("component")) & (F.col("slot") == F.col("first_slot"))
    classes = signed.filter(F.col("id").isNotNull()).select("id", "c1", "c2", "slot").join(
        named.withColumnRenamed("slot", "first_slot"), ["c1", "c2"]).select("id", "class_id", kept.alias("kept"))
    nameless = signed.filter(F.col("id").isNull())
    return classes.unionByName(nameless.select("id", F.col("id").alias("class_id"), F.lit(True).alias("kept")))


def _classes(
    docs: DataFrame, key: str, text: str, similarity: float, bands: int, rows: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed rows, numbered contents with their first row, (node, component) of linked contents).

    Nodes are in order of their first rows, so a component's number is the
    node whose row comes first.
    """
    bound_batches(docs.sparkSession)
    value = F.col(text)
    rows_in = docs.select(F.col(key).alias("id"), value.alias("text"), F.xxhash64(value).alias("print"))
    signable = rows_in.withColumn("text", F.when(F.col("id").isNotNull(), F.col("text")))
    signed, _ = materialize(
        signable.mapInArrow(by_piece("text", lambda batch: _sign(batch, bands, rows)), _SIGNED).withColumn(
            "slot", F.monotonically_increasing_id()), "signatures")
    contents = signed.filter(F.col("id").isNotNull()).groupBy("c1", "c2").agg(
        F.min(F.struct("id", "print", "slot")).alias("first"), F.first("bands").alias("bands")
    ).select("first.*", "c1", "c2", "bands")
    contents, _ = materialize(number_rows(contents, "node", [F.asc(c) for c in ("id", "print", "slot")]), "contents")
    buckets = contents.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter(
        F.col("least") < F.col("most"))
    members, _ = materialize(buckets.join(shared, "bucket").select("bucket", "node", "least"), "buckets")

    involved = contents.join(members.select("node").distinct(), "node").select("id", "print", "node")
    # Repeated rows meet before the shuffle, so no key's texts gather in one task.
    once = rows_in.filter(F.col("id").isNotNull()).groupBy("id", "print").agg(F.first("text").alias("text"))
    texts, _ = materialize(once.join(involved, ["id", "print"]).select("node", "text"), "texts")
    stars = members.filter(F.col("node") > F.col("least")).select(
        F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    links, _ = materialize(_verify(stars, texts, similarity), "links")
    found = components(links)

    more, _ = materialize(_settle(members, found, contents, texts, similarity), "links")
    if more.take(1):
        found = components(links.unionByName(more))
    return signed, contents, found


def _settle(
    members: DataFrame, found: DataFrame, contents: DataFrame, texts: DataFrame, threshold: float
) -> DataFrame:
    """Links between different components that share a bucket."""
    placed, _ = materialize(
        members.join(found, "node", "left").select(
            "bucket", "node", F.coalesce("component", "node").alias("component")), "unsettled")
    several = placed.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")
    ).filter(F.col("low") < F.col("high"))
    last = F.floor((F.col("n") - 1) / _BLOCK)
    open_members = placed.join(several.select("bucket", last.alias("last")), "bucket")
    # Blocks by a hash of the node are even enough and need no order of the bucket.
    block = F.pmod(F.xxhash64("node"), F.col("last") + 1)
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda other: F.struct(
        F.least(F.col("block"), other).alias("one"), F.greatest(F.col("block"), other).alias("two"),
        (other < F.col("block")).cast("int").alias("side")))
    facts = texts.join(contents.select("node", "bands"), "node")
    tasks = open_members.withColumn("block", block).select("bucket", "node", "component", F.inline(meets)).join(
        facts, "node").select("bucket", "one", "two", "side", "node", "component", "bands", "text")
    return tasks.groupBy("bucket", "one", "two").applyInArrow(_meet(threshold), "a long, b long")


def _meet(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        bounds, hashes, weights = weighted_shingles(table.column("text"))
        nodes, component = table.column("node").to_numpy(), table.column("component").to_numpy()
        side = table.column("side").to_numpy()
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(nodes), -1)
        share = _shares(bounds, hashes, weights)
        possible = np.minimum(share, share.T) >= threshold - 1e-9
        possible &= component[:, None] != component[None, :]
        if side.any():
            possible &= (side[:, None] == 0) & (side[None, :] == 1)
        else:
            possible = np.triu(possible, 1)
        i, j = np.nonzero(possible)
        if len(i):
            # Pairs that meet in several buckets are looked at in the first.
            own = np.flatnonzero((bands == table.column("bucket")[0].as_py()).any(axis=0))[0]
            first = (bands[i] == bands[j]).argmax(axis=1) == own
            i, j = i[first], j[first]
        group = {value: value for value in component.tolist()}

        def root(value: int) -> int:
            while group[value] != value:
                group[value] = value = group[group[value]]
            return value

        links = []
        for x, y in zip(i.tolist(), j.tolist()):
            a, b = root(int(component[x])), root(int(component[y]))
            if a != b and similarity(
                (hashes[bounds[x]:bounds[x + 1]], weights[bounds[x]:bounds[x + 1]]),
                (hashes[bounds[y]:bounds[y + 1]], weights[bounds[y]:bounds[y + 1]]),
            ) >= threshold:
                group[max(a, b)] = min(a, b)
                links.append((nodes[x], nodes[y]))
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _shares(bounds, hashes, weights) -> np.ndarray:
    """[x, y]: the share of x's weight on shingles that y has too, which bounds J from above."""
    texts = len(bounds) - 1
    owner = np.repeat(np.arange(texts), np.diff(bounds))
    total = np.maximum(np.add.reduceat(np.append(weights, 0), bounds[:-1]), 1) if texts else np.zeros(0)
    part = (weights / total[owner]).astype(np.float32)
    _, column, times = np.unique(hashes, return_inverse=True, return_counts=True)
    common = times[column] > 1
    owner, part, column = owner[common], part[common], column[common]
    order = np.argsort(column, kind="stable")
    owner, part, column = owner[order], part[order], column[order]
    share = np.zeros((texts, texts))
    start = 0
    while start < len(column):
        first = column[start]
        stop = int(np.searchsorted(column, first + _COLUMNS))
        held = np.zeros((texts, column[stop - 1] - first + 1), np.float32)
        held[owner[start:stop], column[start:stop] - first] = part[start:stop]
        share += held @ (held > 0).astype(np.float32).T
        start = stop
    return share + 1e-5


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(
        lambda batches: _verified(batches, threshold), "a long, b long")


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text",
    similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row of each class: that of its first text under its smallest ``key``.  Rows without a key stay.

    Of several rows with that key and text the one whose values hash lowest stays.
    """
    _, contents, found = _classes(docs, key, text, similarity, bands, rows)
    others = found.filter(F.col("node") != F.col("component"))
    heads = contents.join(others, "node", "left_anti").select("id", "print")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(text).alias("print"))
    nameless = packed.filter(F.col(f"row.{key}").isNull()).select("row")
    once = packed.withColumn("id", F.col(f"row.{key}")).filter(F.col("id").isNotNull()).groupBy("id", "print").agg(
        F.min_by("row", row_hash(docs)).alias("row"))
    return once.join(heads, ["id", "print"], "left_semi").select("row").unionByName(nameless).select("row.*")
