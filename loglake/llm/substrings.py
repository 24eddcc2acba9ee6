"""Substring dedup: words inside a passage that an earlier document has too.

A window is 13 consecutive words.  Its minimiser is the smallest hash among its
runs of four words, and consecutive windows of one document that share their
minimiser make a super-k-mer.  The steps:

1. Minimisers alone are counted; one seen in a single document cannot belong
   to a repeated window, so only super-k-mers of the others go on.
2. These travel as one packed string each to their minimiser's bucket.  Equal
   strings are merged on the way, so thousands of copies arrive as one.
3. In each bucket windows are sorted and get the first document they start in.
4. Windows whose first document is an earlier one are marked in their
   documents, covered words are merged and removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import delete_path
from .steps import settled, settled_at
from .texts import by_piece, window_hashes, windows, words_of

WIDTH = 13
GRAM = 4
#: A bucket of more distinct strings is counted by windows, over many tasks.
BUCKET_ROWS = 200_000
#: Windows in one packed string; a longer run is cut, which changes no bucket.
_RUN = 64
_PLACED = "h long, doc_id long, version long, first int, n int"
_PACKED = "h long, doc_id long, version long, first int, packed binary"
_FIRSTS = "h long, pid long, firsts array<long>"
_EACH = "h long, pid long, last long, i int, w1 long, w2 long, first long"
_KEPT = "doc_id long, text string, n_words long, n_removed long"


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def _super_kmers(batch: pa.RecordBatch, width: int, gram: int) -> pa.RecordBatch | None:
    words = words_of(batch.column("text"))
    starts, bounds = windows(words.bounds, width)
    if not len(starts):
        return None
    hashes = words.hashes()
    grams = window_hashes(hashes, np.arange(len(hashes) - gram + 1), gram)
    least = _sliding_least(grams, width - gram + 1)[starts]
    owner = np.repeat(np.arange(len(words.counts)), np.diff(bounds))
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    run = np.flatnonzero(new)
    since = np.arange(len(starts)) - np.repeat(run, np.diff(np.append(run, len(starts))))
    first = np.flatnonzero(since % _RUN == 0)
    at = owner[first]
    return pa.RecordBatch.from_arrays([
        pa.array(least[first].view(np.int64)),
        batch.column("doc_id").take(pa.array(at)),
        batch.column("version").take(pa.array(at)),
        pa.array((starts[first] - words.bounds[at]).astype(np.int32)),
        pa.array(np.diff(np.append(first, len(starts))).astype(np.int32)),
    ], ["h", "doc_id", "version", "first", "n"])


def _pack(batch: pa.RecordBatch, width: int) -> pa.RecordBatch | None:
    """Each document's listed super-k-mers as words joined by one space."""
    out: list[list] = [[], [], [], [], []]
    texts = batch.column("text").cast(pa.binary()).to_pylist()
    for text, key, version, places in zip(
        texts, batch.column("doc_id").to_pylist(), batch.column("version").to_pylist(), batch.column("places")
    ):
        parts = text.split()
        joined = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        begins = np.concatenate([[0], ends + 1])
        held = places.values
        first = held.field("first").to_numpy()
        last = first + held.field("n").to_numpy() + width - 2
        left, right = begins[first].tolist(), ends[last].tolist()
        out[0].append(held.field("h"))
        out[1] += [key] * len(first)
        out[2] += [version] * len(first)
        out[3].append(held.field("first"))
        out[4] += [joined[a:b] for a, b in zip(left, right)]
    if not out[0]:
        return None
    return pa.RecordBatch.from_arrays([
        pa.concat_arrays(out[0]), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
        pa.concat_arrays(out[3]), pa.array(out[4], pa.binary()),
    ], ["h", "doc_id", "version", "first", "packed"])


def _window_keys(packed: pa.Array, width: int):
    """128 bits per window of each string, and each string's first window."""
    words = words_of(packed.cast(pa.string()))
    starts, bounds = windows(words.bounds, width)
    hashes = words.hashes()
    return window_hashes(hashes, starts, width), window_hashes(hashes, starts, width, salt=0x51CE), bounds


def _first_documents(table: pa.Table, width: int) -> pa.RecordBatch:
    """Of whole buckets: each string's windows' first documents, if any is before its last."""
    one, two, bounds = _window_keys(table.column("packed").combine_chunks(), width)
    counts = np.diff(bounds)
    first, last = table.column("first").to_numpy(), table.column("last").to_numpy()
    mine = np.repeat(first, counts)
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    group = np.flatnonzero(new)
    least = np.minimum.reduceat(mine[order], group)
    firsts = np.empty(len(order), np.int64)
    firsts[order] = np.repeat(least, np.diff(np.append(group, len(order))))
    any_earlier = np.minimum.reduceat(firsts, bounds[:-1]) < last
    keep = np.repeat(any_earlier, counts)
    lists = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(counts[any_earlier])]).astype(np.int32)), pa.array(firsts[keep]))
    chosen = table.filter(pa.array(any_earlier))
    return pa.RecordBatch.from_arrays(
        [chosen.column("h").combine_chunks(), chosen.column("pid").combine_chunks(), lists], ["h", "pid", "firsts"])


def _bucketwise(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Whole buckets of rows sorted by ``h``, some thousand strings at a time."""
    waiting: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("h").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if waiting and waiting[-1].column("h")[-1].as_py() != keys[0] and rows > 20_000:
            yield _first_documents(pa.Table.from_batches(waiting), width)
            waiting, rows = [], 0
        if cut and rows + cut > 20_000:
            yield _first_documents(pa.Table.from_batches([*waiting, batch.slice(0, cut)]), width)
            waiting, rows, batch = [], 0, batch.slice(cut)
        waiting.append(batch)
        rows += batch.num_rows
    if waiting:
        yield _first_documents(pa.Table.from_batches(waiting), width)


def _each_window(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two, bounds = _window_keys(batch.column("packed"), width)
        counts = np.diff(bounds)
        owner = pa.array(np.repeat(np.arange(batch.num_rows), counts))
        index = np.arange(len(one)) - np.repeat(bounds[:-1], counts)
        yield pa.RecordBatch.from_arrays([
            *(batch.column(name).take(owner) for name in ("h", "pid", "last")),
            pa.array(index.astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
            batch.column("first").take(owner),
        ], ["h", "pid", "last", "i", "w1", "w2", "first"])


def _without_marked(batch: pa.RecordBatch, width: int) -> pa.RecordBatch:
    texts, sizes, removed = [], [], []
    encoded = batch.column("text").cast(pa.binary()).to_pylist()
    for text, starts in zip(encoded, batch.column("starts")):
        parts = (text or b"").split()
        sizes.append(len(parts))
        if starts.is_valid and parts:
            depth = np.zeros(len(parts) + 1, np.int64)
            at = np.unique(starts.values.to_numpy())
            depth[at] += 1
            np.subtract.at(depth, np.minimum(at + width, len(parts)), 1)
            stays = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
            parts = [parts[i] for i in stays.tolist()]
        removed.append(sizes[-1] - len(parts))
        texts.append(b" ".join(parts))
    return pa.RecordBatch.from_arrays([
        batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()),
        pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
    ], ["doc_id", "text", "n_words", "n_removed"])


def marked_windows(
    docs: DataFrame, width: int = WIDTH, gram: int = GRAM, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """(doc_id, version, starts): windows that also start in an earlier document.

    ``docs`` has doc_id, version and text.  A row without a doc_id is before
    and after none.
    """
    texts = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    found = texts.mapInArrow(by_piece("text", lambda b: _super_kmers(b, width, gram)), _PLACED)
    shared = found.groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter(
        F.col("least") < F.col("most")).select("h")
    shared = settled(shared, "minimisers")
    listed = found.join(shared, "h", "left_semi").groupBy("doc_id", "version").agg(
        F.collect_set(F.struct("h", "first", "n")).alias("places"))
    packed, packed_path = settled_at(
        texts.join(listed, ["doc_id", "version"]).select("doc_id", "version", "text", "places").mapInArrow(
            by_piece("text", lambda b: _pack(b, width)), _PACKED), "super-k-mers")

    pid = F.xxhash64("packed").alias("pid")
    strings = packed.groupBy("h", "packed").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last")
    ).select("h", pid, "packed", "first", "last")
    strings = settled(strings, "strings")
    # From here on a super-k-mer is told by its bucket and hash, and its strings are on disk once.
    places = settled(packed.select("h", pid, "doc_id", "version", "first"), "places")
    delete_path(docs.sparkSession, packed_path)
    large = settled(strings.groupBy("h").count().filter(F.col("count") > bucket_rows).select("h"), "large")
    small = strings.join(large, "h", "left_anti").repartition("h").sortWithinPartitions("h")
    firsts = small.mapInArrow(lambda b: _bucketwise(b, width), _FIRSTS)
    if large.take(1):
        each = strings.join(large, "h", "left_semi").mapInArrow(lambda b: _each_window(b, width), _EACH)
        least = each.groupBy("w1", "w2").agg(F.min("first").alias("least"))
        placed = each.join(least, ["w1", "w2"]).groupBy("h", "pid").agg(
            F.sort_array(F.collect_list(F.struct("i", "least")))["least"].alias("firsts"))
        firsts = firsts.unionByName(placed)
    earlier = F.filter(
        F.sequence(F.lit(0), F.size("firsts") - 1), lambda i: F.get("firsts", i) < F.col("doc_id"))
    starts = F.transform(earlier, lambda i: i + F.col("first"))
    marked = places.join(firsts, ["h", "pid"]).select(
        "doc_id", "version", starts.alias("starts")).filter(F.size("starts") > 0)
    return marked.groupBy("doc_id", "version").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, **options
) -> DataFrame:
    """(doc_id, text, n_words, n_removed) of every row: kept words joined by one space.

    Words are runs of anything but ASCII white space.  Windows are judged on
    the input.  Null and empty texts have no words; texts of fewer words than a
    window stay whole; a row without a ``key`` stays whole and marks no other.
    Rows that share a key are one document and do not mark each other.
    """
    slim = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    marks = marked_windows(slim, width, **options).withColumnRenamed("doc_id", "_id").withColumnRenamed("version", "_v")
    joined = slim.join(marks, (F.col("doc_id") == F.col("_id")) & (F.col("version") == F.col("_v")), "left")
    return joined.select("doc_id", "text", "starts").mapInArrow(
        by_piece("text", lambda batch: _without_marked(batch, width)), _KEPT)
