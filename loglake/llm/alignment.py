"""Two tokenizers aligned by the bytes of their tokens, with pointer jumping.

Both tokenizations of a text cover the same bytes.  Every token points to the
token of the other one that overlaps it farthest to the right; following the
pointers leads to the last token of its group of overlapping tokens.  All
tokens of a batch of texts take that way at once: pointers are replaced by
their pointers' pointers until nothing changes, which takes as many rounds as
the longest chain has binary digits.

Tokens of the two sides that end together are linked.  Links of a pair of ids
are counted over all documents; the commonest pairs, at most ``HEAD_PAIRS`` of
them, are sent to every task, and the links of all others meet their counts in
a join.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .steps import settled
from .texts import pieces
from .tokens import PATTERN, encode_text

#: Files of the two vocabularies; only the driver reads them.
BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Pairs of ids whose counts are sent to every task, at most: 17 bytes each.
HEAD_PAIRS = 1 << 20

#: Characters that every version of the patterns' classes agrees on.
_UNUSUAL = re.compile("[^\\x00-\\u024f\\u2010-\\u2027\\u20ac]")
_PIECE_SPACE = "▁"
_ALIGNED = (
    "id long, slot long, n_a int, n_b int, n_groups int, n_links int, groups string, "
    "a array<int>, b array<int>, times array<int>")


@dataclass(frozen=True)
class Vocabularies:
    """The contents of the two files, which travel to the tasks."""

    byte_level: str
    pieces: bytes

    @staticmethod
    def load(byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> Vocabularies:
        with open(byte_level, encoding="utf-8") as a, open(pieces, "rb") as b:
            return Vocabularies(a.read(), b.read())


def byte_of_letters() -> dict[str, int]:
    """Which byte each letter of a byte-level vocabulary stands for.

    Printable bytes stand for themselves, the others for letters from U+0100 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in set(printable)]
    return {chr(byte): byte for byte in printable} | {chr(256 + at): byte for at, byte in enumerate(others)}


class Encoders:
    """Both tokenizers, ready for use inside a task."""

    def __init__(self, vocabularies: Vocabularies):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        described = json.loads(vocabularies.byte_level)
        letters = byte_of_letters()
        special = {token["id"] for token in described.get("added_tokens", ()) if token["special"]}
        ranks = {
            bytes(map(letters.__getitem__, token)): number
            for token, number in described["model"]["vocab"].items() if number not in special}
        self.size_a = 1 + max(ranks.values())
        self.a_bytes = [b""] * self.size_a
        for token, number in ranks.items():
            self.a_bytes[number] = token
        self._usual = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._exact = Tokenizer.from_str(vocabularies.byte_level)
        self._exact.encode_special_tokens = True
        self._pieces = sentencepiece.SentencePieceProcessor(model_proto=vocabularies.pieces)
        self.size_b = self._pieces.get_piece_size()
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self._pieces.is_byte(at) else piece.replace(_PIECE_SPACE, " ").encode()
            for at, piece in enumerate(self._pieces.id_to_piece(list(range(self.size_b))))]

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both sides; none if the text is empty or a side does not keep its bytes."""
        if not text:
            return [], []
        spaced = " " + text
        if _UNUSUAL.search(text):
            a = self._exact.encode(spaced, add_special_tokens=False).ids
        else:
            a = encode_text(self._usual, spaced)
        b = self._pieces.encode(text, num_threads=1)
        whole = spaced.encode()
        if (b"".join(map(self.a_bytes.__getitem__, a)) != whole
                or b"".join(map(self.b_bytes.__getitem__, b)) != whole):
            return [], []
        return a, b


def last_tokens(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of both sides, the B token that ends its group.

    The ends are those of two tokenizations of the same bytes.  A token points
    to the token of the other side that holds its last byte, as none overlaps
    it farther right; the last B token of a group points to itself.
    """
    if not len(a_ends):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    holds_a = np.repeat(np.arange(len(a_ends)), np.diff(a_ends, prepend=0))
    holds_b = np.repeat(np.arange(len(b_ends)), np.diff(b_ends, prepend=0))
    right_a = holds_a[b_ends - 1]
    itself = len(a_ends) + np.arange(len(b_ends))
    points = np.concatenate([
        len(a_ends) + holds_b[a_ends - 1], np.where(a_ends[right_a] > b_ends, right_a, itself)])
    while True:
        farther = points[points]
        if np.array_equal(farther, points):
            return points[:len(a_ends)] - len(a_ends), points[len(a_ends):] - len(a_ends)
        points = farther


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and where each list starts."""
    bounds = np.concatenate([[0], np.cumsum([len(ids) for ids in lists], dtype=np.int64)])
    flat = np.empty(bounds[-1], np.int64)
    for ids, low in zip(lists, bounds.tolist()):
        flat[low:low + len(ids)] = ids
    return flat, bounds


def _list_array(values: np.ndarray, bounds: np.ndarray, kind=None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(kind or np.int32)))


def _group_texts(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray,
                 owner_a: np.ndarray, owner_b: np.ndarray, texts: int) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3`` of each text."""
    # Within a group all of A come first; both sides are in order of groups already.
    order = np.argsort(np.concatenate([last_a * 2, last_b * 2 + 1]), kind="stable")
    ids, group = np.concatenate([a, b])[order], np.concatenate([last_a, last_b])[order]
    side = order >= len(a)
    owner = np.concatenate([owner_a, owner_b])[order]
    mark = np.zeros(len(ids), np.int8)
    if len(ids):
        ends_side = np.append(side[1:] != side[:-1], True)
        ends_group = np.append(group[1:] != group[:-1], True)
        ends_text = np.append(owner[1:] != owner[:-1], True)
        mark = np.where(ends_text, 3, np.where(ends_group, 2, np.where(ends_side, 1, 0))).astype(np.int8)
    between = pa.array([",", "|", ";", ""]).take(pa.array(mark))
    tokens = pc.binary_join_element_wise(pc.cast(pa.array(ids), pa.string()), between, "")
    bounds = np.searchsorted(owner, np.arange(texts + 1))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), tokens), "")


def align_texts(texts: list[str | None], encoders: Encoders, digest: bool) -> list[pa.Array]:
    """The columns of ``_ALIGNED`` behind id and slot, for some whole texts."""
    encoded = [encoders.encode(text) if text else ([], []) for text in texts]
    (a, a_bounds), (b, b_bounds) = _flat([ids for ids, _ in encoded]), _flat([ids for _, ids in encoded])
    owner_a = np.repeat(np.arange(len(texts)), np.diff(a_bounds))
    owner_b = np.repeat(np.arange(len(texts)), np.diff(b_bounds))
    a_ends = np.cumsum(np.fromiter((len(token) for token in encoders.a_bytes), np.int64)[a])
    b_ends = np.cumsum(np.fromiter((len(token) for token in encoders.b_bytes), np.int64)[b])
    last_a, last_b = last_tokens(a_ends, b_ends)
    groups = np.bincount(owner_b[last_b == np.arange(len(b))], minlength=len(texts))
    written = _group_texts(a, b, last_a, last_b, owner_a, owner_b, len(texts))
    if digest:
        written = pa.array([
            hashlib.sha256(text.as_buffer()).hexdigest() if text.as_buffer().size else "" for text in written])
    # An A token is linked if it ends where the last token of its group does.
    linked = np.flatnonzero(a_ends == b_ends[last_a]) if len(a) else np.zeros(0, np.int64)
    pairs = a[linked] * encoders.size_b + b[last_a[linked]]
    whole = owner_a[linked] * (encoders.size_a * encoders.size_b) + pairs
    distinct, times = np.unique(whole, return_counts=True)
    owner, pairs = np.divmod(distinct, encoders.size_a * encoders.size_b)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    links = np.bincount(owner_a[linked], minlength=len(texts))
    return [
        *(pa.array(n.astype(np.int32)) for n in (np.diff(a_bounds), np.diff(b_bounds), groups, links)), written,
        _list_array(pairs // encoders.size_b, bounds), _list_array(pairs % encoders.size_b, bounds),
        _list_array(times, bounds)]


_PIECE_BYTES = 1 << 18


def aligned(docs: DataFrame, vocabularies: Vocabularies, key: str = "doc_id", text: str = "text",
            digest: bool = False) -> DataFrame:
    """Token counts, groups and linked pairs of every whole text.

    One row per row of ``docs``: id, slot (told anew at every evaluation),
    n_a, n_b, n_groups, n_links, groups (or the SHA-256 of it), and the linked
    pairs of ids, each once: lists a and b, and how many links hold the pair
    (times).  Null and empty texts, and texts whose bytes a side does not
    keep, have no tokens; their groups are the empty text.  Rows without a key
    and repeated rows are rows like any other; extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(vocabularies)
        for piece in pieces(batches, "text", _PIECE_BYTES):
            columns = align_texts(piece.column("text").to_pylist(), encoders, digest)
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), piece.column("slot"), *columns],
                ["id", "slot", "n_a", "n_b", "n_groups", "n_links", "groups", "a", "b", "times"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.monotonically_increasing_id().alias("slot"),
                       F.col(text).alias("text"))
    return rows.mapInArrow(run, _ALIGNED)


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, n, best): links of each pair of ids, and whether no other pair with the same b has more."""
    each = links.select(F.inline(F.arrays_zip("a", "b", "times")))
    counts = each.groupBy("a", "b").agg(F.sum("times").alias("n"))
    return settled(counts, "pairs")


def _with_best(counts: DataFrame) -> DataFrame:
    # The ids of one vocabulary, so never more rows than it has entries.
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _head(counts: DataFrame, most: int) -> tuple[int, bool]:
    """The least count, a power of two, that at most ``most`` pairs reach, and whether any pair is below."""
    sizes = counts.groupBy(F.length(F.bin("n")).alias("digits")).agg(F.count("*").alias("pairs")).collect()
    held, least = 0, None
    for row in sorted(sizes, key=lambda row: -row.digits):
        held += row.pairs
        if held > most:
            break
        least = row.digits
    if least is None:
        return 1 << 62, bool(sizes)
    return 1 << (least - 1), held > most


def _score(head: pa.Table, size_b: int):
    """Sum the counts of the pairs in ``head``, and keep the links of all others."""
    keys = head.column("a").to_numpy().astype(np.int64) * size_b + head.column("b").to_numpy()
    order = np.argsort(keys)
    keys, counts, best = keys[order], head.column("n").to_numpy()[order], head.column("best").to_numpy()[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(name) for name in ("a", "b", "times")]
            a, b, times = (part.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for part in lists)
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False))])
            pair = a * size_b + b
            at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            known = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            total = np.zeros(len(pair), np.int64)
            first = np.zeros(len(pair), np.int64)
            total[known] = counts[at[known]] * times[known]
            first[known] = best[at[known]] * times[known]
            sums = [np.concatenate([[0], np.cumsum(part)]) for part in (total, first)]
            rest = np.flatnonzero(~known)
            rest_bounds = np.searchsorted(rest, bounds)
            others = [_list_array(part[rest], rest_bounds) for part in (a, b, times)]
            kept = [batch.column(name) for name in ("id", "slot", "n_a", "n_b", "n_groups", "n_links", "groups")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(np.diff(sums[1][bounds])), pa.array(np.diff(sums[0][bounds])), *others],
                ["id", "slot", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum", "a", "b", "times"])

    return run


_SCORED = _ALIGNED.replace("groups string, ", "groups string, n_best long, count_sum long, ")


def alignment(docs: DataFrame, vocabularies: Vocabularies | None = None, key: str = "doc_id", text: str = "text",
              digest: bool = True, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """As ``aligned``, with n_best and count_sum of each document's links.

    ``count_sum`` adds up, over a document's links, how many links of all
    documents hold the same pair of ids; ``n_best`` are the links whose pair no
    other pair with the same B id exceeds.  Both are 0 without links, so also
    in an empty table's absence of rows.
    """
    vocabularies = vocabularies or Vocabularies.load()
    links = settled(aligned(docs, vocabularies, key, text, digest), "links")
    counts = settled(_with_best(pair_counts(links)), "best-pairs")
    least, more = _head(counts, head_pairs)
    head = counts.filter(F.col("n") >= least).toArrow()
    size_b = Encoders(vocabularies).size_b
    scored = links.mapInArrow(_score(head, size_b), _SCORED)
    columns = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    if not more:
        return scored.select(*columns)
    each = scored.select("slot", F.inline(F.arrays_zip("a", "b", "times")))
    rest = each.join(counts.filter(F.col("n") < least), ["a", "b"]).groupBy("slot").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    told = scored.join(rest, "slot", "left")
    return told.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn(
        "count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).select(*columns)
