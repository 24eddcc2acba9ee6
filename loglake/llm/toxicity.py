"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic
text.  Every window of a text is compressed with the ordinary dictionary alone
and with the toxic one before it; the bytes saved tell how much of the window
is toxic phrasing.  A logistic curve, fitted on a part of the sample kept from
the dictionaries, turns the largest savings of a text into a score.

Most of a toxic document is ordinary text, on which dictionaries of whole
documents are hardly different.  The toxic dictionary therefore is trained on
what ordinary documents do not explain: the stretches of toxic ones made of
strings of ``_GRAM`` bytes that occur in toxic documents significantly more
often.  Nothing here knows of words or languages; a stem with many endings is
as good as a word.  A string counts once for all places with the same
surroundings, so that copies of one document labelled toxic count once.
"""

from __future__ import annotations

import json
import math
import struct
from base64 import b64decode, b64encode
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import among_lowest, cut, fold
from .texts import mixed

#: Labelled rows of each label that are learned from, at most.
ROWS_PER_LABEL = 3000
#: A byte string marks a stretch as toxic if it has so many different surroundings in toxic documents, at least,
LEAST_PLACES = 4
#: is so many times (as a logarithm) more frequent there than in ordinary ones,
LEAST_LOG_ODDS = 2.0
#: and the likelihood ratio (twice its logarithm) of the two frequencies being different is this or more.
LEAST_RATIO = 20.0
WINDOW_WORDS = 10
THRESHOLD = 0.7

_ORDINARY_BYTES, _TOXIC_BYTES = 32768, 2048
#: Bytes of a string that is counted, and of its surroundings on either side.
_GRAM, _AROUND = 7, 8
_SHORTEST_MATCH = 6
_NOTICED = 3
_FEATURES = 5
_CALIBRATION_SHARE = 3
_AS_SPACE = bytes(32 if not (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) else c for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Lower case, without ASCII punctuation."""
    return text.lower().encode("utf-8", "replace").translate(_AS_SPACE).split() if text else []


def _windows(words: list[bytes]) -> list[bytes]:
    return [b" " + b" ".join(words[at:at + WINDOW_WORDS]) + b" " for at in range(0, len(words), WINDOW_WORDS)]


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    curve: tuple[float, ...]

    def compressors(self):
        """Toxic text lies before the ordinary text, whose distances stay the same."""
        return _compressor(self.ordinary), _compressor(self.toxic + self.ordinary)


def _compressor(content: bytes):
    import zstandard

    settings = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
        window_log=17, hash_log=15, chain_log=15, search_log=6, target_length=64,
        min_match=_SHORTEST_MATCH, strategy=zstandard.STRATEGY_LAZY2)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)


def features(words: list[bytes], ordinary, toxic) -> tuple[float, ...]:
    """The largest saving in three ranges, what the others save beyond noise, the number of windows (log)."""
    if not words:
        return (0.0,) * _FEATURES
    saved = sorted(
        (len(ordinary.compress(window)) - len(toxic.compress(window)) for window in _windows(words)), reverse=True)
    others = sum(value - _NOTICED for value in saved[1:] if value > _NOTICED)
    most = max(saved[0], 0)
    ranges = (min(most, 4), min(max(most - 4, 0), 2), max(most - 6, 0))
    return (*map(float, ranges), math.log1p(others), math.log1p(len(saved)))


def _curve(shown: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, ...]:
    """Weighted logistic regression by Newton steps with a little ridge."""
    x = np.hstack([shown, np.ones((len(shown), 1))])
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-2] * shown.shape[1] + [1e-4])
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weights * (chance - labels)) + ridge @ beta
        curvature = (x * (weights * chance * (1 - chance))[:, None]).T @ x + ridge
        step = np.linalg.solve(curvature, slope)
        beta -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, beta))


def _joined(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


def _strings(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all strings of ``_GRAM`` bytes, and of each one with its surroundings."""
    size = len(text) - _GRAM + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    padded = np.frombuffer(b" " * _AROUND + text + b" " * _AROUND, np.uint8).astype(np.uint64) + np.uint64(1)

    def rolled(start: int, width: int) -> np.ndarray:
        total = np.zeros(size, np.uint64)
        for at in range(start, start + width):
            total = total * np.uint64(0x9E3779B97F4A7C15) + padded[at:at + size]
        return mixed(total)

    inside = rolled(_AROUND, _GRAM)
    around = rolled(0, _AROUND) + np.uint64(3) * rolled(_AROUND + _GRAM, _AROUND)
    return inside, mixed(inside + np.uint64(5) * around)


def _places(texts: list[bytes], among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(strings, how often each counts, strings in all); ``among`` has the only ones that are asked for, sorted.

    A string counts once for a text and once for the same surroundings.
    """
    held, total = [], 0
    for number, text in enumerate(texts):
        inside, placed = _strings(text)
        total += len(inside)
        if among is not None and len(inside):
            at = np.minimum(np.searchsorted(among, inside), len(among) - 1)
            kept = among[at] == inside
            inside, placed = inside[kept], placed[kept]
        # Once for a text.
        inside, first = np.unique(inside, return_index=True)
        held.append((inside, placed[first]))
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    inside, placed = (np.concatenate(part) for part in zip(*held))
    _, first = np.unique(placed, return_index=True)
    return *np.unique(inside[first], return_counts=True), total


def _log_ratio(count, total, other_count, other_total) -> np.ndarray:
    """Twice the logarithm of the likelihood ratio of two frequencies against a common one."""
    def fit(k, n, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log1p(-p)

    common = (count + other_count) / (total + other_total)
    return 2 * (fit(count, total, count / total) + fit(other_count, other_total, other_count / other_total)
                - fit(count, total, common) - fit(other_count, other_total, common))


def toxic_passages(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The stretches of toxic texts that ordinary ones do not explain; equal texts count once."""
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    strings, counts, total = _places(toxic)
    often = counts >= LEAST_PLACES
    strings, counts = strings[often], counts[often]
    if not len(strings) or not ordinary:
        return []
    known, usual, other_total = _places(ordinary, strings)
    others = np.zeros(len(strings), np.int64)
    others[np.searchsorted(strings, known)] = usual
    odds = np.log((counts + 0.5) / total) - np.log((others + 0.5) / max(other_total, 1))
    marked = strings[(odds > LEAST_LOG_ODDS) & (
        _log_ratio(counts, total, others, max(other_total, 1)) > LEAST_RATIO)]
    if not len(marked):
        return []
    passages = []
    for text in toxic:
        inside, _ = _strings(text)
        at = np.minimum(np.searchsorted(marked, inside), len(marked) - 1)
        places = np.flatnonzero(marked[at] == inside)
        breaks = np.flatnonzero(np.diff(places) > _GRAM)
        for run in np.split(places, breaks + 1) if len(places) else ():
            passages.append(text[run[0]:run[-1] + _GRAM])
    return passages


#: The three distances that end the header of a trained dictionary.
_HEADER_END = struct.pack("<III", 1, 4, 8)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """The text a trained dictionary holds, or the samples themselves where they are too few to train on.

    Its entropy tables are left out, as lengths are to differ by matches alone.
    """
    import zstandard

    joined = [b"".join(samples[at:at + 8]) for at in range(0, len(samples), 8)]
    try:
        trained = zstandard.train_dictionary(size, joined, k=16, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]
    return trained[trained.index(_HEADER_END) + len(_HEADER_END):]


def _trainer(limit: int):
    """Fit on ``limit`` rows of each label of one task, whose rows are few by construction.

    Both labels weigh the same in the curve, so a score tells how much likelier
    a text's savings are among toxic documents, however rare these are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, times = [], []
        for batch in batches:
            times += batch.column("times").to_pylist()
            rows += zip(batch.column("fold").to_pylist(), batch.column("toxic").to_pylist(),
                        map(plain_words, batch.column("text").to_pylist()))
        rows = [rows[at] for at in cut([row[1] for row in rows], [row[0] for row in rows], times, limit)]
        aside = [row for row in rows if row[0] % _CALIBRATION_SHARE == 0]
        learned = [row for row in rows if row[0] % _CALIBRATION_SHARE]
        texts = [[_joined(words) for _, label, words in learned if label == kind and words] for kind in (0, 1)]
        passages = toxic_passages(texts[1], texts[0])
        usual = [window for _, label, words in learned if not label for window in _windows(words)]
        model = ToxicityModel(
            _dictionary(usual, _ORDINARY_BYTES) if usual else b"",
            _dictionary(passages, _TOXIC_BYTES) if passages else b"", ())
        if not model.ordinary or not model.toxic:
            return
        pair = model.compressors()
        labels = np.array([label for _, label, _ in aside], float)
        held = [int((labels == label).sum()) for label in (0, 1)]
        if not min(held):
            return
        weights = len(labels) / 2 / np.where(labels == 1, held[1], held[0])
        curve = _curve(np.array([features(words, *pair) for *_, words in aside]), labels, weights)
        told = {"ordinary": b64encode(model.ordinary).decode(), "toxic": b64encode(model.toxic).decode(), "curve": curve}
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(told)])], ["model"])

    return run


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic",
    rows_per_label: int = ROWS_PER_LABEL,
) -> ToxicityModel | None:
    """A model from the labelled rows, or None if they show no toxic phrasing.

    At most ``rows_per_label`` rows of either label are learned from, picked by
    a hash of key and text among all rows whose key has the label; so what is
    broadcast and what the one task reads are few by construction.  Labels
    other than 0 and 1 and rows without a key are ignored; a key labelled more
    than once is toxic if any label says so.
    """
    told = labels.select(F.col(key).alias("id"), F.col(toxic).cast("int").alias("toxic")).filter(
        F.col("id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter(
        F.col("id").isNotNull() & F.col("text").isNotNull()).withColumn("fold", fold("id", "text"))
    known = texts.groupBy("id", "fold").agg(F.count("*").alias("times")).join(told, "id")
    _, low = among_lowest(known, "toxic", rows_per_label)
    drawn = known.filter(low)
    sample = texts.join(F.broadcast(drawn), ["id", "fold"]).groupBy("id", "fold", "toxic", "times").agg(
        F.first("text").alias("text")).select("fold", "toxic", "times", "text")
    fitted = sample.repartition(1).mapInArrow(_trainer(rows_per_label), "model string").first()
    if fitted is None:
        return None
    found = json.loads(fitted.model)
    return ToxicityModel(b64decode(found["ordinary"]), b64decode(found["toxic"]), tuple(found["curve"]))


def toxicity(text: Column, model: ToxicityModel | None) -> Column:
    """A score of 0 to 1 per whole text; null and empty texts score as texts that show nothing.

    Without a model every score is 0.
    """

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pair = model.compressors() if model else None
        for texts in batches:
            if pair is None:
                yield pa.array([0.0] * len(texts), pa.float64())
                continue
            shown = np.array([features(plain_words(value), *pair) for value in texts.to_pylist()]).reshape(-1, _FEATURES)
            logits = np.clip(shown @ np.array(model.curve[:-1]) + model.curve[-1], -30, 30)
            yield pa.array(1 / (1 + np.exp(-logits)), pa.float64())

    return score(text)
