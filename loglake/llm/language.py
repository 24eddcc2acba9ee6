"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of character n-grams, hashed into a fixed number
of columns.  Document frequencies cover every learnable document.  The weights
are trained by follow-the-regularised-leader with elastic-net penalties, one
task over a bounded sample of labelled rows, and a temperature, fitted on a
part of that sample kept from training, calibrates the probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches
from .sampling import among_lowest, cut, fold
from .texts import give_back, mixed, pieces, slices

COLUMNS = 1 << 13
ORDERS = (1, 2, 3)
#: At most this many labelled rows of each language are learned from.
ROWS_PER_LANGUAGE = 1000
UNDETERMINED = "und"

#: A piece has 64 rows of counts at most, 4 MB in all.
_PIECE_CHARS = 1 << 17
_PIECE_ROWS = 64
_EPOCHS = 3
_BATCH = 16
_ALPHA, _BETA, _L1, _L2 = 0.5, 1.0, 2e-4, 1e-4
_CALIBRATION_SHARE = 5


def gram_counts(texts: list[str | None], columns: int = COLUMNS) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, counts) of some texts at a time, counts having a row per text.

    Texts are lower-cased, runs of other characters than letters are one
    space, and whole texts count; a very long one is read in parts.
    """
    at = 0
    while at < len(texts):
        held, size = [], 0
        for text in texts[at:at + _PIECE_ROWS]:
            # Every text ends in a border of its own, whatever follows it here.
            text = text.lower() + "\n" if text else ""
            if held and size + len(text) > _PIECE_CHARS:
                break
            held.append(text)
            size += len(text)
        yield at, _count(held, columns)
        at += len(held)


def _count(texts: list[str], columns: int) -> np.ndarray:
    counts = np.zeros(len(texts) * columns, np.int64)
    if len(texts) > 1:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        _add_counts(counts, "".join(texts), np.repeat(np.arange(len(texts)), sizes), columns)
    else:
        for low in range(0, len(texts[0]), _PIECE_CHARS):
            part = texts[0][low:low + _PIECE_CHARS + max(ORDERS) - 1]
            _add_counts(counts, part, np.zeros(len(part), np.int64), columns, _PIECE_CHARS)
    return counts.reshape(len(texts), columns)


def _add_counts(counts: np.ndarray, text: str, owner: np.ndarray, columns: int, stop: int | None = None) -> None:
    """Count the n-grams that start before ``stop`` and lie inside one text."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    letter = ((codes >= 97) & (codes <= 122)) | (codes >= 170)
    stays = letter.copy()
    # The first of a run of other characters stands for the run.
    stays[1:] |= letter[:-1]
    place = np.flatnonzero(stays)
    symbols = np.where(letter[place], codes[place], np.uint32(32)).astype(np.uint64)
    owner = owner[place]
    run = np.zeros(len(symbols), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        run = run[:len(symbols) - order + 1]
        if not len(run):
            return
        run = run * np.uint64(0x9E3779B97F4A7C15) + symbols[order - 1:]
        if order in ORDERS:
            own = owner[:len(run)] == owner[order - 1:]
            if stop is not None:
                own &= place[:len(run)] < stop
            column = (mixed(run + np.uint64(order)) >> np.uint64(32)) % np.uint64(columns)
            flat = owner[:len(run)] * columns + column.astype(np.int64)
            counts += np.bincount(flat[own], minlength=len(counts))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length: (1 + log count) * idf."""
    weights = np.zeros(counts.shape, np.float32)
    filled = counts > 0
    weights[filled] = 1 + np.log(counts[filled])
    weights *= idf.astype(np.float32)
    norm = np.sqrt((weights * weights).sum(axis=1, keepdims=True))
    return np.divide(weights, norm, out=weights, where=norm > 0)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        logits = (tf_idf(counts, self.idf) @ self.weights + self.bias) / self.temperature
        logits = np.exp(logits - logits.max(axis=1, keepdims=True))
        return logits / logits.sum(axis=1, keepdims=True)


def _partial_frequencies(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.RecordBatch]:
    """One row per column a task has seen, and its documents under -1."""
    seen, texts = np.zeros(columns, np.int64), 0
    for piece in pieces(batches, "text"):
        for _, counts in gram_counts(piece.column("text").to_pylist(), columns):
            seen += (counts > 0).sum(axis=0)
            texts += len(counts)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, -1)), pa.array(np.append(seen[at], texts))], ["gram", "n"])


def inverse_frequencies(docs: DataFrame, text: str, columns: int = COLUMNS) -> np.ndarray:
    """log(1 + documents / documents with the n-gram), over all rows; ``columns`` numbers."""
    bound_batches(docs.sparkSession)
    counted = docs.select(F.col(text).alias("text")).mapInArrow(
        lambda batches: _partial_frequencies(batches, columns), "gram long, n long"
    ).groupBy("gram").agg(F.sum("n").alias("n")).collect()
    found = {row.gram: row.n for row in counted}
    texts = found.pop(-1, 0)
    frequency = np.zeros(columns)
    frequency[list(found)] = list(found.values())
    return np.log1p((texts + 1) / (frequency + 1))


def _regularised_step(total, squares, weights, gradient) -> None:
    """One step of follow-the-regularised-leader with a rate per weight, in place."""
    added = squares + gradient * gradient
    total += gradient - (np.sqrt(added) - np.sqrt(squares)) / _ALPHA * weights
    squares[...] = added
    shrunk = np.sign(total) * _L1 - total
    rate = (_BETA + np.sqrt(squares)) / _ALPHA + _L2
    weights[...] = np.where(np.abs(total) <= _L1, 0.0, shrunk / rate)


def _dense(rows: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """Sparse rows as a matrix with a last column of ones."""
    matrix = np.zeros((len(rows), width + 1))
    matrix[:, -1] = 1
    for at, (columns, values) in enumerate(rows):
        matrix[at, columns] = values
    return matrix


def _fit(rows: list, labels: np.ndarray, classes: int, width: int) -> np.ndarray:
    weights, total, squares = (np.zeros((width + 1, classes)) for _ in range(3))
    order = np.random.default_rng(7)
    for _ in range(_EPOCHS):
        shuffled = order.permutation(len(labels))
        for low in range(0, len(labels), _BATCH):
            chosen = shuffled[low:low + _BATCH]
            x = _dense([rows[at] for at in chosen], width)
            logits = x @ weights
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            chance[np.arange(len(chosen)), labels[chosen]] -= 1
            _regularised_step(total, squares, weights, x.T @ chance)
    return weights


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    def loss(log_t: float) -> float:
        scaled = logits / math.exp(log_t)
        scaled = scaled - scaled.max(axis=1, keepdims=True)
        return float((np.log(np.exp(scaled).sum(axis=1)) - scaled[np.arange(len(labels)), labels]).mean())

    low, high, part = math.log(0.05), math.log(20), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        left, right = high - part * (high - low), low + part * (high - low)
        low, high = (low, right) if loss(left) < loss(right) else (left, high)
    return math.exp((low + high) / 2)


def _trainer(languages: tuple[str, ...], idf: np.ndarray, limit: int):
    """Train on all rows of one task; they are few by construction."""
    def learn(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        rows, labels, folds, times = [], [], [], []
        code = {language: at for at, language in enumerate(languages)}
        for batch in batches:
            for _, counts in gram_counts(batch.column("text").to_pylist(), len(idf)):
                for weights in tf_idf(counts, idf):
                    columns = np.flatnonzero(weights)
                    rows.append((columns.astype(np.int32), weights[columns]))
            labels += [code[value] for value in batch.column("lang").to_pylist()]
            folds += batch.column("fold").to_pylist()
            times += batch.column("times").to_pylist()
        if not rows:
            return None
        drawn = cut(labels, folds, times, limit)
        rows, labels, folds = ([held[at] for at in drawn] for held in (rows, labels, folds))
        order = np.lexsort((np.array(folds), np.array(labels)))
        aside = order[_CALIBRATION_SHARE - 1::_CALIBRATION_SHARE]
        learned, target = np.setdiff1d(order, aside), np.array(labels)
        weights = _fit([rows[at] for at in learned], target[learned], len(languages), len(idf))
        logits = [_dense([rows[at]], len(idf)) @ weights for at in aside]
        heat = _temperature(np.concatenate(logits), target[aside]) if logits else 1.0
        return np.append(weights, heat).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = learn(batches)
        give_back()
        if learned is not None:
            yield pa.RecordBatch.from_arrays([pa.array([learned], pa.binary())], ["model"])

    return run


def train(
    docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
    rows_per_language: int = ROWS_PER_LANGUAGE, columns: int = COLUMNS,
) -> LanguageModel | None:
    """A model from all rows with text and language; None if there are none.

    Frequencies come from all of them, weights from a sample that a hash of
    key and text picks, at most ``rows_per_language`` rows of each language.
    """
    bound_batches(docs.sparkSession)
    labelled = docs.select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), fold(key, text).alias("fold")
    ).filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    languages, drawn = among_lowest(labelled, "lang", rows_per_language)
    if not languages:
        return None
    languages = tuple(languages)
    idf = inverse_frequencies(labelled, "text", columns)
    sample = labelled.filter(drawn).groupBy("lang", "fold").agg(F.count("*").alias("times"), F.first("text").alias("text"))
    fitted = sample.repartition(1).mapInArrow(_trainer(languages, idf, rows_per_language), "model binary").first()
    numbers = np.frombuffer(fitted.model, np.float64) if fitted else np.zeros((columns + 1) * len(languages) + 1)
    table = numbers[:-1].reshape(columns + 1, len(languages))
    return LanguageModel(languages, idf, table[:-1].astype(np.float32), table[-1], float(numbers[-1]) or 1.0)


def predicted(text: Column, model: LanguageModel | None) -> Column:
    """struct(lang, score): the likeliest language and its calibrated probability.

    ``und`` with score 0 for null, empty and letterless texts, and for all
    texts if there is no model.
    """

    def told(values: list[str | None]) -> pa.Array:
        names, scores = [UNDETERMINED] * len(values), [0.0] * len(values)
        if model is not None:
            for start, counts in gram_counts(values, len(model.idf)):
                chances = model.probabilities(counts)
                for at, best in enumerate(chances.argmax(axis=1).tolist(), start):
                    if has_letter(values[at]):
                        names[at], scores[at] = model.languages[best], float(chances[at - start, best])
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    @F.arrow_udf("lang string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text")
            yield pa.concat_arrays([told([]), *(told(part.column("text").to_pylist()) for part in parts)])
        give_back()

    return predict(text)


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``row`` with lang_pred and score; extra columns cannot clash."""
    bound_batches(docs.sparkSession)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text).alias("text"))
    told = packed.withColumn("told", predicted(F.col("text"), model))
    return told.select("row", F.col("told.lang").alias("lang_pred"), F.col("told.score").alias("score"))


def reject_unknown(docs: DataFrame, text: str = "text", least: float = 0.5, **columns) -> DataFrame:
    """``docs`` without texts of no language: no letters, or no language as likely as ``least``.

    With nothing to learn from only texts without letters go.
    """
    model = train(docs, text, **columns)
    told = identify(docs, model, text)
    known = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)
    if model is None:
        known = F.coalesce(F.col(f"row.{text}").rlike(r"\p{L}"), F.lit(False))
    return told.filter(known).select("row.*")
