"""Token counts from an exact length histogram.

Whole texts are encoded with a public byte-pair vocabulary; documents are then
aggregated by encoded length.  Suffix sums over the distinct lengths answer,
for every context limit, how many documents are longer, how many tokens
survive truncation to it, and any quantile, without going back to the texts.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rank file of a tiktoken vocabulary, in a folder every executor has.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that this vocabulary's merges were made for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(vocabulary: str = VOCABULARY):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(
        os.path.basename(vocabulary), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Runs of white space from this length on are encoded apart from the pattern, whose look-ahead takes a step back for
#: every character of a run.
_LONG_RUN = 4096
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LONG_WHITE = re.compile(f"[{_WHITE}]{{{_LONG_RUN},}}")


def encode_text(encoding, text: str) -> list[int]:
    """Ids of a whole text, however long its runs of white space.

    The pattern takes all of a run but its last character as one piece, and the
    last one goes with what follows; at the end of the text the run is whole.
    """
    ids: list[int] = []
    start = 0
    for run in _LONG_WHITE.finditer(text) if len(text) >= _LONG_RUN else ():
        stop = run.end() if run.end() == len(text) else run.end() - 1
        ids += encoding.encode_ordinary(text[start:run.start()])
        ids += encoding._encode_single_piece(text[run.start():stop])
        start = stop
    return ids + encoding.encode_ordinary(text[start:] if start else text)


def token_count(text, vocabulary: str = VOCABULARY):
    """Tokens of each whole text; null and empty ones have none.  Special tokens' strings are ordinary text."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = encoder(vocabulary)
        for texts in batches:
            yield pa.array([len(encode_text(encoding, text)) if text else 0 for text in texts.to_pylist()], pa.int64())

    return count(text)


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(length, n_docs), one row per distinct length; null and empty texts have length 0."""
    lengths = docs.select(token_count(F.col(text), vocabulary).alias("length"))
    return lengths.groupBy("length").agg(F.count("*").alias("n_docs"))


def context_table(histogram: DataFrame) -> DataFrame:
    """For each length L of the histogram, taken as a context limit:

    n_docs and n_tokens of documents of length L, docs_longer than L,
    tokens_within (of documents no longer than L), tokens_truncated (of all
    documents, each cut at L), and share_within, the share of documents no
    longer than L.  Between two lengths, tokens_truncated at a limit is the row
    below plus docs_longer for every further token.

    The windows run over distinct lengths, of which there are at most as many
    as the longest document has tokens.
    """
    below = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    tokens = F.col("length") * F.col("n_docs")
    longer = F.coalesce(F.sum("n_docs").over(above), F.lit(0))
    within = F.sum(tokens).over(below)
    docs_within = F.sum("n_docs").over(below)
    return histogram.select(
        "length", "n_docs", tokens.alias("n_tokens"),
        longer.alias("docs_longer"), within.alias("tokens_within"),
        (within + longer * F.col("length")).alias("tokens_truncated"),
        (docs_within / (docs_within + longer)).alias("share_within"),
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context, tokens_truncated, docs_longer) for each of the limits; also of an empty table."""
    asked = histogram.sparkSession.createDataFrame([(limit,) for limit in sorted(set(limits))], "context long")
    each = F.explode(F.array(*map(F.lit, limits)).cast("array<long>")).alias("context")
    told = histogram.select("length", "n_docs", each).groupBy("context").agg(
        F.sum(F.least("length", "context") * F.col("n_docs")).alias("tokens_truncated"),
        F.sum(F.when(F.col("length") > F.col("context"), F.col("n_docs")).otherwise(0)).alias("docs_longer"))
    return asked.join(told, "context", "left").na.fill(0)


def quantile(table: DataFrame, share: float) -> int | None:
    """The smallest length that at least ``share`` of all documents do not exceed."""
    return table.filter(F.col("share_within") >= share).agg(F.min("length")).first()[0]
