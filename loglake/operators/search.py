"""Which files can hold a search term or an attribute.

For every file of records a set of bits is kept: one for each three letters in
a row of its messages, in lower case, and one for each attribute with its
value, each at a place told by a hash.  A file in which a bit is missing that
a filter needs has no match and is not read.  All other files are read and
every record in them is judged by the filter itself, so results never depend
on the bits.  Files without bits, terms without three letters in a row and
wildcards just narrow nothing down.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import search_pattern
from ..plans.specs import LogFilter

#: Bits per file: 2^20 for letters, 2^23 for attributes, in words of 64.
TEXT_WORDS, ATTRIBUTE_WORDS = 1 << 14, 1 << 17
_WORD_BITS = 64
#: A word that every file has.
_MARK = -1
#: Bits that one lookup asks for, at most; fewer only skip fewer files.
_ASKED = 64

BITS = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("word", T.IntegerType()),
    T.StructField("held", T.LongType()),
    T.StructField("log_date", T.DateType()),
])

Spot = tuple[int, int]


def _spot(hashed: Column, first: int, words: int) -> Column:
    word = (F.lit(first) + F.pmod(hashed, F.lit(words))).cast("int")
    return F.struct(
        word.alias("word"), F.pmod(F.shiftright(hashed, 32), F.lit(_WORD_BITS)).cast("int").alias("place"))


def _text_spots(text: Column) -> Column:
    """Spots of all three letters in a row; none for null.

    The letters are a lambda's argument, so a text is split once and not for
    each of its letters.
    """
    def of_letters(held: Column) -> Column:
        starts = F.when(F.size(held) >= 3, F.sequence(F.lit(0), F.size(held) - 3)).otherwise(
            F.array().cast("array<int>"))
        return F.array_distinct(F.transform(
            starts, lambda i: F.xxhash64(F.get(held, i), F.get(held, i + 1), F.get(held, i + 2))))

    letters = F.split(F.lower(F.coalesce(text, F.lit(""))), "")
    return F.transform(
        F.flatten(F.transform(F.array(letters), of_letters)), lambda hashed: _spot(hashed, 0, TEXT_WORDS))


def _attribute_spot(key: Column, value: Column) -> Column:
    return _spot(F.xxhash64(key, value), TEXT_WORDS, ATTRIBUTE_WORDS)


def file_bits(records: DataFrame) -> DataFrame:
    """(file, word, held, log_date) of the files behind stored ``records``.

    One pass over messages and attributes.  Words are longs, so each task joins
    its bits in a hash table, whose size the words of a file bound, however
    many records it has; bitmaps in binary would be sorted record by record.
    """
    held = records.select(F.col("_metadata.file_path").alias("file"), "log_date", "message", "attributes")
    entries = F.coalesce(F.map_entries("attributes"), F.array().cast("array<struct<key:string,value:string>>"))
    mark = F.array(F.struct(F.lit(_MARK).alias("word"), F.lit(0).alias("place")))
    spots = F.concat(
        mark, _text_spots(F.col("message")), F.transform(entries, lambda e: _attribute_spot(e["key"], e["value"])))
    each = held.select("file", "log_date", F.inline(spots))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place"))
    return each.groupBy("file", "word", "log_date").agg(F.bit_or(bit).alias("held")).select(*BITS.fieldNames())


def literal_parts(pattern: str) -> list[str]:
    """The stretches of a LIKE pattern between wildcards, without escapes."""
    parts = [""]
    for escaped, char in re.findall(r"\\(.)|(.)", pattern, flags=re.S):
        if char in ("%", "_") and not escaped:
            parts.append("")
        else:
            parts[-1] += escaped or char
    return [part for part in parts if part]


def needed_spots(spark: SparkSession, query: LogFilter) -> list[Spot]:
    """The bits that a file with a match must have."""
    parts = literal_parts(search_pattern(query.q, query.search_mode)) if query.q is not None else []
    if not parts and not query.attributes:
        return []
    spots = [_text_spots(F.lit(part)) for part in parts]
    spots += [F.array(_attribute_spot(F.lit(key), F.lit(value))) for key, value in query.attributes]
    asked = spark.sql("SELECT 1 AS one").select(F.concat(*spots)).first()[0]
    return sorted({tuple(spot) for spot in asked})[:_ASKED]


def files_without(bits: DataFrame, spots: Sequence[Spot]) -> list[str]:
    """The files in which one of the bits is missing: names only, at most as many as a scan lists anyway."""
    words = sorted({word for word, _ in spots})
    found = [F.max(F.when(F.col("word") == word, F.getbit("held", F.lit(place)) == 1)) for word, place in spots]
    every = F.lit(True)
    for bit in found:
        every &= F.coalesce(bit, F.lit(False))
    asked = bits.filter(F.col("word").isin(_MARK, *words)).groupBy("file").agg(every.alias("possible"))
    return [row["file"] for row in asked.filter(~F.col("possible")).select("file").collect()]
