import random

import numpy as np
import zstandard
from pyspark.sql import functions as F

from loglake.llm import toxicity

SYLLABLES = ("ka ro ti mu se la no vi", "sch ung ein ber üß kon der", "ción las que ñar os tra")


def word(rng, parts, least=1):
    return "".join(rng.choice(parts) for _ in range(rng.randint(least, 4)))


def corpus(rng, count, stems, offset=0):
    """(doc_id, text, toxic) in three made-up languages; a tenth is toxic and holds a few words of its own stems."""
    rows = []
    for n in range(offset, offset + count):
        kind = n % 3
        parts = SYLLABLES[kind].split()
        words = [word(rng, parts) for _ in range(rng.randint(30, 120))]
        toxic = int(rng.random() < 0.25)
        for _ in range(rng.randint(3, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(stems[kind]) + word(rng, parts))
        rows.append((n, " ".join(words), toxic))
    return rows


def stems_of(rng, each):
    letters = "bcdfghjklmnpqrstvwxyz"
    return [["".join(rng.choice(letters) for _ in range(7)) for _ in range(each)] for _ in SYLLABLES]


def test_a_hundred_rare_stems_in_three_languages(spark):
    rng = random.Random(5)
    stems = stems_of(rng, 34)
    rows = corpus(rng, 6000, stems)
    docs = spark.createDataFrame([(n, text) for n, text, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(n, toxic) for n, _, toxic in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    held = corpus(rng, 900, stems, 10_000)
    scored = spark.createDataFrame(held, "doc_id long, text string, toxic int").select(
        "toxic", toxicity.toxicity(F.col("text"), model).alias("score")).collect()
    caught = [row.score >= toxicity.THRESHOLD for row in scored if row.toxic]
    alarms = [row.score >= toxicity.THRESHOLD for row in scored if not row.toxic]
    assert np.mean(caught) >= 0.9 and np.mean(alarms) <= 0.05


def test_copies_of_one_toxic_text_are_no_phrasing():
    rng = random.Random(2)
    plain = [toxicity._joined(toxicity.plain_words(text)) for _, text, toxic in corpus(rng, 400, [["x"]] * 3) if not toxic]
    copied = "some perfectly ordinary announcement of the school council "
    copies = [toxicity._joined(toxicity.plain_words(copied + f"{n} end")) for n in range(100)]
    passages = toxicity.toxic_passages([*copies, *copies], plain)
    # Only what stands beside the part that differs has surroundings of its own.
    assert not any(b"ordinary" in passage or b"announcement" in passage for passage in passages)


def test_strings_count_once_for_a_text_and_for_their_surroundings():
    texts = [b" alpha vilestem beta ", b" gamma vilestem delta vilestem eps ", b" alpha vilestem beta  more "]
    strings, counts, total = toxicity._places(texts)
    size = toxicity._GRAM
    assert total == sum(len(text) - size + 1 for text in texts)
    found = dict(zip(strings.tolist(), counts.tolist()))
    key = toxicity._strings(b"vilestem"[:size])[0][0]
    # Three texts hold it, two of them between the same bytes.
    assert found[int(key)] == 2
    asked, some, _ = toxicity._places(texts, np.sort(np.array([key, 7], np.uint64)))
    assert asked.tolist() == [int(key)] and some.tolist() == [2]


def test_window_lengths_are_those_of_plain_compressors():
    rng = random.Random(8)
    ordinary = " ".join(word(rng, SYLLABLES[0].split()) for _ in range(400)).encode()
    model = toxicity.ToxicityModel(ordinary, b" vilestem badword ", ())
    settings = dict(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
        window_log=17, hash_log=15, chain_log=15, search_log=6, target_length=64, min_match=6,
        strategy=zstandard.STRATEGY_LAZY2)

    def size(window, held):
        content = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(
            dict_data=content, compression_params=zstandard.ZstdCompressionParameters(**settings)).compress(window))

    words = toxicity.plain_words(" ".join(
        "vilestem" if n % 13 == 5 else word(rng, SYLLABLES[0].split()) for n in range(95)))
    windows = [" ".join(w.decode() for w in words[at:at + 10]) for at in range(0, len(words), 10)]
    saved = sorted((size(f" {w} ".encode(), ordinary) - size(f" {w} ".encode(), b" vilestem badword " + ordinary)
                    for w in windows), reverse=True)
    shown = toxicity.features(words, *model.compressors())
    assert sum(shown[:3]) == saved[0] > 0 and round(np.expm1(shown[4])) == len(windows)
    assert round(np.expm1(shown[3])) == sum(v - 3 for v in saved[1:] if v > 3)


def test_very_long_and_empty_texts(spark):
    model = toxicity.ToxicityModel(b" some ordinary words ", b" vilestem ", (1.0, 1.0, 1.0, 1.0, 0.0, -3.0))
    rows = [("word " * 600_000,), ("x" * 2_000_000,), (" " * 2_000_000,), ("",), (None,)]
    scores = [row[0] for row in spark.createDataFrame(rows, "text string").select(
        toxicity.toxicity(F.col("text"), model)).collect()]
    assert all(0 <= score <= 1 for score in scores) and scores[2] == scores[3] == scores[4]
