import random

import corpus_pipeline
from loglake.llm import decontaminate

SYLLABLES = {"aa": "ka ro ti mu se".split(), "bb": "sch ung ein ber üß".split()}


def sentences(rng, lang, count):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(count))


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(5)
    item = sentences(rng, "aa", 30)
    rows = [(n, sentences(rng, ("aa", "bb")[n % 2], rng.randint(20, 60)), ("aa", "bb")[n % 2], f"s{n % 2}", 1) for n in range(60)]
    rows += [(100, rows[0][1], "aa", "s0", 1), (101, "... 12", "aa", "s0", 1), (102, None, None, None, None),
             (103, f"{rows[1][1]} {item}", "aa", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_dedup", "decontamination", "source_mix", "sharding"]
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in result}
    assert not kept & {100, 101, 102, 103} and kept <= set(range(60))
    words = {n: len(text.split()) for n, text, *_ in rows[:60]}
    assert abs(sum(words[r["doc_id"]] for r in result) - 1.5 * sum(words.values())) < 70
    assert sorted({r["shard"] for r in result}) == list(range(24))


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert decontaminate.normalised(None) == ""
