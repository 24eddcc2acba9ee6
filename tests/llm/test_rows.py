"""Columns of maps, and many texts under one key."""

from pyspark.sql import functions as F

from loglake.llm import minhash, shards, substrings


def test_columns_of_maps(spark):
    docs = spark.range(60).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("some words of document "), F.col("id") % 30).alias("text"),
        F.lit("en").alias("lang"), F.lit("s").alias("source"),
        F.create_map(F.lit("k"), F.array(F.struct(F.create_map(F.lit(1), F.col("id"))))).alias("extra"))
    placed = shards.assign_shards(docs, 4)
    assert placed.groupBy("shard").count().filter("count <> 15").count() == 0 and placed.count() == 60
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 30


def test_thousands_of_texts_under_one_key(spark):
    shared = " ".join(f"shared{n}" for n in range(20))
    rows = [(key, f"{shared} own{key}x{n} " + " ".join(f"w{key}x{n}x{m}" for m in range(15)))
            for key in (1, 2) for n in range(1200)]
    kept = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 2400
    # The passage stays in every text of the smaller key and goes from every one of the larger.
    assert {(row.doc_id, row.n_removed) for row in kept} == {(1, 0), (2, 20)}
    assert all(("shared0" in row.text) == (row.doc_id == 1) for row in kept)
