"""The registered queries: one per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment,
    decontaminate,
    embeddings,
    language,
    lines,
    minhash,
    mixing,
    negatives,
    shards,
    sql,
    substrings,
    tokens,
    toxicity,
    warc,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_sorted_projections(spark: SparkSession, folder: str) -> DataFrame:
    linked = embeddings.near_duplicate_vectors(_table(spark, folder, "embeddings"))
    return linked.select(
        F.col("id").alias("vec_id"), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.dedup_lines(_table(spark, folder, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", digest)


def op3_token_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.context_table(tokens.length_histogram(_table(spark, folder, "documents")))


def op4_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    facts = documents.select(
        "doc_id", shards.curve_of_documents(documents).alias("at"), shards.text_size(F.col("text")).alias("size"),
        F.crc32("text").alias("text_crc32"))
    placed = shards.assign_shards(facts, 24, F.col("at"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit(shards.LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve")


def op5_qgram_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def _remainder(divisor: int):
    """crc32 of the document id's text, by which rows are held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(divisor))


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    model = language.train(documents.filter(_remainder(5) != 0))
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out")
    told = language.identify(documents.select("doc_id", "text"), model)
    return told.select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score").select(
        "doc_id", held_out, "lang_pred", "score")


def op7_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    mixed = mixing.mix(documents, weight=mixing.length_preference(mixing.word_count(F.col("text"))))
    return mixed.select(
        "row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_super_kmer_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.remove_repeats(_table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_probminhash(spark: SparkSession, folder: str) -> DataFrame:
    classes = minhash.near_duplicate_classes(_table(spark, folder, "documents"))
    return classes.select(F.col("id").alias("doc_id"), "class_id", "kept")


def op10_compression_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    learned = _table(spark, folder, "labels").filter(_remainder(3) != 1)
    model = toxicity.train(documents, learned)
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out")
    scored = documents.select("doc_id", held_out, toxicity.toxicity(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op11_pointer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    told = alignment.alignment(_table(spark, folder, "documents"))
    return told.select(
        F.col("id").alias("doc_id"), *(F.col(name).cast("long").alias(name) for name in (
            "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), F.col("groups").alias("groups_sha256"))


def op12_dictionary_warc(spark: SparkSession, folder: str) -> DataFrame:
    _, archives = warc.write_archives(_table(spark, folder, "pages"))
    return warc.read_archives(spark, archives, payloads=False).select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


def op13_tree_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def queries() -> dict:
    return {
        "op1_sorted_projections": op1_sorted_projections,
        "op2_line_dedup": op2_line_dedup,
        "op3_token_histogram": op3_token_histogram,
        "op4_hilbert_shards": op4_hilbert_shards,
        "op5_qgram_decontamination": op5_qgram_decontamination,
        "op6_language_id": op6_language_id,
        "op7_pareto_mix": op7_pareto_mix,
        "op8_super_kmer_dedup": op8_super_kmer_dedup,
        "op9_probminhash": op9_probminhash,
        "op10_compression_toxicity": op10_compression_toxicity,
        "op11_pointer_alignment": op11_pointer_alignment,
        "op12_dictionary_warc": op12_dictionary_warc,
        "op13_tree_negatives": op13_tree_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": sql.LINE_DEDUP,
        "op4_hilbert_shards": sql.HILBERT_SHARDS,
        "op7_pareto_mix": sql.PARETO_MIX,
        "op8_super_kmer_dedup": sql.SUBSTRING_DEDUP,
        "op12_dictionary_warc": sql.ARCHIVED_PAGES,
        "op13_tree_negatives": sql.HARD_NEGATIVES,
    }
