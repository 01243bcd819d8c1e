"""Registered queries of the training-data operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abode.llm import (
    covering, divergence, html_trees, iceberg, mixing, order_minhash, prefix_doubling, rendezvous, repair_codec,
    set_join, suffix_tree, turn_repair, weak_labels,
)
from abode.llm.common import Scratch, read_table

N_SHARDS = 24


def op1_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = divergence.divergence_rules(read_table(spark, sf_dir, "documents"))
    return found.withColumn("failed_rules", F.array_join("failed_rules", ","))


def op2_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the documents whose crc32 of the id mod 10 is not 0 (a null id counts as empty text)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10
    scratch = Scratch(spark, "suffix-tree")
    model, tables = suffix_tree.fit(docs.filter(fold != 0), scratch)
    out = suffix_tree.score(docs, model, tables, scratch)
    return out.withColumn("held_out", fold == 0).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_weak_label_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = weak_labels.fit(docs, read_table(spark, sf_dir, "labels"))
    return weak_labels.classify(docs, model).select(
        "doc_id", F.round("low_quality", 6).alias("low_quality"), F.round("toxicity", 6).alias("toxicity"), "kept")


def op4_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{Scratch(spark, 'token-files').base}/files"
    repair_codec.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), path)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return repair_codec.decoded_documents(repair_codec.read_segments(spark, path, id_type))


def op5_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``key``: the id and the number of shards decide."""
    docs = read_table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rendezvous.assign_shards(rows, "doc_id", [1.0] * N_SHARDS)
    rows = rendezvous.assign_shards(rows, "doc_id", [1.0] * (N_SHARDS + 1), "grown_shard")
    rows = Scratch(spark, "shards").write(rows, "rows")
    return rendezvous.with_slots(rows, ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return order_minhash.near_duplicate_classes(docs).select(
        "doc_id", "class_id", "class_docs", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("representative"))


def op7_efraimidis_spirakis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op8_html_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_trees.extract(pages, html_trees.fit(pages))
    text = F.array_join("blocks", "\n")
    return found.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


def op9_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = prefix_doubling.removed_spans(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["first"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        "kept_sha256")


def op10_prefix_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = set_join.contaminated_spans(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op11_iceberg_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iceberg.source_divergence(read_table(spark, sf_dir, "documents"))


def op12_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covering.near_duplicate_components(read_table(spark, sf_dir, "documents"))


def op13_turn_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repaired(turn_repair.damaged(read_table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_distribution_divergence, op2_suffix_tree_score, op3_weak_label_classifier, op4_repair_token_files,
        op5_rendezvous_shards, op6_order_minhash, op7_efraimidis_spirakis, op8_html_trees, op9_prefix_doubling,
        op10_prefix_set_join, op11_iceberg_divergence, op12_covering_simhash, op13_turn_alignment)
}
