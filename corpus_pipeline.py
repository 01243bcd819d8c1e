"""The training-data pipeline: five stages from documents to shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared checkpoint folder and reads it again as
the next stage's ``docs``. All stages but the last return the columns of
``documents``; the last adds the shard and the slot in it.

Nulls, empty and very long texts, ties, repeated rows, empty tables and extra
columns are handled as the operators' modules define it: a text without words
is rejected by the first stage, rows that the mix takes several times are
repeated, and further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abode.llm import mixing, order_minhash, rendezvous, set_join, weak_labels
from abode.llm.common import Scratch, read_table

N_SHARDS = 24


def _apart(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``docs`` with its further columns under names of their own, and the columns that name them back."""
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.withColumnsRenamed(own), [F.col(own.get(c, c)).alias(c) for c in docs.columns]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the weak-label classifier rejects."""
    model = weak_labels.fit(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    rows, names = _apart(docs)
    return weak_labels.classify(rows, model).filter("kept").select(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    return order_minhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    rows, names = _apart(docs)
    found = set_join.contaminated_spans(rows, read_table(spark, sf_dir, "benchmark"))
    return found.filter("n_hit = 0").select(*names)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard by id and slot within the shard."""
    rows, names = _apart(docs.drop("shard", "slot"))
    rows = rendezvous.assign_shards(rows, "doc_id", [1.0] * N_SHARDS).withColumn("text_hash", F.xxhash64("text"))
    return rendezvous.with_slots(rows, ["doc_id", "text_hash"]).select(*names, "shard", "slot")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("sharding", sharding),
]

#: The trained classifier cannot be expressed in SQL; tests/llm checks each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
