"""The pipeline's stages on odd and given tables, each against a plain version on its own input."""
import sys
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from abode.llm import mixing, weak_labels
from abode.llm.common import Scratch, read_table
from tests.llm import brute, cases

STAGES = dict(corpus_pipeline.STAGES)


def test_order_and_columns(spark):
    assert list(STAGES) == ["quality_classifier", "near_duplicates", "decontamination", "source_mix", "sharding"]
    path = cases.folder(spark, cases.odd_documents(spark))
    docs = read_table(spark, path, "documents")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        assert out.columns == (names if k < 4 else [c for c in names if c not in ("shard", "slot")] + ["shard", "slot"]), name
        docs = Scratch(spark, "test").write(out, name)
    assert docs.count() > 0


def test_clashing_columns_keep_their_values(spark):
    """Input columns named like the operators' outputs pass through all stages unchanged."""
    docs = read_table(spark, cases.SF, "documents")
    for c in ("kept", "spans", "items", "n_words", "n_hit", "low_quality", "toxicity", "_copies", "_row_key", "copies", "own_0", "key"):
        docs = docs.withColumn(c, F.concat(F.lit(c + ":"), F.col("doc_id").cast("string")))
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark, "test").write(stage(spark, docs, cases.SF), name)
        rows = docs.collect()
        assert rows and all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in names[5:]), name


def test_mix_takes_repeated_rows_as_planned(spark):
    """One text with one id in two sources, and equal rows at the budget's border."""
    body = [(k, f"text number {k} " + "w " * (k % 7), f"s{k % 3}", k) for k in range(40)]
    body += [(1, "text of both sources", "s0", 100), (1, "text of both sources", "s1", 101)]
    body += [(5, "equal rows " * 6, f"s{k % 2}", 200 + k) for k in range(90)]
    docs = spark.createDataFrame(body, "doc_id long, text string, source string, n int").repartition(4)
    plan = Counter()
    for r in mixing.mix(docs).collect():
        plan[r["doc_id"], r["row_key"], r["source"]] += r["copies"]
    taken = mixing.mixed_documents(docs)
    got = Counter((r["doc_id"], r["k"], r["source"]) for r in taken.withColumn("k", F.xxhash64("doc_id", "text")).collect())
    assert got == +plan and any(c % 45 for (i, _, s), c in plan.items() if i == 5)
    most = Counter(r["n"] for r in taken.collect())
    assert all(abs(most[a] - most[b]) <= 1 for a in range(200, 290, 2) for b in (200,))


def test_empty_documents(spark):
    path = cases.folder(spark, cases.empty_documents(spark))
    assert corpus_pipeline.run(spark, path).collect() == []


@pytest.fixture(scope="module")
def stages(spark):
    """(input, output) rows of each stage over the given documents."""
    docs = read_table(spark, cases.SF, "documents")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = Scratch(spark, "test").write(stage(spark, docs, cases.SF), name)
        out[name] = (docs.collect(), after.collect())
        docs = after
    return out


def test_classifier_stage(spark, stages):
    before, after = stages["quality_classifier"]
    docs = read_table(spark, cases.SF, "documents").select("doc_id", "text")
    model = weak_labels.fit(docs, read_table(spark, cases.SF, "labels"))
    kept = {r["doc_id"] for r in weak_labels.classify(docs, model).collect() if r["kept"]}
    assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in before if r["doc_id"] in kept)
    labels = {r["doc_id"]: r for r in read_table(spark, cases.SF, "labels").collect()}
    clean = [r["doc_id"] for r in before if r["doc_id"] in labels and labels[r["doc_id"]]["quality"] == 1
             and labels[r["doc_id"]]["toxic"] == 0]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)


def test_dedup_stage(stages):
    before, after = stages["near_duplicates"]
    docs = [(r["doc_id"], r["text"]) for r in before]
    classes = {c for c in brute.near_classes(docs)}
    assert Counter(r["doc_id"] for r in after) == Counter(classes)


def test_decontamination_stage(spark, stages):
    before, after = stages["decontamination"]
    items = [(r["item_id"], r["text"]) for r in read_table(spark, cases.SF, "benchmark").collect()]
    hits = brute.contamination([r["text"] for r in before], items)
    assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r, h in zip(before, hits) if not h[4])


def test_mix_stage(stages):
    before, after = stages["source_mix"]
    size = {r["doc_id"]: len(brute.WORD.findall(r["text"] or "")) for r in before}
    sizes, taken, most = defaultdict(int), Counter(), Counter()
    for r in before:
        sizes[r["source"]] += size[r["doc_id"]]
        most[r["source"]] = max(most[r["source"]], size[r["doc_id"]])
    for r in after:
        taken[r["source"]] += size[r["doc_id"]]
    want = brute.targets(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= most[s] for s in want)
    assert max(Counter(r["doc_id"] for r in after).values()) <= 3


def test_sharding_stage(stages):
    before, after = stages["sharding"]
    assert Counter(r["doc_id"] for r in before) == Counter(r["doc_id"] for r in after)
    slots, of = defaultdict(list), defaultdict(set)
    for r in after:
        slots[r["shard"]].append(r["slot"])
        of[r["doc_id"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of.values())


def test_entry_without_the_subpackage(monkeypatch):
    every = set(E.queries())
    assert {"pipeline"} | {n for n in every if n.startswith("op")} <= every and len([n for n in every if n.startswith("op")]) == 13
    monkeypatch.setitem(sys.modules, "abode.llm.queries", None)  # importing it raises ImportError
    assert not any(n.startswith("op") or n == "pipeline" for n in [*E.queries(), *E.oracle_sql()])
    assert len(E.queries()) == len(every) - 14
