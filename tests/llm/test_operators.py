"""The training-data operators against brute force, on given and odd tables."""
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from abode.llm import (
    dom, html_trees, mixing, order_minhash, prefix_doubling, rendezvous, repair_codec, set_join, suffix_tree, weak_labels,
)
from abode.llm import queries as Q
from abode.llm.common import Scratch, read_table
from tests.llm import brute, cases

OPS = sorted(Q.QUERIES)


@pytest.fixture(scope="module")
def odd(spark):
    items = spark.createDataFrame([(1, " ".join(cases._words(200, 3)[20:40])), (2, "quick test"), (3, None), (None, "line line line"),
                                   (3, ""), (1, " ".join(cases._words(200, 3)[20:40]))], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 1), (16, 0, 1), (None, 0, 0), (99, None, None)],
                                   "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "v", "<p>a"), (4, "w", "no tags &amp; text"),
                                   (4, "w", "no tags &amp; text")], "page_id long, url string, html string")
    return cases.folder(spark, cases.odd_documents(spark), items, labels, pages)


@pytest.fixture(scope="module")
def odd_docs(spark):
    return [(r["doc_id"], r["text"]) for r in cases.odd_documents(spark).collect()]


@pytest.fixture(scope="module")
def given(spark):
    return [(r["doc_id"], r["text"]) for r in read_table(spark, cases.SF, "documents").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(spark, name):
    assert Q.QUERIES[name](spark, cases.folder(spark, cases.empty_documents(spark))).collect() == []


# op11 returns rows per group and item, op13 per conversation (none here): test_audits.py holds both against brute force
@pytest.mark.parametrize("name", [n for n in OPS if not n.startswith(("op11_", "op13_"))])
def test_one_row_per_row(spark, odd, odd_docs, name):
    n = 5 if name.startswith("op8") else len(odd_docs)
    assert Q.QUERIES[name](spark, odd).count() == n


def key(row):
    return tuple((x is None, str(x)) for x in row)


def check(found, wanted):
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, wanted), key=key)


@pytest.mark.parametrize("where", ["odd", "given"])
def test_op1_base(spark, odd, odd_docs, given, where):
    docs, path = (odd_docs, odd) if where == "odd" else (given, cases.SF)
    got = Q.op1_distribution_divergence(spark, path).collect()
    check([(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
           for r in got], [(i, *brute.base_signals(t)) for i, t in docs])
    assert not any(r["base_failed"] and r["kept"] for r in got)


def test_op1_verdicts_follow_labels(spark):
    path = "/root/testdata/sf0.01"
    rows = Q.op1_distribution_divergence(spark, path).join(read_table(spark, path, "labels"), "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.9 * len(bad)


@pytest.mark.parametrize("where", ["odd", "given"])
def test_op2_counts_and_base(spark, odd, odd_docs, given, where):
    docs, path = (odd_docs, odd) if where == "odd" else (given, cases.SF)
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"])
                  for r in Q.op2_suffix_tree_score(spark, path).collect()), key=key)
    want = sorted(((i, *x) for (i, _), x in zip(docs, brute.unigram(docs))), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def test_op2_rare_words_are_joined(spark, given):
    """The same base scores when hardly any word is in the broadcast table."""
    from abode.llm.common import Scratch
    docs = read_table(spark, cases.SF, "documents").select("doc_id", "text")
    scratch = Scratch(spark, "test")
    model, words = suffix_tree.fit(docs, scratch, suffix_tree.Settings(heavy_words=5))
    few = {r["doc_id"]: r for r in suffix_tree.score(docs, model, words, scratch).collect()}
    model, words = suffix_tree.fit(docs, Scratch(spark, "test"))
    for r in suffix_tree.score(docs, model, words, Scratch(spark, "test")).collect():
        assert few[r["doc_id"]]["n_known"] == r["n_known"] == r["n_tokens"]
        assert np.isclose(few[r["doc_id"]]["base_score"], r["base_score"], rtol=1e-9)


def test_op2_grams_and_states():
    texts = ["Ab ab", None, "a", "", "abc  abd\nab", "x\x00y"]
    data = suffix_tree.normalised(pa.array(texts))
    n = len(data) - 8
    norm = [b" ".join((t or "").lower().encode().split()) + b"\n" for t in texts]
    assert data[:n].tobytes() == b"\n" + b"".join(norm)
    want = []
    for t in norm:
        t = b"\n" + t.replace(b"\0", b"\1")
        want += [sum(c << (8 * (k + 1)) for k, c in enumerate(t[max(0, i - 3):i][::-1])) | t[i] for i in range(1, len(t))]
    assert suffix_tree.grams(data, n, 3).tolist() == want


def test_op2_tallies_are_merged_and_handed_on_in_parts():
    """Merging takes little beside the keys themselves, and no batch holds a whole tally."""
    rng = np.random.default_rng(4)
    parts = [np.unique(rng.integers(0, 1 << 40, 1_000_000).astype(np.uint64)) for _ in range(2)]
    parts[1][:1000] = parts[0][:1000]
    parts[1] = np.unique(parts[1])
    tally = suffix_tree.Tally()
    tally.parts = [(k, np.full(len(k), 3)) for k in parts]
    held = sum(k.nbytes + n.nbytes for k, n in tally.parts)
    tracemalloc.start()
    keys, counts = tally.take()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.6 * held
    want, times = np.unique(np.concatenate(parts), return_counts=True)
    assert (keys == want).all() and (counts == 3 * times).all() and tally.size == 0
    rows = list(suffix_tree._tally_rows(suffix_tree.GRAM, keys, counts))
    assert max(b.num_rows for b in rows) <= 1 << 16 and sum(b.num_rows for b in rows) == len(keys)
    assert [len(x) for x in suffix_tree.Tally().take()] == [0, 0]


def test_op2_tree_is_a_distribution_and_uses_longest_suffix(spark, given):
    from abode.llm.common import Scratch
    docs = read_table(spark, cases.SF, "documents").select("doc_id", "text")
    model, _ = suffix_tree.fit(docs, Scratch(spark, "test"))
    tree = model.tree
    unseen = 255 - (tree.child.shape[1] - 1)
    p = 10 ** tree.logp
    assert tree.states > 20
    # log10 probabilities are kept in single precision
    assert np.all(p.sum(1) <= 1 + 1e-5) and np.all(p[:, :-1].sum(1) + (unseen + 1) * p[:, -1] >= 1 - 1e-5)
    data = suffix_tree.normalised(pa.array([t for _, t in given[:20]]))
    n = len(data) - 8
    got = suffix_tree.symbol_scores(data, n, tree)
    for t in range(1, min(n, 4000)):
        state = 0
        for k in range(1, tree.depth + 1):
            if t - k < 0:
                break
            after = tree.child[state, tree.code[data[t - k]]]
            if after < 0:
                break
            state = after
        assert got[t - 1] == tree.logp[state, tree.code[data[t]]]


def plain_tree(texts, settings):
    """(states, probability of a symbol after a context) by dictionaries over all contexts."""
    norm = [b"\n" + b" ".join((t or "").encode().lower().split()) + b"\n" for t in texts]
    seen = {}
    for t in norm:
        for i in range(1, len(t)):
            for d in range(min(i, settings.depth) + 1):
                after = seen.setdefault(t[i - d:i], {})
                after[t[i]] = after.get(t[i], 0) + 1
    often = {c for c, after in seen.items() if not c or sum(after.values()) >= settings.least_count}
    states = {b""}
    for c in often - {b""}:
        n, up = sum(seen[c].values()), seen[c[1:]]
        gain = sum(k * np.log((k / n) / (up[x] / sum(up.values()))) for x, k in seen[c].items())
        # sums of equal shares may end a rounding above or below the bound 0
        if gain > 0.5 * (len(seen[c]) - 1) * np.log(n):
            states |= {c[i:] for i in range(len(c))}

    def p(c, x):
        below = p(c[1:], x) if c else 1 / 256
        return (seen.get(c, {}).get(x, 0) + settings.smoothing * below) / (sum(seen.get(c, {}).values()) + settings.smoothing)

    def log10(t):
        total = 0.0
        for i in range(1, len(t)):
            d = max(d for d in range(min(i, settings.depth) + 1) if t[i - d:i] in states)
            total += np.log10(p(t[i - d:i], t[i]))
        return total
    return states, [log10(t) for t in norm]


@pytest.mark.parametrize("top", [1, 40, 1 << 16])
def test_op2_equals_plain_tree_wherever_its_states_lie(spark, given, top):
    """States and scores against dictionaries, with all but a few states in the joined tables, and with none."""
    from abode.llm.common import Scratch
    texts = [t if t is None else t[:3000] for _, t in given[:40]] + [None, "", "q", "q", "aaaaaaaaaaaaaaaaaaaa"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string").repartition(3)
    settings = suffix_tree.Settings(depth=4, top_states=top, heavy_words=20)
    scratch = Scratch(spark, "test")
    model, tables = suffix_tree.fit(docs, scratch, settings)
    states, want = plain_tree([*texts, texts[0]], settings)
    deep = tables.states.count()
    assert abs(model.tree.states + deep - len(states)) <= 0.002 * len(states)  # rounding at the bound of the test
    assert (deep > 500) == (top < 100) and model.tree.states <= top + 1
    got = suffix_tree.score(docs, model, tables, scratch).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert np.isclose(r["score"], want[r["doc_id"]], rtol=2e-4), (r["doc_id"], r["score"], want[r["doc_id"]])


@pytest.fixture
def small_batches(spark):
    """Python tasks get 50 rows at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 50)
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("block", [100, 1 << 20])
def test_op2_a_gram_beyond_the_tree_is_a_row_per_block(spark, given, block, small_batches):
    """Many texts with the same grams make no row each; the scores are those of a tree held whole, whatever the blocks."""
    from abode.llm.common import Scratch
    texts = [t if t is None else t[:600] for _, t in given[:20]] + [None, ""]
    copies = [(i, t if t is None else f"{t} {i}") for i, t in enumerate(texts * 30)] + [(0, texts[0]), (0, texts[0])]
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(2)
    made = {}
    for top in (1, 1 << 16):
        scratch = Scratch(spark, "test")
        settings = suffix_tree.Settings(top_states=top, block=block)
        model, tables = suffix_tree.fit(docs, scratch, settings)
        scores = sorted((r["doc_id"], r["row_key"], r["score"]) for r in suffix_tree.score(docs, model, tables, scratch).collect())
        made[top] = scores, [r["gram"] for r in spark.read.parquet(f"{scratch.base}/scored").collect() if r["gram"] is not None]
    (some, grams), (whole, none) = made.values()
    assert [r[:2] for r in some] == [r[:2] for r in whole] and len(some) == len(copies) and not none
    assert np.allclose([r[2] for r in some], [r[2] for r in whole], rtol=1e-5)
    assert len(set(grams)) > 1000
    if block == 1 << 20:
        assert len(grams) <= 2 * len(set(grams))
    else:
        assert len(grams) > 2 * len(set(grams))


def test_op2_beats_unigrams_on_held_out(spark):
    rows = [r for r in Q.op2_suffix_tree_score(spark, "/root/testdata/sf0.1").collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_op3_against_labels(spark):
    path = "/root/testdata/sf0.1"
    docs = read_table(spark, path, "documents").select("doc_id", "text")
    labels = read_table(spark, path, "labels")
    train = labels.filter("doc_id % 2 = 0")
    model = weak_labels.fit(docs, train)
    rows = weak_labels.classify(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    clean = [r for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    low = [r for r in rows if r["quality"] == 0]
    toxic = [r for r in rows if r["toxic"] == 1]
    print("clean kept", np.mean([r["kept"] for r in clean]), "low rejected", np.mean([not r["kept"] for r in low]),
          "toxic rejected", np.mean([not r["kept"] for r in toxic]))
    assert np.mean([r["kept"] for r in clean]) > 0.98
    assert np.mean([not r["kept"] for r in low]) > 0.97
    assert np.mean([not r["kept"] for r in toxic]) > 0.85


def test_op3_em_recovers_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.3
    right = [0.95, 0.9, 0.8, 0.7]
    votes = np.stack([np.where(rng.random(len(truth)) < 0.2, 2, np.where(rng.random(len(truth)) < a, truth, ~truth)) for a in right], 1)
    patterns, count = np.unique(votes, axis=0, return_counts=True)
    start = np.tile(np.array([[0.6, 0.2, 0.2], [0.2, 0.6, 0.2]]), (4, 1, 1))
    post, rates, prior = weak_labels.estimate(patterns.astype(int), count.astype(float), start, np.zeros(4), np.zeros(4, bool))
    assert abs(prior - 0.3) < 0.03 and np.abs(rates - right).max() < 0.04
    assert weak_labels._unpacked(weak_labels._packed([patterns[:, k].astype(int) for k in range(4)]), 4).tolist() == patterns.tolist()


@pytest.mark.parametrize("where", ["odd", "given"])
def test_op4_round_trip(spark, odd, odd_docs, given, where):
    import public_tokenizers
    from tokenizers import Tokenizer
    docs, path = (odd_docs, odd) if where == "odd" else (given, cases.SF)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(Q.op4_repair_token_files(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in docs), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    want = []
    for i, t in docs:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    check([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got], want)


def test_op4_grammar():
    rng = np.random.default_rng(3)
    phrases = [rng.integers(0, 50_000, 6) for _ in range(40)]
    ids = np.concatenate([phrases[k] for k in rng.integers(0, 40, 3000)] + [np.full(101, 7), [0]]).astype(np.uint16)
    tokens = np.array([1, 5000, len(ids) - 5001 - 50, 50])
    settings = repair_codec.Settings(least_pairs=4)
    rules, codes, per_doc = repair_codec.compress(ids, tokens, settings)
    lengths = repair_codec.rule_lengths(rules)
    assert len(codes) < 0.4 * len(ids) and per_doc.sum() == len(codes)
    assert np.array_equal(repair_codec.expand(codes, rules, lengths), ids)
    segment = {"rules": rules.astype("<u2").tobytes(), "lengths": lengths.astype("<u4").tobytes(),
               "codes": codes.astype("<u2").tobytes(), "doc_codes": per_doc}
    stops = np.cumsum(tokens)
    for d, (a, z) in enumerate(zip(stops - tokens, stops)):
        for x, y in ((0, z - a), (0, 1), ((z - a) // 3, (z - a) // 3 + 9), (z - a - 1, z - a)):
            y = min(y, z - a)
            assert np.array_equal(repair_codec.decode_range(segment, d, x, y), ids[a + x:a + y])


def test_op5_law(spark, odd, odd_docs, given):
    for docs, path in ((odd_docs, odd), (given, cases.SF)):
        rows = Q.op5_rendezvous_shards(spark, path).collect()
        check([(r["doc_id"], r["size"], r["text_crc32"], r["law"]) for r in rows],
              [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "key") for i, t in docs])
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
            assert r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        of = defaultdict(set)
        for r in rows:
            of[r["doc_id"]].add(r["shard"])
        assert all(len(s) == 1 for s in of.values())


def test_op5_buckets_change_nothing(spark, monkeypatch):
    one = Q.op5_rendezvous_shards(spark, cases.SF).collect()
    monkeypatch.setattr(rendezvous, "BUCKET_ROWS", 7)
    check(Q.op5_rendezvous_shards(spark, cases.SF).collect(), one)


def test_op5_weights(spark):
    rows = rendezvous.assign_shards(spark.range(20_000), "id", [1, 0, 2, 1]).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] / 20_000 for r in rows}
    assert set(share) == {0, 2, 3} and abs(share[2] - 0.5) < 0.02 and abs(share[0] - 0.25) < 0.02


def test_op6_odd(spark, odd, odd_docs):
    got = Q.op6_order_minhash(spark, odd).collect()
    check([(r["doc_id"], r["class_id"]) for r in got], [(i, c) for (i, _), c in zip(odd_docs, brute.near_classes(odd_docs))])


def test_op6_recall(spark, given):
    want = dict(zip([i for i, _ in given], brute.near_classes(given)))
    got = {r["doc_id"]: r["class_id"] for r in Q.op6_order_minhash(spark, cases.SF).collect()}
    assert sum(got[i] == c for i, c in want.items()) >= 0.99 * len(want)
    assert len(set(want.values())) < len(want)


def test_op6_alignment():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = rng.integers(0, 12, rng.integers(1, 40)).astype(np.uint32)
        b = a.copy() if rng.random() < 0.7 else rng.integers(0, 12, rng.integers(1, 40)).astype(np.uint32)
        for _ in range(rng.integers(0, 6)):
            b = np.delete(b, rng.integers(0, len(b))) if rng.random() < 0.5 and len(b) > 1 else np.insert(b, rng.integers(0, len(b) + 1), rng.integers(0, 12))
        c = brute.lcs(a.tolist(), b.tolist())
        assert order_minhash.similar(a, b, 0.8) == (c / (len(a) + len(b) - c) >= 0.8)


def _template_family(size, planted):
    """Texts of one template at 0.75 to 0.79 to each other, so in the same large buckets, and ``planted`` pairs at 0.817."""
    rng = np.random.default_rng(11)
    places, rows = [], []

    def add(kept, old):
        while True:
            at = [*kept, *rng.choice([k for k in range(100) if k not in kept], 7 - len(kept), replace=False).tolist()]
            if all(len(set(at) & set(x)) <= 2 for x in places):
                break
        words = list(old)
        for k in at[len(kept):]:
            words[5 * k + 4] = f"own{len(rows)}x{k}"
        places.append(at)
        rows.append((len(rows), words))
    template = [f"t{k}" for k in range(500)]
    for _ in range(size - planted):
        add([], template)
    for j in range(planted):
        words = list(template)
        for k in places[j][:2]:
            words[5 * k + 4] = rows[j][1][5 * k + 4]
        add(places[j][:2], words)
    return [(i, " ".join(w)) for i, w in rows]


def test_op6_large_buckets_are_compared_whole(spark):
    docs = _template_family(300, 20)
    want = brute.near_classes(docs)
    assert len(docs) - len(set(want)) == 20
    got = order_minhash.near_duplicate_classes(spark.createDataFrame(docs, "doc_id long, text string"))
    check([(r["doc_id"], r["class_id"]) for r in got.collect()], list(zip([i for i, _ in docs], want)))


def test_op6_tokens_of_one_class_make_no_row(spark):
    """Prefix tokens stay where a node outside the main class and one of another class have them; no pair is lost."""
    rng = np.random.default_rng(8)
    own = rng.choice(1 << 30, (40, 20), replace=False).astype(np.uint32)
    common = (np.arange(80) + (1 << 31)).astype(np.uint32)
    seqs = [np.concatenate([common, own[i]]) for i in range(40)]
    seqs[21][80:92] = seqs[20][80:92]  # two classes, 92 of 100 in common
    seqs[1][80:92] = seqs[0][80:92]    # one class
    labels = [7] * 20 + list(range(100, 120))
    left = spark.createDataFrame([(i, labels[i], labels[i] != 7) for i in range(40)], "node long, label long, few boolean").repartition(3)
    table = spark.createDataFrame([(i, x.astype("<u4").tobytes()) for i, x in enumerate(seqs)], "node long, seq binary")
    scratch = Scratch(spark, "test")
    pairs = order_minhash.remaining_pairs(left, table, scratch, order_minhash.Settings()).collect()
    assert [(r["a"], r["b"]) for r in pairs] == [(20, 21)]
    prefixes = {r["node"]: r["firsts"] for r in spark.read.parquet(f"{scratch.base}/prefixes").collect()}
    classes = defaultdict(set)
    for i, tokens in prefixes.items():
        for t in tokens:
            classes[t].add(labels[i])
    counts = np.bincount(order_minhash._cell(np.concatenate([order_minhash.numbered(x) for x in seqs]), 1 << 18), minlength=1 << 18)
    assert (order_minhash._frequencies(table.repartition(3), order_minhash.Settings()) == counts).all()
    kept = {r["node"]: r["firsts"] for r in spark.read.parquet(f"{scratch.base}/meeting").collect()}
    met = {i: [t for t in prefixes[i] if len(classes[t]) > 1] for i in prefixes}
    assert kept == {i: tokens for i, tokens in met.items() if tokens}
    assert sum(map(len, kept.values())) < sum(map(len, prefixes.values())) / 5


def test_op6_pairs_are_made_at_few_shared_tokens(spark, monkeypatch):
    """Near copies of many classes share most of a prefix; a pair makes a row at its first shared tokens, and none is lost."""
    rng = np.random.default_rng(5)
    origin = rng.choice(1 << 30, 200, replace=False).astype(np.uint32)
    seqs = []
    for i in range(40):
        x = origin.copy()
        at = rng.choice(200, rng.integers(4, 24), replace=False)
        x[at] = rng.integers(1 << 30, 1 << 31, len(at))
        seqs.append(x)
    labels = [7] * 15 + list(range(100, 125))
    left = spark.createDataFrame([(i, labels[i], labels[i] != 7) for i in range(40)], "node long, label long, few boolean").repartition(3)
    table = spark.createDataFrame([(i, x.astype("<u4").tobytes()) for i, x in enumerate(seqs)], "node long, seq binary")
    made, met = [], order_minhash._met
    monkeypatch.setattr(order_minhash, "_met", lambda places, settings: made.append((places, met(places, settings))) or made[0][1])
    pairs = order_minhash.remaining_pairs(left, table, Scratch(spark, "test"), order_minhash.Settings()).collect()
    pairs = {(r["a"], r["b"]) for r in pairs}
    sets = [set(x.tolist()) for x in seqs]
    similar = {(i, j) for i in range(40) for j in range(i + 1, 40) if labels[i] != labels[j]
               and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(similar) > 150 and similar <= pairs
    places, rows = made[0]
    common = places.select("node", "label", "token").join(
        places.select(F.col("node").alias("other"), F.col("label").alias("other_label"), "token"), "token")
    common = common.filter("node < other and label <> other_label").count()  # rows of pairs that meet at every shared token
    assert rows.count() < 6 * len(pairs) and rows.count() < common / 3


def test_op6_prefix_and_bitmap_lose_no_pair():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(0, 60, rng.integers(1, 80)).astype(np.uint32)
        b = a[rng.random(len(a)) < 0.9]
        b = np.concatenate([b, rng.integers(0, 60, rng.integers(0, 4)).astype(np.uint32)])
        x, y = order_minhash.numbered(a), order_minhash.numbered(b)
        common = len(np.intersect1d(x, y))
        assert common == sum((Counter(a.tolist()) & Counter(b.tolist())).values())
        differing = sum(int(v).bit_count() for v in
                        (order_minhash.parity_bitmap(x) ^ order_minhash.parity_bitmap(y)).view(np.uint64))
        assert differing <= len(x) + len(y) - 2 * common
        if common >= 0.8 * (len(x) + len(y) - common):
            first = [set(np.sort(z)[:order_minhash.prefix_length(len(z), 0.8)].tolist()) for z in (x, y)]
            assert first[0] & first[1]


def test_op6_one_of_each_class_stays(spark, odd_docs):
    kept = order_minhash.deduplicated(cases.odd_documents(spark))
    assert kept.columns == cases.odd_documents(spark).columns
    blank = [i for i, t in odd_docs if not t]
    classes = {c for (i, t), c in zip(odd_docs, brute.near_classes(odd_docs)) if t}
    check([(r["doc_id"],) for r in kept.collect()], [(i,) for i in blank] + [(c,) for c in classes])


@pytest.mark.parametrize("where", ["odd", "given"])
def test_op7_targets(spark, odd, odd_docs, given, where):
    path = odd if where == "odd" else cases.SF
    docs = [(r["doc_id"], r["text"], r["source"]) for r in read_table(spark, path, "documents").collect()]
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len(brute.WORD.findall(t or ""))
    want = brute.targets(dict(sizes))
    rows = mixing.mix(read_table(spark, path, "documents")).collect()
    check([(r["doc_id"], r["size"], r["source"], r["source_size"]) for r in rows],
          [(i, len(brute.WORD.findall(t or "")), s, sizes[s]) for i, t, s in docs])
    taken, biggest = Counter(), Counter()
    for r in rows:
        assert np.isclose(r["target"], want[r["source"]], rtol=1e-12)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        biggest[r["source"]] = max(biggest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= biggest[s] for s in want)
    again = mixing.mix(read_table(spark, path, "documents").repartition(5)).collect()
    check([(r["doc_id"], r["size"], r["taken"]) for r in again], [(r["doc_id"], r["size"], r["taken"]) for r in rows])


def test_op7_buckets_change_nothing(spark):
    docs = read_table(spark, cases.SF, "documents")
    a = mixing.mix(docs).select("doc_id", "taken").collect()
    b = mixing.mix(docs, mixing.MixSettings(bucket_rows=2)).select("doc_id", "taken").collect()
    check(a, b)


def article_text(source):
    body = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    body = re.sub(r"<(?:b|/b|br)>", "", body)
    import html as H
    blocks = [" ".join(H.unescape(x).split()) for x in re.split(r"<[^>]*>", body)]
    return "\n".join(b for b in blocks if b)


def test_op8_given_pages(spark):
    rows = Q.op8_html_trees(spark, "/root/testdata/sf0.01").collect()
    source = {r["page_id"]: r["html"] for r in read_table(spark, "/root/testdata/sf0.01", "pages").collect()}
    wrong = [r["page_id"] for r in rows if r["text"] != article_text(source[r["page_id"]])]
    assert not wrong
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_op8_other_layouts(spark):
    """Layouts of pages that were not in the sample: words kept and dropped."""
    import random
    pages = read_table(spark, "/root/testdata/sf0.01", "pages")
    forest = html_trees.fit(pages)
    rng, hit, extra, total = random.Random(99), 0, 0, 0
    texts = [" ".join(cases._words(60, k)) for k in range(50)]
    for _ in range(150):
        article = [("h1", "A title of the story")] + [("p", " ".join(f"mine{w}" for w in cases._words(rng.randint(5, 60), rng.randint(0, 99))) + ".")
                                                      for _ in range(rng.randint(2, 9))]
        found = " ".join(html_trees.extract_text(html_trees.lay_out(rng, article, texts), forest)).split()
        mine = sum(w.startswith("mine") for w in found)
        hit += mine
        extra += sum(not w.startswith("mine") for w in found)
        total += sum(len(t.split()) for _, t in article[1:])
    print("recall", hit / total, "extra", extra / total)
    assert hit > 0.95 * total and extra < 0.1 * total


@pytest.mark.parametrize("tag", ["article", "div"])
def test_op8_long_pages_lose_their_menus(spark, tag):
    """Pages beyond 20,000 characters, with and without a marked article."""
    prose = [" ".join(f"mine{w}" for w in cases._words(60, k)) + "." for k in range(60)]
    menu = "<nav class='menu'><ul>" + "".join(f"<li><a href='#'>menu{k}</a></li>" for k in range(8)) + "</ul></nav>"
    foot = "<footer class='footer'><p>foot words</p></footer>"
    rows = [(i, f"<html><body>{menu}<{tag} class='post'>{''.join(f'<p>{p}</p>' for p in prose[i:] + prose[:i])}</{tag}>{foot}</body></html>")
            for i in range(12)]
    assert min(len(h) for _, h in rows) > 20_000
    pages = spark.createDataFrame(rows, "page_id long, html string")
    forest = html_trees.fit(pages)
    for r in html_trees.extract(pages, forest).collect():
        assert sorted(r["blocks"]) == sorted(prose)


def test_op8_consistent_labels():
    page = dom.parse("<div><p>a</p><section><p>b<p>c</section></div><ul><li>x<li>y</ul>tail")
    odds = np.linspace(-3, 3, len(page.nodes)) * np.array([1, -1] * len(page.nodes))[:len(page.nodes)]
    kept = html_trees.decode(page, odds)
    assert all(kept[x.parent] for x, k in zip(page.nodes, kept) if k and x.parent >= 0)


def test_op8_unclosed_hidden_elements_drop_nothing():
    """Only raw-text elements may run to the end of a page; formulas are text."""
    texts = lambda source: [t for _, t in dom.parse(source).runs]
    for tag in ("video", "svg", "object", "audio", "canvas", "template", "noscript"):
        page = f"<article><p>One two.</p><{tag} class=x><p>Three four.</p></article><p>End.</p>"
        assert texts(page) == ["One two.", "Three four.", "End."]
        assert texts(f"<p>a <{tag}><i>x</i><{tag}>y</{tag}>z</{tag}> b</p>c") == ["a b", "c"]
        assert texts(f"<div><{tag}>x<{tag}>y</{tag}></div>z") == ["x", "z"]
    assert texts("Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.") == ["Let x=1 be."]
    for tag in ("script", "style", "title", "iframe"):
        assert texts(f"<p>a</p><{tag}>b<p>c</p>") == ["a"]


def test_op8_reader():
    runs = dom.parse("<!-- x --><title>t</title><style>p{}</style><script>var a='</p>';</script><p class='a>b'>one &amp; <b>two</b>"
                     "\n three<br>four<p>five &nbsp; six<div>seven<!-- <p>no --> eight</div>nine<p>un<closed").runs
    assert [t for _, t in runs] == ["one & two three four", "five six", "seven eight", "nine", "un"]


@pytest.mark.parametrize("where", ["odd", "given"])
def test_op9_bytes(spark, odd, odd_docs, given, where):
    docs, path = (odd_docs, odd) if where == "odd" else (given, cases.SF)
    got = Q.op9_prefix_doubling(spark, path).collect()
    check([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got],
          [(i, *x) for (i, _), x in zip(docs, brute.repeated_bytes([t for _, t in docs], 400))])
    assert any(r["n_removed"] for r in got)


def test_op9_short_strings(spark):
    """Many partial overlaps: short length and small window over texts of few letters."""
    rng = np.random.default_rng(11)
    pool = ["".join(rng.choice(list("abé"), rng.integers(5, 60))) for _ in range(60)]
    docs = [(k, "".join(pool[j] for j in rng.integers(0, 60, rng.integers(0, 12)))) for k in range(150)]
    docs += [(200, "ab" * 100), (201, "a" * 90), (202, docs[3][1]), (203, None)]
    settings = prefix_doubling.Settings(length=40, window=12, kgram=4, cell=3)
    got = prefix_doubling.removed_spans(spark.createDataFrame(docs, "doc_id long, text string"), settings).collect()
    check([(r["doc_id"], r["n_bytes"], sum(s["stop"] - s["first"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"]) for r in got],
          [(i, *x) for (i, _), x in zip(docs, brute.repeated_bytes([t for _, t in docs], 40))])


@pytest.mark.parametrize("where", ["odd", "given"])
def test_op10_hits(spark, odd, odd_docs, given, where):
    docs, path = (odd_docs, odd) if where == "odd" else (given, cases.SF)
    items = [(r["item_id"], r["text"]) for r in read_table(spark, path, "benchmark").collect()]
    got = Q.op10_prefix_set_join(spark, path).collect()
    check([(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got],
          [(i, *x) for (i, _), x in zip(docs, brute.contamination([t for _, t in docs], items))])
    assert any(r["contaminated"] for r in got)


def test_op10_blocks_change_nothing(spark):
    docs, items = read_table(spark, cases.SF, "documents"), read_table(spark, cases.SF, "benchmark")
    one = set_join.contaminated_spans(docs, items).select("doc_id", "n_hit", "items", "spans").collect()
    many = set_join.contaminated_spans(docs, items, block_words=2_000).select("doc_id", "n_hit", "items", "spans").collect()
    check([(r["doc_id"], r["n_hit"], tuple(r["items"]), str(r["spans"])) for r in one],
          [(r["doc_id"], r["n_hit"], tuple(sorted(r["items"])), str(r["spans"])) for r in many])


def test_op10_pass_per_block_unites_hits(spark, monkeypatch):
    """Texts with windows of several blocks, copies, nulls, clashing columns; no task holds two blocks' indexes."""
    words = [f"w{i}" for i in range(400)]
    items = [(f"i{k}", " ".join(words[k * 10:k * 10 + 14])) for k in range(30)]
    texts = [" ".join(words), " ".join(words[5:40]), " ".join(words[35:47] + ["x"] + words[100:110]), None, "", "w1 w2"]
    rows = [(i, t, "mine", "mine") for i, t in enumerate(texts * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key string, text_spans string").repartition(4)
    bench = spark.createDataFrame(items, "item_id string, text string")
    sizes = []
    build = set_join.build_index
    monkeypatch.setattr(set_join, "build_index", lambda r, f: sizes.append(sum(len(ws) for _, ws in r)) or build(r, f))
    one = sorted(map(repr, set_join.contaminated_spans(docs, bench).collect()))
    assert len(sizes) == 1
    many = sorted(map(repr, set_join.contaminated_spans(docs, bench, block_words=200).collect()))
    assert one == many and len(one) == len(rows)
    assert len(sizes) > 4 and max(sizes[1:]) < sizes[0] / 2
    got = {r["doc_id"]: r for r in set_join.contaminated_spans(docs, bench, block_words=200).collect()}
    assert got[0]["n_hit"] == 304 and len(got[0]["items"]) == 30 and got[3]["n_hit"] == got[5]["n_hit"] == 0
    assert got[0]["text_key"] == got[0]["text_spans"] == "mine"
