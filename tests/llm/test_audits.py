"""Operators 11 to 13 against brute force, on given and odd tables."""
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from abode.llm import covering, iceberg, turn_repair
from abode.llm import queries as Q
from abode.llm.common import Scratch, read_table
from tests.llm import brute, cases
from tests.llm.test_operators import check

COLUMNS = {
    "op11": ["lang", "source", "part", "item", "value", "rank"],
    "op12": ["doc_id", "fingerprint", "component_id"],
    "op13": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
}


@pytest.fixture(scope="module")
def odd(spark):
    return cases.folder(spark, cases.odd_documents(spark))


def rows(df, op):
    return [tuple(r[c] for c in COLUMNS[op]) for r in df.collect()]


@pytest.mark.parametrize("where", ["odd", "given"])
def test_op11_equals_brute_force(spark, odd, where):
    path = odd if where == "odd" else cases.SF
    docs = [tuple(r) for r in read_table(spark, path, "documents").select("text", "lang", "source").collect()]
    check(rows(Q.op11_iceberg_divergence(spark, path), "op11"), brute.iceberg_rows(docs))


def test_op11_shared_bits_change_nothing(spark, odd):
    """A bitmap of 8 bits lets every prefix through, and one-byte levels take more passes: the same terms."""
    docs = read_table(spark, odd, "documents")
    wanted = iceberg.refined_terms(docs).collect()
    assert wanted
    check(iceberg.refined_terms(docs, iceberg.Settings(first=1, bits=8)).collect(), wanted)


def test_op11_shares_of_any_count(spark):
    """Shares are exact on both sides of the count from which the product needs more than 64 bits."""
    counts = [0, 1, 7, 8_999_999_999, 9_000_000_000, 9_223_372_036, 10 ** 12 + 7]
    rows_ = spark.createDataFrame([(c, t) for c in counts for t in (1, 10 ** 12 + 39, 10 ** 15 + 37)], "n long, total long")
    got = rows_.select("n", "total", iceberg._share(F.col("n"), F.col("total"), F.lit(3)).alias("p")).collect()
    assert all(r["p"] == 1 + 10 ** 9 * (r["n"] + 1) // (r["total"] + 3) for r in got if r["n"] <= r["total"])


def test_op11_sums_by_language(spark, odd):
    """Terms come with their occurrences in the language, once per term, as sums over its sources."""
    terms, sums = iceberg.kept_terms(read_table(spark, odd, "documents"), iceberg.Settings(), Scratch(spark, "test"))
    total = Counter()
    for r in terms.collect():
        total[r["lang"], r["term"]] += r["n"]
    assert total and all(r["lang_n"] == total[r["lang"], r["term"]] for r in terms.collect())
    assert Counter((r["lang"], r["lang_n"]) for r in sums.collect()) == Counter((k[0], n) for k, n in total.items())


def test_op11_levels_discard(spark):
    """A level makes no row below a discarded prefix; prefixes that end inside a character are kept apart."""
    docs = spark.createDataFrame([("zebra zebu éé", "en", "a"), ("zebra éa", "en", "b"), ("zebra ëé quartz", "en", "b"),
                                  ("quartz", "de", "a")], "text string, lang string, source string")
    settings = iceberg.Settings(first=3)
    first = iceberg._level(docs, 0, 3, None, settings).collect()
    docs_of = {(r["lang"], bytes(r["prefix"]), r["whole"]): r["docs"] for r in first}
    assert docs_of["en", b"zeb", False] == 3 and docs_of["en", b"qua", False] == 1 and docs_of["en", "é".encode() + b"\xc3", False] == 1
    assert docs_of["en", "éa".encode(), True] == 1
    level = iceberg._level(docs, 0, 3, None, settings).filter("not whole and docs >= 3")
    second = iceberg._level(docs, 3, 6, iceberg._bitmap(level, settings), settings).collect()
    assert {(r["lang"], bytes(r["prefix"])) for r in second} == {("en", b"zebra"), ("en", b"zebu")}


@pytest.mark.parametrize("where", ["odd", "given"])
def test_op12_equals_brute_force(spark, odd, where):
    path = odd if where == "odd" else cases.SF
    docs = [tuple(r) for r in read_table(spark, path, "documents").select("doc_id", "text").collect()]
    check(rows(Q.op12_covering_simhash(spark, path), "op12"), brute.hamming_components(docs))


def test_op12_masks_cover_every_pair_within_the_radius():
    rng = random.Random(5)
    for family in (0, 1):
        masks = covering.covering_masks(covering.Settings(), family)
        assert len(masks) == 31
        for _ in range(3000):
            diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
            assert any(m & diff == 0 for m in masks)


def test_op12_large_bucket_is_compared_whole(spark):
    """Hundreds of fingerprints around one, chains at distance 4 and outliers at 5: classes equal all pairs."""
    rng = random.Random(11)
    base = rng.getrandbits(64)
    prints = {base}
    for far in (1, 2, 3, 5, 6, 9, 10):
        for _ in range(90):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(24), far)))
    step = rng.getrandbits(64)
    for _ in range(60):
        step ^= sum(1 << b for b in rng.sample(range(64), 4))
        prints.add(step)
    prints = sorted(prints)
    docs = [(i, None) for i in range(len(prints))]
    want = {f: c for _, f, c in brute.hamming_components(docs, prints=prints)}
    nodes = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "node long")
    scratch = Scratch(spark, "test")
    for settings in (covering.Settings(), covering.Settings(mask_seed=3)):
        got = {}
        for r in covering.near_classes(nodes, scratch, settings).collect():
            got.setdefault(r["label"], set()).add(f"{r['node'] % 2 ** 64:016x}")
        classes = {}
        for f, c in want.items():
            classes.setdefault(c, set()).add(f)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, classes.values()))


def test_op12_left_links_find_what_rounds_did_not(spark):
    """The exact follow-up alone gives every link between classes."""
    rng = random.Random(2)
    base = rng.getrandbits(63)
    prints = sorted({base ^ sum(1 << b for b in rng.sample(range(40), k % 8)) for k in range(300)})
    node = spark.createDataFrame([(p,) for p in prints], "node long")
    masks = covering.covering_masks(covering.Settings(), 0)
    from pyspark.sql import functions as F
    members = node.select("node", F.col("node").alias("label"), F.explode(covering._under(F.col("node"), masks)).alias("bucket"))
    found = covering._left_links(members, members.select("bucket").distinct(), covering.covering_masks(covering.Settings(), 1),
                                 Scratch(spark, "test"), covering.Settings()).collect()
    want = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1:] if (a ^ b).bit_count() <= 4}
    assert {(r["a"], r["b"]) for r in found} == want


def odd_conversations(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Hi!"), (1, 2, "assistant", "Hi!"),
            (2, None, None, None), (2, 3, "user", ""), (2, 3, "tool", "ran"), (None, None, "user", "why."), (None, 1, None, "x"),
            (3, 5, "", "no role."), (3, 9, "assistant", "late \n\t"), (4, 1, "user", "a b c. " * 20_000), (4, 2, "Assistant", "\x1c"),
            (5, 0, "assistant", "One."), (5, 1, "assistant", "Two."), (5, 2, "system", "Three."), (5, 3, "unknown", "Four."),
            (5, -4, "user", "Zero."), (6, 7, "user", None), (None, None, "user", "why.")]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, kind int")


def fuzzy(n, seed):
    rng = random.Random(seed)
    said = ["Yes.", "No!", "Why?", "cut off", " ", "Again."]
    return [(rng.randrange(max(1, n // 30)), None if rng.random() < 0.02 else rng.randrange(n), rng.choice(["user", "assistant"] * 4 + ["system", "tool", None]),
             rng.choice(said) + (str(rng.randrange(9)) + "." if rng.random() < 0.7 else "")) for _ in range(n)]


@pytest.mark.parametrize("where", ["odd", "given", "fuzzy", "long"])
def test_op13_equals_brute_force(spark, where):
    if where == "odd":
        table = odd_conversations(spark)
    elif where == "given":
        table = read_table(spark, "/root/testdata/sf0.01", "conversations")
    else:
        table = spark.createDataFrame(fuzzy(900, 4) if where == "fuzzy" else [(7, *r[1:]) for r in fuzzy(600, 8)],
                                      "conv_id long, turn long, role string, text string").repartition(5)
    data = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    want = brute.repaired_conversations(data)
    for stretch in (16, 3):
        check(rows(turn_repair.repaired(turn_repair.damaged(table), turn_repair.Settings(stretch)), "op13"), want)


def test_op13_alignment_of_every_short_conversation():
    """All conversations of up to four turns: the joined stretches cost and read as the plain recursion."""
    import itertools
    kinds = [a + f for a in "sua?" for f in "-tx"]
    for n in range(5):
        pool = itertools.product(kinds, repeat=n)
        for k, turns in enumerate(pool):
            if n == 4 and k % 7:
                continue
            want = brute.cheapest_edits(tuple((t[0], t[1] if t[1] != "x" else "b") for t in turns))
            for cut in {0, n // 2}:
                parts = [p for p in (turns[:cut], turns[cut:]) if p]
                tables = [[list(row) for row in turn_repair.stretch_audits("".join(p))] for p in parts]
                assert turn_repair.joined_audit(tables) == want, turns


def test_op13_band_keeps_the_least_cost():
    rng = random.Random(3)
    for _ in range(200):
        turns = "".join(rng.choice("suaua?") + rng.choice("--tx") for _ in range(rng.randint(1, 9)))
        for kind in "usa":
            for length in range(1, 8):
                free = turn_repair.aligned(turns, kind, length, turn_repair.FAR // 2)
                if free is not None:
                    assert turn_repair.aligned(turns, kind, length, free[0]) == free
                    assert turn_repair.aligned(turns, kind, length, free[0] - 1) is None


def test_op13_without_damage(spark):
    table = spark.createDataFrame([(1, 0, "system", "S."), (1, 1, "user", "U."), (1, 2, "assistant", "A.")],
                                  "conv_id long, turn long, role string, text string")
    (r,) = turn_repair.repaired(turn_repair.intact(table)).collect()
    assert (r["audit"], r["cost"], r["illegal"], r["gaps"]) == ("KKK", 0, 0, 0)
