"""Quality classifier from weak labels.

Overlapping heuristic labellers vote reject, keep or abstain on two aspects of
each document, low quality and toxicity. Most look for one fault and abstain
without it; others vote keep where nothing is found. Given labels, where a
document has them, are one more labeller of their aspect, and words that go
with toxic labels make a learned lexicon beside the fixed one.
Expectation-maximisation over the votes of all documents estimates how often
each labeller is right. The posterior labels of a bounded sample
train a linear scorer per aspect over hashed words, word beginnings and binned
signals, and the scorers decide on every document.

Bounded, documented parameters: at most ``sample_rows`` labelled documents
(smallest hash of id and text, equal rows once) with ``sample_features`` distinct
words in all train the scorers, and about ``lexicon_rows`` the lexicon, of at most
``lexicon_words`` words. Their votes and features are made in the tasks; the
driver holds only those of the scorers' sample, never a text. Vote counts, signals and scores cover all documents and whole texts.

Defined cases: a text without letters or digits (null, empty) is rejected as
low quality. Without any labels the label-based labellers abstain throughout.
Of several labels for one id the worst counts; labels without an id are
ignored. Equal rows get equal results; an empty table gives an empty result.
Input columns named like an output column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abode.llm import textbytes as B
from abode.llm.common import Scratch, hash_cut

# Insulting words.
INSULTS = ("idiot moron loser scum clown trash stupid pathetic worthless disgusting imbecile "
           "dumb fool jerk retard bastard bitch").split()
SYMBOL_BYTES = b"#*$%&|<>"
QUALITY = ("symbols", "capitals", "repeats", "copied_runs", "marks", "plain", "quality_label")
TOXIC = ("insults", "dense_words", "short_words", "sparse_words", "no_words", "toxic_label")
ABSTAIN = 2


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 10_000
    sample_features: int = 3_000_000
    lexicon_rows: int = 40_000
    lexicon_words: int = 4_000
    lexicon_least_docs: int = 5
    lexicon_share: float = 0.6
    bits: int = 18
    rounds: int = 40
    reject_from: float = 0.5


@dataclass
class Model:
    """What the tasks need: a few MB, fixed by ``bits`` and ``lexicon_words``."""

    settings: Settings
    lexicon: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    accuracy: dict[str, dict[str, float]] = field(default_factory=dict)


def _insult_hashes() -> np.ndarray:
    made = B.buffer_of(pa.array(INSULTS))
    return np.sort(B.span_hash(made.data, made.bounds[:-1], made.bounds[1:]))


def _member(values: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    if not len(ranked):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ranked, values), len(ranked) - 1)
    return ranked[at] == values


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


class Texts:
    """Words, signals and hashed features of the texts of one slice."""

    def __init__(self, column: pa.Array):
        buf = B.buffer_of(column)
        raw = buf.data[:-B.PAD]
        table = B.byte_table(B.letters_and_digits(), lower=True)
        self.data = np.concatenate((table[raw], np.zeros(B.PAD, np.uint8)))
        self.n = len(buf.bounds) - 1
        w = B.find_words(self.data[:-B.PAD] != 0, buf.bounds)
        self.words, self.hash = w, B.span_hash(self.data, w.start, w.end)
        self.n_words = np.bincount(w.doc, minlength=self.n)
        kinds = np.zeros(256, np.uint8)
        kinds[97:123] = 1
        kinds[65:91] = 2
        kinds[list(SYMBOL_BYTES)] = 4
        kinds[[c for c in range(33, 127) if not chr(c).isalnum() and c not in SYMBOL_BYTES and chr(c) not in ".,"]] = 8
        kind = kinds[raw]
        size = np.maximum(np.diff(buf.bounds), 1)
        lower, upper = _per_text(kind == 1, buf.bounds), _per_text(kind == 2, buf.bounds)
        self.letters = lower + upper
        self.symbols = _per_text(kind == 4, buf.bounds) / size
        self.capitals = upper / np.maximum(self.letters, 1)
        self.marks = _per_text(kind == 8, buf.bounds) / size
        same = (w.doc[1:] == w.doc[:-1]) & (self.hash[1:] == self.hash[:-1])
        count = np.maximum(self.n_words, 1)
        self.repeats = np.bincount(w.doc[1:][same], minlength=self.n) / count
        self.copied = self._copied_runs() / count

    def _copied_runs(self) -> np.ndarray:
        """Runs of four words that came earlier in the same text, counted per text."""
        h, doc = self.hash, self.words.doc
        if len(h) < 4:
            return np.zeros(self.n)
        run = h[:-3].copy()
        for k in (1, 2, 3):
            run = run * np.uint64(0x9E3779B97F4A7C15) ^ h[k:len(h) - 3 + k]
        inside = doc[:-3] == doc[3:]
        run, at = run[inside] ^ (doc[:-3][inside].astype(np.uint64) << np.uint64(40)), doc[:-3][inside]
        order, first, _ = B.grouped(run)
        later = np.ones(len(order), bool)
        later[first] = False
        return np.bincount(at[order[later]], minlength=self.n)

    def hits(self, ranked: np.ndarray) -> np.ndarray:
        return np.bincount(self.words.doc[_member(self.hash, ranked)], minlength=self.n)

    def features(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, hashed word or word beginning), by text."""
        w, mask = self.words, np.uint64((1 << bits) - 1)
        long = w.end - w.start > 6
        begin = B.span_hash(self.data, w.start[long], w.start[long] + 6) * np.uint64(0xD6E8FEB86659FD93)
        slot = np.concatenate((self.hash >> np.uint64(20), begin >> np.uint64(20))) & mask
        key = np.concatenate((w.doc, w.doc[long])).astype(np.uint64) << np.uint64(32) | slot
        key, _ = B.counted(key)
        return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def votes(self, model: Model) -> dict[str, np.ndarray]:
        """1 reject, 0 keep, 2 abstain, for each labeller but the given labels."""
        def one_sided(flags: np.ndarray, vote: int = 1) -> np.ndarray:
            return np.where(flags, vote, ABSTAIN)
        enough, lettered = self.n_words >= 5, self.letters >= 20
        insults, learned = self.hits(_insult_hashes()), self.hits(model.lexicon)
        found = insults + learned
        rate = found / np.maximum(self.n_words, 1)
        plain = (self.n_words > 0) & (self.symbols < 0.01) & (self.capitals < 0.2) & (self.repeats < 0.03) & \
            (self.copied < 0.15) & (self.marks < 0.03)
        return {
            "symbols": one_sided(enough & (self.symbols > 0.02)),
            "capitals": one_sided(lettered & (self.capitals > 0.5)),
            "repeats": one_sided(enough & (self.repeats > 0.2)),
            "copied_runs": one_sided(enough & (self.copied > 0.4)),
            "marks": one_sided(enough & (self.marks > 0.1)),
            "plain": one_sided(plain, 0),
            "insults": one_sided((insults > 0) & (rate >= 0.003)),
            "dense_words": one_sided((found >= 2) & (rate >= 0.006)),
            "short_words": one_sided((found >= 1) & (rate >= 0.012)),
            "sparse_words": one_sided((found >= 1) & (rate < 0.003), 0),
            "no_words": one_sided(found == 0, 0),
        }

    def signal_bins(self, model: Model) -> np.ndarray:
        """One bin number per signal and text; columns are signals."""
        learned = self.hits(model.lexicon) + self.hits(_insult_hashes())
        rate = learned / np.maximum(self.n_words, 1)
        cuts = ((self.symbols, (0.005, 0.01, 0.02, 0.03, 0.05, 0.1)), (self.capitals, (0.1, 0.2, 0.35, 0.5, 0.8)),
                (self.repeats, (0.01, 0.05, 0.1, 0.2, 0.4)), (self.copied, (0.05, 0.1, 0.2, 0.3, 0.5)),
                (self.marks, (0.01, 0.03, 0.05, 0.1, 0.2)), (learned, (1, 2, 3, 6)),
                (rate, (0.001, 0.004, 0.008, 0.015)))
        return np.stack([np.digitize(x, c) for x, c in cuts], axis=1)

    def design(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows of the scorer: (text, column, value)."""
        return sparse_rows(*self.features(model.settings.bits), self.signal_bins(model), model.settings.bits)


def sparse_rows(doc: np.ndarray, col: np.ndarray, bins: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, column, value) from (text, hashed word) and the signals' bins. Words count 4 / sqrt(distinct + 16) each."""
    n = len(bins)
    value = 4.0 / np.sqrt(np.bincount(doc, minlength=n) + 16)[doc]
    base = (1 << bits) + 1 + 8 * np.arange(bins.shape[1])
    rows = np.repeat(np.arange(n), bins.shape[1] + 1)
    more = np.concatenate((np.full((n, 1), 1 << bits), bins + base), axis=1).ravel()
    return np.concatenate((doc, rows)), np.concatenate((col, more)), np.concatenate((value, np.ones(len(rows))))


def _width(settings: Settings) -> int:
    return (1 << settings.bits) + 1 + 8 * 7


def _packed(votes: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(votes[0]), np.int64)
    for v in votes:
        out = out * 3 + v
    return out


def _unpacked(codes: np.ndarray, n: int) -> np.ndarray:
    return np.stack([codes // 3 ** (n - 1 - k) % 3 for k in range(n)], axis=1)


def estimate(patterns: np.ndarray, counts: np.ndarray, start: np.ndarray, held: np.ndarray,
             given: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns (rows: patterns, columns: labellers).

    Each labeller keeps, rejects or abstains with its own probabilities for
    documents to reject and to keep, independently given the truth. ``start``
    (labeller, truth, vote) are the first values; ``held`` is the weight, in
    shares of all documents, that they keep. Where ``given``, abstaining says
    nothing about the truth. Returns the posterior of reject for each pattern,
    each labeller's share of right votes and the prior of reject.
    """
    n = counts.sum()
    vote = np.eye(3)[patterns]  # pattern, labeller, vote
    rate, prior, post = start.copy(), 0.1, np.zeros(len(patterns))
    speaks = ~(given & (patterns == ABSTAIN))
    for _ in range(rounds):
        logs = np.einsum("pkv,ktv->pkt", vote, np.log(rate)) * speaks[:, :, None]
        z = np.log(prior / (1 - prior)) + (logs[:, :, 1] - logs[:, :, 0]).sum(1)
        now = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        weight = np.stack((counts * (1 - now), counts * now))
        seen = np.einsum("tp,pkv,pk->ktv", weight, vote, speaks.astype(float))
        pseudo = (held * n + 1)[:, None, None] * start
        rate = np.maximum(seen + pseudo, 1e-9)
        rate /= rate.sum(2, keepdims=True)
        prior = float(np.clip((counts @ now + 1) / (n + 10), 0.01, 0.9))
        if np.abs(now - post).max(initial=0) < 1e-6:
            break
        post = now
    right = (prior * rate[:, 1, 1] + (1 - prior) * rate[:, 0, 0])
    voted = prior * rate[:, 1, :2].sum(1) + (1 - prior) * rate[:, 0, :2].sum(1)
    return now, right / np.maximum(voted, 1e-9), prior


def _start(names: tuple[str, ...]) -> np.ndarray:
    """First vote probabilities: (truth keep, truth reject) x (keep, reject, abstain)."""
    one_fault = [[0.005, 0.01, 0.985], [0.01, 0.3, 0.69]]
    nothing_found = [[0.8, 0.005, 0.195], [0.1, 0.01, 0.89]]
    label = [[0.97, 0.01, 0.02], [0.01, 0.97, 0.02]]
    return np.array([label if n.endswith("_label") else nothing_found if n in ("plain", "no_words", "sparse_words") else one_fault
                     for n in names])


def fit_scorer(row: np.ndarray, col: np.ndarray, value: np.ndarray, target: np.ndarray, width: int, rounds: int) -> np.ndarray:
    """Logistic regression on soft targets with a small ridge, by L-BFGS."""
    used, place = np.unique(col, return_inverse=True)
    n, ridge = max(len(target), 1), 1e-4

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(row, w[place] * value, minlength=len(target))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.bincount(place, error[row] * value, minlength=len(used)) / n + ridge * w
        return float((np.logaddexp(0, z) - target * z).mean() + 0.5 * ridge * (w @ w)), g

    w = np.zeros(len(used))
    f, g = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, kept = -g, []
        for s, y in reversed(steps):
            a = (s @ d) / (y @ s)
            d = d - a * y
            kept.append(a)
        if steps:
            s, y = steps[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(steps, reversed(kept)):
            d = d + s * (a - (y @ d) / (y @ s))
        size = 1.0
        while size > 1e-6:
            f_now, g_now = loss(w + size * d)
            if f_now <= f + 1e-4 * size * (g @ d):
                break
            size /= 2
        else:
            break
        s, y = size * d, g_now - g
        w, f, g = w + s, f_now, g_now
        if y @ s > 1e-12:
            steps = [*steps[-7:], (s, y)]
        if np.abs(g).max() < 1e-6:
            break
    out = np.zeros(width)
    out[used] = w
    return out


def _sample(df: DataFrame, given: DataFrame, settings: Settings) -> DataFrame:
    """About ``lexicon_rows`` labelled documents: those whose hash of id and text (column h) is below a cut.

    Without any label, ``sample_rows`` documents as such.
    """
    h = F.xxhash64("doc_id", "text")
    labelled = given.limit(1).count() > 0
    ids, most = (given, settings.lexicon_rows) if labelled else (df.filter("doc_id is not null"), settings.sample_rows)
    cut = hash_cut(ids.count(), most)
    rows = df.filter("doc_id is not null").filter(h <= F.lit(cut)).select("doc_id", "text", h.alias("h"))
    return rows.join(given, "doc_id", "inner" if labelled else "left")


_DESIGN = "h long, q long, t long, quality_label int, toxic_label int, columns array<int>, bins array<int>"


def design_rows(sample: DataFrame, model: Model) -> DataFrame:
    """Votes, labels and features of the sample's texts, made in the tasks; equal rows once."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.slices(batches, "text", 1 << 20):
            t = Texts(b.column("text"))
            v = t.votes(shared.value)
            doc, col = t.features(shared.value.settings.bits)
            bins = t.signal_bins(shared.value)
            at = np.searchsorted(doc, np.arange(t.n + 1)).astype(np.int32)
            wide = (np.arange(t.n + 1) * bins.shape[1]).astype(np.int32)
            yield pa.record_batch({
                "h": b.column("h"), "q": _packed([v[k] for k in QUALITY[:-1]]), "t": _packed([v[k] for k in TOXIC[:-1]]),
                "quality_label": b.column("quality_label"), "toxic_label": b.column("toxic_label"),
                "columns": pa.ListArray.from_arrays(at, pa.array(col.astype(np.int32))),
                "bins": pa.ListArray.from_arrays(wide, pa.array(bins.ravel().astype(np.int32)))})
    return sample.select("h", "text", "quality_label", "toxic_label").mapInArrow(made, _DESIGN).dropDuplicates(["h"])


def _bounded(design: DataFrame, settings: Settings) -> DataFrame:
    """The rows with the least h, while they are at most ``sample_rows`` with ``sample_features`` features.

    The cut comes from sums over a thousand ranges of h; at least the first range is taken.
    """
    top = design.agg(F.max("h").alias("top")).collect()[0]["top"]
    if top is None:
        return design
    step = F.floor((F.col("h").cast("double") + 2.0 ** 63) / F.lit((top + 2.0 ** 63) / 1000 or 1.0)).cast("int")
    sums = sorted(design.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows"),
                                                         F.sum(F.size("columns")).alias("features")).collect())
    rows = features = 0
    last = sums[0]["step"]
    for s in sums:
        rows, features = rows + s["rows"], features + s["features"]
        if rows > settings.sample_rows or features > settings.sample_features:
            break
        last = s["step"]
    return design.filter(step <= F.lit(last))


def learn_lexicon(sample: DataFrame, settings: Settings) -> np.ndarray:
    """Hashes of words that occur mostly in toxic ones among the labelled texts of the sample."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.slices(batches, "text", 4 << 20):
            t = Texts(b.column("text"))
            toxic = np.asarray(b.column("toxic_label"))
            order, first, _ = B.grouped(t.hash ^ (t.words.doc.astype(np.uint64) << np.uint64(44)))
            pick = order[first]  # each word once per text
            word, bad = t.hash[pick], toxic[t.words.doc[pick]].astype(np.int64)
            order, first, docs = B.grouped(word)
            yield pa.record_batch({"word": word[order[first]].view(np.int64), "docs": docs.astype(np.int64),
                                   "bad": np.add.reduceat(bad[order], first) if len(first) else docs.astype(np.int64)})
    known = sample.filter("toxic_label is not null")
    counts = known.select("text", "toxic_label").mapInArrow(count, "word long, docs long, bad long") \
        .groupBy("word").agg(F.sum("docs").alias("docs"), F.sum("bad").alias("bad"))
    share = F.col("bad") / F.col("docs")
    found = counts.filter((F.col("bad") >= settings.lexicon_least_docs) & (share >= settings.lexicon_share)) \
        .orderBy(F.desc("bad"), "word").limit(settings.lexicon_words)
    return np.sort(np.asarray(found.select("word").toArrow().column("word")).astype(np.int64).view(np.uint64))


def fit(df: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """EM over the votes on all documents, then the scorers on the sample's posterior labels."""
    spark = df.sparkSession
    scratch = Scratch(spark, "weak-labels")
    given = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    given = given.select("doc_id", (1 - F.col("quality")).cast("int").alias("quality_label"),
                         F.col("toxic").cast("int").alias("toxic_label"))
    table = scratch.write(_sample(df, given, settings), "sample")
    model = Model(settings)
    model.lexicon = learn_lexicon(table, settings)
    shared = spark.sparkContext.broadcast(model)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.slices(batches, "text", 4 << 20):
            v = Texts(b.column("text")).votes(shared.value)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "q": _packed([v[k] for k in QUALITY[:-1]]),
                                   "t": _packed([v[k] for k in TOXIC[:-1]])})
    id_type = df.schema["doc_id"].dataType.simpleString()
    votes = df.select("doc_id", "text").mapInArrow(vote, f"doc_id {id_type}, q long, t long")
    votes = votes.join(given, "doc_id", "left")
    code = {"q": "quality_label", "t": "toxic_label"}
    votes = votes.select(*[(F.col(k) * 3 + F.coalesce(F.col(v), F.lit(ABSTAIN))).alias(k) for k, v in code.items()])
    # at most 3 ** 13 patterns, whatever the corpus; far fewer occur, as labellers look for one fault each
    found = votes.groupBy("q", "t").count().toArrow()
    count = np.asarray(found.column("count"), dtype=np.float64)
    design = scratch.write(design_rows(table, model), "design")
    sample = _bounded(design, settings).toArrow().sort_by("h")
    at = sample.num_rows
    row, col, value = (np.zeros(0, np.int64),) * 3
    if at:
        size = np.asarray(sample.column("columns").combine_chunks().value_lengths())
        words = np.asarray(sample.column("columns").combine_chunks().flatten()).astype(np.int64)
        bins = np.asarray(sample.column("bins").combine_chunks().flatten()).astype(np.int64).reshape(at, -1)
        row, col, value = sparse_rows(np.repeat(np.arange(at), size), words, bins, settings.bits)
        value = value.astype(np.float32)
    for aspect, names, column in (("quality", QUALITY, "q"), ("toxic", TOXIC, "t")):
        codes, where = np.unique(np.asarray(found.column(column)), return_inverse=True)
        patterns = _unpacked(codes, len(names))
        is_label = np.arange(len(names)) == len(names) - 1
        post, right, _ = estimate(patterns, np.bincount(where, count, minlength=len(codes)), _start(names),
                                  np.where(is_label, 1.0, 0.001), is_label)
        model.accuracy[aspect] = dict(zip(names, right.tolist()))
        if at:
            mine = np.asarray(sample.column(column)) * 3 + np.asarray(sample.column(names[-1]).fill_null(ABSTAIN))
            target = post[np.minimum(np.searchsorted(codes, mine), len(codes) - 1)]
            model.weights[aspect] = fit_scorer(row, col, value, target, _width(settings), settings.rounds).astype(np.float32)
        else:
            model.weights[aspect] = np.zeros(_width(settings), np.float32)
    shared.unpersist()
    scratch.drop("sample", "design")
    return model


OUTPUT = "low_quality double, toxicity double, kept boolean"


def classify(df: DataFrame, model: Model) -> DataFrame:
    """``df`` with both scores (probabilities of reject) and ``kept``."""
    names = [x.split()[0] for x in OUTPUT.split(", ")]
    df = df.drop(*names)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in B.slices(batches, "text", 4 << 20):
            t = Texts(b.column("text"))
            row, col, value = t.design(m)
            p = {a: 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col] * value, minlength=t.n), -30, 30)))
                 for a, w in m.weights.items()}
            low = np.where(t.n_words == 0, 1.0, p["quality"])
            kept = (low < m.settings.reject_from) & (p["toxic"] < m.settings.reject_from)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(low), pa.array(p["toxic"]), pa.array(kept)],
                                             [*b.schema.names, *names])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(score, f"{fields}, {OUTPUT}")
