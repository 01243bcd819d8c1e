"""Language-model scoring with a probabilistic suffix tree.

Symbols are the UTF-8 bytes of a text's words (A-Z lower-cased), one space
between words and a line feed as the end token; NUL and byte 1 count as one
symbol. A context is the run of up to ``depth`` symbols before a symbol; it may
cross words but not the start of the text, which counts as a line feed.

Training counts every (context, next symbol) of all training texts, and every
word. A context becomes a state of the tree if

* it occurs at least ``least_count`` times, and
* its next-symbol distribution diverges from that of its longest proper
  suffix: sum n(x) ln(p(x | context) / p(x | suffix)) > 0.5 (k - 1) ln n, with
  k distinct next symbols (the gain in likelihood exceeds its description
  length), or a longer context that has it as a suffix is a state.

Distributions are smoothed towards the suffix:
p(x | s) = (n(s, x) + m p(x | suffix)) / (n(s) + m), below the root the
uniform distribution over 256 symbols. A symbol is scored in the state of the
longest suffix of what precedes it. So every text has a probability above 0.

The states are Spark tables that grow with the corpus. Tasks hold the counts of
``heavy_words`` words and the ``top_states`` most frequent states at most (with all
their suffixes, which are more frequent): 8 bytes a state and distinct symbol, so 135 MB
at most. A symbol whose longest suffix lies beyond them leaves its task as one row per (context, symbol) and block, a
run of texts of the task with ``block`` such entries; the texts keep the places of theirs among the rows of their block.
These are joined to the tables of the deeper states, each distinct one is smoothed once, and each block's texts meet
its scores once. So a (context, symbol) of many texts costs a row per block, not per text. Words beyond ``heavy_words``
are joined by key too.

The unigram base score of a text is the sum over its tokens of
log10((c + 0.1) / (N + 0.1 (V + 1))).

Defined cases: null and blank texts are the end token alone. Equal rows count
one by one in training and get equal scores. Without training texts N, V and
all counts are 0 and the tree is the uniform root.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abode.llm import textbytes as B
from abode.llm.common import Scratch, row_key

END, SPACE = 10, 32
WORD, GRAM = 0, 1
#: Marks in place of a child: no state, a state that is in the tables only.
NONE, DEEPER = -1, -2
_SLICE = 1 << 20
_CHUNK = 1 << 18
#: States whose distributions are smoothed at once.
_ROWS = 1 << 12
#: Keys that a task holds before it hands its counts on, and rows of a batch it hands on at once.
_TALLY, _BATCH = 2_000_000, 1 << 16
#: Parts in which a tally is merged, so that its working arrays are small beside it.
_MERGED = 16


@dataclass(frozen=True)
class Settings:
    depth: int = 5  # 7 at most: a context and its symbol are one 64-bit key
    least_count: int = 8
    smoothing: float = 8.0
    heavy_words: int = 1 << 18
    top_states: int = 1 << 16
    block: int = 1 << 20  # entries (text and gram) beyond the tasks' tree whose grams are looked up together


def normalised(column: pa.Array) -> np.ndarray:
    """A line feed, then each text's words with single spaces and a line feed at its end; padded."""
    texts = column.cast(pa.binary()).to_pylist()
    made = b"\n" + b"".join(b" ".join((t or b"").lower().split()) + b"\n" for t in texts)
    data = np.zeros(len(made) + B.PAD, np.uint8)
    data[:len(made)] = np.frombuffer(made, np.uint8)
    return data


def word_hashes(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word of ``normalised`` data."""
    body = data[:n]
    sep = np.flatnonzero((body == SPACE) | (body == END))
    start, end = sep[:-1] + 1, sep[1:]
    doc = np.cumsum(body[sep[:-1]] == END) - 1
    some = end > start
    return B.span_hash(data, start[some], end[some]), doc[some]


def grams(data: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Key of each symbol but the first: the symbol, and above it its context, nearest symbol lowest.

    Bytes beyond the line feed before the text are 0.
    """
    body = np.maximum(data[:n], 1)
    ends = np.flatnonzero(data[:n] == END)
    keys = body[1:].astype(np.uint64)
    for k in range(1, depth + 1):
        keys[k - 1:] |= body[:n - k].astype(np.uint64) << np.uint64(8 * k)
    for k in range(depth):
        at = ends[:-1] + k  # index of symbol ends + 1 + k in keys; it has k + 1 symbols of context
        at = at[at < len(keys)]
        keys[at] &= np.uint64((1 << (8 * (k + 2))) - 1)
    return keys


class Tally:
    """Counts by key, merged over the slices of a task. Keys are added in ascending order, each once."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.merged = 0

    @property
    def size(self) -> int:
        return sum(len(k) for k, _ in self.parts)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        if self.size > 2 * self.merged + _TALLY // 4:
            self.parts = [self.take()]
            self.merged = self.size

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """All counts so far; the tally is empty then."""
        parts, self.parts, self.merged = self.parts, [], 0
        if len(parts) == 1:
            return parts[0]
        longest = max((k for k, _ in parts), key=len, default=np.zeros(0, np.uint64))
        bounds = longest[len(longest) * np.arange(1, _MERGED) // _MERGED] if len(longest) else longest
        cuts = [[0, *np.searchsorted(k, bounds).tolist(), len(k)] for k, _ in parts]
        made = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for i in range(len(bounds) + 1):
            keys = np.concatenate([np.zeros(0, np.uint64), *(k[c[i]:c[i + 1]] for (k, _), c in zip(parts, cuts))])
            counts = np.concatenate([np.zeros(0, np.int64), *(n[c[i]:c[i + 1]] for (_, n), c in zip(parts, cuts))])
            order, first, _ = B.grouped(keys)
            if len(first):
                made.append((keys[order[first]], np.add.reduceat(counts[order], first)))
        del parts
        return np.concatenate([k for k, _ in made]), np.concatenate([n for _, n in made])


def _tally_rows(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(keys), _BATCH):
        some = keys[a:a + _BATCH]
        yield pa.record_batch({"kind": np.full(len(some), kind, np.int8), "key": some.view(np.int64),
                               "n": counts[a:a + _BATCH].astype(np.int64)})


def training_counts(df: DataFrame, settings: Settings) -> DataFrame:
    """``kind, key, n``: totals of word hashes (the end token is key 0) and of grams over all texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, keys, ends = Tally(), Tally(), 0
        for b in B.slices(batches, "text", _SLICE):
            data = normalised(b.column("text"))
            n = len(data) - B.PAD
            words.add(*B.counted(word_hashes(data, n)[0]))
            keys.add(*B.counted(grams(data, n, settings.depth)))
            ends += b.num_rows
            for kind, tally in ((WORD, words), (GRAM, keys)):
                if tally.size > _TALLY:
                    yield from _tally_rows(kind, *tally.take())
        yield from _tally_rows(WORD, *words.take())
        yield from _tally_rows(GRAM, *keys.take())
        yield from _tally_rows(WORD, np.zeros(1, np.uint64), np.array([ends]))
    made = df.select("text").mapInArrow(count, "kind byte, key long, n long")
    return made.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _masks(settings: Settings) -> list[int]:
    """By depth: the bits of a context of that many symbols."""
    return [(1 << (8 * d)) - 1 for d in range(settings.depth + 1)]


def tree_rows(counts: DataFrame, settings: Settings) -> DataFrame:
    """``d, ctx, x, n, total, kinds``: next-symbol counts of the contexts that occur often enough."""
    mask = _masks(settings)
    g = counts.filter(F.col("kind") == GRAM).select(
        F.shiftrightunsigned("key", 8).alias("full"), F.col("key").bitwiseAND(255).cast("int").alias("x"), "n")
    depths = F.array(*[F.struct(F.lit(d).alias("d"), F.col("full").bitwiseAND(mask[d]).alias("ctx"))
                       for d in range(settings.depth + 1)])
    g = g.select(F.explode(depths).alias("c"), "x", "n").select("c.d", "c.ctx", "x", "n")
    # a context of d symbols is complete if its farthest byte is there
    complete = F.col("d") == 0
    for d in range(1, settings.depth + 1):
        complete = complete | ((F.col("d") == d) & (F.shiftright("ctx", 8 * (d - 1)) != 0))
    g = g.filter(complete).groupBy("d", "ctx", "x").agg(F.sum("n").alias("n"))
    sizes = g.groupBy("d", "ctx").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    sizes = sizes.filter((F.col("total") >= settings.least_count) | (F.col("d") == 0))
    return g.join(sizes, ["d", "ctx"])


def retained(rows: DataFrame, settings: Settings) -> DataFrame:
    """``d, ctx`` of the contexts that pass the divergence test."""
    shorter = F.element_at(F.array(*[F.lit(m).cast("long") for m in _masks(settings)]), F.col("d"))
    child = rows.filter("d > 0").withColumn("pd", F.col("d") - 1).withColumn("pctx", F.col("ctx").bitwiseAND(shorter))
    parent = rows.select(F.col("d").alias("pd"), F.col("ctx").alias("pctx"), "x",
                         F.col("n").alias("pn"), F.col("total").alias("ptotal"))
    gain = F.sum(F.col("n") * F.log((F.col("n") / F.col("total")) / (F.col("pn") / F.col("ptotal"))))
    tested = child.join(parent, ["pd", "pctx", "x"]).groupBy("d", "ctx", "total", "kinds").agg(gain.alias("gain"))
    return tested.filter(F.col("gain") > 0.5 * (F.col("kinds") - 1) * F.log("total")).select("d", "ctx")


def states_of(rows: DataFrame, settings: Settings) -> DataFrame:
    """``d, ctx, total`` of all states but the root: the retained contexts and their suffixes."""
    mask = _masks(settings)
    suffixes = F.filter(F.array(*[F.struct(F.lit(a).alias("d"), F.col("ctx").bitwiseAND(mask[a]).alias("ctx"))
                                  for a in range(1, settings.depth + 1)]), lambda s: s["d"] <= F.col("d"))
    closed = retained(rows, settings).select(F.explode(suffixes).alias("s")).select("s.d", "s.ctx").distinct()
    return closed.join(rows.groupBy("d", "ctx").agg(F.max("total").alias("total")), ["d", "ctx"])


@dataclass
class Tree:
    """The frequent states by number (0 is the root): children by symbol code, log10 probabilities by symbol code."""

    code: np.ndarray    # symbol -> code; the last code is for symbols never seen
    child: np.ndarray   # (states, codes): the state of one more symbol of context, NONE or DEEPER
    logp: np.ndarray    # (states, codes)
    depth: int

    @property
    def states(self) -> int:
        return len(self.child)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name)).astype(np.int64)


def build_tree(rows: pa.Table, deeper: pa.Table, settings: Settings) -> Tree:
    """The tree of the states in ``rows`` (as ``tree_rows``, closed under suffixes).

    ``deeper``: ``d, ctx`` of the other states that are one symbol longer than one of these.
    """
    d, ctx, x, n = (_column(rows, c) for c in ("d", "ctx", "x", "n"))
    # the depth above the context: states ascend by depth, then by context
    label = (d.astype(np.uint64) << np.uint64(56)) | ctx.astype(np.uint64)
    states, at = np.unique(np.append(label, np.uint64(0)), return_inverse=True)
    at = at[:-1]
    seen = np.unique(x) if len(x) else np.zeros(0, np.int64)
    code = np.full(256, len(seen), np.int64)
    code[seen] = np.arange(len(seen))
    code[0] = code[1]
    width = len(seen) + 1
    child = np.full((len(states), width), NONE, np.int32)
    logp = np.empty((len(states), width), np.float32)

    def up(labels: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(state of the longest proper suffix, code of the symbol before it) of contexts of one depth."""
        c = labels & np.uint64((1 << 56) - 1)
        short = (c & np.uint64((1 << (8 * (depth - 1))) - 1)) | np.uint64((depth - 1) << 56)
        return np.searchsorted(states, short), code[(c >> np.uint64(8 * (depth - 1))).astype(np.int64)]

    m, below, first_below = settings.smoothing, None, 0
    for depth in range(settings.depth + 1):
        a, z = np.searchsorted(states, [np.uint64(depth << 56), np.uint64((depth + 1) << 56)])
        mine = d == depth
        table = np.zeros((z - a, width))
        np.add.at(table, (at[mine] - a, code[x[mine]]), n[mine])
        if depth:
            parent, symbol = up(states[a:z], depth)
            child[parent, symbol] = np.arange(a, z)
        for i in range(0, z - a, _ROWS):
            some = slice(i, min(i + _ROWS, z - a))
            base = below[parent[some] - first_below] if depth else np.full((1, width), 1 / 256)
            table[some] = (table[some] + m * base) / (table[some].sum(1, keepdims=True) + m)
            logp[a:z][some] = np.log10(table[some])
        below, first_below = table, a
        more = _column(deeper, "d") == depth
        if depth and more.any():
            found = _column(deeper, "ctx")[more].astype(np.uint64) | np.uint64(depth << 56)
            parent, symbol = up(found, depth)
            child[parent, symbol] = DEEPER
    return Tree(code, child, logp, settings.depth)


def walk(data: np.ndarray, n: int, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of the symbols, the positions with a state beyond the tree, and the depth they reached in it.

    Score i is the log10 probability of symbol i + 1 in the state of its longest suffix within the tree.
    """
    out = np.empty(n - 1)
    codes = tree.code.astype(np.int16)[data[:n]]
    width = tree.child.shape[1]
    child = tree.child.ravel()
    flat = tree.logp.ravel()
    beyond, depths = [], []
    for a in range(1, n, _CHUNK):
        z = min(n, a + _CHUNK)
        state = np.zeros(z - a, np.int64)
        live = np.arange(z - a)
        for k in range(1, tree.depth + 1):
            at = live + (a - k)
            if a - k < 0:
                live, at = live[at >= 0], at[at >= 0]
            after = child[state[live] * width + codes[at]]
            off = live[after == DEEPER]
            beyond.append(off + a)
            depths.append(np.full(len(off), k - 1))
            go = after >= 0
            live = live[go]
            state[live] = after[go]
        out[a - 1:z - 1] = flat[state * width + codes[a:z]]
    none = np.zeros(0, np.int64)
    return out, np.concatenate([none, *beyond]), np.concatenate([none, *depths])


def symbol_scores(data: np.ndarray, n: int, tree: Tree) -> np.ndarray:
    """log10 probability of each symbol but the first, in the state of its longest suffix within the tree."""
    return walk(data, n, tree)[0]


def grams_at(data: np.ndarray, at: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Keys as those of ``grams``, of the symbols at some positions; ``ends``: positions of all line feeds."""
    begin = ends[np.searchsorted(ends, at) - 1]
    keys = np.maximum(data[at], 1).astype(np.uint64)
    for k in range(1, depth + 1):
        there = at - k >= begin
        keys[there] |= np.maximum(data[at[there] - k], 1).astype(np.uint64) << np.uint64(8 * k)
    return keys


@dataclass
class Heavy:
    """Counts of frequent words in a table with one place per hash prefix; other words are joined."""

    keys: np.ndarray
    counts: np.ndarray
    shift: np.uint64

    @classmethod
    def of(cls, words: np.ndarray, counts: np.ndarray, bits: int = 20) -> Heavy:
        shift = np.uint64(64 - bits)
        keys, table = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)
        order = np.argsort(counts, kind="stable")  # the most frequent is written last
        place = (words[order] >> shift).astype(np.int64)
        keys[place], table[place] = words[order], counts[order]
        return cls(keys, table, shift)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, count) of each word."""
        place = (words >> self.shift).astype(np.int64)
        count = self.counts[place]
        found = (self.keys[place] == words) & (count > 0)
        return found, count


@dataclass
class Model:
    """What the tasks hold."""

    tree: Tree
    heavy: Heavy
    end_count: int
    tokens: int
    distinct: int

    def base_log(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))


@dataclass
class Tables:
    """What grows with the corpus: ``words`` (key, n), the deeper states (d, ctx, total) and their next symbols (d, ctx, x, n)."""

    words: DataFrame
    states: DataFrame
    symbols: DataFrame
    settings: Settings


def frequent(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """The rows above a count that at most ``most`` rows exceed.

    The count comes from a histogram of the counts' logarithms (a few hundred
    rows), so no task sorts or gathers the rows.
    """
    step = F.floor(F.log2(n) * 8).cast("int")
    sizes = sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True)
    cut, total = None, 0
    for row in sizes:
        total += row["count"]
        if total > most:
            cut = row["step"]
            break
    return counts if cut is None else counts.filter(step > F.lit(cut))


def fit(train: DataFrame, scratch: Scratch, settings: Settings = Settings()) -> tuple[Model, Tables]:
    """The model that the tasks hold, and the tables of all training words and deeper states."""
    counts = scratch.write(training_counts(train, settings), "counts")
    word_counts = counts.filter((F.col("kind") == WORD) & (F.col("n") > 0)).select("key", "n")
    sums = word_counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("kinds"),
                           F.coalesce(F.sum(F.when(F.col("key") == 0, F.col("n"))), F.lit(0)).alias("ends")).collect()[0]
    heavy = frequent(word_counts.filter("key <> 0"), settings.heavy_words).toArrow()
    heavy = Heavy.of(np.asarray(heavy.column("key")).view(np.uint64), np.asarray(heavy.column("n")))
    rows = scratch.write(tree_rows(counts, settings), "tree")
    states = scratch.write(states_of(rows, settings), "states")
    # a suffix is as frequent as its contexts or more, so the top is closed under suffixes
    top = scratch.write(frequent(states, settings.top_states, "total").select("d", "ctx"), "top")
    deep = scratch.write(states.join(top, ["d", "ctx"], "left_anti"), "deep")
    symbols = scratch.write(rows.join(deep, ["d", "ctx"], "left_semi").select("d", "ctx", "x", "n"), "symbols")
    inner = rows.filter("d = 0").unionByName(rows.join(top, ["d", "ctx"], "left_semi")).select("d", "ctx", "x", "n")
    # one row at most per state and symbol of the top
    shorter = F.element_at(F.array(*[F.lit(m).cast("long") for m in _masks(settings)]), F.col("d"))
    above = top.select(F.col("d").alias("pd"), F.col("ctx").alias("pctx"))
    edge = deep.withColumn("pd", F.col("d") - 1).withColumn("pctx", F.col("ctx").bitwiseAND(shorter))
    edge = edge.filter("pd = 0").select("d", "ctx").unionByName(edge.join(above, ["pd", "pctx"], "left_semi").select("d", "ctx"))
    tree = build_tree(inner.toArrow(), edge.toArrow(), settings)
    model = Model(tree, heavy, int(sums["ends"]), int(sums["tokens"]), int(sums["kinds"]))
    return model, Tables(word_counts, deep, symbols, settings)


def deeper_scores(found: DataFrame, tables: Tables) -> DataFrame:
    """``gram, logp``: log10 probability of each distinct (context, symbol) whose state is in the tables.

    ``found``: ``gram, reached, base``, the depth and the log10 probability it has in the tasks' tree.
    """
    settings, mask = tables.settings, _masks(tables.settings)
    grams = found.groupBy("gram").agg(F.max("reached").alias("reached"), F.max("base").alias("base"))
    full = F.shiftrightunsigned("gram", 8)
    chain = F.filter(F.array(*[F.struct(F.lit(d).alias("d"), full.bitwiseAND(mask[d]).alias("ctx"))
                               for d in range(1, settings.depth + 1)]), lambda s: s["d"] > F.col("reached"))
    links = grams.select("gram", "base", F.col("gram").bitwiseAND(255).cast("int").alias("x"), F.explode(chain).alias("s")) \
        .select("gram", "base", "x", "s.d", "s.ctx")
    links = links.join(tables.states, ["d", "ctx"]).join(tables.symbols, ["d", "ctx", "x"], "left")
    links = links.groupBy("gram", "base").agg(F.sort_array(F.collect_list(  # at most one link per depth
        F.struct("d", F.coalesce("n", F.lit(0)).cast("double").alias("n"), F.col("total").cast("double").alias("total")))).alias("links"))
    m = settings.smoothing
    p = F.aggregate("links", F.pow(F.lit(10.0), F.col("base")), lambda below, s: (s["n"] + below * m) / (s["total"] + m))
    return links.select("gram", F.log10(p).alias("logp"))


class Block:
    """Texts of a task and their entries (text, gram and how often) beyond its tree, until they are handed on."""

    def __init__(self) -> None:
        self.texts: list[pa.RecordBatch] = []
        self.entries: list[tuple[np.ndarray, ...]] = []

    @property
    def rows(self) -> int:
        return sum(t.num_rows for t in self.texts)

    @property
    def size(self) -> int:
        return sum(len(e[0]) for e in self.entries)

    def add(self, texts: pa.RecordBatch, text: np.ndarray, keys: np.ndarray, reached: np.ndarray, base: np.ndarray) -> None:
        """``texts``, and the text, gram, depth and score of each symbol beyond the tree."""
        order = np.lexsort((keys, text))
        text, keys = text[order], keys[order]
        first = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (keys[1:] != keys[:-1])))) \
            if len(text) else np.zeros(0, np.int64)
        self.entries.append((text[first] + self.rows, keys[first], np.diff(np.append(first, len(text))).astype(np.int32),
                             reached[order][first].astype(np.int8), base[order][first]))
        self.texts.append(texts)

    def take(self, number: int) -> Iterator[dict[str, pa.Array | np.ndarray]]:
        """Columns of the texts, then of the distinct grams by ``place``; the block is empty then."""
        n = self.rows
        texts = pa.Table.from_batches(self.texts).combine_chunks()
        text, keys, times, reached, base = (np.concatenate(c) for c in zip(*self.entries))
        self.texts, self.entries = [], []
        grams, first, place = np.unique(keys, return_index=True, return_inverse=True)
        bounds = pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32())
        yield {c: texts.column(c).combine_chunks() for c in texts.column_names} | {
            "block": np.full(n, number), "places": pa.ListArray.from_arrays(bounds, pa.array(place, pa.int32())),
            "times": pa.ListArray.from_arrays(bounds, pa.array(times, pa.int32()))}
        for a in range(0, len(grams), _BATCH):
            some = first[a:a + _BATCH]
            yield {"block": np.full(len(some), number), "gram": grams[a:a + _BATCH].view(np.int64),
                   "place": np.arange(a, a + len(some), dtype=np.int32), "reached": reached[some].astype(np.int32),
                   "base": base[some]}


def with_deeper(texts: pa.Table, logs: pa.Table) -> pa.Table:
    """The texts of a block, ``score`` with the scores of their entries; ``logs``: place and logp."""
    texts = texts.combine_chunks()
    text = np.repeat(np.arange(texts.num_rows), np.asarray(pc.list_value_length(texts.column("places"))))
    places, times = (np.asarray(pc.list_flatten(texts.column(c))) for c in ("places", "times"))
    logp = np.zeros(places.max(initial=-1) + 1)
    logp[np.asarray(logs.column("place"))] = np.asarray(logs.column("logp"))
    score = pa.array(np.asarray(texts.column("score")) + np.bincount(text, times * logp[places], texts.num_rows))
    return texts.drop_columns(["score", "block", "places", "times"]).append_column("score", score)


def score(df: DataFrame, model: Model, tables: Tables, scratch: Scratch) -> DataFrame:
    """doc_id, row_key, n_tokens, n_known, train_tokens, base_score and score of each row (doc_id and text)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select("doc_id", row_key().alias("row_key"), "text")
    id_type = df.schema["doc_id"].dataType.simpleString()
    most = tables.settings.block
    types = {"row_key": pa.int64(), "n_tokens": pa.int64(), "heavy": pa.int64(), "heavy_score": pa.float64(),
             "score": pa.float64(), "block": pa.int64(), "places": pa.list_(pa.int32()), "times": pa.list_(pa.int32()),
             "gram": pa.int64(), "place": pa.int32(), "reached": pa.int32(), "base": pa.float64()}

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, block, number, id_kind = shared.value, Block(), TaskContext.get().partitionId() << 32, None
        end_score = float(m.base_log(np.array([m.end_count]))[0])

        def handed_on() -> Iterator[pa.RecordBatch]:
            for part in block.take(number):
                size = len(part["block"])
                yield pa.record_batch({c: part[c] if c in part else pa.nulls(size, t)
                                       for c, t in ({"doc_id": id_kind} | types).items()})
        for b in B.slices(batches, "text", _SLICE):
            id_kind = b.schema.field("doc_id").type
            data = normalised(b.column("text"))
            n = len(data) - B.PAD
            h, doc = word_hashes(data, n)
            found, count = m.heavy.find(h)
            ends = np.flatnonzero(data[:n] == END)
            symbols, at, reached = walk(data, n, m.tree)
            keys, base = grams_at(data, at, ends, m.tree.depth), symbols[at - 1]
            symbols[at - 1] = 0
            texts = pa.record_batch({
                "doc_id": b.column("doc_id"), "row_key": b.column("row_key"),
                "n_tokens": np.bincount(doc, minlength=b.num_rows) + 1,
                "heavy": np.bincount(doc[found], minlength=b.num_rows) + int(m.end_count > 0),
                "heavy_score": np.bincount(doc[found], m.base_log(count[found]), minlength=b.num_rows) + end_score,
                "score": np.add.reduceat(symbols, ends[:-1])})
            block.add(texts, np.searchsorted(ends, at) - 1, keys, reached, base)
            if block.size >= most or block.rows >= _BATCH:
                yield from handed_on()
                number += 1
        if block.texts:
            yield from handed_on()

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in B.slices(batches, "text", _SLICE):
            data = normalised(b.column("text"))
            h, doc = word_hashes(data, len(data) - B.PAD)
            left = ~m.heavy.find(h)[0]
            yield pa.record_batch({"row_key": np.asarray(b.column("row_key"))[doc[left]], "key": h[left].view(np.int64)})
    both = scratch.write(rows.mapInArrow(
        scored, f"doc_id {id_type}, row_key long, n_tokens long, heavy long, heavy_score double, score double, block long, "
        "places array<int>, times array<int>, gram long, place int, reached int, base double"), "scored")
    main = both.filter("gram is null").select("doc_id", "row_key", "n_tokens", "heavy", "heavy_score", "score",
                                              "block", "places", "times")
    found = scratch.read("scored", both).filter("gram is not null").select("block", "place", "gram", "reached", "base")
    logs = scratch.write(deeper_scores(found, tables), "deeper")
    logs = found.join(logs, "gram").select("block", "place", "logp")
    main = main.groupBy("block").cogroup(logs.groupBy("block")).applyInArrow(
        with_deeper, f"doc_id {id_type}, row_key long, n_tokens long, heavy long, heavy_score double, score double")
    main = scratch.write(main, "main")
    tail = rows.select("row_key", "text").mapInArrow(rare, "row_key long, key long")
    tail = tail.join(tables.words, "key", "left").select("row_key", F.coalesce("n", F.lit(0)).alias("n"))
    base = F.log10((F.col("n") + 0.1) / F.lit(model.tokens + 0.1 * (model.distinct + 1)))
    tail = tail.groupBy("row_key").agg(F.sum(base).alias("rare_score"),
                                       F.sum((F.col("n") > 0).cast("long")).alias("rare"))
    # equal rows share their key: each has its share of the sums
    same = main.groupBy("row_key").agg(F.count(F.lit(1)).alias("same"))
    tail = tail.join(same, "row_key")
    part = lambda c, zero: F.coalesce(F.col(c) / F.col("same"), F.lit(zero))
    return main.join(tail, "row_key", "left").select(
        "doc_id", "row_key", "n_tokens", (F.col("heavy") + part("rare", 0).cast("long")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("heavy_score") + part("rare_score", 0.0)).alias("base_score"),
        "score")
