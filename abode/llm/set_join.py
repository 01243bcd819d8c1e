"""Benchmark decontamination by a prefix-filtered set join.

Records are the windows of ten words of each benchmark item (an item of fewer
words is one window) and the texts. A text contains a window exactly where all
its words follow one another, so for containment the necessary prefix of a
window in rarity order is its rarest word: a text without that word cannot hold
the window. Rarity is how often a word occurs in all texts, ties by the word.

1. Count the benchmark's words in all texts.
2. Order each window's words by rarity and index the windows by their prefix word.
3. At each occurrence of a prefix word, the window's offset gives the only
   place where it can lie (positional bound); the place must be inside the
   text (length bound).
4. Verify the candidates word by word.

The index is broadcast in blocks of about ``block_words`` window words (an item is never
split). A benchmark of one block is searched in one pass over the texts. A larger one takes a
pass per block, which writes the hits of the texts that have any; a task never holds
more than one block. The hits are then united by the text's md5 and joined to the texts.

Defined cases: null texts have no words and hold nothing, null items have no
windows. Repeated items and repeated rows count like any other; an item id with
several texts has the windows of all of them, a null id is named 'null'.
Without benchmark rows nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abode.llm import textbytes as B
from abode.llm.common import Scratch

WINDOW = 10
BLOCK_WORDS = 2_000_000
_SLICE = 8 << 20


def words_of(column: pa.Array) -> tuple[np.ndarray, B.Words, int]:
    """Lower-cased bytes, their words, and the number of texts."""
    buf = B.buffer_of(column)
    data = B.byte_table(B.letters_and_digits(), lower=True)[buf.data]
    return data, B.find_words(data[:-B.PAD] != 0, buf.bounds), len(buf.bounds) - 1


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item, tokens``: each distinct window of each item, as arrays of words."""
    # the same words as ``words_of``; only ASCII letters change case
    low = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    all_words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
                             tokens.alias("t")).filter(F.size("t") > 0)
    last = F.greatest(F.size("t") - window, F.lit(0))
    return all_words.withColumn("i", F.explode(F.sequence(F.lit(0), last))) \
        .select("item", F.slice("t", F.col("i") + 1, window).alias("tokens")).distinct()


@dataclass
class Index:
    """Windows of one block: words by hash, grouped by prefix word."""

    prefix: np.ndarray   # distinct hashes of prefix words, ascending
    first: np.ndarray    # first window of each prefix word
    count: np.ndarray    # its number of windows
    offset: np.ndarray   # place of the prefix word in each window
    length: np.ndarray   # words of each window
    window: np.ndarray   # (windows, WINDOW) word numbers, -1 beyond the length
    item: np.ndarray     # item number of each window
    items: list[str]
    vocabulary: list[bytes]
    hashes: np.ndarray   # of the vocabulary, ascending


def _hash_words(texts: list[bytes]) -> np.ndarray:
    made = B.buffer_of(pa.array(texts, pa.binary()))
    return B.span_hash(made.data, made.bounds[:-1], made.bounds[1:])


def build_index(rows: list[tuple[str, list[str]]], frequency: dict[str, int]) -> Index:
    """Index of a block of windows; the prefix word is the rarest, the first of equal words."""
    vocabulary = sorted({w.encode() for _, ws in rows for w in ws})
    h = _hash_words(vocabulary)
    by_hash = np.argsort(h, kind="stable")
    vocabulary = [vocabulary[i] for i in by_hash]
    number = {w: i for i, w in enumerate(vocabulary)}
    names = sorted({i for i, _ in rows})
    item_number = {i: k for k, i in enumerate(names)}
    made = []
    for item, ws in rows:
        at = min(range(len(ws)), key=lambda k: (frequency.get(ws[k], 0), ws[k], k))
        made.append((number[ws[at].encode()], at, [number[w.encode()] for w in ws], item_number[item]))
    made.sort(key=lambda x: (x[0], x[1], x[2], x[3]))
    prefix = np.array([x[0] for x in made], np.int64)
    first = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
    window = np.full((len(made), max(len(x[2]) for x in made)), -1, np.int64)
    for k, x in enumerate(made):
        window[k, :len(x[2])] = x[2]
    return Index(h[by_hash][prefix[first]], first, np.diff(np.append(first, len(made))),
                 np.array([x[1] for x in made]), np.array([len(x[2]) for x in made]), window,
                 np.array([x[3] for x in made]), names, vocabulary, h[by_hash])


def _numbers(data: np.ndarray, w: B.Words, vocabulary: list[bytes], hashes: np.ndarray) -> np.ndarray:
    """Vocabulary number of each word, -1 for others; equal hashes are checked byte by byte."""
    h = B.span_hash(data, w.start, w.end)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    number = np.where(hashes[at] == h, at, -1)
    found = np.flatnonzero(number >= 0)
    sizes = np.array([len(v) for v in vocabulary])
    starts = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(vocabulary) or b"\0", np.uint8)
    k = number[found]
    size = w.end[found] - w.start[found]
    wrong = size != sizes[k]
    ok = np.flatnonzero(~wrong)
    differs = data[B.ragged(w.start[found[ok]], size[ok])] != flat[B.ragged(starts[k[ok]], size[ok])]
    rows = np.repeat(ok, size[ok])[differs]
    wrong[rows] = True
    number[found[wrong]] = -1
    return number


def find_windows(number: np.ndarray, doc: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(window, first word) of each occurrence in the texts of a slice."""
    key = np.where(number >= 0, index.hashes[np.maximum(number, 0)], 0)
    slot = np.minimum(np.searchsorted(index.prefix, key), len(index.prefix) - 1)
    at = np.flatnonzero((number >= 0) & (index.prefix[slot] == key))
    slot = slot[at]
    window = B.ragged(index.first[slot], index.count[slot])
    start = np.repeat(at, index.count[slot]) - index.offset[window]
    stop = start + index.length[window]
    inside = (start >= 0) & (stop <= len(number))
    window, start, stop = window[inside], start[inside], stop[inside]
    inside = doc[start] == doc[stop - 1]
    window, start = window[inside], start[inside]
    for k in range(index.window.shape[1]):
        want = index.window[window, k]
        have = number[np.minimum(start + k, len(number) - 1)]
        same = (want < 0) | (want == have)
        window, start = window[same], start[same]
    return window, start


def word_frequency(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """How often each benchmark word occurs in all texts: ``word, n``."""
    wanted = windows.select(F.explode("tokens").alias("word")).distinct()
    out = None
    for block in _blocks(wanted.withColumn("n", F.lit(1)), "word", BLOCK_WORDS):
        vocabulary = sorted(r["word"].encode() for r in block.collect())
        h = _hash_words(vocabulary)
        order = np.argsort(h, kind="stable")
        shared = docs.sparkSession.sparkContext.broadcast(([vocabulary[i] for i in order], h[order]))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, hashes = shared.value
            total = np.zeros(len(names), np.int64)
            for b in B.slices(batches, "text", _SLICE):
                data, w, _ = words_of(b.column("text"))
                number = _numbers(data, w, names, hashes)
                total += np.bincount(number[number >= 0], minlength=len(names))
            seen = np.flatnonzero(total)
            yield pa.record_batch({"word": pa.array([names[i].decode() for i in seen], pa.string()),
                                   "n": pa.array(total[seen])})
        counts = docs.select("text").mapInArrow(count, "word string, n long")
        out = counts if out is None else out.unionByName(counts)
    if out is None:
        return docs.sparkSession.createDataFrame([], "word string, n long")
    return out.groupBy("word").agg(F.sum("n").alias("n"))


def _blocks(df: DataFrame, key: str, most: int) -> Iterator[DataFrame]:
    """``df`` (with its row sizes in column n) in parts of about ``most``, dealt by a hash of the key."""
    total = df.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    parts = -(-total // most)
    for k in range(parts):
        yield df.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == k)


_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))
_HITS = "spans array<struct<first:int,stop:int>>, items array<string>"


def mark_hits(data: np.ndarray, w: B.Words, index: Index, change: np.ndarray, found: list[set[str]]) -> None:
    """Adds the block's windows to ``change`` (by word: windows that start less those that have ended) and their items to ``found``."""
    if not len(w.doc):
        return
    number = _numbers(data, w, index.vocabulary, index.hashes)
    which, start = find_windows(number, w.doc, index)
    np.add.at(change, start, 1)
    np.add.at(change, start + index.length[which], -1)
    for d, i in set(zip(w.doc[start].tolist(), index.item[which].tolist())):
        found[d].add(index.items[i])


def hit_columns(w: B.Words, n: int, change: np.ndarray, found: list[set[str]]) -> dict[str, pa.Array]:
    """n_words, n_hit, spans and items of each text of a slice."""
    hit = np.cumsum(change)[:-1] > 0
    first_word = np.searchsorted(w.doc, np.arange(n))
    runs = B.find_words(hit, np.append(first_word, len(hit)))
    spans: list[list[dict[str, int]]] = [[] for _ in range(n)]
    for d, a, z in zip(runs.doc.tolist(), runs.start.tolist(), runs.end.tolist()):
        spans[d].append({"first": a - int(first_word[d]), "stop": z - int(first_word[d])})
    return {"n_words": pa.array(np.bincount(w.doc, minlength=n)), "n_hit": pa.array(np.bincount(w.doc[hit], minlength=n)),
            "spans": pa.array(spans, _SPANS), "items": pa.array([sorted(f) for f in found], pa.list_(pa.string()))}


def block_hits(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """``text_key, spans, items`` of each different text that holds windows of one block."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.slices(batches, "text", _SLICE):
            data, w, n = words_of(b.column("text"))
            change, found = np.zeros(len(w.doc) + 1, np.int32), [set() for _ in range(n)]
            mark_hits(data, w, shared.value, change, found)
            made = hit_columns(w, n, change, found)
            rows = pa.RecordBatch.from_pydict({"text_key": b.column("text_key"), "spans": made["spans"], "items": made["items"]})
            yield rows.filter(pc.greater(made["n_hit"], 0))
    hits = docs.select(F.md5("text").alias("text_key"), "text").mapInArrow(search, f"text_key string, {_HITS}")
    return hits.groupBy("text_key").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))


def contaminated_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                       block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, n_hit, spans (first and end word of each run of hit words) and items."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "set-join")
    windows = scratch.write(item_windows(items, window), "windows")
    frequency = scratch.write(word_frequency(docs, windows), "frequency")
    blocks = list(_blocks(windows.withColumn("n", F.size("tokens")), "item", block_words))

    def index_of(block: DataFrame) -> Broadcast | None:
        rows = [(r["item"], list(r["tokens"])) for r in block.select("item", "tokens").collect()]
        used = block.select(F.explode("tokens").alias("word")).distinct()
        counts = {r["word"]: r["n"] for r in frequency.join(used, "word").collect()}
        return spark.sparkContext.broadcast(build_index(rows, counts)) if rows else None
    names = ["n_words", "n_hit", "spans", "items"]
    docs = docs.drop(*names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    types = f"{fields}, n_words long, n_hit long, {_HITS}"
    columns = docs.columns

    def with_hits(b: pa.RecordBatch, w: B.Words, change: np.ndarray, found: list[set[str]]) -> pa.RecordBatch:
        made = hit_columns(w, b.num_rows, change, found)
        return pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], *[made[c] for c in names]], [*columns, *names])

    if len(blocks) <= 1:
        shared = index_of(blocks[0]) if blocks else None

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in B.slices(batches, "text", _SLICE):
                data, w, n = words_of(b.column("text"))
                change, found = np.zeros(len(w.doc) + 1, np.int32), [set() for _ in range(n)]
                if shared is not None:
                    mark_hits(data, w, shared.value, change, found)
                yield with_hits(b, w, change, found)
        return docs.mapInArrow(search, types)

    hits = None
    for k, block in enumerate(blocks):
        shared = index_of(block)
        if shared is not None:
            one = scratch.write(block_hits(docs, shared), f"hits-{k}")
            shared.destroy()
            hits = one if hits is None else hits.unionByName(one)
    key, spans, held = (_free(docs, c) for c in ("text_key", "text_spans", "text_items"))
    hits = hits.groupBy(F.col("text_key").alias(key)).agg(  # one row at most per text and block
        F.flatten(F.collect_list("spans")).alias(spans), F.array_distinct(F.flatten(F.collect_list("items"))).alias(held))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.slices(batches, "text", _SLICE):
            _, w, n = words_of(b.column("text"))
            first_word = np.searchsorted(w.doc, np.arange(n))
            change = np.zeros(len(w.doc) + 1, np.int32)
            for d, runs in enumerate(b.column(spans).to_pylist()):
                for run in runs or ():
                    change[first_word[d] + run["first"]] += 1
                    change[first_word[d] + run["stop"]] -= 1
            yield with_hits(b, w, change, [set(x or ()) for x in b.column(held).to_pylist()])
    return docs.withColumn(key, F.md5("text")).join(hits, key, "left").mapInArrow(unite, types)


def _free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
