"""Token files: byte-level BPE ids, Re-Pair compressed per shard, with random access.

Texts are sorted by id over range partitions; a partition is a shard, written
in segments of about ``segment_ids`` ids (one row of a Parquet table each; a
longer document is a segment of its own). A segment holds

* its documents' ids, token counts and code counts,
* a Re-Pair grammar: in each round the most frequent pairs of neighbouring
  symbols are replaced by new symbols (left to right, without overlaps and
  within a document), until no pair is frequent or the round limit is reached.
  ``rules`` are the pairs in the order of their symbols, from ``FIRST_RULE`` on,
* ``lengths``, the number of ids that each rule expands to, and ``codes``, the
  compressed sequence, all as little-endian numbers.

A reader sums lengths over a document's codes to reach any token without
expanding what lies before it (``decode_range``).

Encoding: the tokenizer splits a text into pieces before it merges bytes, and
no piece reaches from a character that is no white space into white space. So
a text is cut before each run of white space, each distinct chunk is encoded
once per worker, and its ids are gathered for all its occurrences.

Defined cases: null texts are empty; every document ends with ``end_id``, so an
empty one is that id alone. Null ids come first, equal ids are ordered by text
hash. Repeated rows are written one by one. An empty table gives no segment.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from abode.llm import textbytes as B

#: Ids of the tokenizer lie below this; grammar symbols start here and end at 65,535.
FIRST_RULE = 50_257
_LAST_SYMBOL = 65_535
_SLICE = 8 << 20
SEGMENT = ("shard int, segment int, n_ids long, doc_ids array<{id}>, doc_tokens array<int>, doc_codes array<int>, "
           "rules binary, lengths binary, codes binary")


@dataclass(frozen=True)
class Settings:
    end_id: int = 0
    segment_ids: int = 1 << 21
    rounds: int = 8
    rules_per_round: int = 1_900
    least_pairs: int = 16
    cached_chunks: int = 1_000_000


class ChunkCache:
    """Ids of the chunks that a worker has met, by 64-bit hash; checked by length and outer bytes."""

    def __init__(self, tokenizer, most: int):
        self.tokenizer, self.most = tokenizer, most
        size = tokenizer.get_vocab_size()
        special = {i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.byte_length = np.zeros(size, np.int64)
        for token, i in tokenizer.get_vocab().items():
            self.byte_length[i] = len(token.encode()) if i in special else len(token)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.check = np.zeros((0, 3), np.uint64)
        self.first, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, ids per chunk, all ids) of distinct chunks, both in that order.

        Chunks that begin with white space and end without it are joined and
        encoded together; the lengths of the tokens tell them apart again.
        """
        white = _WHITE[data[start]] & ~_WHITE[data[end - 1]] & ~_other_space_before(data, end)
        joined, alone = np.flatnonzero(white), np.flatnonzero(~white)
        raw = data.tobytes()
        if any(t.encode() in raw for t in self.special):
            held = np.array([any(t.encode() in raw[a:z] for t in self.special) for a, z in zip(start[joined], end[joined])], bool)
            joined, alone = joined[~held], np.concatenate((alone, joined[held]))
        counts, flat = [], []
        for a in range(0, len(joined), 20_000):
            part = joined[a:a + 20_000]
            size = end[part] - start[part]
            text = data[B.ragged(start[part], size)].tobytes().decode()
            made = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            stops, ends = np.cumsum(self.byte_length[made]), np.cumsum(size)
            cut = np.searchsorted(stops, ends)
            if not np.array_equal(stops[cut], ends):
                raise ValueError("a token crosses a chunk border")
            counts.append(np.diff(cut, prepend=-1))
            flat.append(made.astype(np.uint16))
        texts = [raw[a:z].decode() for a, z in zip(start[alone].tolist(), end[alone].tolist())]
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            counts.append(np.array([len(e.ids)]))
            flat.append(np.array(e.ids, np.uint16))
        return np.concatenate((joined, alone)), np.concatenate(counts), np.concatenate(flat)

    def look_up(self, keys: np.ndarray, check: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of each distinct key; data[start:end] are the chunks."""
        if len(self.keys) + len(keys) > self.most:
            self.clear()
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~known)
        if len(new):
            order, count, flat = self.encode(data, start[new], end[new])
            new = new[order]
            all_keys = np.concatenate((self.keys, keys[new]))
            order = np.argsort(all_keys, kind="stable")
            self.keys = all_keys[order]
            self.check = np.concatenate((self.check, check[new]))[order]
            starts = len(self.flat) + np.cumsum(count) - count
            self.first = np.concatenate((self.first, starts))[order]
            self.count = np.concatenate((self.count, count))[order]
            self.flat = np.concatenate((self.flat, flat))
        at = np.searchsorted(self.keys, keys)
        if not np.array_equal(self.check[at], check):
            raise ValueError("two chunks share a 64-bit hash")
        return at


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 13, 32]] = True


def _other_space_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True where the character that ends before ``at`` is white space of Unicode beyond _WHITE."""
    p1, p2, p3 = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    return (p1 == 0x0B) | (p1 == 0x0C) | ((p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))) | \
        ((p3 == 0xE1) & (p2 == 0x9A) & (p1 == 0x80)) | ((p3 == 0xE2) & ((p2 == 0x80) | (p2 == 0x81))) | \
        ((p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80))


def chunk_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the chunks: a run of white space and what follows it up to the next run."""
    n = len(data) - B.PAD
    begins = _WHITE[data[:n]]
    begins[1:] &= ~begins[:-1].copy()
    # not after other white space, with which the run would be one
    start = np.flatnonzero(begins)
    begins[start[_other_space_before(data, start)]] = False
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    start = np.flatnonzero(begins)
    return start, np.append(start[1:], n)


def encode_texts(column: pa.Array, cache: ChunkCache, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after the other, ids per text), each text with the end id."""
    buf = B.buffer_of(column)
    data, bounds = buf.data, buf.bounds
    start, end = chunk_bounds(data, bounds)
    key = B.span_hash(data, start, end)
    view = B.eight_bytes(data)
    size = (end - start).astype(np.uint64)
    bits = np.uint64(8) * np.minimum(size, np.uint64(7))
    head = np.where(size < 8, view[start] & ((np.uint64(1) << bits) - np.uint64(1)), view[start])
    tail = np.where(size < 8, head, view[np.maximum(end - 8, start)])
    order, first, times = B.grouped(key)
    pick = order[first]
    group = np.empty(len(key), np.int64)
    group[order] = np.repeat(np.arange(len(first)), times)
    check = np.stack((size[pick], head[pick], tail[pick]), axis=1)
    if not all(np.array_equal(x, check[group, k]) for k, x in enumerate((size, head, tail))):
        raise ValueError("two chunks share a 64-bit hash")
    at = cache.look_up(key[pick], check, data, start[pick], end[pick])[group]
    # one more entry per text for its end, after its chunks
    doc = np.searchsorted(bounds, start, side="right") - 1
    n = len(bounds) - 1
    per_doc = np.bincount(doc, minlength=n)
    place = np.arange(len(start)) + doc
    last = np.cumsum(per_doc + 1) - 1
    begin, count = np.full(len(start) + n, len(cache.flat)), np.ones(len(start) + n, np.int64)
    begin[place], count[place] = cache.first[at], cache.count[at]
    ids = np.append(cache.flat, np.uint16(end_id))[B.ragged(begin, count)]
    stops = np.cumsum(count)[last]
    return ids, np.diff(stops, prepend=0)


def compress(ids: np.ndarray, doc_tokens: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, codes, codes per document) of a segment; rules are pairs of symbols."""
    seq = ids.astype(np.uint16)
    last = np.zeros(len(seq), bool)
    last[np.cumsum(doc_tokens) - 1] = True
    rules: list[np.ndarray] = []
    symbol = FIRST_RULE
    for _ in range(settings.rounds):
        room = min(settings.rules_per_round, _LAST_SYMBOL + 1 - symbol)
        if room <= 0 or len(seq) < 2:
            break
        pair = seq[:-1].astype(np.uint32) << np.uint32(16) | seq[1:]
        values, times = B.counted(pair[~last[:-1]])
        often = np.flatnonzero(times >= settings.least_pairs)
        if not len(often):
            break
        best = often[np.argsort(-times[often], kind="stable")[:room]]
        chosen = values[best]
        # one place per hash; of pairs that share one the most frequent goes first, the others in a later round
        spot = ((chosen * np.uint32(2654435761)) >> np.uint32(14)).astype(np.int64)
        _, firsts = np.unique(spot, return_index=True)
        chosen = chosen[np.sort(firsts)]
        spot = ((chosen * np.uint32(2654435761)) >> np.uint32(14)).astype(np.int64)
        table = np.full(1 << 18, -1, np.int32)
        table[spot] = np.arange(len(chosen))
        slot = table[(pair * np.uint32(2654435761)) >> np.uint32(14)]
        match = (slot >= 0) & (chosen[slot] == pair) & ~last[:-1]
        # in a run of matches every other one, from its first
        index = np.arange(len(match))
        before = np.maximum.accumulate(np.where(match, -1, index))
        at = np.flatnonzero(match & ((index - before) & 1 == 1))
        seq[at] = symbol + slot[at]
        last[at] |= last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
        rules.append(np.stack((chosen >> np.uint32(16), chosen & np.uint32(0xFFFF)), axis=1).astype(np.uint16))
        symbol += len(chosen)
    made = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint16)
    return made, seq, np.diff(np.flatnonzero(last), prepend=-1)


def rule_lengths(rules: np.ndarray) -> np.ndarray:
    """Ids that each rule expands to; a rule refers to earlier ones only."""
    lengths = np.ones(FIRST_RULE + len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        lengths[FIRST_RULE + i] = lengths[a] + lengths[b]
    return lengths[FIRST_RULE:]


def expansions(rules: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, ids): the full expansion of each rule in one array."""
    start = np.cumsum(lengths) - lengths
    flat = np.zeros(int(lengths.sum()), np.uint16)
    for i, (a, b) in enumerate(rules.tolist()):
        at = int(start[i])
        for s in (a, b):
            if s < FIRST_RULE:
                flat[at] = s
                at += 1
            else:
                k = int(lengths[s - FIRST_RULE])
                flat[at:at + k] = flat[start[s - FIRST_RULE]:start[s - FIRST_RULE] + k]
                at += k
    return start, flat


def expand(codes: np.ndarray, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids of a run of codes."""
    start, flat = expansions(rules, lengths)
    used = codes.astype(np.int64)
    rule = used >= FIRST_RULE
    number = np.where(rule, used - FIRST_RULE, 0)
    # plain ids follow the expansions in one table
    table = np.concatenate((flat, np.arange(FIRST_RULE, dtype=np.uint16)))
    if not len(lengths):
        return codes.astype(np.uint16)
    begin = np.where(rule, start[number], len(flat) + used)
    return table[B.ragged(begin, np.where(rule, lengths[number], 1))]


def decode_range(segment: dict, doc: int, first: int, stop: int) -> np.ndarray:
    """Tokens first .. stop - 1 of the segment's document number ``doc``, expanding only their codes."""
    rules = np.frombuffer(segment["rules"], "<u2").reshape(-1, 2)
    lengths = np.frombuffer(segment["lengths"], "<u4").astype(np.int64)
    per_doc = np.asarray(segment["doc_codes"], np.int64)
    a = int(per_doc[:doc].sum())
    codes = np.frombuffer(segment["codes"], "<u2")[a:a + int(per_doc[doc])]
    every = np.concatenate((np.ones(FIRST_RULE, np.int64), lengths))
    ends = np.cumsum(every[codes])
    lo, hi = int(np.searchsorted(ends, first, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
    skipped = int(ends[lo - 1]) if lo else 0
    return expand(codes[lo:hi], rules, lengths)[first - skipped:stop - skipped]


def _segment(shard: int, number: int, ids: list[np.ndarray], tokens: list[np.ndarray], doc_ids: list[pa.Array],
             settings: Settings) -> pa.RecordBatch:
    every, per_doc = np.concatenate(ids), np.concatenate(tokens)
    rules, codes, doc_codes = compress(every, per_doc, settings)
    lists = [pa.concat_arrays(doc_ids), pa.array(per_doc, pa.int32()), pa.array(doc_codes, pa.int32())]
    blobs = [rules.astype("<u2").tobytes(), rule_lengths(rules).astype("<u4").tobytes(), codes.astype("<u2").tobytes()]
    return pa.RecordBatch.from_arrays(
        [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([len(every)], pa.int64()),
         *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists],
         *[pa.array([x], pa.binary()) for x in blobs]],
        ["shard", "segment", "n_ids", "doc_ids", "doc_tokens", "doc_codes", "rules", "lengths", "codes"])


_CACHES: dict[str, ChunkCache] = {}


def _cache(path: str, most: int) -> ChunkCache:
    """The worker's cache for a tokenizer file; it serves all tasks of the worker."""
    if path not in _CACHES:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _CACHES[path] = ChunkCache(Tokenizer.from_file(path), most)
    return _CACHES[path]


def write_token_files(df: DataFrame, tokenizer_path: str, path: str, settings: Settings = Settings()) -> None:
    """Encode doc_id and text of ``df`` into compressed segments at ``path``."""
    id_type = df.schema["doc_id"].dataType.simpleString()
    order = ["doc_id", "text_hash"]
    rows = df.select("doc_id", F.xxhash64("text").alias("text_hash"), "text") \
        .repartitionByRange(*order).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, total = TaskContext.get().partitionId(), 0, 0
        cache = _cache(tokenizer_path, settings.cached_chunks)
        ids, tokens, docs = [], [], []
        for b in B.slices(batches, "text", _SLICE):
            made, per_doc = encode_texts(b.column("text"), cache, settings.end_id)
            stops = np.cumsum(per_doc)
            a = 0
            while a < len(per_doc):
                done = int(stops[a - 1]) if a else 0
                z = int(np.searchsorted(stops, done + settings.segment_ids - total, side="right"))
                z = max(z, a + (not total))
                if z > a:
                    ids.append(made[done:int(stops[z - 1])])
                    tokens.append(per_doc[a:z])
                    docs.append(b.column("doc_id").slice(a, z - a))
                    total += int(stops[z - 1]) - done
                    a = z
                if a < len(per_doc):
                    yield _segment(shard, number, ids, tokens, docs, settings)
                    ids, tokens, docs, total, number = [], [], [], 0, number + 1
        if tokens:
            yield _segment(shard, number, ids, tokens, docs, settings)
    rows.select("doc_id", "text").mapInArrow(encode, SEGMENT.format(id=id_type)).write.mode("overwrite").parquet(path)


def read_segments(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The segments with ``first``, the number of ids in all segments before each."""
    segments = spark.read.schema(SEGMENT.format(id=id_type)).parquet(path)
    # one row per shard reaches the global window, one per segment that of its shard
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_first"))
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    places = segments.select("shard", "segment", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("place"))
    places = places.join(shards, "shard").select("shard", "segment", (F.col("place") + F.col("shard_first")).alias("first"))
    return segments.join(places, ["shard", "segment"])


def decoded_documents(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from its codes; ``ids`` too if wanted."""
    id_type = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                s = {c: b.column(c)[k] for c in b.schema.names}
                rules = np.frombuffer(s["rules"].as_py(), "<u2").reshape(-1, 2)
                lengths = np.frombuffer(s["lengths"].as_py(), "<u4").astype(np.int64)
                ids = expand(np.frombuffer(s["codes"].as_py(), "<u2"), rules, lengths).astype("<u4")
                tokens = np.asarray(s["doc_tokens"].values, np.int64)
                stops = np.cumsum(tokens)
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * a:4 * z]) for a, z in zip((stops - tokens).tolist(), stops.tolist())]
                columns = [s["doc_ids"].values, pa.array(s["first"].as_py() + stops - tokens), pa.array(tokens),
                           pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    offsets = pa.array(np.concatenate(([0], stops)), pa.int32())
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
    more = ", ids array<int>" if with_ids else ""
    return segments.mapInArrow(decode, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long{more}")
