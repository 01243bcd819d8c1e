"""Near-duplicate classes by order MinHash, verified by banded alignment.

Words are runs of letters and digits (and all characters beyond ASCII),
A-Z lower-cased; a text's shingles are its runs of five words, a shorter text
is one shingle. Repeated shingles are told apart by their occurrence number.

Sketch: each of ``tables`` random orders picks the ``picks`` least labelled
shingles of a text; they stay in text order, and their sequence is the bucket
key. Two texts meet in a bucket only if they share those shingles in the same
order, which is what makes the sketch sensitive to edits and moves.

Candidates: texts of equal words are one node, so copies meet nothing twice.
First each node is compared with one leader, that node of its buckets which has
most company over all tables (the original among its near copies). Then, in
rounds, each bucket that holds several classes draws a leader anew, and each node
of another class is compared with one of the leaders of its buckets. After each
round the linked classes are merged, and one link per pair of classes is kept.
The rounds end when one finds few new links. The pairs of the rounds are linear
in the nodes. Buckets of at most ``small`` nodes that are still mixed then compare
all their nodes of different classes.

What is left: nodes of larger buckets that still hold several classes are joined
by prefix filter. c / (m + n - c) of 0.8 or more needs that share of labelled
shingles in common, so two such texts share one of the first of them in any
common order; the order puts rare ones first. Bounds on the lengths and on the
number of differing shingles (the differing bits of two parity bitmaps are never
more) drop pairs that cannot reach 0.8; all other pairs of different classes are
verified. A pair counts at the first prefix shingle that both have: there all
earlier ones differ, which the bound adds to the bits of the others, so later
shared shingles make few further rows of it. So no pair of 0.8 or more that shares a bucket is left out, however
large the bucket.

Verification: two shingle sequences of lengths m and n with c shingles aligned
in order have similarity c / (m + n - c); 0.8 or more links them. The longest
common subsequence is found by bit-parallel alignment within the band that any
such alignment must lie in. Linked nodes form classes (connected components).

Defined cases: a null or empty text is a class of its own. Texts without any
word are copies only if equal. Repeated rows are copies of each other. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abode.llm import textbytes as B
from abode.llm.common import Scratch, row_key
from abode.llm.components import merged_classes
from abode.llm.set_join import words_of


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    picks: int = 4
    tables: int = 32
    similarity: float = 0.8
    small: int = 32
    few_links: int = 20         # rounds end at one new link per so many mixed buckets
    cells: int = 1 << 18    # counters of the shingles' frequencies: only the order of a prefix depends on them
    flags: int = 1 << 24    # 2 MB: cells of prefix tokens that two classes have; what shares one is told apart by exact keys
    seed: int = 20240229


_MIX = np.uint64(0xFF51AFD7ED558CCD)
_FOLD = np.uint64(33)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _FOLD)) * _MIX
    return h ^ (h >> _FOLD)


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words, from the words' hashes."""
    if not len(h):
        return h
    size = min(size, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - size + 1 + k])
    return out


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingle hashes mixed with their occurrence number in the text."""
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    if first.all():
        return s
    start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    number = np.empty(len(s), np.uint64)
    number[order] = (np.arange(len(s)) - start).astype(np.uint64)
    return np.where(number > 0, _mix(s + number * np.uint64(0xC2B2AE3D27D4EB4F)), s)


def multipliers(settings: Settings) -> np.ndarray:
    rng = np.random.default_rng(settings.seed)
    return rng.integers(1, 1 << 63, settings.tables, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(s: np.ndarray, factors: np.ndarray, picks: int) -> np.ndarray:
    """One bucket key per table: the least labelled shingles, in text order."""
    l = labelled(s)
    picks = min(picks, len(l))
    keys = np.empty(len(factors), np.uint64)
    step = max(1, (1 << 20) // max(len(l), 1))
    for a in range(0, len(factors), step):
        f = factors[a:a + step]
        ranks = _mix(l[None, :] * f[:, None])
        at = np.argpartition(ranks, picks - 1, axis=1)[:, :picks] if picks < len(l) else \
            np.broadcast_to(np.arange(picks), (len(f), picks))
        chosen = l[np.sort(at, axis=1)]
        key = f.copy()
        for k in range(picks):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + chosen[:, k])
        keys[a:a + step] = key
    return keys


def _digest(data: bytes, kind: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, person=kind).digest(), "little", signed=True)


def sketches(df: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, row_key, node (64-bit hash of the word sequence) and bucket keys of each row."""
    factors = multipliers(settings)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.slices(batches, "text", 8 << 20):
            buf = B.buffer_of(b.column("text"))
            data, w, n = words_of(b.column("text"))
            h = B.span_hash(data, w.start, w.end)
            cut = np.searchsorted(w.doc, np.arange(n + 1))
            node: list[int | None] = []
            keys: list[np.ndarray | None] = []
            for i in range(n):
                mine = h[cut[i]:cut[i + 1]]
                if len(mine):
                    node.append(_digest(mine.tobytes(), b"words"))
                    keys.append(sketch(shingles(mine, settings.shingle), factors, settings.picks).view(np.int64))
                else:
                    raw = buf.data[buf.bounds[i]:buf.bounds[i + 1]].tobytes()
                    node.append(_digest(raw, b"raw") if raw else None)
                    keys.append(None)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "row_key": b.column("row_key"),
                                   "node": pa.array(node, pa.int64()), "keys": pa.array(keys, pa.list_(pa.int64()))})
    id_type = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", row_key().alias("row_key"), "text") \
        .mapInArrow(made, f"doc_id {id_type}, row_key long, node long, keys array<long>")


def aligned(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Length of the longest common subsequence if it is at least ``least``, else any smaller number."""
    total_a, total_b = len(a), len(b)
    if min(total_a, total_b) < least:
        return 0
    same = a[:min(len(a), len(b))] == b[:min(len(a), len(b))]
    head = len(same) if same.all() else int(np.argmin(same))
    a, b = a[head:], b[head:]
    k = min(len(a), len(b))
    same = a[len(a) - k:][::-1] == b[len(b) - k:][::-1]
    tail = k if same.all() else int(np.argmin(same))
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    need = least - head - tail
    if not len(a) or not len(b) or len(np.intersect1d(a, b)) == 0:
        return head + tail
    # a match off the diagonal by more than this leaves too few others
    band = max(total_a, total_b) - least
    if need > 0:
        values_a, count_a = B.counted(a)
        values_b, count_b = B.counted(b)
        _, x, y = np.intersect1d(values_a, values_b, return_indices=True)
        if np.minimum(count_a[x], count_b[y]).sum() < need:
            return 0
    masks: dict[int, int] = {}
    for i, value in enumerate(a.tolist()):
        masks[value] = masks.get(value, 0) | 1 << i
    full = (1 << len(a)) - 1
    window = (1 << (2 * band + 1)) - 1
    row = full
    for j, value in enumerate(b.tolist()):
        m = masks.get(value)
        if m is None:
            continue
        m &= window << (j - band) if j >= band else window >> (band - j)
        u = row & m
        row = ((row + u) | (row - u)) & full
    return head + tail + len(a) - row.bit_count()


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """True if the aligned shingles c satisfy c / (m + n - c) >= similarity."""
    both = len(a) + len(b)
    least = int(np.ceil(similarity * both / (1 + similarity) - 1e-9))
    return aligned(a, b, least) >= least


def shingle_table(df: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """``node, seq``: the shingle sequence of one text of each wanted node, 4 bytes a shingle.

    ``nodes``: node and row_key of one of its rows.
    """
    texts = df.select(row_key().alias("row_key"), "text").join(nodes, "row_key").select("node", "text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.slices(batches, "text", 8 << 20):
            data, w, n = words_of(b.column("text"))
            h = B.span_hash(data, w.start, w.end)
            cut = np.searchsorted(w.doc, np.arange(n + 1))
            seq = [(shingles(h[cut[i]:cut[i + 1]], settings.shingle) >> np.uint64(32)).astype("<u4").tobytes()
                   for i in range(n)]
            yield pa.record_batch({"node": b.column("node"), "seq": pa.array(seq, pa.binary())})
    return texts.mapInArrow(made, "node long, seq binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, table: DataFrame, settings: Settings) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sequences align."""
    left = table.select(F.col("node").alias("a"), F.col("seq").alias("seq_a"))
    right = table.select(F.col("node").alias("b"), F.col("seq").alias("seq_b"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), settings.similarity)
                    for x, y in zip(batch.column("seq_a").to_pylist(), batch.column("seq_b").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "seq_a", "seq_b") \
        .mapInArrow(keep, "a long, b long")


#: 64-bit words of a text's parity bitmap.
_BITMAP = 16


def numbered(s: np.ndarray) -> np.ndarray:
    """Distinct 64-bit tokens of 32-bit shingles: the shingle, and above it its occurrence number in the text."""
    order = np.argsort(s, kind="stable")
    ranked = s[order].astype(np.uint64)
    at = np.arange(len(s))
    start = np.maximum.accumulate(np.where(np.concatenate(([True], ranked[1:] != ranked[:-1])), at, 0))
    return ranked | (at - start).astype(np.uint64) << np.uint64(32)


def _bit(tokens: np.ndarray) -> np.ndarray:
    return (_mix(tokens) % np.uint64(64 * _BITMAP)).astype(np.int64)


def parity_bitmap(tokens: np.ndarray) -> np.ndarray:
    """Two bitmaps differ in at most as many bits as their token sets in tokens."""
    bits = np.bincount(_bit(tokens), minlength=64 * _BITMAP) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def prefix_length(size: int, similarity: float) -> int:
    """So many first tokens of ``size`` hold one of any other set that reaches ``similarity``."""
    return size - int(np.ceil(similarity * size - 1e-6)) + 1


def _cell(tokens: np.ndarray, cells: int) -> np.ndarray:
    return (_mix(tokens ^ _MIX) % np.uint64(cells)).astype(np.int64)


#: Cells that go into one row of a task's counts and of its marks.
_STRETCH, _CHUNK = 1 << 9, 1 << 12


def _frequencies(sequences: DataFrame, settings: Settings) -> np.ndarray:
    """How many tokens of all sequences fall into each cell. A task makes a row per stretch of cells, not per token or cell."""
    stretch = min(settings.cells, _STRETCH)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(settings.cells, np.int64)
        for batch in batches:
            for x in batch.column("seq").to_pylist():
                np.add.at(total, _cell(numbered(np.frombuffer(x, "<u4")), settings.cells), 1)
        parts = total.reshape(-1, stretch)
        used = np.flatnonzero(parts.any(1))
        yield pa.record_batch({"part": pa.array(used), "counts": pa.array([x.tobytes() for x in parts[used]], pa.binary())})

    def summed(table: pa.Table) -> pa.Table:
        total = np.zeros(stretch, np.int64)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(x, np.int64)
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})
    found = sequences.select("seq").mapInArrow(counted, "part long, counts binary") \
        .groupBy("part").applyInArrow(summed, "part long, counts binary").toArrow()
    out = np.zeros((settings.cells // stretch, stretch), np.int64)
    for part, counts in zip(found.column("part").to_pylist(), found.column("counts").to_pylist()):
        out[part] = np.frombuffer(counts, np.int64)
    return out.ravel()


def _met_flags(prefixes: DataFrame, settings: Settings) -> np.ndarray:
    """Packed flags (their number fixed by ``flags``) of the cells where a ``few`` node may meet one of another class.

    Each task marks the cells of its prefixes' tokens, those of two classes, and
    those of ``few`` nodes; the tasks' marks are united by stretches of cells. A
    cell that two tasks mark counts as one of two classes.
    """
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, rare = (np.zeros(settings.flags, bool) for _ in range(3))
        for batch in batches:
            firsts = batch.column("firsts")
            cell = _cell(np.asarray(firsts.flatten()).astype(np.int64).view(np.uint64), settings.flags)
            size = np.asarray(firsts.value_lengths())
            label = np.repeat(np.asarray(batch.column("label")), size)
            rare[cell[np.repeat(np.asarray(batch.column("few")), size)]] = True
            order = np.lexsort((label, cell))
            cell, label = cell[order], label[order]
            new = np.ones(len(cell), bool)
            new[1:] = cell[1:] != cell[:-1]
            twice[cell[1:][~new[1:] & (label[1:] != label[:-1])]] = True
            cell = cell[new]
            twice[cell[once[cell]]] = True
            once[cell] = True
        bits = [np.packbits(x).reshape(-1, _CHUNK // 8) for x in (once, twice, rare)]
        used = np.flatnonzero(bits[0].any(1))
        yield pa.record_batch({"chunk": pa.array(used), **{
            name: pa.array([row.tobytes() for row in x[used]], pa.binary()) for name, x in zip(("once", "twice", "rare"), bits)}})

    def united(table: pa.Table) -> pa.Table:
        once, twice, rare = (np.zeros(_CHUNK // 8, np.uint8) for _ in range(3))
        for o, t, r in zip(*(table.column(c).to_pylist() for c in ("once", "twice", "rare"))):
            o, t, r = (np.frombuffer(x, np.uint8) for x in (o, t, r))
            twice |= t | once & o
            once |= o
            rare |= r
        return pa.table({"chunk": table.column("chunk")[:1], "flags": pa.array([(twice & rare).tobytes()], pa.binary())})
    found = prefixes.select("label", "few", "firsts").mapInArrow(made, "chunk long, once binary, twice binary, rare binary") \
        .groupBy("chunk").applyInArrow(united, "chunk long, flags binary").toArrow()
    out = np.zeros((settings.flags // _CHUNK, _CHUNK // 8), np.uint8)
    for chunk, flags in zip(found.column("chunk").to_pylist(), found.column("flags").to_pylist()):
        out[chunk] = np.frombuffer(flags, np.uint8)
    return out.ravel()


def _meeting(prefixes: DataFrame, flags: np.ndarray, settings: Settings) -> DataFrame:
    """``prefixes`` with only those tokens that fall into a flagged cell."""
    shared = prefixes.sparkSession.sparkContext.broadcast(flags)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts = batch.column("firsts")
            tokens, size = np.asarray(firsts.flatten()).astype(np.int64), np.asarray(firsts.value_lengths())
            cell = _cell(tokens.view(np.uint64), settings.flags)
            good = shared.value[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1 == 1
            row = np.repeat(np.arange(batch.num_rows), size)[good]
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            at = batch.schema.get_field_index("firsts")
            yield batch.set_column(at, "firsts", pa.ListArray.from_arrays(ends, pa.array(tokens[good])))
    return prefixes.mapInArrow(made, prefixes.schema)


#: Rows that a task makes of its prefixes at once.
_PLACES = 1 << 13


def _placed(prefixes: DataFrame) -> DataFrame:
    """A row for each token of ``firsts``: the token, how many of ``firsts`` come before it, and the parity bitmap of
    all tokens of the text but those."""
    bits = [f"bits_{k}" for k in range(_BITMAP)]
    kept = ["node", "label", "size"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts = batch.column("firsts")
            tokens, size = np.asarray(firsts.flatten()).astype(np.int64), np.asarray(firsts.value_lengths())
            row = np.repeat(np.arange(batch.num_rows), size)
            before = np.arange(len(tokens)) - np.searchsorted(row, row)
            whole = np.stack([np.asarray(batch.column(name)) for name in bits], 1).view(np.uint8)
            at = _bit(tokens.view(np.uint64))
            byte, change = at >> 3, (128 >> (at & 7)).astype(np.uint8)
            now = np.zeros(whole.shape[1], np.uint8)
            for a in range(0, len(tokens), _PLACES):
                z = min(a + _PLACES, len(tokens))
                maps = np.empty((z - a, whole.shape[1]), np.uint8)
                for i in range(a, z):
                    if before[i] == 0:
                        now[:] = whole[row[i]]
                    maps[i - a] = now
                    now[byte[i]] ^= change[i]
                words = maps.view(np.int64)
                yield pa.record_batch({
                    **{name: batch.column(name).take(pa.array(row[a:z])) for name in kept},
                    **{name: pa.array(words[:, k]) for k, name in enumerate(bits)},
                    "token": pa.array(tokens[a:z]), "before": pa.array(before[a:z])})
    return prefixes.mapInArrow(made, ", ".join(f"{name} long" for name in [*kept, *bits, "token", "before"]))


def _met(places: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b) of nodes of different labels that share a token and may be similar.

    ``places``: as ``_placed`` makes them, with the most frequent label of the
    token (``top``). At the first token of two nodes all tokens before it are of
    one of them alone; so a similar pair meets the bound there, if not at others.
    """
    columns = [c for c in places.columns if c not in ("token", "top")]
    few = places.filter("label <> top").select("token", *[F.col(c).alias(f"x_{c}") for c in columns])
    others = places.select("token", "top", *[F.col(c).alias(f"y_{c}") for c in columns])
    # the same bound as in ``similar``
    both = F.col("x_size") + F.col("y_size")
    least = F.ceil(F.lit(settings.similarity) * both / F.lit(1 + settings.similarity) - F.lit(1e-9))
    differing = sum((F.bit_count(F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}"))) for c in columns if c.startswith("bits_")),
                    F.col("x_before") + F.col("y_before"))
    return few.join(others, "token").filter(F.col("x_label") != F.col("y_label")) \
        .filter((F.col("y_label") == F.col("top")) | (F.col("x_label") < F.col("y_label"))) \
        .filter(F.least("x_size", "y_size") >= least).filter(differing <= both - 2 * least) \
        .select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))


def remaining_pairs(left: DataFrame, table: DataFrame, scratch: Scratch, settings: Settings) -> DataFrame:
    """Pairs (a, b) of the nodes ``left`` (node, label, few) with different labels that may be similar; none that is gets lost.

    ``few``: true for nodes outside the most frequent class of a bucket. Of two
    nodes of different classes in a bucket one is; so tokens that no such node
    has in its prefix make no row.
    """
    sequences = scratch.write(table.join(left, "node"), "open-sequences")
    frequency = left.sparkSession.sparkContext.broadcast(_frequencies(sequences, settings))
    bits = [f"bits_{k}" for k in range(_BITMAP)]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, firsts, maps = [], [], []
            for x in batch.column("seq").to_pylist():
                tokens = numbered(np.frombuffer(x, "<u4"))
                order = np.lexsort((tokens, frequency.value[_cell(tokens, settings.cells)]))
                sizes.append(len(tokens))
                firsts.append(tokens[order[:prefix_length(len(tokens), settings.similarity)]].view(np.int64))
                maps.append(parity_bitmap(tokens))
            words = np.array(maps, np.int64).reshape(-1, _BITMAP)
            yield pa.record_batch({"node": batch.column("node"), "label": batch.column("label"), "few": batch.column("few"),
                                   "size": pa.array(sizes, pa.int64()),
                                   **{name: pa.array(words[:, k]) for k, name in enumerate(bits)},
                                   "firsts": pa.array(firsts, pa.list_(pa.int64()))})
    columns = ", ".join(f"{name} long" for name in ["size", *bits])
    prefixes = scratch.write(sequences.mapInArrow(made, f"node long, label long, few boolean, {columns}, firsts array<long>"), "prefixes")
    prefixes = scratch.write(_meeting(prefixes, _met_flags(prefixes, settings), settings).filter(F.size("firsts") > 0), "meeting")
    # of two nodes of different classes one is not in the token's most frequent class
    shared = prefixes.select("label", F.explode("firsts").alias("token")).groupBy("token", "label").agg(F.count(F.lit(1)).alias("n")) \
        .groupBy("token").agg(F.max(F.struct("n", "label"))["label"].alias("top"), F.count(F.lit(1)).alias("classes")) \
        .filter("classes > 1").select("token", "top")
    shared = scratch.write(shared, "tokens")
    places = scratch.write(_placed(prefixes).join(shared, "token"), "token-places")
    return scratch.write(_met(places, settings).distinct(), "remaining")


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _class_links(pairs: DataFrame, table: DataFrame, classes: DataFrame, scratch: Scratch, settings: Settings, name: str) -> DataFrame:
    """One link (a, b) per pair of classes that one of the node pairs joins: a class of k nodes keeps k - 1 links over all rounds."""
    good = scratch.write(verified(pairs, table, settings), f"{name}-pairs")
    of_a = classes.select(F.col("node").alias("a"), F.col("label").alias("x"))
    of_b = classes.select(F.col("node").alias("b"), F.col("label").alias("y"))
    return scratch.write(_ordered(good.join(of_a, "a").join(of_b, "b").filter("x <> y"), "x", "y"), name)


def near_duplicate_classes(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, row_key, label, class_id and class_docs of each row of ``df`` (needs doc_id and text).

    class_id is the least doc_id of the class; label, a hash, names the class
    (null for null and empty texts).
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "order-minhash")
    rows = scratch.write(sketches(df, settings), "rows")
    places = rows.select("node", F.explode("keys").alias("key"))
    # buckets with at least two nodes; the others have nothing to compare
    shared = places.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")) \
        .filter("lo < hi").select("key")
    # written tables: a join that shuffles both sides can be split where one key holds many rows
    shared = scratch.write(shared, "shared")
    members = scratch.write(places.join(shared, "key").distinct(), "members")
    members = members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    # company: nodes met over all tables; the hub of a group of near copies has most
    company = scratch.write(members.groupBy("node").agg(F.sum("n").alias("company")), "company")
    wanted = rows.filter("keys is not null").groupBy("node").agg(F.min("row_key").alias("row_key")) \
        .join(company.select("node"), "node", "left_semi")
    table = scratch.write(shingle_table(df, wanted, settings), "shingles")
    leaders = members.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node")).alias("leader"))
    first = members.join(leaders, "key").filter("node <> leader.node").groupBy("node").agg(F.max("leader")["node"].alias("leader"))
    classes = scratch.write(company.select("node", F.col("node").alias("label")), "start")
    new = _class_links(_ordered(first, "node", "leader"), table, classes, scratch, settings, "links-0")
    step = 0
    while True:
        found = new.count()
        if found:
            classes = merged_classes(classes, new, scratch, f"classes-{step}")
        step += 1
        classed = scratch.write(members.join(classes, "node"), f"classed-{step}")
        drawn = F.min(F.struct(F.xxhash64("node", F.lit(step)).alias("h"), "node", "label"))
        mixed = classed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), drawn.alias("led")) \
            .filter("lo <> hi").select("key", "led")
        mixed = scratch.write(mixed, f"mixed-{step}")
        if step > 1 and settings.few_links * found <= mixed.count():
            break
        # one leader per node and round
        star = classed.join(mixed, "key").filter("label <> led.label").groupBy("node").agg(
            F.min(F.struct(F.xxhash64("key", F.lit(step)).alias("h"), F.col("led.node").alias("leader")))["leader"].alias("leader"))
        new = _class_links(_ordered(star, "node", "leader"), table, classes, scratch, settings, f"links-{step}")
    # the rounds ended, which does not mean that every pair of a bucket was compared
    open_ = scratch.write(classed.join(mixed.select("key"), "key"), "open-buckets")
    few = open_.filter(F.col("n") <= settings.small).select("key", "node", "label")
    other = few.select("key", F.col("node").alias("other"), F.col("label").alias("other_label"))
    pairs = _ordered(few.join(other, "key").filter("label < other_label"), "node", "other")
    large = open_.filter(F.col("n") > settings.small).select("key", "node", "label")
    top = large.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.max(F.struct("k", "label"))["label"].alias("top"))
    top = scratch.write(top, "tops")
    large = scratch.write(large.join(top, "key").groupBy("node", "label").agg(F.max(F.col("label") != F.col("top")).alias("few")), "open")
    if large.limit(1).count():
        pairs = pairs.unionByName(remaining_pairs(large, table, scratch, settings)).distinct()
    new = _class_links(pairs, table, classes, scratch, settings, "links-remaining")
    if new.limit(1).count():
        classes = merged_classes(classes, new, scratch, "classes-remaining")
    label = classes
    found = scratch.write(rows.join(label, "node", "left").select(
        "doc_id", "row_key", "node", F.coalesce("label", "node").alias("label")), "found")
    ids = found.filter("label is not null").groupBy("label").agg(
        F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("docs"))
    ids = scratch.write(ids, "ids")
    return found.join(ids, "label", "left").select(
        "doc_id", "row_key", "label", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias("class_id"),
        F.coalesce("docs", F.lit(1)).alias("class_docs"))


def deduplicated(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``df`` with one row of each class: that of the least doc_id, then row key; equal rows count once.

    Rows with a null or empty text stay.
    """
    spark = df.sparkSession
    found = Scratch(spark, "dedup").write(near_duplicate_classes(df, settings), "classes")
    firsts = found.filter("label is not null").filter(F.col("doc_id").eqNullSafe(F.col("class_id"))) \
        .groupBy("label", "class_id", "row_key").agg(F.count(F.lit(1)).alias("same"))
    chosen = firsts.groupBy("label").agg(F.min(F.struct("row_key", "class_id", "same")).alias("c")) \
        .select(F.col("c.row_key").alias("_rep_key"), F.col("c.class_id").alias("_rep_id"), F.col("c.same").alias("_same"))
    # the input's columns go by numbers, so that no name of theirs can clash
    own = [F.col(c).alias(f"own_{i}") for i, c in enumerate(df.columns)]
    names = [F.col(f"own_{i}").alias(c) for i, c in enumerate(df.columns)]
    rows = df.select(*own, F.col("doc_id").alias("id"), row_key().alias("key")).join(
        chosen, (F.col("key") == F.col("_rep_key")) & F.col("id").eqNullSafe(F.col("_rep_id")))
    out = rows.filter("_same = 1").select(*names).unionByName(df.filter(F.coalesce(F.col("text"), F.lit("")) == ""))
    if chosen.filter("_same > 1").limit(1).count():
        out = out.unionByName(rows.filter("_same > 1").dropDuplicates(["id", "key"]).select(*names))
    return out
