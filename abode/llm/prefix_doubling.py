"""Suffix-array dedup: prefix doubling over sampled positions.

Finds every string of ``length`` bytes that starts at two or more positions of
the corpus (in one text or several, never across texts) and marks the bytes it
covers, exactly.

Sampling. The k-gram of least hash among ``window`` consecutive ones (the first
of equal ones) is the sample of the string that starts there. It depends on the
string's own bytes, so equal strings have samples at the same offset, and one
sampled position stands for a run of neighbouring string starts.

Prefix doubling. Sampled positions are ranked by their first h bytes; positions
whose rank nobody shares drop out. The others are ranked by (rank, rank of the
next h bytes), so by 2h bytes, which all strings of the sample contain. Ranks
are hashes of those bytes, so equal ranks mean equal prefixes and a rerank is a
count by key; uniques drop out of each step. Then the offset grows past the
threshold, in three steps that each settle what they can:

* whole runs (all bytes of all strings of a sample): equal runs repeat in full;
* cells of a run (strings whose offset lies in the same stretch of ``cell``
  offsets): the bytes common to a cell's strings must repeat, and equal cells
  repeat in full;
* the single strings of cells that are still open, at their full length.

What repeats in full is settled, and one representative with its number stands
for it in the next step. So the ends of repeated passages, not the passages,
reach the last step.

Every step is a count by key with partial sums, so a passage that a third of
all texts share is one row per task. Each row is a position of the corpus, no
pairs of positions are made. Only texts with a surviving sample are joined with
their survivors; other texts never leave their scan.

Defined cases: null texts count as empty; texts shorter than ``length`` have
nothing removed; copies of a text (repeated rows too) of at least ``length``
bytes are removed as a whole, each of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abode.llm import textbytes as B
from abode.llm.common import Scratch, row_key


@dataclass(frozen=True)
class Settings:
    length: int = 400
    window: int = 192
    kgram: int = 8
    cell: int = 16

    @property
    def step(self) -> int:
        """h: bytes of the first ranking; 2h bytes lie in every string of a sample."""
        return (self.length - self.window + 1) // 2


_SLICE = 4 << 20


def samples(data: np.ndarray, bounds: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, sample): runs of string starts with the same sampled position.

    ``data`` is padded; a run holds the starts first .. last of strings that
    lie within one text.
    """
    w, n = settings.window, len(data) - B.PAD
    long = np.flatnonzero(np.diff(bounds) >= settings.length)
    if not len(long):
        none = np.zeros(0, np.int64)
        return none, none, none
    grams = B.eight_bytes(data)[:n].astype(np.uint64)
    if settings.kgram < 8:
        grams &= np.uint64((1 << (8 * settings.kgram)) - 1)
    grams *= np.uint64(0x9E3779B97F4A7C15)
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    # hash above, position below: the least is the first position of the least hash. The width is the same for
    # every slice, so equal strings break ties of the hash alike; a slice is shorter than 2^32 bytes
    bits = np.uint64(32)
    grams = grams >> bits << bits | np.arange(n, dtype=np.uint64)
    blocks = -(-n // w) + 1
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = grams
    table = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[w - 1:n + w - 1])
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = B.ragged(bounds[long], np.diff(bounds)[long] - settings.length + 1)
    at = at[starts]
    cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))))
    last = np.append(cut[1:], len(starts)) - 1
    return starts[cut], starts[last], at[cut]


def _rank(view: memoryview, a: int, z: int) -> int:
    return xxhash.xxh3_64_intdigest(view[a:z])


def _signed(values: list[int] | np.ndarray) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


# a run of string starts in one number: first start, further starts, offset of the sample from the first
_BITS = 12


def pack(start, extra, offset):
    return (start << 2 * _BITS) | (extra << _BITS) | offset


def unpack(place: int) -> tuple[int, int, int]:
    mask = (1 << _BITS) - 1
    return place >> 2 * _BITS, place >> _BITS & mask, place & mask


def first_ranks(df: DataFrame, settings: Settings) -> DataFrame:
    """row_key, run and rank of the first h bytes of each sampled position."""
    h = settings.step

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.slices(batches, "text", _SLICE):
            buf = B.buffer_of(b.column("text"))
            first, last, at = samples(buf.data, buf.bounds, settings)
            view = memoryview(buf.data)
            doc = np.searchsorted(buf.bounds, first, side="right") - 1
            yield pa.record_batch({
                "row_key": np.asarray(b.column("row_key"))[doc],
                "place": pack(first - buf.bounds[doc], last - first, at - first),
                "rank": _signed([_rank(view, p, p + h) for p in at.tolist()])})
    return df.select("row_key", "text").mapInArrow(made, "row_key long, place long, rank long")


def reranked(rows: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """The rows whose rank another row shares: positions of unique rank drop out.

    The shared ranks are written first: the join then reads two shuffles, and
    AQE can split a rank that a third of all rows has.
    """
    shared = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key)
    return rows.join(scratch.write(shared, f"shared-{key}"), key)


# (row_key, place, times, core, whole): a run, how many equal runs it stands for, the rank of the bytes
# common to its strings (equal for all runs that may share a string), and the rank of all its bytes
_RUN = "row_key long, place long, times long, core long, whole long"
_Emit = Callable[[memoryview, int, int, int], Iterator[tuple[int, int, int]]]


def ranked_runs(texts: DataFrame, emit: _Emit) -> DataFrame:
    """Runs made by ``emit`` from the text and each of its runs (place, times)."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.slices(batches, "text", _SLICE):
            out: list[list[int]] = [[], [], [], [], []]
            for key, text, runs in zip(b.column("row_key").to_pylist(), b.column("text").to_pylist(), b.column("runs").to_pylist()):
                view = memoryview(text.encode())
                for r in runs:
                    for place, core, whole in emit(view, *unpack(r["place"])):
                        for column, x in zip(out, (key, place, r["times"], core, whole)):
                            column.append(x)
            key_, place_, times, core_, whole_ = out
            yield pa.record_batch({"row_key": pa.array(key_, pa.int64()), "place": pa.array(place_, pa.int64()),
                                   "times": pa.array(times, pa.int64()), "core": _signed(core_), "whole": _signed(whole_)})
    return texts.mapInArrow(made, _RUN)


def whole_runs(settings: Settings) -> _Emit:
    """Core: 2h bytes from the sample. Whole: all bytes of the run and its shape."""
    def emit(view: memoryview, start: int, extra: int, offset: int) -> Iterator[tuple[int, int, int]]:
        stop = start + extra + settings.length
        if stop <= len(view):  # else another row with this row key
            at = start + offset
            yield pack(start, extra, offset), _rank(view, at, at + 2 * settings.step), \
                _rank(view, start, stop) ^ (extra << _BITS | offset)
    return emit


def cells(settings: Settings) -> _Emit:
    """The parts of a run by stretches of sample offsets. Core: the bytes that all strings of a stretch have."""
    c, length = settings.cell, settings.length

    def emit(view: memoryview, start: int, extra: int, offset: int) -> Iterator[tuple[int, int, int]]:
        if start + extra + length > len(view):
            return
        sample = start + offset
        for j in range((offset - extra) // c, offset // c + 1):
            p, z = max(start, sample - j * c - c + 1), min(start + extra, sample - j * c)
            core = _rank(view, sample - j * c, sample - j * c - c + 1 + length) + j & (1 << 64) - 1
            yield pack(p, z - p, sample - p), core, _rank(view, p, z + length) ^ (z - p << _BITS | sample - z)
    return emit


def single_strings(settings: Settings) -> _Emit:
    """Each string of a run by itself, its 128-bit rank in two halves."""
    def emit(view: memoryview, start: int, extra: int, offset: int) -> Iterator[tuple[int, int, int]]:
        if start + extra + settings.length <= len(view):
            for k in range(extra + 1):
                x = xxhash.xxh3_128_intdigest(view[start + k:start + k + settings.length])
                yield pack(start + k, 0, offset - k), x >> 64, x & (1 << 64) - 1
    return emit


def settled(rows: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(full, open): runs that repeat in full, and one run of each kind that may share a string with another kind."""
    rows = scratch.write(rows, f"{name}-runs")
    kinds = scratch.write(rows.groupBy("core", "whole").agg(
        F.sum("times").alias("times"), F.min(F.struct("row_key", "place")).alias("of")), f"{name}-kinds")
    full = rows.filter("times = 1").join(kinds.filter("times > 1").select("core", "whole"), ["core", "whole"]) \
        .select("row_key", "place")
    mixed = kinds.groupBy("core").agg(F.sum("times").alias("n"), F.min("times").alias("least")) \
        .filter("n > 1 and least = 1").select("core")
    return full, kinds.join(mixed, "core").select("of.row_key", "of.place", "times")


def _with_runs(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """Texts with their runs; ``collect_set`` makes nothing of equal rows."""
    listed = runs.groupBy("row_key").agg(F.collect_set(F.struct("place", "times")).alias("runs"))
    return texts.select("row_key", "text").join(listed, "row_key")


def repeated_runs(df: DataFrame, scratch: Scratch, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(texts, runs): the texts that hold candidates, and the runs of repeated string starts by row_key.

    ``df``: row_key and text.
    """
    ranked = scratch.write(first_ranks(df, settings), "ranks-h")
    survivors = reranked(ranked, "rank", scratch).select("row_key", "place", F.lit(1).cast("long").alias("times"))
    texts = scratch.write(_with_runs(df, survivors), "texts")
    scratch.drop("ranks-h")
    runs = ranked_runs(texts, whole_runs(settings))
    found = []
    for name, emit in (("whole", cells(settings)), ("cells", single_strings(settings)), ("strings", None)):
        full, open_runs = settled(runs, scratch, name)
        found.append(full)
        if emit is not None:
            runs = ranked_runs(_with_runs(texts, open_runs), emit)
    return texts, found[0].unionByName(found[1]).unionByName(found[2])


def covered_spans(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes from runs (start, further starts) of strings."""
    spans: list[tuple[int, int]] = []
    for a, e in sorted(runs):
        z = a + e + length
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(z, spans[-1][1]))
        else:
            spans.append((a, z))
    return spans


def removed_spans(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, row_key, n_bytes, spans (first and end byte of each removed run) and kept_sha256 of each row.

    ``df`` needs doc_id and text.
    """
    scratch = Scratch(df.sparkSession, "prefix-doubling")
    keyed = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row_key().alias("row_key"))
    texts, runs = repeated_runs(keyed.select("row_key", "text"), scratch, settings)
    grouped = runs.groupBy("row_key").agg(F.collect_set("place").alias("found"))
    hits = texts.select("row_key", "text").join(grouped, "row_key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.slices(batches, "text", _SLICE):
            spans, digests = [], []
            for text, found in zip(b.column("text").to_pylist(), b.column("found").to_pylist()):
                raw = text.encode()
                mine = covered_spans([unpack(x)[:2] for x in found], settings.length)
                digest, at = hashlib.sha256(), 0
                for a, z in mine:
                    digest.update(raw[at:a])
                    at = z
                digest.update(raw[at:])
                spans.append([{"first": a, "stop": z} for a, z in mine])
                digests.append(digest.hexdigest())
            yield pa.record_batch({"row_key": b.column("row_key"), "cut_sha256": pa.array(digests, pa.string()),
                                   "cut": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())])))})
    made = scratch.write(hits.mapInArrow(
        cut, "row_key long, cut_sha256 string, cut array<struct<first:long,stop:long>>"), "cuts")
    made = made.dropDuplicates(["row_key"])  # equal rows
    whole = keyed.select("doc_id", "row_key", F.octet_length("text").cast("long").alias("n_bytes"),
                         F.sha2("text", 256).alias("sha256"))
    return whole.join(made, "row_key", "left").select(
        "doc_id", "row_key", "n_bytes",
        F.coalesce("cut", F.array().cast("array<struct<first:long,stop:long>>")).alias("spans"),
        F.coalesce("cut_sha256", "sha256").alias("kept_sha256"))
