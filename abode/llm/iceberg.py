"""Source divergence audit: the terms of each language by iceberg prefix refinement, and how sources differ in them.

Terms are runs of ASCII letters and characters beyond ASCII, only A-Z
lower-cased. A language keeps the terms that occur in at least ``least_docs``
of its documents.

Iceberg prefix refinement: a document that holds a term holds each byte prefix
of it, so no prefix has fewer documents than a term below it. Prefixes of
``first`` bytes are counted first, then of twice as many, and so on. At each
level every document adds one to each of its distinct prefixes of that length
(prefixes may end inside a character), and terms that end on the level are
counted whole, by source. Prefixes with fewer than ``least_docs`` documents are
discarded: the next level makes no row for anything below them. The levels end
when no prefix is left to extend.

What the next level needs of the surviving prefixes is a bitmap of ``bits``
bits, the only broadcast, of the same size whatever the corpus. Two prefixes may
share a bit; then a discarded one is counted again below, and discarded there,
because every level judges by exact counts. A pass reads the texts and makes,
in slices of a few MB, one row per distinct prefix with its number of
documents; these are summed before and after the shuffle, so a hot source or a
frequent term costs one row per task.

Divergence: with N the number of occurrences of kept terms in a group (a source
in a language, or the whole language), V the number of kept terms and c the
count of one, p = 1 + floor(10^9 (c + 1) / (N + V)), and a term's part in the
divergence of p from q is floor((p - q)^2 / q). All numbers are exact (64-bit,
or 38-digit decimals where they may be larger). Sums over all kept terms take
the terms that a pair of sources shares one by one; the terms of one source
alone only depend on its counts, so they come from its counts' histogram.

Defined cases: null text, lang and source count as empty. A group without kept
terms still has its pairs (V = 0: value 0). Repeated rows are documents of
their own. Equal values rank by the item's bytes. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abode.llm import textbytes as B
from abode.llm.common import Scratch

UNIT = 1_000_000_000
#: Counts below this times ``UNIT`` fit into 64 bits.
_LONG_COUNT = 9_000_000_000


@dataclass(frozen=True)
class Settings:
    least_docs: int = 3
    first: int = 3              # bytes of the first level's prefixes
    bits: int = 1 << 24         # 2 MB, the same for every corpus
    slice_bytes: int = 4 << 20
    top_terms: int = 200


def letters() -> np.ndarray:
    """ASCII letters, and all bytes of characters beyond ASCII."""
    flags = np.zeros(256, bool)
    flags[65:91] = flags[97:123] = flags[128:] = True
    return flags


_LETTERS = B.byte_table(letters(), lower=True)
_LANG = np.uint64(0x9E3779B97F4A7C15)


def _lang_seed(lang: str) -> np.uint64:
    raw = np.zeros(len(lang.encode()) + B.PAD, np.uint8)
    raw[:len(raw) - B.PAD] = np.frombuffer(lang.encode(), np.uint8)
    return (B.span_hash(raw, np.array([0]), np.array([len(raw) - B.PAD])) * _LANG)[0]


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    return (h % np.uint64(bits)).astype(np.int64)


def _marked(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _positions(h, len(bitmap) * 8)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _spans(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The bytes data[start:start + size] of each span."""
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    body = data[B.ragged(start, size)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(body)]) \
        .cast(pa.binary())


def _level_rows(batch: pa.RecordBatch, done: int, length: int, bitmap: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Per language: prefixes of ``length`` bytes of longer terms, and whole terms of done + 1 to ``length`` bytes by source."""
    buf = B.buffer_of(batch.column("text"))
    data = _LETTERS[buf.data]
    data[len(data) - B.PAD:] = 0
    words = B.find_words(data[:len(data) - B.PAD] > 0, buf.bounds)
    size = words.end - words.start
    longer = size > done
    start, size, doc = words.start[longer], size[longer], words.doc[longer]
    groups = {}
    for i, group in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())):
        groups.setdefault(group, len(groups))
    number = np.array([groups[g] for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())], np.int64)
    names = list(groups)
    langs = sorted({lang for lang, _ in names})
    lang_of_group = np.array([langs.index(lang) for lang, _ in names], np.int64)
    seeds = np.array([_lang_seed(lang) for lang in langs], np.uint64)
    lang = lang_of_group[number[doc]] if len(doc) else np.zeros(0, np.int64)
    if bitmap is not None:
        open_ = _marked(bitmap, B.span_hash(data, start, start + done) ^ seeds[lang])
        start, size, doc, lang = start[open_], size[open_], doc[open_], lang[open_]
    for whole in (True, False):
        mine = size <= length if whole else size > length
        at, d = start[mine], doc[mine]
        if not len(at):
            continue
        span = size[mine] if whole else np.full(len(at), length, np.int64)
        group = number[d] if whole else lang[mine]
        h = B.span_hash(data, at, at + span)
        h = h ^ (group + 1).astype(np.uint64) * _LANG
        order = np.argsort(h, kind="stable")  # documents stay ascending within a key
        h, d, group, at, span = h[order], d[order], group[order], at[order], span[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        new_doc = new.copy()
        new_doc[1:] |= d[1:] != d[:-1]
        first = np.flatnonzero(new)
        keys = [names[g] if whole else (langs[g], "") for g in group[first].tolist()]
        yield pa.record_batch({
            "lang": pa.array([k[0] for k in keys], pa.string()), "source": pa.array([k[1] for k in keys], pa.string()),
            "prefix": _spans(data, at[first], span[first]), "whole": pa.array(np.full(len(first), whole)),
            "docs": pa.array(np.add.reduceat(new_doc.astype(np.int64), first)),
            "n": pa.array(np.diff(np.append(first, len(h))))})


_LEVEL = "lang string, source string, prefix binary, whole boolean, docs long, n long"


def _level(texts: DataFrame, done: int, length: int, bitmap: np.ndarray | None, settings: Settings) -> DataFrame:
    """lang, source, prefix, whole, docs, n: exact sums over all documents."""
    shared = None if bitmap is None else texts.sparkSession.sparkContext.broadcast(bitmap)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.slices(batches, "text", settings.slice_bytes):
            yield from _level_rows(b, done, length, None if shared is None else shared.value)
    return texts.mapInArrow(made, _LEVEL).groupBy("lang", "source", "prefix", "whole").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def _bitmap(prefixes: DataFrame, settings: Settings) -> np.ndarray | None:
    """One bit per surviving (lang, prefix), united from the tasks' bitmaps; None if none survives."""
    bits = settings.bits

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(bits // 8, np.uint8)
        for b in batches:
            buf = B.buffer_of(b.column("prefix"))
            seeds = {lang: _lang_seed(lang) for lang in b.column("lang").unique().to_pylist()}
            seed = np.array([seeds[lang] for lang in b.column("lang").to_pylist()], np.uint64)
            at = _positions(B.span_hash(buf.data, buf.bounds[:-1], buf.bounds[1:]) ^ seed, bits)
            np.bitwise_or.at(found, at >> 3, (1 << (at & 7)).astype(np.uint8))
        used = np.flatnonzero(found)
        yield pa.record_batch({"cell": pa.array(used), "set_bits": pa.array(found[used].astype(np.int64))})
    # as many rows as the bitmap has bytes at most
    cells = prefixes.select("lang", "prefix").mapInArrow(made, "cell long, set_bits long") \
        .groupBy("cell").agg(F.bit_or("set_bits").alias("set_bits")).toArrow()
    if not cells.num_rows:
        return None
    out = np.zeros(bits // 8, np.uint8)
    out[cells.column("cell").to_numpy()] = cells.column("set_bits").to_numpy().astype(np.uint8)
    return out


def refined_terms(docs: DataFrame, settings: Settings = Settings(), scratch: Scratch | None = None) -> DataFrame:
    """lang, source, term, n: occurrences of each kept term in each source that has it (needs text, lang, source)."""
    return kept_terms(docs, settings, scratch or Scratch(docs.sparkSession, "iceberg"))[0].drop("lang_n")


def kept_terms(docs: DataFrame, settings: Settings, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(terms, sums): written tables of lang, source, term, n and lang_n (occurrences in the language), and of lang and lang_n per kept term.

    Join keys begin with the prefix: a sort compares the first bytes of its first key, and a language has none that differ.
    """
    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    done, length, bitmap, kept, sums = 0, settings.first, None, None, None
    while True:
        level = scratch.write(_level(texts, done, length, bitmap, settings), f"level-{length}")
        whole = level.filter("whole")
        # written, so that the join shuffles both sides and a term of very many sources can be split
        enough = scratch.write(whole.groupBy("lang", "prefix").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
                               .filter(F.col("docs") >= settings.least_docs).select("lang", "prefix", "lang_n"), f"enough-{length}")
        terms = scratch.write(whole.join(enough, ["prefix", "lang"]).select(
            "lang", "source", F.col("prefix").cast("string").alias("term"), "n", "lang_n"), f"terms-{length}")
        kept = terms if kept is None else kept.unionByName(terms)
        enough = enough.select("lang", "lang_n")
        sums = enough if sums is None else sums.unionByName(enough)
        bitmap = _bitmap(level.filter(~F.col("whole") & (F.col("docs") >= settings.least_docs)), settings)
        scratch.drop(f"level-{length}")
        if bitmap is None:
            return kept, sums
        done, length = length, 2 * length


def _share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + kinds)), exactly: in 64 bits where the product fits, else in decimals."""
    count, below = count.cast("long"), total + kinds
    top = (count + 1).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.when(count < _LONG_COUNT, F.call_function("div", (count + 1) * F.lit(UNIT), below)) \
        .otherwise(F.call_function("div", top, below.cast("decimal(19,0)"))) + 1


def _part(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of shares: at most 10^18, so 64 bits do."""
    return F.call_function("div", (p - q) * (p - q), q)


def _sums(value: Column, name: str) -> list[Column]:
    """Sums of the upper and the lower 32 bits: 64 bits hold both for up to 2^31 terms."""
    return [F.sum(F.shiftright(value, 32)).alias(f"{name}_upper"), F.sum(value.bitwiseAND(0xFFFFFFFF)).alias(f"{name}_lower")]


def _whole(name: str) -> Column:
    """The sum again, in 38 digits; 0 without rows."""
    upper, lower = (F.coalesce(F.col(f"{name}_{part}"), F.lit(0)).cast("decimal(19,0)") for part in ("upper", "lower"))
    return upper * F.lit(1 << 32).cast("decimal(10,0)") + lower


def source_divergence(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """lang, source, part, item, value, rank: see the module's text.

    ``pair``: every other source of the language, by the sum over all kept
    terms; ``term``: the first ``top_terms`` of the source's terms that are more
    frequent there than in the language.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    terms, sums = kept_terms(docs, settings, scratch)
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    kinds = sums.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("has"))
    groups = groups.join(totals, ["lang", "source"], "left").join(kinds, "lang", "left") \
        .na.fill(0, ["total", "has", "v", "lang_total"])
    # p0: share of a kept term that the group does not have
    groups = scratch.write(groups.withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.col("v")))), "groups")
    shares = terms.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "p0",
        _share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"))
    shares = scratch.write(shares, "shares")

    named = shares.filter("p > q") \
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _part(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("source", "lang").orderBy(F.desc("value"), "item")
    named = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= settings.top_terms)

    pairs = _pair_values(shares, groups, scratch)
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(named)


def _pair_values(shares: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """lang, source, part, item, value of each ordered pair of different sources of a language.

    Over all kept terms: those of neither source have the same part each; those
    of one source, first taken for all its terms, depend on its shares alone;
    the terms of both are then put right one by one.
    """
    left = groups.select("lang", F.col("source").alias("x"), F.col("p0").alias("x0"), F.col("has").alias("x_has"), "v")
    right = groups.select("lang", F.col("source").alias("y"), F.col("p0").alias("y0"), F.col("has").alias("y_has"))
    # one row per pair of the result
    pairs = left.join(right, "lang").filter("x <> y")
    histogram = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k"))
    zeros = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other0"))
    # few distinct p0: sources of equal size share it
    alone = histogram.join(zeros.select("lang", "other0").distinct(), "lang")
    # a value at most 10^18 and a number of terms: the product in its upper and lower bits
    parts = {"over": _part(F.col("p"), F.col("other0")), "under": _part(F.col("other0"), F.col("p"))}
    alone = alone.groupBy("lang", "source", "other0").agg(*[
        F.sum(bits * F.col("k")).alias(f"{name}_{which}") for name, value in parts.items()
        for which, bits in (("upper", F.shiftright(value, 32)), ("lower", value.bitwiseAND(0xFFFFFFFF)))])
    above = alone.select("lang", F.col("source").alias("x"), F.col("other0").alias("y0"), "over_upper", "over_lower")
    below = alone.select("lang", F.col("source").alias("y"), F.col("other0").alias("x0"), "under_upper", "under_lower")
    a = shares.select("lang", "term", F.col("source").alias("x"), F.col("p").alias("px"), F.col("p0").alias("x0"))
    b = shares.select("lang", "term", F.col("source").alias("y"), F.col("p").alias("py"), F.col("p0").alias("y0"))
    px, py, x0, y0 = (F.col(c) for c in ("px", "py", "x0", "y0"))

    def mended(p: Column, q: Column, p0: Column, q0: Column) -> Column:
        return _part(p, q) - _part(p, q0) - _part(p0, q) + _part(p0, q0)
    # each two sources of a term once, for both directions
    both = a.join(b, ["term", "lang"]).filter("x < y").groupBy("lang", "x", "y").agg(
        *_sums(mended(px, py, x0, y0), "there"), *_sums(mended(py, px, y0, x0), "back"))
    names = ["mended_upper", "mended_lower"]
    both = scratch.write(both, "both")
    both = both.select("lang", "x", "y", "there_upper", "there_lower").toDF("lang", "x", "y", *names).unionByName(
        both.select("lang", F.col("y").alias("x"), F.col("x").alias("y"), "back_upper", "back_lower").toDF("lang", "x", "y", *names))
    # terms of both were taken in ``over`` and in ``under``, and twice from the terms of neither
    found = pairs.join(above, ["lang", "x", "y0"], "left").join(below, ["lang", "y", "x0"], "left") \
        .join(both, ["lang", "x", "y"], "left")
    neither = (F.col("v") - F.col("x_has") - F.col("y_has")).cast("decimal(19,0)") * _part(x0, y0).cast("decimal(19,0)")
    value = neither + _whole("over") + _whole("under") + _whole("mended")
    return found.select("lang", F.col("x").alias("source"), F.lit("pair").alias("part"), F.col("y").alias("item"),
                        F.coalesce(value.cast("long"), F.lit(0).cast("long")).alias("value"))
