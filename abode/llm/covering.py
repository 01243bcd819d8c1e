"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: words are runs without white space, A-Z lower-cased; a text's
shingles are its runs of four words with repeats, joined by a space (a shorter
text is one shingle). Bit i of the 64-bit fingerprint is 1 if it is set in more
than half of the shingles' XXH64 hashes (seed 42). A text without words has
fingerprint zero.

Covering masks: each of the 64 bit places gets a vector of radius + 1 random
bits, and each non-zero vector v of that length makes one mask: the places whose
vector has an odd number of ones in common with v. Up to ``radius`` differing
places span less than the whole space, so some v is orthogonal to all of them
and its mask holds none of them: any two fingerprints within the radius are
equal under at least one of the 2^(radius + 1) - 1 masks. Nothing is left to
chance; a mask holds about half of the places.

Texts with equal fingerprints are one node. A bucket is the nodes that are equal
under one mask. In rounds, each bucket that holds several classes compares its
nodes of other classes with one leader, drawn anew per bucket and round, and
the classes that a link joins are merged; one link per pair of classes is kept.
When a round finds hardly anything new, the mixed buckets are split by a second
set of masks, to which the same guarantee applies, and in each part every node
that is not of the most frequent class is compared with all nodes of other
classes. The
distance is a condition of the join, so only links come out of it. No pair
within the radius is left out, however large a bucket is.

Defined cases: null and empty texts and texts of white space alone have
fingerprint zero and are linked like any other. Repeated rows are nodes once and
rows each time. A component whose ids are all null has a null component_id. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abode.llm import textbytes as B
from abode.llm.common import Scratch
from abode.llm.components import merged_classes


@dataclass(frozen=True)
class Settings:
    shingle: int = 4
    radius: int = 4
    seed: int = 42              # of the shingles' hash
    mask_seed: int = 20240301
    few_links: int = 20         # rounds end at one new link per so many mixed buckets
    slice_bytes: int = 4 << 20


_WORDS = B.byte_table(B.not_white_space(), lower=True)
_BIT = np.uint8(1)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bits that more than half of the hashes have; zero without hashes."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[a:a + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _shingle_hashes(text: bytes, start: list[int], end: list[int], settings: Settings) -> np.ndarray:
    """XXH64 of each run of words; ``text`` has one space between words."""
    n, k = len(start), settings.shingle
    if n <= k:
        return np.array([xxhash.xxh64_intdigest(text[start[0]:end[-1]], settings.seed)], np.uint64) if n else np.zeros(0, np.uint64)
    digest, seed = xxhash.xxh64_intdigest, settings.seed
    return np.fromiter((digest(text[a:b], seed) for a, b in zip(start[:n - k + 1], end[k - 1:])), np.uint64, n - k + 1)


def _fingerprints_of(column: pa.Array, settings: Settings) -> np.ndarray:
    buf = B.buffer_of(column)
    data = _WORDS[buf.data[:len(buf.data) - B.PAD]]
    # byte 0 stands for white space in the table, so a NUL in a text is told apart by its own byte
    inside = (data > 0) | (buf.data[:len(data)] == 0)
    w = B.find_words(inside, buf.bounds)
    size = w.end - w.start
    # the words of all texts again, each followed by one space
    offsets = np.concatenate(([0], np.cumsum(size + 1)))
    body = np.full(int(offsets[-1]), 32, np.uint8)
    body[B.ragged(offsets[:-1], size)] = data[B.ragged(w.start, size)]
    body = body.tobytes()
    starts, ends = offsets[:-1].tolist(), (offsets[:-1] + size).tolist()
    cut = np.searchsorted(w.doc, np.arange(len(column) + 1)).tolist()
    out = np.zeros(len(column), np.uint64)
    for i in range(len(column)):
        a, b = cut[i], cut[i + 1]
        out[i] = fingerprint_of(_shingle_hashes(body, starts[a:b], ends[a:b], settings))
    return out


def fingerprints(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of each row."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.slices(batches, "text", settings.slice_bytes):
            yield pa.record_batch({"doc_id": b.column("doc_id"), "fp": pa.array(_fingerprints_of(b.column("text"), settings).view(np.int64))})
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(made, f"doc_id {id_type}, fp long")


def covering_masks(settings: Settings, family: int) -> list[int]:
    """2^(radius + 1) - 1 masks (as longs) of which any ``radius`` places miss at least one; ``family`` draws others.

    Every vector of the space is used about equally often, so all masks are of similar size.
    """
    width = settings.radius + 1
    rng = np.random.default_rng([settings.mask_seed, family])
    vectors = np.resize(np.arange(1, 1 << width), 64)
    rng.shuffle(vectors)
    out = []
    for v in range(1, 1 << width):
        odd = np.bitwise_count(vectors & v) & 1
        out.append(int(np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")[0]))
    return out


def _under(value: Column, masks: list[int]) -> Column:
    """array of (mask's number, value under the mask)."""
    return F.array(*[F.struct(F.lit(i).alias("mask"), value.bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)])


def _near(a: str, b: str, radius: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


def near_classes(nodes: DataFrame, scratch: Scratch, settings: Settings = Settings()) -> DataFrame:
    """node, label of each of the distinct fingerprints ``nodes`` (node); label names the component.

    Each round is a written table; only the numbers of new links and of mixed
    buckets reach the driver.
    """
    first, second = covering_masks(settings, 0), covering_masks(settings, 1)
    places = nodes.select("node", F.explode(_under(F.col("node"), first)).alias("bucket"))
    shared = scratch.write(places.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
                           .filter("lo < hi").select("bucket"), "buckets")
    members = scratch.write(places.join(shared, "bucket"), "members")
    classes = scratch.write(members.select("node").distinct().select("node", F.col("node").alias("label")), "start")
    step = 0
    while True:
        classed = scratch.write(members.join(classes, "node"), f"classed-{step}")
        drawn = F.min(F.struct(F.xxhash64("node", F.lit(step)).alias("h"), "node", "label"))
        mixed = classed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), drawn.alias("led")) \
            .filter("lo < hi").select("bucket", F.col("led.node").alias("leader"), F.col("led.label").alias("led"))
        mixed = scratch.write(mixed, f"mixed-{step}")
        links = classed.join(mixed, "bucket").filter("label <> led").filter(_near("node", "leader", settings.radius)) \
            .select(F.least("label", "led").alias("a"), F.greatest("label", "led").alias("b")).distinct()
        links = scratch.write(links, f"links-{step}")
        found = links.count()
        if found:
            classes = merged_classes(classes, links, scratch, f"round-{step}")
        if settings.few_links * found <= mixed.count():
            break
        scratch.drop(f"classed-{step}", f"mixed-{step}")
        step += 1
    if found:
        classed = scratch.write(members.join(classes, "node"), "classed")
        several = classed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
        mixed = scratch.write(several.select("bucket"), "mixed")
    left = _left_links(classed, mixed.select("bucket"), second, scratch, settings)
    if left.limit(1).count():
        classes = merged_classes(classes, left, scratch, "left")
    return nodes.join(classes, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def _left_links(classed: DataFrame, mixed: DataFrame, masks: list[int], scratch: Scratch, settings: Settings) -> DataFrame:
    """One link (a, b) per pair of classes that have nodes within the radius; ``mixed``: the buckets with several classes."""
    parts = classed.join(mixed, "bucket").select("bucket", "node", "label", F.explode(_under(F.col("node"), masks)).alias("part"))
    # of two nodes of different classes one is not in the part's most frequent class
    top = parts.groupBy("bucket", "part", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket", "part") \
        .agg(F.max(F.struct("n", "label"))["label"].alias("top"), F.count(F.lit(1)).alias("classes")) \
        .filter("classes > 1").select("bucket", "part", "top")
    top = scratch.write(top, "parts")
    open_ = scratch.write(parts.join(top, ["bucket", "part"]), "open")
    few = open_.filter("label <> top").select("bucket", "part", F.col("node").alias("x"), F.col("label").alias("x_label"))
    other = open_.select("bucket", "part", F.col("node").alias("y"), F.col("label").alias("y_label"))
    met = few.join(other, (few["bucket"] == other["bucket"]) & (few["part"] == other["part"])
                   & (F.col("x_label") != F.col("y_label")) & _near("x", "y", settings.radius))
    return scratch.write(met.select(F.least("x_label", "y_label").alias("a"), F.greatest("x_label", "y_label").alias("b")).distinct(),
                         "left-links")


def near_duplicate_components(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id of the component) of each row."""
    scratch = Scratch(docs.sparkSession, "covering")
    rows = scratch.write(fingerprints(docs, settings), "rows")
    # copies count once, and give their least id
    nodes = scratch.write(rows.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least_id")), "nodes")
    classes = scratch.write(near_classes(nodes.select("node"), scratch, settings), "classes")
    named = classes.join(nodes, "node")
    least = scratch.write(named.groupBy("label").agg(F.min("least_id").alias("component_id")), "least")
    found = scratch.write(classes.join(least, "label").select(F.col("node").alias("fp"), "component_id"), "found")
    return rows.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
