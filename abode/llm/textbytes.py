"""Vectorised word splitting over the byte buffers of Arrow text columns.

The texts of a batch lie one after the other in one byte buffer; words are
found, hashed and counted with numpy over that buffer, without a Python
object for each word. Used inside the tasks of ``mapInArrow``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_K1 = np.uint64(0x9E3779B97F4A7C15)
_K2 = np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)
#: Zero bytes after each buffer, so that 8 bytes can be read from any position.
PAD = 8


class Buffer(NamedTuple):
    """``data``: bytes of the texts and PAD zeros; text i is data[bounds[i]:bounds[i + 1]]."""

    data: np.ndarray
    bounds: np.ndarray


class Words(NamedTuple):
    """Word i is data[start[i]:end[i]], in text ``doc[i]``."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about ``most`` text bytes (one longer text stands alone)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def buffer_of(column: pa.Array) -> Buffer:
    """The bytes of a text column; null counts as empty."""
    texts = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.zeros(int(offsets[-1] - offsets[0]) + PAD, np.uint8)
    if len(data) > PAD:
        data[:-PAD] = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return Buffer(data, offsets - offsets[0])


def byte_table(word_bytes: np.ndarray, lower: bool = False) -> np.ndarray:
    """256 entries: 0 for bytes outside words, else the byte (A-Z as a-z if ``lower``)."""
    table = np.where(word_bytes, np.arange(256), 0).astype(np.uint8)
    if lower:
        table[65:91] = np.where(word_bytes[65:91], np.arange(97, 123), 0)
    return table


def not_white_space() -> np.ndarray:
    flags = np.ones(256, bool)
    flags[[9, 10, 11, 12, 13, 32]] = False
    return flags


def letters_and_digits() -> np.ndarray:
    """ASCII letters and digits, and all bytes of characters beyond ASCII."""
    flags = np.zeros(256, bool)
    flags[48:58] = flags[65:91] = flags[97:123] = flags[128:] = True
    return flags


def find_words(inside: np.ndarray, bounds: np.ndarray) -> Words:
    """Words from flags per byte (without padding); a word never crosses a bound."""
    n = len(inside)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    before[inner] = False
    after[inner - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(bounds, start, side="right") - 1
    return Words(start, end, doc)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _K2
    return h ^ (h >> _S29)


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """View of a padded buffer: the 8 bytes from each position as one number."""
    return np.ndarray((len(data) - PAD + 1,), "<u8", data.data, strides=(1,))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end]; depends on the bytes alone."""
    view, size = eight_bytes(data), end - start
    h = (size.astype(np.uint64) + np.uint64(1)) * _K1
    left, at, rows = size, start, None
    while len(at):
        block = view[at].astype(np.uint64)
        short = left < 8
        if short.any():
            bits = (np.uint64(8) * left[short].astype(np.uint64))
            block[short] &= (np.uint64(1) << bits) - np.uint64(1)
        if rows is None:
            h = _mixed((h ^ block) * _K1 ^ (block >> _S32))
        else:
            h[rows] = _mixed((h[rows] ^ block) * _K1 ^ (block >> _S32))
        more = np.flatnonzero(left > 8)
        rows = more if rows is None else rows[more]
        at, left = at[more] + 8, left[more] - 8
    return h ^ (h >> _S32)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges starts[i] .. starts[i] + counts[i] - 1."""
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    return np.repeat(starts - first, counts) + np.arange(total, dtype=np.int64)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, count): ``order`` sorts the keys; groups start at ``first`` in that order."""
    order = np.argsort(keys)
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return order, first, np.diff(np.append(first, len(keys)))


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each occurs."""
    ranked = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return ranked[first], np.diff(np.append(first, len(keys)))
