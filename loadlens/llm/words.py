"""Words and word shingles of a batch of texts as 64-bit hashes, computed with numpy.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return; A-Z are lower-cased.  Hashes are the same on every executor and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijection whose output bits all depend on all input bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        steps = (np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1 << 20))
        return mix(steps * U64(0x9E3779B97F4A7C15)) | U64(1)


@cache
def _byte_values() -> np.ndarray:
    values = constants(256, 7)
    values[65:91] = values[97:123]
    values[[9, 10, 11, 12, 13, 32]] = 0
    return values


@cache
def _is_space() -> np.ndarray:
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return space


_POWERS = np.ones(1, U64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        more = np.full(max(n, 1024), U64(0xD6E8FEB86659FD93))
        more[0] = 1
        _POWERS = np.multiply.accumulate(more)
    return _POWERS


def slices(batch: pa.RecordBatch, column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of ``batch`` of about ``limit`` text bytes, at least one row each."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0))
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and the offsets; a null text is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if texts.offset:
        texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


class Words:
    """Words of a batch: hash, first byte, end byte, and the range of words of each text."""

    def __init__(self, texts: pa.Array, classes: np.ndarray | None = None):
        data, offsets = text_bytes(texts)
        space = _is_space()[data]
        first = ~space
        if len(data):
            inner = offsets[1:-1]
            after = np.empty(len(data), bool)
            after[0] = True
            after[1:] = space[:-1]
            after[inner[inner < len(data)]] = True
            first &= after
        self.data, self.offsets = data, offsets
        self.first = np.flatnonzero(first)
        self.bounds = np.searchsorted(self.first, offsets)
        if not len(self.first):
            self.hash, self.end = np.zeros(0, U64), np.zeros(0, np.int64)
            return
        # A word ends at the next space, the next word or the end of its text.
        stop = np.append(self.first[1:], len(data))
        lengths = np.diff(np.append(self.first, len(data)))
        where = np.arange(self.first[0], len(data)) - np.repeat(self.first, lengths)
        values = _byte_values()[data[self.first[0]:]] * _powers(int(where.max()) + 1)[where]
        self.hash = mix(np.add.reduceat(values, self.first - self.first[0]))
        solid = np.add.reduceat((~space[self.first[0]:]).astype(np.int64),
                                self.first - self.first[0])
        self.end = np.minimum(self.first + solid, stop)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words inside a text, and the offsets by text.

        A text of fewer words, but at least one, has its whole sequence as the only shingle.
        """
        n = np.diff(self.bounds)
        counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        offsets = np.concatenate([[0], np.cumsum(counts)])
        total = int(offsets[-1])
        if not total:
            return np.zeros(0, U64), offsets
        start = np.arange(total) - np.repeat(offsets[:-1], counts) + np.repeat(
            self.bounds[:-1], counts)
        length = np.repeat(np.minimum(n, k), counts)
        factors = constants(k, 11)
        out = length.astype(U64) * U64(0x9E3779B97F4A7C15)
        last = len(self.hash) - 1
        whole = bool((length == k).all())
        for j in range(k):
            part = self.hash[np.minimum(start + j, last)] * factors[j]
            out += part if whole else np.where(j < length, part, U64(0))
        return mix(out), offsets
