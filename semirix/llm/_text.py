"""Vectorised views of an Arrow text column: words, word hashes and word shingles.

Everything works on the UTF-8 bytes of a block of whole texts with numpy, so a word costs
nanoseconds and not a Python object. Words are runs of bytes other than ASCII white space
(``[^\\x20\\x09-\\x0D]+``). A null text counts as the empty text and has no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BYTE[_SPACE] = 0
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_POW = np.multiply.accumulate(np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64))
_STEP = U64(0xD6E8FEB86659FD93)
SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets of the texts in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offs, data = texts.buffers()
    if len(texts) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offs = np.frombuffer(offs, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


class Words:
    """Words of a block of texts: ``starts``/``ends`` are byte offsets, ``first`` has n + 1 word offsets."""

    def __init__(self, texts: pa.Array, ink: np.ndarray | None = None):
        """``ink``: which of the 256 bytes are in words, all but white space by default."""
        self.data, self.offs = buffers(texts)
        self.n = len(self.offs) - 1
        self.ink = ~_SPACE if ink is None else ink
        ink = self.ink[self.data]
        begin, end = ink.copy(), ink.copy()
        begin[1:] &= ~ink[:-1]
        end[:-1] &= ~ink[1:]
        edge = self.offs[(self.offs > 0) & (self.offs < len(ink))]
        begin[edge] = ink[edge]
        end[edge - 1] = ink[edge - 1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.offs)
        self.counts = np.diff(self.first)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; with ``lower``, A-Z count as a-z. Memory is bounded by SEGMENT."""
        table, out, i, m = np.where(self.ink, _LOWER if lower else _BYTE, U64(0)), np.empty(len(self.starts), U64), 0, len(self.starts)
        while i < m:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + SEGMENT)))
            s = self.starts[i:j] - self.starts[i]
            size = int(self.ends[j - 1] - self.starts[i])
            at = np.arange(size) - np.repeat(s, np.diff(np.append(s, size)))
            part = table[self.data[self.starts[i] : self.starts[i] + size]] * _POW[at & 0xFFFF]
            out[i:j] = np.add.reduceat(part, s)
            i = j
        return mix(out + (self.ends - self.starts).astype(U64))

    def words(self, at: np.ndarray) -> list[str]:
        """The words with these numbers: they hold no space, so one joined text is decoded and split."""
        if not len(at):
            return []
        size = self.ends[at] - self.starts[at]
        end = np.cumsum(size + 1)
        flat = np.arange(end[-1]) + np.repeat(self.starts[at] - end + size + 1, size + 1)
        text = self.data[np.minimum(flat, len(self.data) - 1)]
        text[end - 1] = 32
        return text[:-1].tobytes().decode("utf-8", "replace").split(" ")

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order, and the n + 1 offsets of the texts in them.

    A text with fewer words than k has its whole sequence as its one shingle; one without words has none.
    """
    count = np.diff(first)
    sizes = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    offs = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(first[:-1] - offs[:-1], sizes) + np.arange(offs[-1])
    length = np.repeat(np.minimum(count, k), sizes)
    out = length.astype(U64)
    for j in range(k):
        has = length > j
        if has.all():
            out = out * _STEP + words[at + j]
        else:
            out[has] = out[has] * _STEP + words[at[has] + j]
    return mix(out), offs


def release() -> None:
    """Gives back to the system what a task has freed: a worker serves many tasks and stages, and would keep the most that any of them held."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(run):
    """``run``, a function of batches, with ``release`` at its end."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``size`` bytes of text each; one row may be larger."""
    try:
        yield from _blocks(batches, column, size)
    finally:
        release()


def _blocks(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, i = np.cumsum(lengths.astype(np.int64)), 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + size, "right")))
            yield batch.slice(i, j - i)
            i = j
