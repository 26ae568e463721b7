"""Benchmark decontamination: SimHash of windows as long as each item, a multi-index Hamming search, and an exact check.

Every document is read in windows of as many words as each benchmark item has. A window's 64-bit SimHash is the sign of
the sum of its shingles' hash bits, taken from running sums. The items' fingerprints are cut into BLOCKS blocks; each item is
listed under every block value within RADIUS // BLOCKS errors of its own, so by pigeonhole a window within RADIUS of an item
finds it under one of its own blocks. Found pairs are measured on their bags of shingles: the sum of the least counts over
the sum of the greatest. Shingles have five words, an item of fewer words is one shingle; a window at 0.8 or more is a leak.
A window at exactly 0.8 is beyond RADIUS with a chance of about 3 in 10,000, and one at 0.85 hardly ever: the only loss there is.

A document with fewer words than an item is one window of its own length: it is compared with the items that share shingles
with it, without fingerprints, so this is exact.

Window and item are equally long otherwise, so at a similarity s they share 2 s / (1 + s) of their shingles. So the documents are
read once, whatever the number of items: against a bitmap of all items' shingles, of 32 MB at most, which passes over all places where no
window can have so many, and loses nothing. The regions that are left, a small table, meet the items in cells: the items in chunks of
``chunk``, the regions in cells of bounded size, a task for each of both. Nothing of the documents, regions or items
comes to the driver but counts, the items' different lengths and the bitmap.

Defined results: null or blank documents and items have no leak. Of windows with equal similarity the first counts.
Repeated rows are searched each. A null id is carried.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from semirix.llm._store import discard, table
from semirix.llm._text import U64, Words, blocks, shingles

BITS, BLOCKS, RADIUS = 64, 8, 19
_SHIFTS = np.arange(BITS, dtype=np.uint64)
MASK = (1 << 22) - 1
#: Bits of the bitmap of the items' shingles at most, shingles of a region, bytes of regions in a cell, and regions that are worth one.
BITMAP, REGION, CELL_BYTES, CELL_ROWS = 28, 1 << 17, 16 << 20, 500


def _signs(sh: np.ndarray) -> np.ndarray:
    """[n, BITS] of +1 and -1."""
    return ((sh[:, None] >> _SHIFTS) & U64(1)).astype(np.int32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def simhash(sh: np.ndarray) -> int:
    return int(_packed(_signs(sh).sum(axis=0, keepdims=True))[0])


def _flips(width: int, errors: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for e in range(errors + 1) for c in combinations(range(width), e)], np.uint64)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two bags of shingles."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[i], cb[j]).sum())
    return both / max(1, len(a) + len(b) - both)


@dataclass
class ItemIndex:
    """Items of a chunk: ids, words in each, their shingles, fingerprints and the block lists."""

    ids: list
    words: np.ndarray
    bags: list[np.ndarray]
    prints: np.ndarray
    k: int

    def __post_init__(self) -> None:
        width = BITS // BLOCKS
        flips = _flips(width, RADIUS // BLOCKS)
        keys, items = [], []
        for i, f in enumerate(self.prints.tolist()):
            for b in range(BLOCKS):
                own = U64((f >> (b * width)) & ((1 << width) - 1)) ^ flips
                keys.append(own | U64(b << width | int(self.words[i]) << (width + 8)))
                items.append(np.full(len(own), i, np.int32))
        keys = np.concatenate(keys) if keys else np.zeros(0, U64)
        items = np.concatenate(items) if items else np.zeros(0, np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.items = keys[order], items[order]
        self.known, self.seen, self.listed, self.longest = {}, {}, {}, {}
        for k in sorted({min(self.k, int(n)) for n in self.words}):
            self.known[k] = np.unique(np.concatenate([b for b, n in zip(self.bags, self.words, strict=True) if min(self.k, int(n)) == k]))
            own = [(b, i) for i, (b, n) in enumerate(zip(self.bags, self.words, strict=True)) if min(self.k, int(n)) == k]
            sh, item = np.concatenate([b for b, _ in own]), np.repeat([i for _, i in own], [len(b) for b, _ in own])
            self.longest[k] = max(len(b) for b, _ in own)
            by = np.argsort(sh, kind="stable")
            self.listed[k] = sh[by], item[by]  # the items of each shingle
            self.seen[k] = np.zeros(MASK + 1, bool)
            self.seen[k][(self.known[k] & U64(MASK)).astype(np.int64)] = True

    def near(self, prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs of these windows of n words and items of n words within RADIUS."""
        width, b = BITS // BLOCKS, np.arange(BLOCKS, dtype=U64)
        key = ((prints[:, None] >> (b * U64(width))) & U64((1 << width) - 1) | b << U64(width) | U64(n << (width + 8))).ravel()
        lo = np.searchsorted(self.keys, key)
        size = np.searchsorted(self.keys, key, "right") - lo
        at = np.repeat(np.arange(len(key)) // BLOCKS, size)
        found = self.items[np.repeat(lo - np.cumsum(size) + size, size) + np.arange(len(at))]
        pairs = np.unique(at * np.int64(len(self.ids)) + found)
        at, found = pairs // len(self.ids), pairs % len(self.ids)
        close = np.bitwise_count(prints[at] ^ self.prints[found]) <= RADIUS
        return at[close], found[close]

    def shorter(self, sh: np.ndarray, k: int, threshold: float) -> list[tuple[int, float]]:
        """(item, similarity) of a whole document, all of whose shingles are given, and the items longer than it."""
        if len(sh) >= self.longest[k]:
            return []
        keys, items = self.listed[k]
        u = np.unique(sh)
        lo, hi = np.searchsorted(keys, u), np.searchsorted(keys, u, "right")
        out = []
        for item in np.unique(np.concatenate([items[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)])).tolist():
            size = len(self.bags[item])
            if len(sh) < size and len(sh) >= threshold * size - 1e-9:
                s = weighted_similarity(sh, self.bags[item])
                if s >= threshold:
                    out.append((item, s))
        return out

    def search(self, sh: dict[int, np.ndarray], threshold: float, whole: bool = True) -> list[tuple[int, float, int]]:
        """(item, similarity, first word) of a region's best window for each item. sh: its shingles by k; whole: it is all of a document."""
        out: dict[int, tuple[float, int]] = {}
        sh = {k: own for k, own in sh.items() if k in self.known}
        hit = {}
        for k, own in sh.items():
            maybe = np.flatnonzero(self.seen[k][(own & U64(MASK)).astype(np.int64)])
            at = np.searchsorted(self.known[k], own[maybe])
            hit[k] = np.zeros(len(own), bool)
            hit[k][maybe] = self.known[k][np.minimum(at, len(self.known[k]) - 1)] == own[maybe]
        runs = {k: np.concatenate([[0], np.cumsum(h)]) for k, h in hit.items()}
        for n in np.unique(self.words).tolist():
            k = min(self.k, n)
            span = n - k + 1
            if k not in sh or len(sh[k]) < span or not hit[k].any():
                continue
            count = runs[k]
            least = max(1, math.ceil(2 * threshold / (1 + threshold) * span - 1e-9))
            starts = np.flatnonzero(count[span:] - count[:-span] >= least)
            if not len(starts):
                continue
            edges = np.flatnonzero(np.diff(starts) > span)
            step = min(1 << 15, max(16, (1 << 20) // int((self.words == n).sum())))  # bounds the pairs of a step
            for part in np.split(starts, edges + 1):  # the running sums start anew behind each gap
                for i in range(0, len(part), step):
                    own = part[i : i + step]
                    first = int(own[0])
                    total = np.zeros((int(own[-1]) - first + span + 1, BITS), np.int32)
                    np.cumsum(_signs(sh[k][first : int(own[-1]) + span]), axis=0, out=total[1:])
                    prints = _packed(total[own - first + span] - total[own - first])
                    for w, item in zip(*self.near(prints, n), strict=True):
                        s = weighted_similarity(sh[k][own[w] : own[w] + span], self.bags[item])
                        if s >= threshold and s > out.get(int(item), (0.0, 0))[0]:
                            out[int(item)] = s, int(own[w])
        for k, own in sh.items() if whole else ():
            known = int(runs[k][-1])
            if known >= max(1, math.ceil(threshold * len(own) - 1e-9)):  # both / all >= threshold, and all >= len(own)
                out |= {i: (s, 0) for i, s in self.shorter(own, k, threshold)}
        return [(i, s, at) for i, (s, at) in sorted(out.items())]


def index(rows: list[tuple], k: int = 5) -> ItemIndex:
    """rows: (item id, text)."""
    rows = [(i, t) for i, t in rows if t is not None and t.split()]
    w = Words(pa.array([t for _, t in rows], pa.string()))
    hashes = w.hashes(lower=True)
    bags = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        bags.append(shingles(hashes[a:b], np.array([0, b - a]), k)[0])
    keep = [i for i, b in enumerate(bags) if len(b)]
    bags = [bags[i] for i in keep]
    return ItemIndex([rows[i][0] for i in keep], w.counts[keep], bags, np.array([simhash(b) for b in bags], np.uint64), k)


@dataclass
class Filter:
    """Where windows of the items' lengths can have enough of the items' shingles: a bitmap and the buckets of lengths, by k."""

    bits: dict[int, np.ndarray]  # bitmap in 64-bit words; a power of two of them
    spans: dict[int, list[tuple[int, int]]]  # shortest and longest window of a bucket, in shingles
    threshold: float

    def known(self, k: int, sh: np.ndarray) -> np.ndarray:
        at = sh & U64(64 * len(self.bits[k]) - 1)
        return (self.bits[k][(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) != 0

    def least(self, k: int, sizes: np.ndarray) -> np.ndarray:
        """How many known shingles documents of these sizes have at least, if there is a place in them."""
        share, low, high = 2 * self.threshold / (1 + self.threshold), self.spans[k][0][0], self.spans[k][-1][1]
        window = max(1, math.ceil(share * low - 1e-9))
        return np.where(sizes < high, np.minimum(window, np.maximum(1, np.ceil(self.threshold * sizes - 1e-9))), window)

    def regions(self, k: int, hit: np.ndarray) -> list[tuple[int, int]]:
        """Of a document, by which shingles may be known: intervals that hold all windows with enough of them."""
        n, count = len(hit), np.concatenate([[0], np.cumsum(hit)])
        share = 2 * self.threshold / (1 + self.threshold)
        if n < self.spans[k][-1][1] and count[-1] >= max(1, math.ceil(self.threshold * n - 1e-9)):
            return [(0, n)]  # as a document shorter than an item
        cover = np.zeros(n + 1, np.int64)
        for low, high in self.spans[k]:
            if low <= n:
                size = min(high, n)
                start = np.flatnonzero(count[size:] - count[:-size] >= max(1, math.ceil(share * low - 1e-9)))
                np.add.at(cover, start, 1)
                np.add.at(cover, start + size, -1)
        inside = np.cumsum(cover) > 0
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
        out, step = [], self.spans[k][-1][1] - 1
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            out += [(i, min(b, i + REGION + step)) for i in range(a, max(a + 1, b - step), REGION)]
        return out


def item_filter(items: DataFrame, k: int, threshold: float) -> Filter | None:
    """items: (i, t). None if no item has a word."""

    def sized(batches):
        for b in blocks(batches, "t"):
            n = Words(b.column("t")).counts
            yield pa.RecordBatch.from_arrays([pa.array(n[n > 0])], ["n"])

    lengths = sorted((r["n"], r["count"]) for r in items.select("t").mapInArrow(sized, "n long").groupBy("n").count().collect())
    spans: dict[int, list[tuple[int, int]]] = {}
    total: dict[int, int] = {}
    for n, count in lengths:
        own, span = min(k, n), n - min(k, n) + 1
        total[own] = total.get(own, 0) + span * count
        buckets = spans.setdefault(own, [])
        if buckets and (len(lengths) > 64 and span <= 1.1 * buckets[-1][0] or span == buckets[-1][1]):
            buckets[-1] = buckets[-1][0], span
        else:
            buckets.append((span, span))
    if not spans:
        return None
    size = {own: 1 << min(BITMAP, max(22, (64 * n).bit_length())) for own, n in total.items()}

    def marked(batches):
        for b in blocks(batches, "t"):
            w = Words(b.column("t"))
            hashes = w.hashes(lower=True)
            for own in size:
                sh, offs = shingles(hashes, w.first, own)
                keep = np.repeat((w.counts == own) if own < k else (w.counts >= k), np.diff(offs))
                at = np.unique(sh[keep] & U64(size[own] - 1)).astype(np.int64)
                word, first = np.unique(at >> 6, return_index=True)
                if len(word):
                    bits = np.bitwise_or.reduceat(np.int64(1) << (at & 63), first)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), own)), pa.array(word), pa.array(bits)], ["k", "word", "bits"])

    rows = items.select("t").mapInArrow(marked, "k long, word long, bits long").groupBy("k", "word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = {}
    for own, n in size.items():
        bits[own], some = np.zeros(n >> 6, U64), rows[rows["k"] == own]
        bits[own][some["word"].to_numpy(np.int64)] = some["bits"].to_numpy(np.int64).view(U64)
    return Filter(bits, spans, threshold)


def regions(docs: DataFrame, own: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, id, k, first (word), words (of the document), whole, shingles: the places of all documents that can hold a leak; one pass."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for b in blocks(batches):
            w = Words(b.column("text"))
            hashes = w.hashes(lower=True)
            found = []
            for k in own.bits:
                sh, offs = shingles(hashes, w.first, k)
                hit = own.known(k, sh)
                count = np.concatenate([[0], np.cumsum(hit)])
                for d in np.flatnonzero(np.diff(count[offs]) >= own.least(k, np.diff(offs))).tolist():
                    if w.counts[d] >= k:
                        n = int(offs[d + 1] - offs[d])
                        found += [(d, k, i, int(w.counts[d]), (i, j) == (0, n), sh[offs[d] + i : offs[d] + j].tobytes()) for i, j in own.regions(k, hit[offs[d] : offs[d + 1]])]
            if found:
                d, *cols = zip(*found, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([row + i for i in d], pa.int64()), b.column("id").take(pa.array(d, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["row", "id", "k", "first", "words", "whole", "shingles"])
            row += b.num_rows

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"row long, id {kind}, k long, first long, words long, whole boolean, shingles binary")


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, chunk: int = 10_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, item, similarity, first_word, n_words: a row for each document and item that it leaks."""
    kind, item_kind = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = f"id {kind.simpleString()}, item {item_kind.simpleString()}, similarity double, first_word long, n_words long"
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).alias("t")).filter(F.col("t").isNotNull())
    own = item_filter(items, k, threshold)
    if own is None:
        return docs.sparkSession.createDataFrame([], schema).withColumnsRenamed({"id": id_col, "item": item_col})
    places = table(regions(docs, own, id_col, text_col), "regions")
    count, size, chunks = *places.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("shingles")), F.lit(0))).first(), max(1, -(-items.count() // chunk))
    cells = max(1, -(-size // CELL_BYTES), min(docs.sparkSession.sparkContext.defaultParallelism, -(-count // CELL_ROWS)))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = places.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)).cast("long")).withColumn("chunk", upto(chunks))
    right = items.withColumn("chunk", F.pmod(F.xxhash64("i", "t"), F.lit(chunks)).cast("long")).withColumn("cell", upto(cells))
    id_type, item_type = to_arrow_type(kind), to_arrow_type(item_kind)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        best: dict[tuple[int, int], tuple] = {}
        if left.num_rows and right.num_rows:
            chunk_ = index(sorted(zip(right.column("i").to_pylist(), right.column("t").to_pylist(), strict=True), key=str), k)
            for n, (row, of, first, words, whole, sh) in enumerate(zip(*(left.column(c).to_pylist() for c in ("row", "k", "first", "words", "whole", "shingles")), strict=True)):
                for i, s, at in chunk_.search({of: np.frombuffer(sh, U64)}, threshold, whole):
                    best[row, i] = max(best.get((row, i), (0.0,)), (s, -first - at, n, i, min(words, int(chunk_.words[i]))))
        got = [best[key] for key in sorted(best)]
        s, at, n, i, words = zip(*got, strict=True) if got else [()] * 5
        names = pa.array([chunk_.ids[j] for j in i], item_type) if got else pa.array([], item_type)
        return pa.table([left.column("id").combine_chunks().cast(id_type).take(pa.array(n, pa.int64())), names, pa.array(s, pa.float64()), pa.array([-a for a in at], pa.int64()), pa.array(words, pa.int64())], names=["id", "item", "similarity", "first_word", "n_words"])

    left, right = (side.repartition(chunks * cells, "chunk", "cell") for side in (left, right))  # so many tasks, however few bytes
    found = table(left.groupBy("chunk", "cell").cogroup(right.groupBy("chunk", "cell")).applyInArrow(meet, schema), "leaks")
    discard(places)
    return found.withColumnsRenamed({"id": id_col, "item": item_col})
