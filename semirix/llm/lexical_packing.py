"""Retrieval packing: each window is filled with the seed document's nearest unused neighbours under BM25.

The terms are the token ids. Documents are routed to shards by their content: a tree of two-way splits, fitted on ``sample``
documents, halves the space of projected TF-IDF vectors until a leaf has about a quarter of a shard of tokens, and the leaves are
numbered so that like leaves are neighbours. All texts are tokenized once into a table of ids with their leaf and a weighted MinHash,
and range-sorted by these (and a hash of the row, so that any number of copies is split), so copies, near copies and texts of one
topic lie side by side; partitions of about ``shard`` tokens are the shards of the index. The document frequencies of all
documents, summed by Spark, are one vector of the vocabulary's size. Each task builds the inverted index of its shard (postings with
BM25 weights from the corpus-wide statistics) and packs it, scoring the shard's documents on all terms of the seed: the longest
unused document is the seed; it fills windows of its own while it can; of its unused neighbours, ``ranks`` at a time in falling
score, each that fits follows whole, and where none fits the best of them is cut at the window's end and goes on later.
So all windows of a shard but the last are full; the last tokens of a shard form sequences whose lengths are powers of two, which
need no padding.

Limit: a seed's neighbours come from its own shard, as the cost of a search of all shards grows with the square of the corpus. How
many of the nearest neighbours lie there is the recall in the README; ``search`` gives the exact neighbours of a stated set of
seeds in all shards, to measure it by.

Defined results: a null or empty text is its end id alone. Null ids of documents are carried. Repeated rows are packed each.
Neighbours with equal scores go in the shard's order; a document without any neighbour takes unused ones in that order.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from semirix.llm._store import discard, table
from semirix.llm._text import blocks, released
from semirix.llm.tokens import ended, shards, tokenizer

K1, B = 1.2, 0.75
DIMENSIONS = 128


@dataclass
class Router:
    """Leaves of a tree of two-way splits over projected TF-IDF vectors. below[node] are its two children; -1 - leaf is a leaf."""

    idf: np.ndarray
    normal: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMENSIONS), np.float32))
    offset: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    below: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))

    def __post_init__(self) -> None:
        rng = np.random.default_rng(41)
        self._signs = (rng.integers(0, 2, (len(self.idf), DIMENSIONS), np.int8) * 2.0 - 1) * self.idf[:, None]
        self._signs = self._signs.astype(np.float32)
        self._tf = (1 + np.log(np.arange(1, 1 << 16))).astype(np.float32)
        self._draw = rng.exponential(size=len(self.idf)) / self.idf**2

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def vectors(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """A unit vector of each document, and its MinHash: a term drawn with a chance in proportion to its squared weight."""
        out, low = np.zeros((len(ids), DIMENSIONS), np.float32), np.zeros(len(ids), np.int64)
        for d, x in enumerate(ids):
            u, tf = np.unique(x, return_counts=True)
            v = self._tf[np.minimum(tf, len(self._tf)) - 1] @ self._signs[u]
            out[d] = v / max(float(np.sqrt(v @ v)), 1e-9)
            low[d] = u[self._draw[u].argmin()]
        return out, low

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.offset) else np.full(len(x), -1, np.int64)
        while (inner := np.flatnonzero(at >= 0)).size:
            n = at[inner]
            at[inner] = self.below[n, ((x[inner] * self.normal[n]).sum(axis=1) > self.offset[n]).astype(np.int64)]
        return -1 - at


def grown(idf: np.ndarray, x: np.ndarray, weight: np.ndarray, most: float, least: int = 8) -> Router:
    """Splits by two-means along the main direction, until a leaf weighs ``most`` or has fewer than 2 * ``least`` rows."""
    rng, normal, offset, below, made = np.random.default_rng(43), [], [], [], 0

    def split(own: np.ndarray) -> tuple[np.ndarray, float, np.ndarray] | None:
        if len(own) < 2 * least or weight[own].sum() <= most:
            return None
        y = x[own] - x[own].mean(axis=0)
        v = rng.normal(size=DIMENSIONS).astype(np.float32)
        for _ in range(8):
            v = y.T @ (y @ v)
            v /= max(float(np.sqrt(v @ v)), 1e-12)
        side = y @ v > 0
        for _ in range(8):
            if side.all() or not side.any():
                return None
            a, b = x[own][side].mean(axis=0), x[own][~side].mean(axis=0)
            n, o = a - b, float(a @ a - b @ b) / 2
            side = x[own] @ n > o
        return None if min(side.sum(), (~side).sum()) < least else (n, o, side)

    todo = [(np.arange(len(x)), None)]
    while todo:  # depth first, the near side first, so that leaves are numbered from left to right
        own, parent = todo.pop()
        got = split(own)
        if got is None:
            name, made = -1 - made, made + 1
        else:
            name = len(offset)
            normal.append(got[0])
            offset.append(got[1])
            below.append([0, 0])
            todo += [(own[got[2]], (name, 1)), (own[~got[2]], (name, 0))]
        if parent:
            below[parent[0]][parent[1]] = name
    return Router(idf, np.array(normal, np.float32), np.array(offset, np.float32), np.array(below, np.int64)) if offset else Router(idf)


def _idf(df: np.ndarray, total: int) -> np.ndarray:
    return np.log1p((total - df + 0.5) / (df + 0.5))


def router(docs: DataFrame, path: str, last: int, shard: int, sample: int, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> Router:
    """Fitted on about ``sample`` rows; what comes to the driver has a vector for each of them."""
    rows = docs.count()
    some = table(encode(docs.sample(fraction=min(1.0, sample / max(1, rows)), seed=17), path, last, None, pattern, id_col, text_col), "route-sample")
    width, size = tokenizer(path, pattern).width, tokenizer(path, pattern).total
    df, n, _ = statistics(some, width)
    plain = Router(_idf(np.pad(df, (0, max(0, size + 1 - len(df)))), n))

    def run(batches):
        for b in batches:
            x, _ = plain.vectors([np.frombuffer(i.as_buffer(), width) for i in b.column("ids")])
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary()), b.column("n")], ["x", "n"])

    got = sorted(tuple(r) for r in some.select("n", "ids").mapInArrow(released(run), "x binary, n long").collect())
    discard(some)
    if not got:
        return plain
    x, weight = np.frombuffer(b"".join(r[0] for r in got), np.float32).reshape(len(got), -1), np.array([r[1] for r in got], float)
    return grown(plain.idf, x, weight * rows / len(got), shard / 4)


def encode(docs: DataFrame, path: str, last: int, route: Router | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n, ids (little-endian, 2 bytes each if the vocabulary allows, else 4), leaf, low: a row for each row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        tool = tokenizer(path, pattern)
        for b in blocks(batches, size=2 << 20):
            ids, offs = ended(*tool.encode(b.column("text")), last)
            parts = [ids[x:y] for x, y in zip(offs[:-1], offs[1:], strict=True)]
            leaf = low = np.zeros(len(parts), np.int64)
            if route is not None:
                x, low = route.vectors(parts)
                leaf = route.leaves(x)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(offs)), pa.array([x.tobytes() for x in parts], pa.binary()), pa.array(leaf), pa.array(low)], ["id", "n", "ids", "leaf", "low"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(released(run), f"id {kind}, n long, ids binary, leaf long, low long")


def statistics(encoded: DataFrame, width: type) -> tuple[np.ndarray, int, float]:
    """Document frequency of each token id, documents, and mean length, over all documents."""

    def run(batches):
        df = np.zeros(0, np.int64)
        for b in batches:
            for x in b.column("ids"):
                u = np.unique(np.frombuffer(x.as_buffer(), width))
                if len(u) and u[-1] >= len(df):
                    df = np.concatenate([df, np.zeros(int(u[-1]) + 1 - len(df), np.int64)])
                df[u] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    rows = encoded.select("ids").mapInArrow(released(run), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()  # the vocabulary at most
    out = np.zeros(int(rows["term"].max()) + 1 if len(rows) else 1, np.int64)
    out[rows["term"].to_numpy(np.int64)] = rows["df"]
    n, mean = encoded.agg(F.count(F.lit(1)), F.avg("n")).first()
    return out, n, float(mean or 1.0)


class Index:
    """The inverted index of a shard with BM25 weights. Terms of an eighth of the documents or more have a full row, others a list."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        docs, weights = [], []
        self.terms = []
        for d, x in enumerate(ids):
            u, tf = np.unique(x, return_counts=True)
            self.terms.append(u.astype(np.int64))
            docs.append(np.full(len(u), d))
            weights.append(idf[u] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(x) / mean)))
        term, doc, weight = np.concatenate(self.terms), np.concatenate(docs), np.concatenate(weights)
        size = np.bincount(term, minlength=len(idf))
        heavy = np.flatnonzero(size * 8 >= max(8, len(ids)))
        self.row, self.count = np.full(len(idf), -1), len(ids)
        self.row[heavy] = np.arange(len(heavy))
        self.full = np.zeros((len(heavy), len(ids)), np.float32)
        row = self.row[term]
        self.full[row[row >= 0], doc[row >= 0]] = weight[row >= 0]
        order = np.argsort(term[row < 0], kind="stable")
        self.doc, self.weight = doc[row < 0][order], weight[row < 0][order]
        self.ptr = np.concatenate([[0], np.cumsum(np.where(self.row < 0, size, 0))])
        self.names = np.arange(len(ids))  # of the rows' columns

    def without(self, gone: np.ndarray) -> None:
        """Takes documents out."""
        keep = ~gone[self.doc]
        self.ptr = np.concatenate([[0], np.cumsum(keep)])[self.ptr]
        self.doc, self.weight = self.doc[keep], self.weight[keep]
        keep = ~gone[self.names]
        self.names, self.full = self.names[keep], np.ascontiguousarray(self.full[:, keep])

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """Of all documents, for these terms, each once."""
        row = self.row[terms]
        light, out = terms[row < 0], np.zeros(self.count)
        out[self.names] = np.ones((row >= 0).sum(), np.float32) @ self.full[row[row >= 0]]
        lists = [slice(x, y) for x, y in zip(self.ptr[light].tolist(), self.ptr[light + 1].tolist(), strict=True) if x < y]
        if lists:
            out += np.bincount(np.concatenate([self.doc[x] for x in lists]), np.concatenate([self.weight[x] for x in lists]), self.count)
        return out


def _plan(ids: list[np.ndarray], df: np.ndarray, total: int, mean: float, length: int, ranks: int = 48) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length); every id is in one piece."""
    count = len(ids)
    index = Index(ids, _idf(df, total), mean)
    size = np.array([len(x) for x in ids])
    at, unused = np.zeros(count, np.int64), np.ones(count, bool)
    seeds = iter(np.argsort(-size, kind="stable").tolist())
    out: list[list[tuple[int, int, int]]] = []
    spare = 0  # all before are used
    open_ = count  # documents in the index

    def put(d: int, most: int) -> tuple[int, int, int]:
        n = int(min(most, size[d] - at[d]))
        piece = (d, int(at[d]), n)
        at[d] += n
        unused[d] = at[d] < size[d]
        return piece

    for d in seeds:
        score = None
        while unused[d]:
            window = [put(d, length)]
            free = length - window[0][2]
            while free:
                if score is None:
                    if unused.sum() < 0.7 * open_:  # used documents leave the index now and then
                        index.without(~unused)
                        open_ = int(unused.sum())
                    score = index.scores(index.terms[d])
                score[~unused] = 0  # for good: a used document stays used
                found = np.flatnonzero(score)
                if len(found) > ranks:
                    found = np.sort(found[np.argpartition(-score[found], ranks)[:ranks]])
                found = found[np.argsort(-score[found], kind="stable")]
                if not len(found):
                    while spare < count and not unused[spare]:
                        spare += 1
                    if spare == count:
                        break
                    found = np.array([spare])
                for c in found:
                    if size[c] - at[c] <= free:
                        window.append(put(int(c), free))
                        free -= window[-1][2]
                        if not free:
                            break
                rest = [int(c) for c in found if unused[c]]
                if free and rest:
                    window.append(put(rest[0], free))
                    free = 0
            out.append(window)
    tail = out.pop() if out and sum(p[2] for p in out[-1]) < length else []
    while tail:  # sequences of 2 ** k ids
        free = 1 << (sum(p[2] for p in tail).bit_length() - 1)
        row = []
        while free:
            d, s, n = tail.pop(0)
            m = min(n, free)
            row.append((d, s, m))
            free -= m
            if m < n:
                tail.insert(0, (d, s + m, n - m))
        out.append(row)
    return out


def pack(docs: DataFrame, path: str, last: int, length: int = 4096, shard: int = 2 << 20, sample: int = 4096, ranks: int = 48, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece.

    ``ranks``: how many of the best unused neighbours are tried for a whole fit at a time, before the best of them is cut.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    encoded = table(encode(docs, path, last, router(docs, path, last, shard, sample, pattern, id_col, text_col), pattern, id_col, text_col), "ids")
    width = tokenizer(path, pattern).width
    df, total, mean = statistics(encoded, width)
    parts = max(1, round(total * mean / shard)) if total else 1

    def run(batches):
        task, made = TaskContext.get().partitionId() << 40, 0
        for part in shards(batches, 2 * shard):
            names = pa.concat_arrays([b.column("id") for b in part])
            ids = [np.frombuffer(x.as_buffer(), width) for b in part for x in b.column("ids")]
            rows = []
            for window in _plan(ids, df, total, mean, length, ranks):
                offset = 0
                for d, s, n in window:
                    rows.append((d, s, n, zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()), len(ids[d]), task | made, offset))
                    offset += n
                made += 1
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(cols[0], pa.int64())), *[pa.array(c, pa.int64()) for c in cols[1:]]], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    order = ("leaf", "low", "salt")
    routed = encoded.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "n", "ids")
    out = routed.mapInArrow(released(run), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def search(docs: DataFrame, seeds: DataFrame, path: str, last: int, k: int = 10, shard: int = 2 << 20, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """seed, id, score: the ``k`` documents with the greatest BM25 for all terms of each row of ``seeds``, among all of ``docs``.

    Exact: each task scores every seed on the inverted index of each of its shards, and the shards' best are merged. The seeds are a stated
    query set that fits the driver. A document isn't its own neighbour; equal scores go by id; documents without a common term aren't found.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    encoded = table(encode(docs, path, last, None, pattern, id_col, text_col), "ids")
    width = tokenizer(path, pattern).width
    df, total, mean = statistics(encoded, width)
    asked = [(r["id"], np.unique(np.frombuffer(r["ids"], width)).astype(np.int64)) for r in encode(seeds, path, last, None, pattern, id_col, text_col).select("id", "ids").collect()]

    def run(batches):
        for part in shards(batches, shard):
            names = pa.concat_arrays([b.column("id") for b in part]).to_pylist()
            ids = [np.frombuffer(x.as_buffer(), width) for b in part for x in b.column("ids")]
            index = Index(ids, _idf(df, total), mean)
            for seed, terms in asked:
                score = index.scores(terms[terms < len(df)])
                least = np.partition(score, -k - 1)[-k - 1] if len(score) > k else 0.0  # with all that tie with the last, and the seed
                found = [(seed, names[i], float(score[i])) for i in np.flatnonzero((score >= least) & (score > 0)).tolist() if names[i] != seed]
                if found:
                    a, b, c = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, id_type), pa.array(b, id_type), pa.array(c)], ["seed", "id", "score"])

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    found = encoded.select("id", "n", "ids").mapInArrow(released(run), f"seed {kind}, id {kind}, score double")
    best = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "id"))
    return found.withColumn("_rank", best).filter(F.col("_rank") <= k).drop("_rank").withColumnRenamed("id", id_col)
