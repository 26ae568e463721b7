"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

One model per language. Each order's n-grams of all languages are one sorted array of hashes; beside each hash stand the languages that
have the n-gram, with two weights: what the language's log-probability gains by it over its back-off, and the back-off weight of the
n-gram as a context. The log-probability of a position is the sum of the weights of the n-grams that end there, of the contexts before
it, and a constant, so a text's cross-entropy under all languages is a sum over its positions and only pairs of n-gram and
language that occur are stored. Orders with few n-grams are spread out into a matrix in the worker, up to ``DENSE`` bytes.
A text goes to the language with the lowest length-normalised cross-entropy. Rejection is calibrated on rows kept out of the counts:
``accepted`` is false where the cross-entropy is above the 1 - ``reject`` quantile of that language's own texts, or the margin to the
second language below the ``reject`` quantile of texts told right.

Defined results: a null text, an empty one or one without a letter gives ``und``, score 0, not accepted. Ties go to
the language first in order. Repeated rows give repeated results. Without any training row all texts give ``und``.
Other columns are not read. Texts are scored whole, in any length, in segments of SEGMENT characters that carry their context on.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semirix.llm._store import sampled
from semirix.llm._text import U64, blocks, mix

UND = "und"
#: Characters that are scored at a time, floats of a step, and bytes of an order's matrix.
SEGMENT, CELLS, DENSE = 1 << 19, 1 << 22, 64 << 20
_TABLE: np.ndarray | None = None


def _classes() -> np.ndarray:
    """Code point -> character class: letters in lower case, the pad as 1, all else one separator, 2."""
    global _TABLE
    if _TABLE is None:
        t = np.full(0x110000, 2, np.uint32)
        for start, stop in ((0, 0x20000), (0x20000, 0x32000)):
            for c in range(start, stop):
                ch = chr(c)
                if ch.isalpha():
                    low = ch.lower()
                    t[c] = ord(low[0]) if low else c
        t[0] = 1
        _TABLE = t
    return _TABLE


def _encode(texts: list[str], order: int, before: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts, each after order - 1 pads, separators run together; and each text's n + 1 offsets. ``before``: the class
    before the first text, which a separator joins."""
    pad = "\x00" * (order - 1)
    joined = pad + pad.join(t.replace("\x00", " ") for t in texts)
    c = _classes()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 2) | (c[:-1] != 2)
    if before == 2 and len(c) >= order and c[order - 1] == 2:
        keep[order - 1] = False
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + order - 1
    kept = np.concatenate([[0], np.cumsum(keep)])
    return c[keep], kept[np.concatenate([[0], np.cumsum(sizes)])]


def _rolling(c: np.ndarray, order: int) -> list[np.ndarray]:
    """hash[n][i]: of the n classes that end at i. hash[0] is constant."""
    term = mix(c.astype(U64) + U64(0x1234567))
    out, total, power = [np.zeros(len(c), U64)], np.zeros(len(c), U64), U64(1)
    for k in range(order):
        shifted = np.zeros(len(c), U64)
        shifted[k:] = term[: len(c) - k]
        total = total + shifted * power
        power = U64((int(power) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        out.append(total.copy())
    return out


@dataclass
class Grams:
    """The n-grams of one order: sorted hashes; entries ptr[i] to ptr[i + 1] are the languages of hash i with their two weights."""

    keys: np.ndarray
    ptr: np.ndarray
    language: np.ndarray
    gain: np.ndarray
    back: np.ndarray

    @classmethod
    def merged(cls, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Grams:
        """parts: each language's hashes, gains and back-off weights."""
        keys, language = np.concatenate([k for k, _, _ in parts]), np.repeat(np.arange(len(parts)), [len(k) for k, _, _ in parts])
        order = np.argsort(keys, kind="stable")
        u, first = np.unique(keys[order], return_index=True)
        gain, back = (np.concatenate([p[i] for p in parts])[order].astype(np.float32) for i in (1, 2))
        return cls(u, np.append(first, len(keys)), language[order].astype(np.int16), gain, back)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def nbytes(self) -> int:
        return sum(v.nbytes for v in self.__getstate__().values())

    def _ready(self, width: int) -> None:
        """Where the hashes of each leading bit pattern begin; and the weights as matrices, if they are small."""
        bits = int(len(self.keys)).bit_length() + 2
        self._shift = U64(64 - bits)
        self._start = np.searchsorted(self.keys, np.arange(1 << bits, dtype=U64) << self._shift).astype(np.int32)
        self._end = np.append(self.keys, ~U64(0))  # a hash that isn't found goes past the last
        self._matrix = None
        if 8 * (len(self.keys) + 1) * width <= DENSE:  # gain and both; the last row is that of what isn't found
            self._matrix = np.zeros((2, len(self.keys) + 1, width), np.float32)
            row = np.repeat(np.arange(len(self.keys)), np.diff(self.ptr))
            self._matrix[0, row, self.language], self._matrix[1, row, self.language] = self.gain, self.gain + self.back

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each hash, len(keys) where there is none: a few steps from where its leading bits begin."""
        at = self._start[(wanted >> self._shift).astype(np.int64)]
        key = self._end[at]
        open_ = np.flatnonzero(key < wanted)
        while len(open_):
            at[open_] += 1
            key[open_] = k = self._end[at[open_]]
            open_ = open_[(k < wanted[open_]) & (at[open_] < len(self.keys))]
        at[key != wanted] = len(self.keys)
        return at

    def add(self, out: np.ndarray, own: np.ndarray, h: np.ndarray, at: np.ndarray, contexts: bool) -> None:
        """Adds the weights of the n-grams at the places ``at`` of h, and of the contexts before them, to out[own]."""
        if not hasattr(self, "_start"):
            self._ready(out.shape[1])
        low = int(at[0]) - 1
        found = self.find(h[low : int(at[-1]) + 1])
        first = np.flatnonzero(np.diff(own, prepend=-1))
        if self._matrix is not None:
            gain, both = self._matrix
            out[own[first]] += np.add.reduceat((both if contexts else gain)[found[at - low]], first, axis=0, dtype=np.float64)
            if contexts:  # a place is the context of the next: the one before the first is counted, the last is not
                before, last = found[at[first] - low - 1], found[at[np.append(first[1:], len(at)) - 1] - low]
                out[own[first]] += (both[before] - gain[before]) - (both[last] - gain[last])
            return
        for place, weight in ((found[at - low], self.gain), (found[at - low - 1], self.back))[: 1 + contexts]:
            hit = np.flatnonzero(place < len(self.keys))
            a, size = self.ptr[place[hit]], self.ptr[place[hit] + 1] - self.ptr[place[hit]]
            flat = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
            cell = np.repeat(own[hit] - own[0], size) * out.shape[1] + self.language[flat]
            part = np.bincount(cell, weight[flat], int(own[-1] - own[0] + 1) * out.shape[1])
            out[own[0] : own[-1] + 1] += part.reshape(-1, out.shape[1])


@dataclass
class LanguageModel:
    """grams[n - 1]: those of order n; floor: log-probability of an unseen character by language."""

    languages: list[str]
    order: int
    grams: list[Grams] = field(default_factory=list)
    floor: np.ndarray | None = None
    limit: np.ndarray | None = None
    margin: float = 0.0
    heat: float = 4.0

    def nbytes(self) -> int:
        return sum(g.nbytes() for g in self.grams)

    def _sums(self, c: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log-probability of each text under each language, and the characters scored: all but the first order - 1 classes."""
        out = np.zeros((len(offs) - 1, len(self.languages)))
        size = np.maximum(np.diff(offs) - self.order + 1, 0)
        if not size.any():
            return out, size
        h = _rolling(c, self.order)
        own = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(own)) + np.repeat(offs[:-1] + self.order - 1 - np.cumsum(size) + size, size)
        step = max(1, CELLS // len(self.languages))
        for n, grams in enumerate(self.grams, 1):
            for i in range(0, len(at), step):
                if len(grams.keys):
                    grams.add(out, own[i : i + step], h[n], at[i : i + step], n < self.order)
        return out + size[:, None] * self.floor, size

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Bits per character of each text under each language; a text without characters has 0."""
        total, size = self._sums(*_encode([t if len(t) <= SEGMENT else "" for t in texts], self.order))
        for i, t in enumerate(texts):
            if len(t) > SEGMENT:
                carry = np.ones(self.order - 1, np.uint32)
                for a in range(0, len(t), SEGMENT):
                    c, _ = _encode([t[a : a + SEGMENT]], self.order, int(carry[-1]) if len(carry) else 1)
                    c[: self.order - 1] = carry
                    part, n = self._sums(c, np.array([0, len(c)]))
                    total[i] += part[0]
                    size[i] += n[0]
                    carry = c[len(c) - self.order + 1 :]
        return -total / np.maximum(size, 1)[:, None]

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language's index, its posterior, its cross-entropy, and whether the calibrated rejection accepts it."""
        e = self.entropies(texts)
        best = e.argmin(axis=1)
        low = e[np.arange(len(e)), best]
        post = np.exp(-self.heat * (e - low[:, None]))
        score = 1.0 / post.sum(axis=1)
        second = np.partition(e, 1, axis=1)[:, 1] if e.shape[1] > 1 else np.full(len(e), np.inf)
        return best, score, low, (low <= self.limit[best]) & (second - low >= self.margin)


def _counted(texts: list[str], order: int) -> list[tuple]:
    """Of each order from 1: sorted hashes, counts (below the highest order of different n-grams before), context and suffix hashes."""
    c, offs = _encode(texts, order)
    h = _rolling(c, order)
    use = np.ones(len(c), bool)
    for k in range(order - 1):
        use[np.minimum(offs[:-1] + k, len(c) - 1)] = False
    at = np.flatnonzero(use)
    u, first, n = np.unique(h[order][at], return_index=True, return_counts=True)
    place, out = at[first], []
    for m in range(order, 0, -1):
        out.append((u, n.astype(np.float64), h[m - 1][place - 1] if m > 1 else np.zeros(len(u), U64), h[m - 1][place]))
        if m > 1:  # continuation counts: each different n-gram counts once for its suffix
            u, first, n = np.unique(h[m - 1][place], return_index=True, return_counts=True)
            place = place[first]
    return out[::-1]


def _weights(counted: list[tuple], letters: int) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], float]:
    """Of each order: hashes, gains and back-off weights of one language; and its log-probability of an unseen character."""
    out, floor, lower, below = [], 0.0, np.zeros(0), np.zeros(0, U64)
    for m, (u, n, ctx, suffix) in enumerate(counted, 1):
        once, twice = (n == 1).sum(), (n == 2).sum()
        d = min(0.95, max(0.1, once / max(1.0, once + 2.0 * twice)))
        heads, inv = np.unique(ctx, return_inverse=True)
        total, kinds = np.bincount(inv, n), np.bincount(inv)
        back = d * kinds / total
        base = lower[np.searchsorted(below, suffix)] if m > 1 else np.full(len(u), 1.0 / letters)
        p = (n - d) / total[inv] + back[inv] * base
        gain = np.log2(p) - np.log2(back[inv] * base)
        if m == 1:
            floor = float(np.log2(back[0] / letters))
        else:  # the contexts are n-grams of the order below, or begin with a pad and are contexts only
            k, g, _ = out[-1]
            keys = np.union1d(k, heads)
            both = np.zeros((2, len(keys)))
            both[0, np.searchsorted(keys, k)], both[1, np.searchsorted(keys, heads)] = g, np.log2(back)
            out[-1] = keys, both[0], both[1]
        out.append((u, gain, np.zeros(len(u))))
        lower, below = p, u
    return out, floor


def fit(rows: list[tuple[str, str]], order: int = 5, holdout: int = 10, reject: float = 0.01) -> LanguageModel | None:
    """rows: (language, text). Every ``holdout``-th row of a language calibrates and isn't counted."""
    rows = [(a, b) for a, b in rows if a is not None and b]
    languages = sorted({a for a, _ in rows})
    if not languages:
        return None
    counted, kept = [], []
    for a in languages:
        own = [t for b, t in rows if b == a]
        out = range(holdout - 1, len(own), holdout) if len(own) >= 2 * holdout else range(0)
        kept += [(a, own[i]) for i in out]
        counted.append(_counted([t for i, t in enumerate(own) if i not in out], order))
    letters = max(2, len(np.unique(np.concatenate([c[0][0] for c in counted]))) + 1)
    weights = [_weights(c, letters) for c in counted]
    model = LanguageModel(languages, order, [Grams.merged([w[m] for w, _ in weights]) for m in range(order)], np.array([f for _, f in weights]))
    width, kept = len(languages), kept or rows
    e = model.entropies([t for _, t in kept])
    true = np.array([languages.index(a) for a, _ in kept])
    own = e[np.arange(len(e)), true]
    model.limit = np.array([np.quantile(own[true == l], 1 - reject) if (true == l).any() else own.max() for l in range(width)])
    if width > 1:
        second, right = np.sort(e, axis=1)[:, 1] - e.min(axis=1), e.argmin(axis=1) == true
        model.margin = float(max(0.0, np.quantile(second[right], reject))) if right.any() else 0.0

        def loss(t: float) -> float:
            z = -t * (e - e.min(axis=1, keepdims=True))
            return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), true]))

        model.heat = min((0.5, 1, 2, 4, 8, 16), key=loss)
    return model


def train(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 500, max_chars: int = 20_000, total_chars: int = 10_000_000, least: int = 8, order: int = 5,
    reject: float = 0.01, max_bytes: int = 256 << 20,
) -> LanguageModel | None:
    """Fit on ``per_language`` rows with a letter of each language at most, chosen by a hash of the id; of a text longer than ``max_chars``,
    on that many characters from a place that the hash chooses.

    Over all languages these are ``total_chars`` characters at most, save that ``least`` rows of each language stay. So the model has
    a fixed size at any number of rows; one beyond ``max_bytes`` isn't shipped but an error.
    """
    rows = labelled.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    got = sampled(rows.filter(F.col("_text").rlike(r"\p{L}")), F.col("_lang"), "_id", per_language)
    size = F.length("_text")
    start = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.greatest(size - max_chars, F.lit(1))) + 1
    got = got.select("_lang", F.when(size > max_chars, F.substring("_text", start.cast("int"), F.lit(max_chars))).otherwise(F.col("_text")).alias("_text"), "_draw").collect()
    by: dict[str, list] = {}
    for r in sorted((r["_lang"], r["_draw"], r["_text"]) for r in got):
        by.setdefault(r[0], []).append(r[2])
    share = total_chars // max(1, len(by))
    kept = [(a, t) for a, own in by.items() for i, t in enumerate(own) if i < least or sum(map(len, own[: i + 1])) <= share]
    model = fit(kept, order, reject=reject)
    if model and model.nbytes() > max_bytes:
        raise ValueError(f"the model has {model.nbytes()} bytes; bound total_chars or raise max_bytes")
    return model


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, cross_entropy, accepted: a row for each row of ``docs``."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if model is None:
        return rows.select(F.col("id").alias(id_col), F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cross_entropy"), F.lit(False).alias("accepted"))

    def run(batches):
        for b in blocks(batches, size=1 << 17):  # what a step holds stays in the processor's cache
            best, score, low, ok = model.predict(pc.fill_null(b.column("text"), "").to_pylist())
            has = b.column("letters").to_numpy(zero_copy_only=False)
            names = [model.languages[i] if x else UND for i, x in zip(best, has, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(names, pa.string()), pa.array(np.where(has, score, 0.0)), pa.array(np.where(has, low, 0.0)), pa.array(ok & has)], ["id", "lang_pred", "score", "cross_entropy", "accepted"])

    out = rows.mapInArrow(run, f"id {kind.simpleString()}, lang_pred string, score double, cross_entropy double, accepted boolean")
    return out.withColumnRenamed("id", id_col)
