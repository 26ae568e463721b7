"""Quality by compression: two zstandard dictionaries, one of good and one of bad labelled text.

A text is compressed whole with either dictionary. The normalised difference of the two sizes, (good - bad) / (good + bad), says which
class it resembles, and grows clearer with the length. Texts that neither dictionary explains (noise) or that compress far too
well (repetition) have sizes near each other, so three terms of the smaller size's ratio to the text, and the length, go beside it. A
logistic curve fitted on labelled rows that built no dictionary calibrates all into the score. ``ratio=False`` leaves the difference
and its product with the length alone (figures in the README).

Defined results: a null text is the empty text and has the score of a text of no length. Ties and repeated rows give equal scores.
Two labels of one id: the majority, none if they are even. Without labelled rows of both classes the score is the share of label 1, or
0.5 without any.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semirix.llm._store import discard, labelled_texts, majority, sampled
from semirix.llm._text import blocks

LEVEL = 3


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Weights (the last is the intercept) by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    weights: np.ndarray | None
    mean: np.ndarray | None
    scale: np.ndarray | None
    prior: float
    raw: bool = True
    ratio: bool = True

    def features(self, texts: list[bytes]) -> np.ndarray:
        kind = zstandard.DICT_TYPE_RAWCONTENT if self.raw else zstandard.DICT_TYPE_FULLDICT
        tools = []
        for d in (self.good, self.bad):
            own = zstandard.ZstdCompressionDict(d, dict_type=kind)
            own.precompute_compress(level=LEVEL)
            tools.append(zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_dict_id=False))
        sizes = np.array([[z.compress(t).__len__() for z in tools] for t in texts], float).reshape(-1, 2)
        n = np.fromiter(map(len, texts), float, len(texts))
        g, b = sizes[:, 0], sizes[:, 1]
        d, r = (g - b) / np.maximum(g + b, 1), np.minimum(g, b) / np.maximum(n, 8)
        size = np.log1p(n)
        if not self.ratio:
            return np.column_stack([d, d * size])
        # one column for each part of the ratio's range: both very low and very high ratios are odd
        return np.column_stack([d, d * size, r, r * r, np.maximum(0, 0.15 - r), np.maximum(0, r - 0.5), size])

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), self.prior)
        x = (self.features(texts) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _dictionaries(good: list[bytes], bad: list[bytes], size: int) -> tuple[bytes, bytes, bool]:
    """Both trained by zstandard's cover of the texts; if a class has too little text for that, both are the texts themselves."""
    try:
        return *(zstandard.train_dictionary(size, texts, k=256, d=8, level=LEVEL).as_bytes() for texts in (good, bad)), False
    except zstandard.ZstdError:
        return *(b"\n".join(texts)[-size:] for texts in (good, bad)), True


def fit(rows: list[tuple[int, str]], size: int = 112 << 10, ratio: bool = True) -> CompressionModel:
    """rows: (label, text). Half of each class builds the dictionaries, the other half calibrates."""
    by = {k: [t.encode() for y, t in rows if y == k] for k in (0, 1)}
    prior = len(by[1]) / len(rows) if rows else 0.5
    if min(map(len, by.values())) < 4:
        return CompressionModel(b"", b"", None, None, None, prior)
    build, rest = {k: v[::2] for k, v in by.items()}, {k: v[1::2] for k, v in by.items()}
    good, bad, raw = _dictionaries(build[1], build[0], size)
    model = CompressionModel(good, bad, None, None, None, prior, raw, ratio)
    x = model.features([*rest[1], *rest[0]])
    y = np.r_[np.ones(len(rest[1])), np.zeros(len(rest[0]))]
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.weights = logistic((x - model.mean) / model.scale, y)
    return model


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, per_class: int, class_chars: int, least: int) -> list[tuple[int, str]]:
    """(label, text) of a bounded sample of each label, by a hash of the id.

    The labels are sampled first, so what is broadcast to the documents has ``per_class`` rows of each class.
    """
    parts = sampled(majority(labels, id_col, label_col), F.col("_y"), "_id", per_class).select("_id", "_y", "_draw")
    found = labelled_texts(docs, parts, id_col, text_col, class_chars, least)
    got = sorted(((r["_id"], r["_y"], r["_text"]) for r in found.collect()), key=lambda r: (str(r[0]), r[1]))
    discard(found)
    return [(y, t) for _, y, t in got]


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = 2000, class_chars: int = 32 << 20, least: int = 50, ratio: bool = True,
) -> CompressionModel:
    """Fit on ``per_class`` labelled rows of either class at most, with whole texts of ``class_chars`` characters in all of each class at
    most, save that ``least`` rows of each stay."""
    return fit(labelled(docs, labels, label_col, id_col, text_col, per_class, class_chars, least), ratio=ratio)


def classify(docs: DataFrame, model: CompressionModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted: a row for each row of ``docs``."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        for b in blocks(batches):
            texts = pc.fill_null(b.column("text"), "").cast(pa.large_binary()).to_pylist()
            s = model.score(texts)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)
