"""Toxicity by a lexicon, met even where misspelled, and by the words around each hit.

The lexicon is learned from a bounded sample of labelled rows: words, and open stems (word beginnings), that are far more
frequent in toxic texts than chance allows. It becomes a trie; the Levenshtein automaton of each term's allowed distance is
intersected with the trie and made deterministic, so that all letters of all words step through one table with numpy, and
most words die within a few letters. One or two digits or signs that stand for letters, before a letter, count as these (1d10t).
Each hit is scored in a window of AROUND words on either side: further hits raise the score. A hit is quoted if the nearest
quotation mark before it in the window opens and the nearest behind it closes. A logistic curve, fitted on the labelled sample, weighs the
text's highest window and sum of plain hits, the same of quoted hits, and the shares of hits beside words of report, words of
address and by stem. So what quotation is worth is learned; where no labelled text has a quoted hit, quoted hits count nothing.

Defined results: a null text is the empty text; it and a text without a hit have the score of a text without a hit. Two labels of one id:
the majority, none if they are even. Without labelled rows of both classes the score is 0. Ties and repeated rows give equal scores. Whole
texts are read, those longer than SEGMENT characters in overlapping segments: a window ends MARGIN characters outside its segment.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semirix.llm._store import discard, labelled_texts, majority, sampled
from semirix.llm._text import blocks
from semirix.llm.language_id import _classes
from semirix.llm.quality_classifier import logistic

AROUND, SEEDS = 6, 8
#: Characters that are read at a time, and those read on either side for the windows at its ends.
SEGMENT, MARGIN = 1 << 21, 2000
# Quotation marks that open or close, and signs that stand for letters.
OPENING, CLOSING = "\"“„”«»‹›‘‚", "\"“”»«›‹’"
LOOKS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
# Fixed word lists: report and address, in the four languages of the data.
REPORT = frozenset("said says wrote writes called quote quoted quotes term word insult sagte schrieb nannte zitat wort dit écrit appelé cité mot dijo escribió llamó cita palabra".split())
ADDRESS = frozenset("you your yourself du dich dein ihr sie tu te toi vous votre usted tú ti vosotros".split())


#: Code point (from the last on, all others) -> 1 opens, 2 closes, 4 space, or a sum.
_MARKS = np.zeros(0x2041, np.uint8)
for _bit, _marks in ((1, OPENING), (2, CLOSING), (4, " \t\n\r\x00\x0b\x0c")):
    _MARKS[[ord(c) for c in _marks]] += _bit
_FOLD = np.zeros(129, np.uint32)
_FOLD[[ord(c) for c in LOOKS]] = [ord(c) for c in LOOKS.values()]


def allowed(term: str) -> int:
    """Edits a term may have: none below five letters (a letter changed in a short word is often another word), one below nine, else two."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def folded(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points; letters in lower case with signs that stand for letters as these; and which of them are in words."""
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    low = _classes()[raw]
    word = low > 2
    sign = np.flatnonzero((_FOLD > 0)[np.minimum(raw, 128).astype(np.uint8)])
    if len(sign):  # runs of at most two, with a letter behind
        run = np.cumsum(np.diff(sign, prepend=-2) > 1) - 1
        size, last = np.bincount(run), sign[np.flatnonzero(np.diff(run, append=-1))]
        ok = (size <= 2) & word[np.minimum(last + 1, len(raw) - 1)]
        sign = sign[ok[run]]
        low[sign], word[sign] = _FOLD[raw[sign]], True
    return raw, low, word


def _among(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: frozenset[str]) -> np.ndarray:
    """Which of the words with these bounds are in a short list."""
    size = max(map(len, words))
    table = np.zeros((len(words), size), np.uint32)
    for i, w in enumerate(sorted(words)):
        table[i, : len(w)] = [ord(c) for c in w]
    keys = np.unique(table.view(f"V{4 * size}").ravel())
    out = np.zeros(len(starts), bool)
    for i in range(0, len(starts), 1 << 18):
        a, n = starts[i : i + (1 << 18)], ends[i : i + (1 << 18)] - starts[i : i + (1 << 18)]
        at = np.arange(size)
        own = np.where(at < n[:, None], low[np.minimum(a[:, None] + at, len(low) - 1)], 0).astype(np.uint32)
        out[i : i + (1 << 18)] = np.isin(np.ascontiguousarray(own).view(f"V{4 * size}").ravel(), keys) & (n <= size)
    return out


@dataclass
class Automaton:
    """step[state, letter] -> state; state 0 is dead, 1 the start. kind: 0 none, 1 exact, 2 misspelled, 3 stem."""

    letters: dict[str, int]
    step: np.ndarray
    kind: np.ndarray
    final_stem: np.ndarray

    @classmethod
    def build(cls, words: list[str], stems: list[str]) -> Automaton:
        children, ends, least, stem_at = [{}], [None], [0], [False]

        def add(term: str, stem: bool) -> None:
            at = 0
            for ch in term:
                if ch not in children[at]:
                    children[at][ch] = len(children)
                    children.append({})
                    ends.append(None)
                    stem_at.append(False)
                at = children[at][ch]
            if stem:
                stem_at[at] = True
            else:
                ends[at] = allowed(term)

        for w in words:
            add(w, False)
        for s in stems:
            add(s, True)
        # errors that some term below the node allows: prunes the product
        budget = [0 if e is None else e for e in ends]
        for at in range(len(children) - 1, -1, -1):
            for c in children[at].values():
                budget[at] = max(budget[at], budget[c])
        letters = {ch: i + 1 for i, ch in enumerate(sorted({ch for c in children for ch in c}))}
        other = len(letters) + 1

        def closed(items: dict[int, int]) -> frozenset:
            """Least errors of each trie node, with letters of terms left out in the word."""
            todo = list(items.items())
            while todo:
                at, e = todo.pop()
                if e > items.get(at, 9):
                    continue
                for c in children[at].values():
                    if e + 1 <= budget[c] and e + 1 < items.get(c, 9):
                        items[c] = e + 1
                        todo.append((c, e + 1))
            return frozenset(items.items())

        start = closed({0: 0})
        ids, order, rows = {frozenset(): 0, start: 1}, [frozenset(), start], []
        stem_state: list[bool] = [False, False]
        i = 0
        while i < len(order):
            state, row = order[i], [0] * (other + 1)
            if i:
                row = None
                near = {ch for at, _ in state for ch in children[at]}
                for ch in ["", *sorted(near)]:  # letters that no node here has all step alike
                    to: dict[int, int] = {}
                    for at, e in state:
                        if ch in children[at]:
                            c = children[at][ch]
                            to[c] = min(e, to.get(c, 9))
                        if e + 1 <= budget[at]:
                            to[at] = min(e + 1, to.get(at, 9))  # a letter too many
                        for c in children[at].values():
                            if e + 1 <= budget[c]:
                                to[c] = min(e + 1, to.get(c, 9))  # a wrong letter
                    nxt = closed(to)
                    if nxt not in ids:
                        ids[nxt] = len(order)
                        order.append(nxt)
                        stem_state.append(any(stem_at[at] and e == 0 for at, e in nxt))
                    if not ch:
                        row = [ids[nxt]] * (other + 1)
                    else:
                        row[letters[ch]] = ids[nxt]
            rows.append(row)
            i += 1
        kind = np.zeros(len(order), np.int8)
        for i, state in enumerate(order):
            got = [e for at, e in state if ends[at] is not None and e <= ends[at]]
            if got:
                kind[i] = 1 if min(got) == 0 else 2
        return cls(letters, np.array(rows, np.int32), kind, np.array(stem_state))

    def run(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The kind of each word of letter codes."""
        out = np.zeros(len(starts), np.int8)
        live = np.arange(len(starts))
        state = np.ones(len(starts), np.int32)
        k = 0
        while len(live):
            state = self.step[state, codes[starts[live] + k]]
            k += 1
            stem = self.final_stem[state]
            done = starts[live] + k == ends[live]
            out[live[stem]] = 3
            finished = done & ~stem
            out[live[finished]] = self.kind[state[finished]]
            keep = (state > 0) & ~done & ~stem
            live, state = live[keep], state[keep]
        return out


@dataclass
class ToxicityModel:
    words: list[str]
    stems: list[str]
    weights: np.ndarray | None = None
    automaton: Automaton | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        self.automaton = Automaton.build(self.words, self.stems) if self.words or self.stems else None
        if self.automaton:
            t = np.full(0x110000, len(self.automaton.letters) + 1, np.uint16)
            for ch, i in self.automaton.letters.items():
                t[ord(ch)] = i
            self._alphabet = t

    def features(self, texts: list[str]) -> np.ndarray:
        """Of each text: plain hits' highest window, sum up to a bound and sum in 100 words; quoted hits' highest window and sum; the shares of
        hits with words of report, words of address, and by stem."""
        own = np.zeros((len(texts), 9))  # best and sum of plain hits, of quoted ones; hits, reported, addressed, stems; words
        if self.automaton and texts:
            short = [t if len(t) <= SEGMENT else "" for t in texts]
            size = np.fromiter((len(t) + 1 for t in short), np.int64, len(texts))
            own = self._hits("\x00".join(t.replace("\x00", " ") for t in short) + "\x00", np.concatenate([[0], np.cumsum(size)]), 0, int(size.sum()))
            for i, t in enumerate(texts):
                for a in range(0, len(t) if len(t) > SEGMENT else 0, SEGMENT):
                    lo, hi = max(0, a - MARGIN), min(len(t), a + SEGMENT + MARGIN)
                    part = self._hits(t[lo:hi].replace("\x00", " ") + "\x00", np.array([0, hi - lo + 1]), a - lo, min(a + SEGMENT, len(t)) - lo)[0]
                    own[i] = np.where([1, 0, 1, 0, 0, 0, 0, 0, 0], np.maximum(own[i], part), own[i] + part)
        n = np.maximum(own[:, 4:5], 1)
        return np.column_stack([own[:, 0], np.minimum(own[:, 1], 6), np.minimum(100 * own[:, 1] / np.maximum(own[:, 8], 1), 6), own[:, 2], np.minimum(own[:, 3], 6), own[:, 5:8] / n])

    def _hits(self, joined: str, offs: np.ndarray, low_end: int, high_end: int) -> np.ndarray:
        """The sums of ``features`` over the words that begin in [low_end, high_end), for texts with these offsets."""
        raw, low, word = folded(joined)
        out = np.zeros((len(offs) - 1, 9))
        edge = np.diff(word.astype(np.int8), prepend=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        kinds = self.automaton.run(self._alphabet[low], starts, ends)
        first = np.searchsorted(starts, offs)
        core = np.searchsorted(starts, [low_end, high_end])
        out[:, 8] = np.maximum(np.minimum(first[1:], core[1]) - np.maximum(first[:-1], core[0]), 0)
        hits = np.flatnonzero(kinds)
        if not len(hits):
            return out
        owner = np.searchsorted(first, hits, "right") - 1
        a, b = np.maximum(first[owner], hits - AROUND), np.minimum(first[owner + 1], hits + AROUND + 1)
        weight = np.where(kinds[hits] == 2, 0.5, 1.0)
        total = np.concatenate([[0], np.cumsum(weight)])
        near = total[np.searchsorted(hits, b)] - total[np.searchsorted(hits, a)]
        score = weight * (1 + 0.5 * (near - weight))
        # words of report and of address in the windows
        cover = np.zeros(len(starts) + 1, np.int32)
        np.add.at(cover, a, 1)
        np.add.at(cover, b, -1)
        some = np.flatnonzero(np.cumsum(cover[:-1]))
        beside = []
        for words in (REPORT, ADDRESS):
            flag = np.zeros(len(starts) + 1, np.int64)
            flag[some + 1] = _among(low, starts[some], ends[some], words)
            flag = np.cumsum(flag)
            beside.append(flag[b] > flag[a])
        # the nearest marks on either side
        role = _MARKS[np.minimum(raw, len(_MARKS) - 1)]
        mark = np.flatnonzero(role & 3)
        quoted = np.zeros(len(hits), bool)
        if len(mark):
            opens = (role[mark] & 1 > 0) & (role[np.minimum(mark + 1, len(raw) - 1)] != 4) & ((mark == 0) | ~word[mark - 1])
            closes = (role[mark] & 2 > 0) & (mark > 0) & (role[mark - 1] != 4)
            left, right = np.searchsorted(mark, starts[hits]) - 1, np.searchsorted(mark, ends[hits])
            begin, end = np.maximum(starts[a] - 1, offs[owner]), ends[b - 1]
            has_left = (left >= 0) & (mark[np.maximum(left, 0)] >= begin) & opens[np.maximum(left, 0)]
            has_right = (right < len(mark)) & (mark[np.minimum(right, len(mark) - 1)] <= end) & closes[np.minimum(right, len(mark) - 1)]
            quoted = has_left & has_right
        counted = (hits >= core[0]) & (hits < core[1])
        for plain, at in ((True, 0), (False, 2)):
            own = counted & (quoted != plain)
            np.maximum.at(out[:, at], owner[own], score[own])
            np.add.at(out[:, at + 1], owner[own], score[own])
        for i, flag in enumerate((np.ones(len(hits), bool), *beside, kinds[hits] == 3), 4):
            np.add.at(out[:, i], owner[counted & flag], 1)
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        x = self.features(texts)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def lexicon(sample: DataFrame, n_toxic: int, n_clean: int, size: int = 400, texts: int = 3, times: float = 12.0, surprise_of: float = 14.0) -> tuple[list[str], list[str]]:
    """Words and stems of the sample's (_y, _text) rows whose share of toxic texts is beyond chance, the ``size`` clearest of each.

    A term is in ``texts`` toxic texts at least, ``times`` as frequent in toxic texts as in others, and its log-likelihood ratio
    against chance is ``surprise_of`` or more. Words have 3 to 40 letters, stems 4 to 8.

    Counted by Spark. Copies and near copies count once: a text stays if it has the smallest hash of all texts that share its
    smallest three-word shingle, under each of SEEDS hashes. What is quoted on a line isn't counted: it is somebody else's word.
    """
    grams = F.transform(F.array(F.split(F.lower("_text"), r"\s+")), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, 3))))[0]
    once = sample.select(F.xxhash64("_text").alias("k"), "_y", "_text", grams.alias("grams")).dropDuplicates(["k"])
    lows = F.transform(F.sequence(F.lit(1), F.lit(SEEDS)), lambda seed: F.struct(seed.alias("seed"), F.array_min(F.transform("grams", lambda g: F.xxhash64(g, seed))).alias("low")))
    least = once.select("k", F.explode(lows).alias("l")).groupBy("l.seed", "l.low").agg(F.min("k").alias("k"))
    once = once.join(least.groupBy("k").count().filter(F.col("count") == SEEDS), "k", "left_semi")
    once = once.select("k", "_y", "_text")
    said = F.regexp_replace(F.lower("_text"), "[\"“„«][^\"“”„«»\n]{1,200}[\"“”»]", " ")
    words = once.select("k", "_y", F.explode(F.array_distinct(F.split(said, r"[^\p{L}]+"))).alias("w")).filter((F.length("w") >= 3) & (F.length("w") <= 40))
    parts = F.transform(F.sequence(F.lit(4), F.least(F.length("w") - 1, F.lit(8))), lambda n: F.substring("w", F.lit(1), n))
    stems = words.filter(F.length("w") >= 5).select("k", "_y", F.explode(parts).alias("w")).distinct()
    tally = lambda df, stem: df.groupBy("w").agg(F.sum("_y").alias("a"), F.sum(1 - F.col("_y")).alias("b")).filter(f"a >= {texts} and a > 4 * b").withColumn("stem", F.lit(stem))
    base = max(1e-6, n_toxic / max(1, n_toxic + n_clean))

    def surprise(a: int, b: int) -> float:
        n, p = a + b, a / (a + b)
        return n * (p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0))

    ratio = lambda a, b: ((a + 0.5) / (n_toxic + 1)) / ((b + 0.5) / (n_clean + 1))
    rows = [(surprise(r["a"], r["b"]), r["w"], r["stem"], r["a"]) for df, stem in ((words, False), (stems, True)) for r in tally(df, stem).collect() if ratio(r["a"], r["b"]) >= times]
    rows = sorted((r for r in rows if r[0] >= surprise_of), key=lambda r: (-r[0], r[1], r[2]))
    best = {(w, s): a for _, w, s, a in rows}
    kept_stems: list[str] = []
    for _, w, stem, a in rows:
        # a stem is open if it holds clearly more texts than any one word or longer stem of it, and none shorter is kept
        if stem and not any(w.startswith(s) for s in kept_stems) and all(a >= 1.5 * v for (x, s), v in best.items() if x.startswith(w) and not s):
            inner = [s for s in kept_stems if s.startswith(w)]
            if all(a >= 1.15 * best[s, True] for s in inner):  # else the longer stem says as much
                kept_stems = [s for s in kept_stems if s not in inner] + [w]
    words_kept = [w for _, w, stem, _ in rows if not stem and not any(w.startswith(s) for s in kept_stems)]
    return words_kept[:size], kept_stems[:size]


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", toxic_rows: int = 1000, clean_rows: int = 3000, class_chars: int = 32 << 20, least: int = 50,
    **lexicon_options,
) -> ToxicityModel:
    """Fit on ``toxic_rows`` and ``clean_rows`` labelled rows at most, with whole texts of ``class_chars`` characters in all of either class at
    most, save that ``least`` rows of each stay. ``lexicon_options`` go to ``lexicon``."""
    rows = majority(labels, id_col, label_col)
    parts = sampled(rows.filter("_y = 1"), F.col("_y"), "_id", toxic_rows).select("_id", "_y", "_draw")
    parts = parts.unionByName(sampled(rows.filter("_y = 0"), F.col("_y"), "_id", clean_rows).select("_id", "_y", "_draw"))
    sample = labelled_texts(docs, parts, id_col, text_col, class_chars, least)
    n = {r["_y"]: r["count"] for r in sample.groupBy("_y").count().collect()}
    if not n.get(1) or not n.get(0):
        discard(sample)
        return ToxicityModel([], [])
    model = ToxicityModel(*lexicon(sample, n[1], n[0], **lexicon_options))

    def run(batches):
        for b in blocks(batches, "_text"):
            x = model.features(b.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("_id").cast(pa.string()), b.column("_y"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["_id", "_y", "x"])

    got = sorted(tuple(r) for r in sample.mapInArrow(run, "_id string, _y int, x array<double>").collect())
    discard(sample)
    model.weights = logistic(np.array([r[2] for r in got]), np.array([r[1] for r in got], float))
    return model


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted: a row for each row of ``docs``."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        for b in blocks(batches):
            s = model.score(pc.fill_null(b.column("text"), "").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score below the threshold, in one pass; all columns as they are."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for b in blocks(batches, f"c{at}"):
            s = model.score(pc.fill_null(b.column(at), "").to_pylist())
            yield b.filter(pa.array(s < threshold))

    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    return plain.mapInArrow(run, plain.schema).toDF(*names)
