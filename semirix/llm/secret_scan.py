"""Secrets: candidate strings by their shape or their place, and a random forest that drops the false positives.

A candidate is a run of ``least`` (16) or more of ``A-Z a-z 0-9 + / _ -``, with up to two ``=`` behind that nothing follows (padding);
any other ``=`` parts a key from its value. A candidate of any characters, from ``least_assigned`` (6) bytes on, is also what is
assigned by ``=`` or ``:`` to a name with a word like password or token in it: up to the closing quotation mark, or without one to the
next space, bracket, comma or ``&``; 200 bytes at most. Both are found on the bytes of whole texts. The features are
length, changes of character class, entropy, shares of the classes, surprise under a model of character transitions, coverage by a
dictionary, words of a placeholder, words of the path, and the words beside it. The transitions and the dictionary (the most frequent
words of 4 to 12 letters) are counted over all documents by ``corpus``.

The forest is trained here on labelled findings (value, before, after, path, label): ``train`` fits on those outside a fifth, by a hash, and
gives the precision and recall on that fifth. Without any, a seeded generator writes findings of known kinds (keys, tokens, passwords,
hashes of commits, identifiers, numbers, placeholders, words of the documents) into sentences, 1 where the string is a secret. Findings
are cut into candidates as texts are, so training and scanning see the same value and context.

Defined results: null or empty texts have no finding. Repeated rows are scanned each; null ids are carried; a null path is
the empty path. Where candidates overlap, an assigned value without a space counts, else the run. Equal scores stay equal.
"""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semirix.llm._store import discard, sampled, table
from semirix.llm._text import Words, blocks, buffers

LEAST, LEAST_ASSIGNED = 16, 6
HEX = "0123456789abcdef"
ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
# Fixed word lists: what stands beside secrets, beside other strings, in paths of examples, and in placeholders; common words.
KEYWORDS = frozenset("token secret password passwd pass pwd key apikey api auth bearer credential credentials private access client".split())
HARMLESS = frozenset("commit sha sha1 sha256 md5 checksum digest uuid guid id hash revision example sample placeholder dummy test order invoice phone card isbn version image data".split())
EXAMPLES = frozenset("test tests example examples sample samples docs fixture fixtures mock spec".split())
PLACEHOLDERS = ("example", "sample", "placeholder", "dummy", "changeme", "your", "xxxx", "insert", "replace", "redacted", "env", "get", "none", "null", "required", "optional", "string", "test")
COMMON = frozenset("your token secret here example changeme password test sample dummy placeholder insert value default string content background transition container button wrapper header footer primary secondary version release config options number letter section this that with from have will would there their about which when make like time just know take people into year good some could them other than then look only come over think also back after work first well even want because these give most image data key user name file path".split())
_RUN = np.zeros(256, bool)
_RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-"]] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
#: Byte -> kind of character in the transitions: a letter without case, a digit, else.
KINDS = 28
_KIND = np.full(256, 27)
_KIND[65:91] = _KIND[97:123] = np.arange(26)
_KIND[48:58] = 26
_NAME = re.compile(rb"([A-Za-z][A-Za-z0-9_.-]{0,63})[\"']?[ \t]{0,8}:?$")
_VALUE = re.compile(rb"[ \t]{0,8}(?:\"([^\"\n]{1,200})\"|'([^'\n]{1,200})'|`([^`\n]{1,200})`|([^\s\"'`,;(){}\[\]<>&]{1,200}))")
_PART = re.compile(rb"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
NAMES = ("length", "changes", "entropy", "upper", "lower", "digit", "other", "hex", "surprise", "coverage", "placeholder", "path", "keyword", "harmless", "assigned", "quoted", "repeats", "brackets")


@dataclass(frozen=True)
class Corpus:
    """What strings are held against: a dictionary, and log-probabilities of a kind of character after another."""

    words: frozenset[str]
    after: np.ndarray

    @classmethod
    def of(cls, counts: dict[str, int], pairs: np.ndarray | None = None) -> Corpus:
        """From word counts, and counts of pairs of kinds; without these, those of the words."""
        if pairs is None:
            pairs = np.zeros((KINDS, KINDS))
            for w, n in counts.items():
                k = _KIND[np.frombuffer(w.encode(), np.uint8)]
                np.add.at(pairs, (k[:-1], k[1:]), n)
        pairs = pairs + 0.5
        return cls(frozenset(counts) | COMMON, np.log(pairs / pairs.sum(axis=1, keepdims=True)))


@functools.cache
def common() -> Corpus:
    """Of the common words alone."""
    return Corpus.of(dict.fromkeys(sorted(COMMON), 1))


def corpus(docs: DataFrame, words: int = 20_000, text_col: str = "text", most: int = 50_000) -> Corpus:
    """The most frequent words of 4 to 12 letters, ``words`` at most, and all transitions of all documents.

    A task hands on what it has counted once it holds ``most`` different words; Spark adds up. Counts are compared by their six leading
    bits, and words of one count go in all or not at all.
    """

    def run(batches):
        held: dict[str, int] = {}
        pairs = np.zeros(KINDS * KINDS, np.int64)
        out = lambda d: pa.RecordBatch.from_arrays([pa.array(list(d), pa.string()), pa.array(list(d.values()), pa.int64())], ["word", "n"])
        for b in blocks(batches):
            w = Words(b.column("text"), _LETTERS)
            if len(w.data) > 1:
                k = _KIND[w.data]
                pairs += np.bincount(k[:-1] * KINDS + k[1:], minlength=len(pairs))
            size = w.ends - w.starts
            fit = np.flatnonzero((size >= 4) & (size <= 12))
            if not len(fit):
                continue
            _, first, n = np.unique(w.hashes(lower=True)[fit], return_index=True, return_counts=True)
            for word, c in zip(w.words(fit[first]), n.tolist(), strict=True):
                word = word.lower()
                held[word] = held.get(word, 0) + c
            if len(held) >= most:
                yield out(held)
                held = {}
        yield out(held | {f"\x00{i}": n for i, n in enumerate(pairs.tolist()) if n})

    found = table(docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    is_pair = F.col("word").startswith("\x00")
    pairs = np.zeros(KINDS * KINDS)
    for r in found.filter(is_pair).collect():
        pairs[int(r["word"][1:])] = r["n"]
    # counts to six significant bits: a few hundred different ones, so what comes to the driver is bounded at any number of words
    shift = F.greatest(F.length(F.bin("n")) - 6, F.lit(0))
    kept = found.filter(~is_pair).withColumn("shift", shift).select("word", F.expr("shiftleft(shiftright(n, shift), shift)").alias("size"))
    least, total = None, 0
    for r in kept.groupBy("size").count().orderBy(F.desc("size")).collect():
        total += r["count"]
        if total > words:
            break
        least = r["size"]
    counts = {r["word"]: r["size"] for r in kept.filter(F.col("size") >= least).collect()} if least is not None else {}
    discard(found)
    return Corpus.of(counts, pairs.reshape(KINDS, KINDS)) if pairs.any() else common()


def features(value: str, before: str, after: str, path: str, own: Corpus | None = None) -> list[float]:
    own, n = own or common(), len(value)
    kind = ["u" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "o" for c in value]
    share = [kind.count(k) / n for k in "uldo"]
    freq = [value.count(c) / n for c in set(value)]
    low = value.lower()
    k = _KIND[np.frombuffer(low.encode(), np.uint8)]
    covered, i = 0, 0
    while i < n:
        size = next((s for s in range(min(12, n - i), 3, -1) if low[i : i + s] in own.words), 0)
        covered += size
        i += size or 1
    clean = lambda s: "".join(c.lower() if c.isalnum() else " " for c in s).split()
    near = clean(before)[-3:] + clean(after)[:2]
    tail = before.rstrip(" \"'`")
    return [
        n, sum(a != b for a, b in zip(kind, kind[1:], strict=False)) / n, -sum(f * math.log2(f) for f in freq), *share,
        float(all(c in HEX for c in low)), float(-own.after[k[:-1], k[1:]].mean()) if len(k) > 1 else 0.0, covered / n, float(any(p in low for p in PLACEHOLDERS)), float(bool(EXAMPLES & set(clean(path)))),
        float(bool(KEYWORDS & set(near))), float(bool(HARMLESS & set(near))), float(tail[-1:] in ("=", ":")),
        float(before[-1:] in "\"'`" and before != "" and after[:1] in "\"'`" and after != ""), max(freq), float(low[:1] in "$%<{(" or "(" in low or "${" in low or "[" in low),
    ]


Finding = tuple[str, str, str, str, int]


def findings(n: int = 6000, seed: int = 3, own: Corpus | None = None) -> list[Finding]:
    """(value, before, after, path, label) of generated findings, half of them secrets; words are those of the corpus."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    one = lambda seq: seq[rng.integers(0, len(seq))]
    words, usual = sorted((own or common()).words), sorted(COMMON)
    text = lambda: " ".join(one(words) if rng.random() < 0.5 else pick("abcdefghijklmnopqrstuvwxyz", rng.integers(2, 9)) for _ in range(rng.integers(2, 6)))
    syllable = lambda: one(["", *"bcdfghjklmnprstvwz", "sch", "tr", "st", "pr", "th"]) + one(["a", "e", "i", "o", "u", "ei", "ie", "ou"]) + one(["", "", "n", "r", "s", "t", "l", "ng", "ck"])
    word = lambda: one(words) if rng.random() < 0.5 else one(usual) if rng.random() < 0.4 else "".join(syllable() for _ in range(rng.integers(2, 5)))
    looks = str.maketrans("aeiost", "@31057")
    keys = [
        lambda: pick(HEX, one([32, 40, 48, 64])), lambda: "AKIA" + pick(ALNUM[:26] + "234567", 16), lambda: "ghp_" + pick(ALNUM, 36),
        lambda: "sk-" + pick(ALNUM, 48), lambda: pick(ALNUM + "+/", 40), lambda: pick(ALNUM + "_-", int(rng.integers(20, 44))), lambda: pick(ALNUM, 24) + "==",
        lambda: pick(ALNUM[:52], int(rng.integers(20, 44))), lambda: "AKIA" + pick(ALNUM[:26], 16),
    ]
    passwords = [  # only where they are assigned
        lambda: pick(ALNUM + "!#%*+-.?@^_~", int(rng.integers(8, 20))), lambda: word().title().translate(looks) + one("!?.&#-") + pick("0123456789", 2) + pick(ALNUM, int(rng.integers(0, 5))), lambda: pick(ALNUM[26:52], int(rng.integers(12, 30))),
        lambda: pick(ALNUM, int(rng.integers(8, 16))), lambda: word().translate(looks) + one("!?&#-_") + word().title() + pick("0123456789", int(rng.integers(1, 4))),
    ]
    others = [
        lambda: f"{pick(HEX, 8)}-{pick(HEX, 4)}-4{pick(HEX, 3)}-a{pick(HEX, 3)}-{pick(HEX, 12)}", lambda: pick(HEX, one([32, 40, 64])), lambda: pick("0123456789", int(rng.integers(16, 22))),
        lambda: "your_" + one(words) + "_token_here" + pick("0123456789", 2), lambda: one(["x", "0", "a", "1"]) * int(rng.integers(16, 40)) + "1", lambda: "-".join(one(words) for _ in range(4)) + pick("0123456789", 1),
        lambda: "".join(w.title() for w in (one(words) for _ in range(4))) + pick("0123456789", 1), lambda: "/".join([one(words), one(words), one(words), pick("0123456789", 4)]), lambda: "example" + pick(ALNUM, 6) + "example" + pick("0123456789", 3),
        lambda: "".join(syllable() for _ in range(rng.integers(7, 14))), lambda: one(["-", "_", "/"]).join(word() for _ in range(rng.integers(3, 6))), lambda: "".join(word().title() for _ in range(rng.integers(3, 6))),
        lambda: "_".join(one(usual).upper() for _ in range(4)), lambda: one(["_", "-", "x", "A"]) * int(rng.integers(16, 60)), lambda: "_".join(word() for _ in range(4)),
    ]
    example = lambda: (lambda v: v[: max(0, len(v) - 7)] + "EXAMPLE")(one(keys)())  # noqa: E731  as documents of services print them
    assigned = [  # of a name like password, but no secret
        word, lambda: one(usual), example, lambda: one(["changeme", "required", "optional", "string", "example", "redacted", "undefined", "your_password", "password", "secret123", "placeholder"]),
        lambda: "${" + "_".join(one(usual).upper() for _ in range(2)) + "}", lambda: "$" + "_".join(one(usual).upper() for _ in range(2)), lambda: f"os.environ[{one(usual)}]", lambda: f"get_{one(usual)}", lambda: one("*x.-") * int(rng.integers(6, 20)),
        lambda: "<" + "-".join(one(usual) for _ in range(2)) + ">", lambda: " ".join(word() for _ in range(rng.integers(2, 5))), lambda: f"{one(usual)}.{one(usual)}.{one(usual)}",
    ]
    lead = lambda q: one([f"{k} = {q}", f"{k}: {q}", f"{k}={q}", f"{k.upper()}={q}", f"\"{k}\": {q}"]) if (k := one(["token", "secret", "api_key", "password", "auth_token", "client_secret", "access_key", "db_password", "passwd"])) else ""
    out: list[Finding] = []
    for i in range(n):
        path = one(["src/app.py", "config/prod.env", "src3", "web/main.js", "src12", ""])
        if i % 4 == 1:
            q = one(['"', "'", ""])
            before = lead(q) if rng.random() < 0.8 else one([f"token {q}", f"secret {q}", f"bearer {q}", f"key {q}"])
            out.append((one(keys)(), f"{text()} {before}", q + " " + text(), path, 1))
        elif i % 4 == 3:
            q = one(['"', "'", ""])
            out.append((one(passwords)(), f"{text()} {lead(q)}", q + " " + text(), path, 1))
        elif i % 4 == 2:
            q = one(['"', "'", ""])
            v = one(assigned)()
            out.append((v, f"{text()} {lead(q or chr(34) if ' ' in v or v[:1] in '<$' or '[' in v else q)}", (q or ('"' if " " in v or v[:1] in "<$" or "[" in v else "")) + " " + text(), path, 0))
        else:
            kind = int(rng.integers(0, len(others)))
            v = others[kind]()
            before = one(["commit ", "sha256: ", "id = ", "uuid: ", "checksum ", "digest: "]) if kind <= 1 else one(["", "order ", "phone ", "card ", "version: ", "key = ", "image = \""])
            path = one(["src/app.py", "src3", "tests/test_app.py", "docs/readme.md", "examples/run.sh", ""])
            if kind == 1 and rng.random() < 0.3:  # a key in an example is none
                before, path = "token = \"", one(["tests/fixtures/key.txt", "docs/example.md"])
            out.append((v, f"{text()} {before}", " " + text(), path, 0))
    return out


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), threshold, left child (the right is next to it), value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at].mean(axis=1)
            down = self.left[at] + (x[rows, np.maximum(f, 0)] > self.threshold[at])
            at = np.where(inner, down, at)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 4, seed: int = 5) -> Forest:
    """A random forest: bootstrap rows, sqrt of the features at each split, Gini."""
    rng = np.random.default_rng(seed)
    feature, threshold, left, value, roots = [], [], [], [], []
    tries = max(1, round(math.sqrt(x.shape[1])) + 1)

    def node() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    for _ in range(trees):
        rows = rng.integers(0, len(x), len(x))
        roots.append(node())
        todo = [(roots[-1], rows, 0)]
        while todo:
            at, rows, level = todo.pop()
            p = y[rows].mean()
            value[at] = float(p)
            if level == depth or len(rows) < 2 * least or p in (0.0, 1.0):
                continue
            best = (1e-9, -1, 0.0)
            for f in rng.permutation(x.shape[1])[:tries].tolist():
                order = np.argsort(x[rows, f], kind="stable")
                v, t = x[rows[order], f], np.cumsum(y[rows[order]])
                n = np.arange(1, len(v))
                l, r = t[:-1], t[-1] - t[:-1]
                m = len(v) - n
                gain = p * (1 - p) - (l * (n - l) / n + r * (m - r) / m) / len(v)
                gain[(v[1:] == v[:-1]) | (n < least) | (m < least)] = -1
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), f, float((v[i] + v[i + 1]) / 2))
            if best[1] < 0:
                continue
            feature[at], threshold[at], left[at] = best[1], best[2], node()
            node()
            go = x[rows, best[1]] > best[2]
            todo += [(left[at], rows[~go], level + 1), (left[at] + 1, rows[go], level + 1)]
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(value), np.array(roots))


def _examples(rows: list[Finding], own: Corpus) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the candidates that findings are cut into."""
    texts = pa.array([before + value + after for value, before, after, _, _ in rows], pa.string())
    x, y = [], []
    for d, i, j, f in located(texts, [r[3] for r in rows], own):
        at = len(rows[d][1].encode())
        if i < at + len(rows[d][0].encode()) and j > at:
            x.append(f)
            y.append(float(rows[d][4]))
    return np.array(x).reshape(-1, len(NAMES)), np.array(y)


@dataclass(frozen=True)
class Scanner:
    """A forest with the corpus that its features are of; and its precision and recall on findings kept out, if it was given any."""

    forest: Forest
    own: Corpus
    precision: float | None = None
    recall: float | None = None


def train(labelled: DataFrame | None = None, own: Corpus | None = None, per_class: int = 20_000, threshold: float = 0.5, trees: int = 40, depth: int = 12) -> Scanner:
    """A scanner from findings (value, before, after, path, label), ``per_class`` of each label at most; generated ones if there are none.

    A fifth, by a hash of the value, is kept out and measured: of the secrets how many are told, and of what is told how much is right.
    """
    own = own or common()
    if labelled is None:
        rows = findings(own=own)
    else:
        clean = labelled.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("value", "before", "after", "path")], F.col("label").cast("int").alias("label")).filter("label in (0, 1) and value <> ''")
        got = sampled(clean.withColumn("_key", F.concat_ws("\x00", "value", "before", "after", "path")), F.col("label"), "_key", per_class)
        rows = sorted((r["value"], r["before"], r["after"], r["path"], r["label"]) for r in got.collect())
    fold = np.array([functools.reduce(lambda h, c: (h * 131 + c) % 1000003, r[0].encode(), 7) % 5 == 0 for r in rows], bool)
    x, y = _examples([r for r, f in zip(rows, fold, strict=True) if not f], own)
    if not len(x) or y.min() == y.max():
        return Scanner(Forest(np.array([-1]), np.zeros(1), np.zeros(1, int), np.array([float(y.mean()) if len(y) else 0.0]), np.zeros(1, int)), own)
    forest = fit(x, y, trees, depth)
    x, y = _examples([r for r, f in zip(rows, fold, strict=True) if f], own)
    told = forest.score(x) >= threshold if len(x) else np.zeros(0, bool)
    return Scanner(forest, own, float(y[told].mean()) if told.any() else None, float(told[y == 1].mean()) if (y == 1).any() else None)


@functools.cache
def default_scanner() -> Scanner:
    """Trained on generated findings, with the common words alone."""
    return train()


def _runs(data: np.ndarray, offs: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first byte, byte after the last) of runs."""
    run, run_or_pad = _RUN[data], _RUN.copy()
    run_or_pad[61] = True
    begin, end = run.copy(), run.copy()
    begin[1:] &= ~run[:-1]
    end[:-1] &= ~run[1:]
    edge = offs[(offs > 0) & (offs < len(run))]
    begin[edge], end[edge - 1] = run[edge], run[edge - 1]
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    long = b - a >= least - 2
    a, b = a[long], b[long]
    stop = offs[np.searchsorted(offs, a, "right")]
    byte = lambda at: np.where(at < stop, data[np.minimum(at, len(data) - 1)], 0)
    pad = b + (byte(b) == 61)
    pad += (pad > b) & (byte(pad) == 61)
    b = np.where(run_or_pad[byte(pad)], b, pad)
    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        if j - i >= least:
            t = data[i:j].tobytes()
            lead, end_ = len(t) - len(t.lstrip(b"/-+")), len(t.rstrip(b"/-+"))
            if end_ - lead >= least:
                out.append((i + lead, i + end_))
    return out


def _assigned(data: np.ndarray, offs: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first byte, byte after the last) of values assigned to names of secrets, one after the other."""
    out, last = [], 0
    at = np.flatnonzero((data == 61) | (data == 58))
    own = np.searchsorted(offs, at, "right") - 1
    for p, start, stop in zip(at.tolist(), offs[own].tolist(), offs[own + 1].tolist(), strict=True):
        before, after = data[max(start, p - 1) : p].tobytes(), data[p + 1 : min(stop, p + 2)].tobytes()
        if p < last or before in (b"=", b"!", b"<", b">") or after == b"=":
            continue  # in a value, a comparison, or the first half of :=
        name = _NAME.search(data[max(start, p - 80) : p].tobytes())
        if name and KEYWORDS.intersection(x.lower().decode() for x in _PART.findall(name[1])):
            value = _VALUE.match(data[p + 1 : min(stop, p + 220)].tobytes())
            if value:
                i, j = value.span(value.lastindex)
                if j - i >= least:
                    out.append((p + 1 + i, p + 1 + j))
                    last = p + 1 + j
    return out


def _apart(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The intervals of ``some`` that meet none of ``others``; both sorted, and none of a kind overlap."""
    if not len(some) or not len(others):
        return some
    return some[np.searchsorted(others[:, 0], some[:, 1], "left") <= np.searchsorted(others[:, 1], some[:, 0], "right")]


def candidates(texts: pa.Array, least: int = LEAST, least_assigned: int = LEAST_ASSIGNED) -> list[tuple[int, int, int]]:
    """(text, first byte, byte after the last) in order, offsets in the text's own bytes; none overlap."""
    data, offs = buffers(texts)
    if not len(data):
        return []
    table = lambda rows: np.array(rows, np.int64).reshape(-1, 2)
    values, runs = _assigned(data, offs, least_assigned), table(_runs(data, offs, least))
    spaces = np.concatenate([[0], np.cumsum(data == 32)])
    whole, spaced = (table([v for v in values if (spaces[v[1]] > spaces[v[0]]) == s]) for s in (False, True))
    runs = _apart(runs, whole)
    spaced = _apart(spaced, runs)
    found = np.concatenate([whole, runs, spaced])
    found = found[np.argsort(found[:, 0], kind="stable")]
    own = np.searchsorted(offs, found[:, 0], "right") - 1
    return list(zip(own.tolist(), (found[:, 0] - offs[own]).tolist(), (found[:, 1] - offs[own]).tolist(), strict=True))


def located(texts: pa.Array, paths: list[str | None], own: Corpus, raw: dict[int, bytes] | None = None, least: int = LEAST, least_assigned: int = LEAST_ASSIGNED) -> list[tuple[int, int, int, list[float]]]:
    """(text, first byte, byte after the last, features) of all candidates; ``raw`` receives the bytes of their texts."""
    raw, out = {} if raw is None else raw, []
    for d, i, j in candidates(texts, least, least_assigned):
        if d not in raw:
            raw[d] = texts[d].as_buffer().to_pybytes()
        t = raw[d]
        value = t[i:j].decode("utf-8", "ignore")
        if value:
            out.append((d, i, j, features(value, t[max(0, i - 40) : i].decode("utf-8", "ignore"), t[j : j + 40].decode("utf-8", "ignore"), paths[d] or "", own)))
    return out


def _scan(b: pa.RecordBatch, scanner: Scanner, least: int, least_assigned: int):
    """(row, first byte, last byte, score) of all candidates of a block, with the texts' bytes."""
    raw: dict[int, bytes] = {}
    found = located(pc.fill_null(b.column("text"), ""), b.column("path").to_pylist(), scanner.own, raw, least, least_assigned)
    scores = scanner.forest.score(np.array([x for *_, x in found])) if found else []
    return [(d, i, j, float(s)) for (d, i, j, _), s in zip(found, scores, strict=True)], raw


def scan(docs: DataFrame, scanner: Scanner | None = None, threshold: float = 0.5, least: int = LEAST, least_assigned: int = LEAST_ASSIGNED, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """id, start and length (in bytes of the text), value, score, is_secret: a row for each candidate."""
    scanner = scanner or default_scanner()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in blocks(batches):
            rows, raw = _scan(b, scanner, least, least_assigned)
            if rows:
                d, i, j, s = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(d, pa.int64())), pa.array(i, pa.int64()), pa.array([y - x for x, y in zip(i, j, strict=True)], pa.int64()), pa.array([raw[a][x:y].decode("utf-8", "replace") for a, x, y in zip(d, i, j, strict=True)]), pa.array(s), pa.array([v >= threshold for v in s])],
                    ["id", "start", "length", "value", "score", "is_secret"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(path_col).cast("string").alias("path"))
    return rows.mapInArrow(run, f"id {kind}, start long, length long, value string, score double, is_secret boolean").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, scanner: Scanner | None = None, threshold: float = 0.5, mark: str = "<secret>", least: int = LEAST, least_assigned: int = LEAST_ASSIGNED, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``docs`` with each secret of ``text_col`` replaced by ``mark``; all other columns and rows as they are."""
    scanner = scanner or default_scanner()
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for b in blocks(batches, "text"):
            rows, raw = _scan(b, scanner, least, least_assigned)
            new: dict[int, bytes] = {}
            for d, i, j, s in reversed(rows):
                if s >= threshold:
                    t = new.get(d, raw[d])
                    new[d] = t[:i] + mark.encode() + t[j:]
            text = b.column("text")
            if new:
                mask = np.zeros(b.num_rows, bool)
                mask[list(new)] = True
                text = pc.replace_with_mask(text, pa.array(mask), pa.array([new[d].decode("utf-8", "replace") for d in sorted(new)], text.type))
            yield pa.RecordBatch.from_arrays([text if i == at else b.column(i) for i in range(len(names))], [f"c{i}" if i != at else "text" for i in range(len(names))])

    # positional names, so that no column of the table can clash
    plain = docs.select(*[F.col(f"`{c}`").alias("text" if i == at else f"c{i}") for i, c in enumerate(names)], F.col(f"`{path_col}`").cast("string").alias("path"))
    schema = plain.drop("path").schema
    return plain.mapInArrow(run, schema).toDF(*names)
