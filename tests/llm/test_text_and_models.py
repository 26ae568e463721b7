"""Words, language models, quality, toxicity: against plain Python."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from semirix.llm import language_id, quality_classifier, quality_rules, tokens, toxicity
from semirix.llm._text import Words, shingles

ODD = ["", None, "   \n\t ", "a", "Ärger  über\x0bden Zaun\n", "x" * 70_000 + " y", "one two three four five six", "don't <|endoftext|> it's", "ΣΑΣ ı İ é ́x", "12 ½ 中文 🙂🙂 !!--", "\x85 a﻿b c"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBç \n\t\x0b\x1c中.", max_size=40)), max_size=8), st.integers(1, 4))
def test_words_and_shingles(texts, k):
    w = Words(pa.array(texts, pa.string()))
    h = w.hashes(lower=True)
    expected = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert [[w.word(i) for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)] == expected
    sh, offs = shingles(h, w.first, k)
    names = {}
    for i, ws in enumerate(expected):
        low = ["".join(c.lower() if c < "\x80" else c for c in x) for x in ws]
        own = [tuple(low[j : j + k]) for j in range(len(low) - k + 1)] or ([tuple(low)] if low else [])
        got = sh[offs[i] : offs[i + 1]].tolist()
        assert len(own) == len(got)
        for a, b in zip(own, got, strict=True):
            assert names.setdefault(a, b) == b
    assert len(set(names.values())) == len(names)


def test_word_tokenizer_is_exact():
    t = tokens.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), most=4)
    texts = [*ODD, "The cat's hat, 3.14!", "the THE The"]
    for some in (texts, texts[::-1]):
        ids, offs = t.encode(pa.array(some, pa.string()))
        for i, x in enumerate(some):
            assert ids[offs[i] : offs[i + 1]].tolist() == t.tool.encode(x or "", add_special_tokens=False).ids


def slow_kneser_ney(texts, text, order):
    """Bits per character of ``text`` under a model of ``texts``, from the definition."""

    def chars(t):
        out = ["<"] * (order - 1)
        for ch in t:
            c = ch.lower()[0] if ch.isalpha() else " "
            if not (c == " " and out[-1] == " "):
                out.append(c)
        return out

    counts = {m: Counter() for m in range(1, order + 1)}
    for t in texts:
        c = chars(t)
        for i in range(order - 1, len(c)):
            counts[order][tuple(c[i - order + 1 : i + 1])] += 1
    for m in range(order - 1, 0, -1):
        for g in counts[m + 1]:
            counts[m][g[1:]] += 1
    letters = max(2, len(counts[1]) + 1)
    d, total, kinds = {}, {}, {}
    for m, own in counts.items():
        n1, n2 = sum(v == 1 for v in own.values()), sum(v == 2 for v in own.values())
        d[m] = min(0.95, max(0.1, n1 / max(1.0, n1 + 2.0 * n2)))
        total[m], kinds[m] = defaultdict(float), defaultdict(int)
        for g, v in own.items():
            total[m][g[:-1]] += v
            kinds[m][g[:-1]] += 1

    def p(g):
        m = len(g)
        if not m:
            return 1 / letters
        h = g[:-1]
        if not total[m][h]:
            return p(g[1:])
        return max(counts[m][g] - d[m], 0) / total[m][h] + d[m] * kinds[m][h] / total[m][h] * p(g[1:])

    c = chars(text)
    return -sum(math.log2(p(tuple(c[i - order + 1 : i + 1]))) for i in range(order - 1, len(c))) / max(1, len(c) - order + 1)


def test_kneser_ney_from_the_definition():
    texts = ["the cat sat on the mat", "the dog and the cat ran", "a theatre of cats"]
    model = language_id.fit([("en", t) for t in texts], 3)
    got = model.entropies(["the cat", "zebra then a cat!!", "théâtre"])
    assert np.allclose(got[:, 0], [slow_kneser_ney(texts, t, 3) for t in ("the cat", "zebra then a cat!!", "théâtre")], atol=1e-4)


def tongues(n, chars=4000):
    """n languages of random syllables over the same letters."""
    rng = np.random.default_rng(11)
    out = []
    for i in range(n):
        syllables = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 2)) for _ in range(30)]
        out.append((f"l{i:03}", ["".join(rng.choice([*syllables, " "], 200)) for _ in range(chars // 400)]))
    return out


def test_weights_as_lists_and_as_matrices_agree(monkeypatch):
    rows = [(a, t) for a, texts in tongues(6) for t in texts]
    texts = [t for _, t in rows[::7]] + ODD[3:]
    a = language_id.fit(rows).entropies([t for t in texts if t is not None])
    monkeypatch.setattr(language_id, "DENSE", 0)
    monkeypatch.setattr(language_id, "CELLS", 999)
    b = language_id.fit(rows).entropies([t for t in texts if t is not None])
    assert np.allclose(a, b, atol=1e-6)


def test_long_texts_in_segments(monkeypatch):
    rows = [(a, t) for a, texts in tongues(3) for t in texts]
    texts = [" ".join(t for _, t in rows), "  12 ...  " * 40, "a", "", "ab, cd " * 30 + "   ", "x" * 25]
    model = language_id.fit(rows)
    whole = model.entropies(texts)
    for size in (1, 7, 10, 64):
        monkeypatch.setattr(language_id, "SEGMENT", size)
        assert np.allclose(model.entropies(texts), whole, atol=1e-6)


def test_hundred_languages_and_a_long_text_in_bounded_memory():
    """Eight million characters under 100 languages: what is held doesn't grow with the text."""
    import tracemalloc

    data = tongues(100)
    model = language_id.fit([(a, t) for a, texts in data for t in texts])
    assert model.nbytes() < 100 << 20
    text = " ".join(data[42][1]) * 2000
    few = text[: 1 << 20]
    peaks = []
    for t in (few, text):
        tracemalloc.start()
        best, *_ = model.predict([t])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert model.languages[best[0]] == "l042"
    assert len(text) > 7_000_000 and peaks[1] < 1.2 * peaks[0] + (8 << 20) < 1 << 30
    told = model.predict([texts[-1] for _, texts in data])[0]
    assert [model.languages[i] for i in told] == [a for a, _ in data]


def test_rejection_keeps_its_rate(spark):
    data = tongues(4, 40_000)
    model = language_id.fit([(a, t) for a, texts in data for t in texts[:60]], reject=0.05)
    fresh = [t for _, texts in data for t in texts[60:]]
    assert model.predict(fresh)[3].mean() > 0.85 and not model.predict(["".join(np.random.default_rng(3).choice(list("qxzjk"), 200))])[3].any()


def training(n=40):
    de, en = "der die das und nicht ist wird schon immer wieder haben".split(), "the and that with this have from they would there".split()
    rng = np.random.default_rng(1)
    return [(lang, " ".join(rng.choice(words, 30))) for _ in range(n) for lang, words in (("de", de), ("en", en))]


def test_language_edges(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate(training())]
    labelled = spark.createDataFrame([*rows, (9999, None, "en"), (9998, "x", None)], "doc_id long, text string, lang string")
    model = language_id.train(labelled)
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(ODD)] + [(None, "der und das nicht", 2, None), (50, "they would have that", 3, "d"), (50, "they would have that", 3, "d")], "doc_id long, text string, id int, score string")
    got = [r.asDict() for r in language_id.identify(docs, model).collect()]
    assert len(got) == len(ODD) + 3
    by = {r["doc_id"]: r for r in got}
    assert by[None]["lang_pred"] == "de" and by[50]["lang_pred"] == "en" and by[50]["score"] > 0.9
    assert [by[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and by[9]["lang_pred"] != "und" and not by[9]["accepted"]
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language_id.identify(docs.filter("false"), model).count() == 0
    none = language_id.train(labelled.filter("false"))
    assert none is None and {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}


def slow_base(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    win = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    marked = {j for i in range(len(ws) - 7) if win[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(marked)


def test_quality_rules(spark):
    rng = np.random.default_rng(3)
    texts = [*ODD, "a b c d e f g h " * 4, "a b c d e f g h i " * 3 + "z", "line one\nline one\n \n\nline two\nline one", "a a a a a a a a a a a"]
    texts += ["".join(rng.choice(list("ab \n#"), 120)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "x", None if i % 3 else "s", "k", 1.5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, measure string, n_words double")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in enumerate(texts):
        n = slow_base(t)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == n, repr(t)[:80]
        assert got[i]["base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (got[i]["base_failed"] and got[i]["kept"])
    assert quality_rules.quality_rules(docs.filter("false")).count() == 0


def test_quality_fences_adapt(spark):
    clean = "these are plain words of a usual length in a clean text that has more than twenty words in all as it must be"
    odd = " ".join(w + "###" for w in clean.split())
    rows = [(i, clean + f" {i}", "en", "a") for i in range(60)] + [(100, odd, "en", "a")] + [(200 + i, odd + f" {i}", "en", "markup") for i in range(60)] + [(300, odd, "en", "rare")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert kept[0] and not kept[100] and kept[200]  # a source of marked-up texts keeps them, another doesn't


def test_sketch_merges_and_bounds_error(spark):
    v = [int(x) for x in np.random.default_rng(5).lognormal(5, 2, 3000)]
    cols = ", ".join(f"{m} long" for m in quality_rules.MARGIN)
    df = spark.createDataFrame([("l", "s", *[x] * len(quality_rules.MARGIN)) for x in v], f"lang string, source string, {cols}")
    s = quality_rules.sketches(df).filter("measure = 'len_c'")
    parts = quality_rules.sketches(df.filter("len_c % 2 = 0")).unionByName(quality_rules.sketches(df.filter("len_c % 2 = 1"))).filter("measure = 'len_c'")
    assert sorted(tuple(r) for r in s.collect()) == sorted(tuple(r) for r in parts.groupBy("lang", "source", "measure", "bucket").agg(F.sum("n")).collect())
    rows, seen = sorted((r["bucket"], r["n"]) for r in s.collect()), 0
    for q in (0.25, 0.5, 0.75):
        exact, seen = sorted(v)[math.ceil(q * len(v)) - 1], 0
        for bucket, n in rows:
            seen += n
            if seen >= q * len(v):
                assert bucket <= exact <= bucket * (1 + 1 / 32) + 1
                break


def test_quality_classifier(spark):
    good, bad = "well formed words that follow each other in a sentence with some meaning".split(), "|| $$$ ### BUY!!! NOW!!! && %% >>>".split()
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad, 60)), i % 2) for i in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("id", F.lit("x"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    model = quality_classifier.train(docs, labels.filter("doc_id < 80"))
    more = docs.unionByName(spark.createDataFrame([(1000 + i, t, "y") for i, t in enumerate(ODD)], docs.schema))
    got = {r["doc_id"]: r for r in quality_classifier.classify(more, model).collect()}
    assert all(got[i]["predicted"] == i % 2 for i in range(80, 120)) and len(got) == len(rows) + len(ODD)
    assert got[1000]["score"] == got[1001]["score"] and all(0 <= r["score"] <= 1 for r in got.values())
    empty = quality_classifier.train(docs, labels.filter("false"))
    assert {r["score"] for r in quality_classifier.classify(docs, empty).collect()} == {0.5}
    assert quality_classifier.classify(docs.filter("false"), model).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=10), min_size=1, max_size=6), st.lists(st.text(alphabet="abcd", min_size=1, max_size=12), min_size=1, max_size=30))
def test_automaton_is_levenshtein(terms, words):
    a = toxicity.Automaton.build(terms, [])
    codes = np.array([a.letters.get(ch, len(a.letters) + 1) for w in words for ch in w])
    ends = np.cumsum([len(w) for w in words])
    got = a.run(codes, ends - [len(w) for w in words], ends)
    for w, k in zip(words, got, strict=True):
        exact, near = w in terms, any(distance(w, t) <= toxicity.allowed(t) for t in terms)
        assert k == (1 if exact else 2 if near else 0), w


def test_stems():
    a = toxicity.Automaton.build(["idiot"], ["lowei"])
    words = ["loweichen", "lowe", "lowei", "idiots", "idoit"]
    codes = np.array([a.letters.get(ch, len(a.letters) + 1) for w in words for ch in w])
    ends = np.cumsum([len(w) for w in words])
    assert a.run(codes, ends - [len(w) for w in words], ends).tolist() == [3, 0, 3, 2, 0]


def test_toxicity(spark):
    rng = np.random.default_rng(4)
    plain = [f"w{chr(97 + i)}{chr(97 + j)}rd" for i in range(20) for j in range(20)]
    rows = []
    for i in range(400):
        ws = list(rng.choice(plain, 60))
        if i % 5 == 0:
            for p in rng.choice(60, 4, replace=False):
                ws[p] = str(rng.choice(["scoundrel", "imbecile", "villain"]))
        rows.append((i, " ".join(ws), int(i % 5 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("id", F.lit(1))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels.filter("doc_id < 300"))
    assert {"scoundrel", "imbecile", "villain"} <= set(model.words)
    tests = [*ODD, "wabrd scoundrle wabrd imbecille wabrd vilain wabrd scoundrel", "you imbecile scoundrel villain", 'he wrote "you imbecile scoundrel villain" in a letter']
    more = docs.unionByName(spark.createDataFrame([(1000 + i, t, 2) for i, t in enumerate(tests)], docs.schema))
    got = {r["doc_id"]: r for r in toxicity.score(more, model).collect()}
    assert np.mean([got[i]["predicted"] == int(i % 5 == 0) for i in range(300, 400)]) > 0.97
    n = 1000 + len(ODD)
    assert got[n]["predicted"] == 1 and got[n + 1]["score"] > got[n + 2]["score"] and got[1000]["score"] == got[1001]["score"] < 0.5
    kept = toxicity.keep(more, model)
    assert kept.columns == more.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}
    assert toxicity.score(docs.filter("false"), model).count() == 0
    none = toxicity.train(docs, labels.filter("false"))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}


@pytest.mark.parametrize("cls", ["en", "de"])
def test_sample_is_bounded_and_stable(spark, cls):
    from semirix.llm._store import sampled

    df = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, "de").otherwise("en").alias("l"))
    a, b = ({r["k"] for r in sampled(d, F.col("l"), "k", 200).filter(F.col("l") == cls).collect()} for d in (df, df.repartition(7)))
    assert a == b and len(a) == 200


def test_a_million_hits_in_seconds():
    import time

    model = toxicity.ToxicityModel(["imbecile", "villain"], [])
    text = "you imbecile said the vilain " * 500_000
    began = time.time()
    x = model.features([text, "", "imbecile"])
    assert time.time() - began < 30 and x[0, 1] == 6 and x[1].tolist() == [0] * 8 and x[2, 0] == 1


def slow_windows(model, text):
    """Windows of a text from the definition, word by word."""
    words = [(m.start(), m.end()) for m in re.finditer(r"[a-zäöü]+", text.lower())]
    terms = {w: 1.0 for w in model.words}
    weight = []
    for a, b in words:
        w = text[a:b].lower()
        near = any(distance(w, t) <= toxicity.allowed(t) for t in model.words)
        weight.append(terms.get(w, 0.5 if near else 0.0))
    plain, quoted, report, address = [], [], 0, 0
    for i, w in enumerate(weight):
        if not w:
            continue
        lo, hi = max(0, i - toxicity.AROUND), min(len(words), i + toxicity.AROUND + 1)
        s = w * (1 + 0.5 * (sum(weight[lo:hi]) - w))
        around = {text[a:b].lower() for a, b in words[lo:hi]}
        report += bool(around & toxicity.REPORT)
        address += bool(around & toxicity.ADDRESS)
        left = [p for p in range(max(0, words[lo][0] - 1), words[i][0]) if text[p] in toxicity.OPENING + toxicity.CLOSING]
        right = [p for p in range(words[i][1], min(len(text), words[hi - 1][1] + 1)) if text[p] in toxicity.OPENING + toxicity.CLOSING]
        opens = left and text[left[-1]] in toxicity.OPENING and text[left[-1] + 1] != " " and (left[-1] == 0 or not text[left[-1] - 1].isalpha())
        closes = right and text[right[0]] in toxicity.CLOSING and text[right[0] - 1] != " "
        (quoted if opens and closes else plain).append(s)
    n = max(1, len(plain) + len(quoted))
    return [max(plain, default=0), min(sum(plain), 6), min(100 * sum(plain) / max(1, len(words)), 6), max(quoted, default=0), min(sum(quoted), 6), report / n, address / n, 0.0]


def test_windows_from_the_definition(monkeypatch):
    rng = np.random.default_rng(7)
    model = toxicity.ToxicityModel(["imbecile", "villain", "scoundrel"], [])
    pieces = ["imbecile", "Villain", "vilain", "scoundrle", "you", "said", "und", "der", '"', '" ', ' "', "“", "”", "words", "und", ", ", "du", "table", ".\n"]
    texts = [" ".join(rng.choice(pieces, int(rng.integers(1, 60)))) for _ in range(150)] + ['"villain"', 'he said "you imbecile" to', "x"]
    expected = np.array([slow_windows(model, t) for t in texts])
    assert np.allclose(model.features(texts), expected) and expected[:, 3].any() and (expected[:, 0] > 0).any()
    monkeypatch.setattr(toxicity, "SEGMENT", 40)  # every text in overlapping segments
    assert np.allclose(model.features(texts), expected)


def test_signs_that_stand_for_letters():
    model = toxicity.ToxicityModel(["idiot", "stupid"], [])
    hit = lambda t: model.features([t])[0, 0] > 0
    assert all(map(hit, ["1d10t", "an !diot", "$tupid", "stup1d", "stupid$$$", "IDIOT5", "(idiot)"]))
    assert not any(map(hit, ["10 20", "$$$", "the$$$ 5", "1d", "id: 10 t", "a1b2c3d4e5f60718293a"]))


@pytest.mark.parametrize("abuse", [False, True])
def test_quotation_is_learned(spark, abuse):
    """Quoted insults are labelled as no abuse, or as abuse: the model follows the labels."""
    rng = np.random.default_rng(8)
    plain = [f"w{chr(97 + i)}{chr(97 + j)}rd" for i in range(20) for j in range(20)]
    rows = []
    for i in range(400):
        ws = list(rng.choice(plain, 40))
        term = str(rng.choice(["scoundrel", "imbecile", "villain"]))
        kind = i % 4  # 0 abuse, 1 quotation, else none
        if kind < 2:
            ws[20] = f'"{term} {term}"' if kind else f"{term} {term}"
        rows.append((i, " ".join(ws), int(kind == 0 or kind == 1 and abuse)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 300], "doc_id long, toxic int"), times=2.0, surprise_of=6.0)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs.filter("doc_id >= 300"), model).collect()}
    assert np.mean([got[r[0]] == r[2] for r in rows[300:]]) > 0.97


def test_two_labels_of_one_document(spark):
    from semirix.llm._store import majority

    rows = [(1, 1), (1, 1), (1, 0), (2, 0), (2, 1), (3, 0), (None, 1), (4, None), (5, 7), (6, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, y int")
    assert sorted(tuple(r) for r in majority(labels, "doc_id", "y").collect()) == [(1, 1), (3, 0), (6, 1)]


def test_long_labelled_texts_are_learned(spark):
    """One class has texts of 60,000 characters only; the bound is on all characters, and some rows always stay."""
    rng = np.random.default_rng(6)
    good, bad = "well formed words that follow each other in a sentence".split(), "|| $$$ ### BUY!!! NOW!!! && %%".split()
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad, 60 if i % 2 else 12_000)), i % 2) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 40], "doc_id long, quality int")
    model = quality_classifier.train(docs, labels, class_chars=100_000, least=8)
    got = {r["doc_id"]: r["predicted"] for r in quality_classifier.classify(docs, model).collect()}
    assert all(got[i] == i % 2 for i in range(40, 60))


def slow_compression(model, text):
    """The score from its definition, one text and one compressor at a time."""
    import zstandard

    kind = zstandard.DICT_TYPE_RAWCONTENT if model.raw else zstandard.DICT_TYPE_FULLDICT
    sizes = []
    for d in (model.good, model.bad):
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind), write_content_size=False, write_dict_id=False)
        sizes.append(len(c.compress(text.encode())))
    g, b, n = *sizes, len(text.encode())
    d, r, size = (g - b) / max(g + b, 1), min(g, b) / max(n, 8), math.log1p(n)
    x = [d, d * size, r, r * r, max(0, 0.15 - r), max(0, r - 0.5), size]
    z = sum(w * (v - m) / s for w, v, m, s in zip(model.weights, x, model.mean, model.scale, strict=False)) + model.weights[-1]
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_compression_score_from_the_definition():
    rng = np.random.default_rng(12)
    good, bad = "well formed words that follow each other in a sentence with some meaning".split(), "|| $$$ ### BUY!!! NOW!!! && %% >>>".split()
    rows = [(i % 2, " ".join(rng.choice(good if i % 2 else bad, int(rng.integers(5, 200))))) for i in range(200)]
    model = quality_classifier.fit(rows)
    texts = [t for _, t in rows[::9]] + [t for t in ODD if t is not None]
    assert np.allclose(model.score([t.encode() for t in texts]), [slow_compression(model, t) for t in texts], atol=1e-9)


def test_languages_of_long_documents_are_learned(spark):
    """One language has long documents only, another short ones among many without a letter."""
    rng = np.random.default_rng(2)
    text = lambda letters, n: "".join(rng.choice([*letters, " "], n))
    rows = [(i, "12 34 " + text("abcde", 3000), "long") for i in range(12)] + [(100 + i, text("vwxyz", 300), "short") for i in range(12)]
    rows += [(1000 + i, "1 2 3", "short") for i in range(3000)] + [(9000, None, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, per_language=12, max_chars=1000)
    assert sorted(model.languages) == ["long", "short"]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs.filter("doc_id < 1000"), model).collect()}
    assert all(v == ("long" if i < 100 else "short") for i, v in got.items())
