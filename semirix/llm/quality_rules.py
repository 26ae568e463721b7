"""Quality rules with thresholds that each language and source sets for itself. Native: SQL functions only.

A first pass measures each whole text. The measures become integers (per mille, or hundredths of a character) and are
counted in log-linear buckets, six significant bits each: a quantile sketch with a relative error below 1/32 that is
merged by adding counts, so it has no order, no randomness and a bounded size. The sketches of a (language, source)
group with ``min_rows`` documents give its fences; smaller groups use the merged sketch of the language, and small
languages that of all documents. A fence is the upper (lower) quartile plus (minus) ``SPREAD`` quartile distances, at
least ``MARGIN``. The documents are then joined with the fences of their group; the fences side has one row for each
language and source, and Spark broadcasts it only where its measured size allows.

Defined results: a null text is the empty text: it has no words and fails the base rules. A null language or source counts as
the empty one. Repeated rows give repeated results; only the named columns are read. ``min_rows`` decides whose fences a small group has:
quartiles of fewer documents say little, so these documents are held against the next wider group, and none is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semirix.llm._store import table

SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 8
SPREAD = 3
#: Least distance of a fence from its quartile, by measure. len_c has a lower fence too.
MARGIN = {"symbol_pm": 50, "dup_pm": 300, "repeat_pm": 200, "upper_pm": 300, "len_c": 250}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words that lie in a window of WINDOW words that the text has twice or more."""

    def covered(hashes: Column) -> Column:
        def flagged(s: Column) -> Column:
            same = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

        def total(p: Column) -> Column:
            parts = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
            return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)

        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = _let(_let(by_hash, flagged), total)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(found)

    windows = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(_let(_let(words, windows), covered))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, the base counts and the integer measures of each whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), text.alias("text"))
    df = df.select("doc_id", "lang", "source", "text", F.array_remove(F.split("text", SPACES), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    df = df.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit("[A-ZÀ-ÖØ-Þ]")).cast("long").alias("n_upper"),
    )
    per = lambda a, b, k: F.expr(f"coalesce(({k} * {a}) div nullif({b}, 0), 0)")
    return df.withColumns({
        "symbol_pm": per("n_symbols", "word_chars", 1000),
        "dup_pm": per("n_dup_lines", "n_lines", 1000),
        "repeat_pm": per("n_repeat_words", "n_words", 1000),
        "upper_pm": per("n_upper", "word_chars", 1000),
        "len_c": per("word_chars", "n_words", 100),
    })


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: mergeable by adding n. Summed before the shuffle, so a hot source costs nothing."""
    shift = F.greatest(F.length(F.bin("v")) - 6, F.lit(0))
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MARGIN])).alias("p")
    rows = measured.select("lang", "source", pairs).select("lang", "source", "p.measure", "p.v").withColumn("shift", shift)
    bucket = F.expr("shiftleft(shiftright(v, shift), shift)")
    return rows.groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, min_rows: int = 30) -> DataFrame:
    """lang, source, and for each measure its fence (len_c: two), from the smallest level with ``min_rows`` documents."""
    names = ("lang", "source", "measure", "bucket")
    merged = sketch.groupingSets([names, ("lang", "measure", "bucket"), ("measure", "bucket")], *names).agg(F.sum("n").alias("n"), F.grouping_id().alias("out"))  # the sketches are read once
    level = F.when(F.col("out") == 0, 0).when(F.col("out") == 4, 1).otherwise(2)
    merged = merged.select(level.alias("level"), F.when(level < 2, F.col("lang")).otherwise("*").alias("g1"), F.when(level < 1, F.col("source")).otherwise("*").alias("g2"), "measure", "bucket", "n")
    w = Window.partitionBy("level", "g1", "g2", "measure")
    ranked = merged.withColumn("below", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    low, high = F.min(F.when(F.col("below") * 4 >= F.col("total"), F.col("bucket"))), F.min(F.when(F.col("below") * 4 >= F.col("total") * 3, F.col("bucket")))
    q = ranked.groupBy("level", "g1", "g2", "measure").agg(low.alias("q1"), high.alias("q3"), F.max("total").alias("total"))
    margin = F.create_map(*[F.lit(x) for k, v in MARGIN.items() for x in (k, v)])[F.col("measure")]
    reach = F.greatest(margin.cast("long"), SPREAD * (F.col("q3") - F.col("q1")))
    q = q.select("level", "g1", "g2", "measure", "total", (F.col("q1") - reach).alias("lo"), (F.col("q3") + reach).alias("hi"))
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}")
    wide = q.groupBy("level", "g1", "g2").agg(F.max("total").alias("total"), *[pick(m, "hi") for m in MARGIN], pick("len_c", "lo"))
    cols = [*[f"{m}_hi" for m in MARGIN], "len_c_lo"]
    group = wide.filter("level = 0").select(F.col("g1").alias("lang"), F.col("g2").alias("source"), (F.col("total") >= min_rows).alias("own"), *[F.col(c).alias(f"a_{c}") for c in cols])
    lang = wide.filter("level = 1").select(F.col("g1").alias("lang"), (F.col("total") >= min_rows).alias("own1"), *[F.col(c).alias(f"b_{c}") for c in cols])
    whole = wide.filter("level = 2").select(*[F.col(c).alias(f"c_{c}") for c in cols])  # one row
    joined = group.join(lang, "lang").join(F.broadcast(whole))
    return joined.select("lang", "source", *[F.when(F.col("own"), F.col(f"a_{c}")).when(F.col("own1"), F.col(f"b_{c}")).otherwise(F.col(f"c_{c}")).alias(c) for c in cols])


def quality_rules(docs: DataFrame, min_rows: int = 30, **columns: str) -> DataFrame:
    """The base counts, base_failed, kept, and which fence a document is beyond (``beyond``, null if none)."""
    measured = table(measures(docs, **columns), "measures")
    out = measured.join(fences(sketches(measured), min_rows), ["lang", "source"], "left")
    beyond = F.when(F.col("len_c") < F.col("len_c_lo"), F.lit("len_c"))
    for m in reversed(MARGIN):
        beyond = F.when(F.col(m) > F.col(f"{m}_hi"), F.lit(m)).otherwise(beyond)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & beyond.isNull()).alias("kept"), beyond.alias("beyond"))


#: The same rows by DuckDB.
SQL = r"""
with d as (select row_number() over () as k, doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce("text", '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
win as (select k, i, list_slice(ws, i, i + 7) as g from (select k, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)),
twice as (select k, i from (select k, i, count(*) over (partition by k, g) as c from win) where c > 1),
rep as (select k, sum(least(8, coalesce(nxt - i, 8)))::bigint as r from (select k, i, lead(i) over (partition by k order by i) as nxt from twice) group by k),
m as (select w.k, doc_id, lang, source, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
      (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(r, 0)::bigint as n_repeat_words, len(ls)::bigint as n_lines,
      (length(t) - length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]', '', 'g')))::bigint as n_upper
      from w left join rep on w.k = rep.k),
f as (select *, coalesce(1000 * n_symbols // nullif(word_chars, 0), 0) as symbol_pm, coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) as dup_pm,
      coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) as repeat_pm, coalesce(1000 * n_upper // nullif(word_chars, 0), 0) as upper_pm,
      coalesce(100 * word_chars // nullif(n_words, 0), 0) as len_c from m),
long as (unpivot (select lang, source, symbol_pm, dup_pm, repeat_pm, upper_pm, len_c from f) on symbol_pm, dup_pm, repeat_pm, upper_pm, len_c into name measure value v),
b as (select lang, source, measure, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) as bucket, count(*) as n from long group by all),
lv as (select 0 as lvl, lang as g1, source as g2, measure, bucket, n from b union all select 1, lang, '*', measure, bucket, n from b union all select 2, '*', '*', measure, bucket, n from b),
mg as (select lvl, g1, g2, measure, bucket, sum(n) as n from lv group by all),
rk as (select *, sum(n) over (partition by lvl, g1, g2, measure order by bucket) as below, sum(n) over (partition by lvl, g1, g2, measure) as total from mg),
q as (select lvl, g1, g2, measure, min(bucket) filter (below * 4 >= total) as q1, min(bucket) filter (below * 4 >= total * 3) as q3, max(total) as total from rk group by all),
fe as (select *, greatest(case measure when 'symbol_pm' then 50 when 'dup_pm' then 300 when 'repeat_pm' then 200 when 'upper_pm' then 300 else 250 end, 3 * (q3 - q1)) as reach from q),
pick as (select g.g1 as lang, g.g2 as source, g.measure,
         case when g.total >= 30 then g.q1 - g.reach when l.total >= 30 then l.q1 - l.reach else a.q1 - a.reach end as lo,
         case when g.total >= 30 then g.q3 + g.reach when l.total >= 30 then l.q3 + l.reach else a.q3 + a.reach end as hi
         from fe g join fe l on g.lvl = 0 and l.lvl = 1 and l.g1 = g.g1 and l.measure = g.measure join fe a on a.lvl = 2 and a.measure = g.measure),
p as (select lang, source, max(hi) filter (measure = 'symbol_pm') as h1, max(hi) filter (measure = 'dup_pm') as h2, max(hi) filter (measure = 'repeat_pm') as h3,
      max(hi) filter (measure = 'upper_pm') as h4, max(hi) filter (measure = 'len_c') as h5, max(lo) filter (measure = 'len_c') as l5 from pick group by all),
r as (select f.*, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
      case when symbol_pm > h1 then 'symbol_pm' when dup_pm > h2 then 'dup_pm' when repeat_pm > h3 then 'repeat_pm' when upper_pm > h4 then 'upper_pm'
           when len_c > h5 or len_c < l5 then 'len_c' end as beyond from f left join p using (lang, source))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and beyond is null) as kept, beyond from r
"""
