"""The catalogue: one query for each operator over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semirix import views
from semirix.functions.semiring import INF
from semirix.operators import genotype, graph, measure, report, triples, verify
from semirix.plans import csrv
from semirix.plans.grammar import GrammarMatrix, csr_bytes, engine_bytes, grammar_bytes, stream_bytes
from semirix.plans.matrix import Matrix, extent, replicate
from semirix.plans.prefix import ranked
from semirix.runtime import new_path
from semirix.sources import binary, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return add


_LONG = "cast(y as bigint) as y"
_X = "select p_partkey as col, cast(p_size as double) as x from part"
_XT = "select p_partkey as col, case when p_partkey % 10 = 3 then 1e9 else p_size end as x from part"
_XB = "select p_partkey as col, case when p_size % 2 = 0 then 1 else 0 end as x from part"
_ORDERS = "select range as row from range((select max(o_orderkey) + 1 from orders))"


def _tropical_x(x: DataFrame) -> DataFrame:
    return x.withColumn("x", F.when(F.col("col") % 10 == 3, F.lit(float(INF))).otherwise(F.col("x")))


def _boolean_x(x: DataFrame) -> DataFrame:
    return x.withColumn("x", (F.col("x") % 2 == 0).cast("double"))


# products of the table of entries

_PLUS = f"select r.row, cast(coalesce(sum(l_quantity * x), 0) as bigint) as y from ({_ORDERS}) r left join (select l_orderkey, l_quantity, x from lineitem join ({_X}) on col = l_partkey) on l_orderkey = r.row group by 1"
_BOOL = f"select r.row, cast(coalesce(max(case when l_quantity <> 0 and x <> 0 then 1 else 0 end), 0) as int) as y from ({_ORDERS}) r left join (select l_orderkey, l_quantity, x from lineitem join ({_XB}) on col = l_partkey) on l_orderkey = r.row group by 1"
_TROP = f"select r.row, cast(least(coalesce(min(case when x >= 1e9 then 1e9 else l_quantity + x end), 1e9), 1e9) as bigint) as y from ({_ORDERS}) r left join (select l_orderkey, l_quantity, x from lineitem join ({_XT}) on col = l_partkey) on l_orderkey = r.row group by 1"


@_query(_PLUS)
def spmv_plustimes(spark: SparkSession, d: str) -> DataFrame:
    return views.quantities(spark, d).multiply(views.sizes(spark, d)).selectExpr("row", _LONG)


@_query(_BOOL)
def spmv_boolean(spark: SparkSession, d: str) -> DataFrame:
    return views.quantities(spark, d).multiply(_boolean_x(views.sizes(spark, d)), "boolean")


@_query(_TROP)
def spmv_tropical(spark: SparkSession, d: str) -> DataFrame:
    return views.quantities(spark, d).multiply(_tropical_x(views.sizes(spark, d)), "tropical")


_UNIT = f"select r.row, cast(coalesce(min(1), 1000000000) as bigint) as y from ({_ORDERS}) r join lineitem on l_orderkey = r.row group by 1 union all select row, 1000000000 from ({_ORDERS}) where row not in (select l_orderkey from lineitem)"


@_query(_UNIT)
def spmv_tropical_unit(spark: SparkSession, d: str) -> DataFrame:
    """Unit weights and x = 0: 1 for each row with an entry."""
    m = views.quantities(spark, d)
    return Matrix(m.entries.withColumn("val", F.lit(1.0)), m.rows, m.cols).multiply(views.sizes(spark, d).withColumn("x", F.lit(0.0)), "tropical")


@_query("select p_partkey as col, cast(coalesce(sum(l_quantity * (l_orderkey % 7)), 0) as bigint) as y from part left join lineitem on l_partkey = p_partkey group by 1")
def spmv_transpose(spark: SparkSession, d: str) -> DataFrame:
    """x A with x = row % 7."""
    m = views.quantities(spark, d)
    x = spark.range(m.rows).select(F.col("id").alias("row"), (F.col("id") % 7).cast("double").alias("x"))
    return m.left_multiply(x).selectExpr("col", _LONG)


def _batch_sql(one: str, y: str, kind: str) -> str:
    return f"select r.row, cast(b.range as int) as b, cast({y} as {kind}) as y from ({_ORDERS}) r cross join range(4) b left join (select l_orderkey, l_quantity, col, x from lineitem join ({one}) on col = l_partkey) on l_orderkey = r.row group by 1, 2"


def _batch(spark: SparkSession, d: str, x: DataFrame, semiring: str) -> DataFrame:
    return views.quantities(spark, d).multiply_batch(x, 4, semiring)


@_query(_batch_sql(_X, "coalesce(sum(l_quantity * (x + b.range)), 0)", "bigint"))
def spmm_plustimes(spark: SparkSession, d: str) -> DataFrame:
    x = replicate(views.sizes(spark, d), 4).withColumn("x", F.col("x") + F.col("b"))
    return _batch(spark, d, x, "plustimes").selectExpr("row", "b", _LONG)


@_query(_batch_sql(_X, "coalesce(max(case when l_quantity <> 0 and (x + b.range) % 3 = 0 then 1 else 0 end), 0)", "int"))
def spmm_boolean(spark: SparkSession, d: str) -> DataFrame:
    x = replicate(views.sizes(spark, d), 4).withColumn("x", ((F.col("x") + F.col("b")) % 3 == 0).cast("double"))
    return _batch(spark, d, x, "boolean")


@_query(_batch_sql(_XT, "least(coalesce(min(case when x >= 1e9 then 1e9 else l_quantity + x + b.range end), 1e9), 1e9)", "bigint"))
def spmm_tropical(spark: SparkSession, d: str) -> DataFrame:
    x = replicate(_tropical_x(views.sizes(spark, d)), 4).withColumn("x", F.when(F.col("x") < INF, F.col("x") + F.col("b")).otherwise(F.col("x")))
    return _batch(spark, d, x, "tropical")


# cells and codes


@_query("select vec_id as row, cast(pos as bigint) as col, cast(val as double) as val from (select vec_id, unnest(embedding) as val, generate_subscripts(embedding, 1) - 1 as pos from embeddings) where val <> 0")
def dense_scan_embeddings(spark: SparkSession, d: str) -> DataFrame:
    cells = views.read(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "val"))
    return Matrix.from_entries(cells, 0, 0).entries


_MD = "select l_orderkey as row, l_partkey as col, round(100 * l_discount) as val from lineitem where round(100 * l_discount) <> 0"
_DICT = f"select row_number() over (order by val) - 1 as val_idx, val from (select distinct val from ({_MD}))"
_COLS = "(select max(p_partkey) + 1 from part)"
_CODES = f"select row, row_number() over (partition by row order by col, val) - 1 as pos, cast(val_idx * {_COLS} + col + 1 as bigint) as code from ({_MD}) m join ({_DICT}) v using (val)"


@_query(_DICT)
def value_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return csrv.value_dictionary(views.discounts(spark, d).entries)


@_query(_CODES)
def csrv_encode(spark: SparkSession, d: str) -> DataFrame:
    return csrv.encode(views.discounts(spark, d))


@_query(_MD)
def csrv_decode(spark: SparkSession, d: str) -> DataFrame:
    m = views.discounts(spark, d)
    values = csrv.value_dictionary(m.entries)
    return csrv.decode(csrv.encode(m, values), values, m.cols)


@_query(f"select r.row, cast(sum(count(l_orderkey)) over (order by r.row) - count(l_orderkey) as bigint) as row_ptr, count(l_orderkey) as nnz from ({_ORDERS}) r left join lineitem on l_orderkey = r.row group by r.row")
def csr_row_ptr(spark: SparkSession, d: str) -> DataFrame:
    return views.quantities(spark, d).row_pointers()


@_query(f"select code, row_number() over (order by code) as id from (select distinct code from ({_CODES}))")
def terminal_compaction(spark: SparkSession, d: str) -> DataFrame:
    return csrv.compacted(csrv.encode(views.discounts(spark, d)))


@_query(f"select (select max(o_orderkey) + 1 from orders) as rows, {_COLS} as cols, count(*) as nnz, count(distinct l_quantity) as distinct_values, count(*) - (select count(*) from (select distinct l_orderkey, l_partkey from lineitem)) as duplicates, 100.0::double * count(*) / ((select max(o_orderkey) + 1 from orders) * {_COLS}) as density_pct from lineitem")
def density_stats(spark: SparkSession, d: str) -> DataFrame:
    return views.quantities(spark, d).density()


@_query("select max(l_orderkey) + 1 as rows, max(l_partkey) + 1 as cols from lineitem")
def matrix_extent(spark: SparkSession, d: str) -> DataFrame:
    return extent(views.quantities(spark, d).entries)


@_query("select cast(l_orderkey as bigint) as row, l_partkey as col, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def duplicate_cells(spark: SparkSession, d: str) -> DataFrame:
    return views.quantities(spark, d).entries.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


# grammars

_OH = "select c_custkey as row, unnest([n_nationkey, 25 + list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) - 1, 30 + n_regionkey])::bigint as col from customer join nation on c_nationkey = n_nationkey"
_CUST = "select range as row from range((select max(c_custkey) + 1 from customer))"


def _hot(spark: SparkSession, d: str) -> GrammarMatrix:
    return GrammarMatrix.compress(views.one_hot(spark, d), 500)


def _line(spark: SparkSession, x: str) -> DataFrame:
    return spark.range(35).select(F.col("id").alias("col"), F.expr(x).cast("double").alias("x"))


@_query(f"select r.row, cast(coalesce(sum(col * 3 % 11 - 4), 0) as bigint) as y from ({_CUST}) r left join ({_OH}) o using (row) group by 1")
def grammar_spmv_plustimes(spark: SparkSession, d: str) -> DataFrame:
    return _hot(spark, d).multiply(_line(spark, "id * 3 % 11 - 4")).selectExpr("row", _LONG)


@_query(f"select r.row, cast(coalesce(max(case when col % 4 = 1 then 1 else 0 end), 0) as int) as y from ({_CUST}) r left join ({_OH}) o using (row) group by 1")
def grammar_spmv_boolean(spark: SparkSession, d: str) -> DataFrame:
    return _hot(spark, d).multiply(_line(spark, "int(id % 4 = 1)"), "boolean")


@_query(f"select r.row, cast(coalesce(min(case when col % 3 = 0 then 1000000000 else 1 + col end), 1000000000) as bigint) as y from ({_CUST}) r left join ({_OH}) o using (row) group by 1")
def grammar_spmv_tropical(spark: SparkSession, d: str) -> DataFrame:
    return _hot(spark, d).multiply(_line(spark, "if(id % 3 = 0, 1e9D, id)"), "tropical")


@_query(f"select r.row, cast(b.range as int) as b, cast(coalesce(sum(col + b.range), 0) as bigint) as y from ({_CUST}) r cross join range(8) b left join ({_OH}) o using (row) group by 1, 2")
def grammar_spmm(spark: SparkSession, d: str) -> DataFrame:
    x = replicate(_line(spark, "id"), 8).withColumn("x", F.col("x") + F.col("b"))
    return _hot(spark, d).multiply_batch(x, 8).selectExpr("row", "b", _LONG)


@_query(f"select r.row, cast(coalesce(sum(col * 3 % 11 - 4), 0) as bigint) as y from ({_CUST}) r left join ({_OH}) o using (row) group by 1")
def grammar_spmv_levels(spark: SparkSession, d: str) -> DataFrame:
    """The same product, a join for each level."""
    return _hot(spark, d).multiply(_line(spark, "id * 3 % 11 - 4"), plan="levels").selectExpr("row", _LONG)


_WIDE = """select row, unnest([list_position(['A', 'N', 'R'], l_returnflag) - 1, 2 + list_position(['F', 'O'], l_linestatus), 5 + round(100 * l_discount)::bigint, 16 + round(100 * l_tax)::bigint])::bigint as col, unnest([1, 2, 3, 4]) as val from
(select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_discount, l_tax, l_quantity, l_extendedprice, l_shipdate) - 1 as row, * from lineitem)"""


@_query(f"select row, cast(sum(val * (col + 1)) as bigint) as y from ({_WIDE}) group by 1")
def grammar_spmv_wide(spark: SparkSession, d: str) -> DataFrame:
    """Line items, one-hot: few patterns in many rows."""
    x = spark.range(25).select(F.col("id").alias("col"), (F.col("id") + 1.0).alias("x"))
    return GrammarMatrix.compress(views.wide_one_hot(spark, d), 4000).multiply(x).selectExpr("row", _LONG)


@_query(f"select row, row_number() over (partition by row order by col) - 1 as pos, col + 1 as code from ({_OH})")
def grammar_expand_csrv(spark: SparkSession, d: str) -> DataFrame:
    return _hot(spark, d).csrv()


@_query(f"select row, col, 1.0::double as val from ({_OH})")
def grammar_entries(spark: SparkSession, d: str) -> DataFrame:
    return _hot(spark, d).entries()


@_query(_CODES)
def grammar_compress(spark: SparkSession, d: str) -> DataFrame:
    """The rules' shape is free, so it is what they expand to that is compared: many columns and values, blocks cut by entries."""
    return GrammarMatrix.compress(views.discounts(spark, d), 5000, 4000).csrv()


# the grammar of parts: deep, shared, with runs; rules and top are columns of the tables

_PA = views.PART_ALPHA
_R = f"""r as (select p_partkey + {_PA} as sym, case when p_partkey % 4 = 0 or p_partkey < 2 then p_size % {_PA - 1} + 1 else {_PA} + p_partkey // 2 end as l,
 case when p_partkey % 11 = 5 and p_partkey >= 2 then null when p_partkey % 3 = 0 and p_partkey >= 3 then {_PA} + p_partkey // 3 else (p_partkey * 7) % {_PA - 1} + 1 end as r,
 case when p_partkey % 11 = 5 and p_partkey >= 2 then 2 + p_size % 2 else 1 end as rep from part)"""
_TOP = f"t as (select l_orderkey as row, l_partkey + {_PA} as sym from lineitem union all select o_orderkey, o_custkey % {_PA - 1} + 1 from orders where o_orderkey % 5 = 0)"
_LV = f"with recursive {_R}, {_TOP}, e as (select sym, l as c from r union all select sym, r from r where r is not null), p(sym, lvl) as (select sym, 1 from r union select e.sym, p.lvl + 1 from e join p on e.c = p.sym), lv as (select sym, max(lvl) as lvl from p group by 1), mr as (select lv.sym, lv.lvl, greatest(lv.lvl, coalesce(max(u.lvl), 0)) as maxref from lv left join e on e.c = lv.sym left join lv u on u.sym = e.sym group by 1, 2)"
_SLOTS = f"{_LV}, alive as (select sym, lvl as born, unnest(range(lvl, maxref + 1)) as lvl from mr), sl as (select lvl, row_number() over (partition by lvl order by born desc, sym) - 1 as slot, sym, born = lvl as own from alive), cd as (select c as code, row_number() over (order by c) as id from (select distinct c from (select c from e union all select sym from t) where c < {_PA}))"
_EMIT = f"{_SLOTS}, em as (select sl.lvl, slot, row from t join sl on sl.sym = t.sym and own union all select 0, id, row from t join cd on code = t.sym)"


def _parts(spark: SparkSession, d: str) -> GrammarMatrix:
    return views.part_grammar(spark, d).check()


@_query(f"{_LV} select sym::bigint as sym, lvl::int as lvl from lv")
def grammar_levels(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).levels().select("sym", "lvl")


@_query(f"{_LV} select sym::bigint as sym, lvl::int as lvl from lv")
def grammar_levels_joined(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).levels("levels").select("sym", "lvl")


@_query(f"{_LV} select sym::bigint as sym, lvl::int as lvl, maxref::int as maxref from mr")
def grammar_maxref(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).schedule().select("sym", "lvl", "maxref")


@_query(f"{_LV} select k::int as lvl, count(*) as width, count(*) filter (lvl = k) as rules from (select lvl, unnest(range(lvl, maxref + 1)) as k from mr) group by 1")
def grammar_widths(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).widths()


@_query(f"""{_SLOTS}, s as (select max(lvl)::int as depth, (select max(w) from (select count(*) as w from sl group by lvl)) as max_width, (count(*) + sum(maxref - lvl))::bigint as total_rules, count(*) as raw_rules, sum(maxref - lvl)::bigint as pass_throughs,
 (select count(*) from t where sym >= {_PA}) as emissions, (select count(*) from t where sym < {_PA}) as terminal_emissions, (select count(*) + 1 from cd) as alpha_used from mr)
 select *, 4 * alpha_used + 12 * total_rules + 8 * (alpha_used - 1) + 8 + 4 * {views.PART_COLS} + 4 * (select max(o_orderkey) + 1 from orders) + 8 * max_width + 8 * emissions + 8 * terminal_emissions as engine_bytes from s""")
def grammar_stats(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).stats()


@_query(f"""{_SLOTS}, nd as (select sl.lvl, slot, case when own then r.l else sl.sym end as a, case when own then r.r end as b, case when own then rep else 1 end as coeff from sl join r using (sym))
 select nd.lvl::int as lvl, nd.slot, coalesce(x.slot, -cx.id - 1, -1) as "left", coalesce(y.slot, -cy.id - 1, -1) as "right", coeff::int as coeff
 from nd left join sl x on x.lvl = nd.lvl - 1 and x.sym = a left join cd cx on cx.code = a left join sl y on y.lvl = nd.lvl - 1 and y.sym = b left join cd cy on cy.code = b""")
def grammar_layered(spark: SparkSession, d: str) -> DataFrame:
    """Rules between neighbouring levels, as a device lays them out."""
    return _parts(spark, d).layered()


@_query(f"{_EMIT} select lvl::int as lvl, slot, row::bigint as row from em")
def grammar_emissions(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).emissions()


@_query(f"{_EMIT}, w as (select sl.lvl, count(*) as nodes, (select count(*) from em where em.lvl = sl.lvl) as emissions from sl group by 1) select lvl::int as lvl, nodes, (sum(nodes) over (order by lvl) - nodes)::bigint as node_offset, emissions, (sum(emissions) over (order by lvl) - emissions)::bigint as emission_offset from w")
def grammar_level_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).level_offsets()


@_query(f"{_SLOTS} select code::bigint as code, id from cd")
def grammar_compaction(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).compaction()


@_query(f"{_SLOTS} select {_PA}::bigint as codes, (select count(*) + 1 from cd) as used, 100.0::double * (select count(*) + 1 from cd) / {_PA} as kept_pct")
def grammar_compaction_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).compaction_ratio()


# what each symbol expands to: the codes with how often they occur; paths go down one level at a time
_PATHS = f"with recursive {_R}, {_TOP}, q(sym, c, m) as (select sym, c, m from (select sym, l as c, rep as m from r union all select sym, r, 1 from r where r is not null) union all select q.sym, e.c, q.m * e.m from q join (select sym, l as c, rep as m from r union all select sym, r, 1 from r where r is not null) e on e.sym = q.c), x as (select sym, c as code, sum(m) as m from q where c < {_PA} group by 1, 2 union all select code, code, 1 from range(1, {_PA}) v(code)), cell as (select row, (code - 1) % {views.PART_COLS} as col, case (code - 1) // {views.PART_COLS} when 0 then 1.0 else 3.0 end as val, m from t join x using (sym))"
_PARTX = "id * 5 % 9 - 3"


def _parts_line(spark: SparkSession, x: str) -> DataFrame:
    return spark.range(views.PART_COLS).select(F.col("id").alias("col"), F.expr(x).cast("double").alias("x"))


@_query(f"{_PATHS} select r.row, cast(coalesce(sum(m * val * (col * 5 % 9 - 3)), 0) as bigint) as y from ({_ORDERS}) r left join cell using (row) group by 1")
def runlen_eval(spark: SparkSession, d: str) -> DataFrame:
    """A product over rules with runs: a run adds its value as often as it is long."""
    return _parts(spark, d).multiply(_parts_line(spark, _PARTX)).selectExpr("row", _LONG)


@_query(f"{_PATHS} select r.row, cast(coalesce(min(val + col % 6), 1000000000) as bigint) as y from ({_ORDERS}) r left join cell using (row) group by 1")
def runlen_eval_tropical(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).multiply(_parts_line(spark, "id % 6"), "tropical").selectExpr("row", _LONG)


@_query(f"{_PATHS} select c.range as col, cast(coalesce(sum(m * val * (row % 7)), 0) as bigint) as y from range({views.PART_COLS}) c left join cell on col = c.range group by 1")
def grammar_left_product(spark: SparkSession, d: str) -> DataFrame:
    """x A with x = row % 7, down the rules."""
    g = _parts(spark, d)
    return g.left_multiply(spark.range(g.rows).select(F.col("id").alias("row"), (F.col("id") % 7).cast("double").alias("x"))).selectExpr("col", _LONG)


@_query(f"select c.range as col, cast(coalesce(min(1 + row % 11), 1000000000) as bigint) as y from range(35) c left join ({_OH}) o on col = c.range group by 1")
def grammar_left_tropical(spark: SparkSession, d: str) -> DataFrame:
    g = _hot(spark, d)
    return g.left_multiply(spark.range(g.rows).select(F.col("id").alias("row"), (F.col("id") % 11).cast("double").alias("x")), "tropical").selectExpr("col", _LONG)


@_query(f"select r.row, count(*)::bigint as symbols from ({_ORDERS}) r join (with {_TOP} select row from t) t using (row) group by 1")
def grammar_row_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Top symbols of each row, from a stream with 0 after each: rows are told by the delimiters."""
    g = _parts(spark, d)
    ends = spark.range(g.rows).select(F.col("id").alias("row"), F.lit(1 << 40).alias("pos"), F.lit(0).cast("long").alias("sym"))
    stream = ranked(g.top.select("row", "pos", "sym").unionAll(ends), ["row", "pos"], "idx").select("idx", "sym")
    return binary.rows_of(stream).groupBy("row").agg(F.count(F.lit(1)).alias("symbols"))


@_query("select nat, (4*alpha + 12*rules + 8*(alpha - 1) + 4*n_values + 4*cols + 4*nrows + 8*width + 8*emissions + 8*terminal)::bigint as engine, (4*(nrows + 1) + 8*nnz + 4*cols + 4*nrows)::bigint as csr, (4*(nnz + nrows) + 8)::bigint as csrv, (4*(emissions + terminal + nrows) + 8*raw + 12)::bigint as re32 from (select s_nationkey as nat, count(distinct l_partkey) + 1 as alpha, count(*) as rules, count(distinct l_orderkey) as raw, count(distinct l_quantity) as n_values, count(distinct l_suppkey) as cols, count(distinct l_shipdate) as nrows, count(distinct l_tax) as width, count(*) filter (l_returnflag = 'R') as emissions, count(*) filter (l_linestatus = 'F') as terminal, sum(l_linenumber) as nnz from lineitem join supplier on s_suppkey = l_suppkey group by 1)")
def size_formulas(spark: SparkSession, d: str) -> DataFrame:
    """Bytes by the four formulas, of figures of each nation's line items."""
    n = lambda c: F.count_distinct(c)
    own = views.read(spark, d, "lineitem").join(views.read(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy(F.col("s_nationkey").alias("nat")).agg(
        (n("l_partkey") + 1).alias("alpha"), F.count(F.lit(1)).alias("rules"), n("l_orderkey").alias("raw"), n("l_quantity").alias("n_values"), n("l_suppkey").alias("cols"), n("l_shipdate").alias("nrows"), n("l_tax").alias("width"),
        F.count_if(F.col("l_returnflag") == "R").alias("emissions"), F.count_if(F.col("l_linestatus") == "F").alias("terminal"), F.sum("l_linenumber").alias("nnz"),
    )
    return own.select(
        "nat", engine_bytes("alpha", "rules", "n_values", "cols", "nrows", "width", "emissions", "terminal").alias("engine"), csr_bytes("nrows", "nnz", "cols").alias("csr"), stream_bytes("nnz", "nrows").alias("csrv"),
        grammar_bytes(F.col("emissions") + F.col("terminal") + F.col("nrows"), "raw").alias("re32"),
    )


# files: written to the shared folder by this engine's writers, and read again


@_query(f"{_PATHS} select r.row, cast(coalesce(sum(m * val * (col * 5 % 9 - 3)), 0) as bigint) as y from ({_ORDERS}) r left join cell using (row) group by 1")
def file_grammar(spark: SparkSession, d: str) -> DataFrame:
    """Values, rules and top as arrays, and a vector beside them. Files have pairs only: a run goes into pairs first."""
    g, at = _parts(spark, d), new_path(spark, "files")
    binary.write_grammar(g.paired(), f"{at}/m")
    x = _parts_line(spark, _PARTX)
    binary.write_array(x, "col", "x", "f32", f"{at}/x")
    return binary.read_grammar(spark, f"{at}/m", g.rows, g.cols).multiply(binary.read_vector(spark, f"{at}/x", g.cols)).selectExpr("row", _LONG)


@_query("select dense_rank() over (order by vec_id) - 1 as row, cast(pos as bigint) as col, cast(val as double) as val from (select vec_id, unnest(embedding) as val, generate_subscripts(embedding, 1) - 1 as pos from embeddings) where val <> 0")
def file_dense_f32(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d, "f32")


def _dense(spark: SparkSession, d: str, kind: str) -> DataFrame:
    e = ranked(views.read(spark, d, "embeddings").select("vec_id", "embedding"), ["vec_id"], "row")
    cells, at = e.select("row", F.posexplode("embedding").alias("col", "val")), new_path(spark, "dense")
    cols = e.select(F.max(F.size("embedding"))).first()[0]
    binary.write_dense(cells.select("row", F.col("col").cast("long").alias("col"), F.col("val").cast("double").alias("val")), e.count(), cols, at, kind)
    return binary.read_dense(spark, at, cols, kind)


_QUANT = "select o_orderkey as row, o_custkey % 9 as col, (o_custkey % 4)::double as val from orders where o_custkey % 4 <> 0"


def _quant(spark: SparkSession, d: str) -> DataFrame:
    return views.read(spark, d, "orders").filter("o_custkey % 4 <> 0").selectExpr("o_orderkey as row", "o_custkey % 9 as col", "cast(o_custkey % 4 as double) as val")


@_query(_QUANT)
def file_dense_i32(spark: SparkSession, d: str) -> DataFrame:
    at, rows = new_path(spark, "dense"), views._size(views.read(spark, d, "orders"), "o_orderkey")
    binary.write_dense(_quant(spark, d), rows, 9, at)
    return binary.read_dense(spark, at, 9)


@_query(_QUANT.replace("(o_custkey % 4)::double", "1.0::double"))
def file_dense_bool(spark: SparkSession, d: str) -> DataFrame:
    at, rows = new_path(spark, "dense"), views._size(views.read(spark, d, "orders"), "o_orderkey")
    binary.write_dense(_quant(spark, d).withColumn("val", F.lit(1.0)), rows, 9, at, "bool")
    return binary.read_dense(spark, at, 9, "bool")


@_query(_QUANT)
def file_csv(spark: SparkSession, d: str) -> DataFrame:
    """Lines of nine comma-separated numbers, one for each row."""
    at, rows = new_path(spark, "csv"), views._size(views.read(spark, d, "orders"), "o_orderkey")
    cells = _quant(spark, d).groupBy("row").agg(*[F.coalesce(F.sum(F.when(F.col("col") == j, F.col("val"))), F.lit(0)).cast("int").alias(f"v{j}") for j in range(9)])
    every = spark.range(rows).select(F.col("id").alias("row")).join(cells, "row", "left").fillna(0)
    every.select("row", F.concat_ws(",", *[f"v{j}" for j in range(9)]).alias("value")).write.parquet(at)
    return text.csv_cells(spark.read.parquet(at))


@_query("select distinct l_orderkey as row, l_partkey as col from lineitem")
def file_edges(spark: SparkSession, d: str) -> DataFrame:
    at = new_path(spark, "edges")
    text.write_edges(views.quantities(spark, d).entries.select("row", "col").distinct(), at)
    return text.read_edges(spark, at)


@_query("select p_partkey as col, p_size::double as x from part")
def file_vector(spark: SparkSession, d: str) -> DataFrame:
    at, x = new_path(spark, "x"), views.sizes(spark, d)
    binary.write_array(x, "col", "x", "f32", at)
    return binary.read_vector(spark, at, x.count())


# triples

_T = "select o_custkey as s, 1 as p, o_orderkey as o from orders union all select l_orderkey, 2, l_partkey from lineitem union all select l_partkey, 3, l_suppkey from lineitem union all select s_suppkey, 4, s_nationkey from supplier union all select n_nationkey, 5, n_regionkey from nation"


@_query(f"select p::bigint as p, coalesce(name, 'Unknown_' || p) as name, count(*) as n, count(distinct s) as subjects, count(distinct o) as objects, count(distinct s) * count(distinct o) * 4 as dense_bytes, round(count(distinct s) * count(distinct o) * 4 / 1048576.0::double, 2) as dense_mb from ({_T}) left join (values (1, 'places'), (2, 'contains'), (3, 'supplied_by'), (4, 'based_in')) v(q, name) on q = p group by 1, 2")
def triples_analyze(spark: SparkSession, d: str) -> DataFrame:
    return triples.analyze(views.triples(spark, d), spark.createDataFrame(views.PREDICATES, "p long, name string"))


def _ids_sql(p: str) -> str:
    return f"select p::bigint as p, dense_rank() over (partition by p order by s) - 1 as row, dense_rank() over (partition by p order by o) - 1 as col from ({_T}) where p in ({p})"


@_query(_ids_sql("2, 4, 5"))
def triples_sparse(spark: SparkSession, d: str) -> DataFrame:
    return triples.sparse(views.triples(spark, d), [2, 4, 5])


@_query(f"select distinct row, col, 1.0::double as val from ({_ids_sql('3')})")
def triples_dense(spark: SparkSession, d: str) -> DataFrame:
    return triples.build(views.triples(spark, d), 3)


@_query(f"with n as (select v, row_number() over (order by v) - 1 as id from (select s as v from ({_T}) where p = 1 union select o from ({_T}) where p = 1)) select a.id as src, b.id as dst from ({_T}) t join n a on a.v = s join n b on b.v = o where p = 1")
def triples_square(spark: SparkSession, d: str) -> DataFrame:
    return triples.square(views.triples(spark, d), 1)[1]


@_query("select l_orderkey as row, l_partkey as col from lineitem where l_linenumber % 4 <> 3")
def edge_list_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines with one or two spaces between the numbers; those with one number, and empty ones, are dropped."""
    line = F.expr("case l_linenumber % 4 when 3 then if(l_partkey % 2 = 0, '', string(l_orderkey)) when 2 then concat(' ', l_orderkey, '  ', l_partkey) else concat(l_orderkey, ' ', l_partkey) end")
    return text.edges_of(views.read(spark, d, "lineitem").select(line.alias("value")))


@_query("select l_orderkey as s, l_linenumber::bigint as p, l_partkey as o from lineitem where l_suppkey % 3 <> 0")
def triple_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines of three numbers; those with two or four are dropped."""
    line = F.expr("if(l_suppkey % 3 <> 0, concat(l_orderkey, ' ', l_linenumber, ' ', l_partkey), if(l_suppkey % 2 = 0, concat(l_orderkey, ' ', l_linenumber), concat(l_orderkey, ' ', l_linenumber, ' 1 2')))")
    return text.triples_of(views.read(spark, d, "lineitem").select(line.alias("value")))


@_query("select n_nationkey::bigint as p, n_name || ' of ' || r_name as name from nation join region on r_regionkey = n_regionkey where n_nationkey % 6 <> 5")
def predicate_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a number and a name with spaces; those without a name are dropped."""
    n = views.read(spark, d, "nation").join(views.read(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return text.predicates_of(n.select(F.expr("if(n_nationkey % 6 = 5, string(n_nationkey), concat(n_nationkey, ' ', n_name, ' of ', r_name))").alias("value")))


# genotypes

_GT = "case when (p_partkey * 7 + i * 3) % 5 < 2 then '0|1' when (p_partkey + i) % 7 = 0 then '1/1' when (p_partkey + i) % 11 = 0 then './.' else '0|0' end"


_DOSE = f"select i as row, variant as col, v::double as val from (select i, variant, (gt[1] = '1')::int + (gt[3] = '1')::int as v from (select i, variant, {_GT} as gt from (select p_partkey, row_number() over (order by p_partkey) - 1 as variant from part where p_size % 3 <> 0), range(12) t(i))) where v <> 0"


def _variants(spark: SparkSession, d: str) -> DataFrame:
    gts = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.when((F.col("p_partkey") * 7 + i * 3) % 5 < 2, F.lit("0|1")).when((F.col("p_partkey") + i) % 7 == 0, F.lit("1/1")).when((F.col("p_partkey") + i) % 11 == 0, F.lit("./.")).otherwise(F.lit("0|0")))
    line = F.concat_ws("\t", F.lit("1"), F.col("p_partkey").cast("string"), F.lit("."), F.lit("A"), F.when(F.col("p_size") % 3 == 0, F.lit("AT")).otherwise(F.lit("C")), F.lit("."), F.lit("."), F.lit("."), F.lit("GT"), F.array_join(gts, "\t"))
    lines = views.read(spark, d, "part").select(F.col("p_partkey").alias("n"), line.alias("value")).unionAll(spark.createDataFrame([(-1, "##fileformat=VCFv4.2")], "n long, value string"))
    return text.variants_of(lines)


@_query(_DOSE)
def vcf_dosage(spark: SparkSession, d: str) -> DataFrame:
    return genotype.dosage(_variants(spark, d))


@_query(f"select * from ({_DOSE}) where col < 100")
def vcf_first_variants(spark: SparkSession, d: str) -> DataFrame:
    """The operator's limit to the first variants of the file."""
    return genotype.dosage(_variants(spark, d), 100)


_HAP = "select p_partkey as site, h as hap, ((p_partkey * 31 + h * 17 + p_partkey * h) % 23 < p_size % 24)::int as allele from part, range(20) t(h)"


def _haplotypes(spark: SparkSession, d: str) -> DataFrame:
    p = views.read(spark, d, "part").select(F.col("p_partkey").alias("site"), "p_size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("hap"))
    return p.select("site", "hap", ((F.col("site") * 31 + F.col("hap") * 17 + F.col("site") * F.col("hap")) % 23 < F.col("p_size") % 24).cast("int").alias("allele"))


@_query(f"select site, hap, allele from (select *, sum(allele) over (partition by site) as c from ({_HAP})) where c > 0 and c < 20")
def segregating_sites(spark: SparkSession, d: str) -> DataFrame:
    return genotype.segregating(genotype.binarized(_haplotypes(spark, d)))


@_query(f"select hap // 2 as row, site as col, sum(allele)::double as val from ({_HAP}) group by 1, 2 having sum(allele) <> 0")
def haplotype_pairing(spark: SparkSession, d: str) -> DataFrame:
    return genotype.paired(_haplotypes(spark, d))


@_query()
def genotype_simulation(spark: SparkSession, d: str) -> DataFrame:
    return genotype.genotypes(spark, 40, 300)


@_query("select round(sum(1.0::double / i), 9) as harmonic from range(1, 1000) t(i)")
def harmonic_number(spark: SparkSession, d: str) -> DataFrame:
    return genotype.harmonic(spark, 1000).select(F.round("harmonic", 9).alias("harmonic"))


# graphs: suppliers and parts, two-sided

_PARTS = "(select max(p_partkey) + 1 from part)"
_E = f"select distinct l_partkey as src, l_suppkey + {_PARTS} as dst from lineitem"
_E2 = f"{_E} union select l_suppkey + {_PARTS}, l_partkey from lineitem"
_WALK = "with recursive e as ({e}), w(id, k) as (select 0::bigint, 0 union select dst, k + 1 from w join e on src = id where k < {n})"


def _edges(spark: SparkSession, d: str, both: bool = True) -> DataFrame:
    """Parts and the suppliers that they come from."""
    cells = views.read(spark, d, "lineitem").selectExpr("l_partkey as row", "l_suppkey as col").distinct()
    e = triples.bipartite(cells, views._size(views.read(spark, d, "part"), "p_partkey"))
    return e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct() if both else e


@_query(f"{_WALK.format(e=_E2, n=16)} select id, min(k)::bigint as level from w group by 1")
def bfs_levels(spark: SparkSession, d: str) -> DataFrame:
    return graph.bfs(_edges(spark, d), 0)


@_query(f"{_WALK.format(e=_E2, n=16)} select id, min(k)::double as dist from w group by 1")
def sssp_unit(spark: SparkSession, d: str) -> DataFrame:
    return graph.sssp(_edges(spark, d), 0)


_NODES = f"{_PARTS} + (select max(s_suppkey) + 1 from supplier)"


def _nodes(spark: SparkSession, d: str) -> int:
    return views._size(views.read(spark, d, "part"), "p_partkey") + views._size(views.read(spark, d, "supplier"), "s_suppkey")


@_query(f"{_WALK.format(e=_E2, n=16)} select range as row, (range in (select id from w))::int as y from range({_NODES})")
def reach_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    m = Matrix.from_entries(_edges(spark, d).select(F.col("dst").alias("row"), F.col("src").alias("col"), F.lit(1.0).alias("val")), n, n)
    return graph.fixpoint(m, spark.range(n).select(F.col("id").alias("col"), (F.col("id") == 0).cast("double").alias("x")))


def _apsp_sql() -> str:
    walk = "with recursive e as ({e}), w(s, id, k) as (select s, s, 0 from (values (0::bigint), (5::bigint)) v(s) union select s, src, k + 1 from w join e on dst = id where k < 16)".format(e=_E2)
    return f"{walk} select n.range as row, b::int as b, coalesce(min(k), 1000000000)::bigint as y from range({_NODES}) n cross join (values (0, 0::bigint), (1, 5::bigint)) v(b, s) left join w on w.s = v.s and w.id = n.range group by 1, 2"


@_query(_apsp_sql())
def apsp_batch(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    return graph.apsp(Matrix.from_entries(_edges(spark, d).select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(1.0).alias("val")), n, n), [0, 5])


# checks


@_query(f"select count(*) as n, 0::bigint as unmatched, 0.5::double as max_abs, round(max(0.5::double / (1 + y)), 9) as max_rel, max(y)::double as max_a, count(*) filter (row % 2 = 0) as mismatches, false as passed from ({_PLUS})")
def verify_maxrel(spark: SparkSession, d: str) -> DataFrame:
    """The product against itself with a half taken from every other row."""
    y = spmv_plustimes(spark, d)
    off = y.withColumn("y", F.when(F.col("row") % 2 == 0, F.col("y") - 0.5).otherwise(F.col("y").cast("double")))
    return verify.compare(off, y).withColumn("max_rel", F.round("max_rel", 9)).withColumn("max_a", F.ceil("max_a").cast("double"))


@_query(f"select count(*) as n, 0::bigint as unmatched, 0.5::double as max_abs, round(max(0.5::double / (1 + y)), 9) as max_rel, max(y)::double as max_a, count(*) filter (row % 2 = 0) as mismatches, false as passed from ({_PLUS}) where row < 2000")
def verify_first_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same comparison of the first 2000 rows only."""
    y = spmv_plustimes(spark, d)
    off = y.withColumn("y", F.when(F.col("row") % 2 == 0, F.col("y") - 0.5).otherwise(F.col("y").cast("double")))
    return verify.compare(off, y, first_rows=2000).withColumn("max_rel", F.round("max_rel", 9)).withColumn("max_a", F.ceil("max_a").cast("double"))


@_query(f"select row, least(y * 1e6, 1e9)::double as y from ({_PLUS})")
def verify_clipped(spark: SparkSession, d: str) -> DataFrame:
    """Results with what is above the stand-in for infinity as that."""
    return verify.clipped(spmv_plustimes(spark, d).withColumn("y", F.col("y") * 1e6))


@_query(f"select count(*) as n, 0::bigint as unmatched, 0.0::double as max_abs, 0.0::double as max_rel, 1.0::double as max_a, 0::bigint as mismatches, true as passed from ({_BOOL})")
def verify_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Path counts as bits against the Boolean product."""
    m, x = views.quantities(spark, d), _boolean_x(views.sizes(spark, d))
    return verify.compare(verify.as_bits(m.multiply(x)), m.multiply(x, "boolean"))


@_query(f"select count(*) * 3 as cells, 0::bigint as different from ({_ORDERS})")
def verify_batch(spark: SparkSession, d: str) -> DataFrame:
    """Every column of a batch of one vector against the single product."""
    m, x = views.quantities(spark, d), views.sizes(spark, d)
    return verify.columns_equal(m.multiply_batch(replicate(x, 3), 3), m.multiply(x))


@_query(f"select row, y from ({_PLUS}) order by y desc, row limit 20")
def topk_rows(spark: SparkSession, d: str) -> DataFrame:
    return spmv_plustimes(spark, d).orderBy(F.desc("y"), "row").limit(20)


@_query("select count(*) as n from part")
def xvec_length_check(spark: SparkSession, d: str) -> DataFrame:
    from semirix.plans.matrix import checked_vector

    x = views.sizes(spark, d)
    return checked_vector(x, views._size(views.read(spark, d, "part"), "p_partkey")).agg(F.count(F.lit(1)).alias("n"))


@_query()
def measure_products(spark: SparkSession, d: str) -> DataFrame:
    """Milliseconds of a vector, single and in a batch of eight, beside the grammar's figures."""
    g = _hot(spark, d)
    one = _line(spark, "id")
    single = measure.timed(spark, "customers/1", lambda: g.multiply(one))
    eight = measure.timed(spark, "customers/8", lambda: g.multiply_batch(replicate(one, 8), 8), batch=8)
    return measure.with_sizes(single.unionByName(eight), g.stats())


@_query(f"select 'entries' as base, name, count(*) as n, 0::bigint as unmatched, 0.0::double as max_abs, 0::bigint as mismatches, true as passed from ({_CUST}) cross join (values ('sweep'), ('levels'), ('expanded'), ('batch')) v(name) group by 2")
def cross_check(spark: SparkSession, d: str) -> DataFrame:
    """All ways to one product against the entries."""
    m, g, x = views.one_hot(spark, d), _hot(spark, d), _line(spark, "id * 3 % 11 - 4")
    batch = g.multiply_batch(replicate(x, 3), 3).filter("b = 1").select("row", "y")
    return verify.cross_check({"entries": m.multiply(x), "sweep": g.multiply(x), "levels": g.multiply(x, plan="levels"), "expanded": g.multiply(x, plan="entries"), "batch": batch})


# reports over logs whose figures are the tables'

_FACTS = "f as (select s_suppkey as k, s_nationkey as nat, count(l_orderkey) as n, coalesce(sum(l_quantity), 0)::bigint as q, count(distinct l_orderkey) as c, s_suppkey % 7 = 0 as lost from supplier left join lineitem on l_suppkey = s_suppkey group by all)"


def _abbr(v: str) -> str:
    return f"case when {v} >= 1000000 then (({v} + 5000) // 10000 // 100) || '.' || lpad((({v} + 5000) // 10000 % 100)::varchar, 2, '0') || 'M' when {v} >= 1000 then (({v} + 50) // 100 // 10) || '.' || (({v} + 50) // 100 % 10) || 'K' else ({v})::varchar end"


def _dec(v: str, parts: int, digits: int) -> str:
    """SQL for the whole number v over ``parts`` with ``digits`` decimals, halves up."""
    h = f"(({v}) * {10**digits} * 2 + {parts}) // {2 * parts}"
    return f"({h}) // {10**digits} || '.' || lpad((({h}) % {10**digits})::varchar, {digits}, '0')" if digits else f"({h})::varchar"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return text.log_blocks(views.supplier_log(spark, d))


def _config(spark: SparkSession, d: str) -> DataFrame:
    """ord, grp, key, label, nnz, crossover: every second supplier, by parity of its nation; the seventh is the crossover."""
    f = views.supplier_facts(spark, d).filter("k % 2 = 1")
    return f.select(F.col("k").cast("int").alias("ord"), F.concat(F.lit("group "), (F.col("nat") % 2).cast("string")).alias("grp"), F.concat(F.lit("s"), "k").alias("key"), F.concat(F.lit("S"), "k").alias("label"), (F.col("n") * 100).alias("nnz"), (F.col("k") == 7).alias("crossover"))


@_query(f"with {_FACTS}, l as (select 0 as i, 'even' as grp, * from f where nat % 2 = 0 union all select 1, 'odd', * from f where nat % 2 = 1) select row_number() over (order by i, k)::int as ord, grp, 's' || k as key, 'S' || k as label, n * 100 as nnz from l")
def dataset_list(spark: SparkSession, d: str) -> DataFrame:
    """Two lists of datasets, one after the other."""
    f = views.supplier_facts(spark, d).select("nat", F.col("k").alias("ord"), F.concat(F.lit("s"), "k").alias("key"), F.concat(F.lit("S"), "k").alias("label"), (F.col("n") * 100).alias("nnz"))
    return report.listed({"even": f.filter("nat % 2 = 0"), "odd": f.filter("nat % 2 = 1")})


@_query(f"with {_FACTS} select 'nation' || nat as file, 's' || k as key, k * 100 + 9 as n, '--- LIBRARY ---' as line from f union all select 'nation' || nat, 's' || k, k * 100 + 3, 'MEM analytic bytes: ' || (q * 1000) from f union all select 'nation' || nat, 's' || k, k * 100 + 19, ' >> REANS size: ' || (c * 500) || ' bytes' from f")
def log_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Three lines of every block with the block's key; the lines above the first block are in none."""
    return _log(spark, d).filter("line = '--- LIBRARY ---' or n % 100 = 3 or line like '%REANS%' or key is null or line like '# a log%'").select("file", "key", "n", "line")


@_query(f"with {_FACTS} select 's' || k as key, nat + 1 as depth, n as width, q + c as total, c as raw, q as passed, n as emissions, c as terminal_emissions from f")
def log_struct(spark: SparkSession, d: str) -> DataFrame:
    return report.structure(_log(spark, d))


@_query(f"with {_FACTS} select k::int as ord, 'S' || k as label, nat + 1 as depth, {_abbr('n')} as width, {_abbr('(q + c)')} as total, {_abbr('c')} as raw, {_abbr('q')} as passed from f where k % 2 = 1")
def log_struct_table(spark: SparkSession, d: str) -> DataFrame:
    return report.structure_table(_config(spark, d).select("ord", "key", "label"), _log(spark, d))


@_query(f"with {_FACTS} select k::int as ord, 'S' || k as label, {_abbr('(n * 100)')} as nnz, {_abbr('c')} as raw, {_abbr('(q + c)')} as total, nat + 1 as depth, {_abbr('n')} as width, {_abbr('q')} as passed from f where k % 2 = 1")
def relation_structure(spark: SparkSession, d: str) -> DataFrame:
    return report.relation_structure(_config(spark, d).select("ord", "key", "label", "nnz"), _log(spark, d))


def _parted(spark: SparkSession, d: str) -> DataFrame:
    return text.parts_of(_log(spark, d), "^--- (LIBRARY|GRAMMAR)")


@_query(f"with {_FACTS} select 's' || k as key, n / 100.0::double as ms, case when not lost then n / 50.0::double end as library_ms, (q * 1000)::double as bytes, case when not lost then (n * 4000)::double end as library_bytes, c / 4.0::double as mj, case when not lost then c / 2.0::double end as library_mj, lost as oom from f")
def space_energy(spark: SparkSession, d: str) -> DataFrame:
    out = report.space_energy(_parted(spark, d))
    return out.withColumns({c: F.col(c).cast("double") for c in ("bytes", "library_bytes")})


@_query(f"""with {_FACTS}, g as (select * from f where k % 2 = 1), none as (select if(k = 7, 'OOM', '--') as v, k as kk from g)
 select k::int as ord, 1 as line, 'S' || k as label, case when k % 3 = 0 then {_abbr('(n * 1000)')} else {_abbr('(n * 100)')} end as nnz, {_dec('q', 1000, 1)} as engine_mb, case when lost then v else {_dec('n * 4', 1000, 1)} end as library_mb, {_dec('n', 100, 2)} as engine_ms,
 case when lost then v else {_dec('n', 50, 2)} end as library_ms, {_dec('c', 4, 0)} as engine_mj, case when lost then v else {_dec('c', 2, 0)} end as library_mj from g join none on kk = k
 union all select min(k)::int, 0, 'group ' || (nat % 2), null, null, null, null, null, null, null from g where k <> 7 group by nat % 2""")
def space_energy_table(spark: SparkSession, d: str) -> DataFrame:
    """With a header row for each group and the crossover row, which tells where the library ran out of memory."""
    return report.space_energy_table(_config(spark, d), _parted(spark, d))


@_query(f"with {_FACTS} select k::int as ord, 'S' || k as label, format('{{:,}}', n * 100) as nnz, format('{{:,}}', c) as rules, nat + 1 as depth, {_dec('c * 500', 1000000, 1)} as packed_mb, case when lost then '--' else {_dec('n * 4000', 1000000, 1)} end as library_mb, {_dec('q * 1000', 1000000, 1)} as engine_mb, {_dec('n', 100, 2)} || ' / ' || case when lost then '--' else {_dec('n', 50, 2)} end as ms from f where k % 2 = 1")
def scale_table(spark: SparkSession, d: str) -> DataFrame:
    return report.scale_table(_config(spark, d).select("ord", "key", "label", "nnz"), _parted(spark, d))


@_query(f"with {_FACTS} select count(*) filter (k % 5 <> 0) as successes, count(*) filter (k % 5 = 0) as failures from f")
def log_tallies(spark: SparkSession, d: str) -> DataFrame:
    return report.tallies(_log(spark, d))


@_query(f"with {_FACTS} select k::int as ord, 'S' || k as label, case when k % 4 = 1 then '--' else {_dec('n', 100, 3)} end as gpu, {_dec('n', 10, 3)} as omp, {_dec('q', 8, 3)} as seq, {_dec('n * (nat + 2)', 100, 3)} as mm_seq, case when c % 2 = 0 then '--' else {_dec('c', 1, 3)} end as mm_16, case when k % 4 = 1 or n = 0 then '--' else (nat + 2) || '.0' end as speedup from f where k % 2 = 1")
def times_table(spark: SparkSession, d: str) -> DataFrame:
    f = views.supplier_facts(spark, d).selectExpr("concat('s', k) as key", "if(k % 4 = 1, null, n / 100) as gpu", "n / 10 as omp", "q / 8 as seq", "n * (nat + 2) / 100 as mm_seq", "if(c % 2 = 0, null, double(c)) as mm_16")
    return report.times_table(_config(spark, d).select("ord", "key", "label"), f)


_RUNSQL = "with r as (select 'n' || n_regionkey as key, case when l_linenumber % 2 = 0 then 'engine' else 'library' end as side, case when l_linenumber % 2 = 0 then 'engine' when l_linenumber % 3 = 0 then 'alg3' when l_linenumber % 5 = 0 then 'alg2' else 'default' end as alg, 16 * (1 + l_suppkey % 3)::int as b, (l_partkey * 4 + l_quantity) / 64 as ms from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """(key, side, alg, b, ms): line items as runs of a region."""
    j = views.read(spark, d, "lineitem").join(views.read(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(views.read(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return j.selectExpr(
        "concat('n', n_regionkey) as key", "if(l_linenumber % 2 = 0, 'engine', 'library') as side", "case when l_linenumber % 2 = 0 then 'engine' when l_linenumber % 3 = 0 then 'alg3' when l_linenumber % 5 = 0 then 'alg2' else 'default' end as alg",
        "int(16 * (1 + l_suppkey % 3)) as b", "(l_partkey * 4 + l_quantity) / 64 as ms",
    )


@_query(f"{_RUNSQL}, t as (select key, side, min((ms, alg, b)) as t from r group by 1, 2), w as (select key, max(t[1]) filter (side = 'engine') as engine_ms, max(t[3]) filter (side = 'engine') as engine_b, max(t[1]) filter (side = 'library') as library_ms, max(t[2]) filter (side = 'library') as library_alg, max(t[3]) filter (side = 'library') as library_b from t group by 1) select *, round(engine_ms / library_ms, 1) as ratio from w")
def best_batch(spark: SparkSession, d: str) -> DataFrame:
    return report.best(_runs(spark, d))


@_query(f"{_RUNSQL} select key, b, min(ms) filter (side = 'engine') as engine_ms, min(ms) filter (alg in ('default', 'alg2')) as merged_ms, min(ms) filter (alg = 'alg3') as alg3_ms from r group by 1, 2")
def alg_pivot(spark: SparkSession, d: str) -> DataFrame:
    return report.sweep_table(_runs(spark, d))


@_query(f"with {_FACTS} select 's' || k as key, n / 2.0::double as build_s, n / 4.0::double as repair_s, c::double as schedule_ms, case when n > 0 then round(q * 64 / (n * 8)::double, 2) end as ratio, 50000::bigint as amortized_after from f")
def amortization(spark: SparkSession, d: str) -> DataFrame:
    f = views.supplier_facts(spark, d)
    return report.construction(_log(spark, d), f.selectExpr("concat('s', k) as key", "double(c) as schedule_ms"), f.selectExpr("concat('s', k) as key", "n / 100 as ms"))


@_query(f"with {_FACTS} select 's' || k as key, case when k % 3 = 0 then n * 1000 else n * 100 end as nnz, case when n > 0 then round(q * 1000 / (case when k % 3 = 0 then n * 1000 else n * 100 end)::double, 3) end as bytes_per_entry from f where k % 2 = 1")
def footprint(spark: SparkSession, d: str) -> DataFrame:
    f = views.supplier_facts(spark, d)
    return report.footprint(f.selectExpr("concat('s', k) as key", "if(k % 3 = 0, n * 1000, null) as nnz", "q * 1000 as bytes"), _config(spark, d).select("key", "nnz"))


@_query(f"with {_FACTS} select 's' || k as relation, case when k % 2 = 0 then 'boolean' else 'tropical' end as semiring, n / 100.0::double as single_ms, n / 200.0::double as batch_ms, n::double as library_ms, (nat + 1)::int as threads from f where k % 3 <> 0")
def relation_table(spark: SparkSession, d: str) -> DataFrame:
    """Blocks whose key has a semiring behind it; the others aren't relations."""
    own = _log(spark, d).withColumn("id", F.substring("key", 2, 20).cast("long"))
    kind = F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 2 == 0, "_boolean").otherwise("_tropical")
    return report.relation_table(own.withColumn("key", F.concat("key", kind)))


@_query(f"select o_orderkey as i, {_abbr('(o_custkey * o_custkey)')} as abbr, format('{{:,}}', o_custkey * o_custkey) as grp, (o_custkey * o_custkey) || '.00' as fix from orders where o_orderkey % 10 <> 0 union all select o_orderkey, '--', '--', '--' from orders where o_orderkey % 10 = 0")
def fmt_abbr(spark: SparkSession, d: str) -> DataFrame:
    v = views.read(spark, d, "orders").select(F.col("o_orderkey").alias("i"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey") * F.col("o_custkey")).cast("double").alias("v"))
    return v.select("i", report.abbreviated("v").alias("abbr"), report.grouped("v").alias("grp"), report.fixed("v", 2).alias("fix"))
