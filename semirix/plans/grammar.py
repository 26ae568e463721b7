"""Matrices as context-free grammars over their row stream, evaluated without being expanded.

A grammar is three tables: ``rules`` (block, sym, kind, left, right, rep), ``top`` (block, row, pos, sym) and ``values`` (val_idx, val).
Codes below ``alpha`` are cells; symbols from ``alpha`` on are rules, whose children come before them. Blocks of rows have their own
rules, so a block is the unit of work: a product joins the blocks' different codes with the values and the vector, and
sweeps each block in one task, whose size the block's entries bound. Of a grammar of tables, as read from files, the rules of a block pass
through a task in order, which keeps a value for each, and the top is joined with the symbols. ``plan="levels"`` evaluates one level of all
rules at a time with joins instead, for a grammar whose single block has more than RULES_IN_TASK rules, for which it is chosen; the frontier
keeps only symbols that a later level reads.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semirix.functions.semiring import Semiring, get
from semirix.plans import csrv, repair, sweep
from semirix.plans.matrix import Matrix
from semirix.plans.prefix import ranked, ranked_within
from semirix.runtime import Increments, discard, table

RULES = "block long, sym long, kind string, left long, right long, rep int"
TOP = "block long, row long, pos long, sym long"
_BLOCKS = "block long, data binary, codes array<long>"
#: A block of tables with more rules than this, some 300 MB in a task of the left product, is evaluated level by level.
RULES_IN_TASK = 2_000_000
#: Rows of a top that a task joins, where the session's partitions would have more.
ROWS_IN_TASK = 1_000_000


def _numpy(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(n).to_numpy() for n in names]


def _pack(alpha: int, rules: list[np.ndarray], top: list[np.ndarray]) -> tuple[bytes, np.ndarray]:
    """A block as bytes: how many rules and top symbols, then sym, left, right (-1: none) and rep, then row, pos and sym; and its codes."""
    used = np.concatenate([rules[1], rules[2][rules[2] >= 0], top[2]])
    return np.concatenate([[len(rules[0]), len(top[0])], *rules, *top]).astype("<i8").tobytes(), np.unique(used[used < alpha])


def _unpack(data: pa.Scalar) -> tuple[list[np.ndarray], list[np.ndarray]]:
    x = np.frombuffer(data.as_buffer(), "<i8")
    n, m = int(x[0]), int(x[1])
    return [x[2 + i * n : 2 + (i + 1) * n] for i in range(4)], [x[2 + 4 * n + i * m : 2 + 4 * n + (i + 1) * m] for i in range(3)]


@dataclass(frozen=True)
class GrammarMatrix:
    """``blocks`` (block, data, codes), where it is given, has the same rules and top with a row for each block, for products."""

    rules: DataFrame
    top: DataFrame
    values: DataFrame
    alpha: int
    rows: int
    cols: int
    blocks: DataFrame | None = None

    @classmethod
    def compress(cls, matrix: Matrix, block_rows: int = 2000, block_entries: int = 1_000_000) -> GrammarMatrix:
        """One grammar for each ``block_rows`` rows. If any of these blocks has more than ``block_entries`` entries, blocks are cut by entries
        instead: each has ``block_entries`` at most, save for its last row's."""
        values = table(csrv.value_dictionary(matrix.entries), "values")
        alpha = values.count() * matrix.cols + 1
        stream, by_rows = csrv.encode(matrix, values), F.expr(f"row div {block_rows}")
        if matrix.entries.groupBy(by_rows.alias("block")).count().filter(F.col("count") > block_entries).limit(1).count():
            starts = matrix.row_pointers().select("row", F.expr(f"row_ptr div {block_entries}").alias("block"))
            stream = stream.join(starts, "row")
        else:
            stream = stream.withColumn("block", by_rows)

        def build(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            block = key[0].as_py()
            t = t.sort_by([("row", "ascending"), ("pos", "ascending")])
            row, code = _numpy(t, "row", "code")
            ends = np.flatnonzero(np.diff(row, append=-1)) + 1
            names = row[ends - 1]
            s, rules = repair.compress(np.insert(code, ends, 0), alpha)
            lift = block << 32  # names are distinct over blocks
            up = lambda x: np.where(x >= alpha, x + lift, x)
            at = np.cumsum(s == 0) - (s == 0)
            keep = s != 0
            start = np.concatenate([[0], np.flatnonzero(s == 0) + 1])
            pos = np.arange(len(s)) - start[at]
            n = len(rules)
            data, codes = _pack(alpha, [alpha + lift + np.arange(n), up(rules[:, 0]), up(rules[:, 1]), np.ones(n, np.int64)], [names[at[keep]], pos[keep], up(s[keep])])
            return pa.table({"block": pa.array([block], pa.int64()), "data": pa.array([data], pa.binary()), "codes": pa.array([codes.tolist()], pa.list_(pa.int64()))})

        blocks = table(stream.groupBy("block").applyInArrow(build, _BLOCKS), "grammar")

        def rules_of(batches):
            for b in batches:
                for block, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    (sym, left, right, _), _ = _unpack(data)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sym), block)), pa.array(sym), pa.array(np.full(len(sym), "BINARY")), pa.array(left), pa.array(right), pa.array(np.ones(len(sym), np.int32))], ["block", "sym", "kind", "left", "right", "rep"])

        def top_of(batches):
            for b in batches:
                for block, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    _, (row, pos, sym) = _unpack(data)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sym), block)), pa.array(row), pa.array(pos), pa.array(sym)], ["block", "row", "pos", "sym"])

        cells = blocks.select("block", "data")
        return cls(cells.mapInArrow(rules_of, RULES), cells.mapInArrow(top_of, TOP), values, alpha, matrix.rows, matrix.cols, blocks)

    @classmethod
    def of(cls, spark: SparkSession, rules: list[tuple], top: list[tuple], values: list[float], alpha: int, rows: int, cols: int) -> GrammarMatrix:
        """A small grammar: rules (sym, kind, left, right, rep), top (row, pos, sym)."""
        return cls(
            spark.createDataFrame([(0, *r) for r in rules], RULES), spark.createDataFrame([(0, *t) for t in top], TOP),
            spark.createDataFrame(list(enumerate(values)), "val_idx long, val double"), alpha, rows, cols,
        )

    @property
    def spark(self) -> SparkSession:
        return self.rules.sparkSession

    def check(self) -> GrammarMatrix:
        """Raises on a delimiter in a rule, a child that isn't before its parent, a run below 2, or a row out of range."""
        bad = self.rules.filter("left <= 0 or right <= 0 or left >= sym or right >= sym or sym < " + str(self.alpha) + " or (kind = 'RUNLEN' and rep < 2)").limit(1).collect()
        if bad:
            raise ValueError(f"not a rule: {bad[0].asDict()}")
        if self.top.filter((F.col("row") < 0) | (F.col("row") >= self.rows) | (F.col("sym") <= 0)).limit(1).count():
            raise ValueError("a top symbol is the delimiter or in a row out of range")
        return self

    def paired(self) -> GrammarMatrix:
        """The same matrix without runs, symbols numbered from alpha without a gap: files hold pairs only.

        A run of k is a chain of k - 1 pairs, so its symbols go between its children's and its own. One block.
        """
        steps = F.when(F.col("kind") == "RUNLEN", F.col("rep") - 1).otherwise(1)
        each = self.rules.select("sym", "left", "right", F.explode(F.sequence(F.lit(1), steps)).alias("step"), steps.alias("steps"))
        numbered = table(ranked(each, ["sym", "step"], "id", self.alpha), "pairs")
        names = numbered.filter("step = steps").select(F.col("sym").alias("old"), F.col("id").alias("name"))

        def renamed(df: DataFrame, column: str) -> DataFrame:
            return df.join(names, F.col(column) == F.col("old"), "left").withColumn(column, F.coalesce("name", column)).drop("old", "name")

        pairs = renamed(numbered, "left")
        pairs = renamed(pairs, "right").select(  # a chain's first pair is left left, the others add one left
            F.lit(0).cast("long").alias("block"), F.col("id").alias("sym"), F.lit("BINARY").alias("kind"), F.when(F.col("step") == 1, F.col("left")).otherwise(F.col("id") - 1).cast("long").alias("left"),
            F.coalesce("right", "left").alias("right"), F.lit(1).alias("rep"),
        )
        top = renamed(self._dealt("sym"), "sym").select(F.lit(0).cast("long").alias("block"), "row", "pos", "sym")
        return GrammarMatrix(pairs, top, self.values, self.alpha, self.rows, self.cols)

    def _dealt(self, *keys: str) -> DataFrame:
        """The top, for a join by ``keys``: dealt out to tasks of about ROWS_IN_TASK rows if the session has fewer partitions. A symbol with more
        rows is left to Spark, which splits the tasks of its own shuffles only."""
        tasks = -(-self.top.count() // ROWS_IN_TASK)
        if tasks <= int(self.spark.conf.get("spark.sql.shuffle.partitions")) or self.top.groupBy(*keys).count().filter(F.col("count") > ROWS_IN_TASK).limit(1).count():
            return self.top
        return self.top.repartition(tasks, *keys)

    # structure

    def children(self) -> DataFrame:
        """(block, sym, child): an edge for each rule and child."""
        return self.rules.select("block", "sym", F.explode(F.array("left", "right")).alias("child")).filter("child is not null")

    def levels(self, plan: str = "sweep") -> DataFrame:
        """(block, sym, lvl): 1 + the greatest level of the children; codes have 0."""
        if plan == "sweep":
            alpha = self.alpha

            def run(t: pa.Table) -> pa.Table:
                t = t.sort_by("sym")
                sym, left, right = t.column("sym").to_numpy(), t.column("left").to_numpy(), t.column("right").fill_null(0).to_numpy()
                here = lambda c: np.where(c >= alpha, alpha + np.searchsorted(sym, c), c)
                return pa.table({"block": t.column("block"), "sym": t.column("sym"), "lvl": repair.levels(here(left), here(right), alpha).astype(np.int32)})

            return self.rules.select("block", "sym", "left", "right").groupBy("block").applyInArrow(run, "block long, sym long, lvl int")
        edges = table(self.children().filter(F.col("child") >= self.alpha), "edges")
        need = table(edges.groupBy("sym").agg(F.count(F.lit(1)).alias("need")), "need")
        done, told = Increments(self.spark, "block long, sym long, lvl int", "levels"), Increments(self.spark, "block long, sym long, lvl int", "told")
        fresh = done.add(self.rules.select("block", "sym").join(need, "sym", "left_anti").select("block", "sym", F.lit(1).alias("lvl")))
        while fresh.limit(1).count():  # each edge tells its parent once, and a parent is done when all have
            new = told.add(edges.join(fresh.select(F.col("sym").alias("child"), "lvl"), "child").select("block", "sym", "lvl"))
            touched = told.all().join(new.select("sym").distinct(), "sym", "left_semi").groupBy("block", "sym").agg(F.max("lvl").alias("m"), F.count(F.lit(1)).alias("n"))
            fresh = done.add(touched.join(need, "sym").filter("n = need").select("block", "sym", (F.col("m") + 1).alias("lvl")))
        discard(edges, need, told.all())
        return done.all()

    def schedule(self, plan: str = "sweep") -> DataFrame:
        """(block, sym, lvl, maxref): maxref is the highest level that reads the symbol, its own at least."""
        lvl = table(self.levels(plan), "lvl")
        read = self.children().join(lvl.select("sym", "lvl"), "sym").groupBy(F.col("child").alias("sym")).agg(F.max("lvl").alias("up"))
        return lvl.join(read, "sym", "left").select("block", "sym", "lvl", F.greatest("lvl", F.coalesce("up", "lvl")).alias("maxref"))

    def widths(self) -> DataFrame:
        """(lvl, width, rules): symbols alive at each level, and rules of the level."""
        alive = self.schedule().select("lvl", F.explode(F.sequence("lvl", "maxref")).alias("at"))
        return alive.groupBy(F.col("at").alias("lvl")).agg(F.count(F.lit(1)).alias("width"), F.count_if(F.col("lvl") == F.col("at")).alias("rules"))

    def terminals(self) -> DataFrame:
        """(block, code): the different codes that rules or the top read."""
        if self.blocks is not None:
            return self.blocks.select("block", F.explode("codes").alias("code"))
        codes = self.children().select("block", F.col("child").alias("code")).unionAll(self.top.select("block", F.col("sym").alias("code")))
        return codes.filter(F.col("code") < self.alpha).distinct()

    def compaction(self) -> DataFrame:
        """(code, id): the codes in use, numbered from 1 in ascending order."""
        return ranked(self.terminals().select("code").distinct(), ["code"], "id", 1)

    def compaction_ratio(self) -> DataFrame:
        """One row: all codes, those in use (both with the delimiter), and the share kept in per cent."""
        used = self.terminals().select("code").distinct().agg((F.count(F.lit(1)) + 1).alias("used"))
        return used.select(F.lit(self.alpha).cast("long").alias("codes"), "used", (100.0 * F.col("used") / self.alpha).alias("kept_pct"))

    def stats(self) -> DataFrame:
        """One row: depth, greatest width, layered rules, rules, pass-throughs, emissions, terminal emissions, codes in use, device bytes."""
        sched = table(self.schedule(), "schedule")
        wide = sched.select(F.explode(F.sequence("lvl", "maxref")).alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("w")).agg(F.coalesce(F.max("w"), F.lit(0)).alias("max_width"))
        one = sched.agg(F.coalesce(F.max("lvl"), F.lit(0)).alias("depth"), F.count(F.lit(1)).alias("raw_rules"), F.coalesce(F.sum(F.col("maxref") - F.col("lvl")), F.lit(0)).alias("pass_throughs"))
        emit = self.top.agg(F.count_if(F.col("sym") >= self.alpha).alias("emissions"), F.count_if(F.col("sym") < self.alpha).alias("terminal_emissions"))
        used = self.terminals().select("code").distinct().agg((F.count(F.lit(1)) + 1).alias("alpha_used"))
        n = self.values.agg(F.count(F.lit(1)).alias("n_values"))
        row = one.join(F.broadcast(wide)).join(F.broadcast(emit)).join(F.broadcast(used)).join(F.broadcast(n))  # one row each
        total = F.col("raw_rules") + F.col("pass_throughs")
        size = engine_bytes("alpha_used", "total_rules", "n_values", F.lit(self.cols), F.lit(self.rows), "max_width", "emissions", "terminal_emissions")
        return row.withColumn("total_rules", total).withColumn("engine_bytes", size).select("depth", "max_width", "total_rules", "raw_rules", "pass_throughs", "emissions", "terminal_emissions", "alpha_used", "engine_bytes")

    # physical layout

    def slots(self) -> DataFrame:
        """(lvl, slot, sym, own): each level's symbols in a device's order: its own rules as they are numbered, then those kept from
        the level below in that level's order. So a level goes by falling level of origin, then by symbol."""
        alive = self.schedule().select("sym", F.col("lvl").alias("born"), F.explode(F.sequence("lvl", "maxref")).alias("lvl"))
        numbered = ranked_within(alive, ["lvl"], [F.desc("born"), "sym"], "slot")
        return numbered.select("lvl", F.col("slot").cast("long").alias("slot"), "sym", (F.col("born") == F.col("lvl")).alias("own"))

    def layered(self) -> DataFrame:
        """(lvl, slot, left, right, coeff): rules between neighbouring levels. A child >= 0 is a slot of the level below, one below 0 the
        compact terminal -child - 1, of which 0 is the identity; a kept symbol is its own left child."""
        slots = table(self.slots(), "slots")
        below = slots.select((F.col("lvl") + 1).alias("lvl"), F.col("sym").alias("child"), F.col("slot").alias("at"))
        codes = self.compaction().select(F.col("code").alias("child"), (-F.col("id") - 1).alias("at"))
        own = slots.filter("own").join(self.rules, "sym").select("lvl", "slot", "left", "right", F.col("rep").alias("coeff"))
        kept = slots.filter("not own").select("lvl", "slot", F.col("sym").alias("left"), F.lit(None).cast("long").alias("right"), F.lit(1).alias("coeff"))
        nodes = own.unionAll(kept)
        for side in ("left", "right"):
            inner = below.select("lvl", F.col("child").alias(side), F.col("at").alias(f"{side}_slot"))
            outer = codes.select(F.col("child").alias(side), F.col("at").alias(f"{side}_code"))
            nodes = nodes.join(inner, ["lvl", side], "left").join(outer, side, "left").withColumn(f"{side}_at", F.coalesce(f"{side}_slot", f"{side}_code", F.lit(-1).cast("long")))
        return nodes.select("lvl", "slot", F.col("left_at").alias("left"), F.col("right_at").alias("right"), "coeff")

    def emissions(self) -> DataFrame:
        """(lvl, slot, row): where each top symbol's value is added, at its own level; codes at level 0 with their compact number as slot."""
        inner = self.top.join(self.slots().filter("own").select("sym", "lvl", "slot"), "sym").select("lvl", "slot", "row")
        codes = self.top.join(self.compaction().withColumnRenamed("code", "sym"), "sym").select(F.lit(0).alias("lvl"), F.col("id").alias("slot"), "row")
        return inner.unionAll(codes)

    def level_offsets(self) -> DataFrame:
        """(lvl, nodes, node_offset, emissions, emission_offset): exclusive sums over the levels, a row for each."""
        nodes = self.widths().select("lvl", F.col("width").alias("nodes"))
        emit = self.emissions().filter("lvl > 0").groupBy("lvl").agg(F.count(F.lit(1)).alias("emissions"))
        rows = nodes.join(emit, "lvl", "left").select("lvl", "nodes", F.coalesce("emissions", F.lit(0)).cast("long").alias("emissions"))
        w = Window.orderBy("lvl").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row for each level
        return rows.select("lvl", "nodes", (F.sum("nodes").over(w) - F.col("nodes")).alias("node_offset"), "emissions", (F.sum("emissions").over(w) - F.col("emissions")).alias("emission_offset"))

    # expansion

    def csrv(self) -> DataFrame:
        """(row, pos, code): the row stream that the grammar stands for."""
        alpha = self.alpha

        def run(batches):
            for b in batches:
                for data in b.column(0):
                    rules, (row, pos, sym) = _unpack(data)
                    order = np.lexsort((pos, row))
                    code, place = sweep.expand(alpha, *rules, sym[order])
                    row = row[order][place]
                    yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.arange(len(row)) - np.searchsorted(row, row)), pa.array(code)], ["row", "pos", "code"])

        return self._blocks().select("data").mapInArrow(run, "row long, pos long, code long")

    def entries(self) -> DataFrame:
        """(row, col, val): the matrix."""
        return csrv.decode(self.csrv(), self.values, self.cols)

    def matrix(self) -> Matrix:
        return Matrix(self.entries(), self.rows, self.cols)

    def _blocks(self, top: bool = True) -> DataFrame:
        """(block, data): a row for each block; without ``top`` its rules alone."""
        if self.blocks is not None:
            return self.blocks.select("block", "data")
        alpha = self.alpha
        cells = self.rules.select("block", F.lit(0).alias("tag"), F.col("sym").alias("a"), F.col("left").alias("b"), F.coalesce("right", F.lit(-1)).cast("long").alias("c"), F.col("rep").cast("long").alias("d"))
        if top:
            cells = cells.unionAll(self.top.select("block", F.lit(1).alias("tag"), F.col("row").alias("a"), F.col("pos").alias("b"), F.col("sym").alias("c"), F.lit(0).cast("long").alias("d")))

        def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            tag, (a, b, c, d) = t.column("tag").to_numpy(), _numpy(t, "a", "b", "c", "d")
            r, top = tag == 0, tag == 1
            return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([_pack(alpha, [a[r], b[r], c[r], d[r]], [a[top], b[top], c[top]])[0]], pa.binary())})

        return cells.groupBy("block").applyInArrow(pack, "block long, data binary")

    # products

    def multiply(self, x: DataFrame, semiring: str | Semiring = "plustimes", plan: str = "sweep") -> DataFrame:
        """x (col, x) -> (row, y) with a row for each of the matrix; plan: sweep, levels, or entries (expanded)."""
        s = get(semiring)
        if plan == "entries":
            return self.matrix().multiply(x, s)
        return self.multiply_arrays(x.select("col", F.array("x").alias("xs")), 1, s, plan).select("row", F.col("ys")[0].alias("y"))

    def multiply_batch(self, x: DataFrame, size: int, semiring: str | Semiring = "plustimes") -> DataFrame:
        """x (col, b, x) with b in [0, size) -> (row, b, y): the grammar is read once for all vectors."""
        wide = x.groupBy(F.col("col").cast("bigint").alias("col")).agg(*[F.max(F.when(F.col("b") == b, F.col("x"))).alias(f"x{b}") for b in range(size)])
        y = self.multiply_arrays(wide.select("col", F.array(*[f"x{b}" for b in range(size)]).alias("xs")), size, get(semiring))
        return y.select("row", F.posexplode("ys").alias("b", "y"))

    def multiply_arrays(self, x: DataFrame, size: int, semiring: str | Semiring = "plustimes", plan: str = "sweep") -> DataFrame:
        s = get(semiring)
        idx, col = csrv.parts("code", self.cols)
        leaf = self.terminals().withColumns({"val_idx": idx, "col": col.cast("bigint")}).join(self.values, "val_idx").join(x, "col")
        kind = "double" if s.dtype is np.float64 else "long"
        leaf = leaf.select("block", "code", *[s.leaf(F.col("val"), F.col("xs")[b]).cast(kind).alias(f"w{b}") for b in range(size)])
        if plan == "levels" or self._large():
            parts = self._levelled(leaf, s, size, kind)
        else:
            parts = self._swept(leaf, s, size, kind) if self.blocks is not None else self._ruled(leaf, s, size, kind)
        every = self.spark.range(self.rows).select(F.col("id").alias("row"), *[F.lit(None).cast(kind).alias(f"w{b}") for b in range(size)])
        return parts.unionAll(every).groupBy("row").agg(F.array(*[s.y(F.col(f"w{b}")) for b in range(size)]).alias("ys"))

    def left_multiply(self, x: DataFrame, semiring: str | Semiring = "plustimes") -> DataFrame:
        """x (row, x) -> (col, y) with a row for each column: the product of a row vector with the matrix."""
        y = self.left_multiply_arrays(x.select("row", F.array("x").alias("xs")), 1, semiring)
        return y.select("col", F.col("ys")[0].alias("y"))

    def left_multiply_arrays(self, x: DataFrame, size: int, semiring: str | Semiring = "plustimes") -> DataFrame:
        """x (row, xs array of ``size``) -> (col, ys array). The rows' values go down the rules, each block in one task; what arrives at a block's
        codes, few rows, meets the values. A row's values are summed where a code is met again, as the semiring distributes."""
        s = get(semiring)
        kind = "double" if s.dtype is np.float64 else "long"
        names = [f"w{b}" for b in range(size)]
        values = x.select(F.col("row").cast("bigint").alias("row"), *[s.leaf(F.lit(s.one), F.col("xs")[b]).cast(kind).alias(f"w{b}") for b in range(size)])
        idx, col = csrv.parts("code", self.cols)
        met = self._fallen(values, s, names, kind) if self.blocks is not None else self._fallen_rules(values, s, names, kind)
        leaf = met.withColumns({"val_idx": idx, "col": col.cast("bigint")}).join(self.values, "val_idx").select("col", *[s.leaf(F.col("val"), F.col(n)).cast(kind).alias(n) for n in names])
        every = self.spark.range(self.cols).select(F.col("id").alias("col"), *[F.lit(None).cast(kind).alias(n) for n in names])
        return leaf.unionAll(every).groupBy("col").agg(F.array(*[s.y(F.col(n)) for n in names]).alias("ys"))

    def _fallen(self, values: DataFrame, s: Semiring, names: list[str], kind: str) -> DataFrame:
        """(code, w): what arrives at each block's codes from the rows' ``values`` (row, w)."""
        alpha, size = self.alpha, len(names)
        given = self.top.select("block", "row").distinct().join(values, "row").select(F.col("block").alias("of"), "row", *names)

        def run(cells: pa.Table, given: pa.Table) -> pa.Table:
            kinds = pa.float64() if kind == "double" else pa.int64()
            if not cells.num_rows or not given.num_rows:
                return pa.table([pa.array([], pa.int64()), *[pa.array([], kinds) for _ in names]], names=["code", *names])
            rules, (row, _, sym) = _unpack(cells.column("data")[0])
            w = np.stack([given.column(n).fill_null(s.zero).to_numpy() for n in names], axis=1)
            codes, y = sweep.descend(s, alpha, *rules, row, sym, given.column("row").to_numpy(), w)
            return pa.table([pa.array(codes), *[pa.array(y[:, i]) for i in range(size)]], names=["code", *names])

        schema = ", ".join(["code long", *[f"{n} {kind}" for n in names]])
        return self._blocks().groupBy("block").cogroup(given.groupBy("of")).applyInArrow(run, schema)

    def _fallen_rules(self, values: DataFrame, s: Semiring, names: list[str], kind: str) -> DataFrame:
        """As ``_fallen`` for a grammar of tables: the rows' values are summed by symbol first, and a task has a block's rules and their sums."""
        alpha, size = self.alpha, len(names)
        sums = self.top.select("block", "row", "sym").join(values, "row").groupBy("block", "sym").agg(*[s.total(F.col(n)).cast(kind).alias(n) for n in names])
        sums = table(sums, "sums")
        codes = sums.filter(F.col("sym") < alpha).select(F.col("sym").alias("code"), *names)
        sums = sums.filter(F.col("sym") >= alpha)
        if self._large():
            return codes.unionAll(self._fallen_levels(sums, s, names, kind))

        def run(cells: pa.Table, given: pa.Table) -> pa.Table:
            kinds = pa.float64() if kind == "double" else pa.int64()
            if not cells.num_rows or not given.num_rows:
                return pa.table([pa.array([], pa.int64()), *[pa.array([], kinds) for _ in names]], names=["code", *names])
            rules, _ = _unpack(cells.column("data")[0])
            w = np.stack([given.column(n).fill_null(s.zero).to_numpy() for n in names], axis=1)
            each = np.arange(given.num_rows)
            below, y = sweep.descend(s, alpha, *rules, each, given.column("sym").to_numpy(), each, w)
            return pa.table([pa.array(below), *[pa.array(y[:, i]) for i in range(size)]], names=["code", *names])

        schema = ", ".join(["code long", *[f"{n} {kind}" for n in names]])
        given = sums.withColumnRenamed("block", "of")
        return codes.unionAll(self._blocks(top=False).groupBy("block").cogroup(given.groupBy("of")).applyInArrow(run, schema))

    def _fallen_levels(self, sums: DataFrame, s: Semiring, names: list[str], kind: str) -> DataFrame:
        """(code, w) from the symbols' ``sums`` (sym, w), a level of all rules at a time: for blocks with more rules than a task holds."""
        lvl = table(self.levels("levels").select("sym", "lvl"), "lvl")
        depth = lvl.agg(F.max("lvl")).first()[0] or 0
        edges = self.rules.select("sym", "rep", F.posexplode(F.array("left", "right")).alias("side", "child")).filter("child is not null").join(lvl, "sym")
        edges = edges.join(lvl.select(F.col("sym").alias("child"), F.col("lvl").alias("to")), "child", "left")
        edges = table(edges.select("sym", "lvl", "child", F.coalesce("to", F.lit(0)).alias("to"), F.when(F.col("side") == 0, F.col("rep")).otherwise(1).alias("rep")), "edges")
        down = Increments(self.spark, ", ".join(["sym long, lvl int", *[f"{n} {kind}" for n in names]]), "down")
        down.add(sums.join(lvl, "sym").select("sym", "lvl", *names))
        for k in range(depth, 0, -1):
            own = down.all().filter(F.col("lvl") == k).groupBy("sym").agg(*[s.total(F.col(n)).cast(kind).alias(n) for n in names])
            sent = edges.filter(F.col("lvl") == k).join(own, "sym")
            down.add(sent.select(F.col("child").alias("sym"), F.col("to").alias("lvl"), *[s.power(F.col(n), F.col("rep")).cast(kind).alias(n) for n in names]))
        discard(lvl, edges)
        return down.all().filter("lvl = 0").select(F.col("sym").alias("code"), *names)

    def _swept(self, leaf: DataFrame, s: Semiring, size: int, kind: str) -> DataFrame:
        alpha, names = self.alpha, [f"w{b}" for b in range(size)]

        def run(cells: pa.Table, leaves: pa.Table) -> pa.Table:
            if not cells.num_rows:
                return pa.table([pa.array([], pa.int64()), *[pa.array([], pa.float64() if kind == "double" else pa.int64()) for _ in names]], names=["row", *names])
            rules, (row, _, sym) = _unpack(cells.column("data")[0])
            w = np.stack([leaves.column(n).fill_null(s.zero).to_numpy() for n in names], axis=1) if leaves.num_rows else np.zeros((0, size), s.dtype)
            codes = leaves.column("code").to_numpy()
            lost = np.setdiff1d(sym[sym < alpha], codes)  # codes of the top that no rule reads, without a leaf
            codes, w = np.concatenate([codes, lost]), np.concatenate([w, np.full((len(lost), size), s.zero, s.dtype)])
            symbols, value = sweep.evaluate(s, alpha, *rules, codes, w)
            row, y = sweep.rows(s, symbols, value, row, sym)
            return pa.table([pa.array(row), *[pa.array(y[:, i]) for i in range(size)]], names=["row", *names])

        schema = ", ".join(["row long", *[f"{n} {kind}" for n in names]])
        leaf = leaf.withColumnRenamed("block", "leaf_block").select(F.col("leaf_block").alias("of"), "code", *names)
        return self._blocks().groupBy("block").cogroup(leaf.groupBy("of")).applyInArrow(run, schema)

    def _large(self) -> bool:
        """Whether a block of the tables has more rules than a task holds."""
        return self.blocks is None and bool(self.rules.groupBy("block").count().filter(F.col("count") > RULES_IN_TASK).limit(1).count())

    def _ruled(self, leaf: DataFrame, s: Semiring, size: int, kind: str) -> DataFrame:
        """As ``_swept`` for a grammar of tables: a block's codes and rules pass through a task in ascending order, a batch at a time, and leave it
        with their values; the top, of any length, is joined with these."""
        names, none, zero = [f"w{b}" for b in range(size)], F.lit(-1).cast("long"), F.lit(s.zero).cast(kind)
        codes = leaf.select("block", F.col("code").alias("sym"), none.alias("left"), none.alias("right"), F.lit(1).cast("long").alias("rep"), *[F.coalesce(n, zero).alias(n) for n in names])
        rules = self.rules.select("block", "sym", "left", F.coalesce("right", none).alias("right"), F.col("rep").cast("long").alias("rep"), *[zero.alias(n) for n in names])

        def run(batches):
            of = known = None
            for b in batches:
                block, sym, left, right, rep, *w = [b.column(i).to_numpy() for i in range(5 + size)]
                w, ends = np.stack(w, axis=1), np.flatnonzero(np.diff(block)) + 1
                for i, j in zip([0, *ends], [*ends, len(block)], strict=True):
                    if i == j:
                        continue
                    if known is None or block[i] != of:
                        of, known = block[i], sweep.Rising(s, size)
                    w[i:j] = known.add(sym[i:j], left[i:j], right[i:j], rep[i:j], w[i:j])
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(sym), *[pa.array(w[:, i]) for i in range(size)]], ["block", "sym", *names])

        schema = ", ".join(["block long, sym long", *[f"{n} {kind}" for n in names]])
        symbols = codes.unionAll(rules).repartition("block").sortWithinPartitions("block", "sym").mapInArrow(run, schema)
        return self._dealt("block", "sym").select("block", "row", "sym").join(symbols, ["block", "sym"]).select("row", *names)

    def _levelled(self, leaf: DataFrame, s: Semiring, size: int, kind: str) -> DataFrame:
        names = [f"w{b}" for b in range(size)]
        zero = F.lit(s.zero).cast(kind)
        levels = self.schedule("levels")
        sched = table(self.rules.join(levels.select("sym", "lvl", "maxref"), "sym"), "schedule")
        depth = sched.agg(F.max("lvl")).first()[0] or 0
        reads = self.children().join(sched.select("sym", "lvl"), "sym").groupBy(F.col("child").alias("sym")).agg(F.max("lvl").alias("maxref"))
        codes = leaf.select(F.col("code").alias("sym"), *names).dropDuplicates(["sym"])
        live = table(codes.join(reads, "sym", "left").withColumn("maxref", F.coalesce("maxref", F.lit(0))), "live")
        emit = lambda frontier: self.top.join(frontier, "sym").select("row", *names)
        out = Increments(self.spark, ", ".join(["row long", *[f"{n} {kind}" for n in names]]), "emitted")
        out.add(emit(live))
        for k in range(1, depth + 1):
            value = live.filter(F.col("maxref") >= k)
            lw = value.select(F.col("sym").alias("left"), *[F.col(n).alias(f"l{n}") for n in names])
            rw = value.select(F.col("sym").alias("right"), *[F.col(n).alias(f"r{n}") for n in names])
            own = sched.filter(F.col("lvl") == k).select(F.col("sym").alias("p"), "left", "right", "rep", F.col("maxref").alias("until"))
            both = own.join(lw, "left", "left").join(rw, "right", "left")
            new = both.select(F.col("p").alias("sym"), *[s.plus(s.power(F.coalesce(f"l{n}", zero), F.col("rep")), F.coalesce(f"r{n}", zero)).alias(n) for n in names], F.col("until").alias("maxref"))
            new = table(new, "level")
            out.add(emit(new))
            old, live = live, table(live.filter(F.col("maxref") > k).select("sym", *names, "maxref").unionAll(new.filter(F.col("maxref") > k).select("sym", *names, "maxref")), "live")
            discard(old, new)
        discard(live, sched)
        return out.all()


def engine_bytes(alpha, rules, values, cols, rows, width, emissions, terminal_emissions):
    """Bytes of the layered form: codes, rules, terminals, values, vectors, two frontiers, emission lists."""
    c = lambda v: F.col(v) if isinstance(v, str) else v
    return 4 * c(alpha) + 12 * c(rules) + 8 * (c(alpha) - 1) + 4 * c(values) + 4 * c(cols) + 4 * c(rows) + 8 * c(width) + 8 * c(emissions) + 8 * c(terminal_emissions)


def csr_bytes(rows, nnz, cols):
    c = lambda v: F.col(v) if isinstance(v, str) else v
    return 4 * (c(rows) + 1) + 8 * c(nnz) + 4 * c(cols) + 4 * c(rows)


def stream_bytes(nnz, rows):
    c = lambda v: F.col(v) if isinstance(v, str) else v
    return 4 * (c(nnz) + c(rows)) + 8


def grammar_bytes(top, rules):
    c = lambda v: F.col(v) if isinstance(v, str) else v
    return 4 * c(top) + 8 * c(rules) + 4 + 8
