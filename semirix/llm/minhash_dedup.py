"""Near-duplicate groups by a multi-index Hamming join of b-bit MinHash signatures, confirmed on full shingle sets.

A signature has CHUNKS x WIDTH symbols of 16 bits. By pigeonhole, two signatures that differ in at most RADIUS =
CHUNKS * (ERRORS + 1) - 1 symbols agree, in some chunk, in all but ERRORS symbols. Each document therefore has one key for
each chunk and each choice of ERRORS symbols left open, and every pair within RADIUS shares a key: the join is exact for the
signature distance. At a similarity s a symbol differs with probability 1 - s, so at 0.8 a pair is beyond RADIUS of 25 out of
65 with probability 1e-4, and at 0.85 with 1e-7. Candidates are confirmed on their full shingle sets.

The join emits no pairs within a group. Equal sets are one class first. Then each key links its members to a centre, for a
few rounds with other centres, and a member whose component is already the centre's is not linked again, so a large group costs
rows in proportion to its size. What is left, members that share a key but not a component, is compared in full, which loses no
link: in blocks of at most BLOCK members by numpy, where a row is a member with the list of those within RADIUS. Sets are built
from whole texts, only for documents that share a key. Where the lists are long, as in a group near the threshold, the sets of a group
that the lists connect meet in a task, which tries only pairs that it hasn't connected; a group with more than SETS_BYTES of sets is laid
out in blocks, each two of which meet, and cells go in waves, so disk doesn't grow with the square of a group. Else each pair is
joined with its two sets. Either way all pairs within RADIUS are decided on their full sets.

Defined results: a null or blank text has no shingle, is linked with nothing and is kept. A null id is kept, without a
component. Rows with the same id and text are one document; each row is returned. Of one id with several texts any one stands for it. Ids are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semirix.llm._store import discard, table
from semirix.llm._text import U64, Words, blocks, mix, released, shingles
from semirix.llm.components import connected
from semirix.runtime import Increments, collected

CHUNKS, WIDTH, ERRORS = 13, 5, 1
SYMBOLS = CHUNKS * WIDTH
RADIUS = CHUNKS * (ERRORS + 1) - 1
ROUNDS, FEW, BLOCK = 4, 200, 512
SETS_BYTES, LEAST_PARTS, WAVE_BYTES = 16 << 20, 4, 512 << 20
#: Ids up to this many, 8 MB, go to all executors.
BROADCAST_ROWS = 1_000_000
#: A set with fewer copies isn't hot.
HOT = 1000
_RNG = np.random.default_rng(977)
_XOR = _RNG.integers(0, 2**32, SYMBOLS, dtype=np.uint32)[:, None]
_MUL = (_RNG.integers(0, 2**32, SYMBOLS, dtype=np.uint32) | np.uint32(1))[:, None]


def _sets(texts: pa.Array, k: int):
    """The sorted distinct shingle hashes of each text."""
    w = Words(texts)
    sh, offs = shingles(w.hashes(lower=True), w.first, k)
    for i in range(w.n):
        yield np.unique(sh[offs[i] : offs[i + 1]])


def _signature(s: np.ndarray) -> np.ndarray:
    low, out = (s >> U64(32)).astype(np.uint32), None
    for i in range(0, len(low), 1 << 14):
        part = ((low[None, i : i + (1 << 14)] ^ _XOR) * _MUL).min(axis=1)
        out = part if out is None else np.minimum(out, part)
    return mix(out.astype(U64) + U64(0x51ED)).astype(np.uint16)


def _keys(sig: np.ndarray) -> np.ndarray:
    """[n, SYMBOLS] symbols -> [n, CHUNKS * WIDTH] keys: one for each chunk with one symbol left open."""
    s = sig.reshape(len(sig), CHUNKS, WIDTH).astype(U64)
    out = np.zeros((len(sig), CHUNKS, WIDTH), U64)
    tag = mix(np.arange(CHUNKS * WIDTH, dtype=U64) + U64(1)).reshape(CHUNKS, WIDTH)
    for free in range(WIDTH):
        h = np.broadcast_to(tag[:, free], s.shape[:2]).copy()
        for j in range(WIDTH):
            if j != free:
                h = (h << U64(16) | h >> U64(48)) ^ (s[:, :, j] + U64(0x9E3779B97F4A7C15))
                h = mix(h)
        out[:, :, free] = h
    return out.reshape(len(sig), -1).view(np.int64)


def signatures(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (set size), f1, f2 (fingerprint of the set), sig: a row for each row of ``docs``."""

    def run(batches):
        for b in blocks(batches):
            n, f1, f2, sig = [], [], [], []
            for s in _sets(b.column("text"), k):
                n.append(len(s))
                f1.append(int(mix(s).sum(dtype=U64).view(np.int64)) if len(s) else 0)
                f2.append(int(mix(s ^ U64(0xABCDEF0123456789)).sum(dtype=U64).view(np.int64)) if len(s) else 0)
                sig.append(_signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary())], ["id", "n", "f1", "f2", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(run), "id long, n long, f1 long, f2 long, sig binary")


def _buckets(distinct: DataFrame) -> DataFrame:
    """(id, key, slot, n, sig) of all keys that two or more sets have; slot says which chunk and which symbol is left open."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                if not part.num_rows:
                    continue
                keys = _keys(_matrix(part.column("sig")))
                offs = pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(offs, pa.array(keys.ravel()))], ["id", "keys"])

    rows = distinct.select("id", "sig").mapInArrow(released(run), "id long, keys array<long>").select("id", F.posexplode("keys").alias("slot", "key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    found = rows.join(shared, "key", "left_semi")
    return table(found.join(distinct.select("id", "n", "sig"), "id"), "buckets")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), SYMBOLS)


def _first_slots(differ: np.ndarray) -> np.ndarray:
    """Of pairs, by which symbols differ: the first slot whose key both have, so a pair is reported under one of its keys."""
    parts = differ.reshape(-1, CHUNKS, WIDTH)
    wrong = parts.sum(axis=2)
    chunk = (wrong <= ERRORS).argmax(axis=1)
    at = np.arange(len(parts))
    return chunk * WIDTH + np.where(wrong[at, chunk] > 0, parts[at, chunk].argmax(axis=1), 0)


def _starred(rows: DataFrame, rank, percent: int) -> DataFrame:
    """(a, bs): each member of a key of several components with the key's centre, if that is within RADIUS and in another."""
    centre = rows.groupBy("key").agg(F.min_by(F.struct("id", "n", "root", "sig"), rank).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    centre = centre.select("key", *[F.col(f"c.{x}").alias(f"{x}2") for x in ("id", "n", "root", "sig")])
    pairs = rows.join(centre, "key").filter(f"root <> root2 and 100 * least(n, n2) >= {percent} * greatest(n, n2)")

    def close(batches):
        for b in batches:
            if b.num_rows:
                far = (_matrix(b.column("sig")) != _matrix(b.column("sig2"))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(far <= RADIUS))

    found = pairs.select(F.greatest("id", "id2").alias("a"), F.least("id", "id2").alias("b"), "sig", "sig2").mapInArrow(released(close), "a long, b long")
    return found.distinct().select("a", F.array("b").alias("bs"))


def _compared(rows: DataFrame, percent: int) -> DataFrame:
    """(a, bs): all pairs within RADIUS that share a key but not a component, as lists.

    A key's largest component isn't compared with itself: the members of the others probe all. Both sides go in blocks, a
    task holds two blocks at a time, and a key whose members are nearly all connected costs rows in proportion to them.
    """
    roots = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    size = roots.groupBy("key").agg(F.sum("c").alias("all"), F.max(F.struct("c", "root")).alias("top")).filter(F.col("top.c") < F.col("all"))
    size = size.select("key", F.col("top.root").alias("major"), F.ceil(F.col("all") / BLOCK).cast("int").alias("xs"), F.ceil((F.col("all") - F.col("top.c")) / BLOCK).cast("int").alias("ys"))
    own = rows.join(size, "key").withColumn("minor", F.col("root") != F.col("major"))
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda x, y, probe: F.struct(x.alias("x"), y.alias("y"), F.lit(probe).alias("probe"))
    own = own.withColumns({"bx": block("xs"), "by": block("ys")})
    cells = F.concat(F.transform(upto("ys"), lambda y: cell(F.col("bx"), y, False)), F.when(F.col("minor"), F.transform(upto("xs"), lambda x: cell(x, F.col("by"), True))).otherwise(F.array().cast("array<struct<x:int,y:int,probe:boolean>>")))
    cols = ("key", "x", "y", "probe", "minor", "slot", "id", "n", "root", "sig")
    own = own.withColumn("cell", F.explode(cells)).select("key", "cell.*", *cols[4:])

    def group(probe, minor, slot, ids, n, root, sig):
        right = np.flatnonzero(~probe)
        for p in np.flatnonzero(probe).tolist():
            q = right[(root[right] != root[p]) & (100 * np.minimum(n[right], n[p]) >= percent * np.maximum(n[right], n[p])) & (~minor[right] | (ids[right] < ids[p]))]
            for i in range(0, len(q), 1 << 12):
                some = q[i : i + (1 << 12)]
                differ = sig[p] != sig[some]
                near = differ.sum(axis=1) <= RADIUS
                some = some[near]
                some = some[_first_slots(differ[near]) == slot[0]] if len(some) else some
                if len(some):
                    yield int(ids[p]), ids[some]

    names = cols[:-1]

    def run(batches):
        held = None  # the last group of a batch may go on in the next
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            held = yield from groups_of(held, False)
        if held is not None and held.num_rows:
            yield from groups_of(held, True)

    def groups_of(t, last):
        cols = [t.column(c).to_numpy() for c in names]
        cut = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
        edges = [0, *cut.tolist()]
        stop = t.num_rows if last else edges[-1]
        if stop:
            sig = _matrix(t.column("sig").slice(0, stop).combine_chunks())
            found = [r for i, j in zip(edges, [*edges[1:], t.num_rows], strict=True) if j <= stop for r in group(*[c[i:j] for c in cols[3:]], sig[i:j])]
            if found:
                offs = np.concatenate([[0], np.cumsum([len(q) for _, q in found])])
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(np.concatenate([q for _, q in found])))], ["a", "bs"])
        return t.slice(stop)

    return own.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(released(run), "a long, bs array<long>")


def _shares(x: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of ``sets`` reach ``percent`` with x."""
    sizes = np.array([len(y) for y in sets])
    flat = np.concatenate(sets)
    at = np.searchsorted(x, flat)
    at[at == len(x)] = 0
    both = np.add.reduceat((x[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * both >= percent * (len(x) + sizes - both)


def _by_pairs(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the lists ``near``: a join of each pair with both sets."""
    pairs = near.select("a", F.explode("bs").alias("b"))
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("xa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("xb")), "b")

    def verify(batches):
        for b in batches:
            ok = [bool(_shares(np.frombuffer(x.as_buffer(), U64), [np.frombuffer(y.as_buffer(), U64)], percent)[0]) for x, y in zip(b.column("xa"), b.column("xb"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return full.select("a", "b", "xa", "xb").mapInArrow(released(verify), "a long, b long")


def _spanning(near: DataFrame) -> DataFrame:
    """(a, b): of each batch of the lists ``near`` the links that connect something, so there are fewer than ids in it."""

    def run(batches):
        for b in batches:
            root, out = {}, []

            def find(i, root=root):
                while root.get(i, i) != i:
                    root[i] = root.get(root[i], root[i])
                    i = root[i]
                return i

            for i, bs in zip(b.column("a").to_pylist(), b.column("bs").to_pylist(), strict=True):
                for j in bs:
                    if find(i) != find(j):
                        root[find(j)] = find(i)
                        out.append((i, j))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return near.mapInArrow(released(run), "a long, b long")


def _homes(near: DataFrame, sets: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """(id, root, parts): the group that the lists ``near`` connect an id with, and its blocks of sets; and the bytes of sets that all blocks get.

    A group has a block for SETS_BYTES of sets; one of HOT members has ``parts`` at least."""
    root = table(connected(_spanning(near)), "roots")
    sized = sets.select("id", F.length("set").cast("long").alias("size")).join(root, "id").groupBy("root").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("members"))
    sized = table(sized.select("root", "size", F.greatest(F.ceil(F.col("size") / SETS_BYTES), F.when(F.col("members") >= HOT, parts).otherwise(1)).cast("int").alias("parts")), "sized")
    moved = sized.agg(F.sum(F.col("size") * F.col("parts"))).first()[0] or 0
    homes = table(root.join(sized.select("root", "parts"), "root").select("id", "root", "parts"), "homes")
    discard(root, sized)
    return homes, moved


def _by_blocks(near: DataFrame, sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """Links of the lists ``near`` that connect what isn't yet; written. A group's sets lie in blocks, each two of which meet in a task."""
    collected(near.sparkSession)
    homes, moved = _homes(near, sets, parts)
    known = F.broadcast(homes) if homes.count() <= BROADCAST_ROWS // 4 else homes
    every, n = F.sequence(F.lit(0), F.col("parts") - 1), F.col("parts")
    block = lambda c: F.pmod(F.xxhash64(c), n).cast("int")
    own = sets.join(known, "id").select("root", block(F.col("id")).alias("m"), "id", "set", F.explode(every).alias("o"))
    own = own.select("root", F.least("m", "o").alias("x"), F.greatest("m", "o").alias("y"), F.lit(0).alias("kind"), "id", "set", F.lit(None).cast("array<long>").alias("bs"))
    lists = near.withColumnRenamed("a", "id").join(known, "id").select("root", "parts", "id", "bs", block(F.col("id")).alias("m"), F.explode(every).alias("o"))
    lists = lists.withColumn("bs", F.filter("bs", lambda b: block(b) == F.col("o"))).filter(F.size("bs") > 0)
    lists = lists.select("root", F.least("m", "o").alias("x"), F.greatest("m", "o").alias("y"), F.lit(1).alias("kind"), "id", F.lit(None).cast("binary").alias("set"), "bs")

    def run(batches):
        cell, held, root = None, {}, {}

        def find(i):
            while root.get(i, i) != i:
                root[i] = root.get(root[i], root[i])
                i = root[i]
            return i

        for b in batches:
            out = []
            for group, x, y, kind, i, s, bs in zip(*(b.column(c) for c in ("root", "x", "y", "kind", "id", "set", "bs")), strict=True):
                if (group.as_py(), x.as_py(), y.as_py()) != cell:
                    cell, held, root = (group.as_py(), x.as_py(), y.as_py()), {}, {}
                i = i.as_py()
                if kind.as_py() == 0:
                    held[i] = np.frombuffer(s.as_py(), U64)
                    continue
                todo = [j for j in set(bs.values.to_numpy().tolist()) if find(j) != find(i)]
                for at in range(0, len(todo), 256):
                    some = [j for j in todo[at : at + 256] if find(j) != find(i)]
                    if some:
                        for j in np.array(some)[_shares(held[i], [held[j] for j in some], percent)].tolist():
                            if find(j) != find(i):
                                root[find(j)] = find(i)
                                out.append((i, j))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    cells, found = own.unionAll(lists), Increments(near.sparkSession, "a long, b long", "linked")
    size = sets.agg(F.sum(F.length("set"))).first()[0] or 0
    waves = -(-moved // max(size, WAVE_BYTES)) or 1
    for wave in range(waves):
        some = cells.filter(F.pmod(F.xxhash64("root", "x", "y"), F.lit(waves)) == wave) if waves > 1 else cells
        found.add(some.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "kind").mapInArrow(released(run), "a long, b long"))
        if waves > 1:
            collected(near.sparkSession)
    discard(homes)
    return found.all()


def _members(near: DataFrame) -> DataFrame:
    """(id): who is in the lists; repeats go batch by batch, so long lists make few rows."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                both = np.concatenate([b.column("a").to_numpy(), b.column("bs").flatten().to_numpy()])
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(both))], ["id"])

    return near.mapInArrow(released(run), "id long").distinct()


def _confirmed(near: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b): the pairs of the lists ``near`` whose full sets reach ``percent``, or such that connect all of them; written."""
    near = table(near, "near")
    members = wanted = table(_members(near), "members")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted  # else the texts are shuffled
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted, "id", "left_semi")

    def build(batches):
        for b in blocks(batches):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([s.tobytes() for s in _sets(b.column("text"), k)], pa.binary())], ["id", "set"])

    sets = table(text.mapInArrow(build, "id long, set binary"), "sets")
    pairs = near.agg(F.sum(F.size("bs"))).first()[0] or 0
    count = sets.count()
    found = table(_by_pairs(near, sets, percent), "confirmed") if pairs <= 2 * max(1, count) else _by_blocks(near, sets, percent, LEAST_PARTS)  # else pairs move each set often
    discard(near, members, sets)
    return found


def groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept: a row for each row of ``docs``. Linked: 100 * intersection >= percent * union."""
    own = table(signatures(docs, k, id_col, text_col), "signatures")
    with_id = own.filter("id is not null and n > 0")
    classes = with_id.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    distinct = table(with_id.dropDuplicates(["id"]).join(classes.select(F.col("rep").alias("id")), "id", "left_semi"), "distinct")
    buckets = _buckets(distinct)
    comp = links = None
    for turn in range(ROUNDS + 1):
        if comp is None:
            rows = buckets.withColumn("root", F.col("id"))
        else:
            rows = table(buckets.join(comp.withColumnRenamed("root", "known"), "id", "left").withColumn("root", F.coalesce("known", "id")).drop("known"), "open")
        rank = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
        full = turn == ROUNDS or turn > 0 and new < FEW
        found = _confirmed(_compared(rows, percent) if full else _starred(rows, rank, percent), docs, k, percent, id_col, text_col)
        new = found.count()
        links = found if links is None else links.unionAll(found)
        discard(rows)
        if new or comp is None:
            old, comp = comp, table(connected(links), "components")
            discard(old)
        if full:
            break
    discard(buckets, distinct)
    names = classes.join(comp, F.col("rep") == F.col("id"), "left").select("f1", "f2", "n", "copies", F.coalesce("root", "rep").alias("component_id"))
    # sets with very many copies, of which there are BROADCAST_ROWS at most, are named without a shuffle; their rows are then dealt by id
    many = max(HOT, own.count() // BROADCAST_ROWS + 1)
    hot = names.filter(F.col("copies") >= many).select("f1", "f2", "n", F.col("component_id").alias("hot"))
    out = own.drop("sig").join(F.broadcast(hot), ["f1", "f2", "n"], "left").withColumn("f1", F.when(F.col("hot").isNotNull() | (F.col("n") == 0), F.xxhash64("id")).otherwise(F.col("f1")))
    out = out.join(names.filter(F.col("copies") < many).drop("copies"), ["f1", "f2", "n"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("hot", "component_id"))
    kind = docs.schema[id_col].dataType
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


#: The same rows by DuckDB, for 4-word shingles.
SQL = r"""
with recursive d as (select row_number() over () as k, doc_id, list_filter(regexp_split_to_array(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, list_slice(w, i, i + 3) as g from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*)::bigint as n from s group by 1),
c as (select a.doc_id as x, b.doc_id as y, count(*) as inter from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select x, y from c join n na on na.doc_id = x join n nb on nb.doc_id = y where 100 * inter >= 80 * (na.n + nb.n - inter)),
r(id, root) as (select doc_id, doc_id from d union select l.y, r.root from r join l on l.x = r.id),
m as (select id, min(root) as component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id, d.doc_id = m.component_id as kept from d left join n using (doc_id) left join m on m.id = d.doc_id
"""
