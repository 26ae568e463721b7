"""Genotype matrices out of variants and haplotypes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semirix.plans.prefix import ranked
from semirix.runtime import discard, table


def snps(variants: DataFrame, most: int | None = None) -> DataFrame:
    """(variant, gts): single-letter variants in the file's order, numbered, the first ``most`` of them."""
    own = variants.filter((F.length("ref") == 1) & (F.length("alt") == 1))
    own = ranked(own.select("idx", "gts"), ["idx"], "variant")
    return own.select("variant", "gts") if most is None else own.filter(F.col("variant") < most).select("variant", "gts")


def dosage(variants: DataFrame, most: int | None = None) -> DataFrame:
    """(row = individual, col = variant, val): how many of the two alleles are '1'; zeros go."""
    cells = snps(variants, most).select("variant", F.posexplode("gts").alias("individual", "gt"))
    one = lambda at: (F.substring("gt", at, 1) == "1").cast("int")
    return cells.select(F.col("individual").cast("bigint").alias("row"), F.col("variant").alias("col"), (one(1) + one(3)).cast("double").alias("val")).filter("val <> 0")


def binarized(haplotypes: DataFrame) -> DataFrame:
    """(site, hap, allele) with every allele but 0 as 1."""
    return haplotypes.select("site", "hap", (F.col("allele") != 0).cast("int").alias("allele"))


def segregating(haplotypes: DataFrame) -> DataFrame:
    """The rows of sites where some haplotypes, but not all, carry the allele."""
    sums = haplotypes.groupBy("site").agg(F.sum("allele").alias("carriers"), F.count(F.lit(1)).alias("n"))
    return haplotypes.join(sums.filter("carriers > 0 and carriers < n").select("site"), "site", "left_semi")


def paired(haplotypes: DataFrame) -> DataFrame:
    """(row = individual, col = site, val): the sum of haplotypes 2i and 2i + 1; zeros go."""
    sums = haplotypes.groupBy(F.expr("hap div 2").cast("bigint").alias("row"), F.col("site").cast("bigint").alias("col")).agg(F.sum("allele").cast("double").alias("val"))
    return sums.filter("val <> 0")


def simulated(spark: SparkSession, haps: int, sites: int, block: int = 50, founders: int = 8, seed: int = 1) -> DataFrame:
    """(site, hap, allele): each haplotype copies one of ``founders`` random ones in each block of sites, so rows repeat like linked sites do."""
    h = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1 << 30))
    grid = spark.range(sites).select(F.col("id").alias("site"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(haps - 1).cast("long"))).alias("hap"))
    founder = h(F.expr(f"site div {block}"), F.col("hap")) % founders
    return grid.select("site", "hap", (h(F.col("site"), founder + 1000) % 100 < h(F.col("site"), F.lit(7)) % 60).cast("int").alias("allele"))


class Tree:
    """A genealogy of n samples: parent (-1 above the root) and time of each of its 2 n - 1 nodes, in generations."""

    def __init__(self, n: int, ne: float, rng: np.random.Generator):
        self.n, self.ne, self.rng = n, ne, rng
        self.parent, self.time = np.full(2 * n - 1, -1), np.zeros(2 * n - 1)
        alive, t = list(range(n)), 0.0
        for new in range(n, 2 * n - 1):  # two of k lineages meet at a rate of k (k - 1) / 2 in 2 ne generations
            k = len(alive)
            t += rng.exponential(4 * ne / (k * (k - 1)))
            for _ in range(2):
                i = int(rng.integers(len(alive)))
                alive[i], alive[-1] = alive[-1], alive[i]
                self.parent[alive.pop()] = new
            self.time[new] = t
            alive.append(new)

    def lengths(self) -> np.ndarray:
        """Of the branches above the nodes; 0 above the root."""
        return np.where(self.parent >= 0, self.time[self.parent] - self.time, 0.0)

    def recombine(self, lengths: np.ndarray) -> None:
        """Cuts a branch at a uniform point; its lower end joins another lineage, as coalescence has it from that time on."""
        total = np.cumsum(lengths)
        u = self.rng.random() * total[-1]
        v = int(np.searchsorted(total, u, "right"))
        t = self.time[v] + (u - total[v] + lengths[v])
        p = int(self.parent[v])
        sibling = next(c for c in np.flatnonzero(self.parent == p).tolist() if c != v)
        self.parent[sibling] = self.parent[p]
        others = np.sort(self.time[self.n :][(self.time[self.n :] > t) & (np.arange(self.n, 2 * self.n - 1) != p)])
        edges = np.concatenate([[t], others])
        count = np.arange(len(others) + 1, 0, -1)  # lineages between the edges
        hazard = np.concatenate([[0.0], np.cumsum(np.diff(edges) * count[:-1])])
        wait = self.rng.exponential(2 * self.ne)
        i = int(np.searchsorted(hazard, wait, "right")) - 1
        t = edges[i] + (wait - hazard[i]) / count[i]
        above = np.where(self.parent >= 0, self.time[self.parent], np.inf)
        alive = (self.time <= t) & (above > t)
        alive[[v, p]] = False
        target = int(self.rng.choice(np.flatnonzero(alive)))
        self.parent[p], self.time[p] = self.parent[target], t
        self.parent[target] = self.parent[v] = p

    def below(self, v: int) -> np.ndarray:
        """The samples under a node."""
        at, hit = np.arange(self.n), np.zeros(self.n, bool)
        while (at >= 0).any():
            hit |= at == v
            at = np.where(at >= 0, self.parent[at], -1)
        return np.flatnonzero(hit)


def coalescent(spark: SparkSession, haps: int, length: float, recombination: float = 1e-8, ne: float = 10_000.0, mu: float = 1e-8, seed: int = 1, chunk: float = 200_000.0) -> DataFrame:
    """(pos, carriers): the mutations on a genome of ``length`` bases under the coalescent, and the haplotypes that have each.

    ``ne`` diploid individuals, ``recombination`` and ``mu`` a base and generation. Along a chunk the genealogy changes by recombination, one
    lineage at a time (sequentially Markov); chunks of ``chunk`` bases are unlinked, so each is a task's work, drawn from its own seed.
    """

    def run(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                rng = np.random.default_rng([seed, i])
                tree, at, end = Tree(haps, ne, rng), i * chunk, min(length, (i + 1) * chunk)
                pos, carriers = [], []
                while at < end:
                    lengths = tree.lengths()
                    total = lengths.sum()
                    step = min(end - at, rng.exponential(1 / (recombination * total)) if recombination > 0 else end)
                    for where in np.sort(rng.random(rng.poisson(mu * total * step))):
                        pos.append(at + float(where) * step)
                        carriers.append(tree.below(int(np.searchsorted(np.cumsum(lengths), rng.random() * total, "right"))))
                    at += step
                    if at < end:
                        tree.recombine(lengths)
                yield pa.RecordBatch.from_arrays([pa.array(pos, pa.float64()), pa.array([c.tolist() for c in carriers], pa.list_(pa.int64()))], ["pos", "carriers"])

    chunks = max(1, -(-int(length) // int(chunk)))
    return spark.range(0, chunks, 1, min(chunks, 8 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "pos double, carriers array<long>")


def genotypes(spark: SparkSession, rows: int, cols: int, seed: int = 1, tries: int = 6, recombination: float = 1e-8, ne: float = 10_000.0, mu: float = 1e-8) -> DataFrame:
    """(row, col, val) of ``rows`` diploid individuals and the first ``cols`` segregating sites of a simulated genome.

    The genome begins twice as long as the expected number of sites needs, and doubles until there are enough; after ``tries`` it is an error.
    """
    haps = 2 * rows
    length = max(cols / (4 * ne * mu * sum(1 / i for i in range(1, haps))) * 2, 1e4)
    for _ in range(tries):
        sites = table(coalescent(spark, haps, length, recombination, ne, mu, seed).filter((F.size("carriers") > 0) & (F.size("carriers") < haps)), "sites")
        if sites.count() >= cols:
            break
        discard(sites)
        length *= 2
    else:
        raise RuntimeError(f"fewer than {cols} segregating sites after {tries} tries")
    first = ranked(sites, ["pos"], "col").filter(F.col("col") < cols)
    return paired(first.select(F.col("col").alias("site"), F.explode("carriers").alias("hap"), F.lit(1).alias("allele")))


def harmonic(spark: SparkSession, n: int) -> DataFrame:
    """One row: the sum of 1 / i for i below n."""
    return spark.range(1, n).agg(F.sum(1.0 / F.col("id")).alias("harmonic"))


