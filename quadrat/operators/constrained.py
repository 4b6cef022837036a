"""Constrained ordination: how much of the centred log ratios of a community a few variables explain, and along which axes.

Counts are long, (sample, taxon, reads); a missing row is a zero. With one added to every count a zero's logarithm is zero, so
all sums over the dense table follow from the rows that exist, the samples' mean logarithms and the number of taxa. Each taxon
gives one product with each variable; what comes to the driver are the sums of those products over all taxa, a table of
variables by variables, whose eigenvectors are the axes. No task holds samples by taxa.

Permutations are rows, (permutation, sample, place), made by a cross join, whose size Spark knows, so none is ever broadcast.
They get the variables of their place and meet the counts by blocks of samples; a block gives the sums of each permutation and
taxon over its samples, and those of all blocks each permutation's own table of sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.operators.community import numbered
from quadrat.rounds import Rounds

PERMUTATIONS = 999
CELLS = 1 << 21  # numbers of a task's permuted variables, and of its sums
MOST_VARIABLES = 50


def _centred(metadata: DataFrame, logs: DataFrame, variables: list[str]) -> DataFrame:
    """(sample, x0, x1, ...): the variables less their means, of samples that have reads and all variables."""
    known = metadata.select("sample", *[F.col(v).cast("double").alias(f"x{k}") for k, v in enumerate(variables)]).dropDuplicates(["sample"])
    known = known.dropna().join(logs.select("sample").distinct(), "sample", "left_semi")
    means = known.agg(*[F.avg(f"x{k}").alias(f"m{k}") for k in range(len(variables))])  # one row
    return known.crossJoin(F.broadcast(means)).select("sample", *[(F.col(f"x{k}") - F.col(f"m{k}")).alias(f"x{k}") for k in range(len(variables))])


def _table(row, p: int, name: str) -> np.ndarray:
    out = np.zeros((p, p))
    for k in range(p):
        for m in range(k, p):
            out[k, m] = out[m, k] = row[f"{name}{k}_{m}"] or 0.0
    return out


def _products(p: int, name: str, column: str) -> list:
    return [F.sum(F.col(f"{column}{k}") * F.col(f"{column}{m}")).alias(f"{name}{k}_{m}") for k in range(p) for m in range(k, p)]


def _block_sums(p: int, permutations: int):
    """Task: (r, taxon, b0, b1, ...), sums over a block's samples of permuted variables times logarithms."""

    def run(drawn: pa.Table, logs: pa.Table) -> pa.Table:
        names, taxa = (logs.column(c).combine_chunks().dictionary_encode() for c in ("sample", "taxon"))
        at = pc.index_in(drawn.column("sample"), names.dictionary)
        known = at.is_valid()  # samples with rows in this part of the taxa
        drawn, at = drawn.filter(known), at.filter(known).to_numpy()
        r = drawn.column("r").to_numpy() - 1
        dense = np.zeros((len(names.dictionary), len(taxa.dictionary)))
        dense[names.indices.to_numpy(), taxa.indices.to_numpy()] = logs.column("l").to_numpy()
        sums = []
        for k in range(p):
            x = np.zeros((permutations, len(dense)))
            x[r, at] = drawn.column(f"x{k}").to_numpy()
            sums.append(pa.array((x @ dense).ravel()))
        width = dense.shape[1]
        number = pa.array(np.repeat(np.arange(1, permutations + 1, dtype=np.int32), width))
        return pa.table([number, taxa.dictionary.take(pa.array(np.tile(np.arange(width), permutations))), *sums], names=["r", "taxon", *(f"b{k}" for k in range(p))])

    return run


class Constrained:
    """The sums behind an ordination of counts by variables: n samples, taxa, inner (variables by variables), total variation."""

    def __init__(self, counts: DataFrame, metadata: DataFrame, variables: list[str]):
        if len(variables) > MOST_VARIABLES:
            raise ValueError(f"at most {MOST_VARIABLES} variables, not {len(variables)}")
        self.keep, self.variables = Rounds(counts.sparkSession, "constrained"), variables
        logs = self.keep(counts.where("reads > 0").groupBy("sample", "taxon").agg(F.log1p(F.sum("reads").cast("double")).alias("l")))
        x = _centred(metadata, logs, variables)
        varied = x.agg(*[F.max(F.abs(f"x{k}")).alias(f"x{k}") for k in range(len(variables))]).first()
        self.used = [k for k in range(len(variables)) if (varied[f"x{k}"] or 0.0) > 1e-12]
        self.p = len(self.used)
        self.x = self.keep(x.select("sample", *[F.col(f"x{k}").alias(f"x{n}") for n, k in enumerate(self.used)]))
        self.logs = self.keep(logs.join(self.x.select("sample"), "sample"))
        self.taxa = self.logs.select("taxon").distinct().count()
        self.means = self.keep(self.logs.groupBy("sample").agg((F.sum("l") / max(self.taxa, 1)).alias("m")))
        row = self.x.join(self.means, "sample", "left").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("mm"), *_products(self.p, "s", "x")).first()
        self.n, self.inner = row["n"], _table(row, self.p, "s")
        sums = self.logs.groupBy("taxon").agg(F.sum("l").alias("l"), F.sum(F.col("l") * F.col("l")).alias("ll")).agg(F.sum("ll").alias("ll"), F.sum(F.pow(F.col("l") - (row["m"] or 0.0), 2)).alias("d")).first()
        self.total = (sums["ll"] or 0.0) - self.taxa * (row["mm"] or 0.0) - (sums["d"] or 0.0) / max(self.n, 1)

    def outer(self, x: DataFrame, by: list[str]) -> DataFrame:
        """(by..., o0_0, o0_1, ...): sums over taxa of the products of each two variables' products with the taxon."""
        columns = [f"x{k}" for k in range(self.p)]
        part = x.join(self.means, "sample").groupBy(*by).agg(*[F.sum(F.col(c) * F.col("m")).alias(f"c{k}") for k, c in enumerate(columns)])
        own = x.join(self.logs, "sample").groupBy(*by, "taxon").agg(*[F.sum(F.col(c) * F.col("l")).alias(f"b{k}") for k, c in enumerate(columns)])
        own = own.join(part, by) if by else own.crossJoin(F.broadcast(part))  # one row
        own = own.withColumns({f"b{k}": F.col(f"b{k}") - F.col(f"c{k}") for k in range(self.p)})
        return (own.groupBy(*by) if by else own).agg(*_products(self.p, "o", "b"))

    def permuted(self, permutations: int, seed: int) -> DataFrame:
        """(r, o0_0, o0_1, ...): ``outer`` of each permutation. It orders the samples by a hash of its number; the sample at a place gets the variables of that place."""
        spark, columns = self.x.sparkSession, [f"x{k}" for k in range(self.p)]
        number = spark.range(1, permutations + 1).select(F.col("id").cast("int").alias("r"))
        order = Window.partitionBy("r").orderBy(F.xxhash64("r", F.lit(seed), "sample"), "sample")
        tasks = max(1, -(-self.n * permutations // CELLS))
        drawn = self.x.select("sample").repartition(tasks, "sample").crossJoin(number).withColumn("place", F.row_number().over(order))
        placed = numbered(self.x.withColumn("all", F.lit(0)), "all", "sample", "place").select(F.col("place").cast("int").alias("place"), *columns)
        blocks, parts = max(1, -(-self.n * permutations * self.p // CELLS)), max(1, -(-self.taxa * permutations * self.p // CELLS))
        block = F.pmod(F.xxhash64("sample", F.lit(seed)), F.lit(blocks)).cast("int").alias("block")
        part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))) if parts > 1 else F.lit(0)
        left = drawn.join(placed, "place").select(block, part.alias("part"), "r", "sample", *columns)
        right = self.logs.select(block, F.pmod(F.xxhash64("taxon"), F.lit(parts)).cast("int").alias("part"), "sample", "taxon", "l")
        # a block without rows in a part of the taxa has no sums there
        kind = f"r int, taxon {self.logs.schema['taxon'].dataType.simpleString()}, " + ", ".join(f"b{k} double" for k in range(self.p))
        sums = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_block_sums(self.p, permutations), kind)
        sums = sums.groupBy("r", "taxon").agg(*[F.sum(f"b{k}").alias(f"b{k}") for k in range(self.p)])
        # a mean over the taxa is what the samples' mean logarithms give
        less = [(F.sum(F.col(f"b{k}") * F.col(f"b{m}")) - F.sum(f"b{k}") * F.sum(f"b{m}") / self.taxa).alias(f"o{k}_{m}") for k in range(self.p) for m in range(k, self.p)]
        return sums.groupBy("r").agg(*less)

    def explained(self, inverse: np.ndarray):
        """The part of the variation that the variables explain, as an expression of the sums of ``outer``."""
        return sum(((1 if k == m else 2) * float(inverse[k, m]) * F.col(f"o{k}_{m}") for k in range(self.p) for m in range(k, self.p)), F.lit(0.0))


def constrained_axes(counts: DataFrame, metadata: DataFrame, variables: list[str], axes: int = 2) -> DataFrame:
    """(kind, name, axis, value, share): ``site`` scores and ``variable`` arrows; share is the axis's part of all variation.

    Site scores are the samples' fitted places, of unit length over all samples; arrows are correlations of variables with
    them. The largest arrow of an axis points up. Variables that don't vary, and samples without reads or a variable, are left
    out.
    """
    c = Constrained(counts, metadata, variables)
    spark, kind = counts.sparkSession, "kind string, name string, axis int, value double, share double"
    if not c.p or c.n <= c.p + 1 or c.total <= 0:
        return spark.createDataFrame([], kind)
    values, turn = np.linalg.eigh(c.inner)
    good = values > 1e-10 * values.max()
    root, back = (turn[:, good] * np.sqrt(values[good])), (turn[:, good] / np.sqrt(values[good]))
    table = _table(c.outer(c.x, []).first(), c.p, "o")
    size, vectors = np.linalg.eigh(back.T @ table @ back)
    order = np.argsort(-size)[:axes]
    size, vectors = size[order], vectors[:, order]
    arrows = root @ vectors / np.sqrt(np.diag(c.inner))[:, None]
    sign = np.sign(arrows[np.abs(arrows).argmax(axis=0), np.arange(len(order))])
    arrows, weights = arrows * sign, back @ vectors * sign
    shares = (size / c.total).tolist()
    score = F.explode(F.array(*[F.struct(F.lit(a + 1).alias("axis"), sum((F.col(f"x{k}") * float(weights[k, a]) for k in range(c.p)), F.lit(0.0)).alias("value"), F.lit(shares[a]).alias("share")) for a in range(len(order))]))
    sites = c.x.select(F.lit("site").alias("kind"), F.col("sample").cast("string").alias("name"), score.alias("s")).select("kind", "name", "s.*")
    return sites.unionByName(spark.createDataFrame([("variable", variables[k], a + 1, float(arrows[n, a]), shares[a]) for n, k in enumerate(c.used) for a in range(len(order))], kind))


def constrained_test(counts: DataFrame, metadata: DataFrame, variables: list[str], permutations: int = PERMUTATIONS, seed: int = 1) -> DataFrame:
    """One row: samples, df, residual_df, explained, residual, f and p by permutation of the samples' variables."""
    c = Constrained(counts, metadata, variables)
    spark = counts.sparkSession
    kind = "samples long, df long, residual_df long, explained double, residual double, f double, p double"
    if not c.p or c.n <= c.p + 1 or c.total <= 0:
        return spark.createDataFrame([(c.n, c.p, None, None, None, None, None)], kind)
    inverse, df = np.linalg.pinv(c.inner, rcond=1e-10, hermitian=True), int(np.linalg.matrix_rank(c.inner, hermitian=True))
    ratio = lambda e: (e / df) / ((F.lit(c.total) - e) / (c.n - 1 - df))
    own = c.keep(c.outer(c.x, []).select(c.explained(inverse).alias("explained")))
    p = F.lit(None).cast("double")
    if permutations:
        again = c.permuted(permutations, seed).select(c.explained(inverse).alias("again"))
        at_least = again.crossJoin(F.broadcast(own)).agg((F.sum((F.col("again") >= F.col("explained") * (1 - 1e-12)).cast("int")) + 1).alias("m"))
        own = own.crossJoin(at_least)
        p = F.col("m") / (permutations + 1.0)
    e = F.col("explained")
    out = c.keep(own.select(F.lit(c.n).cast("long").alias("samples"), F.lit(df).cast("long").alias("df"), F.lit(c.n - 1 - df).cast("long").alias("residual_df"), e.alias("explained"), (F.lit(c.total) - e).alias("residual"), ratio(e).alias("f"), p.alias("p")))
    c.keep.keep(out)
    return out
