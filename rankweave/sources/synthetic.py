"""Made-up inputs of published shapes, for benchmarks and calibration: values depend on the seed and the row alone, not on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _uniform(seed: int, *parts: Column) -> Column:
    """A number above 0 and below 1 by a hash."""
    return (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _normal(seed: int, *parts: Column) -> Column:
    """A normal number by two hashes."""
    return F.sqrt(-2 * F.log(_uniform(seed, *parts, F.lit("r")))) * F.cos(2 * math.pi * _uniform(seed, *parts, F.lit("a")))


def _genes(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("i"), F.format_string("Gene_%05d", F.col("id")).alias("gene"))


def ranked_scores(spark: SparkSession, n_genes: int = 12_000, shifted: int = 500, shift: float = 2.0, seed: int = 42) -> DataFrame:
    """(gene, score): normal scores, the first `shifted` genes raised and the last ones lowered by `shift`."""
    moved = F.when(F.col("i") < shifted, shift).when(F.col("i") >= n_genes - shifted, -shift).otherwise(0.0)
    return _genes(spark, n_genes).select("gene", (_normal(seed, F.col("i")) + moved).alias("score"))


def tied_scores(spark: SparkSession, n_genes: int = 12_000, ties: int = 2000, seed: int = 42) -> DataFrame:
    """(gene, score): normal scores, the first `ties` genes tied in pairs."""
    i = F.when(F.col("i") < ties, F.floor(F.col("i") / 2) * 2).otherwise(F.col("i")).cast("int")
    return _genes(spark, n_genes).select("gene", _normal(seed, i).alias("score"))


def random_sets(spark: SparkSession, n_genes: int, sizes: list[int], seed: int = 42, prefix: str = "Null", low: int = 0, high: int | None = None) -> DataFrame:
    """(pathway, gene): a uniform random set of each size, without repeats, of the genes numbered from low to high - 1.

    The genes of smallest hash are a set's members.
    """
    high = n_genes if high is None else high
    named = spark.createDataFrame([(f"{prefix}_{k}", int(m)) for k, m in enumerate(sizes)], "pathway string, m int")
    rows = named.withColumn("i", F.explode(F.sequence(F.lit(low), F.lit(high - 1)))).withColumn("h", F.xxhash64(F.lit(seed), "pathway", "i"))
    place = F.row_number().over(Window.partitionBy("pathway").orderBy("h", "i"))
    return rows.withColumn("__place", place).where(F.col("__place") <= F.col("m")).select("pathway", F.format_string("Gene_%05d", F.col("i").cast("long")).alias("gene"))


def benchmark_data(spark: SparkSession, n_genes: int = 12_000, n_sets: int = 200, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Scores and sets: n_sets - 20 random sets of 15 to 200 genes, 10 of 20 to 50 among the first 1,000 genes and 10 among the last."""
    import random

    rng = random.Random(seed)
    scores = ranked_scores(spark, n_genes, seed=seed)
    null = random_sets(spark, n_genes, [rng.randint(15, 200) for _ in range(n_sets - 20)], seed, "Null")
    up = random_sets(spark, n_genes, [rng.randint(20, 50) for _ in range(10)], seed, "Up", 0, min(1000, n_genes))
    down = random_sets(spark, n_genes, [rng.randint(20, 50) for _ in range(10)], seed, "Down", max(0, n_genes - 1000), n_genes)
    return scores, null.unionByName(up).unionByName(down)


def tail_data(spark: SparkSession, n_genes: int = 20_000, n_sets: int = 500, tails: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Normal scores and sets: random sets of 50, and `tails` sets of 30 of the 1,000 genes of largest score and 20 of any."""
    from rankweave.operators.prep import ranked

    scores = ranked_scores(spark, n_genes, 0, seed=seed)
    ranks = ranked(scores).where("rnk < 1000").select(F.col("rnk"), "gene")
    planted = random_sets(spark, 1000, [30] * tails, seed, "Tail")
    planted = planted.select("pathway", F.substring("gene", 6, 20).cast("int").alias("rnk")).join(F.broadcast(ranks), "rnk").select("pathway", "gene")
    mixed = random_sets(spark, n_genes, [20] * tails, seed + 1, "Tail")
    return scores, random_sets(spark, n_genes, [50] * (n_sets - tails), seed, "Null").unionByName(planted).unionByName(mixed).distinct()
