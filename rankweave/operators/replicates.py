"""Replicates of a list under the null, as one more key of the plan: all of them run side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed_place(salt: str, *parts: Column) -> Column:
    """A hash of the parts that any engine with md5 can make."""
    return F.md5(F.concat_ws("|", F.lit(salt), *[p.cast("string") for p in parts]).cast("binary"))


def permuted_lists(ranks: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """(replicate, gene, score, rnk, n): the list with its genes dealt anew to the scores, by md5(replicate|seed|number|gene), for each replicate from 0.

    Every set is then a random one of its size, so that p-values of right tests are uniform.
    """
    dealt = ranks.select("gene", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    order = Window.partitionBy("replicate").orderBy(hashed_place("replicate", F.lit(seed), F.col("replicate"), F.col("gene")), "gene")
    placed = dealt.withColumn("rnk", F.row_number().over(order) - 1)
    return placed.join(ranks.select("rnk", "score", "n"), "rnk").select("replicate", "gene", "score", "rnk", "n")


def pooled_calibration(results: DataFrame, key: str = "replicate") -> DataFrame:
    """One row of all replicates: replicates, n, ks (largest |i/n - p_(i)|), below_05, and the bounds that uniform p-values keep to but for one run in about a thousand.

    No results have infinite bounds, and neither ks nor below_05.
    """
    w = Window.partitionBy(F.lit(0))
    at = results.select(key, "pval", F.row_number().over(w.orderBy("pval", key, "pathway")).alias("i"), F.count("*").over(w).alias("n"))
    made = at.agg(
        F.count_distinct(key).alias("replicates"), F.count("*").alias("n"), F.max(F.greatest(F.abs(F.col("i") / F.col("n") - F.col("pval")), F.abs((F.col("i") - 1) / F.col("n") - F.col("pval")))).alias("ks"),
        F.avg((F.col("pval") < 0.05).cast("double")).alias("below_05"),
    )
    bound = lambda c: F.when(F.col("n") > 0, c).otherwise(float("inf"))
    return made.withColumn("ks_bound", bound(1.95 / F.sqrt("n"))).withColumn("below_bound", bound(3.3 * F.sqrt(0.05 * 0.95 / F.col("n"))))
