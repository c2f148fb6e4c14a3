"""Normalised scores, adjusted p-values and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.operators.ordering import Ranges


def nes(es: Column, pos_mean: Column, neg_mean: Column) -> Column:
    """es over the mean of the background's scores of its sign; 0 for es 0; null where that mean is missing or about 0."""
    up = F.when(pos_mean > 1e-9, es / pos_mean)
    down = F.when(F.abs(neg_mean) > 1e-9, es / F.abs(neg_mean))
    return F.when(es > 0, up).when(es < 0, down).otherwise(F.lit(0.0))


def bh(results: DataFrame, pval: str = "pval", keys: list[str] | None = None, tie: str = "pathway", spread: bool = False) -> DataFrame:
    """results with padj, adjusted by Benjamini and Hochberg within each key (a run or window); spread adjusts one run, of any number of sets, over all tasks."""
    if spread and not keys:
        return _bh_spread(results, pval, tie)
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    rank = F.row_number().over(by.orderBy(pval, tie))
    at = results.withColumn("__rank", rank).withColumn("__m", F.count("*").over(by))
    falling = by.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = F.least(F.lit(1.0), F.min(F.col(pval) * F.col("__m") / F.col("__rank")).over(falling))
    return at.withColumn("padj", adjusted).drop("__rank", "__m")


def _bh_spread(results: DataFrame, pval: str, tie: str) -> DataFrame:
    """The least value from each place on is the least within the range and of the ranges after it, one value for each."""
    ranges = Ranges(results, [F.col(pval), F.col(tie)])
    at = ranges.placed.withColumn("__rank", ranges.places() + 1)
    raw = F.col(pval) * F.lit(ranges.total) / F.col("__rank")
    least = {r[0]: r[1] for r in at.groupBy("__range").agg(F.min(raw)).collect()}
    after = [min([1.0, *(v for k, v in least.items() if k > r)]) for r in range(ranges.count)]
    falling = Window.partitionBy("__range").orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    return at.withColumn("padj", F.least(ranges.per_range(after, "double"), F.min(raw).over(falling))).drop("__rank", "__range")


def flagged(results: DataFrame, eps: float) -> DataFrame:
    """results with pval_capped: whether pval is at the floor."""
    return results.withColumn("pval_capped", F.col("pval") <= F.lit(float(eps)))
