"""Anchor pairs, anchor matrices and switch points of trajectories. The designs are this package's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def anchor_pairs(results: DataFrame, value: str = "nes_smooth", top: int = 30) -> DataFrame:
    """(a, b, corr, sep, range) of pairs among the `top` pathways of largest range, most opposed first: corr of their courses, largest distance, smaller range."""
    ranges = results.groupBy("pathway").agg((F.max(value) - F.min(value)).alias("r"))
    chosen = ranges.where("r is not null").orderBy(F.desc("r"), "pathway").limit(top)
    course = results.join(F.broadcast(chosen), "pathway").select("window_id", "pathway", F.col(value).alias("v"), "r")
    a, b = course.alias("a"), course.alias("b")
    both = a.join(b, (F.col("a.window_id") == F.col("b.window_id")) & (F.col("a.pathway") < F.col("b.pathway")))
    pairs = both.groupBy(F.col("a.pathway").alias("a"), F.col("b.pathway").alias("b")).agg(
        F.corr("a.v", "b.v").alias("corr"), F.max(F.abs(F.col("a.v") - F.col("b.v"))).alias("sep"), F.least(F.max("a.r"), F.max("b.r")).alias("range")
    )
    return pairs.orderBy(F.col("corr").asc_nulls_last(), F.desc("sep"), "a", "b")


def anchor_matrix(results: DataFrame, points: int = 61, value: str = "nes_smooth", low: float | None = None, high: float | None = None) -> DataFrame:
    """(pathway, bin, value): means on a grid of `points` equal parts of the time axis."""
    if low is None or high is None:
        low, high = results.agg(F.min("pt_mid"), F.max("pt_mid")).first()
    if low is None or high is None:  # no times, no rows
        low = high = 0.0
    width = (high - low) / points if high > low else 1.0
    at = F.least(F.lit(points - 1), F.floor((F.col("pt_mid") - low) / width)).cast("int")
    return results.where("pt_mid is not null").groupBy("pathway", at.alias("bin")).agg(F.avg(value).alias("value"))


def switch_points(results: DataFrame, a: str, b: str, value: str = "nes_smooth", x: str = "pt_mid") -> DataFrame:
    """(x) where the courses of pathways a and b cross, by linear interpolation between windows."""
    both = results.where(F.col("pathway").isin(a, b)).groupBy("window_id").agg(
        F.max(x).alias("x"), F.max(F.when(F.col("pathway") == a, F.col(value))).alias("ya"), F.max(F.when(F.col("pathway") == b, F.col(value))).alias("yb")
    )
    w = Window.partitionBy(F.lit(0)).orderBy("window_id")
    d = both.withColumn("d", F.col("ya") - F.col("yb")).withColumn("d0", F.lag("d").over(w)).withColumn("x0", F.lag("x").over(w))
    crossed = d.where(((F.col("d0") < 0) & (F.col("d") >= 0)) | ((F.col("d0") > 0) & (F.col("d") <= 0)))
    return crossed.select((F.col("x0") + (F.col("x") - F.col("x0")) * F.col("d0") / (F.col("d0") - F.col("d"))).alias("x"))


def bootstrap_interval(values: DataFrame, key: str, value: str, replicates: int = 200, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(key, mean, low, high): bootstrap interval of a mean by hashed Poisson weights, in one pass over the rows."""
    u = (F.xxhash64(F.lit(seed), F.col("__rep"), key, F.col(value), "__row") / F.lit(2.0**64)) + 0.5
    poisson, total = F.lit(0), 0.0
    for k in range(8):
        total += 2.718281828459045**-1 / _factorial(k)
        poisson = poisson + (u > total).cast("int")
    rows = values.withColumn("__row", F.monotonically_increasing_id()).withColumn("__rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("__w", poisson)
    means = rows.groupBy(key, "__rep").agg((F.sum(F.col(value) * F.col("__w")) / F.sum("__w")).alias("m"))
    tail = (1 - level) / 2
    band = means.groupBy(key).agg(F.percentile("m", [tail, 1 - tail]).alias("q"))
    return values.groupBy(key).agg(F.avg(value).alias("mean")).join(band, key).select(key, "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def _factorial(k: int) -> int:
    return 1 if k < 2 else k * _factorial(k - 1)
