"""Robustness of trajectories: a null of circularly shifted orders, and a scan of window sizes and steps, as keys of one plan over one set of sums."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.operators import enrichment, prep
from rankweave.operators.replicates import hashed_place
from rankweave.operators.trajectory import bin_sums, mean_difference, span_sums, window_count


def shifts(spark: SparkSession, replicates: int, bins: int, seed: int = 42) -> DataFrame:
    """(replicate, shift): 0 for replicate 0, else 1 to bins - 1 by md5(shift|seed|replicate)."""
    digits = F.conv(F.substring(hashed_place("shift", F.lit(seed), F.col("replicate")), 1, 8), 16, 10).cast("long")
    rows = spark.range(replicates + 1).select(F.col("id").cast("int").alias("replicate"))
    return rows.select("replicate", F.when(F.col("replicate") == 0, 0).otherwise(1 + F.pmod(digits, F.lit(max(1, bins - 1)))).cast("int").alias("shift"))


def shifted_scores(expression: DataFrame, ordered: DataFrame, size: int, step: int, replicates: int = 100, seed: int = 42, n: int | None = None) -> DataFrame:
    """(replicate, window_id, gene, score): scores of the windows, and of the same windows when the order is turned by a random number of steps.

    The circle holds the complete steps; places after them are outside of every shifted window. Neighbouring places stay neighbours, so a course keeps its smoothness. step must divide size.
    """
    if size % step:
        raise ValueError("step must divide size")
    spark = expression.sparkSession
    n = ordered.count() if n is None else n
    bins, held, count = n // step, size // step, window_count(n, size, step)
    windows = spark.range(count).select(F.col("id").cast("int").alias("window_id"))
    turned = shifts(spark, replicates, bins, seed).crossJoin(F.broadcast(windows)).withColumn("low", F.pmod(F.col("window_id") + F.col("shift"), F.lit(max(1, bins))))
    # a run over the circle's end is two spans
    spans = turned.select("replicate", "window_id", "low", F.least(F.col("low") + held, F.lit(bins)).alias("high"), (F.col("low") + held - bins).alias("over"))
    spans = spans.select("replicate", "window_id", F.inline(F.array(F.struct("low", "high"), F.struct(F.lit(0).alias("low"), F.greatest("over", F.lit(0)).alias("high")))))
    met = span_sums(bin_sums(expression, ordered, step), expression, spans, ["replicate", "window_id"])
    return met.select("replicate", "window_id", "gene", mean_difference(met, F.lit(size), n).alias("score"))


def scan_scores(expression: DataFrame, ordered: DataFrame, grid: list[tuple[int, int]], n: int | None = None) -> DataFrame:
    """(width, step, window_id, gene, score) of the windows of every (width, step) of the grid, over one set of sums by the greatest number of places that divides all of them."""
    spark = expression.sparkSession
    n = ordered.count() if n is None else n
    unit = math.gcd(*[x for pair in grid for x in pair])
    shapes = spark.createDataFrame([(s, t, window_count(n, s, t)) for s, t in dict.fromkeys(grid)], "width int, step int, count int")
    spans = shapes.where("count > 0").select("width", "step", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("window_id"))
    low = (F.col("window_id") * (F.col("step") / unit)).cast("int")
    spans = spans.select("width", "step", "window_id", low.alias("low"), (low + (F.col("width") / unit).cast("int")).alias("high"))
    met = span_sums(bin_sums(expression, ordered, unit), expression, spans, ["width", "step", "window_id"])
    return met.select("width", "step", "window_id", "gene", mean_difference(met, F.col("width"), n).alias("score"))


def window_enrichment(lists: DataFrame, sets: DataFrame, keys: list[str], min_size: int = 15, max_size: int = 500, power: float = 1.0) -> DataFrame:
    """(keys, pathway, size, es) of lists (keys, gene, score)."""
    return enrichment.enrichment(prep.members(sets, prep.ranked(lists, keys), min_size, max_size, keys), power, keys)


def null_distribution(results: DataFrame, value: str = "es") -> DataFrame:
    """(window_id, pathway, value, null_mean, null_sd, null_p): the value of replicate 0 against the others; null_p = (1 + others at least as far from 0) / (1 + others)."""
    own = results.where("replicate = 0").select("window_id", "pathway", F.col(value).alias("__own"))
    met = results.where("replicate > 0").join(own, ["window_id", "pathway"])
    far = F.round(F.abs(value), 12) >= F.round(F.abs("__own"), 12)
    return met.groupBy("window_id", "pathway").agg(
        F.max("__own").alias(value), F.avg(value).alias("null_mean"), F.stddev_samp(value).alias("null_sd"), ((1 + F.sum(far.cast("int"))) / (1 + F.count("*"))).alias("null_p")
    )


def scan_summary(results: DataFrame, value: str = "es") -> DataFrame:
    """(pathway, settings, most, least, peak_mean, peak_sd, sign_share): of the grid's settings, the extreme of a course, the centre of its window as a share of the way, and how many settings agree with the sign of most.

    The centre is that of the first window of largest magnitude, over the places up to the last window's end.
    """
    end = F.max(F.col("window_id") * F.col("step") + F.col("width"))
    centre = F.col("window_id") * F.col("step") + F.col("width") / 2
    best = F.max_by(F.struct(F.col(value).alias("v"), centre.alias("c")), F.struct(F.round(F.abs(value), 12), -F.col("window_id")))
    lengths = results.groupBy("width", "step").agg(end.alias("end"))
    each = results.groupBy("width", "step", "pathway").agg(best.alias("b")).join(lengths, ["width", "step"]).select("pathway", F.col("b.v").alias("v"), (F.col("b.c") / F.col("end")).alias("peak"))
    up = F.avg((F.col("v") > 0).cast("double"))
    return each.groupBy("pathway").agg(F.count("*").alias("settings"), F.max("v").alias("most"), F.min("v").alias("least"), F.avg("peak").alias("peak_mean"), F.stddev_samp("peak").alias("peak_sd"), F.greatest(up, 1 - up).alias("sign_share"))
