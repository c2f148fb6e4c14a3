"""Analytics of results: pivots, rolling means, calibration, stability and agreement."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def heatmap(results: DataFrame, window_ids: list[int], value: str = "nes") -> DataFrame:
    """One row for each pathway, one column w<id> for each window; absent values are 0."""
    wide = results.groupBy("pathway").pivot("window_id", window_ids).agg(F.avg(value))
    return wide.select("pathway", *[F.coalesce(F.col(str(w)), F.lit(0.0)).alias(f"w{w}") for w in window_ids])


def _filled(results: DataFrame, n_windows: int, value: str) -> DataFrame:
    """(pathway, window_id, v) of every pathway and window, 0 where absent."""
    mean = results.groupBy("pathway", "window_id").agg(F.avg(value).alias("v"))
    grid = results.select("pathway").distinct().select("pathway", F.explode(F.sequence(F.lit(0), F.lit(n_windows - 1))).alias("window_id"))
    return grid.join(mean, ["pathway", "window_id"], "left").select("pathway", "window_id", F.coalesce("v", F.lit(0.0)).alias("v"))


def heatmap_long(results: DataFrame, n_windows: int, value: str = "nes") -> DataFrame:
    """(pathway, window_id, value): what heatmap() holds of all windows, one row for each pathway and window; absent values are 0."""
    return _filled(results, n_windows, value).select("pathway", "window_id", F.col("v").alias("value"))


def top_variable(results: DataFrame, n_windows: int, k: int = 30, value: str = "nes") -> DataFrame:
    """(pathway, variance): the k pathways of largest sample variance over the zero-filled windows."""
    return _filled(results, n_windows, value).groupBy("pathway").agg(F.var_samp("v").alias("variance")).orderBy(F.desc("variance"), "pathway").limit(k)


def peak_order(results: DataFrame, n_windows: int, value: str = "nes") -> DataFrame:
    """(pathway, peak_window): the first window of a pathway's largest value."""
    return _filled(results, n_windows, value).groupBy("pathway").agg(F.min_by("window_id", F.struct(-F.col("v"), "window_id")).alias("peak_window"))


def rolling_z(series: DataFrame, width: int = 20, key: str = "gene", order: str = "pos", value: str = "value") -> DataFrame:
    """Centred rolling mean of complete windows of `width`, then z-scores within each key (sample deviation, 0 read as 1)."""
    by = Window.partitionBy(key).orderBy(order)
    held = by.rowsBetween(-(width // 2), width - width // 2 - 1)
    means = series.withColumn("m", F.when(F.count("*").over(held) == width, F.avg(value).over(held))).where("m is not null")
    whole = Window.partitionBy(key)
    sd = F.coalesce(F.stddev_samp("m").over(whole), F.lit(0.0))
    return means.select(key, order, "m", ((F.col("m") - F.avg("m").over(whole)) / F.when(sd == 0, 1.0).otherwise(sd)).alias("z"))


def progress(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with progress from 0 to 1 in each key."""
    w = Window.partitionBy(key)
    n = F.count("*").over(w)
    return rows.withColumn("progress", F.when(n > 1, (F.row_number().over(w.orderBy(order)) - 1) / (n - 1)).otherwise(0.0))


def top_by_p(results: DataFrame, k: int = 5) -> DataFrame:
    return results.orderBy("pval", "pathway").limit(k)


def stability(results: DataFrame) -> DataFrame:
    """(pathway, mean, sd, low, high, cv) of -log10 p over replicates."""
    x = -F.log10(F.greatest(F.col("pval"), F.lit(1e-300)))
    stats = results.select("pathway", x.alias("x")).groupBy("pathway").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("low"), F.max("x").alias("high"))
    return stats.withColumn("cv", F.when(F.col("mean") != 0, F.col("sd") / F.col("mean")))


def calibration(results: DataFrame, key: str | None = "replicate") -> DataFrame:
    """(key, ks, below_05, n): largest |i/n - p_(i)| against the uniform distribution, and the share of p below 0.05. Without a key one row of all results, of nulls where there are none."""
    keys = [key] if key else []
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    at = results.select(*keys, "pval", F.row_number().over(w.orderBy("pval", "pathway")).alias("i"), F.count("*").over(w).alias("n"))
    return at.groupBy(*keys).agg(F.max(F.abs(F.col("i") / F.col("n") - F.col("pval"))).alias("ks"), F.avg((F.col("pval") < 0.05).cast("double")).alias("below_05"), F.max("n").alias("n"))


def qq(results: DataFrame, key: str = "replicate") -> DataFrame:
    """(key, pathway, expected, observed, ecdf): -log10 quantiles of each p against i/(n+1), and its cumulative share."""
    w = Window.partitionBy(key)
    i, n = F.row_number().over(w.orderBy("pval", "pathway")), F.count("*").over(w)
    return results.select(key, "pathway", (-F.log10(i / (n + 1))).alias("expected"), (-F.log10(F.greatest("pval", F.lit(1e-300)))).alias("observed"), F.cume_dist().over(w.orderBy("pval")).alias("ecdf"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: n, rmse, mae and largest difference of NES, mae of log10 p, and pathways more than 0.1 apart in NES."""
    d, lp = F.abs(F.col("a.nes") - F.col("b.nes")), F.abs(F.log10(F.col("a.pval") + 1e-300) - F.log10(F.col("b.pval") + 1e-300))
    both = a.alias("a").join(b.alias("b"), F.col("a.pathway") == F.col("b.pathway")).select(d.alias("d"), lp.alias("lp"))
    return both.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"), F.avg("d").alias("mae"), F.max("d").alias("most"), F.avg("lp").alias("logp_mae"), F.sum((F.col("d") > 0.1).cast("int")).alias("outliers"))


def tail_band(replicates: DataFrame, observed: DataFrame) -> DataFrame:
    """(pathway, low, high, x, inside): the 2.5 % and 97.5 % points of -log10 p over seeds, and whether the observed one is between."""
    x = -F.log10(F.greatest(F.col("pval"), F.lit(1e-300)))
    band = replicates.select("pathway", x.alias("x")).groupBy("pathway").agg(F.percentile("x", [0.025, 0.975]).alias("q"))
    met = observed.select("pathway", x.alias("x")).join(band, "pathway")
    return met.select("pathway", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "x", F.col("x").between(F.col("q")[0], F.col("q")[1]).alias("inside"))


def bland_altman(a: DataFrame, b: DataFrame, margin: float = 0.1) -> DataFrame:
    """One row: bias, limits of agreement (population deviation), and the p-value of two one-sided t-tests within the margin."""
    d = a.alias("a").join(b.alias("b"), F.col("a.pathway") == F.col("b.pathway")).select((F.col("a.nes") - F.col("b.nes")).alias("d"))
    s = d.agg(F.count("*").alias("n"), F.avg("d").alias("bias"), F.stddev_pop("d").alias("sd"), F.stddev_samp("d").alias("ss"))

    @F.udf("double")
    def tost(n, bias, ss):
        if n is None or n < 2 or ss is None:
            return None
        if ss == 0:
            return 0.0 if abs(bias) < margin else 1.0
        se = ss / math.sqrt(n)
        return max(1 - t_cdf((bias + margin) / se, n - 1), t_cdf((bias - margin) / se, n - 1))

    return s.select("n", "bias", (F.col("bias") - 1.96 * F.col("sd")).alias("low"), (F.col("bias") + 1.96 * F.col("sd")).alias("high"), tost("n", "bias", "ss").alias("tost_p"))


def t_cdf(t: float, df: float) -> float:
    """Student's distribution function by the incomplete beta function's continued fraction."""
    x = df / (df + t * t)
    tail = 0.5 * _beta(x, df / 2, 0.5)
    return 1 - tail if t > 0 else tail


def _beta(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or 1e-300)
        c = (1 + num / c) or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1) if f != 1 else front


def speedup(times: DataFrame) -> DataFrame:
    """(threads, seconds, speedup) against one thread."""
    one = times.where("threads = 1").agg(F.min("seconds").alias("one"))
    return times.crossJoin(F.broadcast(one)).select("threads", "seconds", (F.col("one") / F.col("seconds")).alias("speedup"))


def by_rank(ranks: DataFrame, first: int, last: int) -> DataFrame:
    """The first and last genes of a ranked list, with their side."""
    return ranks.where((F.col("rnk") < first) | (F.col("rnk") >= F.col("n") - last)).withColumn("side", F.when(F.col("rnk") < first, "top").otherwise("bottom"))
