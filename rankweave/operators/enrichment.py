"""Enrichment scores as a closed form over two running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weight(score: Column, power: float) -> Column:
    """|score| ** power; 1 for power 0."""
    if power == 0:
        return F.lit(1.0)
    return F.abs(score) if abs(power - 1) < 1e-6 else F.pow(F.abs(score), F.lit(float(power)))


def enrichment(met: DataFrame, power: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """(keys, pathway, size, es) of members with rnk, score and n.

    The running sum rises by a member's share of the total weight and falls between members; its extremes stand just before and just after a
    member, so both deviations of each member are compared and the first of largest magnitude (to 12 digits) is the score. 0 for a
    set that is the whole list or has no weight.
    """
    by = [*(keys or []), "pathway"]
    order = Window.partitionBy(*by).orderBy("rnk")
    whole = Window.partitionBy(*by)
    w = met.select(*by, "rnk", "n", weight(F.col("score"), power).alias("w"))
    w = w.select(
        *by, "rnk", "n", "w",
        F.row_number().over(order).alias("k"), F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cw"),
        F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"), F.count("*").over(whole).alias("m"),
    )
    usable = (F.col("total") > 0) & (F.col("m") < F.col("n"))
    misses = (F.col("rnk") - F.col("k") + 1) / (F.col("n") - F.col("m"))
    after = F.col("cw") / F.col("total") - misses
    before = (F.col("cw") - F.col("w")) / F.col("total") - misses
    both = F.array(F.struct((2 * F.col("k") - 1).alias("o"), before.alias("d")), F.struct((2 * F.col("k")).alias("o"), after.alias("d")))
    first = F.when(F.round(F.abs(before), 12) >= F.round(F.abs(after), 12), both[0]).otherwise(both[1])
    rows = w.select(*by, "m", F.when(usable, first).alias("x"))
    best = F.max_by("x.d", F.struct(F.round(F.abs("x.d"), 12), -F.col("x.o")))
    return rows.groupBy(*by).agg(F.max("m").cast("int").alias("size"), F.coalesce(best, F.lit(0.0)).alias("es"))
