"""Places in a global order, without gathering the rows in one task.

Rows are cut into ranges at sampled values of the whole order key, so equal leading values don't meet in one range. A place is the place inside the sorted range plus
the sizes of the ranges before. What reaches the driver is bounded: SAMPLE sampled keys for each range, and one count for each range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled keys for each range.
SAMPLE = 32


def _up_to(key: Column, cuts: list[Column]) -> Column:
    """How many of the sorted cuts are at most the key, by binary search."""
    if not cuts:
        return F.lit(0)
    array = F.array(*cuts)

    def probed(by: int) -> Callable[[Column], Column]:
        return lambda n: F.when((n + by <= len(cuts)) & (F.try_element_at(array, n + by) <= key), n + by).otherwise(n)

    found, step = F.array(F.lit(0)), 1 << (len(cuts).bit_length() - 1)
    while step:  # an array of one element binds the value once
        found = F.transform(found, probed(step))
        step >>= 1
    return found[0]


class Ranges:
    """rows with a column __range, in the rising order of the key columns, which must not be null and must tell rows apart."""

    def __init__(self, rows: DataFrame, key: list[Column], parts: int | None = None) -> None:
        parts = parts or max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        named = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(key)])
        # the smallest hashes are a sample that depends on the rows alone
        sample = rows.select(named.alias("k")).orderBy(F.xxhash64("k"), "k").limit(SAMPLE * parts).collect()
        values = sorted({tuple(r["k"]) for r in sample})
        chosen = sorted({values[i * len(values) // parts] for i in range(1, parts)}) if values else []
        types = [f.dataType for f in rows.select(named.alias("k")).schema["k"].dataType]
        cuts = [F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(c, types, strict=True))]) for c in chosen]
        self.placed = rows.withColumn("__range", _up_to(named, cuts))
        self.sizes = {r[0]: r[1] for r in self.placed.groupBy("__range").count().collect()}
        self.total = sum(self.sizes.values())
        self.count = len(cuts) + 1
        self.key = key

    def per_range(self, values: list, kind: str) -> Column:
        """The value of a row's range, of a list of one for each range."""
        return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("__range"))

    def places(self) -> Column:
        """Places from 0."""
        before = [sum(n for r, n in self.sizes.items() if r < k) for k in range(self.count)]
        own = F.row_number().over(Window.partitionBy("__range").orderBy(*self.key)) - 1
        return (own + self.per_range(before, "long")).cast("long")
