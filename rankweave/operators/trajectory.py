"""Rolling windows of cells along an ordering, and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.operators import prep, windowed
from rankweave.operators.ordering import Ranges
from rankweave.operators.prep import finite


def positions(rows: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """rows with their place (from 0) in the global order of columns that tell rows apart."""
    ranges = Ranges(rows, [F.col(c) for c in order])
    return ranges.placed.withColumn(name, ranges.places()).drop("__range")


def ordered_cells(cells: DataFrame, time: str = "pseudotime") -> DataFrame:
    """Cells with a finite time, with pos by (time, cell_id)."""
    kept = cells.where(finite(F.col(time).cast("double"))).withColumn("pseudotime", F.col(time).cast("double"))
    return positions(kept, ["pseudotime", "cell_id"])


def window_count(n: int, size: int, step: int) -> int:
    """Complete windows of n places."""
    return 0 if n < size else (n - size) // step + 1


def _windows_of(pos: Column, count: int, size: int, step: int) -> Column:
    """The ids of the windows that hold a place; an empty array where there are none."""
    low = F.greatest(F.lit(0), F.ceil((pos - size + 1) / step))
    high = F.least(F.lit(count - 1), F.floor(pos / step))
    return F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))


def windows(ordered: DataFrame, size: int, step: int, n: int | None = None) -> DataFrame:
    """(window_id, cell_id, pos, pseudotime) of the complete windows."""
    n = ordered.count() if n is None else n
    held = _windows_of(F.col("pos"), window_count(n, size, step), size, step)
    return ordered.select(F.explode(held).alias("window_id"), "cell_id", "pos", "pseudotime")


def window_times(ordered: DataFrame, size: int, step: int, n: int | None = None) -> DataFrame:
    """(window_id, pt_start, pt_end, pt_mid): first and last time of a window, and the middle between them."""
    times = windows(ordered, size, step, n).groupBy("window_id").agg(F.min("pseudotime").alias("pt_start"), F.max("pseudotime").alias("pt_end"))
    return times.withColumn("pt_mid", (F.col("pt_start") + F.col("pt_end")) / 2)


def bin_sums(expression: DataFrame, ordered: DataFrame, width: int) -> DataFrame:
    """(bin, gene, value): sums over each `width` places; values that are missing or no numbers don't count."""
    values = expression.where(F.col("value").isNotNull() & ~F.isnan("value")).join(ordered.select("cell_id", "pos"), "cell_id")
    return values.groupBy(F.floor(F.col("pos") / width).cast("int").alias("bin"), "gene").agg(F.sum("value").cast("double").alias("value"))


def span_sums(sums: DataFrame, genes: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gene, inside, total): sums over the bins low to high - 1 of each span (keys, low, high), for every gene, and over all bins.

    A span is the difference of two prefix sums, so a bin's sum is one row whatever the spans' length; a key with several spans adds them up. The only shuffle of the sums is by gene.
    """
    ends = spans.select(*keys, F.explode(F.array(F.struct(F.col("low").alias("bin"), F.lit(-1).alias("sign")), F.struct(F.col("high").alias("bin"), F.lit(1).alias("sign")))).alias("e")).select(*keys, "e.*")
    # a prefix sum is read where no sum stands: before its bin
    asked = genes.select("gene").distinct().crossJoin(F.broadcast(ends.agg(F.collect_set("bin").alias("bins")))).select("gene", F.explode("bins").alias("bin"))
    rows = asked.select("gene", (2 * F.col("bin")).alias("at"), F.lit(0.0).alias("value")).unionByName(sums.select("gene", (2 * F.col("bin") + 1).alias("at"), "value"))
    by = Window.partitionBy("gene")
    prefix = rows.select("gene", "at", F.sum("value").over(by.orderBy("at")).alias("before"), F.sum("value").over(by).alias("total")).where("at % 2 = 0")
    prefix = prefix.select("gene", (F.col("at") / 2).cast("int").alias("bin"), "before", "total")
    return prefix.join(ends, "bin").groupBy(*keys, "gene").agg(F.sum(F.col("sign") * F.col("before")).alias("inside"), F.max("total").alias("total"))


def mean_difference(found: DataFrame, size: Column, n: int) -> Column:
    """The mean of `size` places minus the mean of the others, of n; 0 where it is no finite number."""
    score = F.col("inside") / F.greatest(size, F.lit(1)) - (F.col("total") - F.col("inside")) / F.greatest(F.lit(n) - size, F.lit(1))
    return F.when(finite(score), score).otherwise(0.0)


def gene_sums(expression: DataFrame, ordered: DataFrame, width: int) -> DataFrame:
    """bin_sums() with a row for each gene besides, without a bin and value if it has none; rows lie by gene, and are shuffled no further to be summed or put in order within a gene."""
    rows = expression.join(ordered.select("cell_id", "pos"), "cell_id", "left")
    counts = F.col("pos").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value")
    rows = rows.select(F.when(counts, F.floor(F.col("pos") / width).cast("int")).alias("bin"), "gene", F.when(counts, F.col("value").cast("double")).alias("value"))
    return rows.repartition("gene").groupBy("bin", "gene").agg(F.sum("value").alias("value"))


def window_runs(sums: DataFrame, genes: DataFrame | None, count: int, held: int) -> DataFrame:
    """(gene, low, high, inside, total): for every gene the runs of windows, low to high, with the same sum of the bins window_id to window_id + held - 1; and the sum of all bins.

    A bin's sum enters with the first window that holds it and leaves after the last, so there are at most two runs more than sums, and the only shuffle is of the sums by gene.
    Without genes, sums are gene_sums(), which name every gene, and nothing is shuffled.
    """
    if genes is None:
        # a row without a bin is a mark that changes nothing
        enters = F.struct(F.greatest(F.lit(0), F.coalesce(F.col("bin") - held + 1, F.lit(0))).alias("at"), F.coalesce("value", F.lit(0.0)).alias("change"), F.coalesce("value", F.lit(0.0)).alias("part"))
        leaves = F.struct((F.col("bin") + 1).alias("at"), (-F.col("value")).alias("change"), F.lit(0.0).alias("part"))
        marks = sums.select("gene", F.explode(F.array(enters, leaves)).alias("m")).select("gene", "m.*").where("at is not null")
        by = Window.partitionBy("gene")
        runs = marks.select("gene", F.col("at").alias("low"), F.sum("change").over(by.orderBy("at")).alias("inside"), F.sum("part").over(by).alias("total"), F.lead("at", 1, count).over(by.orderBy("at")).alias("next"), F.lag("at", 1).over(by.orderBy("at")).alias("last"))
        own = F.struct("low", (F.least(F.col("next"), F.lit(count)) - 1).alias("high"), "inside")
        # windows before the first mark hold none of the gene's values
        before = F.struct(F.lit(0).alias("low"), F.when(F.col("last").isNull(), F.least(F.col("low"), F.lit(count)) - 1).alias("high"), F.lit(0.0).alias("inside"))
        return runs.select("gene", F.explode(F.array(own, before)).alias("r"), "total").select("gene", "r.low", "r.high", "r.inside", "total").where("low <= high")
    marks = sums.select("gene", F.inline(F.array(
        F.struct(F.greatest(F.lit(0), F.col("bin") - held + 1).alias("at"), F.col("value").alias("change"), F.col("value").alias("part")),
        F.struct((F.col("bin") + 1).alias("at"), (-F.col("value")).alias("change"), F.lit(0.0).alias("part")),
    )))
    marks = marks.unionByName(genes.select("gene").distinct().select("gene", F.lit(0).alias("at"), F.lit(0.0).alias("change"), F.lit(0.0).alias("part")))
    by = Window.partitionBy("gene")
    # of the marks at one place the last has a next one further on, and the sum of all of them
    runs = marks.select("gene", F.col("at").alias("low"), F.sum("change").over(by.orderBy("at")).alias("inside"), F.sum("part").over(by).alias("total"), F.lead("at", 1, count).over(by.orderBy("at")).alias("next"))
    high = F.least(F.col("next"), F.lit(count)) - 1
    return runs.select("gene", "low", high.alias("high"), "inside", "total").where("low <= high")


def scored_runs(expression: DataFrame, ordered: DataFrame, size: int, step: int, genes: DataFrame | None, n: int, digits: int | None = None) -> DataFrame:
    """(gene, low, high, score): window_scores() as runs of windows with the same score, of the genes given, or else all; step must divide size."""
    sums = gene_sums(expression, ordered, step) if genes is None else bin_sums(expression.join(genes, "gene", "left_semi"), ordered, step)
    runs = window_runs(sums, genes, window_count(n, size, step), size // step)
    score = mean_difference(runs, F.lit(size), n)
    return runs.select("gene", "low", "high", (score if digits is None else F.round(score, digits)).alias("score"))


def window_scores(expression: DataFrame, ordered: DataFrame, size: int, step: int, genes: DataFrame | None = None, n: int | None = None, digits: int | None = None) -> DataFrame:
    """(window_id, gene, score): mean inside the window minus mean outside, to `digits` if given; absent values are 0, so every gene has every window.

    If step divides size, values are summed by steps first and scored by runs of windows, of which rows are made last, after all shuffles; else each value goes to its windows.
    """
    n = ordered.count() if n is None else n
    count = window_count(n, size, step)
    genes = genes.select("gene").distinct() if genes is not None else None
    if size % step == 0:
        return scored_runs(expression, ordered, size, step, genes, n, digits).select(F.explode(F.sequence("low", "high")).alias("window_id"), "gene", "score")
    genes = genes if genes is not None else expression.select("gene").distinct()
    values = expression.where(F.col("value").isNotNull() & ~F.isnan("value")).join(ordered.select("cell_id", "pos"), "cell_id")
    inside = values.select(F.explode(_windows_of(F.col("pos"), count, size, step)).alias("window_id"), "gene", "value")
    total = values.groupBy("gene").agg(F.sum("value").alias("total"))
    every = F.sequence(F.lit(0), F.lit(count - 1)) if count else F.array().cast("array<int>")
    grid = genes.join(total, "gene", "left").select(F.explode(every).alias("window_id"), "gene", F.coalesce("total", F.lit(0.0)).alias("total"))
    # the grid and the sums meet in one aggregate instead of a join
    none = F.lit(None).cast("double")
    both = grid.select("window_id", "gene", "total", none.alias("value")).unionByName(inside.select("window_id", "gene", none.alias("total"), F.col("value").cast("double").alias("value")))
    met = both.groupBy("window_id", "gene").agg(F.max("total").alias("total"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("inside")).where("total is not null")
    score = mean_difference(met, F.lit(size), n)
    return met.select("window_id", "gene", (score if digits is None else F.round(score, digits)).alias("score"))


def window_enrichment(expression: DataFrame, ordered: DataFrame, sets: DataFrame, size: int, step: int, min_size: int = 15, max_size: int = 500, power: float = 1.0, digits: int | None = None) -> DataFrame:
    """(window_id, pathway, size, es) of all windows; step must divide size.

    Every window lists every gene, so sets are chosen first. Genes and sets are numbered in their order, and a gene's runs of windows are shuffled, not its windows (`windowed`).
    Without sets no window is scored.
    """
    if size % step:
        raise ValueError("step must divide size")
    genes = expression.where("gene is not null").select("gene").distinct().persist()
    known = prep.qualified(sets, genes, min_size, max_size).persist()
    n = 0 if known.isEmpty() else ordered.count()
    count = window_count(n, size, step)
    if not count:
        return known.limit(0).select(F.lit(0).alias("window_id"), "pathway", F.lit(0).alias("size"), F.lit(0.0).alias("es"))
    listed = positions(genes, ["gene"], "place").select("gene", F.col("place").cast("int").alias("place"))
    named = positions(known.select("pathway").distinct(), ["pathway"], "id").select("pathway", F.col("id").cast("int").alias("id")).persist()
    held = known.join(named, "pathway").groupBy("gene").agg(F.collect_list("id").alias("ids"))
    runs = scored_runs(expression, ordered, size, step, None, n, digits).join(listed.join(held, "gene", "left"), "gene")
    return windowed.run_enrichment(runs, count, power).join(named, "id").select("window_id", "pathway", "size", "es")


def log_normalised(expression: DataFrame, limit: float = 20.0, target: float = 1e4) -> DataFrame:
    """Expression as log1p of each cell's values scaled to `target`, if any value is over `limit`; else as it is."""
    most = expression.agg(F.max("value")).first()[0]
    if most is None or most <= limit:
        return expression
    total = expression.groupBy("cell_id").agg(F.sum("value").alias("__total"))
    scaled = expression.join(total, "cell_id")
    return scaled.select("cell_id", "gene", F.when(F.col("__total") > 0, F.log1p(F.col("value") * target / F.col("__total"))).otherwise(0.0).alias("value"))


def smoothed(results: DataFrame, half_width: int = 1, value: str = "nes", name: str = "nes_smooth") -> DataFrame:
    """Centred rolling mean of a value along the windows of each pathway."""
    w = Window.partitionBy("pathway").orderBy("window_id").rowsBetween(-half_width, half_width)
    return results.withColumn(name, F.avg(value).over(w))
