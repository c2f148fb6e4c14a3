"""Preparation of ranked lists and set membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.operators.ordering import Ranges

DEDUP = ("max_abs", "first", "none")
TIES = ("gene", "seeded")


def finite(score: Column) -> Column:
    """Whether a double is a finite number."""
    return score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))


def deduplicated(scores: DataFrame, mode: str = "max_abs", keys: list[str] | None = None, order: str | None = None) -> DataFrame:
    """One score for each gene (and key): the one of largest magnitude (of two, the positive), or the first by `order`; none keeps all.

    Both choices are aggregates, so they combine on the map side; no gene's rows are sorted in one task.
    """
    by = [*(keys or []), "gene"]
    if mode == "none":
        return scores
    if mode == "max_abs":
        best = F.max_by("score", F.struct(F.abs("score"), "score"))
    elif mode == "first":
        if order is None:
            raise ValueError("dedup 'first' needs an order column: rows of a DataFrame have no order of their own")
        best = F.min_by("score", F.struct(F.col(order), F.col("score")))
    else:
        raise ValueError(f"dedup is one of {DEDUP}")
    return scores.groupBy(*by).agg(best.alias("score"))


def ranked(scores: DataFrame, keys: list[str] | None = None, tie: str = "gene", seed: int = 42, spread: bool = False) -> DataFrame:
    """Scores with rnk (from 0, by falling score) and n (genes in the list); non-finite scores are dropped first.

    Ties go by gene, or by a seeded hash of it. Lists of different keys are ranked side by side; spread ranks one list, of any length, over all tasks.
    """
    if tie not in TIES:
        raise ValueError(f"tie is one of {TIES}")
    keys = keys or []
    second = F.col("gene") if tie == "gene" else F.md5(F.concat_ws("|", F.lit(str(seed)), "gene").cast("binary"))
    kept = scores.where(finite(F.col("score")))
    if spread and not keys:
        ranges = Ranges(kept, [-F.col("score"), second])
        return ranges.placed.withColumn("rnk", ranges.places().cast("int")).withColumn("n", F.lit(ranges.total).cast("long")).drop("__range")
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return kept.withColumn("rnk", F.row_number().over(by.orderBy(F.desc("score"), second)) - 1).withColumn("n", F.count("*").over(by))


def members(sets: DataFrame, ranks: DataFrame, min_size: int = 15, max_size: int = 500, keys: list[str] | None = None) -> DataFrame:
    """(keys, pathway, gene, rnk, score, n, size): set members that are in the list, of sets with min_size to max_size of them.

    A list without duplicate removal gives a gene its last place.
    """
    keys = keys or []
    place = ranks.groupBy(*keys, "gene").agg(F.max_by(F.struct("rnk", "score", "n"), "rnk").alias("p")).select(*keys, "gene", "p.*")
    met = sets.join(place, "gene")
    size = F.count("*").over(Window.partitionBy(*keys, "pathway"))
    return met.withColumn("size", size.cast("int")).where(F.col("size").between(min_size, max_size))


def qualified(sets: DataFrame, genes: DataFrame, min_size: int = 15, max_size: int = 500) -> DataFrame:
    """(pathway, gene) of the set members among the genes, of sets with min_size to max_size of them.

    Lists of the same genes give a set the same size, so sets are chosen here before any of the lists is scored or ranked.
    """
    known = sets.join(genes.select("gene").distinct(), "gene", "left_semi")
    sizes = known.groupBy("pathway").count().where(F.col("count").between(min_size, max_size))
    return known.join(sizes, "pathway", "left_semi").select("pathway", "gene")


def lineage_filter(cells: DataFrame, column: str | None, keyword: str | None) -> DataFrame:
    """Cells whose column, as text, holds the keyword as a case-insensitive regular expression; all if either is missing."""
    if not column or not keyword:
        return cells
    return cells.where(F.coalesce(F.col(column).cast("string").rlike(f"(?i){keyword}"), F.lit(False)))


def upper_names(rows: DataFrame, column: str = "gene") -> DataFrame:
    """rows with a name column in upper case, so that names of sources with other habits meet."""
    return rows.withColumn(column, F.upper(column))


def chosen(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows whose column, as text, is one of the values."""
    return rows.where(F.col(column).cast("string").isin(*values))


def named_pathways(results: DataFrame, parts: list[str], fallback: int = 2) -> DataFrame:
    """Results of the pathways whose name holds one of the parts, whatever its case; if none does, of the `fallback` pathways of the smallest p."""
    holds = F.lit(False)
    for part in parts:
        holds = holds | F.contains(F.lower("pathway"), F.lit(part.lower()))
    best = results.groupBy("pathway").agg(F.min("pval").alias("__p"), F.max(holds.cast("int")).alias("__holds"))
    any_holds = best.agg(F.max("__holds").alias("__any"))
    first = best.orderBy("__p", "pathway").limit(fallback)
    wanted = best.where("__holds = 1").select("pathway").unionByName(first.join(F.broadcast(any_holds), F.col("__any") == 0).select("pathway"))
    return results.join(wanted, "pathway", "left_semi")


def display_name(name: Column) -> Column:
    """A set's name without its collection's prefix."""
    for prefix in ("HALLMARK_", "KEGG_", "REACTOME_"):
        name = F.replace(name, F.lit(prefix), F.lit(""))
    return name
