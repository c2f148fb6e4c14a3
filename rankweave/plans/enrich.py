"""Set enrichment of one ranked list, or of many lists side by side."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.operators import adjust, enrichment, multilevel, null, prep
from rankweave.sources import catalog as sources

COLUMNS = ["pathway", "es", "nes", "pval", "log2err", "size", "n_levels", "padj", "pval_capped"]


def enrich_lists(ranks: DataFrame, sets: DataFrame, min_size: int = 15, max_size: int = 500, sample_size: int = 101, seed: int = 42, nperm_nes: int = 500, gsea_param: float = 1.0, eps: float = 1e-50, score_type: str = "two_sided_abs", use_batched: bool = True, bin_width: int | None = None, precheck: bool = False, calculate_nes: bool = True, keys: list[str] | None = None, background: DataFrame | None = None, draws: str = "random", spread: bool = False, traces: bool = False) -> DataFrame:
    """Results of ranked lists (keys, gene, score, rnk, n) against (pathway, gene) sets, a list for each key.

    draws: how the background's random sets are drawn (null.DRAWS); spread adjusts one run over all tasks; traces adds the
    column trace, which levels() makes rows of.
    """
    keys = keys or []
    met = prep.members(sets, ranks, min_size, max_size, keys)
    length = met.groupBy(*keys, "pathway").agg(F.max("n").alias("n"))
    scored = enrichment.enrichment(met, gsea_param, keys).join(length, [*keys, "pathway"])
    scored = scored.persist()
    if scored.isEmpty():  # no list is gathered for nothing
        ranks = ranks.limit(0)
    weights = null.rank_weights(ranks, gsea_param, keys)
    if use_batched:
        tested = multilevel.batched(scored, weights, sample_size, seed, eps, score_type, bin_width, precheck, keys=keys)
    else:
        tested = multilevel.per_set(scored, weights, sample_size, seed, eps, score_type, keys)
    if calculate_nes:
        shared = [] if background is not None else keys
        named = null.rank_weights(ranks, gsea_param, keys, genes=True) if draws == "hashed" else weights
        means = background if background is not None else null.background(scored.select(*keys, "size").distinct(), named, nperm_nes, seed, keys, draws)
        tested = tested.join(means, [*shared, "size"], "left").withColumn("nes", adjust.nes(F.col("es"), F.col("pos_mean"), F.col("neg_mean")))
    else:
        tested = tested.withColumn("nes", F.lit(None).cast("double"))
    return adjust.flagged(adjust.bh(tested, "pval", keys, spread=spread), eps).select(*keys, *COLUMNS, *(["trace"] if traces else []))


def run_gsea(spark: SparkSession, data, sets: DataFrame | Mapping | str, gene_col: str | int = 0, score_col: str | int = 1, min_size: int = 15, max_size: int = 500, sample_size: int = 101, seed: int = 42, nperm_nes: int = 500, gsea_param: float = 1.0, eps: float = 1e-50, dedup_genes: str = "max_abs", order_col: str | None = None, score_type: str = "two_sided_abs", use_batched: bool = True, bin_width: int | None = None, precheck: bool = False, calculate_nes: bool = True, draws: str = "random", spread: bool = False, traces: bool = False) -> DataFrame:
    """Enrichment of one list of scores: pathway, es, nes, pval, log2err, size, n_levels, padj, pval_capped, by rising p.

    data: a DataFrame, pandas DataFrame or Series, or dict; sets: a DataFrame, dict or GMT path. Always has its columns,
    also when no set qualifies. Non-finite scores are dropped, repeated members count once. spread ranks the list and adjusts the
    results over all tasks; the results are the same.
    """
    if order_col is not None:
        scores = data.select(F.col(gene_col if isinstance(gene_col, str) else data.columns[gene_col]).cast("string").alias("gene"), F.col(score_col if isinstance(score_col, str) else data.columns[score_col]).cast("double").alias("score"), order_col)
    else:
        scores = sources.scores_of(spark, data, gene_col, score_col)
    asked = {k: v for k, v in locals().items() if k not in ("spark", "data", "sets", "scores")}
    ranks = prep.ranked(prep.deduplicated(scores, dedup_genes, order=order_col), spread=spread).persist()
    found = enrich_lists(ranks, sources.catalog(spark, sets), min_size, max_size, sample_size, seed, nperm_nes, gsea_param, eps, score_type, use_batched, bin_width, precheck, calculate_nes, draws=draws, spread=spread, traces=traces)
    return _noted(found.orderBy("pval", "pathway"), asked)


def levels(found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, pathway, level, threshold, log_prob, accept_rate): the levels that each set of a result with traces has passed."""
    return found.select(*(keys or []), "pathway", F.inline("trace"))


def _noted(found: DataFrame, params: Mapping) -> DataFrame:
    """found with the parameters of its run in its columns' metadata, which goes with them into Parquet."""
    return found.withMetadata("pathway", {"run": {k: str(v) for k, v in params.items()}})


def parameters(found: DataFrame) -> dict[str, str]:
    """The parameters of the run that made a result, by its columns' metadata; none if they aren't there."""
    return dict(found.schema["pathway"].metadata.get("run", {}))


def run_params(spark: SparkSession, **params) -> DataFrame:
    """The parameters of a run as one row of strings."""
    names = sorted(params)
    return spark.createDataFrame([tuple(str(params[k]) for k in names)], ", ".join(f"{k} string" for k in names))


class GseaRunner:
    """A catalog indexed once against a gene list, run on many score vectors; optionally with the first run's background for all."""

    def __init__(self, spark: SparkSession, sets, genes: DataFrame, min_size: int = 15, max_size: int = 500) -> None:
        known = sources.catalog(spark, sets).join(genes.select(F.col("gene").cast("string").alias("gene")).distinct(), "gene", "left_semi")
        sizes = known.groupBy("pathway").count().where(F.col("count").between(min_size, max_size))
        self.sets = known.join(sizes.select("pathway"), "pathway", "left_semi").select("pathway", "gene").persist()
        self.min_size, self.max_size = min_size, max_size
        self._spark = spark
        self._background: DataFrame | None = None

    def run(self, scores, sample_size: int = 101, seed: int = 42, nperm_nes: int = 500, use_nes_cache: bool = False, **params) -> DataFrame:
        ranks = prep.ranked(prep.deduplicated(sources.scores_of(self._spark, scores))).persist()
        if use_nes_cache and self._background is None:
            power = params.get("gsea_param", 1.0)
            sizes = prep.members(self.sets, ranks, self.min_size, self.max_size).select("size").distinct()
            self._background = null.background(sizes, null.rank_weights(ranks, power, []), nperm_nes, seed).persist()
        return enrich_lists(ranks, self.sets, self.min_size, self.max_size, sample_size, seed, nperm_nes, background=self._background if use_nes_cache else None, **params).orderBy("pval", "pathway")
