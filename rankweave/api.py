"""Plain names for users of set-enrichment libraries: arrays and dicts in, numbers, DataFrames or pandas out."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from rankweave.operators import multilevel, null, prep
from rankweave.plans.enrich import GseaRunner, enrich_lists, run_gsea, run_params
from rankweave.plans.plots import plot_pathway_dynamics, plot_trajectory_heatmap
from rankweave.plans.trajectory import run_pipeline
from rankweave.plans.trajectory import run_trajectory as run_trajectory_gsea
from rankweave.sources import catalog as _sources

__all__ = [
    "GseaRunner", "build_tail_curve", "calculate_es", "get_random_es_means", "load_gmt", "multilevel_batched", "multilevel_batched_scores", "multilevel_per_set", "plot_pathway_dynamics",
    "plot_trajectory_heatmap", "prepare_pathways", "query_tail_curve", "run", "run_gsea", "run_params", "run_pipeline", "run_trajectory_gsea",
]

run = run_pipeline


def load_gmt(spark: SparkSession, path: str) -> DataFrame:
    """(pathway, gene) of a GMT file."""
    return _sources.catalog(spark, path)


def prepare_pathways(spark: SparkSession, genes: Sequence[str] | DataFrame, sets: DataFrame | Mapping | str, min_size: int = 15, max_size: int = 500) -> DataFrame:
    """(pathway, gene) of the sets with min_size to max_size members among the genes."""
    known = genes if isinstance(genes, DataFrame) else spark.createDataFrame([(str(g),) for g in genes], "gene string")
    found = _sources.catalog(spark, sets).join(known.select("gene").distinct(), "gene", "left_semi")
    sizes = found.groupBy("pathway").count().where(f"count between {int(min_size)} and {int(max_size)}")
    return found.join(sizes.select("pathway"), "pathway", "left_semi").select("pathway", "gene")


def _weights(scores: Sequence[float], gsea_param: float) -> np.ndarray:
    scores = np.abs(np.asarray(scores, float))
    return np.ones(len(scores)) if gsea_param == 0 else scores**gsea_param


def calculate_es(scores: Sequence[float], hits: Sequence[int], gsea_param: float = 1.0) -> float:
    """Enrichment score of the places `hits` in a list of falling scores; repeated places count once."""
    places = np.unique(np.asarray(hits, np.int64))
    places = places[(places >= 0) & (places < len(scores))]
    if not len(places):
        return 0.0
    return float(null.scores_of_sets(_weights(scores, gsea_param), places[None, :])[0])


def get_random_es_means(scores: Sequence[float], sizes: Sequence[int], nperm: int = 500, seed: int = 42, gsea_param: float = 1.0) -> list[tuple[float, float]]:
    """For each size the mean score of random sets with a score >= 0, and below 0; 1 and -1 where a side is empty. One list; for many see operators.null.background."""
    w, out = _weights(scores, gsea_param), []
    for k in sizes:
        es = null.scores_of_sets(w, null.random_hits(null.rng_of(seed, "background", int(k)), len(w), min(int(k), len(w)), nperm))
        up, down = es[es >= 0], es[es < 0]
        out.append((float(up.mean()) if len(up) else 1.0, float(down.mean()) if len(down) else -1.0))
    return out


def build_tail_curve(scores: Sequence[float], size: int, sample_size: int = 101, seed: int = 42, gsea_param: float = 1.0, eps: float = 1e-50, score_type: str = "two_sided_abs", sign: int = 1) -> dict:
    """Thresholds, log probabilities, populations and sample size of a curve for sets of one size."""
    two_sided = multilevel._checked(sample_size, score_type)
    w = _weights(scores, gsea_param)
    return multilevel.tail_curve(w, min(int(size), len(w) - 1), sample_size, null.rng_of(seed, "curve", int(size), int(sign)), eps, sign, two_sided)


def query_tail_curve(curve: Mapping, obs_es: float, score_type: str = "two_sided_abs", sign: int = 1) -> tuple[float, float]:
    """(p-value, error in log2) of an observed score on a curve."""
    two_sided = multilevel._checked(curve["sample_size"], score_type)
    metric = float(multilevel.metric_of(np.array([obs_es]), sign, two_sided)[0])
    if metric < 1e-10:
        return 1.0, 0.0
    level = min(sum(metric >= t for t in curve["thresholds"]), len(curve["populations"]) - 1)
    return math.exp(curve["log_probs"][level]) * float(np.mean(np.asarray(curve["populations"][level]) >= metric)), 1 / math.sqrt(curve["sample_size"])


def multilevel_batched(spark: SparkSession, scores, sets, **params) -> DataFrame:
    """run_gsea() with one curve for each set size."""
    return run_gsea(spark, scores, sets, use_batched=True, **params)


def multilevel_batched_scores(ranks: DataFrame, sets: DataFrame, **params) -> DataFrame:
    """Many lists (list, gene, score) side by side, each with its own curves."""
    return enrich_lists(prep.ranked(prep.deduplicated(ranks, keys=["list"]), ["list"]), sets, keys=["list"], **params)


def multilevel_per_set(spark: SparkSession, scores, sets, **params) -> DataFrame:
    """run_gsea() with a splitting chain for each set."""
    return run_gsea(spark, scores, sets, use_batched=False, **params)


def ranked_list(spark: SparkSession, data, **params) -> DataFrame:
    """(gene, score, rnk, n) of scores in any accepted form."""
    return prep.ranked(prep.deduplicated(_sources.scores_of(spark, data)), **params)
