"""Rankweave: set-enrichment analytics expressed as Spark DataFrame plans."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to the Python workers by value: executors need no copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from rankweave.api import (  # noqa: E402
    GseaRunner,
    build_tail_curve,
    calculate_es,
    get_random_es_means,
    load_gmt,
    multilevel_batched,
    multilevel_batched_scores,
    multilevel_per_set,
    plot_pathway_dynamics,
    plot_trajectory_heatmap,
    prepare_pathways,
    query_tail_curve,
    run,
    run_gsea,
    run_params,
    run_pipeline,
    run_trajectory_gsea,
)

__all__ = [
    "GseaRunner", "build_tail_curve", "calculate_es", "get_random_es_means", "load_gmt", "multilevel_batched", "multilevel_batched_scores", "multilevel_per_set", "plot_pathway_dynamics",
    "plot_trajectory_heatmap", "prepare_pathways", "query_tail_curve", "run", "run_gsea", "run_params", "run_pipeline", "run_trajectory_gsea",
]
