"""Enrichment along a trajectory, and the pipeline around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.operators import null, prep, trajectory
from rankweave.plans.enrich import enrich_lists
from rankweave.sources import catalog as sources


def run_trajectory(spark: SparkSession, expression: DataFrame, cells: DataFrame, sets, lineage_col: str | None = None, lineage_keyword: str | None = None, window_size: int = 500, step: int = 100, out: str | None = None, min_size: int = 15, max_size: int = 500, sample_size: int = 101, seed: int = 42, eps: float = 1e-50, nperm_nes: int = 100, pseudotime_key: str = "pseudotime", bin_width: int | None = 10, precheck: bool = True, calculate_nes: bool = True, use_nes_cache: bool = False, gsea_param: float = 1.0, root_gene: str | None = None) -> DataFrame:
    """Results of every rolling window of cells, all windows in one plan: enrichment columns and window_id, pt_start, pt_end, pt_mid.

    use_nes_cache takes the first window's background for all. out writes the result as Parquet or, by its name, CSV. root_gene orders the cells anew, from the cell
    of its largest value; a column of that name is replaced.
    """
    if root_gene is not None:
        from rankweave.operators.pseudotime import with_pseudotime

        cells = with_pseudotime(expression, prep.lineage_filter(cells, lineage_col, lineage_keyword).drop(pseudotime_key), pseudotime_key, root_gene=root_gene)
    if pseudotime_key not in cells.columns:
        raise ValueError(f"cells have no column {pseudotime_key}; make one first (see rankweave.operators.pseudotime)")
    kept = prep.lineage_filter(cells, lineage_col, lineage_keyword)
    ordered = trajectory.ordered_cells(kept, pseudotime_key).persist()
    n = ordered.count()
    lists = trajectory.window_scores(trajectory.log_normalised(expression), ordered, window_size, step, expression, n)
    ranks = prep.ranked(lists, ["window_id"]).persist()
    catalog = sources.catalog(spark, sets)
    background = None
    if calculate_nes and use_nes_cache:
        first = ranks.where("window_id = 0").drop("window_id")
        sizes = prep.members(catalog, first, min_size, max_size).select("size").distinct()
        background = null.background(sizes, null.rank_weights(first, gsea_param, []), nperm_nes, seed)
    found = enrich_lists(ranks, catalog, min_size, max_size, sample_size, seed, nperm_nes, gsea_param, eps, bin_width=bin_width, precheck=precheck, calculate_nes=calculate_nes, keys=["window_id"], background=background)
    found = found.join(trajectory.window_times(ordered, window_size, step, n), "window_id")
    if out:
        sources.write_result(found, out, "csv" if out.rstrip("/").endswith(".csv") else "parquet")
    return found


def run_pipeline(spark: SparkSession, expression: DataFrame, cells: DataFrame, sets, output_dir: str, pseudotime_key: str = "pseudotime", force_rerun: bool = False, window_size: int = 800, step: int = 50, min_size: int = 15, nperm_nes: int = 1000, **params) -> dict[str, DataFrame]:
    """core (cached results with smoothed NES), anchors (opposed pathway pairs), switch points of the best pair, and the data of the plots: heatmap, and dynamics of the best pair (of the two pathways of smallest p where no pair is)."""
    from rankweave.operators import analytics, anchors, pseudotime
    from rankweave.plans import plots

    if pseudotime_key not in cells.columns:
        cells = pseudotime.with_pseudotime(expression, cells, pseudotime_key)
    given = {"window_size": window_size, "step": step, "min_size": min_size, "nperm_nes": nperm_nes, "pseudotime_key": pseudotime_key, **params}
    core = sources.cached(spark, output_dir, given, lambda: run_trajectory(spark, expression, cells, sets, window_size=window_size, step=step, min_size=min_size, nperm_nes=nperm_nes, pseudotime_key=pseudotime_key, **params), force_rerun, [expression, cells, sources.catalog(spark, sets)])
    smooth = trajectory.smoothed(core)
    pairs = anchors.anchor_pairs(smooth)
    best = pairs.first()
    switch = anchors.switch_points(smooth, best["a"], best["b"]) if best else None
    n_windows = (core.agg(F.max("window_id")).first()[0] or 0) + 1
    shown = [best["a"], best["b"]] if best else [r["pathway"] for r in analytics.top_by_p(core.groupBy("pathway").agg(F.min("pval").alias("pval")), 2).collect()]
    return {"core": smooth, "anchors": pairs, "switch": switch, "heatmap": plots.trajectory_heatmap_data(core, n_windows), "dynamics": plots.pathway_dynamics_data(smooth, shown, "nes_smooth")}
