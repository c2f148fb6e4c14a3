"""Data of the plots of a trajectory's results. Where a plotting library is installed, the functions draw as well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.operators import analytics, prep


def trajectory_heatmap_data(results: DataFrame, n_windows: int, top: int = 30, value: str = "nes") -> DataFrame:
    """(place, pathway, name, window_id, value): the `top` pathways of largest variance over the windows in the order of their peaks, absent values 0."""
    chosen = analytics.top_variable(results, n_windows, top, value).select("pathway")
    held = results.join(F.broadcast(chosen), "pathway", "left_semi")
    peaks = analytics.peak_order(held, n_windows, value)
    # at most `top` rows
    order = peaks.agg(F.array_sort(F.collect_list(F.struct("peak_window", "pathway"))).alias("o")).select(F.posexplode("o").alias("place", "x")).select("place", "x.pathway")
    return analytics.heatmap_long(held, n_windows, value).join(F.broadcast(order), "pathway").select("place", "pathway", prep.display_name(F.col("pathway")).alias("name"), "window_id", "value")


def pathway_dynamics_data(results: DataFrame, pathways: list[str], value: str = "nes") -> DataFrame:
    """(pathway, name, window_id, value) of the named pathways, by pathway and window."""
    held = prep.chosen(results, "pathway", pathways)
    return held.select("pathway", prep.display_name(F.col("pathway")).alias("name"), "window_id", F.col(value).alias("value")).orderBy("pathway", "window_id")


def plot_trajectory_heatmap(results: DataFrame, n_windows: int, top: int = 30, value: str = "nes", ax=None):
    """The heatmap's data as pandas (at most top x n_windows values), drawn where matplotlib is installed."""
    data = trajectory_heatmap_data(results, n_windows, top, value).toPandas()
    try:
        import matplotlib.pyplot as plt
    except ImportError:
        return data
    ax = ax or plt.gca()
    wide = data.pivot(index="place", columns="window_id", values="value").sort_index()
    ax.imshow(wide.to_numpy(), aspect="auto", cmap="RdBu_r")
    ax.set_yticks(range(len(wide)), data.drop_duplicates("place").sort_values("place")["name"])
    return data


def plot_pathway_dynamics(results: DataFrame, pathways: list[str], value: str = "nes", ax=None):
    """The courses' data as pandas, drawn where matplotlib is installed."""
    data = pathway_dynamics_data(results, pathways, value).toPandas()
    try:
        import matplotlib.pyplot as plt
    except ImportError:
        return data
    ax = ax or plt.gca()
    for name, rows in data.groupby("name"):
        ax.plot(rows["window_id"], rows["value"], label=name)
    ax.legend()
    return data
