"""Public names, synthetic inputs, global order, plots' data, caches and the driver's queries against their SQL."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import rankweave
from rankweave import queries
from rankweave.operators import adjust, ordering, prep, trajectory
from rankweave.plans import enrich, plots
from rankweave.sources import catalog as sources
from rankweave.sources import synthetic

DATA = "/root/testdata/sf0.01"


def test_names_of_the_package(spark, tmp_path):
    assert all(hasattr(rankweave, x) for x in rankweave.__all__)
    scores = [2.5, 1.8, 0.5, -0.2, -1.5]
    assert rankweave.calculate_es(scores, [0, 1]) == pytest.approx(1) and rankweave.calculate_es(scores, [3, 4]) == pytest.approx(-1)
    assert rankweave.calculate_es(scores, [1, 3]) == pytest.approx(0.5666666666666667) and rankweave.calculate_es(scores, [1, 1, 3, 9]) == pytest.approx(0.5666666666666667)
    assert rankweave.calculate_es(scores, [1, 3], 0.5) == pytest.approx(0.4166666666666667) and rankweave.calculate_es(scores, []) == 0
    x = np.sort(np.random.default_rng(0).normal(size=400))[::-1]
    (up, down), (one, _) = rankweave.get_random_es_means(x, [20, 400], 300)
    assert 0.1 < up < 0.5 and -0.5 < down < -0.1 and one == 0
    curve = rankweave.build_tail_curve(x, 20, 101, eps=1e-4)
    p = [rankweave.query_tail_curve(curve, v)[0] for v in (0.0, 0.2, 0.5, 0.7)]
    assert p[0] == 1 and p == sorted(p, reverse=True) and p[3] < 0.01 and rankweave.query_tail_curve(curve, 0.5)[1] == pytest.approx(101**-0.5)
    (tmp_path / "s.gmt").write_text("a\tNA\tx\ty\tz\nb\tNA\tx\n")
    assert rankweave.load_gmt(spark, str(tmp_path / "s.gmt")).count() == 4
    ready = rankweave.prepare_pathways(spark, ["x", "y", "q"], str(tmp_path / "s.gmt"), 2, 5)
    assert sorted(map(tuple, ready.collect())) == [("a", "x"), ("a", "y")]


@pytest.mark.parametrize("n", [0, 1, 3, 500])
def test_places_of_a_spread_list(spark, n):
    """Ranks and adjusted values over all tasks equal those of one task, with most scores tied."""
    rng = np.random.default_rng(n)
    rows = [(f"g{i:04d}", float(rng.choice([0.0, 0.0, 0.0, 1.0, -1.0, float(i)]))) for i in range(n)]
    scores = spark.createDataFrame(rows, "gene string, score double")
    for tie in prep.TIES:
        assert sorted(map(tuple, prep.ranked(scores, tie=tie, spread=True).collect())) == sorted(map(tuple, prep.ranked(scores, tie=tie).collect()))
    if n > 3:
        ranges = ordering.Ranges(scores, [F.col("score"), F.col("gene")], 8)
        assert len(ranges.sizes) == 8 and max(ranges.sizes.values()) < n / 2
    results = scores.select(F.col("gene").alias("pathway"), (F.abs(F.sin("score")) + 1e-6).alias("pval"))
    one = {r["pathway"]: r["padj"] for r in adjust.bh(results).collect()}
    many = {r["pathway"]: r["padj"] for r in adjust.bh(results, spread=True).collect()}
    assert one.keys() == many.keys() and all(many[k] == pytest.approx(one[k], rel=1e-12) for k in one)


def test_window_middles(spark):
    cells = spark.createDataFrame([(f"c{i}", float(t)) for i, t in enumerate([0, 1, 2, 100])], "cell_id string, pseudotime double")
    got = trajectory.window_times(trajectory.ordered_cells(cells), 4, 1).first()
    assert (got["pt_start"], got["pt_end"], got["pt_mid"]) == (0.0, 100.0, 50.0)


def test_run_parameters_go_with_a_result(spark, tmp_path):
    data = pd.Series(np.random.default_rng(3).normal(size=60), index=[f"G{i}" for i in range(60)])
    found = enrich.run_gsea(spark, data, {"s": [f"G{i}" for i in range(20)]}, nperm_nes=10, seed=5, bin_width=10)
    found.write.parquet(str(tmp_path / "r"))
    asked = enrich.parameters(spark.read.parquet(str(tmp_path / "r")))
    assert (asked["seed"], asked["bin_width"], asked["score_type"], asked["use_batched"]) == ("5", "10", "two_sided_abs", "True")


def test_plot_data(spark):
    rows = [(f"HALLMARK_P{p}", w, float((w - p) ** 2 * (p + 1))) for p in range(4) for w in range(5) if (p + w) % 3]
    results = spark.createDataFrame(rows, "pathway string, window_id int, nes double")
    data = plots.plot_trajectory_heatmap(results, 5, top=3)
    assert len(data) == 15 and set(data["place"]) == {0, 1, 2} and set(data["name"]) <= {f"P{p}" for p in range(4)}
    course = plots.plot_pathway_dynamics(results, ["HALLMARK_P1"])
    assert list(course["window_id"]) == sorted(course["window_id"]) and set(course["name"]) == {"P1"}


def test_synthetic_sets_are_partition_free(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    a = sorted(map(tuple, synthetic.random_sets(spark, 500, [15, 40], 1).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == sorted(map(tuple, synthetic.random_sets(spark, 500, [15, 40], 1).collect())) and len(set(a)) == 55


def test_cache_follows_rows(spark, tmp_path):
    made = []

    def run(rows):
        return sources.cached(spark, str(tmp_path), {"a": 1}, lambda: made.append(1) or rows, inputs=[rows]).count()

    one = spark.range(5)
    assert (run(one), run(one.orderBy(F.desc("id"))), run(spark.range(6))) == (5, 5, 6) and len(made) == 2


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", ["adjusted_spread", "catalog_forms", "picked_pathways", "result_cache", "run_gsea_many_sets_verified", "run_trajectory_verified", "runner", "score_forms", "sinks", "synthetic"])
def test_queries_against_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("nation", "part", "lineitem", "orders", "embeddings"):
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    found = queries.queries()[name](spark, DATA)
    asked = con.execute(queries.oracle_sql()[name])
    order = [c[0] for c in asked.description]
    shown = lambda rows: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert sorted(found.columns) == sorted(order) and shown(map(tuple, found.select(*order).collect())) == shown(asked.fetchall())
