"""Windows, trajectories, pipeline, analytics and the driver's entry."""

import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankweave import queries
from rankweave.operators import analytics, anchors, enrichment, prep, pseudotime, trajectory, windowed
from rankweave.plans import trajectory as plans
from rankweave.sources import catalog as sources

ROOT = Path(__file__).resolve().parent.parent


def expression_of(spark, x):
    rows = [(f"c{i:03d}", f"g{j:02d}", float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1]) if x[i, j]]
    return spark.createDataFrame(rows, sources_ddl)


sources_ddl = "cell_id string, gene string, value double"


def cells_of(spark, times):
    return spark.createDataFrame([(f"c{i:03d}", float(t), "Ery" if i % 2 else "Mono") for i, t in enumerate(times)], "cell_id string, pseudotime double, lineage string")


@pytest.mark.parametrize(("n", "size", "step", "starts"), [(10, 4, 3, [0, 3, 6]), (9, 4, 3, [0, 3]), (3, 4, 3, []), (12, 4, 5, [0, 5]), (7, 3, 1, [0, 1, 2, 3, 4])])
def test_windows(spark, n, size, step, starts):
    ordered = trajectory.ordered_cells(cells_of(spark, range(n)))
    got = {}
    for r in trajectory.windows(ordered, size, step).collect():
        got.setdefault(r["window_id"], []).append(r["pos"])
    assert [sorted(got[k]) for k in sorted(got)] == [list(range(s, s + size)) for s in starts]


@pytest.mark.parametrize("step", [4, 3])
def test_window_scores(spark, step):
    rng = np.random.default_rng(4)
    x = rng.poisson(0.7, (20, 6)).astype(float)
    x[:, 5] = 0
    x[3, 5] = 1
    got = {(r["window_id"], r["gene"]): r["score"] for r in trajectory.window_scores(expression_of(spark, x), trajectory.ordered_cells(cells_of(spark, range(20))), 8, step).collect()}
    for w, a in enumerate(range(0, 20 - 8 + 1, step)):
        inside = x[a : a + 8].mean(0)
        outside = (x.sum(0) - x[a : a + 8].sum(0)) / 12
        for j in range(6):
            assert got[(w, f"g{j:02d}")] == pytest.approx(inside[j] - outside[j])
    assert len(got) == 6 * ((20 - 8) // step + 1)


def test_cells_without_time_are_dropped(spark):
    ordered = trajectory.ordered_cells(cells_of(spark, [3, float("nan"), 1, float("inf"), 1]))
    assert [(r["cell_id"], r["pos"]) for r in ordered.orderBy("pos").collect()] == [("c002", 0), ("c004", 1), ("c000", 2)]
    assert prep.lineage_filter(cells_of(spark, range(4)), "lineage", "ERY").count() == 2 and prep.lineage_filter(cells_of(spark, range(4)), None, "x").count() == 4


def rising(spark, n=120):
    rng = np.random.default_rng(0)
    t = np.linspace(0, 1, n)
    x = rng.gamma(1.0, 0.2, (n, 40))
    x[:, :10] += 2 * t[:, None]
    x[:, 10:20] += 2 * (1 - t[:, None])
    return expression_of(spark, x), cells_of(spark, t), {"Up": [f"g{i:02d}" for i in range(10)], "Down": [f"g{i:02d}" for i in range(10, 20)]}


def test_planted_trajectory(spark, tmp_path):
    expression, cells, sets = rising(spark)
    out = plans.run_pipeline(spark, expression, cells, sets, str(tmp_path / "out"), window_size=40, step=20, min_size=5, nperm_nes=50)
    core = out["core"].toPandas().sort_values("window_id")
    up, down = core[core.pathway == "Up"], core[core.pathway == "Down"]
    assert up["es"].iloc[0] < 0 < up["es"].iloc[-1] and down["es"].iloc[0] > 0 > down["es"].iloc[-1]
    assert up["nes_smooth"].is_monotonic_increasing
    assert (core["pt_start"] <= core["pt_mid"]).all() and (core["pt_mid"] <= core["pt_end"]).all()
    assert (core.groupby("window_id")["padj"].max() <= 1).all()
    pair = out["anchors"].first()
    assert {pair["a"], pair["b"]} == {"Up", "Down"} and pair["corr"] < -0.9
    assert 0.2 < out["switch"].first()["x"] < 0.8
    again = plans.run_pipeline(spark, expression, cells, sets, str(tmp_path / "out"), window_size=40, step=20, min_size=5, nperm_nes=50)
    assert again["core"].count() == len(core)
    matrix = anchors.anchor_matrix(out["core"], 3)
    assert matrix.where("bin between 0 and 2").count() == matrix.count()


def test_shared_background_and_missing_time(spark):
    expression, cells, sets = rising(spark, 80)
    a = plans.run_trajectory(spark, expression, cells, sets, window_size=40, step=40, min_size=5, nperm_nes=30, use_nes_cache=True)
    assert a.count() == 4
    with pytest.raises(ValueError):
        plans.run_trajectory(spark, expression, cells, sets, pseudotime_key="none")


def test_pseudotime_follows_the_course(spark):
    expression, cells, _ = rising(spark)
    made = pseudotime.with_pseudotime(expression, cells.drop("pseudotime"), root_cell="c000", neighbours=10).join(cells.select("cell_id", F.col("pseudotime").alias("t")), "cell_id").toPandas()
    assert abs(np.corrcoef(made["pseudotime"].rank(), made["t"].rank())[0, 1]) > 0.8


def test_log_normalised(spark):
    big = expression_of(spark, np.array([[30.0, 10.0], [5.0, 0.0]]))
    got = {(r["cell_id"], r["gene"]): r["value"] for r in trajectory.log_normalised(big).collect()}
    assert got[("c000", "g00")] == pytest.approx(np.log1p(7500)) and got[("c001", "g00")] == pytest.approx(np.log1p(10000))
    small = expression_of(spark, np.array([[3.0]]))
    assert trajectory.log_normalised(small).first()["value"] == 3.0


def test_metadata(spark):
    cells = cells_of(spark, range(3))
    meta = spark.createDataFrame([("c001", "x"), ("c000", "y")], "cell_id string, batch string")
    assert {r["cell_id"]: r["batch"] for r in sources.merge_metadata(cells, meta).collect()} == {"c000": "y", "c001": "x", "c002": None}
    assert sources.merge_metadata(cells, meta, positional=True).columns == cells.columns
    full = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "z")], "row string, batch string")
    assert [r["batch"] for r in sources.merge_metadata(cells, full.withColumnRenamed("row", "cell_id"), positional=True).orderBy("cell_id").collect()] == ["x", "y", "z"]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.5)], "Pathway string, `P-value` double")
    sources.write_result(rows, str(tmp_path / "t"), "tsv")
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "t")).columns == ["pathway", "pval"]


def test_analytics(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 2, 3.0), ("b", 1, 5.0)], "pathway string, window_id int, nes double")
    wide = {r["pathway"]: (r["w0"], r["w1"], r["w2"]) for r in analytics.heatmap(rows, [0, 1, 2]).collect()}
    assert wide == {"a": (1.0, 0.0, 3.0), "b": (0.0, 5.0, 0.0)}
    assert analytics.top_variable(rows, 3, 1).first()["pathway"] == "b"
    assert {r["pathway"]: r["peak_window"] for r in analytics.peak_order(rows, 3).collect()} == {"a": 2, "b": 1}
    speed = spark.createDataFrame([(1, 4.0), (4, 1.0)], "threads int, seconds double")
    assert {r["threads"]: r["speedup"] for r in analytics.speedup(speed).collect()} == {1: 1.0, 4: 4.0}
    band = anchors.bootstrap_interval(spark.createDataFrame([("k", float(i)) for i in range(50)], "k string, v double"), "k", "v", 100).first()
    assert band["low"] < band["mean"] < band["high"]


def test_pseudotime_has_one_method(spark, monkeypatch):
    """2,000 genes unless another number is given; more cells than landmarks are placed in the landmarks' map."""
    x = np.random.default_rng(2).random((12, 700))
    expression, cells, asked = expression_of(spark, x), cells_of(spark, range(12)).drop("pseudotime"), []
    chosen = pseudotime.variable_genes
    monkeypatch.setattr(pseudotime, "variable_genes", lambda e, n, top: (asked.append(top), chosen(e, n, top))[1])
    assert pseudotime.with_pseudotime(expression, cells, neighbours=4).where("pseudotime between 0 and 1").count() == 12 and asked == [2000]


def test_pseudotime_of_more_cells_than_landmarks(spark):
    """A curve of 400 cells: the order by 80 landmarks is that of the whole map, the root is at 0, and the map's own points extend to about their places."""
    t = np.sort(np.random.default_rng(5).random(400))
    x = np.stack([np.cos(3 * t), np.sin(3 * t), t**2], 1) * 5 + np.random.default_rng(6).normal(0, 0.02, (400, 3))
    expression = expression_of(spark, x)
    cells = spark.createDataFrame([(f"c{i:03d}",) for i in range(400)], "cell_id string")
    by = {n: pseudotime.with_pseudotime(expression, cells, root_cell="c000", n_pcs=3, landmarks=n).toPandas().set_index("cell_id")["pseudotime"] for n in (400, 80)}
    assert by[80]["c000"] == by[400]["c000"] == 0 and by[80].max() == by[400].max() == 1
    assert abs(np.corrcoef(by[80].sort_index().rank(), by[400].sort_index().rank())[0, 1]) > 0.98
    whole = pseudotime.DiffusionMap(x)
    assert np.corrcoef(whole.extended(x + 1e-9)[:, 0], whole.places[:, 0])[0, 1] > 0.999
    nobody = pseudotime.with_pseudotime(expression, cells.limit(0))
    assert nobody.columns == ["cell_id", "pseudotime"] and nobody.count() == 0


def test_queries_of_all_windows(spark):
    """Every window is in the heatmap, and the anchor matrix spans the data's own range; both equal their SQL."""
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in ("orders", "lineitem", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    for name, key, ids in (("heatmap", "window_id", {0, 1, 2, 3, 4}), ("anchor_matrix", "bin", {0, 15, 30, 45, 60})):
        got = {(r["pathway"], r[key]): r["value"] for r in queries.queries()[name](spark, d).select("pathway", key, "value").collect()}
        want = {(p, k): v for p, k, v in con.execute(f"SELECT pathway, {key}, value FROM ({queries.oracle_sql()[name]})").fetchall()}
        assert {k for _, k in got} == ids and got == want


def test_entry_without_training_data_operators():
    code = "import sys; sys.modules['rankweave.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'run_gsea' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q); print('fine')"
    assert "fine" in subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout


def test_melted(spark):
    wide = spark.createDataFrame(pd.DataFrame({"cell_id": ["a"], "g1": [1.0], "g2": [0.0]}))
    assert [tuple(r) for r in sources.melted(wide).collect()] == [("a", "g1", 1.0)]


def test_runs_of_windows_are_few(spark):
    """A gene's score is a row for each run of windows, so rows before the last step grow with the values and not with windows times genes."""
    rng = np.random.default_rng(5)
    x = np.where(rng.random((400, 30)) < 0.01, rng.integers(1, 9, (400, 30)), 0).astype(float)
    ordered = trajectory.ordered_cells(cells_of(spark, range(400)))
    genes = spark.createDataFrame([(f"g{j:02d}",) for j in range(31)], "gene string")
    sums = trajectory.bin_sums(expression_of(spark, x), ordered, 4)
    count = trajectory.window_count(400, 8, 4)
    runs = trajectory.window_runs(sums, genes, count, 2).collect()
    assert len(runs) <= 2 * sums.count() + 31 < count * 31 / 5
    got = {(w, r["gene"]): (r["inside"], r["total"]) for r in runs for w in range(r["low"], r["high"] + 1)}
    x = np.c_[x, np.zeros(400)]
    assert got == {(w, f"g{j:02d}"): (x[4 * w : 4 * w + 8, j].sum(), x[:, j].sum()) for w in range(count) for j in range(31)}


def test_window_enrichment_is_that_of_ranked_lists(spark):
    x = np.random.default_rng(6).integers(0, 3, (60, 40)).astype(float)
    ordered, expression = trajectory.ordered_cells(cells_of(spark, range(60))), expression_of(spark, x)
    named = sources.sets_from_dict(spark, {"a": [f"g{j:02d}" for j in range(0, 40, 2)], "b": [f"g{j:02d}" for j in range(0, 40, 3)], "few": ["g01"], "none": ["h00"]})
    lists = prep.ranked(trajectory.window_scores(expression, ordered, 20, 10).withColumn("score", F.round("score", 6)), ["window_id"])
    want = enrichment.enrichment(prep.members(named, lists, 5, 30, ["window_id"]), 1.0, ["window_id"])
    rows = lambda df: sorted((r["window_id"], r["pathway"], r["size"], round(r["es"], 12)) for r in df.collect())
    got = rows(trajectory.window_enrichment(expression, ordered, named, 20, 10, 5, 30, digits=6))
    assert got == rows(want) and len(got) == 10
    assert trajectory.window_enrichment(expression, ordered, named, 20, 10, 30, 40, digits=6).collect() == []


@pytest.mark.parametrize("blocks", [1, 3, 32])
@pytest.mark.parametrize("power", [1.0, 0.5])
def test_window_enrichment_by_blocks(spark, monkeypatch, blocks, power):
    """Lists with many ties and genes of several sets, in blocks of windows; no row for each window and gene is shuffled."""
    monkeypatch.setattr(windowed, "BLOCKS", blocks)
    rng = np.random.default_rng(7)
    x = np.where(rng.random((170, 50)) < 0.1, rng.integers(1, 4, (170, 50)), 0).astype(float)
    x[60:100] = 0  # windows whose lists are alike
    ordered, expression = trajectory.ordered_cells(cells_of(spark, range(170))), expression_of(spark, x)
    named = sources.sets_from_dict(spark, {f"s{k}": [f"g{j:02d}" for j in rng.choice(50, 12, replace=False)] for k in range(6)} | {"all": [f"g{j:02d}" for j in range(50)]})
    lists = prep.ranked(trajectory.window_scores(expression, ordered, 10, 5, digits=6), ["window_id"])
    want = enrichment.enrichment(prep.members(named, lists, 5, 50, ["window_id"]), power, ["window_id"])
    rows = lambda df: sorted((r["window_id"], r["pathway"], r["size"], round(r["es"], 12)) for r in df.collect())
    found = trajectory.window_enrichment(expression, ordered, named, 10, 5, 5, 50, power, 6)
    assert found.dtypes == want.dtypes and rows(found) == rows(want) and found.count() == 33 * 7
    assert "hashpartitioning(window_id" not in found._jdf.queryExecution().executedPlan().toString()


def test_block_rows_are_runs_and_a_list_for_each_block(spark):
    runs = spark.createDataFrame([(0, 0, 9, 1.0, [3]), (1, 0, 4, 2.0, None), (1, 5, 9, 0.0, None)], "place int, low int, high int, score double, ids array<int>")
    got = sorted(tuple(r) for r in windowed.block_rows(runs, 4).collect())
    assert got == [(0, 0, 1.0, [3]), (0, 1, 2.0, None), (4, 0, 1.0, [3]), (4, 1, 2.0, None), (5, 1, 0.0, None), (8, 0, 1.0, [3]), (8, 1, 0.0, None)]


@pytest.mark.parametrize("name", ["calibration", "tost", "replicates_calibrated", "repeated_genes", "replicate_qq", "seed_agreement", "heatmap"])
def test_queries_without_a_set_that_qualifies(spark, tmp_path, name):
    """No brand has 15 parts here; brands of over 5,000 parts leave as few sets."""
    con = duckdb.connect()
    tables = {
        "part": "SELECT i::BIGINT AS p_partkey, 'Brand#' || (11 + i % 9) AS p_brand, 'T' || i % 2 AS p_type FROM range(60) t(i)",
        "orders": "SELECT i::BIGINT AS o_orderkey, TIMESTAMP '1998-01-01' + INTERVAL (i) DAY AS o_orderdate, 'F' AS o_orderstatus FROM range(300) t(i)",
        "lineitem": "SELECT i::BIGINT AS l_orderkey, (i * 7 % 60)::BIGINT AS l_partkey, (1000 + i * 37 % 900)::DOUBLE AS l_extendedprice, 0.1::DOUBLE AS l_discount, TIMESTAMP '1998-01-01' + INTERVAL (i) DAY AS l_shipdate FROM range(300) t(i)",
    }
    for table, rows in tables.items():
        con.execute(f"COPY ({rows}) TO '{tmp_path}/{table}.parquet'")
        con.execute(f"CREATE VIEW {table} AS FROM read_parquet('{tmp_path}/{table}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    held = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    assert held(want.fetchall()) == held(tuple(r[c] for c in names) for r in queries.queries()[name](spark, str(tmp_path)).collect())


def test_smoothed_has_brands_of_any_size(spark, tmp_path):
    """A brand of 5,600 parts has its rows as one of 400 has."""
    con = duckdb.connect()
    tables = {
        "part": "SELECT i::BIGINT AS p_partkey, 'Brand#' || CASE WHEN i % 15 = 0 THEN 12 ELSE 11 END AS p_brand FROM range(6000) t(i)",
        "orders": "SELECT i::BIGINT AS o_orderkey, TIMESTAMP '1992-01-01' + INTERVAL (i) HOUR AS o_orderdate, 'F' AS o_orderstatus FROM range(10000) t(i)",
        "lineitem": "SELECT i::BIGINT AS l_orderkey, (i * 7 % 6000)::BIGINT AS l_partkey, (1000 + i * 37 % 900)::DOUBLE AS l_extendedprice, 0.1::DOUBLE AS l_discount, TIMESTAMP '1998-01-01' AS l_shipdate FROM range(10000) t(i)",
    }
    for table, rows in tables.items():
        con.execute(f"COPY ({rows}) TO '{tmp_path}/{table}.parquet'")
        con.execute(f"CREATE VIEW {table} AS FROM read_parquet('{tmp_path}/{table}.parquet')")
    want = sorted(con.execute(queries.oracle_sql()["smoothed"]).fetchall())
    got = sorted((r["pathway"], r["window_id"], r["nes"], r["nes_smooth"]) for r in queries.queries()["smoothed"](spark, str(tmp_path)).collect())
    assert got == want and len(got) == 6 and {r[0] for r in got} == {"Brand#11", "Brand#12"}
