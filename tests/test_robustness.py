"""Prefix sums of windows, turned orders, parameter scans, exact neighbours, eigenvectors, sketches, traces and merges by place, against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import rankweave
from rankweave.operators import neighbours, pseudotime, robustness, trajectory
from rankweave.plans import enrich
from rankweave.sources import catalog as sources
from rankweave.sources.steps import Steps


def cells_of(spark, n, genes=6, seed=0):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, genes)) < 0.7, rng.integers(1, 50, (n, genes)), 0).astype(float)
    order = rng.permutation(n)
    rows = [(f"c{i:04d}", f"g{g}", float(x[i, g])) for i in range(n) for g in range(genes) if x[i, g]]
    cells = [(f"c{i:04d}", float(p)) for i, p in zip(range(n), order, strict=True)]
    by_place = x[np.argsort(order)]
    return by_place, spark.createDataFrame(rows, "cell_id string, gene string, value double"), trajectory.ordered_cells(spark.createDataFrame(cells, "cell_id string, pseudotime double"))


def score_of(x, inside):
    rest = np.delete(x, inside, 0)
    return x[inside].sum(0) / len(inside) - rest.sum(0) / max(1, len(rest))


@pytest.mark.parametrize(("n", "size", "step"), [(43, 8, 4), (40, 10, 10), (12, 12, 3), (5, 8, 4), (30, 9, 4)])
def test_windows_of_prefix_sums(spark, n, size, step):
    x, expression, ordered = cells_of(spark, n)
    got = {(r["window_id"], r["gene"]): r["score"] for r in trajectory.window_scores(expression, ordered, size, step).collect()}
    count = trajectory.window_count(n, size, step)
    assert len(got) == 6 * count
    for w in range(count):
        want = score_of(x, np.arange(w * step, w * step + size))
        assert all(got[w, f"g{g}"] == pytest.approx(want[g], abs=1e-9) for g in range(6))


def test_windows_of_named_genes(spark):
    """A gene without values has the score 0, a gene that isn't named none; missing values and no numbers don't count."""
    _, expression, ordered = cells_of(spark, 20)
    odd = spark.createDataFrame([("c0001", "g1", None), ("c0002", "g1", float("nan"))], "cell_id string, gene string, value double")
    genes = spark.createDataFrame([("g1",), ("none",)], "gene string")
    got = trajectory.window_scores(expression.unionByName(odd), ordered, 4, 2, genes).collect()
    plain = {(r["window_id"], r["gene"]): r["score"] for r in trajectory.window_scores(expression, ordered, 4, 2).collect()}
    assert {r["gene"] for r in got} == {"g1", "none"} and len(got) == 18
    assert all(r["score"] == (0 if r["gene"] == "none" else pytest.approx(plain[r["window_id"], "g1"])) for r in got)


def test_window_scores_are_shuffled_by_gene_once(spark):
    """Genes without a value in any cell have their windows too, before and after the first value."""
    x, expression, ordered = cells_of(spark, 43)
    odd = spark.createDataFrame([("nobody", "a", 5.0), ("c0001", "b", None), ("c0002", "c", float("nan")), ("nobody", "g1", 7.0)], "cell_id string, gene string, value double")
    late = ordered.where("pos = 36").select("cell_id", F.lit("d").alias("gene"), F.lit(3.0).alias("value"))
    found = trajectory.window_scores(expression.unionByName(odd).unionByName(late), ordered, 8, 4)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(gene") == 1
    got = {(r["window_id"], r["gene"]): r["score"] for r in found.collect()}
    x = np.c_[x, np.zeros((43, 4))]
    x[36, 9] = 3
    names = [*(f"g{g}" for g in range(6)), "a", "b", "c", "d"]
    assert len(got) == 10 * 9
    for w in range(9):
        want = score_of(x, np.arange(w * 4, w * 4 + 8))
        assert all(got[w, name] == pytest.approx(want[j], abs=1e-9) for j, name in enumerate(names))


def test_turned_orders(spark):
    n, size, step = 43, 12, 4
    x, expression, ordered = cells_of(spark, n)
    bins = n // step
    turns = {r["replicate"]: r["shift"] for r in robustness.shifts(spark, 6, bins).collect()}
    assert turns[0] == 0 and all(1 <= turns[k] < bins for k in range(1, 7)) and len(set(turns.values())) > 2
    got = {(r["replicate"], r["window_id"], r["gene"]): r["score"] for r in robustness.shifted_scores(expression, ordered, size, step, 6).collect()}
    assert len(got) == 7 * trajectory.window_count(n, size, step) * 6
    for (k, w, g), value in got.items():
        start = (w + turns[k]) * step
        inside = np.arange(start, start + size) % (bins * step)
        assert value == pytest.approx(score_of(x, inside)[int(g[1:])], abs=1e-9)
    with pytest.raises(ValueError):
        robustness.shifted_scores(expression, ordered, 10, 4)


def test_scan_equals_single_runs(spark):
    _, expression, ordered = cells_of(spark, 50)
    grid = [(12, 4), (10, 2), (6, 6), (60, 2)]
    got = {(r["width"], r["step"], r["window_id"], r["gene"]): r["score"] for r in robustness.scan_scores(expression, ordered, grid).collect()}
    want = {(s, t, r["window_id"], r["gene"]): r["score"] for s, t in grid for r in trajectory.window_scores(expression, ordered, s, t).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)


def test_null_and_summary(spark):
    rows = [(k, w, "p", v) for w in (0, 1) for k, v in enumerate([0.5, 0.1, -0.6, 0.5, 0.2] if w else [-0.1, 0.2, 0.3, 0.05, -0.3])]
    got = {r["window_id"]: r for r in robustness.null_distribution(spark.createDataFrame(rows, "replicate int, window_id int, pathway string, es double")).collect()}
    assert got[1]["null_p"] == pytest.approx(3 / 5) and got[0]["null_p"] == pytest.approx(4 / 5) and got[0]["es"] == -0.1 and got[1]["null_mean"] == pytest.approx(0.05)
    scan = [(10, 5, 0, "p", 0.2), (10, 5, 1, "p", -0.4), (20, 10, 0, "p", 0.3), (20, 10, 1, "p", 0.1)]
    row = robustness.scan_summary(spark.createDataFrame(scan, "width int, step int, window_id int, pathway string, es double")).first()
    assert (row["settings"], row["most"], row["least"]) == (2, 0.3, -0.4) and row["peak_mean"] == pytest.approx((10 / 15 + 10 / 30) / 2) and row["sign_share"] == 0.5


def points_of(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>").repartition(3)


@pytest.mark.parametrize(("n", "block", "chunk", "dims"), [(300, 30, 20, 3), (300, 1000, 50, 3), (200, 10, 7, 1), (4, 2, 2, 2), (1, 5, 5, 2)])
def test_nearest_against_brute_force(spark, n, block, chunk, dims):
    """With equal points in great number, few and many blocks, and chunks smaller than blocks."""
    rng = np.random.default_rng(n + block)
    x = rng.normal(size=(n, dims)).round(1)
    x[: n // 4] = 0.0
    with Steps(spark) as steps:
        got = {}
        for r in neighbours.nearest(points_of(spark, x), 5, steps, block, 64, chunk).collect():
            got.setdefault(r["id"], set()).add((r["neighbour"], round(r["square"], 6)))
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    for i in range(n):
        far = sorted((round(float(d[i, j]), 6), j) for j in range(n) if j != i)[:5]
        assert sorted(s for _, s in got.get(i, ())) == [s for s, _ in far]
        assert all(round(float(d[i, j]), 6) == s for j, s in got.get(i, ()))


def test_leading_eigenvectors(spark):
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(rng.normal(size=(60, 60)))[0]
    a = basis @ np.diag(np.concatenate([rng.uniform(-0.9, 0.2, 57), [0.8, 0.9, 1.0]])) @ basis.T
    edges = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "i long, j long, w double")
    start = spark.createDataFrame([(i, *map(float, rng.normal(size=3))) for i in range(60)], "i long, v0 double, v1 double, v2 double")
    with Steps(spark) as steps:
        values, vectors = neighbours.leading(edges, start, 3, steps, 2)
        got = vectors.orderBy("i").toPandas()[["v0", "v1", "v2"]].to_numpy()
    assert np.allclose(values, [1.0, 0.9, 0.8], atol=2e-3)
    assert np.allclose(got.T @ got, np.eye(3), atol=1e-6) and abs(got[:, 0] @ basis[:, -1]) > 0.999


def branch(n, genes=40, seed=1):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.random(n))
    centres = np.linspace(-0.2, 1.2, genes)
    return t, np.exp(-((t[:, None] - centres[None]) ** 2) / 0.05) * 8 + rng.random((n, genes)) * 0.3


def long_table(spark, x):
    rows = pd.DataFrame({"cell_id": np.repeat([f"c{i:05d}" for i in range(len(x))], x.shape[1]), "gene": [f"g{g:02d}" for g in range(x.shape[1])] * len(x), "value": x.ravel()})
    return spark.createDataFrame(rows)


def test_map_of_all_cells(spark):
    """By joins over all cells it agrees with the eigensolver's map of all cells; from few landmarks as well."""
    t, x = branch(400)
    expression = long_table(spark, x)
    cells = expression.select("cell_id").distinct()
    exact = pseudotime.with_pseudotime(expression, cells, root_cell="c00000", landmarks=400).toPandas().set_index("cell_id").sort_index()["pseudotime"]
    by_joins = pseudotime.with_pseudotime(expression, cells, root_cell="c00000", landmarks=80, all_cells=True).toPandas().set_index("cell_id").sort_index()["pseudotime"]
    few = pseudotime.with_pseudotime(expression, cells, root_cell="c00000", landmarks=80).toPandas().set_index("cell_id").sort_index()["pseudotime"]
    assert np.corrcoef(exact, by_joins)[0, 1] > 0.99 and by_joins.iloc[0] == 0 and by_joins.max() == pytest.approx(1)
    assert np.corrcoef(exact.rank(), t)[0, 1] > 0.95 and np.corrcoef(exact, few)[0, 1] > 0.8


def test_axes_of_a_sketch(spark):
    _, x = branch(300, 30)
    genes = [f"g{g:02d}" for g in range(30)]
    mean, axes = pseudotime._components(long_table(spark, x), genes, 3, 300)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(mean, x.mean(0)) and axes.shape == (30, 3) and np.allclose(axes.T @ axes, np.eye(3), atol=1e-9)
    assert all(abs(axes[:, c] @ vectors[:, -1 - c]) > 0.999 for c in range(3))


def test_variable_genes_by_definition(spark):
    rng = np.random.default_rng(2)
    x = rng.gamma(2.0, rng.uniform(0.1, 20, 80), (50, 80)) * (rng.random((50, 80)) < 0.8)
    x[:, 0] = 0.0
    x[:, 1] = -1.0
    mean, variance = x.mean(0), x.var(0, ddof=1)
    known = (mean > 0) & (variance > 0)
    d, m = np.log(variance[known] / mean[known]), np.log1p(mean[known])
    place = np.clip(np.ceil((m - m.min()) / (m.max() - m.min()) * 20), 1, 20)
    want = {}
    for g, v, b in zip(np.flatnonzero(known), d, place, strict=True):
        own = d[place == b]
        want[f"g{g:02d}"] = (v - own.mean()) / own.std(ddof=1) if len(own) > 1 else 1.0
    got = pseudotime.variable_genes(long_table(spark, x), 50, 60).collect()
    assert [r["gene"] for r in got] == sorted(want, key=lambda g: (-round(want[g], 9), -variance[int(g[1:])]))[:60] and all(r["dispersion"] == pytest.approx(want[r["gene"]], abs=1e-9) for r in got)
    assert pseudotime.variable_genes(long_table(spark, x), 50, 100).where("dispersion is null").count() == 2


def test_merge_by_place(spark):
    rng = np.random.default_rng(5)
    keys = [int(k) for k in rng.permutation(200)]
    left = spark.createDataFrame([(k, f"c{k}") for k in keys], "place long, name string").repartition(5)
    right = spark.createDataFrame([(1000 - k, k) for k in keys], "place long, note long").repartition(3)
    got = {r["name"]: r["note"] for r in sources.merge_metadata(left, right, positional=True, order="place").collect()}
    assert got == {f"c{k}": 199 - k for k in keys}
    assert sources.merge_metadata(left, right.limit(10), positional=True, order="place").columns == ["place", "name"]
    some = spark.createDataFrame([(None, "n"), (1, "a")], "place long, name string")
    assert {(r["name"], r["note"]) for r in sources.merge_metadata(some, spark.createDataFrame([(None, 5), (7, 6)], "place long, note long"), positional=True, order="place").collect()} == {("n", 5), ("a", 6)}


def test_traces(spark):
    rng = np.random.default_rng(0)
    data = {f"g{i:03d}": float(x) for i, x in enumerate(np.sort(rng.normal(size=300))[::-1])}
    sets = {"top": [f"g{i:03d}" for i in range(20)], "mid": [f"g{i:03d}" for i in range(0, 300, 15)]}
    for batched in (True, False):
        found = enrich.run_gsea(spark, data, sets, eps=1e-6, nperm_nes=20, use_batched=batched, traces=True)
        rows = enrich.levels(found).toPandas()
        counts = rows.groupby("pathway").size().to_dict()
        for r in found.collect():
            assert counts.get(r["pathway"], 0) == r["n_levels"]
            own = rows[rows["pathway"] == r["pathway"]].sort_values("level")
            assert own["threshold"].is_monotonic_increasing and own["log_prob"].is_monotonic_decreasing and own["accept_rate"].isna().all() == batched or not len(own)
        assert counts["top"] > 5
    assert "trace" not in enrich.run_gsea(spark, data, sets, eps=1e-2, nperm_nes=4).columns


def test_lists_side_by_side(spark):
    rng = np.random.default_rng(0)
    rows = [(k, f"g{i:03d}", float(x)) for k in ("a", "b") for i, x in enumerate(rng.normal(size=120))]
    sets = spark.createDataFrame([("s", f"g{i:03d}") for i in range(20)], "pathway string, gene string")
    got = rankweave.multilevel_batched_scores(spark.createDataFrame(rows, "list string, gene string, score double"), sets, eps=1e-3, nperm_nes=20).collect()
    assert {r["list"] for r in got} == {"a", "b"} and all(0 < r["pval"] <= 1 and math.isfinite(r["es"]) for r in got)
