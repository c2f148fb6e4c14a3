"""Walks by blocks, nested and hashed draws, and replicates, against plain versions of themselves."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave import queries
from rankweave.operators import multilevel, null, prep, replicates
from rankweave.plans import enrich


def weights_of(n, seed=1):
    return np.abs(np.sort(np.random.default_rng(seed).normal(size=n))[::-1])


@pytest.mark.parametrize(("n", "k", "rows"), [(700, 320, 30), (900, 899, 7), (2000, 400, 51), (331, 310, 20)])
def test_blocks_keep_the_same_moves(monkeypatch, n, k, rows):
    """The same numbers are drawn and the same exchanges kept as when each set is scored anew."""
    w = weights_of(n)
    w[n // 2 :: 3] = 0.0
    out = []
    for limit in (10**9, 0):
        monkeypatch.setattr(multilevel, "BLOCKED", limit)
        rng = null.rng_of(3, n, k)
        hits = null.random_hits(rng, n, k, 2 * rows)
        metric = np.abs(null.scores_of_sets(w, hits))
        best = np.argsort(-metric)[:rows]
        out.append(multilevel.walk(rng, w, hits[best], metric[best], float(metric[best].min()), 60, 1, True))
    assert (out[0][0] == out[1][0]).all() and np.allclose(out[0][1], out[1][1], atol=1e-10) and out[0][2] == out[1][2]
    assert out[0][2] > 0 and (np.diff(out[0][0], axis=1) > 0).all()


def test_walks_stay_above_the_floor():
    w = weights_of(5000)
    rng = null.rng_of(1, "floor")
    hits = null.random_hits(rng, 5000, 600, 40)
    metric = np.abs(null.scores_of_sets(w, hits))
    floor = float(np.median(metric))
    hits, metric = hits[metric >= floor], metric[metric >= floor]
    moved, value, rate = multilevel.walk(rng, w, hits, metric, floor, 100, 1, True)
    assert np.allclose(value, np.abs(null.scores_of_sets(w, moved))) and value.min() >= floor - 1e-9 and 0 < rate <= 1
    assert (moved != hits).any()


def test_nested_draws_serve_all_sizes():
    w = weights_of(200)
    order = null.random_order(null.rng_of(1, "o"), 200, 60, 40)
    assert all(len(set(r)) == 60 for r in order.tolist()) and order.min() >= 0 and order.max() < 200
    got = null.nested_scores(w, order, [1, 7, 60])
    for j, k in enumerate([1, 7, 60]):
        assert np.allclose(got[:, j], null.scores_of_sets(w, np.sort(order[:, :k], 1)))
    places = np.bincount(null.random_order(null.rng_of(2, "o"), 6, 3, 6000)[:, 0], minlength=6) / 6000
    assert np.abs(places - 1 / 6).max() < 0.025


def test_hashed_order_by_definition():
    genes = [f"gén{i}" for i in range(300)]
    want = sorted(range(300), key=lambda i: hashlib.md5(f"7|3|{genes[i]}".encode()).hexdigest())
    for k in (1, 20, 300):
        assert null.hashed_order([g.encode() for g in genes], 7, 3, k).tolist() == want[:k]


def ranked(spark, n):
    x = np.random.default_rng(4).normal(size=n)
    return prep.ranked(spark.createDataFrame([(f"g{i:03d}", float(v)) for i, v in enumerate(x)], "gene string, score double"))


def test_background_equals_hashed_draws(spark):
    ranks = ranked(spark, 150)
    sizes = spark.createDataFrame([(3,), (40,), (150,), (200,)], "size int")
    named = null.rank_weights(ranks, 1.0, [], genes=True)
    got = {r["size"]: (r["pos_mean"], r["neg_mean"]) for r in null.background(sizes, named, 70, 5, draws="hashed").collect()}
    want = {r["size"]: (r["pos_mean"], r["neg_mean"]) for r in null.means_of(null.hashed_background(ranks, sizes, 70, 5)).collect()}
    assert got.keys() == want.keys() == {3, 40, 150, 200}
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in got)
    assert null.background(sizes.where("false"), named, 10).count() == 0
    assert {tuple(r) for r in null.background(sizes.where("size = 3"), named, 0).collect()} == {(3, 1.0, -1.0)}
    with pytest.raises(ValueError):
        null.background(sizes, named, 10, draws="other")


def by_definition(rows, sizes, nperm, seed):
    """(perm, size): score of hashed sets of one list of (rnk, w, gene) rows."""
    rows = sorted(rows)
    genes, w = [r[2].encode() for r in rows], np.array([r[1] for r in rows])
    drawn = [null.hashed_order(genes, seed, p, min(max(sizes), len(w))) for p in range(nperm)]
    return {(p, k): float(null.scores_of_sets(w, np.sort(drawn[p][:k])[None])[0]) for p in range(nperm) for k in sizes}


@pytest.mark.parametrize("most", [null.ROWS, 0])
def test_hashed_draws_of_rows(spark, monkeypatch, most):
    """No task gets a list with names as one row; sets are exact where genes repeat, and where a size is none or all of the list."""
    monkeypatch.setattr(null, "ROWS", most)
    monkeypatch.setattr(null, "BLOCK", 64)
    named = null.rank_weights(ranked(spark, 500), 1.0, [], genes=True)
    assert named.count() == 500
    lists = {1: [tuple(r) for r in named.select("rnk", "w", "gene").collect()]}
    lists[2] = [(i, w, f"é{i % 3}" if i % 10 else g) for i, w, g in lists[1][:400]]
    rows = spark.createDataFrame([(k, *r) for k, x in lists.items() for r in x], "k int, rnk int, w double, gene string")
    sizes = {1: [0, 2, 7, 600], 2: [5, 20]}
    asked = spark.createDataFrame([(k, s) for k, x in sizes.items() for s in x] + [(3, 4)], "k int, size int")
    got = {(r["k"], r["perm"], r["size"]): r["es"] for r in null.hashed_scores(asked, rows, 9, 5, ["k"]).collect()}
    want = {(k, *x): v for k in sizes for x, v in by_definition(lists[k], sizes[k], 9, 5).items()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(v, abs=1e-12) for x, v in want.items())
    few = {(r["perm"], r["size"]): r["es"] for r in null.hashed_scores(asked.where("k = 2").select("size"), rows.where("k = 2").drop("k"), 9, 5, []).collect()}
    assert few == {x[1:]: v for x, v in got.items() if x[0] == 2}
    assert {tuple(r) for r in null.hashed_scores(asked.where("size = 4").select("size"), rows.where("k = 3").drop("k"), 2, 5, []).collect()} == {(0, 4, 0.0), (1, 4, 0.0)}


def test_background_of_many_lists(spark):
    """Each list has its own draws, which don't depend on the others or on the number of tasks."""
    one = ranked(spark, 120)
    lists = one.withColumn("k", F.lit(1)).unionByName(one.withColumn("k", F.lit(2)))
    sizes = spark.createDataFrame([(1, 10), (1, 30), (2, 10)], "k int, size int")
    both = {(r["k"], r["size"]): r["pos_mean"] for r in null.background(sizes, null.rank_weights(lists, 1.0, ["k"]), 60, keys=["k"]).collect()}
    alone = {(r["k"], r["size"]): r["pos_mean"] for r in null.background(sizes.where("k = 1"), null.rank_weights(lists, 1.0, ["k"]).repartition(1), 60, keys=["k"]).collect()}
    assert set(both) == {(1, 10), (1, 30), (2, 10)} and all(both[x] == v for x, v in alone.items())
    assert both[1, 10] != both[2, 10]


def test_replicates_are_permutations(spark):
    ranks = ranked(spark, 80)
    lists = replicates.permuted_lists(ranks, 3, 9).collect()
    genes = {r["gene"] for r in lists}
    scores = {r["rnk"]: r["score"] for r in ranks.collect()}
    for k in range(3):
        own = [r for r in lists if r["replicate"] == k]
        assert sorted(r["rnk"] for r in own) == list(range(80)) and {r["gene"] for r in own} == genes and all(r["score"] == scores[r["rnk"]] and r["n"] == 80 for r in own)
        want = sorted(genes, key=lambda g, k=k: hashlib.md5(f"replicate|9|{k}|{g}".encode()).hexdigest())
        assert [r["gene"] for r in sorted(own, key=lambda r: r["rnk"])] == want


def test_spread_runs_equal_others(spark):
    rng = np.random.default_rng(0)
    data = {f"g{i:03d}": float(x) for i, x in enumerate(rng.normal(size=200))}
    sets = {f"s{k}": [f"g{i:03d}" for i in rng.choice(200, 20, replace=False)] for k in range(12)}
    a = enrich.run_gsea(spark, data, sets, eps=1e-4, nperm_nes=40).toPandas()
    b = enrich.run_gsea(spark, data, sets, eps=1e-4, nperm_nes=40, spread=True).toPandas()
    assert a["pathway"].tolist() == b["pathway"].tolist()
    for c in ("es", "nes", "pval", "padj"):
        assert np.allclose(a[c], b[c], rtol=1e-12)
    assert enrich.parameters(enrich.run_gsea(spark, data, sets, eps=1e-2, nperm_nes=4, spread=True))["spread"] == "True"


def test_pooled_calibration(spark):
    rows = [(k % 4, f"p{k}", (k + 0.5) / 200) for k in range(200)]
    got = replicates.pooled_calibration(spark.createDataFrame(rows, "replicate int, pathway string, pval double")).first()
    assert (got["replicates"], got["n"]) == (4, 200) and got["ks"] == pytest.approx(0.0025) and got["below_05"] == pytest.approx(0.05)


def test_lists_of_queries_are_ranked_by_all_tasks(spark):
    """No task holds the whole list to rank it."""
    listed = queries.ranks(spark, "/root/testdata/sf0.001")
    assert "SinglePartition" not in listed._jdf.queryExecution().executedPlan().toString()
