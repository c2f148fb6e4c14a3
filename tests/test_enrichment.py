"""Enrichment scores against exact arithmetic, preparation, adjustment and Monte-Carlo operators."""

from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankweave.operators import adjust, analytics, enrichment, multilevel, null, prep
from rankweave.plans import enrich
from rankweave.sources import catalog as sources

FIVE = {"A": 2.5, "B": 1.8, "C": 0.5, "D": -0.2, "E": -1.5}


def exact(scores: list[int], hits: list[int]) -> Fraction:
    """The running sum walked place by place in rationals; the first largest deviation counts."""
    n, m = len(scores), len(hits)
    total = sum(abs(scores[h]) for h in hits)
    if m in (0, n) or total == 0:
        return Fraction(0)
    best = run = Fraction(0)
    for place in range(n):
        if place in hits:
            if abs(run) > abs(best):
                best = run
            run += Fraction(abs(scores[place]), total)
            if abs(run) > abs(best):
                best = run
        else:
            run -= Fraction(1, n - m)
    return best


def es_of(spark, data, named, power=1.0, low=1):
    ranks = prep.ranked(sources.scores_of(spark, data))
    met = prep.members(sources.catalog(spark, named), ranks, low, 10**6)
    return {r["pathway"]: (r["size"], r["es"]) for r in enrichment.enrichment(met, power).collect()}


def test_fixed_values(spark):
    sets = {"up": ["A", "B"], "down": ["D", "E"], "mid": ["B", "D"], "all": list("ABCDE"), "twice": ["B", "B", "D"]}
    got = es_of(spark, FIVE, sets)
    assert got["up"] == (2, pytest.approx(1.0)) and got["down"] == (2, pytest.approx(-1.0))
    assert got["mid"][1] == pytest.approx(0.5666666666666667) and got["all"][1] == 0 and got["twice"] == got["mid"]
    assert es_of(spark, FIVE, sets, 0.5)["mid"][1] == pytest.approx(0.4166666666666667)
    assert es_of(spark, FIVE, sets, 0.0)["mid"][1] == pytest.approx(-1 / 3)  # -1/3 and 1/3 tie: the first counts


def test_against_exact_arithmetic(spark):
    rng = np.random.default_rng(5)
    rows, sets, want = [], [], {}
    for k in range(60):
        n = int(rng.integers(4, 30))
        scores = sorted((int(x) for x in rng.choice(np.arange(-60, 60), n, replace=False)), reverse=True)
        hits = sorted(int(x) for x in rng.choice(n, int(rng.integers(1, n)), replace=False))
        rows += [(k, f"{k}:{i:02d}", float(s)) for i, s in enumerate(scores)]
        sets += [(f"p{k}", f"{k}:{i:02d}") for i in hits]
        want[f"p{k}"] = float(exact(scores, hits))
    ranks = prep.ranked(spark.createDataFrame(rows, "list int, gene string, score double"), ["list"])
    met = prep.members(spark.createDataFrame(sets, "pathway string, gene string"), ranks, 1, 100, ["list"])
    got = {r["pathway"]: r["es"] for r in enrichment.enrichment(met, 1.0, ["list"]).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=3, max_size=25, unique=True), st.data())
def test_numpy_scores_match_exact(scores, data):
    scores = sorted(scores, reverse=True)
    hits = sorted(data.draw(st.sets(st.integers(0, len(scores) - 1), min_size=1, max_size=len(scores) - 1)))
    got = null.scores_of_sets(np.abs(np.array(scores, float)), np.array([hits]))[0]
    assert abs(got) == pytest.approx(abs(float(exact(scores, hits))), abs=1e-9)


def test_scale_and_mirror(spark):
    rng = np.random.default_rng(1)
    data = {f"g{i:03d}": float(x) for i, x in enumerate(rng.normal(size=100))}
    named = {"s": [f"g{i:03d}" for i in range(0, 40, 2)]}
    base = es_of(spark, data, named)["s"][1]
    assert es_of(spark, {k: 7 * v for k, v in data.items()}, named)["s"][1] == pytest.approx(base)
    assert es_of(spark, {k: -v for k, v in data.items()}, named)["s"][1] == pytest.approx(-base)


def test_size_limits_are_inclusive(spark):
    data = pd.Series(np.random.default_rng(0).normal(size=100), index=[f"G{i}" for i in range(100)])
    sets = {str(k): [f"G{i}" for i in range(k)] for k in (14, 15, 20, 21)}
    out = enrich.run_gsea(spark, data, sets, min_size=15, max_size=20, nperm_nes=50)
    assert out.columns == enrich.COLUMNS and sorted(r["pathway"] for r in out.collect()) == ["15", "20"]


def test_degenerate_inputs(spark):
    flat = pd.Series(np.zeros(100), index=[f"G{i}" for i in range(100)])
    row = enrich.run_gsea(spark, flat, {"s": [f"G{i}" for i in range(20)]}, nperm_nes=20).first()
    assert row["es"] == 0 and row["pval"] == 1 and row["nes"] == 0
    none = enrich.run_gsea(spark, flat, {"s": ["nobody"]})
    assert none.columns == enrich.COLUMNS and none.count() == 0
    two = enrich.run_gsea(spark, pd.DataFrame({"a": ["x", "y"], "b": [1.0, -1.0]}), {"s": ["x"]}, min_size=1, nperm_nes=10).collect()
    assert len(two) == 1


def test_dedup_and_ranks(spark):
    rows = spark.createDataFrame([("a", 1.0, 1), ("a", -3.0, 2), ("b", 2.0, 3), ("b", -2.0, 4), ("c", float("nan"), 5)], "gene string, score double, at int")
    assert {r["gene"]: r["score"] for r in prep.deduplicated(rows).where("gene <> 'c'").collect()} == {"a": -3.0, "b": 2.0}
    assert {r["gene"]: r["score"] for r in prep.deduplicated(rows, "first", order="at").where("gene <> 'c'").collect()} == {"a": 1.0, "b": 2.0}
    assert prep.deduplicated(rows, "none").count() == 5
    with pytest.raises(ValueError):
        prep.deduplicated(rows, "first")
    ranked = prep.ranked(rows)
    assert [(r["gene"], r["score"]) for r in ranked.orderBy("rnk").collect()] == [("b", 2.0), ("a", 1.0), ("b", -2.0), ("a", -3.0)]


def test_bh(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.03), ("d", 0.5)], "pathway string, pval double")
    got = {r["pathway"]: r["padj"] for r in adjust.bh(rows).collect()}
    assert got == {"a": pytest.approx(0.04), "b": pytest.approx(0.04), "c": pytest.approx(0.04), "d": pytest.approx(0.5)}


def test_gmt_round_trip(spark, tmp_path):
    path = tmp_path / "x.gmt"
    path.write_text("one\tnote\ta\tb\nshort\tnote\n two\tNA\tc\td \none\tlater\tz\n")
    got = {r["pathway"]: (r["description"], r["genes"]) for r in sources.read_gmt(spark, str(path)).collect()}
    assert got == {"one": ("later", ["z"]), "two": ("NA", ["c", "d"])}
    sources.write_gmt(sources.read_gmt(spark, str(path)), str(tmp_path / "out"))
    again = {r["pathway"]: r["genes"] for r in sources.read_gmt(spark, str(tmp_path / "out")).collect()}
    assert again == {k: v[1] for k, v in got.items()}


def normal_list(n=1000, seed=2):
    x = np.sort(np.random.default_rng(seed).normal(size=n))[::-1]
    return pd.Series(x, index=[f"G{i:04d}" for i in range(n)])


def test_same_seed_same_result_and_modes_agree(spark):
    data, sets = normal_list(), {"a": [f"G{i:04d}" for i in range(0, 60)], "b": [f"G{i:04d}" for i in range(300, 360)], "c": [f"G{i:04d}" for i in range(0, 1000, 11)]}
    a = enrich.run_gsea(spark, data, sets, seed=7, eps=1e-6, nperm_nes=100).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    b = enrich.run_gsea(spark, data, sets, seed=7, eps=1e-6, nperm_nes=100).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    pd.testing.assert_frame_equal(a, b)
    c = enrich.run_gsea(spark, data, sets, seed=7, eps=1e-6, nperm_nes=100, use_batched=False).toPandas()
    both = a.merge(c, on="pathway", suffixes=("", "_c"))
    assert np.allclose(both["es"], both["es_c"]) and np.allclose(both["nes"], both["nes_c"])
    assert ((a["pval"] >= 0) & (a["pval"] <= 1) & (a["padj"] >= a["pval"])).all()
    assert a.set_index("pathway").loc["a", "pval"] <= 1e-4


def test_splitting_agrees_with_plain_permutation():
    weights = np.abs(normal_list(500).to_numpy())
    drawn = np.abs(null.scores_of_sets(weights, null.random_hits(null.rng_of(1, "plain"), 500, 30, 40_000)))
    seen = float(np.quantile(drawn, 0.998))
    plain = float((drawn >= seen).mean())
    logs = []
    for k in range(12):
        curve = multilevel.tail_curve(weights, 30, 201, null.rng_of(k, "curve"), 1e-8, target=seen)
        level = min(sum(seen >= t for t in curve["thresholds"]), len(curve["populations"]) - 1)
        logs.append(np.exp(curve["log_probs"][level]) * np.mean(np.array(curve["populations"][level]) >= seen))
        assert all(np.diff(curve["thresholds"]) >= 0)
    chain = [multilevel.chain_p(weights, 30, seen, 201, null.rng_of(k, "chain"), 1e-8)[0] for k in range(12)]
    assert 0.4 < np.mean(logs) / plain < 2.5 and 0.4 < np.mean(chain) / plain < 2.5


def test_null_calibration():
    weights = np.abs(normal_list(800).to_numpy())
    rng = null.rng_of(3, "observed")
    observed = np.abs(null.scores_of_sets(weights, null.random_hits(rng, 800, 25, 300)))
    p = np.sort([multilevel.chain_p(weights, 25, float(x), 101, null.rng_of(3, i), 1e-6)[0] for i, x in enumerate(observed)])
    assert np.abs(np.arange(1, 301) / 300 - p).max() < 0.12


def test_background_is_partition_free_and_right(spark):
    ranks = prep.ranked(sources.scores_of(spark, normal_list(300)))
    sizes = spark.createDataFrame([(10,), (40,)], "size int")
    got = {r["size"]: (r["pos_mean"], r["neg_mean"]) for r in null.background(sizes, null.rank_weights(ranks, 1.0, []), 2000).collect()}
    hashed = {r["size"]: (r["pos_mean"], r["neg_mean"]) for r in null.means_of(null.hashed_background(ranks, sizes, 300)).collect()}
    for k in (10, 40):
        assert got[k][0] == pytest.approx(hashed[k][0], rel=0.15) and got[k][1] == pytest.approx(hashed[k][1], rel=0.15)


def test_size_key(spark):
    rows = spark.createDataFrame([(4,), (5,), (14,), (15,)], "size int")
    assert [r[0] for r in rows.orderBy("size").select(multilevel.size_key(F.col("size"), 10, F.lit(100))).collect()] == [10, 10, 10, 20]
    assert rows.where("size = 15").select(multilevel.size_key(F.col("size"), 10, F.lit(15))).first()[0] == 14
    with pytest.raises(ValueError):
        multilevel._checked(1, "two_sided_abs")
    with pytest.raises(ValueError):
        multilevel._checked(10, "other")


def test_t_distribution():
    assert analytics.t_cdf(2.228, 10) == pytest.approx(0.975, abs=1e-4) and analytics.t_cdf(0.0, 3) == pytest.approx(0.5)


@pytest.mark.parametrize("table", [10**9, 0])
@pytest.mark.parametrize(("two_sided", "sign"), [(True, 1), (False, 1), (False, -1)])
def test_walks_by_blocks_keep_the_moves_of_plain_walks(monkeypatch, two_sided, sign, table):
    """Blocks of one-sided scores too, with sets as a table and without."""
    monkeypatch.setattr(multilevel, "TABLE", table)
    rng = np.random.default_rng(3)
    for n, k in ((900, 310), (1000, 700)):
        weights = np.abs(rng.normal(size=n))
        hits = null.random_hits(rng, n, k, 60)
        metric = multilevel.metric_of(null.scores_of_sets(weights, hits), sign, two_sided)
        chosen = np.argsort(-metric)[:20]
        floor = float(metric[chosen[-1]])
        args = weights, hits[chosen], metric[chosen], floor, 30, sign, two_sided
        by_blocks = multilevel.walk(null.rng_of(5, n), *args)
        monkeypatch.setattr(multilevel, "BLOCKED", 10**9)
        plain = multilevel.walk(null.rng_of(5, n), *args)
        monkeypatch.undo()
        monkeypatch.setattr(multilevel, "TABLE", table)
        assert floor > 0 and 0 < plain[2] < 1 and by_blocks[2] == plain[2]
        assert (by_blocks[0] == plain[0]).all() and np.allclose(by_blocks[1], plain[1], rtol=1e-12)


@pytest.mark.parametrize("two_sided", [True, False])
def test_a_walk_holds_no_row_as_long_as_the_list(two_sided):
    import tracemalloc

    n, k, rows = 3_000_000, 400, 51
    weights = np.random.default_rng(1).random(n)
    hits = null.random_hits(null.rng_of(1), n, k, rows)
    metric = multilevel.metric_of(null.scores_of_sets(weights, hits), 1, two_sided)
    tracemalloc.start()
    multilevel.walk(null.rng_of(2), weights, hits, metric, 1e-3, 3, 1, two_sided)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


@pytest.mark.parametrize("k", [400, 2600])
@pytest.mark.parametrize("two_sided", [True, False])
def test_redrawn_walkers_are_sets_that_keep_to_the_floor(monkeypatch, two_sided, k):
    """Walkers whose sets aren't held have k members each after any walk, the metric that those sets score, and a floor that they keep to."""
    monkeypatch.setattr(multilevel, "HELD", 0)
    monkeypatch.setattr(multilevel, "CELLS", 5 * k)
    n, weights = 3000, np.random.default_rng(1).random(3000)
    rng = null.rng_of(1, "walkers")
    sets = multilevel.walkers(rng, weights, k, 24, 1, two_sided)
    metric = sets.metric()
    first = sets._hits(np.arange(24))
    assert len({tuple(x) for x in first}) == 24 and (np.diff(first) > 0).all() and first.min() >= 0 and first.max() < n
    for _ in range(3):
        order = np.argsort(-metric)
        floor = float(metric[order[11]])
        sets, metric, rate = sets.walked(rng, order[:12], order[rng.integers(0, 12, 12)], metric, floor, 40)
        hits = sets._hits(np.arange(24))
        assert 0 < rate < 1 and hits.shape == (24, k) and (np.diff(hits) > 0).all() and (metric >= floor - 1e-9).all()
        assert np.allclose(metric, multilevel.metric_of(null.scores_of_sets(weights, hits), 1, two_sided), rtol=1e-12)
    assert len({tuple(x) for x in hits}) > 12


@pytest.mark.parametrize("one_chain", [True, False])
def test_memory_of_walkers_does_not_grow_with_large_sets(one_chain):
    """1,001 sets of 20,000 ranks are 160 MB as numbers."""
    import tracemalloc

    weights = np.random.default_rng(1).random(120_000)
    tracemalloc.start()
    if one_chain:
        multilevel.chain_p(weights, 20_000, 1e-9, 1001, null.rng_of(1), 1.0, False)
    else:
        multilevel.tail_curve(weights, 20_000, 1001, null.rng_of(1), 1.0, 1, False, 1e-9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_no_row_to_the_samplers_holds_a_list(spark, monkeypatch):
    monkeypatch.setattr(null, "BLOCK", 16)
    listed = prep.ranked(spark.createDataFrame([(f"g{i:03d}", float(i - 40)) for i in range(100)], "gene string, score double"))
    units = spark.createDataFrame([(i,) for i in range(9)], "unit int")
    rows = null.shared(units, null.rank_weights(listed, 1.0, []), [])
    assert {len(r["weights"]) for r in rows.collect()} == {16, 4}

    def run(batches):
        for _, asked, w in null.by_list(batches, []):
            yield pd.DataFrame([(u, w.tolist()) for u in asked], columns=["unit", "w"])

    got = {r["unit"]: r["w"] for r in rows.mapInPandas(run, "unit int, w array<double>").collect()}
    assert got == {i: [abs(float(59 - j)) for j in range(100)] for i in range(9)}
