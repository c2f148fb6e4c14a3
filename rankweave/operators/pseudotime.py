"""Diffusion pseudotime of cells: variable genes, PCA, nearest neighbours, diffusion map, distance from a root.

The diffusion map is that of at most LANDMARKS cells, chosen by a hash of their ids, with the root among them. Other cells are placed in it in tasks, by the mean of
their nearest landmarks' places under the same kernel (Nystroem's extension). So the driver holds a matrix of bounded size, and time is linear in the cells; with no more
cells than landmarks the map is the exact one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.operators.neighbours import leading, nearest
from rankweave.operators.prep import finite
from rankweave.operators.trajectory import positions
from rankweave.sources.steps import Steps, shared_folder

#: Cells whose neighbour graph is put to the eigensolver on the driver.
LANDMARKS = 2000


def variable_genes(expression: DataFrame, n_cells: int, top: int = 2000, bins: int = 20) -> DataFrame:
    """(gene, dispersion): the `top` genes of largest normalised dispersion over all cells, absent values being 0.

    The logarithm of variance over mean, less the mean of its bin and over its deviation; bins cut the range of log1p(mean) evenly. A gene alone in its bin has 1. Ties (to 9 digits) go by variance. Genes without a
    positive mean and variance have no dispersion and come last, by variance.
    """
    sums = expression.where(finite(F.col("value"))).groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    mean, square = F.col("s") / n_cells, F.col("q") / n_cells
    shape = sums.select("gene", mean.alias("mean"), ((square - mean * mean) * n_cells / max(1, n_cells - 1)).alias("variance"))
    known = (F.col("mean") > 0) & (F.col("variance") > 0)
    shape = shape.select("gene", "variance", F.when(known, F.log(F.col("variance") / F.col("mean"))).alias("d"), F.when(known, F.log1p("mean")).alias("m"))
    ends = shape.agg(F.min("m").alias("low"), F.max("m").alias("high"))
    place = F.when(F.col("high") > F.col("low"), F.ceil((F.col("m") - F.col("low")) / (F.col("high") - F.col("low")) * bins)).otherwise(F.lit(1))
    binned = shape.crossJoin(F.broadcast(ends)).withColumn("bin", F.greatest(F.lit(1), F.least(F.lit(bins), place)))
    each = binned.where("d is not null").groupBy("bin").agg(F.avg("d").alias("centre"), F.stddev_samp("d").alias("sd"))
    # at most `bins` rows
    met = binned.join(F.broadcast(each), "bin", "left")
    value = F.when(F.col("sd").isNull(), F.when(F.col("d").isNotNull(), 1.0)).when(F.col("sd") > 0, (F.col("d") - F.col("centre")) / F.col("sd")).otherwise(0.0)
    return met.select("gene", value.alias("dispersion"), "variance").orderBy(F.round("dispersion", 9).desc_nulls_last(), F.desc("variance"), "gene").limit(top).select("gene", "dispersion")


#: Vectors of a sketch beyond the axes that are asked for, and passes over the cells.
EXTRA, PASSES = 10, 4


def _components(expression: DataFrame, genes: list[str], n_pcs: int, n_cells: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Means and principal axes of the cells, by a randomised range finder.

    Each pass sends a sketch (genes x (n_pcs + EXTRA) numbers) to the tasks, which multiply their cells by it and back; Spark adds up the tasks' sketches by gene, and one sketch reaches
    the driver. Absent values, and cells without values, are 0.
    """
    index = {g: i for i, g in enumerate(genes)}
    k, wide = len(genes), min(len(genes), n_pcs + EXTRA)
    number = F.broadcast(expression.sparkSession.createDataFrame(list(index.items()), "gene string, g int"))
    cells = expression.where(finite(F.col("value"))).join(number, "gene").groupBy("cell_id").agg(F.collect_list(F.struct("g", "value")).alias("pairs")).persist()
    mean = np.zeros(k)
    for r in cells.select(F.inline("pairs")).groupBy("g").agg(F.sum("value").alias("s")).collect():
        mean[r["g"]] = r["s"] / max(1, n_cells)
    names = [f"c{j}" for j in range(wide)]

    def multiplied(q: np.ndarray) -> np.ndarray:
        """The covariance times q."""

        def partial(batches):
            total = np.zeros((k, wide))
            for rows in batches:
                sizes = rows["pairs"].map(len).to_numpy()
                at = np.array([p["g"] for pairs in rows["pairs"] for p in pairs], int)
                value = np.array([p["value"] for pairs in rows["pairs"] for p in pairs], float)
                owner = np.repeat(np.arange(len(rows)), sizes)
                seen = np.zeros((len(rows), wide))
                np.add.at(seen, owner, value[:, None] * q[at])
                np.add.at(total, at, value[:, None] * seen[owner])
            yield pd.DataFrame(total, columns=names).assign(g=np.arange(k))[["g", *names]]

        rows = cells.select("pairs").mapInPandas(partial, "g int, " + ", ".join(f"{c} double" for c in names)).groupBy("g").agg(*[F.sum(c).alias(c) for c in names]).collect()
        made = np.zeros((k, wide))
        for r in rows:
            made[r["g"]] = r[1:]
        return made / max(1, n_cells) - np.outer(mean, mean @ q)

    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, wide)))[0]
    for _ in range(PASSES - 1):
        q = np.linalg.qr(multiplied(q))[0]
    inner = q.T @ multiplied(q)
    cells.unpersist()
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    return mean, q @ vectors[:, np.argsort(values)[::-1][:n_pcs]]


def _exact_away(placed: DataFrame, rough: DataFrame, root_cell: str, neighbours: int, components: int, steps: Steps) -> DataFrame:
    """(cell_id, __away): distances from the root in the diffusion map of the neighbour graph of all cells. rough: (cell_id, v1, ...), the places to start from."""
    numbered = steps.kept(positions(placed, ["cell_id"], "id"))
    found = steps.kept(nearest(numbered, neighbours, steps))
    scale = found.groupBy("id").agg((F.sqrt(F.max("square")) + 1e-12).alias("scale"))
    both = found.join(scale, "id").join(scale.select(F.col("id").alias("neighbour"), F.col("scale").alias("other")), "neighbour")
    weight = F.exp(-F.col("square") / (F.col("scale") * F.col("other")))
    one = both.select(F.col("id").alias("i"), F.col("neighbour").alias("j"), weight.alias("w"))
    graph = steps.kept(one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg(F.max("w").alias("w")))

    def divided(edges: DataFrame, sums: DataFrame) -> DataFrame:
        return edges.join(sums, "i").join(sums.select(F.col("i").alias("j"), F.col("s").alias("t")), "j").select("i", "j", (F.col("w") / (F.col("s") * F.col("t"))).alias("w"))

    degree = graph.groupBy("i").agg((F.sum("w") + 1e-12).alias("s"))
    graph = steps.kept(divided(graph, steps.kept(degree)))
    norm = steps.kept(graph.groupBy("i").agg(F.sqrt(F.sum("w") + 1e-300).alias("s")))
    graph = steps.kept(divided(graph, norm))
    m = components + 1
    begun = numbered.select(F.col("id").alias("i"), "cell_id").join(rough, "cell_id").join(norm, "i").select("i", F.col("s").alias("v0"), *[(F.col(f"v{c}") * F.col("s")).alias(f"v{c}") for c in range(1, m)])
    values, vectors = leading(graph, begun, m, steps)
    values = np.clip(values[1:], -1 + 1e-9, 1 - 1e-9)
    places = vectors.join(norm, "i").select("i", *[(F.col(f"v{c}") / F.col("s") * float(values[c - 1] / (1 - values[c - 1]))).alias(f"p{c}") for c in range(1, m)])
    places = places.join(numbered.select(F.col("id").alias("i"), "cell_id"), "i")
    root = places.where(F.col("cell_id") == root_cell).first()
    square = sum(((F.col(f"p{c}") - float(root[f"p{c}"])) ** 2 for c in range(1, m)), F.lit(0.0))
    return places.select("cell_id", F.sqrt(square).alias("__away"))


def with_pseudotime(expression: DataFrame, cells: DataFrame, key: str = "pseudotime", root_gene: str | None = None, root_cell: str | None = None, top_genes: int = 2000, n_pcs: int = 30, neighbours: int = 15, landmarks: int = LANDMARKS, all_cells: bool = False) -> DataFrame:
    """cells with a pseudotime column from 0 (root) to 1: the root is the given cell, else the cell of largest root gene, else the first cell id.

    all_cells makes the neighbour graph and diffusion map of all cells, by joins, however many they are; the landmarks' map is where it starts.
    """
    spark = cells.sparkSession
    n = cells.count()
    genes = sorted(r[0] for r in variable_genes(expression, n, top_genes).collect()) if n else []
    if not genes:
        return cells.withColumn(key, F.lit(None).cast("double"))
    mean, axes = _components(expression, genes, min(n_pcs, len(genes)), n)
    loads = spark.createDataFrame([(g, [float(v) for v in axes[i]]) for i, g in enumerate(genes)], "gene string, axis array<double>")
    base = [float(v) for v in mean @ axes]
    parts = expression.join(F.broadcast(loads), "gene").select("cell_id", F.posexplode(F.transform("axis", lambda a: a * F.col("value"))).alias("pc", "v"))
    summed = parts.groupBy("cell_id", "pc").agg(F.sum("v").alias("v")).groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pc", "v"))), lambda x: x["v"]).alias("x"))
    found = cells.select(F.col("cell_id").cast("string").alias("cell_id")).distinct().join(summed, "cell_id", "left")
    placed = found.select("cell_id", F.coalesce("x", F.array(*[F.lit(0.0)] * len(base))).alias("x")).persist()
    if root_cell is None and root_gene is not None:
        top = expression.where(F.col("gene") == root_gene).orderBy(F.desc("value"), "cell_id").first()
        root_cell = top["cell_id"] if top else None
    if root_cell is None or placed.where(F.col("cell_id") == str(root_cell)).isEmpty():
        root_cell = placed.agg(F.min("cell_id")).first()[0]
    root_cell = str(root_cell)
    chosen = placed.orderBy(F.col("cell_id") != root_cell, F.xxhash64("cell_id"), "cell_id").limit(landmarks).toPandas().sort_values("cell_id").reset_index(drop=True)
    x = np.array(chosen["x"].tolist()) - np.array(base)
    map_ = DiffusionMap(x, neighbours)
    own = dict(zip(chosen["cell_id"], map_.distances(int(chosen.index[chosen["cell_id"] == root_cell][0])).tolist(), strict=True))
    start = map_.places[int(chosen.index[chosen["cell_id"] == root_cell][0])]

    def timed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            away = np.sqrt(((map_.extended(np.array(rows["x"].tolist()).reshape(len(rows), -1) - np.array(base)) - start) ** 2).sum(1)) if len(rows) else np.zeros(0)
            yield pd.DataFrame({"cell_id": rows["cell_id"], "__away": [own.get(c, d) for c, d in zip(rows["cell_id"], away.tolist(), strict=True)]})

    away = placed.mapInPandas(timed, "cell_id string, __away double")
    if all_cells and n > 2:
        shape = map_.places.shape[1]

        def roughly(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                v = map_.extended(np.array(rows["x"].tolist()).reshape(len(rows), -1) - np.array(base)) / (map_.values / (1 - map_.values))
                yield pd.concat([rows[["cell_id"]].reset_index(drop=True), pd.DataFrame(v, columns=[f"v{c}" for c in range(1, shape + 1)])], axis=1)

        with Steps(spark) as steps:
            rough = placed.mapInPandas(roughly, "cell_id string, " + ", ".join(f"v{c} double" for c in range(1, shape + 1)))
            path = shared_folder(spark)
            _exact_away(placed, rough, root_cell, min(neighbours, n - 1), shape, steps).write.parquet(path)
        away = spark.read.schema("cell_id string, __away double").parquet(path)
    most = away.agg(F.max("__away")).first()[0] or 0.0
    times = away.select("cell_id", (F.col("__away") / F.lit(most if most > 0 else 1.0)).alias(key))
    placed.unpersist()
    return cells.drop(key).withColumn("cell_id", F.col("cell_id").cast("string")).join(times, "cell_id")


class DiffusionMap:
    """The diffusion map of the nearest-neighbour graph of some points; `places` are the points' coordinates in it."""

    def __init__(self, x: np.ndarray, neighbours: int = 15, components: int = 10) -> None:
        n = len(x)
        self.x, self.k = x, min(neighbours, n - 1)
        self.places = np.zeros((n, 1))
        if self.k < 1:
            return
        near, far = self._nearest(x, self.k, True)
        self.scale = np.sqrt(far.max(1)) + 1e-12
        rows = np.repeat(np.arange(n), self.k)
        graph = np.zeros((n, n))
        graph[rows, near.ravel()] = np.exp(-far.ravel() / (self.scale[rows] * self.scale[near.ravel()]))
        graph = np.maximum(graph, graph.T)
        self.degree = graph.sum(1) + 1e-12
        graph /= np.outer(self.degree, self.degree)
        norm = np.sqrt(graph.sum(1) + 1e-300)
        values, vectors = np.linalg.eigh(graph / np.outer(norm, norm))
        order = np.argsort(values)[::-1][1 : components + 1]
        self.values = np.clip(values[order], -1 + 1e-9, 1 - 1e-9)
        self.places = vectors[:, order] / norm[:, None] * (self.values / (1 - self.values))

    def _nearest(self, x: np.ndarray, k: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest points of each row and their squared distances, without the row itself if it is one of the points."""
        near, far = np.zeros((len(x), k), int), np.zeros((len(x), k))
        square = (self.x * self.x).sum(1)
        for a in range(0, len(x), 1024):
            part = x[a : a + 1024]
            d = (part * part).sum(1)[:, None] + square[None] - 2 * part @ self.x.T
            if own:
                d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            near[a : a + 1024] = np.argpartition(d, k - 1, 1)[:, :k]
            far[a : a + 1024] = np.take_along_axis(d, near[a : a + 1024], 1)
        return near, np.maximum(far, 0)

    def extended(self, x: np.ndarray) -> np.ndarray:
        """Places of other points: means of their nearest points' places by the kernel, over the eigenvalues."""
        if self.k < 1 or not len(x):
            return np.zeros((len(x), self.places.shape[1]))
        near, far = self._nearest(x, self.k, False)
        scale = np.sqrt(far.max(1)) + 1e-12
        weight = np.exp(-far / (scale[:, None] * self.scale[near])) / self.degree[near]
        weight /= weight.sum(1, keepdims=True) + 1e-300
        value = np.where(np.abs(self.values) > 1e-6, self.values, 1.0)
        return np.einsum("ij,ijk->ik", weight, self.places[near]) / value

    def distances(self, root: int) -> np.ndarray:
        """Distances of the points from one of them."""
        return np.sqrt(((self.places - self.places[root]) ** 2).sum(1))


def diffusion_times(x: np.ndarray, root: int, neighbours: int = 15, components: int = 10) -> np.ndarray:
    """Distances from the root in a diffusion map of the nearest-neighbour graph, scaled to 0..1."""
    distance = DiffusionMap(x, neighbours, components).distances(root)
    return distance / distance.max() if len(distance) and distance.max() > 0 else distance
