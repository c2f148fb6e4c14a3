"""Exact nearest neighbours of many points, and the leading eigenvectors of a sparse symmetric matrix, as joins.

Points are put to the nearest of at most PIVOTS pivots. A point's neighbours in its own block bound the distance of all its neighbours; another block is searched
only if it can hold a nearer point, by its radius and by the plane between the two pivots. Blocks are compared in chunks of at most about CHUNK
points and CHUNK queries, so no task holds a whole block, and equal points in any number are no burden.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.sources.steps import Steps

#: Points for each pivot, and pivots at most: their places go to every task.
BLOCK, PIVOTS = 1000, 2048
#: Points that a task compares with as many.
CHUNK = 2000

_FOUND = "id long, neighbour long, square double"


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(a, b): squared distances of rows."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def _rows(x: pd.Series) -> np.ndarray:
    return np.array(x.tolist(), float).reshape(len(x), -1)


def _least(ids: np.ndarray, near: np.ndarray, own: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """Of each query (a row of near) the k nearest ids, ties by id, without the query itself."""
    out = []
    near = np.where(own[:, None] == ids[None], np.inf, near)
    for q, d in zip(own.tolist(), near, strict=True):
        m = min(k, len(d))
        bound = np.partition(d, m - 1)[m - 1]
        at = np.flatnonzero(d <= bound) if np.isfinite(bound) else np.flatnonzero(np.isfinite(d))
        at = at[np.lexsort((ids[at], d[at]))][:m]
        out += [(q, int(ids[i]), float(d[i])) for i in at]
    return out


def _searched(queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(id, neighbour, square) of queries (block, part, id, x) against targets (block, chunk, id, x), chunk by chunk; at most k for each query and chunk."""
    chunks = targets.select("block", "chunk").distinct()
    parts = queries.select("block", "part").distinct()
    pairs = parts.join(chunks, "block")
    asked = queries.join(pairs, ["block", "part"]).select("block", "part", "chunk", F.lit(True).alias("asks"), "id", "x")
    there = targets.join(pairs, ["block", "chunk"]).select("block", "part", "chunk", F.lit(False).alias("asks"), "id", "x")

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["asks"].to_numpy(bool)
        q, t = rows[asks], rows[~asks]
        if not len(q) or not len(t):
            return pd.DataFrame([], columns=["id", "neighbour", "square"])
        found = _least(t["id"].to_numpy(), squares(_rows(q["x"]), _rows(t["x"])), q["id"].to_numpy(), k)
        return pd.DataFrame(found, columns=["id", "neighbour", "square"])

    return asked.unionByName(there).groupBy("block", "part", "chunk").applyInPandas(search, _FOUND)


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """(id, near): the k nearest (square, neighbour) of all that were found, nearest first."""
    return found.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("square", "neighbour"))), 1, k).alias("near"))


def nearest(points: DataFrame, k: int, steps: Steps, block: int = BLOCK, pivots: int = PIVOTS, chunk: int = CHUNK) -> DataFrame:
    """(id, neighbour, square): the k nearest other points of each point (id, x), by distance and then id; fewer where there are no more points."""
    points = steps.kept(points.select(F.col("id").cast("long").alias("id"), "x"))
    n = points.count()
    wanted = max(1, min(pivots, -(-n // block)))
    centres = np.array([r["x"] for r in points.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()], float)
    if n < 2 or k < 1:
        return points.select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("square")).where("false")

    def place(batches):
        for rows in batches:
            x = _rows(rows["x"])
            away = squares(x, centres)
            own = away.argmin(1)
            yield rows.assign(block=own.astype(np.int32), away=np.sqrt(away[np.arange(len(x)), own]))[["id", "x", "block", "away"]]

    placed = steps.kept(points.mapInPandas(place, "id long, x array<double>, block int, away double"))
    # one row for each pivot
    sizes = {r["block"]: (r["n"], r["radius"]) for r in placed.groupBy("block").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
    radius = np.array([sizes.get(b, (0, -np.inf))[1] for b in range(len(centres))])

    def share(counts: dict[int, int]):
        return F.pmod(F.xxhash64("id"), F.get(F.array(*[F.lit(max(1, -(-counts.get(b, 0) // chunk))) for b in range(len(centres))]), F.col("block"))).cast("int")

    targets = placed.withColumn("chunk", share({b: s for b, (s, _) in sizes.items()}))
    own = steps.kept(_nearest(_searched(targets.withColumnRenamed("chunk", "part"), targets, k), k))
    reach = placed.join(own, "id", "left").select("id", "x", "block", F.when(F.size("near") >= k, F.sqrt(F.col("near")[k - 1]["square"])).otherwise(float("inf")).alias("reach"))
    between = np.sqrt(squares(centres, centres))

    def spread(batches):
        for rows in batches:
            x, b = _rows(rows["x"]), rows["block"].to_numpy()
            away = squares(x, centres)
            here = away[np.arange(len(x)), b][:, None]
            plane = (away - here) / np.maximum(2 * between[b], 1e-300)
            least = np.maximum(np.sqrt(away) - radius[None], np.where(between[b] > 0, plane, 0))
            # what rounding may hide is searched too
            open_ = (least <= rows["reach"].to_numpy()[:, None] * (1 + 1e-9) + 1e-9) & (np.arange(len(centres)) != b[:, None]) & np.isfinite(radius)[None]
            at, other = np.nonzero(open_)
            if len(at):
                yield pd.DataFrame({"id": rows["id"].to_numpy()[at], "x": [rows["x"].iloc[i] for i in at], "block": other.astype(np.int32)})

    asked = steps.kept(reach.mapInPandas(spread, "id long, x array<double>, block int"))
    counts = {r["block"]: r["count"] for r in asked.groupBy("block").count().collect()}
    others = _searched(asked.withColumn("part", share(counts)), targets, k)
    found = own.select("id", F.inline("near")).select("id", "neighbour", "square").unionByName(others)
    return _nearest(found, k).select("id", F.inline("near")).select("id", "neighbour", "square")


def _columns(m: int) -> list[str]:
    return [f"v{c}" for c in range(m)]


def _product(edges: DataFrame, vectors: DataFrame, m: int) -> DataFrame:
    """(i, v0, ...): the matrix of edges (i, j, w) times vectors (i, v0, ...)."""
    return edges.join(vectors.withColumnRenamed("i", "j"), "j").groupBy("i").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in _columns(m)])


def _gram(a: DataFrame, b: DataFrame, m: int) -> np.ndarray:
    """(m, m): inner products of the columns of two sets of vectors."""
    right = b.select("i", *[F.col(c).alias(f"b_{c}") for c in _columns(m)])
    sums = a.join(right, "i").agg(*[F.sum(F.col(x) * F.col(f"b_{y}")).alias(f"{x}_{y}") for x in _columns(m) for y in _columns(m)]).first()
    return np.array([0.0 if s is None else s for s in sums], float).reshape(m, m)


def _mixed(vectors: DataFrame, by: np.ndarray) -> DataFrame:
    """The vectors times a small matrix."""
    sums = [sum((F.col(f"v{r}") * float(by[r, c]) for r in range(by.shape[0])), F.lit(0.0)).alias(f"v{c}") for c in range(by.shape[1])]
    return vectors.select("i", *sums)


def _orthonormal(vectors: DataFrame, m: int) -> DataFrame:
    values, q = np.linalg.eigh(_gram(vectors, vectors, m))
    return _mixed(vectors, q / np.sqrt(np.maximum(values, 1e-12 * values.max())))


def leading(edges: DataFrame, start: DataFrame, m: int, steps: Steps, rounds: int = 3, degree: int = 8) -> tuple[np.ndarray, DataFrame]:
    """The m values, falling, and vectors (i, v0, ...) of the largest eigenvalues of a symmetric matrix of edges (i, j, w) whose eigenvalues are between -1 and 1.

    Subspace iteration from the vectors start, with Chebyshev polynomials that damp all below the least of the m values; inner products of m vectors are all that reaches the driver.
    """
    now = steps.kept(_orthonormal(start, m))
    for _ in range(rounds):
        image = steps.kept(_product(edges, now, m))
        values, q = np.linalg.eigh(_gram(now, image, m))
        low = float(np.clip(values.min(), -0.9, 0.999))
        centre, half = (low - 1) / 2, (low + 1) / 2
        before, now = now, steps.kept(_joined(image, now, m, 1 / half, -centre / half, None, 0.0))
        for _ in range(degree - 1):
            after = steps.kept(_joined(_product(edges, now, m), now, m, 2 / half, -2 * centre / half, before, -1.0))
            before, now = now, after
        now = steps.kept(_orthonormal(now, m))
    image = steps.kept(_product(edges, now, m))
    values, q = np.linalg.eigh(_gram(now, image, m))
    order = np.argsort(values)[::-1]
    return values[order], steps.kept(_mixed(now, q[:, order]))


def _joined(a: DataFrame, b: DataFrame, m: int, wa: float, wb: float, c: DataFrame | None, wc: float) -> DataFrame:
    """wa * a + wb * b + wc * c of vectors."""
    rows = a.join(b.select("i", *[F.col(x).alias(f"b_{x}") for x in _columns(m)]), "i")
    if c is not None:
        rows = rows.join(c.select("i", *[F.col(x).alias(f"c_{x}") for x in _columns(m)]), "i")
    return rows.select("i", *[(wa * F.col(x) + wb * F.col(f"b_{x}") + (wc * F.col(f"c_{x}") if c is not None else F.lit(0.0))).alias(x) for x in _columns(m)])
