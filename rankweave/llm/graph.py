"""Connected components by alternating large-star and small-star steps; nothing is collected and no node's neighbours meet in one row.

Each round is a written table, and the round before goes. The least neighbours are written before they are joined where the graph is large: both sides
of the join are then plain shuffles, of which Spark splits the partition of a hub. What a task holds of a round's edges, at most about HELD_EDGES at a
time, is contracted there; once that many are left in all, one task contracts them, which ends the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import discard, release, written

#: Edges that a task holds before it contracts them (16 bytes each).
HELD_EDGES = 1_000_000

_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def labelled(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n numbers the smallest number that the links a-b reach from it."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        np.minimum.at(label, x, y)
        np.minimum.at(label, y, x)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def stars_of(edges: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """A star for each component of the edges: each node but the smallest, with the smallest."""
    u, v = (np.concatenate(x) for x in zip(*edges, strict=True)) if edges else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = labelled(len(names), at[: len(u)], at[len(u) :])
    far = np.flatnonzero(label != np.arange(len(names)))
    return pa.RecordBatch.from_arrays([pa.array(names[far], pa.int64()), pa.array(names[label[far]], pa.int64())], schema=_EDGES)


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges contracted within each task."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n > HELD_EDGES:
                yield stars_of(held)
                held, n = [], 0
        yield stars_of(held)

    return edges.select("u", "v").mapInArrow(contract, "u long, v long")


def _large_star(edges: DataFrame) -> list[DataFrame]:
    """The new edges, and the table of least neighbours that they are made with."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("__m")).select("u", F.least("u", "__m").alias("__m")), "least")
    return [both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("__m").alias("v")), least]


def _small_star(edges: DataFrame) -> list[DataFrame]:
    """As _large_star(); edges have u > v."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("__m")), "least")
    moved = edges.join(least, "u").where(F.col("v") != F.col("__m")).select(F.col("v").alias("u"), F.col("__m").alias("v"))
    return [moved.unionByName(least.select("u", F.col("__m").alias("v"))).where(F.col("u") != F.col("v")), least]


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node has two edges down, or edges both up and down: else all components are stars."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return not ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down = 1 and up = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (u, v), bigints; component is the smallest node reachable.

    Self-loops and repeated edges do no harm; an empty input gives an empty result.
    """
    now = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = written(_contracted(now), "edges")
    release(edges.sparkSession)
    while (n := now.count()) > HELD_EDGES and _unfinished(now):
        raised, least = _large_star(now)
        raised = written(_contracted(raised.distinct()), "edges")
        lowered, below = _small_star(raised)
        after = written(_contracted(lowered.distinct()), "edges")
        discard(now, least, raised, below)
        now = after
    if 0 < n <= HELD_EDGES:
        after = written(_contracted(now.repartition(1)), "edges")
        discard(now)
        now = after
    release(edges.sparkSession)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
