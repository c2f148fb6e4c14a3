"""Enrichment scores of the lists of consecutive windows, whose genes keep their scores from window to window but for those that a step moves.

A gene's runs of windows are dealt to blocks of windows, so what is shuffled is a row for each run and one for each gene and block, not one for each gene and window. In a block the
order of the genes is kept from window to window: the moved ones are taken out and put in anew. A task holds one list, at numbers only (about 60 bytes a gene and a membership).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks that the windows of a trajectory are dealt to, at most.
BLOCKS = 32

_FOUND = pa.schema([("window_id", pa.int32()), ("id", pa.int32()), ("size", pa.int32()), ("es", pa.float64())])


def first_extreme(rank: np.ndarray, weight: np.ndarray, n: int) -> float:
    """enrichment.enrichment() of one set, of its members' rising ranks (from 0) and their weights in a list of n."""
    m = len(rank)
    risen = np.cumsum(weight)
    if m >= n or not risen[-1] > 0:
        return 0.0
    misses = (rank - np.arange(m)) / (n - m)
    both = np.empty(2 * m)
    both[::2] = (risen - weight) / risen[-1] - misses
    both[1::2] = risen / risen[-1] - misses
    return float(both[np.argmax(np.round(np.abs(both), 12))])


class Ordered:
    """Genes 0 to n - 1 by falling score, then number, of which some are moved at a time; ids are the sets of each."""

    def __init__(self, score: np.ndarray, ids: pa.Array, power: float) -> None:
        self.power = power
        self.order = np.argsort(-score, kind="stable").astype(np.int32)
        self.low = -score[self.order]
        self.held = np.nan_to_num(ids.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int32)
        self.first = (np.cumsum(self.held, dtype=np.int64) - self.held).astype(np.int64)
        label = ids.flatten().to_numpy(zero_copy_only=False)
        self.names, label = np.unique(label, return_inverse=True)
        self.label = label.astype(np.uint16 if len(self.names) <= 1 << 16 else np.int32)  # 16-bit numbers sort by radix
        self.ends = np.cumsum(np.bincount(label, minlength=len(self.names)))

    def move(self, genes: np.ndarray, score: np.ndarray) -> None:
        """Give genes new scores."""
        stays = np.ones(len(self.order), bool)
        stays[genes] = False
        kept = stays[self.order]
        order, low = self.order[kept], self.low[kept]
        by = np.lexsort((genes, -score))
        genes, new = genes[by], -score[by]
        at, end = np.searchsorted(low, new, "left"), np.searchsorted(low, new, "right")
        for i in np.flatnonzero(at < end):  # among equal scores by number
            at[i] += np.searchsorted(order[at[i] : end[i]], genes[i])
        self.order, self.low = np.insert(order, at, genes), np.insert(low, at, new)

    def scores(self) -> np.ndarray:
        """The score of each set of names."""
        member = np.flatnonzero(self.held[self.order])
        gene = self.order[member]
        times = self.held[gene]
        pairs = np.repeat(self.first[gene] - (np.cumsum(times) - times), times) + np.arange(len(self.label))
        rank = np.repeat(member, times)
        by = np.argsort(self.label[pairs], kind="stable")
        rank = rank[by]
        weight = np.ones(len(rank)) if self.power == 0 else np.abs(self.low[rank])
        if self.power != 0 and abs(self.power - 1) >= 1e-6:
            weight = weight**self.power
        return np.array([first_extreme(rank[a:b], weight[a:b], len(self.order)) for a, b in zip(np.r_[0, self.ends[:-1]], self.ends, strict=True)])


def _by_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each window together, from rows sorted by window (the first column)."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        at = batch.column(0).to_numpy()
        cuts = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1, len(at)] if len(at) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and at[a] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = at[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _block_scores(batches: Iterator[pa.RecordBatch], width: int, count: int, power: float) -> Iterator[pa.RecordBatch]:
    lists, at = None, 0

    def until(end: int) -> Iterator[pa.RecordBatch]:
        """Scores of the windows from `at` on, whose lists are alike."""
        es = lists.scores()
        for w in range(at, end):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(es), w, np.int32)), pa.array(lists.names.astype(np.int32)), pa.array(np.diff(lists.ends, prepend=0).astype(np.int32)), pa.array(es)], schema=_FOUND)

    for rows in _by_window(batches):
        window = rows.column(0)[0].as_py()
        gene, score = rows.column(1).to_numpy(), rows.column(2).to_numpy()
        begins = window % width == 0
        if lists is not None:
            yield from until(min(count, at - at % width + width) if begins else window)
        if begins:  # a row for each gene
            by = np.argsort(gene)
            lists = Ordered(score[by], rows.column(3).combine_chunks().take(pa.array(by)), power)
        else:
            lists.move(gene, score)
        at = window
    if lists is not None:
        yield from until(min(count, at - at % width + width))


def block_rows(runs: DataFrame, width: int) -> DataFrame:
    """(at, place, score, ids) of runs (place, low, high, score, ids): a gene's score from window `at` on, in each block of `width` windows that the run meets; ids at a block's beginning only."""
    blocks = F.sequence(F.floor(F.col("low") / width).cast("int"), F.floor(F.col("high") / width).cast("int"))
    met = runs.select(F.explode(blocks).alias("block"), "low", "place", "score", "ids").withColumn("at", F.greatest("low", F.col("block") * width))
    return met.select("at", "place", "score", F.when(F.col("at") == F.col("block") * width, F.col("ids")).alias("ids"))


def run_enrichment(runs: DataFrame, count: int, power: float = 1.0) -> DataFrame:
    """(window_id, id, size, es) of the `count` windows, from runs (place int, low, high, score, ids) of every gene, numbered in its order by place; ids are the numbers of a gene's sets, or null."""
    width = -(-count // BLOCKS)
    rows = block_rows(runs, width)
    dealt = rows.repartition(2 * BLOCKS, F.floor(F.col("at") / width)).sortWithinPartitions("at")
    return dealt.mapInArrow(lambda batches: _block_scores(batches, width, count, power), "window_id int, id int, size int, es double")
