"""Tail probabilities by multilevel splitting: shared curves for set sizes, or a chain for each set.

A unit of work (a size and sign of a list, or one set of it) comes with the list's weights by rank. Walkers are
moved together in numpy; generators depend on the seed and the unit, so results don't depend on partitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.operators.null import by_list, random_hits, rng_of, scores_of_sets, shared

SCORE_TYPES = ("two_sided_abs", "one_sided_signed")
MAX_LEVELS = 2000
TINY = 1e-9
#: The levels that a set has passed: threshold, log probability of reaching it, and the share of accepted moves of a chain of its own.
TRACE = "array<struct<level: int, threshold: double, log_prob: double, accept_rate: double>>"
CURVE_DDL = "thresholds array<double>, log_probs array<double>, populations array<array<double>>, sample_size int"


def size_key(size: Column, width: int | None, n: Column) -> Column:
    """A size rounded to a multiple of width, halves up, at least width, and less than the list's length."""
    if not width:
        return F.least(size, n - 1).cast("int")
    return F.least(F.greatest(F.lit(width), F.floor((size + width // 2) / width) * width), n - 1).cast("int")


def metric_of(es: np.ndarray, sign: int, two_sided: bool) -> np.ndarray:
    return np.abs(es) if two_sided else es * (1 if sign >= 0 else -1)


#: Sets larger than this are walked by blocks of the list, smaller ones are scored anew at each step.
BLOCKED = 300
#: Scores this much below a floor count as at it: block sums are updated, not summed anew.
SLACK = 1e-12


#: Bounds of scanned blocks allow for so much rounding.
ROUNDED = 1e-13
#: Numbers that a step holds at once, whatever the length of the list and the sets.
CELLS = 2_000_000
#: Sets of a walk that have at most so many rows times ranks are a table.
TABLE = 64_000_000
#: Walkers times members that a unit of work holds; sets of more are drawn again whenever they are walked.
HELD = 8_000_000


def _proposed(rng: np.random.Generator, held: Callable[[np.ndarray], np.ndarray], rows: int, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row a member's place, a rank outside the set, and whether one was found. held: whether each row holds a rank."""
    out = rng.integers(0, k, rows)
    new = rng.integers(0, n, rows)
    for _ in range(10):
        taken = held(new)
        if not taken.any():
            break
        new[taken] = rng.integers(0, n, int(taken.sum()))
    return out, new, ~held(new)


def _parts(rows: int, each: int) -> Iterator[slice]:
    """Slices of rows of about CELLS numbers, `each` a row."""
    part = max(1, CELLS // max(1, each))
    return (slice(a, min(a + part, rows)) for a in range(0, rows, part))


def walk(rng: np.random.Generator, weights: np.ndarray, hits: np.ndarray, metric: np.ndarray, floor: float, steps: int, sign: int, two_sided: bool) -> tuple[np.ndarray, np.ndarray, float]:
    """Move each row of hits by `steps` exchanges of a member, kept where the metric stays at floor or above; also the share of kept moves.

    Both ways to decide draw the same numbers and keep the same moves.
    """
    n, (rows, k) = len(weights), hits.shape
    if k >= n:
        return hits, metric, 0.0
    if k > BLOCKED and floor > SLACK:
        return _walk_blocks(rng, weights, hits, floor, steps, 0 if two_sided else 1 if sign >= 0 else -1)
    at = np.arange(rows)
    hits, metric = hits.copy(), metric.copy()
    kept = 0
    for _ in range(steps):
        out, new, free = _proposed(rng, lambda new: np.concatenate([(hits[p] == new[p, None]).any(1) for p in _parts(rows, k)]), rows, n, k)
        old = hits[at, out]
        hits[at[free], out[free]] = new[free]
        es = metric_of(np.concatenate([scores_of_sets(weights, np.sort(hits[p], 1)) for p in _parts(rows, k)]), sign, two_sided)
        good = free & (es >= floor - SLACK)
        back = free & ~good
        hits[at[back], out[back]] = old[back]
        metric[good] = es[good]
        kept += int(good.sum())
    hits.sort(1)
    return hits, metric, kept / max(1, rows * steps)


class _Table:
    """The sets of a walk as a table of rows and ranks, where it is small."""

    def __init__(self, hits: np.ndarray, n: int, length: int) -> None:
        self.at = np.arange(len(hits))
        self.length = length
        self.inside = np.zeros((len(hits), -(-n // length) * length), bool)
        self.inside[self.at[:, None], hits] = True

    def hold(self, rank: np.ndarray) -> np.ndarray:
        return self.inside[self.at, rank]

    def exchange(self, row: np.ndarray, old: np.ndarray, new: np.ndarray) -> None:
        self.inside[row, old] = False
        self.inside[row, new] = True

    def undo(self, row: np.ndarray, old: np.ndarray, new: np.ndarray) -> None:
        self.exchange(row, new, old)

    def within(self, row: np.ndarray, block: np.ndarray) -> np.ndarray:
        """(pairs, length): which of the ranks of a block a row holds."""
        return self.inside.reshape(len(self.at), -1, self.length)[row, block]


class _Members:
    """As _Table, without a column for each rank: the ranks as they were, in rising order, and those that entered or left since."""

    def __init__(self, hits: np.ndarray, n: int, length: int, steps: int) -> None:
        self.at, self.n, self.length = np.arange(len(hits)), n, length
        self.keys = (hits + self.at[:, None] * n).ravel()
        self.moved = np.full((len(hits), 2 * steps), -1, np.int64)
        self.count = np.zeros(len(hits), np.int64)

    def hold(self, rank: np.ndarray) -> np.ndarray:
        key = self.at * self.n + rank
        there = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
        return there ^ ((self.moved == rank[:, None]).sum(1) % 2 == 1)

    def exchange(self, row: np.ndarray, old: np.ndarray, new: np.ndarray) -> None:
        for rank in (old, new):
            self.moved[row, self.count[row]] = rank
            self.count[row] += 1

    def undo(self, row: np.ndarray, old: np.ndarray, new: np.ndarray) -> None:
        """Forget the rows' last exchanges."""
        self.count[row] -= 2
        self.moved[row, self.count[row]] = self.moved[row, self.count[row] + 1] = -1

    def within(self, row: np.ndarray, block: np.ndarray) -> np.ndarray:
        start = block * self.length
        there = np.zeros((len(row), self.length), np.int8)
        low, high = (np.searchsorted(self.keys, row * self.n + np.minimum(x, self.n)) for x in (start, start + self.length))
        many = high - low
        pair = np.repeat(np.arange(len(row)), many)
        key = self.keys[np.arange(len(pair)) + np.repeat(low - (np.cumsum(many) - many), many)]
        there[pair, key - (row * self.n + start)[pair]] = 1
        moved = self.moved[row]
        pair, column = np.nonzero((moved >= start[:, None]) & (moved < (start + self.length)[:, None]))
        np.add.at(there, (pair, moved[pair, column] - start[pair]), 1)
        return there % 2 == 1


def _walk_blocks(rng: np.random.Generator, weights: np.ndarray, hits: np.ndarray, floor: float, steps: int, side: int) -> tuple[np.ndarray, np.ndarray, float]:
    """walk() with running sums by blocks of about sqrt(n) ranks; side: 0 for two-sided scores, else the sign.

    An exchange changes two blocks' counts and weights. The running sum at the blocks' ends often shows that the floor is reached (one-sided: and that the other side is
    less far from 0), and what a block can add at most that it isn't; only blocks that leave it open are scanned. What a scan found bounds its block from both sides until a member enters or
    leaves there, as other exchanges change no more than the total weight. The exact metric is computed once, at the end.
    """
    n, (rows, k) = len(weights), hits.shape
    length = max(8, math.isqrt(n))
    blocks = -(-n // length)
    w = np.zeros(blocks * length)
    w[:n] = weights
    size = np.full(blocks, float(length))
    size[-1] = n - (blocks - 1) * length
    at = np.arange(rows)
    sets = _Table(hits, n, length) if rows * n <= TABLE else _Members(hits, n, length, steps)
    hits = hits.copy()
    members, held = np.zeros((rows, blocks)), np.zeros((rows, blocks))
    for p in _parts(rows, k):
        cell = (hits[p] // length + (at[p] - p.start)[:, None] * blocks).ravel()
        members[p] = np.bincount(cell, minlength=(p.stop - p.start) * blocks).reshape(-1, blocks)
        held[p] = np.bincount(cell, w[hits[p]].ravel(), (p.stop - p.start) * blocks).reshape(-1, blocks)
    total = held.sum(1)
    level, misses = floor - SLACK, float(n - k)
    start = np.zeros((rows, blocks))
    # largest and smallest sums of scanned blocks from their start on, and the scale that they were found with
    top, bottom, at_scale = np.full((rows, blocks), np.inf), np.full((rows, blocks), -np.inf), np.ones((rows, blocks))
    kept = 0

    def change(which: np.ndarray, old: np.ndarray, new: np.ndarray) -> None:
        members[which, old // length] -= 1
        members[which, new // length] += 1
        held[which, old // length] -= w[old]
        held[which, new // length] += w[new]
        total[which] += w[new] - w[old]
        for rank in (old, new):
            top[which, rank // length], bottom[which, rank // length] = np.inf, -np.inf

    def scanned(row: np.ndarray, block: np.ndarray, scale: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, largest, smallest) of the running sums in blocks of rows."""
        for p in _parts(len(row), 4 * length):
            r, b = row[p], block[p]
            ranks_left = size[b][:, None] > np.arange(length)
            rises = w.reshape(blocks, length)[b] / scale[r][:, None]
            course = np.cumsum(np.where(sets.within(r, b), rises, np.where(ranks_left, -1 / misses, 0.0)), 1)
            top[r, b], bottom[r, b], at_scale[r, b] = course.max(1), course.min(1), scale[r]
            yield r, top[r, b] + start[r, b], bottom[r, b] + start[r, b]

    for _ in range(steps):
        out, new, free = _proposed(rng, sets.hold, rows, n, k)
        old = hits[at, out]
        sets.exchange(at[free], old[free], new[free])
        change(at[free], old[free], new[free])
        usable = total > 0
        scale = np.where(usable, total, 1.0)
        rise = held / scale[:, None]
        fall = (size - members) / misses
        end = np.cumsum(rise - fall, 1)
        start[:, 1:] = end[:, :-1]
        off = held * np.abs(1 / scale[:, None] - 1 / at_scale) + ROUNDED
        most, least = start + top, start + bottom
        up, down = np.minimum(start + rise, most + off), np.minimum(fall - start, off - least)
        known = np.isfinite(top)
        risen, fallen = np.where(known, most - off, end), np.where(known, least + off, end)
        if side == 0:
            good = ((np.maximum(end, risen) >= level) | (np.minimum(end, fallen) <= -level)).any(1)
            row, block = np.nonzero(((up >= level) | (down >= level)) & ~good[:, None])
            for r, most, least in scanned(row, block, scale):
                good[r[(most >= level) | (-least >= level)]] = True
        else:
            # both sides' distances from 0: what the ends show, and what blocks can reach at most
            near, far = np.maximum(0.0, np.maximum(end, risen).max(1)), np.maximum(0.0, -np.minimum(end, fallen).min(1))
            if side < 0:
                near, far, up, down = far, near, down, up
            ahead = (lambda a, b: a >= b) if side > 0 else (lambda a, b: a > b)
            good = (near >= level) & ahead(near, down.max(1))
            open_ = ~good & (up.max(1) >= level) & ahead(up.max(1), far)
            row, block = np.nonzero(((up > near[:, None]) | (down > far[:, None])) & open_[:, None])
            for r, most, least in scanned(row, block, scale):
                np.maximum.at(near, r, most if side > 0 else -least)
                np.maximum.at(far, r, -least if side > 0 else most)
            good |= open_ & (near >= level) & ahead(near, far)
        good &= free & usable
        back = free & ~good
        if back.any():
            sets.undo(at[back], old[back], new[back])
            change(at[back], new[back], old[back])
        hits[at[good], out[good]] = new[good]
        kept += int(good.sum())
    hits.sort(1)
    found = scores_of_sets(weights, hits)
    return hits, np.abs(found) if side == 0 else found * side, kept / max(1, rows * steps)


class _Held:
    """Walkers' sets as rows of ranks, with what scores them."""

    def __init__(self, weights: np.ndarray, sign: int, two_sided: bool, hits: np.ndarray) -> None:
        self.weights, self.sign, self.two_sided, self.hits = weights, sign, two_sided, hits

    def metric(self) -> np.ndarray:
        return metric_of(scores_of_sets(self.weights, self.hits), self.sign, self.two_sided)

    def walked(self, rng: np.random.Generator, elite: np.ndarray, parents: np.ndarray, metric: np.ndarray, floor: float, steps: int) -> tuple[_Held, np.ndarray, float]:
        """The elite's sets and those that walks from parents end in, the metric of both, and the share of kept moves."""
        moved, value, rate = walk(rng, self.weights, self.hits[parents], metric[parents], floor, steps, self.sign, self.two_sided)
        return _Held(self.weights, self.sign, self.two_sided, np.concatenate([self.hits[elite], moved])), np.concatenate([metric[elite], value]), rate


class _Redrawn:
    """As _Held, without the sets: the draw that each began as, and the ranks in which it differs from that since (at most two for each kept move).

    Sets are drawn again by parts of CELLS ranks, so a unit of work holds the list's weights and a few sets, however many walkers there are.
    """

    def __init__(self, weights: np.ndarray, sign: int, two_sided: bool, size: int, key: int, draws: list[int], changes: list[np.ndarray]) -> None:
        self.weights, self.sign, self.two_sided = weights, sign, two_sided
        self.size, self.key, self.draws, self.changes = size, key, draws, changes

    def _hits(self, rows: np.ndarray) -> np.ndarray:
        """(rows, size) rising ranks."""
        n, out = len(self.weights), np.empty((len(rows), self.size), np.int64)
        few = min(self.size, n - self.size)  # of members or of the others, whichever are fewer
        for i, r in enumerate(rows):
            rng = np.random.Generator(np.random.Philox(key=self.key, counter=self.draws[r] << 192))
            drawn, found = np.zeros(n, bool), 0
            while found < few:
                drawn[rng.integers(0, n, few - found)] = True
                found = int(np.count_nonzero(drawn))
            if few < self.size:
                np.logical_not(drawn, out=drawn)
            drawn[self.changes[r]] ^= True
            out[i] = np.flatnonzero(drawn)
        return out

    def _between(self, old: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Ranks that only one of two sets holds."""
        one = np.zeros(len(self.weights), bool)
        one[old] = True
        one[new] ^= True
        return np.flatnonzero(one).astype(np.int32)

    def metric(self) -> np.ndarray:
        rows = np.arange(len(self.draws))
        return metric_of(np.concatenate([scores_of_sets(self.weights, self._hits(rows[p])) for p in _parts(len(rows), self.size)]), self.sign, self.two_sided)

    def walked(self, rng: np.random.Generator, elite: np.ndarray, parents: np.ndarray, metric: np.ndarray, floor: float, steps: int) -> tuple[_Redrawn, np.ndarray, float]:
        changes, values, kept = [self.changes[r] for r in elite], [metric[elite]], 0.0
        for p in _parts(len(parents), self.size):
            part = parents[p]
            hits = self._hits(part)
            moved, value, rate = walk(rng, self.weights, hits, metric[part], floor, steps, self.sign, self.two_sided)
            changes += [np.setxor1d(self.changes[r], self._between(a, b), assume_unique=True) for r, a, b in zip(part, hits, moved, strict=True)]
            values.append(value)
            kept += rate * len(part)
        draws = [self.draws[r] for r in (*elite, *parents)]
        return _Redrawn(self.weights, self.sign, self.two_sided, self.size, self.key, draws, changes), np.concatenate(values), kept / max(1, len(parents))


def walkers(rng: np.random.Generator, weights: np.ndarray, size: int, sample_size: int, sign: int, two_sided: bool) -> _Held | _Redrawn:
    """Random sets to begin with, held where they are at most HELD ranks."""
    if size * sample_size <= HELD or size >= len(weights):
        return _Held(weights, sign, two_sided, random_hits(rng, len(weights), size, sample_size))
    return _Redrawn(weights, sign, two_sided, size, int.from_bytes(rng.bytes(16), "little"), list(range(sample_size)), [np.zeros(0, np.int32)] * sample_size)


def tail_curve(weights: np.ndarray, size: int, sample_size: int, rng: np.random.Generator, eps: float, sign: int = 1, two_sided: bool = True, target: float = math.inf) -> dict:
    """Thresholds, log probabilities and populations of nested tail levels, each holding about half of the one before.

    A one-sided curve whose middle is not on its side of zero takes the positive values as its first level, so that rare signs still split.
    """
    sets = walkers(rng, weights, size, sample_size, sign, two_sided)
    metric = sets.metric()
    thresholds: list[float] = []
    logs, populations, log_p = [0.0], [metric.tolist()], 0.0
    half = sample_size // 2
    steps = min(max(size, 10), 100)
    while math.exp(log_p) >= eps and len(thresholds) <= MAX_LEVELS:
        threshold = float(np.sort(metric)[::-1][half])
        if threshold < TINY:
            positive = metric[metric >= TINY]
            if two_sided or thresholds or len(positive) < 2:
                break
            threshold = float(positive.min())
        if threshold >= target:
            break
        passing = np.flatnonzero(metric >= threshold)
        log_p += math.log(len(passing) / sample_size)
        thresholds.append(threshold)
        logs.append(log_p)
        elite = rng.permutation(passing)[:half]
        parents = elite[rng.integers(0, len(elite), sample_size - len(elite))]
        sets, metric, _ = sets.walked(rng, elite, parents, metric, threshold, steps)
        populations.append(metric.tolist())
    return {"thresholds": thresholds, "log_probs": logs, "populations": populations, "sample_size": sample_size}


def query_curve(curve: Column, metric: Column, floor: float = 0.0) -> tuple[Column, Column]:
    """(pval, log2err) of a metric on a curve column, in SQL functions; 1 and 0 for a metric of about 0, 1 and 0 without a curve."""
    level = F.size(F.filter(curve["thresholds"], lambda t: metric >= t))
    population = F.get(curve["populations"], F.least(level, F.size(curve["populations"]) - 1))
    share = F.size(F.filter(population, lambda x: x >= metric)) / F.size(population)
    log_p = F.get(curve["log_probs"], F.least(level, F.size(curve["log_probs"]) - 1))
    none = curve.isNull() | (metric < 1e-10)
    return F.when(none, 1.0).otherwise(F.greatest(F.exp(log_p) * share, F.lit(float(floor)))), F.when(none, 0.0).otherwise(1 / F.sqrt(curve["sample_size"]))


def _checked(sample_size: int, score_type: str) -> bool:
    if sample_size < 2:
        raise ValueError("sample_size is 2 at least")
    if score_type not in SCORE_TYPES:
        raise ValueError(f"score_type is one of {SCORE_TYPES}")
    return score_type == "two_sided_abs"


def batched(results: DataFrame, weights: DataFrame, sample_size: int = 101, seed: int = 42, eps: float = 1e-50, score_type: str = "two_sided_abs", bin_width: int | None = None, precheck: bool = False, precheck_n: int = 64, precheck_eps: float = 0.005, keys: list[str] | None = None) -> DataFrame:
    """results (keys, pathway, size, es, n) with pval, log2err, n_levels and trace (level, threshold, log_prob, accept_rate), from one curve for each (keys, size bin, sign).

    A curve ends beyond its most extreme observed score. With precheck a cheap curve serves the bin if that score isn't rare.
    """
    two_sided = _checked(sample_size, score_type)
    keys = keys or []
    sign = F.lit(1) if two_sided else F.when(F.col("es") >= 0, 1).otherwise(-1)
    metric = F.abs("es")
    sized = results.withColumn("__bin", size_key(F.col("size"), bin_width, F.col("n"))).withColumn("__sign", sign)
    work = sized.groupBy(*keys, "__bin", "__sign").agg(F.max(metric).alias("__target"))
    work = shared(work.select(*keys, F.struct(F.col("__bin").alias("size"), F.col("__sign").alias("sign"), F.col("__target").alias("target")).alias("unit")), weights, keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own, units, w in by_list(batches, keys):
            out = []
            for u in units:
                size, s, target = int(u["size"]), int(u["sign"]), float(u["target"])
                unit = [*own, size, s]
                curve = None
                if target >= 1e-10 and precheck:
                    cheap = tail_curve(w, size, precheck_n, rng_of(seed, "precheck", *unit), 1.0, s, two_sided)
                    level = min(sum(target >= t for t in cheap["thresholds"]), len(cheap["populations"]) - 1)
                    p = math.exp(cheap["log_probs"][level]) * float(np.mean(np.asarray(cheap["populations"][level]) >= target))
                    curve = cheap if p > precheck_eps else None
                if curve is None:
                    curve = tail_curve(w, size, sample_size, rng_of(seed, "curve", *unit), eps, s, two_sided, target)
                out.append((*own, size, s, curve["thresholds"], curve["log_probs"], curve["populations"], curve["sample_size"]))
            yield pd.DataFrame(out, columns=[*keys, "__bin", "__sign", "thresholds", "log_probs", "populations", "sample_size"])

    types = "".join(f"{c} {results.schema[c].dataType.simpleString()}, " for c in keys)
    curves = work.mapInPandas(run, f"{types}__bin int, __sign int, {CURVE_DDL}")
    curves = curves.select(*keys, "__bin", "__sign", F.struct("thresholds", "log_probs", "populations", "sample_size").alias("__curve"))
    met = sized.join(curves, [*keys, "__bin", "__sign"], "left")
    p, err = query_curve(F.col("__curve"), metric, eps)
    level = F.when(F.col("__curve").isNotNull(), F.size(F.filter(F.col("__curve")["thresholds"], lambda t: metric >= t)))
    passed = F.transform(F.slice(F.col("__curve")["thresholds"], 1, level), lambda t, i: F.struct((i + 1).alias("level"), t.alias("threshold"), F.get(F.col("__curve")["log_probs"], i + 1).alias("log_prob"), F.lit(None).cast("double").alias("accept_rate")))
    return met.withColumn("pval", p).withColumn("log2err", err).withColumn("n_levels", level).withColumn("trace", F.coalesce(passed, F.expr(f"cast(array() as {TRACE})"))).drop("__bin", "__sign", "__curve")


def chain_p(weights: np.ndarray, size: int, es: float, sample_size: int, rng: np.random.Generator, eps: float, two_sided: bool = True) -> tuple[float, float, list[float], list[float], int]:
    """(pval, log2err, thresholds, acceptance rates, levels) of one observed score by its own splitting chain."""
    sign = 1 if es >= 0 else -1
    seen = abs(es)
    if seen < 1e-10:
        return 1.0, 0.0, [], [], 0
    sets = walkers(rng, weights, size, sample_size, sign, two_sided)
    metric = sets.metric()
    above = int((metric >= seen).sum())
    if above >= math.ceil(0.05 * sample_size):
        return max((above + 1) / (sample_size + 1), eps), 1 / math.sqrt(sample_size), [], [], 0
    half, log_p = sample_size // 2, 0.0
    steps = min(max(size, 10), 100)
    thresholds: list[float] = []
    rates: list[float] = []
    while len(thresholds) < MAX_LEVELS:
        order = np.argsort(-metric, kind="stable")
        threshold = float(metric[order[half - 1]])
        if threshold >= seen:
            share = float((metric >= seen).mean())
            return max(math.exp(log_p) * share, eps, 5e-324), 1 / math.sqrt(half), thresholds, rates, len(thresholds)
        if math.exp(log_p) < eps:
            break
        log_p += math.log(half / sample_size)
        elite = order[:half]
        parents = elite[rng.integers(0, half, sample_size - half)]
        sets, metric, rate = sets.walked(rng, elite, parents, metric, threshold, steps)
        thresholds.append(threshold)
        rates.append(rate)
    return max(eps, 5e-324), 0.0, thresholds, rates, len(thresholds)


def per_set(results: DataFrame, weights: DataFrame, sample_size: int = 101, seed: int = 42, eps: float = 1e-50, score_type: str = "two_sided_abs", keys: list[str] | None = None) -> DataFrame:
    """results (keys, pathway, size, es) with pval, log2err, n_levels and trace (level, threshold, log_prob, accept_rate), a chain for each set."""
    two_sided = _checked(sample_size, score_type)
    keys = keys or []
    work = shared(results.select(*keys, F.struct("pathway", "size", "es").alias("unit")), weights, keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own, units, w in by_list(batches, keys):
            out = []
            for u in units:
                unit = [*own, u["pathway"]]
                p, err, thresholds, rates, levels = chain_p(w, int(u["size"]), float(u["es"]), sample_size, rng_of(seed, "chain", *unit), eps, two_sided)
                halved = math.log((sample_size // 2) / sample_size)
                trace = [{"level": i, "threshold": t, "log_prob": i * halved, "accept_rate": a} for i, (t, a) in enumerate(zip(thresholds, rates, strict=True), 1)]
                out.append((*unit, p, err, levels, trace))
            yield pd.DataFrame(out, columns=[*keys, "pathway", "pval", "log2err", "n_levels", "trace"])

    types = "".join(f"{c} {results.schema[c].dataType.simpleString()}, " for c in keys)
    found = work.mapInPandas(run, f"{types}pathway string, pval double, log2err double, n_levels int, trace {TRACE}")
    return results.join(found, [*keys, "pathway"])
