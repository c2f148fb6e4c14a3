"""Backgrounds of random sets: permutations of a list, drawn by generators or by hashes, each of which serves all sizes by its prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rng_of(seed: int, *parts: object) -> np.random.Generator:
    """A generator that depends on the seed and the unit of work, not on partitions."""
    import hashlib

    key = int.from_bytes(hashlib.sha256("|".join(map(str, (seed, *parts))).encode()).digest()[:16], "little")
    return np.random.Generator(np.random.Philox(key=key))


#: Numbers that an array of sets' scores holds at once.
CELLS = 500_000


def scores_of_sets(weights: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Enrichment scores of many sets of one size at once: weights by rank, hits (sets, size) with rising ranks."""
    part = max(1, CELLS // max(1, hits.shape[1]))
    return np.concatenate([np.zeros(0), *(scores_of_hits(weights[hits[a : a + part]], hits[a : a + part], len(weights)) for a in range(0, len(hits), part))])


def scores_of_hits(w: np.ndarray, hits: np.ndarray, n: int) -> np.ndarray:
    """Enrichment scores of sets of one size in a list of n: their members' weights and rising ranks (sets, size)."""
    k = hits.shape[1]
    if k in (0, n):
        return np.zeros(len(hits))
    cw = np.cumsum(w, 1)
    total = cw[:, -1:]
    safe = np.where(total > 0, total, 1)
    miss = (hits - np.arange(k)) / (n - k)
    high = (cw / safe - miss).max(1)
    low = ((cw - w) / safe - miss).min(1)
    return np.where(total[:, 0] > 0, np.where(high >= -low, high, low), 0.0)


def random_hits(rng: np.random.Generator, n: int, k: int, sets: int) -> np.ndarray:
    """Uniform k-subsets of range(n), rising."""
    if 4 * k > n:  # rows by rows, which draws the same numbers
        part = max(1, CELLS // n)
        return np.concatenate([np.sort(np.argpartition(rng.random((min(part, sets - a), n)), k - 1, 1)[:, :k], 1) for a in range(0, sets, part)])
    hits = rng.integers(0, n, (sets, k))
    hits.sort(1)
    while True:  # draw the repeated members anew
        again = np.zeros(hits.shape, bool)
        again[:, 1:] = hits[:, 1:] == hits[:, :-1]
        if not again.any():
            return hits
        hits[again] = rng.integers(0, n, int(again.sum()))
        hits.sort(1)


def nested_scores(weights: np.ndarray, order: np.ndarray, sizes: list[int]) -> np.ndarray:
    """(permutations, sizes): scores of the sets that each permutation's first k ranks make, for every size k. order: (permutations, largest size) ranks as drawn.

    The drawn ranks are sorted once; a size's members are those of the sorted ranks that were drawn among the first k.
    """
    part = max(1, CELLS // max(1, order.shape[1]))
    return np.concatenate([np.zeros((0, len(sizes))), *(nested_scores_of_hits(weights[order[a : a + part]], order[a : a + part], len(weights), sizes) for a in range(0, len(order), part))])


def nested_scores_of_hits(w: np.ndarray, order: np.ndarray, n: int, sizes: list[int]) -> np.ndarray:
    """nested_scores() of a list of n by the weights of the drawn ranks: both (permutations, largest size), as drawn."""
    drawn = np.argsort(order, 1, kind="stable")
    ranks, w = np.take_along_axis(order, drawn, 1), np.take_along_axis(w, drawn, 1)
    return np.stack([scores_of_hits(w[drawn < k].reshape(len(order), k), ranks[drawn < k].reshape(len(order), k), n) for k in sizes], 1) if sizes else np.zeros((len(order), 0))


def random_order(rng: np.random.Generator, n: int, k: int, perms: int) -> np.ndarray:
    """The first k ranks of random permutations of range(n)."""
    return rng.permuted(random_hits(rng, n, k, perms), axis=1)


def hashed_order(genes: list[bytes], seed: int, perm: int, k: int) -> np.ndarray:
    """The first k ranks of the genes by md5(seed|perm|gene); genes are UTF-8 bytes by rank."""
    import hashlib

    head = f"{seed}|{perm}|".encode()
    halves = np.empty((len(genes), 2), np.uint64)
    for a in range(0, len(genes), 100_000):
        halves[a : a + 100_000] = np.frombuffer(b"".join([hashlib.md5(head + g).digest() for g in genes[a : a + 100_000]]), ">u8").reshape(-1, 2)
    last = np.partition(halves[:, 0], k - 1)[k - 1] if k else 0
    near = np.flatnonzero(halves[:, 0] <= last)
    return near[np.lexsort((halves[near, 1], halves[near, 0]))][:k]


#: Draws of random sets: by numpy's generators, or by hashes that other engines can follow.
DRAWS = ("random", "hashed")
#: Shares of the permutations of a list, which are units of work; the draws don't depend on the number of tasks.
SHARES = 16


def rank_weights(ranks: DataFrame, power: float, keys: list[str], genes: bool = False) -> DataFrame:
    """(keys, block, weights): |score| ** power by rank, an array for each BLOCK ranks of a list; with genes (keys, rnk, w, gene), rows that stay apart, for hashed draws."""
    from rankweave.operators.enrichment import weight

    rows = ranks.select(*keys, "rnk", weight(F.col("score"), power).alias("w"), *(["gene"] if genes else []))
    return rows if genes else _gathered(rows, keys)


def _gathered(rows: DataFrame, keys: list[str]) -> DataFrame:
    held = rows.groupBy(*keys, F.floor(F.col("rnk") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("rnk", "w"))).alias("held"))
    return held.select(*keys, "block", F.col("held.w").alias("weights"))


def _drawn(sizes: DataFrame, weights: DataFrame, nperm: int, seed: int, keys: list[str]) -> DataFrame:
    """(keys, size, share, up, n_up, down, n_down): sums and numbers of the scores >= 0 and < 0 of generated permutations, for each share of those of a list."""
    types = _types(sizes, keys) + "size int, share int, up double, n_up long, down double, n_down long"
    units = _wanted(sizes, keys).select(*keys, F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"), "sizes")
    work = shared(units.select(*keys, F.struct("share", "sizes").alias("unit")), weights, keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own, listed, w in by_list(batches, keys):
            made = []
            for unit in sorted(listed, key=lambda u: u["share"]):
                share = int(unit["share"])
                known = [int(k) for k in unit["sizes"]]
                if not known:
                    continue
                ks = [min(k, len(w)) for k in known]
                rng = rng_of(seed, "background", *own, share)
                parts = [np.zeros((0, len(ks)))]
                for m in _chunks(len(range(share, nperm, SHARES)), ks[-1]):
                    parts.append(nested_scores(w, random_order(rng, len(w), ks[-1], m), ks))
                es = np.concatenate(parts)
                up = es >= 0
                made += [(*own, k, share, float(es[up[:, j], j].sum()), int(up[:, j].sum()), float(es[~up[:, j], j].sum()), int((~up[:, j]).sum())) for j, k in enumerate(known)]
            yield pd.DataFrame(made, columns=[*keys, "size", "share", "up", "n_up", "down", "n_down"])

    return work.mapInPandas(run, types)


def _types(rows: DataFrame, keys: list[str]) -> str:
    return "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in keys)


def _wanted(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sizes): the distinct sizes of each list, rising."""
    return sizes.groupBy(*keys).agg(F.array_sort(F.collect_set(F.col("size").cast("int"))).alias("sizes"))


def _met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows joined with few rows by keys; each with each, without keys."""
    return left.join(F.broadcast(right), keys) if keys else left.crossJoin(F.broadcast(right))


#: Deviations that the first draws of a permutation allow for, and how much wider each further try is.
SIGMAS, WIDER = 6, 8
#: Rows of hashed permutations that are shuffled at most; larger sets are drawn by tasks that hold the list as bytes.
ROWS = 25_000_000
#: Ranks of a list in one row.
BLOCK = 8192


def hashed_scores(sizes: DataFrame, rows: DataFrame, nperm: int, seed: int, keys: list[str]) -> DataFrame:
    """(keys, perm, size, es) of hashed permutations of lists (keys, rnk, w, gene): the first k genes by md5(seed|perm|gene), then rank, are a set of size k."""
    if nperm < 1 or sizes.isEmpty():  # no list is read for nothing
        return rows.sparkSession.createDataFrame([], _types(sizes, keys) + "perm int, size int, es double")
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    lists = _met(rows.groupBy(*keys).agg(F.count("*").cast("int").alias("__n")), _wanted(sizes, keys), keys)
    lists = lists.withColumn("__k", F.least(F.array_max("sizes"), "__n")).persist()
    several = lists.where("__k > 0")
    drawn = int(several.agg(F.sum(F.col("__k").cast("long"))).first()[0] or 0) * nperm
    made = (_scores_by_rows if drawn <= ROWS else _scores_by_lists)(several, rows, nperm, seed, keys)
    none = lists.where("__k = 0").select(*keys, F.explode(F.sequence(F.lit(0), F.lit(nperm - 1))).alias("perm"), "sizes")
    return made.unionByName(none.select(*keys, "perm", F.explode("sizes").alias("size"), F.lit(0.0).alias("es")))


def _scores_by_rows(lists: DataFrame, rows: DataFrame, nperm: int, seed: int, keys: list[str]) -> DataFrame:
    """hashed_scores() with a list's rows dealt over all tasks.

    A row goes on to a permutation only if its hash is below a bound that about the largest size and SIGMAS deviations more of them keep to, so a
    permutation holds rows in proportion to that size, whatever the list's length. Permutations that got too few (as where genes
    repeat) are drawn again with a WIDER bound, at last with none, so the sets are exact.
    """
    spark, types = rows.sparkSession, _types(lists, keys) + "perm int, size int, es double"
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = rows.repartition(tasks, *keys, "rnk", "gene")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for got in batches:
            made = []
            for row in got.to_dict("records"):
                n, known = int(row["__n"]), [int(k) for k in row["sizes"]]
                es = nested_scores_of_hits(np.asarray(row["ws"], float)[None], np.asarray(row["ranks"], np.int64)[None], n, [min(k, n) for k in known])[0]
                made += [(*[row[c] for c in keys], row["perm"], k, float(x)) for k, x in zip(known, es, strict=True)]
            yield pd.DataFrame(made, columns=[*keys, "perm", "size", "es"])

    def scored(perms: DataFrame, wide: int) -> DataFrame:
        share = wide * (F.col("__k") + SIGMAS * F.sqrt("__k") + 4 * SIGMAS) / F.col("__n")
        # 13 hexadecimal digits; g is beyond every hash
        bound = F.when(share < 1, F.lpad(F.lower(F.hex(F.floor(share * 2**52).cast("long"))), 13, "0")).otherwise("g")
        each = _met(dealt, _met(perms, lists, keys).select(*keys, "perms", bound.alias("bound")), keys)
        each = each.select(*keys, "rnk", "w", "gene", "bound", F.explode("perms").alias("perm"))
        hashed = F.md5(F.concat(F.lit(f"{seed}|"), F.col("perm").cast("string"), F.lit("|"), "gene").cast("binary"))
        near = each.withColumn("h", hashed).where(F.col("h") < F.col("bound")).select(*keys, "perm", F.unhex("h").alias("h"), "rnk", "w")
        near = near.repartition(tasks, *keys, "perm")  # rows are gathered after the shuffle alone
        held = near.groupBy(*keys, "perm").agg(F.array_sort(F.collect_list(F.struct("h", "rnk", "w"))).alias("held"))
        first = _met(held, lists, keys).where(F.size("held") >= F.col("__k")).withColumn("held", F.slice("held", 1, F.col("__k")))
        return first.select(*keys, "perm", "__n", "sizes", F.col("held.rnk").alias("ranks"), F.col("held.w").alias("ws")).mapInPandas(run, types).persist()

    numbers = spark.range(nperm).agg(F.array_sort(F.array_agg(F.col("id").cast("int"))).alias("perms"))
    perms = lists.select(*keys).crossJoin(F.broadcast(numbers))
    left, found, wide = nperm * lists.count(), [], 1
    while left or not found:
        if wide > 2**36:  # the bound was beyond every hash of any list
            raise RuntimeError(f"{left} permutations of hashed draws stay short")
        found.append(scored(perms, wide))
        done = found[-1].select(*keys, "perm").distinct()
        left, wide = left - done.count(), wide * WIDER
        perms = perms.select(*keys, F.explode("perms").alias("perm")).join(done, [*keys, "perm"], "left_anti").groupBy(*keys).agg(F.array_agg("perm").alias("perms"))
    return reduce(DataFrame.unionByName, found)


def first_hashed(names: list[tuple[bytes, np.ndarray]], n: int, seed: int, perm: int, k: int) -> np.ndarray:
    """hashed_order() of n genes held as (their bytes joined, where each ends) by blocks of ranks: only hashes that may be among the first k are kept."""
    import hashlib

    head, wide = f"{seed}|{perm}|".encode(), 1
    while True:
        share = wide * (k + SIGMAS * k**0.5 + 4 * SIGMAS) / n
        bound = np.uint64(int(share * 2**64) if share < 1 else 2**64 - 1)
        kept, at = [], 0
        for text, ends in names:
            digests = b"".join([hashlib.md5(head + text[a:b]).digest() for a, b in pairwise([0, *ends.tolist()])])
            halves = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)
            near = np.flatnonzero(halves[:, 0] <= bound)
            kept.append((halves[near], (near + at).astype(np.int32)))
            at += len(ends)
        halves, near = (np.concatenate(x) for x in zip(*kept, strict=True))
        if len(near) >= k:
            return near[np.lexsort((halves[:, 1], halves[:, 0]))][:k]
        wide *= WIDER


def _scores_by_lists(lists: DataFrame, rows: DataFrame, nperm: int, seed: int, keys: list[str]) -> DataFrame:
    """hashed_scores() of sets so large that a row for each of their genes would be too many: a task draws a share of a list's permutations, and holds weights and names as bytes."""
    spark, types = rows.sparkSession, _types(lists, keys) + "perm int, size int, es double"
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    blocks = rows.groupBy(*keys, F.floor(F.col("rnk") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("rnk", "w", "gene"))).alias("b"))
    units = lists.select(*keys, "sizes", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    work = _met(blocks.select(*keys, "block", F.col("b.w").alias("w"), F.col("b.gene").alias("genes")), units, keys)
    work = work.repartition(tasks, *keys, "share").sortWithinPartitions(*keys, "share", "block")

    def scored(unit: tuple, sizes: list[int], ws: list[np.ndarray], names: list[tuple[bytes, np.ndarray]]) -> pd.DataFrame:
        w = np.concatenate(ws)
        ks, made = [min(k, len(w)) for k in sizes], []
        for perm in range(unit[-1], nperm, SHARES):
            order = first_hashed(names, len(w), seed, perm, ks[-1])
            made += [(*unit[:-1], perm, k, float(x)) for k, x in zip(sizes, nested_scores(w, order[None], ks)[0], strict=True)]
        return pd.DataFrame(made, columns=[*keys, "perm", "size", "es"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, sizes, ws, names = None, [], [], []
        for got in batches:
            for row in got.to_dict("records"):
                own = (*[row[c] for c in keys], int(row["share"]))
                if own != unit:
                    if unit is not None:
                        yield scored(unit, sizes, ws, names)
                    unit, sizes, ws, names = own, [int(k) for k in row["sizes"]], [], []
                texts = [g.encode() for g in row["genes"]]
                ws.append(np.array(row["w"], float))
                names.append((b"".join(texts), np.cumsum([len(t) for t in texts], dtype=np.int32)))
        if unit is not None:
            yield scored(unit, sizes, ws, names)

    return work.mapInPandas(run, types)


def background(sizes: DataFrame, weights: DataFrame, nperm: int = 500, seed: int = 42, keys: list[str] | None = None, draws: str = "random") -> DataFrame:
    """(keys, size, pos_mean, neg_mean) for each (keys, size): means of the scores >= 0 and < 0 of nperm random sets; 1 and -1 where a side is empty.

    One permutation of a list serves all its sizes by its prefixes. Hashed draws need weights with genes and equal hashed_background()'s.
    """
    keys = keys or []
    if draws not in DRAWS:
        raise ValueError(f"draws is one of {DRAWS}")
    if sizes.isEmpty():  # no list is gathered for nothing
        return sizes.sparkSession.createDataFrame([], _types(sizes, keys) + "size int, pos_mean double, neg_mean double")
    if draws == "hashed":
        es, asked = F.col("es"), _wanted(sizes, keys).select(*keys, F.explode("sizes").alias("size"))
        up, n_up, down, n_down = F.when(es >= 0, es), F.when(es >= 0, 1), F.when(es < 0, es), F.when(es < 0, 1)
        part = F.struct("perm", *(F.coalesce(c, F.lit(0)).alias(a) for a, c in (("up", up), ("n_up", n_up), ("down", down), ("n_down", n_down))))
        drawn = hashed_scores(sizes, weights, nperm, seed, keys).groupBy(*keys, "size").agg(F.array_sort(F.collect_list(part)).alias("p"))
        parts = asked.join(drawn, [*keys, "size"], "left").withColumn("p", F.coalesce("p", F.array().cast(drawn.schema["p"].dataType)))
    else:
        made = _drawn(sizes, weights if "weights" in weights.columns else _gathered(weights, keys), nperm, seed, keys)
        parts = made.groupBy(*keys, "size").agg(F.array_sort(F.collect_list(F.struct("share", "up", "n_up", "down", "n_down"))).alias("p"))

    def total(c: str):
        return F.aggregate("p", F.lit(0.0), lambda a, x: a + x[c])  # in the order of shares or permutations, so that equal runs have equal sums

    pos = F.when(total("n_up") > 0, total("up") / total("n_up")).otherwise(1.0)
    neg = F.when(total("n_down") > 0, total("down") / total("n_down")).otherwise(-1.0)
    return parts.select(*keys, "size", pos.alias("pos_mean"), neg.alias("neg_mean"))


def _chunks(total: int, k: int, cells: int = 2_000_000) -> Iterator[int]:
    """total in parts of at most `cells` // k."""
    part = max(1, cells // max(k, 1))
    for at in range(0, total, part):
        yield min(part, total - at)


#: Rows that a list of many is dealt to, each with a share of its units.
KEYED = 4
#: Bytes of a batch to Python, unless one row is more.
BATCH = 8 << 20


def shared(units: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, share, units, block, weights): the units of work (keys, unit) of a list with the blocks of its weights, dealt over all tasks; by_list() reads them.

    A list of many is KEYED shares at most, so its weights travel so many times; a single list has a bounded number of shares of its units. A list is never one row.
    """
    spark = units.sparkSession
    # batches to Python are bounded by bytes
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    share = F.pmod(F.xxhash64("unit"), F.lit(KEYED if keys else 2 * tasks)).alias("share")
    dealt = units.groupBy(*keys, share).agg(F.collect_list("unit").alias("units"))
    met = dealt.join(weights, keys) if keys else weights.crossJoin(F.broadcast(dealt))
    return met.repartition(tasks if keys else 2 * tasks, *keys, "share").sortWithinPartitions(*keys, "share", "block")


def by_list(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, list, np.ndarray]]:
    """(values of keys, units, weights) of each list and share, from the rows of shared()."""
    now, units, held = None, [], []
    for rows in batches:
        for row in rows.to_dict("records"):
            own = (*[row[c] for c in keys], row["share"])
            if own != now:
                if now is not None:
                    w, held = np.concatenate(held), []
                    yield now[:-1], units, w
                now, units = own, row["units"]
            held.append(np.array(row["weights"], float))
    if now is not None:
        w, held = np.concatenate(held), []
        yield now[:-1], units, w


def hashed_background(ranks: DataFrame, sizes: DataFrame, nperm: int = 100, seed: int = 42, power: float = 1.0) -> DataFrame:
    """(perm, size, es) of hashed permutations: the first k genes by md5(seed|perm|gene) are permutation perm's random set of size k.

    One permutation serves all sizes. For one list; any engine with md5 can draw the same sets.
    """
    return hashed_scores(sizes, rank_weights(ranks, power, [], genes=True), nperm, seed, [])


def means_of(drawn: DataFrame) -> DataFrame:
    """(size, pos_mean, neg_mean) of (perm, size, es)."""
    return drawn.groupBy("size").agg(F.coalesce(F.avg(F.when(F.col("es") >= 0, F.col("es"))), F.lit(1.0)).alias("pos_mean"), F.coalesce(F.avg(F.when(F.col("es") < 0, F.col("es"))), F.lit(-1.0)).alias("neg_mean"))


def permutation_p(results: DataFrame, drawn: DataFrame, one_sided: bool = False) -> DataFrame:
    """results with pval = (1 + random sets of the size that score at least as far from 0, one_sided: on the score's side) / (1 + their number)."""
    per_size = drawn.groupBy("size").agg(F.collect_list(F.round("es", 12)).alias("null_es"))
    met = results.join(per_size, "size", "left")
    seen = F.round(F.abs("es"), 12)
    above = F.size(F.filter("null_es", lambda x: (x * F.when(F.col("es") >= 0, 1).otherwise(-1) if one_sided else F.abs(x)) >= seen))
    return met.withColumn("pval", (1 + above) / (1 + F.size("null_es"))).drop("null_es")
