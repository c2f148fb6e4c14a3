"""What the near-duplicate operators share: shingle hashes, signatures, bucket joins and exact resolution of candidate groups.

A bucket join takes (key, node, check) entries, dealt to cells by key and packed, many to a row. Within a bucket, nodes are joined if a chain of
nodes with near checks leads from one to the other, so a bucket adds no more edges than it has nodes. Every entry is compared with every other of its bucket, whatever partition
it comes from. A bucket of over BUCKET nodes becomes one group without comparing checks: groups may be too large, never too small. Candidate groups
are the components of these edges; they hold every candidate pair, and their links are then decided on whole shingle sets, so that no task
holds an unbounded group and no pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import bound_batches, release, written
from rankweave.llm.graph import HELD_EDGES, components, labelled, stars_of

#: A bucket with more nodes than this becomes one candidate group without comparing checks.
BUCKET = 32_768
#: Buckets up to this size are compared together, larger ones one by one.
SMALL_BUCKET = 16
#: Entries of a cell that a task holds before it puts buckets of over BUCKET nodes together.
HELD = 1_000_000
#: Cells for each shuffle partition, and in all at least.
CELLS, LEAST_CELLS = 4, 2048
#: A block of a candidate group holds about so many shingles.
BLOCK_SHINGLES = 1_000_000
#: Candidate groups of more shingles are formed anew with longer checks.
SHARPENED = BLOCK_SHINGLES // 10

_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of an odd base and of its inverse, modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        while len(self.up) < n + 1:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_INVERSE, k, 1 << 64))])


def span_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hashes of raw[starts:ends]; equal bytes have equal hashes wherever they stand."""
    powers.reach(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * powers.up[: len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * powers.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_shingles(text: str, powers: Powers, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; with fewer words the whole sequence is one; without words none.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lowered, which are the pieces that bytes.split() makes.
    """
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    raw = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(words) > n:
        starts, ends = starts[: len(words) - n + 1], ends[n - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return _distinct(span_hashes(raw, starts, ends, powers))


def char_shingles(line: str, powers: Powers, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of n-character shingles of a line; a shorter line is one."""
    return char_shingle_sets([line], n)[0]


def char_shingle_sets(lines: list[str], n: int = 5, chars: int = 60_000) -> list[np.ndarray]:
    """char_shingles() of many lines, hashed together in parts of about `chars` characters, which fit a processor's cache."""
    out: list[np.ndarray] = []
    while len(out) < len(lines):
        part, held = [], 0
        while len(out) + len(part) < len(lines) and held <= chars:
            line = lines[len(out) + len(part)]
            part.append(line if len(line) >= n or not line else line.ljust(n, "\0"))
            held += len(line)
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        h = np.zeros(max(0, len(codes) - n + 1), np.uint64)
        for k in range(n):
            h = h * np.uint64(_BASE) + codes[k : len(codes) - n + 1 + k]
        h = mixed(h)
        starts = np.cumsum(sizes) - sizes
        ends = np.maximum(starts + sizes - n + 1, starts)
        new = np.zeros(len(h), bool)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b > a:
                h[a:b].sort()
                new[a] = True
                np.not_equal(h[a + 1 : b], h[a : b - 1], out=new[a + 1 : b])
        bounds = np.r_[0, np.cumsum(new)]
        kept = h[new]
        out += [kept[bounds[a] : bounds[b]] if b > a else kept[:0] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return out


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """The numbers, at least one, sorted, each once; sorts them in place (np.unique's hash table takes several times as long)."""
    hashes.sort()
    return hashes[np.r_[True, hashes[1:] != hashes[:-1]]]


def min_hashes(hashes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """(sets, k) values of k minhashes of the consecutive sets hashes[starts[i]:starts[i + 1]], 32-bit hashes, none of the sets empty.

    Multiplication by an odd number permutes 32-bit numbers. The values are mixed, so that their low bits serve as b-bit minhashes.
    """
    i = np.arange(k, dtype=np.uint64)
    factors = (mixed(i * np.uint64(2) + np.uint64(12345)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    out = np.empty((k, len(starts)), np.uint32)
    x = np.empty(len(hashes), np.uint32)
    for at in range(k):
        np.multiply(hashes, factors[at], out=x)
        out[at] = np.minimum.reduceat(x, starts)
    out ^= out >> np.uint32(16)
    out *= np.uint32(0x85EBCA6B)
    out ^= out >> np.uint32(13)
    out *= np.uint32(0xC2B2AE35)
    out ^= out >> np.uint32(16)
    return np.ascontiguousarray(out.T)


def set_hash(hashes: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a sorted set."""
    size = mixed(np.array([len(hashes)], np.uint64))[0]
    with np.errstate(over="ignore"):
        one, two = (mixed(hashes * np.uint64(f)).sum(dtype=np.uint64) ^ size for f in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def flooded(checks: np.ndarray, distance: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int) -> np.ndarray:
    """labelled() for the pairs with distance <= most: each number is only compared with those not yet reached."""
    label, left = np.arange(len(checks)), np.arange(len(checks))
    while len(left):
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            near = distance(checks[queue.pop()], checks[left]) <= most
            if near.any():
                found, left = left[near], left[~near]
                label[found] = root
                queue.extend(found)
    return label


def entry_type(words: int) -> np.dtype:
    """An entry: the low half of its key, its node and a check of 32-bit words."""
    return np.dtype([("key", "<u4"), ("node", "<i8"), ("check", "<u4", (words,))])


_CELLS = pa.schema([("cell", pa.int32()), ("entries", pa.binary())])
CELLS_DDL = "cell int, entries binary"


def cells_of(df: DataFrame) -> int:
    """Cells that df's session deals entries to."""
    return max(LEAST_CELLS, CELLS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def packed(nodes: np.ndarray, keys: np.ndarray, checks: np.ndarray, cells: int) -> pa.RecordBatch:
    """Entries of distinct nodes, their keys (n, k), unsigned 64 bits, and checks (n, words), packed by cell."""
    n, k = keys.shape
    flat = keys.ravel()
    cell = ((flat >> np.uint64(32)) % np.uint64(cells)).astype(np.uint16 if cells <= 1 << 16 else np.int32)  # 16-bit numbers sort by radix
    order = np.argsort(cell, kind="stable")
    cell, owner = cell[order], order // k
    made = np.empty(n * k, entry_type(checks.shape[1]))
    made["key"], made["node"], made["check"] = flat[order].astype(np.uint32), nodes[owner], checks[owner]
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if n * k else np.zeros(0, np.int64)
    ends = np.r_[first, n * k] * made.dtype.itemsize
    values = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(made.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(cell[first].astype(np.int32)), values], schema=_CELLS)


class CellJoin:
    """Edges (node, smallest node of its part of the bucket) of one cell after the other."""

    def __init__(self, words: int, distance: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int) -> None:
        self.type, self.distance, self.most = entry_type(words), distance, most
        self.held: list[np.ndarray] = []
        self.size = 0
        self.whole: dict[int, int] = {}
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, raw: object) -> None:
        made = np.frombuffer(raw, self.type)
        self.held.append(made)
        self.size += len(made)
        if self.size > HELD:
            self._gather()

    def _sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The held entries that share a bucket, each node of a bucket once, with the buckets' starts and sizes."""
        made = np.concatenate(self.held) if self.held else np.empty(0, self.type)
        if self.whole and len(made):
            hot = np.isin(made["key"], np.fromiter(self.whole, np.uint32, len(self.whole)))
            if hot.any():
                known = made[hot]
                self.edges.append((known["node"].copy(), np.fromiter((self.whole[int(x)] for x in known["key"]), np.int64, len(known))))
                made = made[~hot]
        made = made[np.argsort(made["key"])]
        key = made["key"]
        same = key[1:] == key[:-1]
        made = made[np.r_[False, same] | np.r_[same, False]] if len(made) else made
        made = made[np.lexsort((made["node"], made["key"]))]
        made = made[np.r_[True, (made["key"][1:] != made["key"][:-1]) | (made["node"][1:] != made["node"][:-1])]] if len(made) else made
        first = np.flatnonzero(np.r_[True, made["key"][1:] != made["key"][:-1]]) if len(made) else np.zeros(0, np.int64)
        return made, first, np.diff(np.r_[first, len(made)])

    def _gather(self) -> None:
        """Put buckets of over BUCKET nodes together and keep the others; entries alone in their bucket stay, others may follow."""
        everything = np.concatenate(self.held)
        self.held = [everything]
        made, first, sizes = self._sorted()
        for a, m in zip(first[sizes > BUCKET], sizes[sizes > BUCKET], strict=True):
            self.whole[int(made["key"][a])] = int(made["node"][a])
            self._star(made["node"][a : a + m])
        if self.whole:
            everything = everything[~np.isin(everything["key"], np.fromiter(self.whole, np.uint32, len(self.whole)))]
        self.held, self.size = [everything], 0

    def _star(self, nodes: np.ndarray) -> None:
        self.edges.append((nodes[1:], np.full(len(nodes) - 1, nodes[0])))

    def close(self) -> None:
        """Join the held cell."""
        made, first, sizes = self._sorted()
        self.held, self.size = [], 0
        self.whole = {}
        for a, m in zip(first[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET], strict=True):
            part = made[a : a + m]
            if m > BUCKET:
                self._star(part["node"])
                continue
            label = flooded(part["check"], self.distance, self.most)
            far = np.flatnonzero(label != np.arange(m))
            self.edges.append((part["node"][far], part["node"][label[far]]))
        small = made[np.repeat(sizes <= SMALL_BUCKET, sizes)]
        bucket = np.repeat(np.arange(len(sizes)), sizes)[np.repeat(sizes <= SMALL_BUCKET, sizes)]
        left, right = [], []
        for step in range(1, SMALL_BUCKET):
            at = np.flatnonzero(bucket[step:] == bucket[:-step])
            if not len(at):
                break
            at = at[self.distance(small["check"][at], small["check"][at + step]) <= self.most]
            left.append(at)
            right.append(at + step)
        if left:
            label = labelled(len(small), np.concatenate(left), np.concatenate(right))
            far = np.flatnonzero(label != np.arange(len(small)))
            self.edges.append((small["node"][far], small["node"][label[far]]))

    def contracted(self) -> pa.RecordBatch:
        """A star for each component of the held edges, which are then forgotten."""
        held, self.edges = self.edges, []
        return stars_of(held)


def candidate_groups(cells: DataFrame, words: int, distance: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int) -> DataFrame:
    """(node, component) of the nodes that share a candidate group, from packed entries (cell, entries)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, now = CellJoin(words, distance, most), None
        for batch in batches:
            for cell, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if cell != now:
                    joined.close()
                    now = cell
                    if sum(len(u) for u, _ in joined.edges) > HELD_EDGES:
                        yield joined.contracted()
                joined.add(raw.as_buffer())
        joined.close()
        yield joined.contracted()

    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return components(cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(join, "u long, v long"))


#: Share of a set's shingles, the rarest ones, whose postings are counted before an intersection is.
RARE = 0.3


def linked(sets: list[np.ndarray], side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """A forest of the links between sets: 100 * intersection >= percent * union. With sides, only sets of different sides are compared.

    Linked sets of sizes a and b share at least percent * (a + b) / (100 + percent) shingles, and those that a set has besides its rarest ones are at most so many of them.
    Postings of a set's rarest shingles leave few others, whose intersections are counted whole, and only as long as sets are left that no tree has reached.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    n, out = len(sets), []
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(every)
    found = every[order]
    shingle = np.empty(len(every), np.int64)
    shingle[order] = np.cumsum(np.r_[False, found[1:] != found[:-1]][: len(every)])
    posting = owner[order]
    counts = np.bincount(shingle)
    begins = np.cumsum(counts) - counts
    own = np.r_[0, np.cumsum(sizes)]
    rising = shingle[np.lexsort((counts[shingle], owner))]
    rare = np.ceil(RARE * sizes).astype(np.int64)
    left = np.ones(n, bool)
    mark = np.zeros(len(counts), bool)
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            i = queue.pop()
            wanted = left if side is None else left & (side != side[i])
            if not wanted.any():
                continue
            mine = rising[own[i] : own[i] + rare[i]]
            shared = np.bincount(posting[_ranges(begins[mine], counts[mine])], minlength=n)
            least = -(-percent * (sizes[i] + sizes) // (100 + percent)) - (sizes[i] - rare[i])
            near = np.flatnonzero(wanted & (shared >= least) & (sizes > 0))
            if not len(near):
                continue
            mark[shingle[own[i] : own[i + 1]]] = True
            shared = np.bincount(np.repeat(np.arange(len(near)), sizes[near]), mark[shingle[_ranges(own[near], sizes[near])]], len(near)).astype(np.int64)
            mark[shingle[own[i] : own[i + 1]]] = False
            near = near[(shared > 0) & (100 * shared >= percent * (sizes[i] + sizes[near] - shared))]
            left[near] = False
            queue.extend(near.tolist())
            out += [(i, j) for j in near.tolist()]
    return out


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, as many as its size, one range after the other."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def sharpened(members: DataFrame, cells: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], words: int, distance: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int) -> DataFrame:
    """members (node, group, text, weight) with the groups of over SHARPENED shingles cut to those that their nodes' longer checks form; nodes without any other near them go.

    cells makes packed entries (cell, entries) of batches (node, text). Groups are chains of candidates, and short checks let unlike nodes pass now and then: with more nodes such
    chains grow into one group of most nodes, of which every block would meet every other.
    """
    sizes = members.groupBy("group").agg(F.sum("weight").alias("w")).where(F.col("w") > SHARPENED).select("group")
    sizes = written(sizes, "sizes")
    if sizes.isEmpty():
        return members
    large = written(members.join(sizes, "group", "left_semi"), "large")
    found = candidate_groups(large.select("node", "text").mapInArrow(cells, CELLS_DDL), words, distance, most).withColumnRenamed("component", "group")
    cut = written(large.drop("group").join(found, "node").select("node", "group", "text", "weight"), "cut")
    return members.join(sizes, "group", "left_anti").select("node", "group", "text", "weight").unionByName(cut)


def resolve(members: DataFrame, shingles: Callable[[list[str]], list[np.ndarray]], percent: int, sharpen: Callable[[DataFrame], DataFrame] = lambda members: members) -> DataFrame:
    """(node, component) by exact links, from one row (node, group, text, weight) for each node of a candidate group; sharpen may cut groups.

    A group of over BLOCK_SHINGLES shingles is cut into blocks. Each block is resolved by itself, then one node of each tree with those of other blocks.
    A link that is still missing has an end outside the largest tree of its group: the nodes outside are compared, block by block, with
    each other and with that tree.
    """
    spark = members.sparkSession
    release(spark)
    members = written(members.select("node", "group", "text", "weight"), "members")
    release(spark)
    bound_batches(spark)
    members = sharpen(members)

    def blocked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """rows (node, group, text, weight) with blocks and block; the groups (group, blocks) of more than one block."""
        sizes = rows.groupBy("group").agg(F.ceil(F.sum("weight") / BLOCK_SHINGLES).cast("int").alias("blocks")).where("blocks > 1")
        sizes = written(sizes, "sizes")
        placed = rows.join(sizes, "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        return placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), sizes

    def decided(dealt: DataFrame) -> DataFrame:
        """Forest edges (u, v) of rows (task, group, node, text, block, a, b): links within block a, or between blocks a and b."""

        def decide(rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            group, a, b, node, block = (rows[c].to_numpy() for c in ("group", "a", "b", "node", "block"))
            order = np.lexsort((node, b, a, group))
            # a task's texts are bounded as its blocks are
            every = shingles(rows["text"].to_numpy()[order].tolist())
            own = np.stack([group, a, b], 1)[order]
            first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]).any(1)])
            for low, high in zip(first, np.r_[first[1:], len(order)], strict=True):
                at = order[low:high]
                if len(at) < 2:
                    continue
                sets = every[low:high]
                if len(at) == 2:
                    shared = len(np.intersect1d(*sets, assume_unique=True))
                    near = shared and 100 * shared >= percent * (len(sets[0]) + len(sets[1]) - shared)
                    found = [(0, 1)] if near and (own[low, 1] == own[low, 2] or block[at[0]] != block[at[1]]) else []
                else:
                    found = linked(sets, None if own[low, 1] == own[low, 2] else block[at] == own[low, 1], percent)
                out += [(int(node[at[i]]), int(node[at[j]])) for i, j in found]
            return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

        return written(dealt.groupBy("task").applyInPandas(decide, "u long, v long"), "links")

    def within(rows: DataFrame, shares: int) -> tuple[DataFrame, DataFrame]:
        placed, sizes = blocked(rows)
        # groups of one block share tasks: a group by itself would be too little work for one call
        task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("group"), F.lit(shares))).otherwise(F.xxhash64("group", "block"))
        return decided(placed.select(task.alias("task"), "group", "node", "text", "block", F.col("block").alias("a"), F.col("block").alias("b"))), sizes

    weight = members.agg(F.sum("weight")).first()[0] or 0
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * weight // BLOCK_SHINGLES)
    edges, sizes = within(members, shares)
    release(spark)
    whole = components(edges)
    if sizes.isEmpty():
        return whole
    large = members.join(sizes, "group", "left_semi")
    tree = F.coalesce("component", "node").alias("tree")
    trees = written(large.join(written(whole, "trees"), "node", "left").select("node", "group", "weight", tree), "trees")
    roots = large.join(trees.where("node = tree").select("node"), "node", "left_semi")
    edges = edges.unionByName(within(roots, shares)[0])
    whole = written(components(edges), "trees")
    trees = large.join(whole, "node", "left").select("node", "group", "weight", tree)
    trees = written(trees, "trees")
    counts = trees.groupBy("group", "tree").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    most = counts.groupBy("group").agg(F.max(F.struct("n", "tree")).alias("m"), F.sum("weight").alias("weight"), F.count("*").alias("trees")).where("trees > 1")
    largest = counts.join(most.select("group", F.col("m.tree").alias("tree"), F.col("weight").alias("all")), ["group", "tree"])
    blocks = lambda x: F.greatest(F.lit(1), F.ceil(x / BLOCK_SHINGLES)).cast("int")
    largest = written(largest.select("group", F.col("tree").alias("most"), blocks(F.col("all") - F.col("weight")).alias("rest"), blocks(F.col("weight")).alias("held")), "largest")
    if largest.isEmpty():
        return whole
    outside = F.col("tree") != F.col("most")
    block = F.when(outside, F.pmod(F.xxhash64("node"), F.col("rest"))).otherwise(F.col("rest") + F.pmod(F.xxhash64("node"), F.col("held"))).cast("int")
    others = F.sequence(F.lit(0), F.when(outside, F.col("rest") + F.col("held") - 1).otherwise(F.col("rest") - 1))
    placed = written(trees.join(largest, "group").select("node", "group", block.alias("block"), others.alias("others")), "placed")
    dealt = placed.join(members.select("node", "text"), "node").select("node", "group", "text", "block", F.explode("others").alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return components(edges.unionByName(decided(dealt.select(F.xxhash64("group", low, high).alias("task"), "group", "node", "text", "block", low.alias("a"), high.alias("b")))))
