"""Phrase collocations from depth-limited count tries.

1. A task keeps the texts of a few MB and makes of each language's words a trie of the phrases of at most DEPTH words, level by level in sorted order: one sort of the
   words' contexts gives all levels. Each trie is cut at the borders of prefix ranges, and a serialised piece goes to each range.
2. A range's pieces are merged, counts of equal phrases added. A walk down the merged trie gives every frequent phrase the counts of its left parts; the counts of the
   prefixes of a range's border, which lie in ranges before, come with its pieces.
3. Suffix links, a join of phrases on what follows their first words, give the right parts, and links to prefixes and suffixes the longest counts of extensions.

Borders are taken from a sample of about SAMPLE_CHARS characters; they deal out the work only, and any borders give the same result. A frequent word or phrase is one node of
each task's trie, and its extensions fall into many ranges. A merge holds about HELD_NODES nodes before it puts them together.

A phrase of two to DEPTH words that occurs `least` times or more is a candidate; one is dropped if a longer candidate holds its words and has SHARE percent or more of its count.
As counts fall with length, it's enough to look at phrases that are longer by one word.

Defined results: a null or empty text has no words; a null lang is UNKNOWN; repeated rows count each time; an empty table gives an empty result; other columns don't matter. A long
text is held as its bytes and some 60 bytes for each word while its trie is made.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.common import bound_batches, discard, release, texts_of, written

DEPTH = 5
#: Fewest occurrences of a candidate.
LEAST = 100
#: A longer candidate with this percentage of a phrase's count takes its place.
SHARE = 100
#: Phrases of a language.
TOP = 2000
UNKNOWN = "und"

#: Bytes of texts that a task makes a trie of.
HELD_BYTES = 8 << 20
#: Nodes of pieces that a merge holds before it puts them together.
HELD_NODES = 6_000_000
#: Ranges for each shuffle partition at least, and characters for each range at most.
RANGES, RANGE_CHARS = 4, 16 << 20
#: Characters from which borders are taken, and bytes of a border's words.
SAMPLE_CHARS, BORDER_BYTES = 4 << 20, 64
#: Parts of a language whose first phrases are found by themselves.
PARTS = 64

#: Byte table: A-Z lowered; what ends a piece (".,;:!?", 0x0A-0x0D) a line feed; a tab a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c for c in range(256))

#: A node's path or a border: its words as bytes.
Path = tuple[bytes, ...]


def _small(x: np.ndarray) -> np.ndarray:
    """The same numbers, none below zero, in the narrowest type."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


class Trie:
    """words: a sorted binary array. levels[d - 1]: the sorted nodes of depth d as arrays parent (a place in the level before; -1 for the border's prefix), word and count.

    above[d]: the count of the first d words of the border before these nodes; above[0], the root's, counts all words.
    """

    def __init__(self, words: pa.Array, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], above: np.ndarray) -> None:
        self.words, self.levels, self.above = words, levels, above

    def __len__(self) -> int:
        return sum(len(x[2]) for x in self.levels)

    def serialised(self) -> bytes:
        """Levels as the numbers of children, words and counts, in narrow types, compressed."""
        levels, before = [], 0
        for parent, word, count in self.levels:
            levels.append((_small(np.bincount(parent + 1, minlength=before + 1)), _small(word), _small(count)))
            before = len(count)
        lengths = pc.binary_length(self.words).to_numpy(zero_copy_only=False)
        return zstandard.ZstdCompressor(level=1).compress(pickle.dumps((_small(lengths), b"".join(self.words.to_pylist()), levels, self.above), protocol=5))

    @classmethod
    def read(cls, raw: bytes) -> Trie:
        lengths, flat, levels, above = pickle.loads(zstandard.ZstdDecompressor().decompress(raw))
        offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat)])
        made = [(np.repeat(np.arange(len(n)) - 1, n), word.astype(np.int64), count.astype(np.int64)) for n, word, count in levels]
        return cls(words, made, above)


def ranked(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words, sorted by bytes, and the place of each word among them."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), place[coded.indices.to_numpy()]


def merged(tries: list[Trie]) -> Trie:
    """One trie of several of one range: paths of each are sorted, so that a stable sort merges runs."""
    if len(tries) == 1:
        return tries[0]
    words, place = ranked(pa.concat_arrays([t.words for t in tries]))
    starts = np.cumsum([0] + [len(t.words) for t in tries])
    levels = []
    up, offsets = np.zeros(0, np.int64), np.zeros(len(tries), np.int64)
    for d in range(DEPTH):
        parents = [np.where(t.levels[d][0] < 0, -1, t.levels[d][0] + offsets[k]) for k, t in enumerate(tries)]
        parent = np.concatenate(parents)
        above = parent >= 0
        parent[above] = up[parent[above]]
        key = (parent + 1) * len(words) + np.concatenate([place[starts[k] + t.levels[d][1]] for k, t in enumerate(tries)])
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        count = np.add.reduceat(np.concatenate([t.levels[d][2] for t in tries])[order], first) if len(first) else np.zeros(0, np.int64)
        up = np.empty(len(key), np.int64)
        up[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
        offsets = np.cumsum([0] + [len(t.levels[d][2]) for t in tries])
        levels.append((key[first] // max(1, len(words)) - 1, key[first] % max(1, len(words)), count))
    return Trie(words, levels, np.sum([t.above for t in tries], axis=0))


class Shard:
    """The sorted contexts of the words of some texts (bytes): each word with the words after it in its piece, DEPTH in all, as places from 1 among the distinct words; 0: none."""

    def __init__(self, texts: list[bytes]) -> None:
        raw = np.frombuffer(b"\n".join(texts).translate(_TABLE), np.uint8)
        inside = (raw != 32) & (raw != 10)
        edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        n = len(starts)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        flat = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[inside].tobytes())])
        self.words, place = ranked(flat)
        piece = np.cumsum(raw == 10)[starts] if n else np.zeros(0, np.int64)
        word = np.concatenate([place + 1, np.zeros(DEPTH, np.int64)])
        piece = np.concatenate([piece, np.full(DEPTH, -1)])

        def after(k: int) -> np.ndarray:
            return np.where(piece[k : k + n] == piece[:n], word[k : k + n], 0)

        base = len(self.words) + 1
        pair = np.unique(word[:n] * base + after(1), return_inverse=True)[1].reshape(-1) + 1
        pairs = np.concatenate([pair, np.zeros(DEPTH, np.int64)])
        third = np.where(after(2) > 0, pairs[2 : 2 + n], 0)
        bits = int(pair.max()).bit_length() if n else 1
        if 2 * bits + base.bit_length() <= 63:
            order = np.argsort((pair << (bits + base.bit_length())) | (third << base.bit_length()) | after(4))
        else:
            order = np.lexsort((after(4), third, pair))
        self.rows = np.stack([after(k)[order] for k in range(DEPTH)], 1).astype(np.int32)
        self.total = n
        #: Of each level, the rows at which its nodes start, and their counts.
        self.starts, self.counts = [], []
        new = np.zeros(n, bool)
        new[:1] = True
        for d in range(DEPTH):
            new[1:] |= self.rows[1:, d] != self.rows[:-1, d]
            start = np.flatnonzero(new)
            count = np.diff(np.r_[start, n])
            node = self.rows[start, d] > 0
            self.starts.append(start[node])
            self.counts.append(count[node])

    def _place(self, border: Path) -> tuple[int, list[int]]:
        """The first row that isn't before the border; and the border's words as places, -1 from the first unknown one on."""
        known, low, high, index = [], 0, len(self.rows), 0
        for d, w in enumerate(border):
            index = _lower(self.words, w)
            there = index < len(self.words) and self.words[index].as_py() == w
            column = self.rows[low:high, d]
            if not there:
                return low + int(np.searchsorted(column, index + 1)), known + [-1] * (len(border) - d)
            known.append(index + 1)
            low, high = low + int(np.searchsorted(column, index + 1)), low + int(np.searchsorted(column, index + 1, "right"))
        return low, known

    def pieces(self, borders: list[Path]) -> Iterator[tuple[int, Trie]]:
        """(number of borders up to its paths, trie) of each range."""
        cuts, aboves = [[0] * DEPTH], [np.array([self.total] + [0] * (DEPTH - 1))]
        for border in borders:
            row, known = self._place(border)
            cut, above = [], np.array([self.total] + [0] * (DEPTH - 1))
            for d, (start, count) in enumerate(zip(self.starts, self.counts, strict=True), 1):
                k = int(np.searchsorted(start, row))
                if d < len(border):  # the border's own prefix stands before it, wherever its rows start
                    for at in (k - 1, k):
                        if 0 <= at < len(start) and (self.rows[start[at], :d] == known[:d]).all():
                            above[d] = count[at]
                            k = at + 1
                cut.append(k)
            cuts.append(cut)
            aboves.append(above)
        cuts.append([len(x) for x in self.starts])
        parents = [np.full(len(self.starts[0]), -1)] + [np.searchsorted(a, b, "right") - 1 for a, b in zip(self.starts, self.starts[1:], strict=False)]
        for k, above in enumerate(aboves):
            low, high = cuts[k], cuts[k + 1]
            used, levels = [], []
            for d in range(DEPTH):
                parent = parents[d][low[d] : high[d]] - (low[d - 1] if d else 0)
                used.append(self.rows[self.starts[d][low[d] : high[d]], d] - 1)
                levels.append((np.maximum(parent, -1), self.counts[d][low[d] : high[d]]))
            own, place = np.unique(np.concatenate(used), return_inverse=True)
            split = np.split(place.reshape(-1), np.cumsum([len(x) for x in used])[:-1])
            yield k, Trie(self.words.take(pa.array(own)), [(p, w, c) for (p, c), w in zip(levels, split, strict=True)], above)

    def even(self, step: int) -> Iterator[Path]:
        """Every step-th path or so, of all nodes in order, words cut to BORDER_BYTES."""
        nodes = np.zeros(self.total, np.int64)
        for start in self.starts:
            nodes[start] += 1
        at = np.cumsum(nodes) // max(1, step)
        for row in np.flatnonzero(at[1:] != at[:-1]) + 1:
            yield tuple(self.words[int(w) - 1].as_py()[:BORDER_BYTES] for w in self.rows[row] if w)


def _lower(words: pa.Array, w: bytes) -> int:
    """How many of the sorted words are before w."""
    low, high = 0, len(words)
    while low < high:
        middle = (low + high) // 2
        if words[middle].as_py() < w:
            low = middle + 1
        else:
            high = middle
    return low


def _held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[dict[str, list[bytes]]]:
    """The texts by language, about `most` bytes at a time."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
            if text:
                raw = text.encode("utf-8", "surrogatepass")
                held.setdefault(lang, []).append(raw)
                size += len(raw)
                if size >= most:
                    yield held
                    held, size = {}, 0
    if held:
        yield held


_BORDERS = pa.schema([("lang", pa.string()), ("path", pa.list_(pa.binary()))])
_PIECES = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("trie", pa.binary())])
_PHRASES = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("depth", pa.int32()), ("f", pa.int64()), ("lefts", pa.list_(pa.int64())), ("n", pa.int64())])
_PHRASES_DDL = "lang string, phrase string, depth int, f long, lefts array<long>, n long"


def _borders(rows: DataFrame, ranges: int, chars: int) -> list[tuple[str, Path]]:
    """At most about `ranges` sorted borders (lang, path) that cut a sample's distinct paths evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        for part in _held(batches, HELD_BYTES):
            for lang, texts in part.items():
                held.setdefault(lang, []).extend(texts)
        shards = {lang: Shard(texts) for lang, texts in held.items()}
        step = max(1, sum(len(s) for shard in shards.values() for s in shard.starts) // ranges)
        out = [(lang, list(path)) for lang in sorted(shards) for path in dict.fromkeys([(), *shards[lang].even(step)])]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(_BORDERS)], schema=_BORDERS)

    sample = rows.sample(min(1.0, SAMPLE_CHARS / max(1, chars)), seed=1)
    found = sample.repartition(1).mapInArrow(run, "lang string, path array<binary>").collect()
    return sorted({(r["lang"], tuple(bytes(w) for w in r["path"])) for r in found})


def frequent_phrases(docs: DataFrame, least: int = LEAST, ranges: int | None = None) -> DataFrame:
    """(lang, phrase, depth, f, lefts, n): the phrases of 1 to DEPTH words with f >= least; lefts has the counts of their first 1, 2, ... words, and n counts the language's words."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    borders = _borders(rows, ranges or max(RANGES * parts, -(-chars // RANGE_CHARS)), chars)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, HELD_BYTES):
            for lang, texts in held.items():
                own = [path for named, path in borders if named == lang]
                before = sum(named < lang for named, _ in borders)
                for k, trie in Shard(texts).pieces(own):
                    yield pa.RecordBatch.from_arrays([pa.array([before + k], pa.int32()), pa.array([lang]), pa.array([trie.serialised()], pa.binary())], schema=_PIECES)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, nodes = None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if now != (row["range"], row["lang"]):
                    if held:
                        yield _frequent(merged(held), now, borders, least)
                    now, held, nodes = (row["range"], row["lang"]), [], 0
                held.append(Trie.read(row["trie"]))
                nodes += len(held[-1])
                if nodes > HELD_NODES:
                    held = [merged(held)]
                    nodes = len(held[0])
        if held:
            yield _frequent(merged(held), now, borders, least)

    pieces = rows.mapInArrow(cut, "range int, lang string, trie binary").repartition(parts, "range").sortWithinPartitions("range", "lang")
    return pieces.mapInArrow(put_together, _PHRASES_DDL)


def _frequent(trie: Trie, now: tuple[int, str], borders: list[tuple[str, Path]], least: int) -> pa.RecordBatch:
    """The walk down a range's merged trie: its frequent phrases, with the counts of their left parts."""
    number, lang = now
    border = borders[number - 1][1] if number and borders[number - 1][0] == lang else ()
    above = {-1: ((), ())}
    out = []
    for d, (parent, word, count) in enumerate(trie.levels, 1):
        found = np.flatnonzero(count >= least)
        words = trie.words.take(pa.array(word[found])).to_pylist()
        here = {}
        for at, up, w, f in zip(found.tolist(), parent[found].tolist(), words, count[found].tolist(), strict=True):
            path, lefts = above[up]
            here[at] = ((*path, w), (*lefts, f))
            out.append((lang, b" ".join(here[at][0]).decode("utf-8", "surrogatepass"), d, f, lefts, int(trie.above[0])))
        if d < DEPTH:
            here[-1] = (border[:d], tuple(int(x) for x in trie.above[1 : d + 1]))
        above = here
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(_PHRASES)], schema=_PHRASES)


def _words_from(start: str, length: str) -> str:
    return f"array_join(slice(split(phrase, ' ', -1), {start}, {length}), ' ')"


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, ranges: int | None = None) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score."""
    found = written(frequent_phrases(docs, least, ranges), "phrases")
    release(docs.sparkSession)
    counts = found.select("lang", F.col("phrase").alias("part"), F.col("f").alias("r"))
    longer = found.where("depth > 2").select("lang", "f", F.explode(F.expr(f"array({_words_from('1', 'depth - 1')}, {_words_from('2', 'depth - 1')})")).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = found.where("depth > 1").join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("f")))
    cut = kept.select("lang", "phrase", F.col("f").alias("a"), "n", "depth", F.posexplode("lefts").alias("k", "l"))
    cut = cut.withColumn("part", F.expr(_words_from("k + 2", "depth - k - 1")))
    # sums of 38 digits are exact: counts have 14 at most
    exact = "cast((cast(1000 as decimal(4)) * cast(a as decimal(17)) * cast(n as decimal(17))) div (cast(l as decimal(17)) * cast(r as decimal(17))) as bigint)"
    scored = cut.join(counts, ["lang", "part"]).withColumn("score", F.expr(exact))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("b")).select("lang", "phrase", "b.*")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = best.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    ranked_ = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked_.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows in DuckDB SQL, whose products have 128 bits.
ORACLE_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS piece, lang, words FROM (
    SELECT lang, regexp_extract_all(x, '[^\x{20}\x{09}]+') AS words FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x{0A}-\x{0D}]')) AS x FROM documents WHERE text IS NOT NULL))
  WHERE len(words) > 0),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM p GROUP BY lang),
s AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM p),
g AS (SELECT lang, words, i, unnest(range(1, least(5, len(words) - i + 1) + 1)) AS d FROM s),
f AS (SELECT lang, array_to_string(words[i : i + d - 1], ' ') AS phrase, d, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
w AS (SELECT lang, phrase, d, f, string_split(phrase, ' ') AS words FROM f),
longer AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, f, unnest([array_to_string(words[i : i + m - 1], ' ') FOR i IN range(1, d - m + 2)]) AS phrase FROM (SELECT *, unnest(range(2, d)) AS m FROM w WHERE d > 2))
  GROUP BY lang, phrase),
c AS (SELECT w.lang, w.phrase, f AS a, words, d, unnest(range(1, d)) AS k FROM w LEFT JOIN longer USING (lang, phrase) WHERE d > 1 AND (longer IS NULL OR 100 * longer < 100 * f)),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n, k, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1 : k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[k + 1 : c.d], ' ') JOIN n ON n.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best) WHERE rank <= 2000
"""
