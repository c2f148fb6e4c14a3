"""Benchmark decontamination with DataFrame and SQL functions only.

The windows of all benchmark items (NGRAM consecutive words; an item of fewer, but not none, is one window) form hash sets of at most about MAX_WINDOWS
members, of which each goes to every task in the plan of a pass over the documents: a larger benchmark takes more passes. Every window has an anchor, its longest word; the
windows of a document that hold an anchor at any place are looked up in the set by their hash, so that no window is missed and most windows of clean text
are never built. What is found is verified by its text, in a join with the benchmark's windows. Nothing is shuffled but the short rows of documents with hits.

Defined results: a null or empty text, or one of separators only, has no words and is never contaminated; a null or wordless item has no windows; an item
with a null id hits words but is not listed; equal ids of items count once; repeated documents get equal rows; an empty benchmark hits nothing; columns of any name go through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import ascii_lower, row_key, unused, written

NGRAM = 13
#: Windows whose hashes go to the tasks at a time (about 20 bytes each, and an anchor for each at most).
MAX_WINDOWS = 50_000
#: A document is contaminated if hit words are at least one in SHARE of its words.
SHARE = 20

_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PIECE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
_LEAD = r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), _SEPARATOR), "")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, length, window): each item's distinct windows, words joined by a space."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    items = items.select("item_id", "words", F.least(F.size("words"), F.lit(NGRAM)).alias("length")).where("length > 0")
    return (
        items.select("item_id", "words", "length", F.explode(F.expr("sequence(0, size(words) - length)")).alias("at"))
        .select("item_id", "length", F.expr("array_join(slice(words, at + 1, length), ' ')").alias("window"))
        .distinct()
    )


class WindowSet:
    """The hashes of some windows by length, and an anchor word for each."""

    def __init__(self, windows: list[tuple[str, int]]) -> None:
        self.by_length: dict[int, set[int]] = {}
        self.anchors: dict[int, set[str]] = {}
        for window, number in windows:
            words = window.split(" ")
            self.by_length.setdefault(len(words), set()).add(number)
            self.anchors.setdefault(len(words), set()).add(max(words, key=lambda x: (len(x), x)))

    def found(self, words: str) -> str:
        """SQL: array of (start, length, window) of the windows of the array column whose hashes are in the set."""
        found = []
        for length, numbers in sorted(self.by_length.items()):
            anchors = ", ".join(f"'{x}'" for x in sorted(self.anchors[length]))
            members = ", ".join(f"{x}L" if x > -(1 << 63) else "cast('-9223372036854775808' as bigint)" for x in sorted(numbers))
            at = f"filter(transform({words}, (w, i) -> if(w IN ({anchors}), i, -1)), p -> p >= 0)"
            around = f"array_distinct(flatten(transform({at}, p -> sequence(greatest(p - {length - 1}, 0), least(p, size({words}) - {length})))))"
            built = f"transform({around}, s -> named_struct('start', s, 'length', {length}, 'window', array_join(slice({words}, s + 1, {length}), ' ')))"
            found.append(f"if(size({words}) < {length}, array(), filter({built}, h -> xxhash64(h.window) IN ({members})))")
        return f"concat({', '.join(found)})" if found else "cast(array() as array<struct<start: int, length: int, window: string>>)"


def _covered(hits: str) -> str:
    """SQL: the distinct word places inside the (start, length) entries."""
    return f"array_distinct(flatten(transform({hits}, h -> sequence(h.start, h.start + h.length - 1))))"


def _with_words(docs: DataFrame) -> DataFrame:
    """(key, doc_id, words, row). The words are cut once: the row number, which later steps use, keeps the optimizer from copying the cut into their expressions."""
    return docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", words_of(F.col("text")).alias("words"), F.monotonically_increasing_id().alias("row"))


def _found(docs: DataFrame, benchmark: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Per document (key, doc_id, n_words); and (key, start, length, item_id) of the verified hits, for each item with the window."""
    windows = written(benchmark_windows(benchmark).withColumn("number", F.xxhash64("window")), "windows")
    distinct = windows.select("window", "number").distinct()
    passes = max(1, -(-distinct.count() // limit))
    cut = _with_words(docs)
    found = []
    for k in range(passes):
        held = WindowSet([tuple(r) for r in distinct.where(F.pmod("number", F.lit(passes)) == k).collect()])
        rows = cut.select("key", "doc_id", F.size("words").cast("long").alias("n_words"), F.expr(held.found("words")).alias("found"), "row")
        found.append(written(rows if not k else rows.where("size(found) > 0 and row >= 0"), "found"))
    hits = None
    for rows in found:
        part = rows.select("key", F.inline("found")).distinct()
        hits = part if hits is None else hits.unionByName(part)
    return found[0].select("key", "doc_id", "n_words"), hits.join(windows.select("window", "item_id"), "window").select("key", "start", "length", "item_id")


def _marked(docs: DataFrame, benchmark: DataFrame, limit: int) -> DataFrame:
    """What contamination() returns, and key, the row's key."""
    rows, hits = _found(docs, benchmark, limit)
    met = hits.groupBy("key").agg(F.collect_set(F.struct("start", "length")).alias("hits"), F.array_sort(F.collect_set("item_id")).alias("items"))
    met = met.select("key", F.expr(f"cast(size({_covered('hits')}) as bigint)").alias("hit"), "items")
    items = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    marked = rows.join(written(met, "met"), "key", "left").select("key", "doc_id", "n_words", F.coalesce("hit", F.lit(0)).alias("n_hit"), items.alias("items"))
    return marked.select(
        "key", "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, limit: int = MAX_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return _marked(docs, benchmark, limit).drop("key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, limit: int = MAX_WINDOWS) -> DataFrame:
    """The documents that are not contaminated, with their own columns: each row is decided by its own text."""
    row, key = unused(docs, "row"), unused(docs, "key")
    bad = written(_marked(docs, benchmark, limit).where("contaminated").select(F.col("key").alias(key)).distinct(), "contaminated")
    return docs.withColumn(row, row_key(F.col("doc_id"), F.col("text"))).join(bad, F.col(row) == F.col(key), "left_anti").drop(row)


def remove_spans(docs: DataFrame, benchmark: DataFrame, limit: int = MAX_WINDOWS) -> DataFrame:
    """docs with the hit words, and the separators after them, cut out of text; other columns as they are."""
    row, key, hit = (unused(docs, c) for c in ("row", "key", "hit"))
    hits = _found(docs, benchmark, limit)[1].groupBy("key").agg(F.collect_set(F.struct("start", "length")).alias("hits"))
    hits = written(hits.select(F.col("key").alias(key), F.expr(_covered("hits")).alias(hit)), "places")
    marked = docs.withColumn(row, row_key(F.col("doc_id"), F.col("text"))).join(hits, F.col(row) == F.col(key), "left")
    pieces = f"regexp_extract_all(text, '{_PIECE}', 0)".replace("\\", "\\\\")
    # the pieces are bound once, and set difference takes time linear in them
    kept = F.expr(f"transform(array({pieces}), x -> array_join(transform(array_except(sequence(0, size(x) - 1), `{hit}`), i -> x[i]), ''))[0]")
    text = F.when(F.col(hit).isNull(), F.col("text")).otherwise(F.concat(F.regexp_extract("text", _LEAD, 0), kept))
    return marked.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same rows in DuckDB SQL.
ORACLE_SQL = r"""
WITH w AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS words
  FROM benchmark WHERE text IS NOT NULL),
n AS (SELECT item_id, words, least(len(words), 13) AS length FROM w WHERE len(words) > 0),
b AS (SELECT DISTINCT item_id, length, array_to_string(words[pos + 1 : pos + length], ' ') AS win
      FROM (SELECT item_id, words, length, unnest(range(0, len(words) - length + 1)) AS pos FROM n)),
d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS words
  FROM documents),
l AS (SELECT DISTINCT length FROM b),
s AS (SELECT k, words, length, unnest(range(0, len(words) - length + 1)) AS pos FROM d, l WHERE len(words) >= length),
h AS (SELECT k, length, pos, array_to_string(words[pos + 1 : pos + length], ' ') AS win FROM s),
m AS (SELECT h.k, h.pos, h.length, h.win FROM h WHERE win IN (SELECT win FROM b)),
c AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(pos, pos + length)) AS p FROM m) GROUP BY k),
i AS (SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
      FROM m JOIN b USING (win) WHERE item_id IS NOT NULL GROUP BY k)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.words) AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN i USING (k)
"""
