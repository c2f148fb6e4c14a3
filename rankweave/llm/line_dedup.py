"""Fuzzy line de-duplication by MinHash.

Lines (cut at newlines) of at least `least` characters, lower-cased and with white space squeezed, are nodes: equal lines are one node (by 128 bits of hash). The
5-character shingles of a line (a shorter line is one) give HASHES minhashes in BANDS bands; lines that share a band and whose one-bit signatures are near form candidate groups, and their
links are decided on whole shingle sets: 100 * intersection >= PERCENT * union. (At a Jaccard similarity of 0.8, bands miss 1 pair in 200; at 0.9, fewer than 1 in 1,000,000.)
Of each component one line stays: the first by (doc_id, row key, line number).

Defined results: a null text has no lines; a blank line is kept; a null doc_id sorts first; rows with equal doc_id and text are one
document and get equal results; columns of any name go through.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import bound_batches, row_key, texts_of, unused, written
from rankweave.llm.similar import CELLS_DDL, candidate_groups, cells_of, char_shingle_sets, min_hashes, mixed, packed, resolve, sharpened

CHARS = 5
PERCENT = 80
#: Fewest characters of a line that can be a copy; with 1 every line that isn't blank.
LEAST = 1
HASHES, BANDS = 108, 18
#: Most of CHECK_BITS one-bit minhashes that may differ between candidates (at 0.8, 6.4 differ on average, 19 or more in 1 of 100,000 pairs).
CHECK_BITS, MOST = 64, 18
#: Most of the HASHES minhashes, 8 bits of each, that may differ within large groups (at 0.8, 21.5 differ on average, 42 or more in 1 of 100,000 pairs; at 0.5, 41 or fewer in 1 of 120).
SHARP_MOST = 41
#: Lines whose entries a task packs at a time.
SIGNED = 16_384

_LINES = pa.schema([("doc_id", pa.int64()), ("row_key", pa.binary()), ("line", pa.int32()), ("node", pa.int64()), ("twin", pa.int64()), ("weight", pa.int32())])


def squeezed(line: str) -> str:
    return " ".join(line.lower().split())


#: White space besides spaces and newlines.
_WHITE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def _lines_from(text: str, least: int) -> list[tuple[int, str]]:
    text = text.lower()
    if any(c in text for c in _WHITE):
        return [(i, s) for i, x in enumerate(text.split("\n")) if len(x) >= least and len(s := " ".join(x.split())) >= least]
    # only runs of spaces are left to squeeze
    return [(i, s) for i, x in enumerate(text.split("\n")) if len(x) >= least and len(s := " ".join(x.split()) if "  " in x else x.strip(" ")) >= least]


def _node(line: str) -> tuple[int, int]:
    """Two signed 64-bit halves of a hash: the node, and its twin, which differs where unequal lines share a node."""
    return struct.unpack(">qq", _digest(line))


def _digest(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("row_key"), F.col("text").cast("string").alias("text"))


def _lines(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_lines_from(text, least) for text in texts_of(batch)]
        each = [len(x) for x in found]
        squeezed_ = [s for lines in found for _, s in lines]
        halves = np.frombuffer(b"".join([_digest(s) for s in squeezed_]), ">i8").reshape(-1, 2).astype(np.int64)
        columns = [
            np.repeat(np.arange(len(each)), each), np.fromiter((i for lines in found for i, _ in lines), np.int32, len(squeezed_)), halves[:, 0], halves[:, 1],
            np.fromiter(map(len, squeezed_), np.int32, len(squeezed_)),
        ]
        owner = pa.array(columns[0])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), *[pa.array(c) for c in columns[1:]]], schema=_LINES)


def line_signatures(lines: list[str]) -> np.ndarray:
    """(lines, HASHES) minhashes of the character shingles of lines that aren't empty; a line of fewer characters than a shingle is one."""
    lines = [x if len(x) >= CHARS else x.ljust(CHARS, "\0") for x in lines]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    n = len(codes) - CHARS + 1
    h = np.zeros(n, np.uint32)
    for k in range(CHARS):
        h ^= h >> np.uint32(15)
        h += codes[k : k + n]
        h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    inside = np.ones(len(codes), bool)
    for k in range(1, CHARS):
        inside[np.cumsum(sizes) - k] = False
    counts = sizes - CHARS + 1
    return min_hashes(h[inside[:n]], np.cumsum(counts) - counts, HASHES)


def band_keys(made: np.ndarray) -> np.ndarray:
    """(lines, BANDS) keys of signatures."""
    keys = np.empty((len(made), BANDS), np.uint64)
    for b, places in enumerate(np.array_split(np.arange(HASHES), BANDS)):
        h = np.full(len(made), b, np.uint64)
        for p in places:
            h = h * np.uint64(0x9E3779B97F4A7C15) + made[:, p].astype(np.uint64) + np.uint64(1)
        keys[:, b] = mixed(h)
    return keys


def checks_of(made: np.ndarray) -> np.ndarray:
    """(lines, words): one bit of each of the first CHECK_BITS hashes."""
    return np.packbits((made[:, :CHECK_BITS] & 1).astype(np.uint8), axis=1).view("<u4")


def sharp_checks(made: np.ndarray) -> np.ndarray:
    """(lines, words): 8 bits of each hash."""
    return made.astype(np.uint8).view("<u4")


def _unequal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.count_nonzero(np.ascontiguousarray(a ^ b).view(np.uint8), axis=-1)


def _sharp(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            made = np.concatenate(list(_signatures([squeezed(x) for x in texts_of(batch)])))
            yield packed(batch.column(0).to_numpy(), band_keys(made), sharp_checks(made), cells)


def sharp_groups(members: DataFrame) -> DataFrame:
    """sharpened() by all minhashes of the lines."""
    cells = cells_of(members)
    return sharpened(members, lambda batches: _sharp(batches, cells), HASHES // 4, _unequal, SHARP_MOST)


def _banded(batches: Iterator[pa.RecordBatch], least: int, cells: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        distinct = {_node(s)[0]: s for text in texts_of(batch) for _, s in _lines_from(text, least)}
        if not distinct:
            continue
        nodes, lines = np.fromiter(distinct, np.int64, len(distinct)), list(distinct.values())
        for a in range(0, len(lines), SIGNED):
            made = np.concatenate(list(_signatures(lines[a : a + SIGNED])))
            yield packed(nodes[a : a + SIGNED], band_keys(made), checks_of(made), cells)


def _signatures(lines: list[str], chars: int = 60_000) -> Iterator[np.ndarray]:
    """line_signatures() of lines in parts of about `chars` characters, which fit a processor's cache."""
    part, held = [], 0
    for line in lines:
        part.append(line)
        held += len(line)
        if held > chars:
            yield line_signatures(part)
            part, held = [], 0
    if part:
        yield line_signatures(part)


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def removed_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(row_key, gone): the numbers of the lines of a document that are copies of a line that stays; documents without are left out."""
    spark = docs.sparkSession
    bound_batches(spark)
    keyed = _keyed(docs)
    lines = written(keyed.mapInArrow(lambda batches: _lines(batches, least), "doc_id long, row_key binary, line int, node long, twin long, weight int"), "lines")
    cells = cells_of(docs)
    groups = candidate_groups(keyed.select("text").mapInArrow(lambda batches: _banded(batches, least, cells), CELLS_DDL), CHECK_BITS // 32, _differing, MOST)
    # a frequent line's places are put together before they are shuffled
    places = lines.groupBy("node").agg(F.min(F.struct("row_key", "line", "twin")).alias("p"), F.max("weight").alias("weight"))
    chosen = written(places.join(groups.withColumnRenamed("component", "group"), "node").select("node", "p.twin", "p.row_key", "p.line", "weight", "group"), "chosen")
    wanted = chosen.groupBy("row_key").agg(F.collect_list(F.struct("line", "node", "weight", "group")).alias("wanted"))
    texts = (
        keyed.select("row_key", "text").join(wanted, "row_key")
        # the lines of a text are bound once for all that are wanted of it
        .select(F.expr("inline(transform(array(split(text, '\\n', -1)), x -> transform(wanted, w -> named_struct('node', w.node, 'group', w.group, 'weight', w.weight, 'text', x[w.line])))[0])"))
        .dropDuplicates(["node"])
    )
    linked = resolve(texts, lambda texts: char_shingle_sets([squeezed(x) for x in texts], CHARS), PERCENT, sharp_groups)
    linked = written(linked.join(chosen.select("node", "twin"), "node"), "linked")
    # a class is a component, or a line by both halves of its hash
    alone = F.col("component").isNull()
    own = lines.join(linked, ["node", "twin"], "left").select("doc_id", "row_key", "line", F.coalesce("component", "node").alias("class"), F.when(alone, F.col("twin")).otherwise(0).alias("twin"), alone.alias("alone"))
    own = written(own, "classes")
    keys = ["class", "twin", "alone"]
    first = own.groupBy(*keys).agg(F.min(F.struct("doc_id", "row_key", "line")).alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    first = written(first.select(*keys, F.col("__first.row_key").alias("__key"), F.col("__first.line").alias("__line")), "first")
    gone = own.join(first, keys).where(~((F.col("row_key") == F.col("__key")) & (F.col("line") == F.col("__line"))))
    return gone.groupBy("row_key").agg(F.collect_set("line").alias("gone"))


def _left(gone: str) -> str:
    """SQL: the text without the lines whose numbers the column holds. The lines are bound once, and set difference takes time linear in them."""
    return f"if({gone} is null, text, transform(array(split(text, '\\n', -1)), x -> array_join(transform(array_except(sequence(0, size(x) - 1), {gone}), i -> x[i]), '\n'))[0])"


def dedup_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, n_chars (of what is left) and kept_sha256."""
    gone = written(removed_lines(docs, least), "gone")
    text = F.coalesce(F.expr(_left("gone")), F.lit(""))
    return _keyed(docs).join(gone, "row_key", "left").select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.length(text).cast("long").alias("n_chars"),
        F.sha2(text, 256).alias("kept_sha256"),
    )


def drop_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs without the lines that are copies; a document that loses all its text goes. n_chars follows the text if there is such a column."""
    key, gone, left = (unused(docs, c) for c in ("key", "gone", "left"))
    removed = written(removed_lines(docs, least), "gone").select(F.col("row_key").alias(key), F.col("gone").alias(gone))
    kept = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))).join(removed, key, "left")
    kept = kept.withColumn(left, F.expr(_left(f"`{gone}`"))).where(F.col(gone).isNull() | (F.trim(left) != ""))
    columns = [F.col(left).alias("text") if c == "text" else F.when(F.col(gone).isNull(), F.col(f"`{c}`")).otherwise(F.length(left)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return kept.select(*columns)
