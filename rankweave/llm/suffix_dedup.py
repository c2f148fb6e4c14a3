"""Removal of repeated byte strings by bucket-pointer refinement.

A byte is removed if it lies in a LENGTH-byte string that also starts somewhere else. Equal strings have equal content, so the smallest q-gram of a
string (its anchor, by a hash, the leftmost of equals) stands at the same place in both: strings need only be
compared with those of the same anchor bucket. A run of consecutive strings with one anchor is a segment, of about 280 bytes.

1. Each document is cut into segments: anchor bucket, hash of the segment, place. Segments equal as a whole repeat
   all their strings. Buckets with one segment only repeat none. This needs no text beyond the pass over the documents.
2. Of the buckets that hold different segments, one of each is refined on its bytes: the q-gram buckets of all its
   offsets are refined by sorting on the bucket identifiers of later offsets (40, 80, 160 and then 200 bytes), each round starting from
   the identifiers that the one before has made, and offsets alone in their bucket drop out.
3. Buckets of more than HOT segments are dealt out by their strings instead, so no task holds an unbounded bucket.

Defined results: a null text counts as empty; rows with equal doc_id and text are separate documents, so all their strings
repeat each other; documents shorter than LENGTH lose nothing; matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import bound_batches, key_array, key_column, release, row_key, texts_of, unused, written
from rankweave.llm.similar import Powers, mixed

LENGTH = 200
Q = 40
#: Segments of one anchor bucket that one task may refine.
HOT = 6_000
#: Bytes of segments in a task, about.
TASK_BYTES = 2 << 20

#: Strings of a document whose anchors are searched at a time: longer documents are taken in ranges, which cuts a segment in two at most at each border.
RANGE = 1 << 24

_PLACE = np.uint64((1 << 28) - 1)


#: Values of the bytes for a second hash that doesn't depend on the first.
_OTHER = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


class Spans:
    """Hashes of any span of one byte string; table: the bytes' values, else each byte plus one."""

    def __init__(self, raw: np.ndarray, powers: Powers, table: np.ndarray | None = None) -> None:
        powers.reach(len(raw))
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        values = raw.astype(np.uint64) + np.uint64(1) if table is None else table[raw]
        np.cumsum(values * powers.up[: len(raw)], out=self.sums[1:])
        self.down = powers.down

    def fixed(self, n: int) -> np.ndarray:
        """Hashes of the n bytes from every place."""
        k = len(self.sums) - n
        return mixed((self.sums[n:] - self.sums[:k]) * self.down[:k]) if k > 0 else np.zeros(0, np.uint64)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, by running minima from both ends of blocks."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, 1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def segments(raw: np.ndarray, powers: Powers, length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a document's segments: anchor bucket, hash of the whole segment, first start and number of its strings."""
    if len(raw) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(raw) - length + 1 > RANGE:
        made = [segments(raw[a : a + RANGE + length - 1], powers, length, q) for a in range(0, len(raw) - length + 1, RANGE)]
        for k, x in enumerate(made):
            x[2][:] += k * RANGE
        return tuple(np.concatenate(x) for x in zip(*made, strict=True))
    spans = Spans(raw, powers)
    grams = spans.fixed(q)
    keyed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_least(keyed, length - q + 1) & _PLACE).astype(np.int64)
    lo = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    n = np.diff(np.r_[lo, len(at)])
    whole = spans.of(lo, lo + n - 1 + length)
    return grams[at[lo]].view(np.int64), whole.view(np.int64), lo, n


def refine(pieces: list[bytes], length: int = LENGTH, q: int = Q) -> list[np.ndarray]:
    """For each piece, its offsets at which a string of `length` bytes starts that also starts at another offset of the pieces.

    Bucket-pointer refinement over the offsets of all pieces: pointers to buckets of `span`-byte strings become pointers to buckets of
    longer ones by sorting on the pair (own bucket, bucket of a later offset).
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    total = len(raw)
    room = np.repeat(ends, sizes) - np.arange(total)  # bytes up to the end of the own piece
    powers = Powers()
    bucket = np.zeros(total, np.int64)  # 0: alone, or too near the end
    grams = np.zeros(total, np.uint64)
    if total >= q:
        for a in range(0, total - q + 1, 1 << 20):  # bounded powers
            part = raw[a : a + (1 << 20) + q - 1]
            made = Spans(part, powers).fixed(q)
            grams[a : a + len(made)] = made
    active = np.flatnonzero(room >= q)
    span = q

    def pointed(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        first = np.r_[True, ordered[1:] != ordered[:-1]]
        number = np.cumsum(first)
        shared = np.bincount(number)[number] > 1
        bucket[offsets] = 0
        bucket[offsets[order[shared]]] = number[shared]
        return np.sort(offsets[order[shared]])

    active = pointed(grams[active], active)
    while span < length:
        step = min(span, length - span)
        outside = active[room[active] < span + step]
        active = active[room[active] >= span + step]
        later = bucket[active + step]
        keys = bucket[active] << np.int64(32) | later
        alone = later == 0
        dropped = np.concatenate([outside, active[alone]])
        active, keys = active[~alone], keys[~alone]
        kept = pointed(keys, active)
        bucket[dropped] = 0
        active, span = kept, span + step
    owner = np.searchsorted(ends, active, "right")
    starts = ends - sizes
    cuts = np.searchsorted(owner, np.arange(len(pieces) + 1))
    return [active[cuts[i] : cuts[i + 1]] - starts[i] for i in range(len(pieces))]


_SEGMENTS = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("whole", pa.int64()), ("row_key", pa.binary()), ("lo", pa.int32()), ("n", pa.int32()), ("many", pa.bool_())])
_SEGMENTS_DDL = "kind int, bucket long, whole long, row_key binary, lo int, n int, many boolean"
#: Rows of kind REPEATED say that the n strings from lo on repeat; OPEN ones are to be compared; MIXED ones are to be refined on their bytes.
REPEATED, OPEN, MIXED = 0, 1, 2


def _batch(kind: int, bucket: np.ndarray, whole: np.ndarray, key: np.ndarray, lo: np.ndarray, n: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
    columns = [np.full(len(key), kind, np.int32), bucket, whole, key, lo.astype(np.int32), n.astype(np.int32), many]
    return pa.RecordBatch.from_arrays([key_column(c) if f.name == "row_key" else pa.array(c, f.type) for c, f in zip(columns, _SEGMENTS, strict=True)], schema=_SEGMENTS)


def _collapsed(bucket: np.ndarray, whole: np.ndarray, key: np.ndarray, lo: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of equal segments in one batch: all as repeated, and one to compare."""
    if not len(key):
        return
    order = np.lexsort((whole, bucket))
    bucket, whole, key, lo, n = (x[order] for x in (bucket, whole, key, lo, n))
    first = np.r_[True, (bucket[1:] != bucket[:-1]) | (whole[1:] != whole[:-1])]
    number = np.cumsum(first) - 1
    many = np.bincount(number)[number] > 1
    yield _batch(OPEN, bucket[first], whole[first], key[first], lo[first], n[first], many[first])
    if many.any():
        spread = mixed(key[many].view(np.uint64)[::2] + lo[many].astype(np.uint64)).view(np.int64)
        yield _batch(REPEATED, spread, np.zeros(len(spread), np.int64), key[many], lo[many], n[many], many[many])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        made = []
        for key, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
            if len(text) * 4 >= LENGTH:
                bucket, whole, lo, n = segments(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), powers)
                made.append((bucket, whole, np.frombuffer(key * len(lo), "V16"), lo, n))
        if made:
            yield from _collapsed(*(np.concatenate(x) for x in zip(*made, strict=True)))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (bucket, whole): equal segments as REPEATED, one of each in buckets of different ones as MIXED.

    Only the last bucket is held over between batches, and of a long one only the last segment.
    """
    held: list[np.ndarray] | None = None
    known = None  # a bucket already found to be mixed

    def closed(x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        bucket, whole, key, lo, n, many = x
        if not len(key):
            return
        new = np.r_[True, bucket[1:] != bucket[:-1]]
        first = np.r_[True, new[1:] | (whole[1:] != whole[:-1])]
        run, group = np.cumsum(first) - 1, np.cumsum(new) - 1
        repeated = (np.bincount(run)[run] > 1) | np.bincount(run, many)[run].astype(bool)
        different = (np.bincount(group, first)[group] > 1) | (bucket == known if known is not None else False)
        if repeated.any():
            yield _batch(REPEATED, bucket[repeated], whole[repeated], key[repeated], lo[repeated], n[repeated], many[repeated])
        chosen = first & different
        if chosen.any():
            yield _batch(MIXED, bucket[chosen], whole[chosen], key[chosen], lo[chosen], n[chosen], many[chosen])

    for batch in batches:
        kind = batch.column(0).to_numpy(zero_copy_only=False)
        columns = [key_array(batch.column(i)) if i == 3 else batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 7)]
        done = kind == REPEATED
        if done.any():
            yield _batch(REPEATED, *(c[done] for c in columns))
        columns = [c[~done] for c in columns]
        held = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
        if not len(held[0]):
            continue
        bucket, whole = held[0], held[1]
        tail = int(np.searchsorted(bucket, bucket[-1], "left"))
        yield from closed([x[:tail] for x in held])
        held = [x[tail:] for x in held]
        if known is not None and bucket[-1] != known:
            known = None
        if len(held[0]) > 50_000:
            last = held[1] == held[1][-1]
            if not last.all():
                known = int(held[0][0])
                yield from closed([x[~last] for x in held])
                held = [x[last] for x in held]
            if len(held[0]) > 1:  # one of these equal segments goes on, marked as repeated
                rest = [x[1:] for x in held]
                yield _batch(REPEATED, *rest[:5], np.ones(len(rest[0]), bool))
                held = [x[:1] for x in held]
                held[5] = np.ones(1, bool)
    if held is not None:
        yield from closed(held)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row_key"), F.col("text").cast("string").alias("text"))


def _compare(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "whole").mapInArrow(_compared, _SEGMENTS_DDL)


_PIECES_DDL = "bucket long, row_key binary, lo int, n int, hot boolean, piece binary"


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, text, wanted in zip(batch.column(0).to_pylist(), texts_of(batch), batch.column(2).to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            out += [(w["bucket"], key, w["lo"], w["n"], w["hot"], raw[w["lo"] : w["lo"] + w["n"] - 1 + LENGTH]) for w in wanted]
        columns = list(zip(*out, strict=True)) or [()] * 6
        types = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["bucket", "row_key", "lo", "n", "hot", "piece"])


def _refined(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["bucket", "row_key", "lo"]).reset_index(drop=True)
    keys, los, starts, runs = rows["row_key"].to_numpy(), rows["lo"].to_numpy(), [], []
    for i, found in enumerate(refine([bytes(x) for x in rows["piece"]])):
        if len(found):
            first = np.flatnonzero(np.r_[True, np.diff(found) > 1])
            n = np.diff(np.r_[first, len(found)])
            starts.append(np.full(len(first), i))
            runs.append(np.stack([found[first] + los[i], n], 1))
    if not runs:
        return pd.DataFrame({"row_key": np.zeros(0, object), "lo": np.zeros(0, np.int32), "n": np.zeros(0, np.int32)})
    run = np.concatenate(runs)
    return pd.DataFrame({"row_key": keys[np.concatenate(starts)], "lo": run[:, 0].astype(np.int32), "n": run[:, 1].astype(np.int32)})


def _by_string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to compare for each string of the pieces of unbounded buckets: strings are told apart by two hashes, 128 bits."""
    powers = Powers()
    for batch in batches:
        made = []
        for key, lo, n, piece in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 5)), strict=True):
            raw = np.frombuffer(piece, np.uint8)
            one, two = (Spans(raw, powers, t).fixed(LENGTH)[:n].view(np.int64) for t in (None, _OTHER))
            made.append((one, two, np.frombuffer(key * n, "V16"), lo + np.arange(n), np.ones(n, np.int64)))
        if made:
            yield from _collapsed(*(np.concatenate(x) for x in zip(*made, strict=True)))


def repeated_strings(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(row_key, lo, n): the n LENGTH-byte strings from byte lo on, each of which also starts elsewhere."""
    spark = docs.sparkSession
    bound_batches(spark)
    compared = written(_compare(_keyed(docs).mapInArrow(_cut, _SEGMENTS_DDL)), "compared")
    release(spark)
    repeated = compared.where(F.col("kind") == REPEATED).select("row_key", "lo", "n")
    mixed_rows = compared.where(F.col("kind") == MIXED).select("bucket", "row_key", "lo", "n")
    counts = mixed_rows.groupBy("bucket").agg(F.count("*").alias("__n")).where(F.col("__n") > hot).select("bucket", F.lit(True).alias("hot"))
    counts = written(counts, "hot")
    wanted = mixed_rows.join(counts, "bucket", "left").groupBy("row_key").agg(F.collect_list(F.struct("bucket", "lo", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted"))
    pieces = written(_keyed(docs).join(wanted, "row_key").select("row_key", "text", "wanted").mapInArrow(_fetched, _PIECES_DDL), "pieces")
    release(spark)
    size = pieces.agg(F.sum(F.col("n") + LENGTH)).first()[0] or 0
    tasks = max(1, -(-size // TASK_BYTES))
    refined = pieces.where("not hot").withColumn("task", F.pmod(F.xxhash64("bucket"), F.lit(tasks))).groupBy("task").applyInPandas(_refined, "row_key binary, lo int, n int")
    by_string = _compare(pieces.where("hot").mapInArrow(_by_string, _SEGMENTS_DDL)).where(F.col("kind") == REPEATED).select("row_key", "lo", "n")
    return repeated.unionByName(refined).unionByName(by_string)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def removed_spans(spans: np.ndarray) -> np.ndarray:
    """Maximal byte runs [start, end) that (lo, n) string runs cover; touching runs are one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    starts, ends = spans[:, 0], np.maximum.accumulate(spans[:, 0] + spans[:, 1] - 1 + LENGTH)
    first = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]])
    return np.stack([starts[first], ends[np.r_[first[1:] - 1, len(ends) - 1]]], 1)


def _kept(raw: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    if not spans:
        return raw, 0
    gone = removed_spans(np.array([(x["lo"], x["n"]) for x in spans], np.int64))
    at, parts = 0, []
    for a, b in gone.tolist():
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]]), len(gone)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(batch.column(0).to_pylist(), texts_of(batch), batch.column(2).to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            left, n = _kept(raw, spans)
            rows.append((doc_id, len(raw), len(raw) - len(left), n, hashlib.sha256(left).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)


def _with_spans(docs: DataFrame, hot: int) -> tuple[DataFrame, str]:
    """docs with a column of their repeated spans, and that column's name."""
    row, key, spans = (unused(docs, c) for c in ("row", "key", "spans"))
    found = written(repeated_strings(docs, hot).groupBy(F.col("row_key").alias(key)).agg(F.collect_set(F.struct("lo", "n")).alias(spans)), "spans")
    release(docs.sparkSession)
    keyed = docs.withColumn(row, row_key(F.col("doc_id"), F.col("text")))
    return keyed.join(found, F.col(row) == F.col(key), "left"), spans


def removed(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined, spans = _with_spans(own, hot)
    return joined.select("doc_id", "text", spans).mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """docs with the repeated bytes cut out of text; a character of which a part is cut is decoded as U+FFFD. Other columns as they are."""

    @F.pandas_udf("string")
    def left(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _kept(x.encode("utf-8", "surrogatepass"), None if s is None else list(s))[0].decode("utf-8", "replace") for x, s in zip(text, spans, strict=True)])

    joined, spans = _with_spans(docs, hot)
    return joined.withColumn("text", left("text", spans)).select(*[F.col(f"`{c}`") for c in docs.columns])


#: The rows of removed() in DuckDB SQL, over hexadecimal text.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT k, i, md5(substr(h, 2 * i + 1, 400)) AS g FROM (SELECT k, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)),
r AS (SELECT k, i FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(*) > 1)),
s AS (SELECT k, i, i - lag(i) OVER (PARTITION BY k ORDER BY i) AS gap FROM r),
t AS (SELECT k, i, sum(CASE WHEN gap IS NULL OR gap > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS span FROM s),
spans AS (SELECT k, min(i) AS a, max(i) + 200 AS b FROM t GROUP BY k, span),
cuts AS (
  SELECT k, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS f, a AS e FROM spans
  UNION ALL SELECT spans.k, max(b), any_value(length(h) // 2) FROM spans JOIN d USING (k) GROUP BY spans.k),
kept AS (SELECT k, string_agg(substr(h, 2 * f + 1, 2 * (e - f)), '' ORDER BY f) AS left_hex FROM cuts JOIN d USING (k) GROUP BY k),
n AS (SELECT k, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY k)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(left_hex, h))) AS kept_sha256
FROM d LEFT JOIN n USING (k) LEFT JOIN kept USING (k)
"""
