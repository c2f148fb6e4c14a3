"""Best-fit packing of tokenised documents into sequences by hierarchical residual packing.

Documents become pieces of at most CAPACITY tokens; full pieces are sequences of their own. The others are dealt by a hash into leaves of about LEAF_PIECES
pieces, and each leaf packs its pieces best-fit, longest first. Nearly full bins are emitted. Underfull bins go up a tree in which FAN
groups at a time merge, and are themselves the items of a best-fit round there, until one group is left.

What goes up is bounded without a loss: after a best-fit round at most one bin of a group is half full or less (two such would have been one), and two bins over half
never fit together. So only half-empty bins can still merge, at most FAN of them in a round, and the CARRIED loosest of the other bins hold a place
for each of them if any bin does.

Defined results: a null or empty text has the end id alone; equal rows are packed each for itself; an empty table gives no rows; texts of any length
are tokenised whole. Ties in length are packed in the order of (doc_id, piece, checksum).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import bound_batches, texts_of, worker_state, written

CAPACITY = 1024
END_ID = 2
LEAF_PIECES = 50_000
FAN = 8
CARRIED = 64
#: Bins this full are emitted at once.
NEARLY_FULL = 1016
#: Entries of a worker's cache of encoded chunks; it is emptied when full.
CACHE_ENTRIES = 400_000
VOCABULARY = "byte_bpe_50k"

_SPACE_RUN = re.compile(r"\s ")


class ChunkEncoder(dict):
    """Encoded ids (little-endian unsigned 32-bit) of a space and the chunk after it, by chunk.

    The tokenizer's pre-tokeniser always cuts before a space that follows a character other than white space, so such
    chunks can be encoded one by one. A text in which white space precedes a space is encoded whole, and one with the
    special token's string by the reference tokenizer, which reads it as that token.
    """

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._json = public_tokenizers.path(f"{vocabulary}.json")
        self._whole = None

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        made = np.array(self._encode(" " + chunk), "<u4").tobytes()
        if len(chunk) <= 64:
            self[chunk] = made
        return made

    def ids(self, text: str) -> bytes:
        if "<|" in text:
            from tokenizers import Tokenizer

            self._whole = self._whole or Tokenizer.from_file(self._json)
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _SPACE_RUN.search(text):
            return np.array(self._encode(text), "<u4").tobytes()
        first, *chunks = text.split(" ")
        return np.array(self._encode(first), "<u4").tobytes() + b"".join(map(self.__getitem__, chunks))


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of `total` ids; the first may be shorter."""
    first = total % capacity or capacity
    starts = [0, *range(first, total, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], total], strict=True)]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(f"encoder_{vocabulary}", lambda: ChunkEncoder(vocabulary))
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                ids = encoder.ids(text) + end
                rows += [(doc_id, k, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)])) for k, (a, n) in enumerate(cut(len(ids) // 4, capacity))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: bin and offset of each item, fill of each bin. Equal lengths keep their order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fills: list[int] = []
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if an open bin has room r
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        left = room - size
        if left:
            open_by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, fills


def pack_pieces(made: DataFrame, capacity: int = CAPACITY, leaf_pieces: int = LEAF_PIECES, fan: int = FAN) -> DataFrame:
    """The pieces with sequence_id and offset."""
    columns = made.columns
    whole = made.where(F.col("length") >= capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = made.where(F.col("length") < capacity)
    leaves = max(1, -(-part.count() // leaf_pieces))
    nearly = capacity * NEARLY_FULL // CAPACITY

    def leaf(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], na_position="first", kind="stable").reset_index(drop=True)
        bins, offsets, fills = best_fit(rows["length"].to_numpy(), capacity)
        number = int(rows["leaf"].iloc[0])
        return rows.assign(bin=(number << 40) + bins, offset=offsets, fill=np.array(fills, np.int64)[bins])

    kept_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
    # equal rows are told apart by their places in the table
    grouped = part.withColumn("leaf", F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32", F.monotonically_increasing_id()), F.lit(leaves)))
    placed = written(grouped.groupBy("leaf").applyInPandas(leaf, f"{kept_types}, leaf long, bin long, offset long, fill long"), "leaves")
    if leaves == 1:
        out = placed.select(*columns, F.col("bin").alias("sequence_id"), "offset")
        return whole.select(*columns, "sequence_id", "offset").unionByName(out)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin").reset_index(drop=True)
        bins, offsets, fills = best_fit(rows["fill"].to_numpy(), capacity)
        host = np.full(len(fills), np.iinfo(np.int64).max)
        np.minimum.at(host, bins, rows["bin"].to_numpy())
        return rows.assign(parent=host[bins], place=offsets, parent_fill=np.array(fills, np.int64)[bins])

    def carried(items: DataFrame) -> DataFrame:
        """Of (node, bin, fill): what can still merge or hold what merges."""
        from pyspark.sql import Window

        rank = F.row_number().over(Window.partitionBy("node").orderBy("fill", "bin"))
        return items.where(F.col("fill") < nearly).withColumn("__rank", rank).where(F.col("__rank") <= CARRIED + 1).drop("__rank")

    items = carried(placed.groupBy(F.col("leaf").alias("node"), "bin").agg(F.max("fill").alias("fill")))
    resolved = None  # bin -> the bin that it is in by now, and its place there
    nodes = leaves
    while nodes > 1:
        nodes = -(-nodes // fan)
        up = items.withColumn("node", F.expr(f"node div {fan}"))
        merged = written(up.groupBy("node").applyInPandas(merge, "node long, bin long, fill long, parent long, place long, parent_fill long"), "merge")
        step = merged.select("bin", "parent", "place")
        if resolved is None:
            resolved = step
        else:
            later = step.select(F.col("bin").alias("parent"), F.col("parent").alias("__to"), F.col("place").alias("__at"))
            resolved = written(
                resolved.join(later, "parent", "left").select("bin", F.coalesce("__to", "parent").alias("parent"), (F.col("place") + F.coalesce("__at", F.lit(0))).alias("place")), "resolved"
            )
        items = carried(merged.groupBy("node", F.col("parent").alias("bin")).agg(F.max("parent_fill").alias("fill")))
    out = placed.join(resolved, "bin", "left").select(*columns, F.coalesce("parent", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("place", F.lit(0))).alias("offset"))
    return whole.select(*columns, "sequence_id", "offset").unionByName(out)


def pack(docs: DataFrame, capacity: int = CAPACITY, leaf_pieces: int = LEAF_PIECES) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(written(pieces(docs, capacity), "pieces"), capacity, leaf_pieces)
