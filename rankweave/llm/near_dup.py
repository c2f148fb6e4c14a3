"""MinHash near-duplicates by a multi-index Hamming join.

A document's distinct 5-word shingles give SYMBOLS b-bit minhashes (BITS bits each). Signatures are split into CHUNKS chunks; by the pigeonhole
principle two signatures that differ in at most DISTANCE symbols agree in some chunk but for DISTANCE // CHUNKS symbols, so each chunk is entered under
every way to leave out that many of its symbols, and every pair within the distance shares an entry. (At a Jaccard similarity of 0.75, 22 or more of 40 symbols differ
with probability below 0.0001.) Signatures that share an entry are compared, near ones form candidate groups, and the links of a group are decided on
the full shingle sets: 100 * intersection >= 75 * union. Components of links are found by distributed star steps.

Equal shingle sets are one node from the start, so copies never meet in pairs. A node is 64 bits of a hash of its set; 64 others, the twin, tell
unequal sets of one node apart.

Defined results: a null text, or one without words, has no shingles and is linked with nothing; rows with equal doc_id and
text are one document; a null doc_id takes part in links, sorts after every id and has component_id null only where its whole component has null ids, and is kept then.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import bound_batches, row_key, texts_of, unused, written
from rankweave.llm.similar import CELLS_DDL, Powers, candidate_groups, cells_of, min_hashes, mixed, packed, resolve, set_hash, word_shingles

WORDS = 5
PERCENT = 75
SYMBOLS, BITS, CHUNKS, DISTANCE = 40, 16, 11, 21

_SIGNED = pa.schema([("doc_id", pa.int64()), ("row_key", pa.binary()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("twin", pa.int64()), ("signature", pa.binary())])


def _sets_of(texts: list[str]) -> list[np.ndarray]:
    powers = Powers()
    return [word_shingles(x, powers, WORDS) for x in texts]


def signatures(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, row_key, n_shingles, node and twin (hashes of the shingle set) and signature; the last three null without shingles."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            sets = [word_shingles(x, powers, WORDS) for x in texts_of(batch)]
            full = [s for s in sets if len(s)]
            signed: Iterator[bytes] = iter(())
            if full:
                sizes = np.fromiter(map(len, full), np.int64, len(full))
                made = min_hashes((np.concatenate(full) >> np.uint64(32)).astype(np.uint32), np.cumsum(sizes) - sizes, SYMBOLS)
                signed = iter([x.tobytes() for x in (made & np.uint32((1 << BITS) - 1)).astype("<u2")])
            halves = [set_hash(s) if len(s) else (None, None) for s in sets]
            columns = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([node for node, _ in halves], pa.int64()),
                pa.array([twin for _, twin in halves], pa.int64()),
                pa.array([next(signed) if len(s) else None for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], schema=_SIGNED)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("row_key"), F.col("text").cast("string").alias("text"))
    return keyed.mapInArrow(run, "doc_id long, row_key binary, n_shingles long, node long, twin long, signature binary")


def entries(symbols: np.ndarray) -> np.ndarray:
    """(signatures, keys): the chunks of each signature with every way to leave out the allowed errors."""
    keys, errors = [], DISTANCE // CHUNKS
    for c, places in enumerate(np.array_split(np.arange(symbols.shape[1]), CHUNKS)):
        for out in combinations(places.tolist(), errors):
            h = np.full(len(symbols), c, np.uint64)
            for p in places:
                h = h * np.uint64(0x9E3779B97F4A7C15) + (np.uint64(0) if p in out else symbols[:, p].astype(np.uint64) + np.uint64(1))
            keys.append(mixed(h))
    return np.stack(keys, 1)


CHECK_WORDS = SYMBOLS // 8


def checks_of(symbols: np.ndarray) -> np.ndarray:
    """(signatures, CHECK_WORDS): the low four bits of each symbol."""
    low = (symbols & 15).astype(np.uint8)
    return np.ascontiguousarray(low[:, ::2] << 4 | low[:, 1::2]).view("<u4")


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing symbols by their low four bits: never more than by the whole symbols."""
    x = a ^ b
    x |= x >> np.uint32(2)
    x |= x >> np.uint32(1)
    return np.bitwise_count(x & np.uint32(0x11111111)).sum(-1, dtype=np.int64)


def _entered(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = batch.column(0).to_numpy(zero_copy_only=False)
        nodes, first = np.unique(nodes, return_index=True)
        if len(nodes):
            raw = batch.column(1).to_pylist()
            symbols = np.frombuffer(b"".join(raw[i] for i in first), "<u2").reshape(len(nodes), SYMBOLS)
            yield packed(nodes, entries(symbols), checks_of(symbols), cells)


def near_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signatures table, and (node, twin, component) of the nodes with links."""
    signed = written(signatures(docs), "signatures")
    some = signed.where("n_shingles > 0")
    cells = cells_of(docs)
    groups = candidate_groups(some.select("node", "signature").mapInArrow(lambda batches: _entered(batches, cells), CELLS_DDL), CHECK_WORDS, _differing, DISTANCE)
    chosen = some.groupBy("node").agg(F.min("row_key").alias("row_key"), F.min_by("twin", "row_key").alias("twin"), F.max("n_shingles").alias("weight"))
    chosen = written(chosen.join(groups.withColumnRenamed("component", "group"), "node"), "chosen")
    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row_key"), F.col("text").cast("string").alias("text"))
    # one plan at every size: the candidates grow with the documents
    members = texts.join(chosen.hint("merge"), "row_key").dropDuplicates(["node"])
    linked = resolve(members, _sets_of, PERCENT)
    return signed, linked.join(chosen.select("node", "twin"), "node")


def _own(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, row_key, n_shingles, class (a component, or a shingle set by both halves of its hash); the last null without shingles."""
    signed, linked = near_components(docs)
    alone = F.col("component").isNull()
    named = F.struct(F.coalesce("component", "node").alias("node"), F.when(alone, F.col("twin")).otherwise(0).alias("twin"), alone.alias("alone"))
    own = signed.join(linked, ["node", "twin"], "left").select("doc_id", "row_key", "n_shingles", F.when(F.col("node").isNotNull(), named).alias("class"))
    return written(own, "classes")


def _classed(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, row_key, n_shingles, component_id."""
    own = _own(docs)
    least = written(own.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("__least")), "least")
    return own.join(least, "class", "left").select("doc_id", "row_key", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("__least")).alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    return _classed(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group, with its own columns: the one of the smallest doc_id, ids before none, then of the smallest row key. Repeated rows are one."""
    own = _own(docs)
    first = own.where("class is not null").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("__first"))
    first = written(first.select("class", F.col("__first.row_key").alias("__stays")), "first")
    gone = own.join(first, "class").where("row_key <> __stays").select(F.col("row_key").alias("__key")).distinct()
    again = written(own.groupBy("row_key").count().where("count > 1").select(F.col("row_key").alias("__key")), "again")
    row, key = unused(docs, "row"), unused(docs, "key")
    gone, again = gone.withColumnRenamed("__key", key), again.withColumnRenamed("__key", key)
    kept = docs.withColumn(row, row_key(F.col("doc_id"), F.col("text"))).join(gone, F.col(row) == F.col(key), "left_anti")
    single = kept.join(again, F.col(row) == F.col(key), "left_anti")
    repeated = kept.join(again, F.col(row) == F.col(key), "left_semi").dropDuplicates([row, "doc_id"])
    return single.unionByName(repeated).drop(row)
