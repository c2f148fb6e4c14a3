"""I-Match document fingerprints.

The lexicon holds the terms whose document frequency lies in a band (idf between ln(1/HIGH) and ln(1/LOW)). Frequencies are exact: each task counts its
documents by term, and a shuffle sums the counts. At most (mean distinct terms of a document) / LOW terms can be in the band, whatever the corpus's size; that is
the bound on what is collected and broadcast.

A fingerprint hashes the sorted distinct lexicon terms of a text once for each of SUBSETS random parts of the lexicon (a sum of the terms' numbers in that part). The parts
come in levels of falling share (RATES), so that short and long texts alike have parts in which few of their terms fall: there a partly edited text still agrees. Each part gives four
hex digits, 0000 where no term falls in it; a text without lexicon terms has a mark and a hash of itself instead. The likeness of two fingerprints
is the share of equal parts among those where either has terms, at the sparsest level with LEAST such parts.

Defined results: a null text counts as empty; documents stand in the order of doc_id (null first), ties by text; the next of the last document is the first;
equal texts have equal fingerprints and likeness 1; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import bound_batches, discard, plain_words, release, texts_of, written

LOW, HIGH = 0.01, 0.25
RATES = (1 / 2, 1 / 8, 1 / 32, 1 / 128)
PER_RATE = 48
SUBSETS = PER_RATE * len(RATES)
LEAST = 10


#: Terms that a task counts before it hands its counts on.
HELD_TERMS = 500_000


class Lexicon:
    """Terms in sorted order and, for each part of the lexicon, their 32-bit numbers there: 0 for terms that aren't in the part."""

    def __init__(self, terms: list[bytes]) -> None:
        self.number = {t: i for i, t in enumerate(sorted(terms))}
        seeds = np.array([xxhash.xxh64_intdigest(t) for t in self.number], np.uint64)
        self.weights = np.zeros((len(seeds), SUBSETS), np.uint32)
        for k in range(SUBSETS):
            with np.errstate(over="ignore"):
                x = (seeds ^ np.uint64(xxhash.xxh64_intdigest(b"subset %d" % k))) * np.uint64(0xFF51AFD7ED558CCD)
                x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            inside = (x >> np.uint64(40)).astype(np.float64) / 2**24 < RATES[k // PER_RATE]
            self.weights[inside, k] = (x[inside] & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)

    def fingerprint(self, text: str) -> str:
        number = self.number
        found = sorted([number[w] for w in set(plain_words(text)) & number.keys()])
        if not found:
            return f"-{xxhash.xxh64_hexdigest(text.encode('utf-8', 'surrogatepass'))}"
        mine = self.weights[found]
        sums = mine.sum(0, dtype=np.uint64)
        sums = (sums ^ (sums >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        digits = np.where(mine.any(0), (sums >> np.uint64(32)) % np.uint64(65535) + np.uint64(1), np.uint64(0))
        return digits.astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    if a[0] == "-" or b[0] == "-":
        return 0.0
    x, y = (np.frombuffer(s.encode(), "S4").reshape(len(RATES), PER_RATE) for s in (a, b))
    votes = (x != b"0000") | (y != b"0000")
    best = 0
    for level in range(len(RATES)):
        if votes[level].sum() >= LEAST:
            best = level
    n = int(votes[best].sum())
    return float(((x[best] == y[best]) & votes[best]).sum() / n) if n else 0.0


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> list[bytes]:
    """The terms whose document frequency over all documents is in the band."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("text").cast("string").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, counts = 0, Counter()

        def out(rows: int) -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([*counts, None], pa.binary()), pa.array([*counts.values(), rows], pa.int64())], names=["term", "n"])
            counts.clear()
            return made

        for batch in batches:
            for text in texts_of(batch):
                n += 1
                counts.update(set(plain_words(text)))
            if len(counts) > HELD_TERMS:
                yield out(0)
        yield out(n)

    sums = written(texts.mapInArrow(counted, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")), "terms")
    total = sums.where("term is null").agg(F.sum("n")).first()[0] or 0
    kept = sums.where(F.col("term").isNotNull() & (F.col("n") >= low * total) & (F.col("n") <= high * total)).select("term").collect()
    discard(sums)
    release(docs.sparkSession)
    return sorted(bytes(r["term"]) for r in kept)


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as many of the first characters of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _parts(docs: DataFrame, parts: int) -> DataFrame:
    """(part, tail, doc_id, text): documents by ranges of doc_id, each range with the document after it (the first of all after the last) as its tail.

    The ranges' first ids are the only thing that is collected: one for each range.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = sorted(set(own.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []))
    number = F.expr("0" + "".join(f" + int(doc_id >= {c})" for c in cuts) if len(cuts) < 200 else f"aggregate(array({', '.join(map(str, cuts))}), 0, (a, c) -> a + int(doc_id >= c))")
    number = F.coalesce(number, F.lit(0))  # null ids stand first
    placed = own.withColumn("part", number)
    firsts = sorted((r for r in placed.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("m")).collect()), key=lambda r: r["part"])
    if not firsts:
        return placed.select("part", F.lit(0).alias("tail"), "doc_id", "text")
    before = {firsts[i]["part"]: firsts[i - 1]["part"] for i in range(len(firsts))}
    spark = docs.sparkSession
    starts = spark.createDataFrame([(r["m"]["doc_id"], before[r["part"]]) for r in firsts], "__first long, __to int")
    tails = (
        own.join(F.broadcast(starts), F.col("doc_id").eqNullSafe(F.col("__first")))
        .groupBy("__to").agg(F.min(F.struct("doc_id", "text")).alias("d"))
        .select(F.col("__to").alias("part"), F.lit(1).alias("tail"), "d.doc_id", "d.text")
    )
    return placed.select("part", F.lit(0).alias("tail"), "doc_id", "text").unionByName(tails)


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    terms = spark.sparkContext.broadcast(lexicon(docs, low, high))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Lexicon(terms.value)
        held: tuple[int | None, str, str] | None = None
        for batch in batches:
            rows = []
            for tail, doc_id, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts_of(batch), strict=True):
                own = book.fingerprint(text)
                if held is not None:
                    changed = edited(held[1], text)
                    other = book.fingerprint(changed)
                    rows.append((held[0], len(held[1]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), held[2], other, likeness(held[2], other), likeness(held[2], own)))
                held = None if tail else (doc_id, text, own)
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)

    ordered = _parts(docs, 8 * tasks).repartition(tasks, "part").sortWithinPartitions("part", "tail", "doc_id", "text")
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
