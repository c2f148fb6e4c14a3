"""Rows are told apart by id and text, nulls included."""

import hashlib

import pytest
from pyspark.sql import functions as F

from rankweave.llm import decontaminate, line_dedup, near_dup, suffix_dedup
from rankweave.llm.common import row_key

LONG = "".join(chr(97 + i * i % 23) for i in range(150)) * 3
PAIR = "doc_id long, text string"


@pytest.fixture(params=["5", LONG], ids=["short", "long"])
def rows(spark, request):
    """A null text beside a null id with the other's id as its text; and the pair the other way round with a long text."""
    text = request.param
    return text, spark.createDataFrame([(5, None), (None, text), (9, text), (None, None), (7, "")], PAIR)


def test_keys_differ(spark):
    rows = [(5, None), (None, "5"), (None, None), (5, "5"), (None, ""), (55, ""), (5, "+5"), (None, "-"), (None, ":5")]
    made = spark.createDataFrame(rows, PAIR).select(row_key(F.col("doc_id"), F.col("text")).alias("k")).collect()
    assert len({bytes(r["k"]) for r in made}) == len(rows) and {len(r["k"]) for r in made} == {16}


def test_decontamination_of_the_pair(spark, rows):
    text, docs = rows
    bench = spark.createDataFrame([("a", text)], "item_id string, text string")
    got = {(r["doc_id"], r["n_words"], r["n_hit"], r["contaminated"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {(5, 0, 0, False), (None, 1, 1, True), (9, 1, 1, True), (None, 0, 0, False), (7, 0, 0, False)}
    left = {tuple(r) for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert left == {(5, None), (None, None), (7, "")}
    cut = decontaminate.remove_spans(docs, bench).collect()
    assert sorted(map(tuple, cut), key=str) == sorted([(5, None), (None, ""), (9, ""), (None, None), (7, "")], key=str)


def test_near_copies_of_the_pair(spark, rows):
    text, docs = rows
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs).collect()}
    assert got == {(5, 0, 5), (None, 1, 9), (9, 1, 9), (None, 0, None), (7, 0, 7)}
    left = {tuple(r) for r in near_dup.keep_one(docs).collect()}
    assert left == {(5, None), (9, text), (None, None), (7, "")}


def test_lines_of_the_pair(spark, rows):
    text, docs = rows
    got = {(r["doc_id"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(docs).collect()}
    kept = {tuple(r) for r in line_dedup.drop_lines(docs).collect()}
    assert (5, 0, 0) in got and (None, 0, 0) in got and (7, 1, 0) in got
    assert sorted(n for d, _, n in got if d == 9 or (d is None and (_, n) != (0, 0))) == [0, 1]
    assert (5, None) in kept and (None, None) in kept and (7, "") in kept and len(kept & {(9, text), (None, text)}) == 1


def test_strings_of_the_pair(spark, rows):
    text, docs = rows
    gone = len(text) if len(text) >= suffix_dedup.LENGTH else 0
    digest = hashlib.sha256(b"" if gone else text.encode()).hexdigest()
    none = hashlib.sha256(b"").hexdigest()
    got = {tuple(r) for r in suffix_dedup.removed(docs).collect()}
    assert got == {(5, 0, 0, 0, none), (None, len(text), gone, int(gone > 0), digest), (9, len(text), gone, int(gone > 0), digest), (None, 0, 0, 0, none), (7, 0, 0, 0, none)}
