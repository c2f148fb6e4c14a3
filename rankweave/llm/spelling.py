"""Spelling variants by pairless wildcard groups.

Words that differ in one replaced code point share a group (position, prefix, suffix). A group keeps its size and its two first words, by falling count and then by
code points, and each member takes from it what it needs: how many others there are, and the first of them. Words that differ in one inserted or deleted
code point meet where a deletion of the longer one is in the vocabulary. No pair within a group is ever a row: a word has one row for each of its places.

Words are numbered in the order (falling count, code points), so that the best of some words is the least number, and shuffles hold a key and a number. A group's size is
bounded by the alphabet (a wildcard) or by the alphabet times the places (a deletion), so there are no hot groups; a form chain is at most log(largest count) / log(TIMES)
long, as each step has TIMES the occurrences.

Defined results: a null or empty text has no words; a null id stands as the empty string in the hash; repeated rows count each time; a word without near words has
n_near 0 and is its own root; an empty table gives an empty result. A word of L code points has 2 L rows, whose keys are digests beyond SPELLED code points: time for one
word grows with the square of L, memory doesn't.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import bound_batches, discard, release, texts_of, written

#: Fewest code points and occurrences of a word.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form has at least so many times the occurrences of its variant.
TIMES = 10
#: One in EDITED pairs of document and run loses a code point.
EDITED = 31
#: Keys up to this length are the text itself.
SPELLED = 40
#: Words that a task counts before it passes them on.
HELD_WORDS = 300_000

#: Latin-1 bytes: A-Z lowered, other letters (a-z, 0xC0 up) kept, all others a space. Characters beyond Latin-1 are encoded as "?".
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def edited_run(doc_id: object, run: bytes) -> bytes:
    """The run (Latin-1, lowered), without one code point where the hash of document and run says so."""
    named = f"{'' if doc_id is None else doc_id}:".encode()
    h = zlib.crc32(run.decode("latin-1").encode(), zlib.crc32(named))
    if h % EDITED:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def passed(words: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array(words.values(), pa.int64())], names=["word", "n"])

    held: Counter = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
            runs = Counter(text.encode("latin-1", "replace").translate(_LETTERS).split())
            for run, n in runs.items():
                if len(run) >= LEAST_LENGTH:
                    word = edited_run(doc_id, run)
                    if len(word) >= LEAST_LENGTH:
                        held[word] += n
            if len(held) > HELD_WORDS:
                yield passed(held)
                held = Counter()
    yield passed(held)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n, id): the words, numbered by falling n and then code points (numbers rise, with gaps)."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    words = written(words, "words")
    # a total order gives rising numbers from one partition to the next
    numbered = written(words.orderBy(F.desc("n"), "word").withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    discard(words)
    return numbered


def _key(text: Column) -> Column:
    return F.when(F.length(text) <= SPELLED, text).otherwise(F.concat(F.lit("#"), F.md5(text.cast("binary"))))


def _groups(rows: DataFrame) -> DataFrame:
    """(key, ids): the numbers of each key's words, rising."""
    return rows.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best): how many near words a word has and the first of them; words without are left out."""
    places = words.select("id", "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    before, after = F.expr("substring(word, 1, at - 1)"), F.expr("substring(word, at + 1)")
    wild = _groups(places.select("id", _key(F.concat(before, F.lit("*"), after)).alias("key"))).where(F.size("ids") > 1)
    # size and the first two are all that a member needs of its group
    wild = wild.select("ids", F.size("ids").alias("size"), F.col("ids")[0].alias("one"), F.col("ids")[1].alias("two"))
    replaced = wild.select(F.expr("inline(transform(ids, x -> named_struct('id', x, 'n', size - 1, 'best', if(x = one, two, one))))"))
    # of a run of one letter, only the first place counts: the others give the same string
    new = F.expr("at = 1 or substring(word, at, 1) <> substring(word, at - 1, 1)")
    cut = _groups(places.where((F.length("word") > LEAST_LENGTH) & new).select("id", _key(F.concat(before, after)).alias("key")))
    met = cut.join(words.select(_key(F.col("word")).alias("key"), F.col("id").alias("of")), "key")
    shifted = met.select(F.expr("inline(concat(array(named_struct('id', of, 'n', size(ids), 'best', ids[0])), transform(ids, x -> named_struct('id', x, 'n', 1, 'best', of))))"))
    return replaced.unionByName(shifted).groupBy("id").agg(F.sum("n").cast("long").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) of the words with a form, from (id, form): each round doubles the steps that a row has taken."""
    now = written(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("id").alias("root"), F.col("root").alias("__next"))
        after = written(now.join(further, "root", "left").select("id", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = after
        if now.where("moved").isEmpty():
            return now.select("id", "root")


def spelling(docs: DataFrame) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    words = vocabulary(docs)
    near = written(near_words(words), "near")
    best = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    described = words.join(near, "id", "left").join(best, "best", "left")
    formed = F.col("form_n") >= TIMES * F.col("n")
    kept = [F.when(formed, F.col(c)).alias(c) for c in ("best", "form", "form_n")]
    described = written(described.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *kept), "described")
    release(docs.sparkSession)
    roots = _roots(described.where("best is not null").select("id", F.col("best").alias("form")))
    named = roots.join(words.select(F.col("id").alias("root"), F.col("word").alias("__root")), "root").select("id", "__root")
    return described.join(named, "id", "left").select("word", "form", F.coalesce("__root", "word").alias("root"), "n", "n_near", "form_n")


#: The same rows in DuckDB SQL. The hash is the table form of the cyclic redundancy check of the polynomial 0xEDB88320.
ORACLE_SQL = r"""
WITH tab AS (
  SELECT list(list_reduce(list_concat([b::BIGINT], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) AS r(b)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS raw FROM documents),
lowered AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM runs),
counted AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS named, run, count(*) AS c FROM lowered WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(octet_length(encode(named))), lambda i: ('0x' || substr(hex(encode(named)), 2 * i + 1, 2))::BIGINT)),
                         lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]))) AS h
  FROM counted, tab),
w AS (
  SELECT word, sum(c)::BIGINT AS n FROM (SELECT c, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS pos FROM w),
k AS (SELECT word, n, pos, substr(word, 1, pos - 1) AS a, substr(word, pos + 1) AS z FROM p),
near AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM k x JOIN k y ON x.pos = y.pos AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT k.word, w.word, w.n FROM k JOIN w ON w.word = k.a || k.z
  UNION SELECT w.word, k.word, k.n FROM k JOIN w ON w.word = k.a || k.z),
ranked AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS place FROM near),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM w LEFT JOIN ranked ON w.word = ranked.word AND place = 1),
chain AS (
  WITH RECURSIVE c(word, pos, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN f ON f.word = c.pos WHERE f.form IS NOT NULL)
  SELECT word, arg_max(pos, step) AS root FROM c GROUP BY word)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM f JOIN chain USING (word)
"""
