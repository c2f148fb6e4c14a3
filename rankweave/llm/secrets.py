"""Secret scans over a trigram inverted index, with DataFrame and SQL functions only.

Each rule's regular expression gives a Boolean query of trigrams that every match must hold (in lower case): alternatives, of which each is a set of trigrams. The index has the
postings (trigram, document) of the trigrams that some query names. A rule's candidates are the documents in which the postings of all trigrams of one of its
alternatives meet; the rule's expression is then run on the candidates' whole texts. A rule without mandatory trigrams is run on all texts.

A match stands leftmost and doesn't overlap an earlier one of its rule. Its place follows from the lengths of the pieces between matches and of the matches, summed by a window over
the document's matches. Only texts that hold the rarest trigram of some alternative are shuffled to meet their candidates. Postings are short rows that meet by document, so a
frequent trigram is no hot key.

Defined results: a null or empty text has no secrets; a null id stays; repeated rows get equal rows; other columns don't matter to scan() and go through redact() unchanged;
an empty table gives an empty result. Places are code points.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.common import ascii_lower, row_key, unused, written

_parser = re._parser  # type: ignore[attr-defined]  # the standard library's own reading of an expression


@dataclass(frozen=True)
class Rule:
    """Matches of pattern whose group (0: all of it) has at least `least` characters. The pattern means the same to Java and to Python."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def any_case(word: str) -> str:
    """An expression for the ASCII word in either case, letter by letter."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMED = "|".join(map(any_case, ["password", "passwd", "secret", "token", "api_?key"]))

#: The kinds of the contract, in its order.
BASE = [
    Rule("assign", rf"""({_NAMED})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]{32,}"),
]
#: Others, of published formats.
MORE = [
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", "[rs]k_(live|test)_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url", r"://[A-Za-z0-9._-]+:[A-Za-z0-9._-]+@"),
]
RULES = BASE + MORE

#: A class of more characters, or a join of more strings, isn't spelled out.
MOST_CHARS, MOST_STRINGS = 8, 64

#: A Boolean query: any of some sets of trigrams. ANY holds for every text.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])


def _either(*queries: Query) -> Query:
    sets = frozenset().union(*queries)
    return frozenset(s for s in sets if not any(t < s for t in sets))


def _both(a: Query, b: Query) -> Query:
    return _either(frozenset(x | y for x, y in product(a, b)))


def _of_strings(strings: set[str]) -> Query:
    return _either(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _read(node: tuple) -> tuple[set[str] | None, Query]:
    """Of one node of a parsed expression: the strings that it can be, if they are few, and what else its matches must hold."""
    kind, value = node
    name = str(kind)
    if name == "LITERAL":
        return {chr(value).lower()}, ANY
    if name == "IN" and all(str(k) in ("LITERAL", "RANGE") for k, _ in value):
        size = sum(1 if str(k) == "LITERAL" else v[1] - v[0] + 1 for k, v in value)
        if size <= MOST_CHARS:
            return {chr(c).lower() for k, v in value for c in ([v] if str(k) == "LITERAL" else range(v[0], v[1] + 1))}, ANY
    if name == "SUBPATTERN":
        return _sequence(list(value[-1]))
    if name == "BRANCH":
        read = [_sequence(list(x)) for x in value[1]]
        if all(s is not None and q == ANY for s, q in read):
            return set().union(*[s for s, _ in read]), ANY
        return None, _either(*[q if s is None else _both(_of_strings(s), q) for s, q in read])
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        least, most, body = value
        strings, query = _sequence(list(body))
        if (least, most) == (0, 1) and strings is not None and query == ANY:
            return strings | {""}, ANY
        return None, (query if strings is None else _both(_of_strings(strings), query)) if least else ANY
    return None, ANY


def _sequence(nodes: list[tuple]) -> tuple[set[str] | None, Query]:
    """As _read() for nodes that follow each other: neighbours with few strings are joined before trigrams are taken."""
    query, joined, whole = ANY, {""}, True
    for node in nodes:
        strings, held = _read(node)
        query = _both(query, held)
        if strings is not None and len(joined) * len(strings) <= MOST_STRINGS:
            joined = {a + b for a in joined for b in strings}
            continue
        query = _both(query, _of_strings(joined))
        joined, whole = strings or {""}, False
    return (joined, query) if whole else (None, _both(query, _of_strings(joined)))


def trigram_query(pattern: str) -> Query:
    """Sets of lower-case trigrams, of which every match of the pattern holds at least one set; ANY without mandatory trigrams."""
    strings, query = _sequence(list(_parser.parse(pattern)))
    return query if strings is None else _both(query, _of_strings(strings))


def _holds(text: Column, trigrams: list[str]) -> Column:
    """Those of the trigrams that the text holds in lower case; the lowered text is bound once."""
    return F.transform(F.array(ascii_lower(text)), lambda x: F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(x, t)))[0]


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, key) of the documents' keys, each row's key as row_key() has it; in each file sorted by trigram."""
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    found = rows.select("key", F.explode(_holds(F.col("text"), trigrams)).alias("trigram"))
    return written(found.select("trigram", "key").sortWithinPartitions("trigram", "key"), "postings")


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(key, kinds): the rules whose trigram queries a document meets, by intersection of postings."""
    terms = [(t, kind, k, len(s)) for kind, query in queries.items() for k, s in enumerate(sorted(query, key=sorted)) for t in s]
    terms = index.sparkSession.createDataFrame(terms, "trigram string, kind string, alternative int, need int")
    met = index.join(F.broadcast(terms), "trigram").groupBy("key", "kind", "alternative", "need").agg(F.count_distinct("trigram").alias("n")).where("n = need")
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _matches_of(rule: Rule) -> Column:
    """Of the column text: an array of the rule's matches, in order."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group)))
    made = F.transform(zipped, lambda x, i: F.struct(F.lit(rule.kind).alias("kind"), i.alias("i"), F.length(x["0"]).alias("gap"), F.length(x["1"]).alias("size"), F.length(x["2"]).alias("part")))
    return F.filter(made, lambda x: x["size"].isNotNull())


def _matches(rows: DataFrame, rules: list[Rule], wanted: str | None) -> DataFrame:
    """(key, kind, i, gap, size, part) of all matches of the rules: characters since the match before, of the match, and of its group. wanted: a column with the kinds to look for."""
    none = F.expr("cast(array() as array<struct<kind: string, i: int, gap: int, size: int, part: int>>)")
    tried = [F.array_contains(wanted, r.kind) if wanted else F.rlike("text", F.lit(r.pattern)) for r in rules]
    return rows.select("key", F.inline(F.concat(*[F.when(t, _matches_of(r)).otherwise(none) for t, r in zip(tried, rules, strict=True)])))


def find(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(key, kind, start, end) of the secrets of each distinct row, key as row_key() has it, end exclusive."""
    rules = RULES if rules is None else rules
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) != ANY}
    indexed, others = [r for r in rules if r.kind in queries], [r for r in rules if r.kind not in queries]
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = []
    if indexed:
        index = trigram_index(docs, sorted({t for q in queries.values() for s in q for t in s}))
        # one count for each trigram that a rule names
        counts = dict(index.groupBy("trigram").count().collect())
        rarest = sorted({min(s, key=lambda t: (counts.get(t, 0), t)) for q in queries.values() for s in q})
        texts = rows.where(F.size(_holds(F.col("text"), rarest)) > 0)
        found.append(_matches(texts.join(candidates(index, queries), "key"), indexed, "kinds"))
    if others:
        hit = F.lit(False)
        for rule in others:
            hit = hit | F.rlike("text", F.lit(rule.pattern))
        found.append(_matches(rows.where(hit), others, None))
    made = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    made = made.dropDuplicates(["key", "kind", "i"])
    order = Window.partitionBy("key", "kind").orderBy("i")
    start = F.sum(F.col("gap") + F.col("size")).over(order) - F.col("size")
    kept = F.lit(False)
    for rule in rules:
        kept = kept | ((F.col("kind") == rule.kind) & (F.col("part") >= rule.least))
    return made.withColumn("start", start.cast("long")).where(kept).select("key", "kind", "start", (F.col("start") + F.col("size")).alias("end"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kinds(kinds: list[str]) -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(kinds))


def scan(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Per document: doc_id, n_<kind> of each rule, base_sha256 (of the rules of BASE) and spans: kind:start:end by start, then kind as listed."""
    rules = RULES if rules is None else rules
    kinds = [r.kind for r in rules]
    found = find(docs, rules).withColumn("place", F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")))
    spans = F.array_sort(F.collect_list(F.struct("start", "place", "kind", "end")))
    found = written(found.groupBy("key").agg(spans.alias("spans")), "secrets")
    of_kind = [F.size(_of_kinds([k])).cast("long").alias(f"n_{k}") for k in kinds]
    base = [r.kind for r in rules if r in BASE]
    own = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id").join(found, "key", "left")
    own = own.withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start: bigint, place: bigint, kind: string, end: bigint>>)")))
    digest = F.sha2(_joined(_of_kinds(base)), 256).alias("base_sha256")
    return own.select("doc_id", *of_kind, digest, _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """docs with each run of overlapping or touching secrets replaced by the kind of its first in angle brackets; other columns as they are."""
    row, key, cuts = (unused(docs, c) for c in ("row", "key", "cuts"))
    rules = RULES if rules is None else rules
    found = find(docs, rules).withColumn("place", F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind")))
    order = Window.partitionBy("key").orderBy("start", "place")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order))
    runs = runs.groupBy("key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "place")).alias("kind"))
    last = F.coalesce(F.lag("end").over(Window.partitionBy("key").orderBy("run")), F.lit(0))
    runs = runs.withColumn("from", last).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("from", "start", "kind", "end"))).alias("cuts"))
    runs = written(runs.select(F.col("key").alias(key), F.col("cuts").alias(cuts)), "cuts")
    pieces = F.transform(cuts, lambda c: F.concat(F.substring(F.col("text"), (c["from"] + 1).cast("int"), (c["start"] - c["from"]).cast("int")), F.lit("<"), c["kind"], F.lit(">")))
    rest = F.expr(f"substring(text, cast(element_at(`{cuts}`, -1).end as int) + 1)")
    text = F.when(F.col(cuts).isNull(), F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), rest))
    joined = docs.withColumn(row, row_key(F.col("doc_id"), F.col("text"))).join(runs, F.col(row) == F.col(key), "left")
    return joined.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])


def _sql() -> str:
    """The rows of scan() in DuckDB SQL: every rule on every text."""
    found = []
    for place, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        found.append(f"""
  SELECT k, '{rule.kind}' AS kind, {place} AS place, s.start, s.start + len(found[i]) AS stop FROM (
    SELECT k, found, parts, i, list_sum(list_transform(gaps[1:i], lambda x: len(x)))::BIGINT + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: len(x))), 0)::BIGINT AS start
    FROM (SELECT k, gaps, found, parts, unnest(range(1, len(found) + 1)) AS i
          FROM (SELECT k, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS found, regexp_extract_all(text, '{pattern}', {rule.group}) AS parts FROM d))) AS s
  WHERE len(parts[i]) >= {rule.least}""")
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = '{r.kind}'), 0) AS n_{r.kind}" for r in RULES)
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    joined = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place){}, '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(found)})
SELECT doc_id, {counts}, sha256({joined.format(f" FILTER (kind IN ({base}))")}) AS base_sha256, {joined.format("")} AS spans
FROM d LEFT JOIN m USING (k) GROUP BY k, doc_id
"""


ORACLE_SQL = _sql()
