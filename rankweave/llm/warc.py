"""WARC records and the resolution of not-modified revisits.

A revisit record (an HTTP 304) has no body: it stands for the latest earlier full response of its canonical URL, if the validators agree. The as-of
join is split by time: in each (URL, slice of time) a window carries the last response forward, and what a slice starts with comes from the last
responses of the slices before it, one row each. Slices hold about equally many records, whatever their times; so one URL's captures spread over up to SLICES tasks.

Validators: entity tags by weak comparison if both records have one, else Last-Modified dates, else payload digests; nothing to compare is a mismatch. Of the revisit's
headers only those that a 304 may update replace or join the stored ones.

Defined results: a null URL or time never resolves (no_earlier) and never answers; of responses at one time the largest record id counts; a response at the
revisit's own time isn't earlier; header names compare in lower case, and of values whose
names differ in case only the largest counts; null headers are none; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.common import BATCH_BYTES

SLICES = 512

# Headers that a 304 response may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Query parameters that name a campaign, not a page.
TRACKING = "^(utm_[a-z]*|ref|fbclid|gclid|msclkid|mc_cid|mc_eid)(=|$)"

_URL = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def canonical_url(url: Column) -> Column:
    """Host in lower case without user, www and default port; path without a closing slash; sorted query without tracking; no scheme, no fragment."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"^(?:[^@]*@)?(?:www[0-9]*\.)?|(?::(?:80|443))?$", "")
    path = F.regexp_replace(F.regexp_extract(url, _URL, 2), "/+$", "")
    kept = F.filter(F.array_sort(F.split(F.coalesce(F.regexp_extract(url, _URL, 3), F.lit("")), "&")), lambda x: (x != "") & ~x.rlike(TRACKING))
    query = F.array_join(kept, "&")
    made = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(url.rlike(_URL), made).otherwise(F.trim(url))


def _lower_names(headers: Column) -> Column:
    pairs = F.transform(F.map_entries(F.coalesce(headers, F.expr("cast(map() as map<string, string>)"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    # sorted, so that the last of a name is the largest
    return F.aggregate(
        F.array_sort(pairs), F.expr("cast(map() as map<string, string>)"),
        lambda made, e: F.map_concat(F.map_filter(made, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))),
    )


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def _cuts_up_to(ts: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most ts."""
    if not cuts:
        return F.lit(0)
    array, step = F.array(*[F.lit(int(x)) for x in cuts]), 1 << (len(cuts).bit_length() - 1)

    def probed(by: int) -> Callable[[Column], Column]:
        return lambda n: F.when((n + by <= len(cuts)) & (F.try_element_at(array, n + by) <= ts), n + by).otherwise(n)

    found = F.array(F.lit(0))
    while step:  # each array of one element binds the value once
        found = F.transform(found, probed(step))
        step >>= 1
    return F.when(ts.isNotNull(), found[0])


def resolve_revisits(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """Per revisit: record_id, url (canonical), ts, status, source_id, headers (merged), body_sha256, n_chars.

    records: record_id bigint, url string, ts bigint, kind 'response' or 'revisit', headers map<string, string>, digest string
    (payload digest) and body string. status: resolved, no_earlier or mismatch; the other columns are null unless resolved.
    """
    rows = records.select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("url"), F.col("ts").cast("long").alias("ts"), "kind",
        _lower_names(F.col("headers")).alias("headers"), "digest",
        F.when(F.col("kind") == "response", F.sha2(F.coalesce("body", F.lit("")), 256)).alias("body_sha256"),
        F.when(F.col("kind") == "response", F.length(F.coalesce("body", F.lit("")))).cast("long").alias("n_chars"),
    )
    cuts = sorted(set(rows.select(F.percentile_approx("ts", [i / slices for i in range(1, slices)] or [0.5], 10 * slices)).first()[0] or []))
    # the number of cuts up to a time: binary search by halves of the sorted cuts
    rows = rows.withColumn("slice", _cuts_up_to(F.col("ts"), cuts))
    placed = rows.where(F.col("url").isNotNull() & F.col("ts").isNotNull())
    answer = F.when(F.col("kind") == "response", F.struct("ts", F.col("record_id").alias("source_id"), "headers", "digest", "body_sha256", "n_chars"))
    order = F.when(F.col("kind") == "response", 1).otherwise(0)
    # maps have no order: the last response of a slice is found by (ts, record_id)
    last = placed.where("kind = 'response'").groupBy("url", "slice").agg(F.max_by(answer, F.struct("ts", "record_id")).alias("own"))
    touched = placed.select("url", "slice").distinct().join(last, ["url", "slice"], "left")
    earlier = Window.partitionBy("url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    start = touched.select("url", "slice", F.last("own", ignorenulls=True).over(earlier).alias("start"))
    inside = Window.partitionBy("url", "slice").orderBy("ts", order, "record_id").rowsBetween(Window.unboundedPreceding, 0)
    carried = placed.withColumn("answer", F.last(answer, ignorenulls=True).over(inside)).where("kind = 'revisit'")
    met = carried.join(start, ["url", "slice"], "left").withColumn("answer", F.coalesce("answer", "start")).drop("start", "slice")
    lost = rows.where(F.col("kind").eqNullSafe("revisit") & (F.col("url").isNull() | F.col("ts").isNull())).drop("slice")
    met = met.unionByName(lost.withColumn("answer", F.lit(None).cast(met.schema["answer"].dataType)))
    mine, stored = F.col("headers"), F.col("answer.headers")
    tags = (mine["etag"], stored["etag"])
    dates = (mine["last-modified"], stored["last-modified"])
    digests = (F.col("digest"), F.col("answer.digest"))
    both = lambda p: p[0].isNotNull() & p[1].isNotNull()
    agree = F.when(both(tags), _weak(tags[0]) == _weak(tags[1])).when(both(dates), dates[0] == dates[1]).when(both(digests), digests[0] == digests[1]).otherwise(F.lit(False))
    status = F.when(F.col("answer").isNull(), "no_earlier").when(agree, "resolved").otherwise("mismatch")
    update = F.map_filter(mine, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)
    found = met.withColumn("status", status)
    hit = F.col("status") == "resolved"
    return found.select(
        "record_id", "url", "ts", "status", F.when(hit, F.col("answer.source_id")).alias("source_id"), F.when(hit, merged).alias("headers"),
        F.when(hit, F.col("answer.body_sha256")).alias("body_sha256"), F.when(hit, F.col("answer.n_chars")).alias("n_chars"),
    )


def header_text(headers: Column) -> Column:
    """Headers as sorted lines `name: value`."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def captures(pages: DataFrame) -> DataFrame:
    """Capture records of a page table. Of each page: a full response at ten times its id, and a revisit five later; every third page has a second
    response at three later with a tag of its own, of which every sixth page has another one at the same time, and every fourth page one after the revisit, at eight later.

    Every fifth page has a second revisit, a million later, and every fourth one at the very time of the second response. Every seventh first revisit has another entity tag, every ninth none but a
    date, and every eleventh asks for a URL that was never captured.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    none = F.lit(None).cast("string")
    day = F.concat(F.lit("day "), (F.col("page_id") % 5).cast("string"))
    tag_of = lambda html: F.concat(F.lit('"'), F.md5(html.cast("binary")), F.lit('"'))

    def full(k: int, later: int, html: Column, every: int) -> Column:
        headers = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length(html).cast("string"), F.lit("ETag"), tag_of(html), F.lit("Last-Modified"), day, F.lit("Date"), F.col("page_id").cast("string"))
        return F.when(F.col("page_id") % every == 0, F.struct((8 * F.col("page_id") + k).alias("record_id"), F.col("url").alias("url"), (10 * F.col("page_id") + later).alias("ts"), F.lit("response").alias("kind"), headers.alias("headers"), none.alias("digest"), html.alias("body")))

    date = F.create_map(F.lit("Date"), F.concat(F.lit("r"), F.col("page_id").cast("string")), F.lit("Content-Length"), F.lit("0"), F.lit("Server"), F.lit("edge"))

    def again(k: int, later: int, url: Column, headers: Column, every: int) -> Column:
        return F.when(F.col("page_id") % every == 0, F.struct((8 * F.col("page_id") + k).alias("record_id"), url.alias("url"), (10 * F.col("page_id") + later).alias("ts"), F.lit("revisit").alias("kind"), headers.alias("headers"), none.alias("digest"), none.alias("body")))

    second, third = F.concat("html", F.lit(" second")), F.concat("html", F.lit(" third"))
    latest = F.when(F.col("page_id") % 6 == 0, third).when(F.col("page_id") % 3 == 0, second).otherwise(F.col("html"))
    with_tag = lambda html: F.map_concat(date, F.create_map(F.lit("ETag"), F.concat(F.lit("W/"), tag_of(html))))
    seventh, ninth, eleventh = (F.col("page_id") % n == n - 1 for n in (7, 9, 11))
    first = F.when(seventh, F.map_concat(date, F.create_map(F.lit("ETag"), F.lit('"other"')))).when(ninth, F.map_concat(date, F.create_map(F.lit("Last-Modified"), day))).otherwise(with_tag(latest))
    made = F.array(
        full(0, 0, F.col("html"), 1), full(1, 3, second, 3), full(2, 3, third, 6), full(3, 8, second, 4),
        again(4, 5, F.when(eleventh, F.concat("url", F.lit("/never"))).otherwise(F.col("url")), first, 1),
        again(5, 1_000_003, F.col("url"), with_tag(F.when(F.col("page_id") % 4 == 0, second).otherwise(latest)), 5), again(6, 3, F.col("url"), with_tag(F.col("html")), 4),
    )
    return own.select(F.inline(F.filter(made, lambda x: x.isNotNull())))


#: resolve_revisits(captures(pages)), headers as text, in DuckDB SQL.
ORACLE_SQL = r"""
WITH p AS (SELECT page_id::BIGINT AS page_id, url, coalesce(html, '') AS html, 'day ' || (page_id % 5) AS day FROM pages),
q AS (SELECT *, CASE WHEN page_id % 6 = 0 THEN html || ' third' WHEN page_id % 3 = 0 THEN html || ' second' ELSE html END AS latest FROM p),
f AS (
  SELECT 8 * page_id AS record_id, url, 10 * page_id AS ts, day, html AS body FROM q
  UNION ALL SELECT 8 * page_id + 1, url, 10 * page_id + 3, day, html || ' second' FROM q WHERE page_id % 3 = 0
  UNION ALL SELECT 8 * page_id + 2, url, 10 * page_id + 3, day, html || ' third' FROM q WHERE page_id % 6 = 0
  UNION ALL SELECT 8 * page_id + 3, url, 10 * page_id + 8, day, html || ' second' FROM q WHERE page_id % 4 = 0),
v AS (
  SELECT 8 * page_id + 4 AS record_id, CASE WHEN page_id % 11 = 10 THEN url || '/never' ELSE url END AS url, 10 * page_id + 5 AS ts, page_id,
         CASE WHEN page_id % 7 = 6 THEN '"other"' WHEN page_id % 9 = 8 THEN NULL ELSE 'W/"' || md5(latest) || '"' END AS tag,
         CASE WHEN page_id % 7 <> 6 AND page_id % 9 = 8 THEN day END AS day FROM q
  UNION ALL SELECT 8 * page_id + 5, url, 10 * page_id + 1000003, page_id, 'W/"' || md5(CASE WHEN page_id % 4 = 0 THEN html || ' second' ELSE latest END) || '"', NULL FROM q WHERE page_id % 5 = 0
  UNION ALL SELECT 8 * page_id + 6, url, 10 * page_id + 3, page_id, 'W/"' || md5(html) || '"', NULL FROM q WHERE page_id % 4 = 0),
r AS (SELECT record_id, url, ts, NULL::BIGINT AS page_id, '"' || md5(body) || '"' AS tag, day, body, 1 AS is_full FROM f
      UNION ALL SELECT record_id, url, ts, page_id, tag, day, NULL, 0 FROM v),
s AS (
  SELECT *, regexp_extract(url, '^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$', ['h', 'p', 'q']) AS u FROM r),
c AS (
  SELECT * EXCLUDE (u, url),
         regexp_replace(regexp_replace(lower(u.h), '^(?:[^@]*@)?(?:www[0-9]*\.)?', ''), ':(?:80|443)$', '') || regexp_replace(u.p, '/+$', '')
         || coalesce('?' || nullif(array_to_string(list_filter(list_sort(string_split(coalesce(u.q, ''), '&')), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]*|ref|fbclid|gclid|msclkid|mc_cid|mc_eid)(=|$)')), '&'), ''), '') AS url
  FROM s),
j AS (
  SELECT a.record_id, a.url, a.ts, a.tag AS tag_a, a.day AS day_a, a.page_id AS page_a, b.record_id AS source, b.tag AS tag_b, b.day AS day_b, b.body,
         row_number() OVER (PARTITION BY a.record_id ORDER BY b.ts DESC NULLS LAST, b.record_id DESC) AS place
  FROM c a LEFT JOIN c b ON b.is_full = 1 AND b.url = a.url AND b.ts < a.ts WHERE a.is_full = 0),
m AS (
  SELECT *, CASE WHEN source IS NULL THEN 'no_earlier'
                 WHEN tag_a IS NOT NULL THEN CASE WHEN regexp_replace(tag_a, '^W/', '') = tag_b THEN 'resolved' ELSE 'mismatch' END
                 WHEN day_a = day_b THEN 'resolved' ELSE 'mismatch' END AS status FROM j WHERE place = 1)
SELECT record_id, url, ts, status,
       CASE WHEN status = 'resolved' THEN source END AS source_id,
       CASE WHEN status = 'resolved' THEN 'content-length: ' || strlen(body) || chr(10) || 'content-type: text/html' || chr(10) || 'date: r' || page_a || chr(10)
            || 'etag: ' || coalesce(tag_a, tag_b) || chr(10) || 'last-modified: ' || coalesce(day_a, day_b) END AS headers,
       CASE WHEN status = 'resolved' THEN sha256(body) END AS body_sha256,
       CASE WHEN status = 'resolved' THEN length(body)::BIGINT END AS n_chars
FROM m
"""


def write_record(record_id: int, url: str, ts: int, kind: str, headers: dict[str, str], body: str | None, digest: str | None = None) -> bytes:
    """One WARC/1.1 record with an HTTP message."""
    status = "200 OK" if kind == "response" else "304 Not Modified"
    message = (f"HTTP/1.1 {status}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n").encode() + (body or "").encode()
    named = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:record:{record_id}>", "WARC-Target-URI": url, "WARC-Date": str(ts), "Content-Type": "application/http;msgtype=response"}
    if digest:
        named["WARC-Payload-Digest"] = digest
    if kind == "revisit":
        named["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named.items()) + f"Content-Length: {len(message)}\r\n\r\n"
    return head.encode() + message + b"\r\n\r\n"


def _named(lines: bytes) -> dict[str, str]:
    return {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode("utf-8", "replace").split("\r\n")) if v}


#: Bytes of a file that are decompressed at a time: what a member leaves of them is read again.
CHUNK = 16 << 10


def _members(raw: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one after the other, or the file itself where it isn't compressed; a member that is cut off or broken ends it."""
    if not raw.startswith(b"\x1f\x8b"):
        yield raw
        return
    view, at = memoryview(raw), 0
    while at < len(raw):
        one, made = zlib.decompressobj(31), []
        while not one.eof and at < len(raw):
            part = view[at : at + CHUNK]
            try:
                made.append(one.decompress(part))
            except zlib.error:
                return
            at += len(part) - len(one.unused_data)
        if not one.eof:
            return
        yield b"".join(made)


def _number(name: str) -> int | None:
    """A record id as a number: the digits after the last colon, else 63 bits of a hash of the whole id."""
    digits = name.rstrip(">").rpartition(":")[2]
    if digits.isdigit() and len(digits) < 19:
        return int(digits)
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big") >> 1 if name else None


def _time(date: str) -> int | None:
    """A date as a number: digits as they are, else an ISO 8601 date in microseconds."""
    if date.isdigit() and len(date) < 19:
        return int(date)
    try:
        made = datetime.fromisoformat(date[:26].rstrip("Z") + "+00:00" if date.endswith("Z") else date)
    except ValueError:
        return None
    made = made if made.tzinfo else made.replace(tzinfo=timezone.utc)
    return (made - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def read_records(raw: bytes) -> Iterator[dict]:
    """The response and revisit records of a WARC file's bytes, plain or gzip members. A cut-off last record is left out, and so is one without a length."""
    for part in _members(raw):
        yield from _records(part)


def _records(raw: bytes) -> Iterator[dict]:
    at = 0
    while (at := raw.find(b"WARC/1.", at)) >= 0:
        end = raw.find(b"\r\n\r\n", at)
        if end < 0:
            return
        named = {k.lower(): v for k, v in _named(raw[raw.find(b"\r\n", at) + 2 : end]).items()}
        at = end + 4
        if not named.get("content-length", "").isdigit():
            continue
        size = int(named["content-length"])
        message = raw[at : at + size]
        if len(message) < size:
            return
        at += size
        if named.get("warc-type") in ("response", "revisit"):
            head, _, body = message.partition(b"\r\n\r\n")
            kind = named["warc-type"]
            yield {
                "record_id": _number(named.get("warc-record-id", "")), "url": named.get("warc-target-uri", "").strip("<>") or None, "ts": _time(named.get("warc-date", "")), "kind": kind,
                "headers": _named(head.partition(b"\r\n")[2]), "digest": named.get("warc-payload-digest"), "body": body.decode("utf-8", "replace") if kind == "response" else None,
            }


RECORDS_DDL = "record_id long, url string, ts long, kind string, headers map<string,string>, digest string, body string"


def parse_files(files: DataFrame) -> DataFrame:
    """Records of the WARC files in the binary column content, as spark.read.format('binaryFile') gives them."""
    schema = pa.schema(
        [("record_id", pa.int64()), ("url", pa.string()), ("ts", pa.int64()), ("kind", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("digest", pa.string()), ("body", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                rows, held = [], 0
                for r in read_records(raw or b""):
                    rows.append(r | {"headers": list(r["headers"].items())})
                    held += len(r["body"] or "")
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("content").mapInArrow(run, RECORDS_DDL)
