"""Quality, licences, fingerprints, HTML, WARC and decontamination: brute force, round trips and hard inputs."""

import gzip
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.llm import decontaminate, fingerprint, html_extract, license_scan, quality, warc
from rankweave.llm.common import plain_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


def lowered(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


HARD = [None, "", " \n\t ", "a", "\x00\x01", "É ß İ ﬀ 𝔘nicode ÀB", "x" * 300_000, "The MIT License. " * 3, "word " * 4000, "the same", "the same"]


def test_words_match_the_pattern():
    for t in HARD:
        assert [w.decode() for w in plain_words(t or "")] == WORD.findall(lowered(t))


# quality


def labelled(n=400, seed=0):
    rng = random.Random(seed)
    words = ["tion", "ander", "the", "of", "ering", "hathe", "and", "whole", "is"]
    texts, marks = [], []
    for i in range(n):
        good = i % 3 > 0
        body = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        texts.append(" ".join(body) + "." if good else " ".join(w.upper() + "!!" for w in body))
        marks.append(int(good))
    return texts, marks


def test_quality_learns_and_ignores_held_out_labels(spark):
    texts, marks = labelled()
    docs = docs_of(spark, texts)
    rows = [(i, m, 0) for i, m in enumerate(marks)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert np.mean([got[i]["predicted"] == marks[i] for i in got if got[i]["held_out"]]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    lying = spark.createDataFrame([(i, 1 - m if zlib.crc32(str(i).encode()) % 4 == 2 else m, 0) for i, m in enumerate(marks)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, lying).collect()} == {i: r["score"] for i, r in got.items()}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}


def test_quality_hard_inputs(spark):
    texts, marks = labelled(120)
    docs = docs_of(spark, [*texts, *HARD], [*range(120), *range(200, 199 + len(HARD)), None]).withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([*[(i, m, 0) for i, m in enumerate(marks)], (0, None, 0), (None, 1, 0), (5, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.where("score is null or held_out is null").count() == 0 and got.count() == 120 + len(HARD)
    assert quality.quality_scores(docs, labels.limit(0)).where("score <> 1").count() == 0
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_flat_forest_equals_walking_the_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 5))
    forest = quality.fit(x, (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float), trees=10, depth=3)
    for row, got in zip(x[:50], forest.score(x[:50]), strict=True):
        total = forest.base
        for t in range(10):
            i = 0
            for _ in range(3):
                i = 2 * i + 1 + int(row[forest.feature[t, i]] > forest.threshold[t, i])
            total += forest.leaf[t, i - 7]
        assert got == pytest.approx(1 / (1 + np.exp(-total)))
    assert np.mean((forest.score(x) > 0.5) == (x[:, 0] + x[:, 1] ** 2 > 0.5)) > 0.9


# licences


def test_license_base(spark):
    rng = random.Random(1)
    words = ["mit", "license", "apache", "general", "public", "MIT", "License,", "x1", "é", "-"]
    texts = [*HARD, *[" ".join(rng.choice(words) for _ in range(40)) for _ in range(60)]]
    got = {r["doc_id"]: r for r in license_scan.scan(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(lowered(t))
        places = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert license_scan.scan(docs_of(spark, [])).count() == 0


def whole(label):
    """A template's wording with its optional words, the first of listed wordings, and a name where any words may stand."""
    made = re.sub(r"<</?optional>>", "", license_scan.TEMPLATES[label]).replace("<<any:1-12>>", "the Foo Bar Institute")
    return re.sub(r"<<one:([^|>]*)[^>]*>>", r"\1", made)


def test_templates(spark):
    texts = [
        "Released under the MIT License.", "Licensed under the terms of the MIT license", "Not under the MIT of License",
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-ND 4.0.", "Licensed under the Apache License, Version 2.0.",
        whole("bsd-3-clause-text"), whole("bsd-3-clause-text").replace("endorse", "enhance"), whole("bsd-2-clause-text"), whole("bsd-2-clause-text").replace("2.", ""),
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: totally proprietary terms",
        whole("mit-text"), whole("mit-text").rpartition("IN NO EVENT")[0], whole("isc-text"), whole("apache-2.0-text"), whole("apache-2.0-text").partition("Unless")[0],
        whole("gpl-text"), whole("gpl-text").replace("hope", "fear"),
    ]
    got = [r["labels"] for r in license_scan.scan(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["mit,mit-notice", "mit,mit-notice", "", "gpl,gpl-3.0-notice", "cc-by-nc-4.0-notice", "", "apache,apache-2.0-notice", "bsd-3-clause-text", "", "bsd-2-clause-text", "bsd-2-clause-text", "",
        "mit-text", "", "isc-text", "apache,apache-2.0-notice,apache-2.0-text", "apache,apache-2.0-notice", "gpl,gpl-text", "gpl"]


def test_automaton_against_regular_expression():
    a = license_scan.Automaton("a <<optional>>b <<optional>>c<</optional>><</optional>> <<one:d|e f>> <<any:0-2>> g")
    pattern = re.compile(r"a (?:b (?:c )?)?(?:d|e f) (?:\S+ ){0,2}?g(?: |$)")
    rng = random.Random(2)
    for _ in range(3000):
        w = [rng.choice("abcdefg") for _ in range(9)]
        m = pattern.match(" ".join(w))
        assert a.match([x.encode() for x in w], 0) == (len(m[0].split()) if m else 0)
    with pytest.raises(ValueError):
        license_scan.Automaton("<<optional>>a<</optional>>")


def test_template_that_starts_with_a_replaceable_region(spark):
    docs = docs_of(spark, ["xx foo bar", "foo bar", "one two foo bar", None, ""]).withColumns({c: F.lit(1) for c in ("words", "labels", "score")})
    got = [r["labels"] for r in license_scan.scan(docs, {"made": "<<any:1-2>> foo bar"}).orderBy("doc_id").collect()]
    assert got == ["made", "", "made", "", ""]


# fingerprints


def test_fingerprints(spark):
    rng = random.Random(3)
    words = [f"w{i:03d}" for i in range(200)]
    texts = [" ".join(rng.choices(words, k=rng.randint(5, 120))) for _ in range(70)] + HARD[:6] + ["the same", "the same"]
    ids = list(range(5, 5 + len(texts)))
    docs = docs_of(spark, texts, ids).orderBy(F.rand(1))
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    clean = [t or "" for t in texts]
    assert len(got) == len(texts)
    for k, t in enumerate(clean):
        after = clean[(k + 1) % len(clean)]
        changed = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[ids[k]]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and r["near_next"] == pytest.approx(fingerprint.likeness(r["fingerprint"], got[ids[(k + 1) % len(clean)]]["fingerprint"]))
    assert got[ids[-1]]["fingerprint"] == got[ids[-2]]["fingerprint"] and got[ids[-2]]["near_next"] == 1
    assert np.mean([got[i]["near_edited"] for i in ids[:70]]) > np.mean([got[i]["near_next"] for i in ids[:70]])
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0
    alone = fingerprint.fingerprints(docs_of(spark, ["abcd"], [None])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


def test_fingerprint_by_definition():
    """Each part's digits depend on the text's terms in that part and nothing else."""
    rng = random.Random(41)
    book = fingerprint.Lexicon([b"t%d" % i for i in range(300)])
    texts = [" ".join(f"t{rng.randint(0, 350)}" for _ in range(rng.randint(1, 60))) for _ in range(80)]
    seen = defaultdict(set)
    for t in texts:
        own = {w.encode() for w in t.split()} & book.number.keys()
        digits = book.fingerprint(t)
        assert digits == book.fingerprint(" ".join(sorted(t.split(), reverse=True)) + " unknown") or not own
        for k in range(fingerprint.SUBSETS if own else 0):
            part = frozenset(w for w in own if book.weights[book.number[w], k])
            seen[k].add((part, digits[4 * k : 4 * k + 4]))
            assert (digits[4 * k : 4 * k + 4] == "0000") == (not part)
    clashes = sum(len(x) - len({d for _, d in x}) for x in seen.values())
    assert all(len(x) == len({p for p, _ in x}) for x in seen.values()) and clashes < 20
    for k, rate in enumerate(fingerprint.RATES):
        share = (book.weights[:, k * fingerprint.PER_RATE : (k + 1) * fingerprint.PER_RATE] > 0).mean()
        assert abs(share - rate) < 0.25 * rate + 0.005


def test_lexicon_is_exact(spark):
    texts = [f"common w{i % 7} rare{i} {'half' if i % 2 else ''}" for i in range(60)]
    got = fingerprint.lexicon(docs_of(spark, texts).repartition(7), 0.1, 0.6)
    assert got == sorted([b"half", *[b"w%d" % i for i in range(7)]])


# HTML


def test_html_rules():
    text = "The house of the old man was on the hill and it was not far from the river, as he said to the people. " * 4
    page = (
        "<html><head><title>No</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><div class='cookie-notice'>We use cookies</div>"
        f"<article><header><h1>Head &amp; line</h1></header><p>{text}<p><b>{text}<br>tail &#8212; end</article>"
        "<aside>side</aside><div id=comments><p>A comment of the reader is not part of the page.</div><form><input></form><footer>&copy; us</footer><script>x('</p>')</script>"
    )
    want = " ".join(["Head & line", *(" ".join(text.split()),) * 2, "tail — end"])
    assert html_extract.extract(page) == want
    bare = page.replace("<article>", "<div>").replace("</article>", "</div>").replace("<header>", "").replace("</header>", "")
    assert html_extract.extract(bare) == want
    assert html_extract.extract("") == "" and html_extract.extract("<nav><a>x</a></nav>") == ""
    assert html_extract.extract("<article><p>short</p></article>") == "short"
    assert html_extract.extract("<<<a<p" * 2000 + "<!-- open") is not None
    for name in ("side-story", "share-content related", "widget"):
        assert html_extract.extract(f"<div class='{name}'><p>{text}</div>") == " ".join(text.split())
    for name in ("comments", "comment-list", "reader-replies"):
        assert html_extract.extract(f"<div class='{name}'><p>{text}</div>") == ""


def test_html_blocks_against_brute_force():
    """Pages of plain blocks: both passes by their definition, one block at a time."""
    rng = random.Random(31)
    stops = ["the", "of", "and", "to", "in"]

    def words(n, share):
        return " ".join(rng.choice(stops) if rng.random() < share else f"noun{rng.randint(0, 99)}" for _ in range(n))

    for _ in range(300):
        rows = []
        for _ in range(rng.randint(1, 12)):
            kind = rng.choice(["p", "p", "p", "h2", "nav", "li"])
            plain, link = words(rng.randint(1, 60), rng.choice([0, 0.15, 0.5])), words(rng.randint(1, 12), 0) if rng.random() < 0.3 else ""
            rows.append((kind, plain, link))
        page = "".join(f"<{k}>{a}" + (f" <a href='x'>{b}</a>" if b else "") + f"</{k}>" for k, a, b in rows)
        shown = [(k, f"{a} {b}" if b else a, len(b)) for k, a, b in rows if k != "nav"]
        labels = []
        for _, s, linked in shown:
            density = sum(w in html_extract.STOP_WORDS for w in s.split()) / len(s.split())
            if linked > 0.33 * len(s):
                labels.append("bad")
            elif len(s) < 70:
                labels.append("bad" if linked else "short")
            elif density >= 0.2:
                labels.append("good" if len(s) > 200 else "near")
            elif density >= 0.12:
                labels.append("near")
            else:
                labels.append("good" if len(s) > 400 else "short")
        if "good" not in labels:
            labels = ["good" if x == "near" else x for x in labels]
        decided = [i for i, x in enumerate(labels) if x in ("good", "bad")]

        def kept(i):
            if labels[i] in ("good", "bad"):  # noqa: B023
                return labels[i] == "good"  # noqa: B023
            left, right = [j for j in decided if j < i], [j for j in decided if j > i]  # noqa: B023
            sides = [labels[j] for j in (left[-1:] + right[:1])] or ["bad"]  # noqa: B023
            if len(set(sides)) == 1:
                return sides[0] == "good"
            if labels[i] == "near":  # noqa: B023
                return True
            if shown[i][0] == "h2":  # noqa: B023
                return kept(i + 1)  # noqa: B023
            a, b = i - left[-1], right[0] - i
            return a != b and (sides[0] if a < b else sides[1]) == "good"

        want = " ".join(s for i, (_, s, _) in enumerate(shown) if kept(i))
        assert html_extract.extract(page) == want, page


def test_html_raw_elements():
    """Scripts have no self-closing tags, drawings end with their own end, and of an unclosed player only the tag goes."""
    def text(page):
        return html_extract.extract(f"<article>{page}</article>")

    assert text("<script src=/js/>code</script><p>one") == "one" and text("<script/>code</script><p>one") == "one"
    assert text("<p>one<video src=x><p>two") == "one two" and text("<p>one<svg><svg><text>in</text></svg><text>in</text></svg>two") == "one" + "two"
    assert text("<p>one<svg src=/a/><text>in</text></svg> two") == "one two" and text("<p>one<svg/> two<svg width='1' />three") == "one twothree"
    assert text("<p>one<svg><svg>in</svg> two") == "one two" and text("<p>one<style>p {} ") == "one" and text("<p>one<template><p>in</template> two") == "one two"
    assert text("<p>one<svgs>two</svgs><title>no") == "onetwo"


def test_html_takes_time_in_proportion():
    for page in ("<svg>" * 40_000, "<svg>" * 40_000 + "</svg>", "<video>x" * 30_000, "<svg></svg>x" * 20_000 + "<svg>", "<b>" * 40_000 + "x" + "</i>" * 40_000, "<b>" * 20_000 + "<p>x" * 20_000, "<svg/>" * 40_000, "<a " + "a" * 200_000 + ">", "<div class='" + "x " * 50_000 + "'>y"):
        began = time.time()
        html_extract.extract(page)
        assert time.time() - began < 5


def test_html_of_a_table(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<article>a&nbsp;b &lt;i&gt;</article>"), (3, "u", "<article>a&nbsp;b &lt;i&gt;</article>")], "page_id long, url string, html string")
    got = sorted(tuple(r) for r in html_extract.extract_pages(pages.withColumn("text", F.lit("mine"))).fillna("-", ["url"]).collect())
    assert got == [(1, "u", "", 0), (2, "-", "", 0), (3, "u", "a b <i>", 7), (3, "u", "a b <i>", 7)]


# WARC


def test_revisits_against_a_scan(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        url = "http://WWW.one.org/a/?b=2&a=1&utm_source=x#y" if rng.random() < 0.4 else rng.choice([f"https://h{k}.org/p" for k in range(30)] + [None])
        tag, day = rng.choice(['"t1"', 'W/"t1"', '"t2"', None]), rng.choice(["d1", "d2", None])
        headers = {k: v for k, v in (("ETag", tag), ("Last-Modified", day), ("X-Own", "n"), ("Content-Length", str(i)), ("Date", f"at{i}")) if v}
        rows.append((i, url, rng.choice([*range(60), None]), "response" if rng.random() < 0.5 else "revisit", headers if rng.random() < 0.95 else None, rng.choice(["s1", "s2", None]), f"body{i}"))
    got = {r["record_id"]: r for r in warc.resolve_revisits(spark.createDataFrame(rows, warc.RECORDS_DDL), 16).collect()}
    name = lambda u: None if u is None else "one.org/a?a=1&b=2" if "WWW" in u else u.removeprefix("https://")
    assert len(got) == sum(r[3] == "revisit" for r in rows)
    for i, url, ts, kind, headers, digest, _ in rows:
        if kind != "revisit":
            continue
        earlier = [r for r in rows if r[3] == "response" and url is not None and ts is not None and name(r[1]) == name(url) and r[2] is not None and r[2] < ts]
        r = got[i]
        if not earlier:
            assert r["status"] == "no_earlier" and r["source_id"] is None
            continue
        full = max(earlier, key=lambda x: (x[2], x[0]))
        a, b = ({k.lower(): v for k, v in (h or {}).items()} for h in (headers, full[4]))
        pairs = [(a.get("etag", "").removeprefix("W/"), b.get("etag", "").removeprefix("W/")), (a.get("last-modified"), b.get("last-modified")), (digest, full[5])]
        known = [(x, y) for x, y in pairs if x and y]
        if known and known[0][0] == known[0][1]:
            merged = b | {k: v for k, v in a.items() if k in warc.PERMITTED}
            assert (r["status"], r["source_id"], r["headers"]) == ("resolved", full[0], merged) and r["body_sha256"] == hashlib.sha256(full[6].encode()).hexdigest()
        else:
            assert r["status"] == "mismatch" and r["headers"] is None


def test_warc_files(spark, tmp_path):
    raw = warc.write_record(1, "http://a.org/", 5, "response", {"ETag": '"x"'}, "hello\r\n\r\nWARC/1.1 body é") + warc.write_record(2, "http://a.org", 9, "revisit", {"ETag": 'W/"x"', "Date": "now"}, None, "sha1:Z")
    (tmp_path / "a.warc").write_bytes(raw + b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\ncut")
    (tmp_path / "b.warc").write_bytes(b"")
    records = warc.parse_files(spark.read.format("binaryFile").load(str(tmp_path / "*.warc")))
    assert records.count() == 2 and records.where("record_id = 1").first()["body"] == "hello\r\n\r\nWARC/1.1 body é"
    done = warc.resolve_revisits(records).first()
    assert done["status"] == "resolved" and done["source_id"] == 1 and done["headers"] == {"etag": 'W/"x"', "date": "now"}
    assert warc.resolve_revisits(records.limit(0)).count() == 0


def test_warc_files_as_crawlers_write_them(spark, tmp_path):
    """Ids of the form urn:uuid, ISO 8601 dates, gzip members, a bad length and a broken member."""
    one = warc.write_record(1, "http://a.org/", 5, "response", {"ETag": '"x"', "etag": '"w"'}, "hello").replace(b"<urn:record:1>", b"<urn:uuid:0a1b2c3d-0000-4000-8000-00000000abcd>").replace(b"WARC-Date: 5", b"WARC-Date: 2024-05-01T10:00:00Z")
    two = warc.write_record(2, "http://a.org", 9, "revisit", {"ETag": 'W/"x"'}, None).replace(b"WARC-Date: 9", b"WARC-Date: 2024-05-01T10:00:00.250000Z")
    bad = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(bad) + gzip.compress(two) + gzip.compress(one)[:40])
    (tmp_path / "b.warc").write_bytes(bad + two)
    records = warc.parse_files(spark.read.format("binaryFile").load(str(tmp_path / "*.warc*"))).collect()
    times = sorted(r["ts"] for r in records)
    assert len(records) == 3 and all(r["record_id"] is not None for r in records) and times[1] - times[0] == 250_000 and times[1] == times[2]
    done = warc.resolve_revisits(spark.createDataFrame(records, warc.RECORDS_DDL)).collect()
    assert [r["status"] for r in done] == ["resolved"] * 2 and all(r["headers"]["etag"] == 'W/"x"' for r in done)


def test_many_members_take_time_in_proportion():
    rng = random.Random(4)
    one = [gzip.compress(warc.write_record(k, f"http://a.org/{k}", k, "response", {}, "".join(rng.choices("abcdefgh ", k=2000)))) for k in range(500)]
    raw = b"".join(one * 40)
    began = time.perf_counter()
    found = [r["record_id"] for r in warc.read_records(raw)]
    assert len(found) == 20_000 and found[:500] == list(range(500)) and time.perf_counter() - began < 20
    long = warc.write_record(7, "http://b.org", 1, "response", {}, "x" * 3 * warc.CHUNK + "é")
    cut = gzip.compress(long) + gzip.compress(long)[:-9]
    assert [(r["record_id"], len(r["body"])) for r in warc.read_records(gzip.compress(b"") + cut)] == [(7, 3 * warc.CHUNK + 1)]


def test_an_outlier_in_time_leaves_the_slices_even(spark):
    times = [*range(1000), 10**15, None]
    rows = spark.createDataFrame([(t,) for t in times], "ts long")
    cuts = sorted(set(rows.select(F.percentile_approx("ts", [i / 8 for i in range(1, 8)], 100)).first()[0]))
    counts = Counter(r[1] for r in rows.select("ts", warc._cuts_up_to(F.col("ts"), cuts)).collect())
    assert counts[None] == 1 and len(counts) == 9 and max(counts.values()) < 140
    got = {r[0]: r[1] for r in rows.select("ts", warc._cuts_up_to(F.col("ts"), cuts)).collect()}
    assert all(got[t] == sum(c <= t for c in cuts) for t in times if t is not None)


# decontamination


def contaminated(texts, items):
    windows = []
    for k, t in items:
        w = WORD.findall(lowered(t))
        n = min(13, len(w))
        windows += [(k, tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n]
    out = []
    for t in texts:
        w = WORD.findall(lowered(t))
        hit, found = set(), set()
        for k, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= {str(k)} if k is not None else set()
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("limit", [50_000, 3])
def test_decontamination(spark, limit):
    rng = random.Random(6)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "Eps", "é"]) + str(rng.randint(0, 9))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((30, 13, 12, 20, 1, 40))] + [(10, None), (11, "..."), (None, "zz yy xx"), (1, "again " * 14)]
    texts = [*HARD, *[" ".join(word() for _ in range(rng.randint(5, 80))) for _ in range(40)]]
    for k in (0, 1, 2, 3, 8):
        texts.append(" ".join(word() for _ in range(60)) + " " + items[k][1].upper() + "!" + " ".join(word() for _ in range(rng.choice([5, 600]))))
        texts.append(items[k][1])
    docs = docs_of(spark, texts).withColumns({c: F.lit(1) for c in ("words", "hits", "row", "key", "found", "__row", "__key")})
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contaminated(texts, items)
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.contamination(docs, bench, limit).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = decontaminate.drop_contaminated(docs, bench, limit)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [i for i, x in enumerate(want) if not x[4]]
    assert decontaminate.contamination(docs.limit(0), bench, limit).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0), limit).where("n_hit <> 0 or contaminated").count() == 0


@pytest.mark.parametrize("limit", [50_000, 3])
def test_dropping_by_text_with_repeated_and_null_ids(spark, limit):
    item = " ".join(f"test{i}" for i in range(30))
    rows = [(1, item), (1, "clean text of the same id"), (None, item), (None, "clean text without an id"), (None, "another"), (2, None), (3, item), (3, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), limit)
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, (r for r in rows if r[1] != item)))


def test_texts_are_cut_once(spark):
    """Words are cut once in the plan of a pass, and not in each lambda over them."""
    docs = docs_of(spark, ["a b c"])
    held = decontaminate.WindowSet([("a b c", 1), ("b c", 2)])
    rows = decontaminate._with_words(docs).select("key", F.size("words").alias("n_words"), F.expr(held.found("words")).alias("found"), "row")
    for plan in (rows, rows.where("size(found) > 0 and row >= 0")):
        assert plan._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_span_removal_of_a_large_benchmark(spark):
    """The windows of a benchmark above the limit are looked up in several passes, and the same words are cut."""
    item = " ".join(f"test{i}" for i in range(20))
    rows = [(1, f"  Keep, this. {item.upper()}! And this?"), (1, f"{item} twice {item}"), (None, f"No id. {item}"), (None, "no hit"), (2, None), (3, item), (3, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "keep this")], "item_id long, text string")
    below, above = (decontaminate.remove_spans(docs, bench, limit) for limit in (50_000, 3))
    assert above.columns == docs.columns and sorted(map(str, map(tuple, above.collect()))) == sorted(map(str, map(tuple, below.collect())))
    assert {r["text"] for r in above.collect()} == {"  And this?", "twice ", "No id. ", "no hit", None, ""}


def test_span_removal(spark):
    item = " ".join(f"test{i}" for i in range(13))
    docs = docs_of(spark, [f"  Keep, this. {item.upper()}! And this?", "nothing", None])
    got = [r["text"] for r in decontaminate.remove_spans(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["  Keep, this. And this?", "nothing", None]
