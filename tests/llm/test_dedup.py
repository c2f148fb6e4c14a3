"""Suffix, line and near de-duplication, packing and the pipeline: brute force, planted cases and hard inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankweave.llm import graph, line_dedup, near_dup, packing, queries, similar, suffix_dedup
from test_filters import DOCS, HARD, contaminated, docs_of, lowered

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def sentence(rng, n, size=400):
    return " ".join(f"{rng.choice(['an', 'be', 'ti', 'on', 'ré'])}{rng.randint(0, size)}" for _ in range(n))


# graph


@pytest.mark.parametrize("held", [1_000_000, 40])
@pytest.mark.parametrize("shape", ["path", "star", "random", "empty"])
def test_components(spark, shape, held, monkeypatch):
    """In one task, and by rounds where the edges are more than a task holds."""
    monkeypatch.setattr(graph, "HELD_EDGES", held)
    rng = random.Random(1)
    edges = {"path": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 200)] + [(500, i) for i in range(501, 600)], "random": [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(7, 7)], "empty": []}[shape]
    rng.shuffle(edges)
    sets = Sets({x for e in edges for x in e})
    for a, b in edges:
        sets.join(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: sets.find(x) for x in linked}


# hashes


def test_span_hashes_depend_on_content_only():
    raw = b"the cat sat. the cat sat. a cat"
    h = similar.span_hashes(raw, np.array([0, 13, 4, 17, 28, 0]), np.array([12, 25, 7, 20, 31, 11]), similar.Powers())
    assert h[0] == h[1] and h[2] == h[3] == h[4] and len({int(x) for x in h}) == 3


def test_char_shingles_are_those_of_the_line():
    powers = similar.Powers()
    for a, b in (("abcdefgh", "xabcdefg"), ("ab", "ab"), ("aaaaaaa", "aaaaa"), ("", "")):
        want = {a[i : i + 5] for i in range(max(1, len(a) - 4))} & {b[i : i + 5] for i in range(max(1, len(b) - 4))} if a else set()
        assert len(np.intersect1d(similar.char_shingles(a, powers), similar.char_shingles(b, powers))) == len(want)


def test_char_shingle_sets_are_those_of_each_line():
    lines = ["", "ab", "abcde", "é" * 9, "", *[sentence(random.Random(i), 40) for i in range(30)], "x" * 500, ""]
    for chars in (1, 300, 10**6):
        got = similar.char_shingle_sets(lines, chars=chars)
        for line, found in zip(lines, got, strict=True):
            assert len(found) == len({line[i : i + 5] for i in range(max(1, len(line) - 4))} if line else ())
            assert (np.diff(found.astype(object)) > 0).all() and (found == similar.char_shingles(line, similar.Powers())).all()


@pytest.mark.parametrize("percent", [75, 80])
def test_linked_against_brute_force(percent):
    rng = np.random.default_rng(percent)
    for _ in range(60):
        base = [rng.integers(0, 60, rng.integers(1, 25)) for _ in range(3)]
        sets = []
        for _ in range(rng.integers(2, 25)):
            x = base[rng.integers(0, 3)].copy()
            moved = rng.random(len(x)) < rng.choice([0, 0.1, 0.2])
            x[moved] = rng.integers(0, 60, moved.sum())
            sets.append(np.unique(x[: rng.integers(0, len(x) + 1)] if rng.random() < 0.2 else x).astype(np.uint64))
        side = rng.random(len(sets)) < 0.5
        for sides in (None, side):
            want, got = Sets(range(len(sets))), Sets(range(len(sets)))
            for i, a in enumerate(sets):
                for j, b in enumerate(sets[:i]):
                    shared = len(np.intersect1d(a, b))
                    if shared and 100 * shared >= percent * (len(a) + len(b) - shared) and (sides is None or sides[i] != sides[j]):
                        want.join(i, j)
            for i, j in similar.linked(sets, sides, percent):
                got.join(i, j)
            assert [want.find(i) for i in range(len(sets))] == [got.find(i) for i in range(len(sets))]


def test_every_near_signature_shares_an_entry():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 65536, (400, near_dup.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(near_dup.SYMBOLS, near_dup.DISTANCE, replace=False)
        row[at] += 1
    assert (near_dup.entries(a) == near_dup.entries(b)).any(1).all()


# near duplicates


def near_brute(texts, ids):
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        w = SPACE.findall(lowered(t))
        sets[i] = frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    comps = Sets(ids)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                comps.join(a, b)
    return {i: (len(sets[i]), comps.find(i), comps.find(i) == i) for i in ids}


def near_texts(rng):
    texts = [*HARD]
    for _ in range(12):
        base = sentence(rng, rng.randint(20, 150)).split()
        for _ in range(rng.randint(1, 7)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = sentence(rng, 1, 10**6)
            texts.append("\t\n".join(w) if rng.random() < 0.3 else " ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    chain = sentence(rng, 100).split()
    for k in range(12):  # neighbours are linked, ends are not
        texts.append(" ".join(chain[2 * k : 2 * k + 70]))
    return texts + [" ".join(chain[:70])] * 30


def test_near_duplicates(spark):
    texts = near_texts(random.Random(2))
    ids = random.Random(3).sample(range(1000), len(texts))
    docs = docs_of(spark, texts, ids).withColumns({c: F.lit(1) for c in ("node", "component", "row", "key", "__row", "__key")})
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dup.near_duplicates(docs).collect()}
    want = near_brute(texts, ids)
    assert got == want
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, x in want.items() if x[2])


def test_near_duplicates_empty_null_and_repeated(spark):
    assert near_dup.near_duplicates(docs_of(spark, [])).count() == 0
    rows = near_dup.near_duplicates(docs_of(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None], [None, 4, 4, None])).collect()
    assert len(rows) == 4 and sum(r["component_id"] == 4 for r in rows) == 3


def test_unequal_sets_of_one_node_are_no_copies(spark, monkeypatch):
    """With the first half of every hash equal, only equal sets are classes."""
    whole = similar.set_hash
    monkeypatch.setattr(near_dup, "set_hash", lambda hashes: (7, whole(hashes)[1]))
    rng = random.Random(8)
    texts = [sentence(rng, 40) for _ in range(9)]
    texts += [texts[2], texts[5].upper(), texts[5], ""]
    docs = docs_of(spark, texts, list(range(len(texts)))).repartition(3)
    want = near_brute(texts, range(len(texts)))
    assert {r["doc_id"]: tuple(r)[1:] for r in near_dup.near_duplicates(docs).collect()} == want
    assert sorted(r["doc_id"] for r in near_dup.keep_one(docs).collect()) == sorted(i for i, x in want.items() if x[2])


def test_blocks_of_a_group(spark, monkeypatch):
    """A large group cut into many blocks has the same links."""
    monkeypatch.setattr(similar, "BLOCK_SHINGLES", 150)
    monkeypatch.setattr(similar, "BUCKET", 8)
    texts = near_texts(random.Random(5))
    ids = list(range(len(texts)))
    assert {r["doc_id"]: tuple(r)[1:] for r in near_dup.near_duplicates(docs_of(spark, texts, ids)).collect()} == near_brute(texts, ids)


def crowd(rng, n):
    """Signatures of n nodes that share the first six symbols, and else are random but for planted pairs at the distance."""
    made = rng.integers(0, 65536, (n, near_dup.SYMBOLS)).astype(np.uint16)
    made[:, :6] = made[0, :6]
    pairs = []
    for i in range(0, n - 1, 10):
        made[i + 1] = made[i]
        at = 6 + rng.choice(near_dup.SYMBOLS - 6, near_dup.DISTANCE, replace=False)
        made[i + 1, at] ^= rng.integers(1, 16, near_dup.DISTANCE).astype(np.uint16)
        pairs.append((i, i + 1))
    return made, pairs


@pytest.mark.parametrize("bucket", [32_768, 100])
@pytest.mark.parametrize("held", [1_000_000, 300])
def test_crowded_buckets_lose_no_pair(spark, monkeypatch, bucket, held):
    """1,500 signatures that share buckets, over several partitions: all pairs within the distance are in one group, and the groups don't depend on the partitions."""
    monkeypatch.setattr(similar, "BUCKET", bucket)
    monkeypatch.setattr(similar, "HELD", held)
    made, pairs = crowd(np.random.default_rng(4), 1500)
    rows = [(i, bytearray(x.astype("<u2").tobytes())) for i, x in enumerate(made)]
    random.Random(5).shuffle(rows)
    found = []
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "node long, signature binary").repartition(parts)
        entered = docs.mapInArrow(partial(near_dup._entered, cells=similar.cells_of(docs)), similar.CELLS_DDL)
        groups = {r["node"]: r["component"] for r in similar.candidate_groups(entered, near_dup.CHECK_WORDS, near_dup._differing, near_dup.DISTANCE).collect()}
        assert all(groups[a] == groups[b] for a, b in pairs)
        found.append(groups)
    if bucket > 1500:
        near = Sets(range(1500))
        checks = near_dup.checks_of(made)
        for i in range(1500):
            for j in np.flatnonzero(near_dup._differing(checks[i], checks[i + 1 :]) <= near_dup.DISTANCE):
                near.join(i, i + 1 + int(j))
        assert found[0] == found[1] and all(near.find(a) == near.find(b) for a, b in found[0].items())


def test_one_row_of_each_group_with_repeated_and_null_ids(spark):
    rng = random.Random(17)
    a, b, c = (sentence(rng, 40) for _ in range(3))
    near = a + " more"
    rows = [(1, a), (1, a), (1, near), (None, a), (None, b), (None, b), (None, b + " more"), (None, c), (2, c), (4, ""), (5, None), (None, "5")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    kept = near_dup.keep_one(docs)
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert kept.columns == docs.columns and len(got) == len(set(got)) == 6 and set(got) <= set(rows)
    assert sum(r in ((1, a), (1, near)) for r in got) == 1 and sum(r in ((None, b), (None, b + " more")) for r in got) == 1
    assert {(2, c), (4, ""), (5, None), (None, "5")} <= set(got)


# lines


def lines_brute(texts, ids, least=1):
    occ = [(i, k, line_dedup.squeezed(x)) for i, t in sorted(zip(ids, texts, strict=True)) for k, x in enumerate((t or "").split("\n")) if len(x) >= least and len(line_dedup.squeezed(x)) >= least]
    sets = {s: {s[a : a + 5] for a in range(max(1, len(s) - 4))} for _, _, s in occ}
    comps = Sets(sets)
    names = sorted(sets)
    for x, a in enumerate(names):
        for b in names[x + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                comps.join(a, b)
    seen, gone = set(), defaultdict(set)
    for i, k, s in occ:
        if comps.find(s) in seen:
            gone[i].add(k)
        seen.add(comps.find(s))
    out = {}
    for i, t in zip(ids, texts, strict=True):
        parts = (t or "").split("\n")
        kept = "\n".join(x for k, x in enumerate(parts) if k not in gone[i])
        out[i] = (0 if t is None else len(parts), len(gone[i]), len(kept), hashlib.sha256(kept.encode()).hexdigest())
    return out, gone


@pytest.mark.parametrize("least", [1, 30])
def test_lines(spark, least):
    rng = random.Random(7)
    pool = [sentence(rng, rng.randint(8, 60)) for _ in range(25)]
    texts = [*HARD[:8], "the same line of a text that is long enough", "the same line of a text that is long enough"]
    for _ in range(60):
        part = []
        for _ in range(rng.randint(1, 6)):
            w = rng.choice(pool).split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = "zz"
            part.append(" ".join(w) if rng.random() < 0.7 else rng.choice(["", "short", "  " + " ".join(w).upper() + " \r"]))
        texts.append("\n".join(part))
    ids = list(range(len(texts)))
    docs = docs_of(spark, texts, ids).withColumns({c: F.lit(i) for i, c in enumerate(("gone", "line", "key", "left", "row", "__row"))})
    want, gone = lines_brute(texts, ids, least)
    got = {r["doc_id"]: tuple(r)[1:] for r in line_dedup.dedup_lines(docs, least).collect()}
    assert sum(map(len, gone.values())) > 50
    wrong = [i for i in ids if got[i] != want[i]]
    assert len(wrong) <= 1, wrong  # bands may miss a pair at the threshold itself
    kept = line_dedup.drop_lines(docs, least)
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert kept.columns == docs.columns and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows.values())
    assert {0, 1, 2, 3} <= rows.keys() and 9 not in rows
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_lines_link_on_five_characters(spark):
    """One changed character in a line of 60 leaves 51 of 61 shingles of five characters: a link."""
    line = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz", k=60))
    other = line[:30] + "#" + line[31:]
    sets = [{x[a : a + 5] for a in range(56)} for x in (line, other)]
    assert (len(sets[0] & sets[1]), len(sets[0] | sets[1])) == (51, 61)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs_of(spark, [line, other], [0, 1])).collect()}
    assert got == {0: 0, 1: 1}


def test_unlike_long_lines_are_no_chain(spark, monkeypatch):
    """Long lines of few syllables share about half of their shingles, and short checks make one group of nearly all; the longer ones leave the near pairs."""
    rng = random.Random(5)
    syllables = ["".join(rng.choice("abcdeinrst") for _ in range(3)) for _ in range(22)]
    lines = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(420)) for _ in range(200)]
    near = {i: f"{lines[i][:-20]} near {i}" for i in range(0, 200, 20)}
    texts = {i: x for i, x in enumerate(lines)} | {1000 + i: x for i, x in near.items()}
    sets = {i: set(similar.char_shingles(x, similar.Powers()).tolist()) for i, x in texts.items()}
    likeness = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(40) for j in range(i)]
    assert 0.4 < sum(likeness) / len(likeness) < 0.6
    made = line_dedup.line_signatures(list(texts.values()))
    checks = line_dedup.checks_of(made)
    assert np.mean([line_dedup._differing(checks[i], checks[j]) <= line_dedup.MOST for i in range(40) for j in range(i)]) > 0.2
    monkeypatch.setattr(similar, "SHARPENED", 1000)
    members = spark.createDataFrame([(i, 0, x, len(x)) for i, x in texts.items()], "node long, group long, text string, weight int").repartition(3)
    grouped = defaultdict(set)
    for r in line_dedup.sharp_groups(members).collect():
        grouped[r["group"]].add(r["node"])
    assert all(any({i, 1000 + i} <= g for g in grouped.values()) for i in near)
    assert max(map(len, grouped.values())) < 20
    # groups of few shingles stay as they are
    monkeypatch.setattr(similar, "SHARPENED", 10**9)
    assert line_dedup.sharp_groups(members).count() == len(texts)


def test_short_lines_of_the_queries(spark, tmp_path):
    """Lines of any length are compared, and blank lines stay."""
    texts = ["All rights reserved.\n\nx", "  all RIGHTS reserved. \n\nall rights reserved!\nx", "x\nx", "\n \n"]
    docs = docs_of(spark, texts, [0, 1, 2, 3])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in queries.op3_lines(spark, str(tmp_path)).collect()}
    kept = [texts[0], "", "", texts[3]]
    assert got == {i: (len(t.split("\n")), n, hashlib.sha256(k.encode()).hexdigest()) for i, (t, n, k) in enumerate(zip(texts, (0, 3, 2, 0), kept, strict=True))}
    stage = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_deduplication(spark, docs, str(tmp_path)).collect()}
    assert stage == {0: kept[0], 3: kept[3]}


# suffixes


def suffix_brute(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    count = Counter(x[k : k + length] for x in raw for k in range(len(x) - length + 1))
    out = []
    for x in raw:
        mark = np.zeros(len(x), bool)
        for k in range(len(x) - length + 1):
            if count[x[k : k + length]] > 1:
                mark[k : k + length] = True
        kept = bytes(np.frombuffer(x, np.uint8)[~mark])
        out.append((len(x), int(mark.sum()), int((np.diff(np.r_[0, mark.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [6000, 3])
def test_suffixes(spark, hot):
    rng = random.Random(8)
    base = sentence(rng, 900)
    texts = [x for x in HARD if x is None or len(x) < 20_000]
    for _ in range(50):
        a = rng.randrange(len(base) - 700)
        texts.append(sentence(rng, rng.randint(0, 40), 10**6) + base[a : a + rng.choice([150, 199, 200, 201, 260, 690])] + sentence(rng, rng.randint(0, 40), 10**6))
    texts += ["x" * 450, "ha " * 150, "é" * 120 + "q" * 199, base, sentence(rng, 100), "tail " + "y" * 199, "y" * 199]
    docs = docs_of(spark, texts).withColumn("bucket", F.lit(1)).withColumn("n", F.lit("x"))
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.removed(docs, hot).collect()}
    assert [got[i] for i in range(len(texts))] == suffix_brute(texts)
    assert suffix_dedup.removed(docs.limit(0), hot).count() == 0


def test_suffixes_of_repeated_rows_and_text(spark):
    text = sentence(random.Random(9), 100)
    rows = spark.createDataFrame([(1, text), (1, text), (None, "short"), (2, sentence(random.Random(10), 80))], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["n_removed"]) for r in suffix_dedup.removed(rows).collect())
    assert got == [(0, 0), (1, len(text.encode())), (1, len(text.encode())), (2, 0)]
    left = suffix_dedup.remove_repeats(rows)
    assert left.columns == rows.columns and sorted(len(r["text"]) for r in left.collect())[:2] == [0, 0]


def test_long_documents_are_cut_in_ranges(spark, monkeypatch):
    """A document of many ranges loses the same bytes as in one."""
    rng = random.Random(19)
    part = sentence(rng, 120, 10**6)
    texts = [sentence(rng, 300, 10**6) + part + sentence(rng, 300, 10**6), part[37:500], sentence(rng, 50, 10**6), "ab " * 900]
    monkeypatch.setattr(suffix_dedup, "RANGE", 64)
    docs = docs_of(spark, texts).withColumns({c: F.lit(1) for c in ("row", "key", "spans", "lo", "__spans")})
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.removed(docs).collect()}
    assert [got[i] for i in range(len(texts))] == suffix_brute(texts)
    assert suffix_dedup.remove_repeats(docs).columns == docs.columns


def test_refinement_against_brute_force():
    rng = random.Random(11)
    base = bytes(rng.choices(b"ab", k=800))
    pieces = [base[rng.randrange(500) :][: rng.randint(0, 400)] for _ in range(20)] + [b"", b"a" * 300]
    count = Counter(p[k : k + 200] for p in pieces for k in range(len(p) - 199))
    want = [[k for k in range(len(p) - 199) if count[p[k : k + 200]] > 1] for p in pieces]
    assert [x.tolist() for x in suffix_dedup.refine(pieces)] == want


# packing


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*e.ids, 2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_packed(rows, ids):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert by_doc.keys() == ids.keys()
    for d, parts in by_doc.items():
        parts.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts))) and sum(r["length"] for r in parts) == len(ids[d])
        assert all(r["length"] == 1024 for r in parts[1:])
        for r in parts:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[d][r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for spans in by_sequence.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at <= 1024
    return len(by_sequence)


def test_packing_round_trip(spark):
    rng = random.Random(12)
    texts = [x for x in HARD if x is None or len(x) < 50_000] + ["a  b", "x \n y", " lead", "it's 12,5", "<|endoftext|> x", "ü " * 700, *[sentence(rng, rng.randint(1, 500)) for _ in range(80)]]
    docs = docs_of(spark, texts).withColumn("piece", F.lit(9)).withColumn("offset", F.lit("x"))
    ids = dict(enumerate(reference_ids(texts)))
    n = check_packed(packing.pack(docs).collect(), ids)
    assert n <= sum(map(len, ids.values())) / 1024 * 1.02 + 1
    small = check_packed(packing.pack(docs, leaf_pieces=4).collect(), ids)
    assert n <= small <= n * 1.3 + 2
    assert packing.pack(docs.limit(0)).count() == 0
    twice = packing.pack(docs_of(spark, ["one", "one"], [1, 1])).collect()
    assert len(twice) == 2 and len({(r["sequence_id"], r["offset"]) for r in twice}) == 2


@pytest.mark.parametrize("shape", ["even", "large", "small", "two"])
def test_bins_that_stay_behind_could_not_have_merged(spark, monkeypatch, shape):
    """With the least number of carried bins there are as many sequences as with all of them."""
    rng = random.Random(21)
    length = {"even": lambda: rng.randint(1, 100), "large": lambda: rng.randint(40, 100), "small": lambda: rng.choice([3, 7, 30, 95]), "two": lambda: rng.choice([51, 49, 45, 60])}[shape]
    rows = [(i, 0, 0, length(), i) for i in range(600)]
    made = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    n = []
    for carried in (packing.FAN, 10**6):
        monkeypatch.setattr(packing, "CARRIED", carried)
        n.append(packing.pack_pieces(made, 100, 8).select("sequence_id").distinct().count())
    assert n[0] == n[1]


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fills = packing.best_fit(np.array([700, 600, 324, 424, 1000, 24]), 1024)
    assert bins[2] == bins[0] and bins[3] == bins[1] and bins[5] == bins[4] and fills == [1024, 1024, 1024]
    assert offsets[2] == 700


# pipeline


def test_pipeline_of_hard_tables(spark, tmp_path):
    """An empty table, and one of nulls, empty texts and repeated rows with other columns of clashing names, go through all stages."""
    good, bad = sentence(random.Random(1), 60, 10**5), "BUY NOW!!! " * 30
    spark.createDataFrame([(k, int(k % 2), 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(k, f"{good} {k}" if k % 2 else f"{bad} {k}") for k in range(40)] + [(None, None), (None, None), (7, ""), (7, ""), (8, "\n"), (None, good), (None, good)]
    whole = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "key", "gone", "left", "hit", "__row", "__key", "score", "label")})
    for docs in (whole.limit(0), whole):
        now = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = now.count()
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns and now.count() <= before, name
        assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() >= now.count()


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(13)
    texts, marks = [], []
    for k in range(60):
        good = k % 4 > 0
        text = "\n".join(sentence(rng, 30, 10**5) for _ in range(4))
        texts.append(text if good else text.upper().replace(" ", "!! "))
        marks.append(int(good))
    item = sentence(rng, 30, 10**6)
    near = texts[1].replace(texts[1].split()[3], "changed", 1)
    texts += [texts[1], near, "  " + item, sentence(rng, 2000, 10**5), None, ""]
    docs = docs_of(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, m, 0) for i, m in enumerate(marks)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    now, steps = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.dtypes == docs.dtypes, name
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        steps[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    quality, lines, minhash, clean = steps.values()
    assert not any(i in quality for i in range(60) if not marks[i]) and sum(i in quality for i in range(60)) >= 44
    assert 60 not in lines and set(lines) <= set(quality)
    comps = near_brute(list(lines.values()), list(lines))
    assert set(minhash) == {i for i, x in comps.items() if x[2]}
    bad = contaminated(list(minhash.values()), [(7, item)])
    assert set(clean) == {i for i, x in zip(minhash, bad, strict=True) if not x[4]} and 62 not in clean
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    check_packed(packed, dict(zip(clean, reference_ids(clean.values()), strict=True)))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole.collect()) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)
    assert DOCS.startswith("doc_id")
