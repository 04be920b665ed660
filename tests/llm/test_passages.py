"""Repeated passages against brute force: links of long paragraphs, edited passages, and the awkward rows."""

import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import passages, shingles

DOCS = "/root/testdata/sf0.01/documents.parquet"


def fresh(r, n):
    return [f"{r.choice('abcdefgh')}{r.randrange(10**6)}" for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(list(rows.items()), "doc_id long, text string")


def found(df, **more):
    return {r.doc_id: r for r in passages.repeated_passages(df, **more).collect()}


def covered(row, a, z):
    return sum(max(0, min(p.end, z) - max(p.begin, a)) for p in row.passages) if row else 0


def test_long_paragraphs_are_windows_of_their_texts():
    r = random.Random(1)
    texts = [fresh(r, n) for n in (0, 1, 19, 20, 33, 40, 41, 300)]
    t = passages.laid(shingles.word_hashes([" ".join(w).encode() for w in texts]))
    got = passages.long_paragraphs(t)
    assert set(got.text.tolist()) == {3, 4, 5, 6, 7}
    same = defaultdict(set)
    for k, a, n, own in zip(got.text.tolist(), (got.place - t.first[got.text]).tolist(), got.length.tolist(), got.own.tolist(), strict=True):
        assert n == min(passages.WINDOW, len(texts[k])) and a + n <= len(texts[k])
        same[own].add(tuple(texts[k][a : a + n]))
    assert all(len(x) == 1 for x in same.values())
    marks = passages.minhashes(passages.runs_of(t), got, 3)
    runs = passages.runs_of(t)
    for k in range(3):
        h = shingles.mixed(runs + np.uint64(k * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        assert marks[:, k].tolist() == [h[a : a + n - 4].min() for a, n in zip(got.place.tolist(), got.length.tolist(), strict=True)]


def test_short_paragraphs_fill_their_texts():
    r = random.Random(2)
    texts = [fresh(r, n) for n in (0, 1, 2, 3, 50, 400)]
    t = passages.laid(shingles.word_hashes([" ".join(w).encode() for w in texts]))
    got = passages.paragraphs(t)
    alone = [passages.paragraphs(passages.laid(shingles.word_hashes([" ".join(w).encode()]))).own.tolist() for w in texts]
    for k, w in enumerate(texts):
        mine = got.text == k
        assert got.length[mine].sum() == len(w) and got.own[mine].tolist() == alone[k]  # whatever stands beside it


def jaccard_pairs(texts):
    """All pairs of different long paragraphs of Jaccard 0.75 or more, by an inverted index over sets of word tuples; and those that don't stand in the same documents."""
    t = passages.laid(shingles.word_hashes([x.encode() for x in texts]))
    got = passages.long_paragraphs(t)
    words = [x.translate({c: c + 32 for c in range(65, 91)}).split() for x in texts]
    sets, docs = {}, defaultdict(set)
    for k, a, n, own in zip(got.text.tolist(), (got.place - t.first[got.text]).tolist(), got.length.tolist(), got.own.view(np.int64).tolist(), strict=True):
        w = words[k][a : a + n]
        sets[own] = {tuple(w[i : i + 5]) for i in range(n - 4)}
        docs[own].add(k)
    index = defaultdict(list)
    for own, s in sets.items():
        for x in s:
            index[x].append(own)
    pairs = {(a, b) for v in index.values() if len(v) < 200 for a in v for b in v if a < b}
    alike = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    return alike, {(a, b) for a, b in alike if docs[a] != docs[b]}


def test_recall_of_links_on_the_test_table(spark):
    rows = [r for r in spark.read.parquet(DOCS).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect() if r.text.isascii()]
    alike, want = jaccard_pairs([r.text for r in rows])
    texts = spark.createDataFrame([(r.doc_id, r.text.encode()) for r in rows], "doc long, raw binary").where(F.length("raw") > 0)
    members = passages._collisions(texts, 1, passages.bands()).cache()
    links = [(r.a, r.b) for r in passages._close(members, passages._named(texts, members), 75).collect()]
    top = {}

    def root(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            top[max(a, b)] = min(a, b)
    joined = sum(root(a) == root(b) for a, b in want)
    assert len(want) > 50 and joined >= 0.99 * len(want)
    assert {(min(p), max(p)) for p in links} <= alike


@pytest.mark.parametrize("length, share", [(60, 0.8), (80, 0.97)])
def test_passages_with_a_changed_word(spark, length, share):
    r = random.Random(3)
    rows, where = {}, {}
    for k in range(150):
        passage = fresh(r, length)
        other = list(passage)
        other[length // 2] = "changed"
        for d, p in ((2 * k, passage), (2 * k + 1, other)):
            a = r.randrange(20, 60)
            rows[d] = " ".join(fresh(r, a) + p + fresh(r, r.randrange(20, 60)))
            where[d] = a
    got = found(frame(spark, rows))
    hit = sum(covered(got.get(d), where[d], where[d] + length) >= 25 for d in rows)
    assert hit >= share * len(rows)
    assert all(covered(got[d], 0, where[d] - 6) + covered(got[d], where[d] + length + 6, 10**9) == 0 for d in got)  # a similar paragraph may reach a few words beyond
    assert all(got[d].n_removed == 0 for d in got if d % 2 == 0)


def test_exact_passages_of_over_fifty_words(spark):
    r = random.Random(4)
    rows = {}
    for k in range(200):
        passage = fresh(r, 51)
        for d in (2 * k, 2 * k + 1):
            rows[d] = " ".join(fresh(r, r.randrange(10, 60)) + passage + fresh(r, r.randrange(10, 60)))
    got = found(frame(spark, rows))
    assert len(got) >= 0.96 * len(rows)


def test_all_of_a_bucket_are_compared(spark, monkeypatch):
    """Three texts in one bucket: two are alike, and neither is like the third, whichever comes first."""
    r = random.Random(5)
    monkeypatch.setattr(passages, "minhashes", lambda runs, at, count: np.ones((len(at.own), count), np.uint64))
    for k in range(3):
        base = fresh(r, 40)
        texts = [" ".join(fresh(r, 40)), " ".join(base), " ".join([*base[:-1], "other"])]
        for group in (100_000, 1):  # and in blocks
            monkeypatch.setattr(passages, "GROUP", group)
            got = found(frame(spark, {1: texts[0], 2: texts[1], 3: texts[2]}))
            assert {d: x.n_removed for d, x in got.items()} == {2: 0, 3: 40}


def test_repeated_rows_ties_and_long_texts(spark):
    r = random.Random(6)
    passage = " ".join(fresh(r, 70))
    long = " ".join(fresh(r, 60_000))
    rows = [(1, passage), (1, passage), (2, passage), (3, f"{long} {passage} {long}"), (4, long), (5, None), (6, ""), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit("x")).withColumn("own", F.lit(1))
    got = found(df)
    assert set(got) == {1, 2, 3, 4}
    assert got[2].n_removed >= 50 and got[4].n_removed > 59_000
    assert found(df.where("doc_id = 1")) == {}  # one document, twice
    assert found(df.where("false")) == {}


def near_copies(r, bases, copies):
    """Texts of WINDOW words, one changed word in each copy, so that each is one long paragraph."""
    rows = {}
    for _ in range(bases):
        base = fresh(r, passages.WINDOW)
        for k in range(copies):
            words = list(base)
            words[k % len(words)] = f"changed{k}"
            rows[len(rows)] = " ".join(words)
    return rows


def test_large_buckets_are_parts_of_their_own_and_hot_ones_pairs_of_blocks(spark, monkeypatch):
    texts = frame(spark, near_copies(random.Random(7), 4, 4000)).select(F.col("doc_id").alias("doc"), F.col("text").cast("binary").alias("raw"))

    def buckets():
        out = defaultdict(lambda: defaultdict(set))
        for x in passages._collisions(texts, 1, passages.bands()).collect():
            out[x.part][x.bucket].add(x.own)
        return out

    whole = buckets()
    large = [b for part in whole.values() for b in part.values() if len(b) > 2048]
    assert len(large) > 8  # more than there are parts of small buckets
    assert all(len(part) == 1 for part in whole.values() if max(map(len, part.values())) > 2048)
    monkeypatch.setattr(passages, "GROUP", 1000)
    blocks = [b for part in buckets().values() for b in part.values()]
    assert max(map(len, blocks)) < 2 * 1500
    members = sorted(large[0])[:60]
    assert all(any(a in b and z in b for b in blocks) for a in members for z in members)


def test_a_bucket_of_many_near_copies_is_compared_in_little_memory():
    t = passages.laid(shingles.word_hashes([x.encode() for x in near_copies(random.Random(8), 1, 4000).values()]))
    got = passages.long_paragraphs(t)
    runs = passages.runs_of(t) & passages.SHORTER
    sets = [np.unique(runs[a : a + n - 4]) for a, n in zip(got.place.tolist(), got.length.tolist(), strict=True)]
    size, every = np.array([len(x) for x in sets]), np.concatenate(sets)
    tracemalloc.start()
    a, b = passages.links_within(np.full(len(sets), 5, np.uint64), got.own, size, every, 75)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    passages.forest(*at.reshape(2, -1), label)
    middle = np.isin(np.arange(len(sets)) % passages.WINDOW, (0, 1, 38, 39))  # few changed runs: 30 or more of at most 40 are shared by two of these
    assert len(set(label[np.searchsorted(nodes, got.own[middle])].tolist())) == 1
    assert peak < 64 << 20
