"""The prefix trie against brute force, on small tables that hold the awkward cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from chronoloom.llm import queries, trie

FORM = "conv_id long, turn long, role string, text string, conv string, depth int, prefix string"


def brute(rows, rebuild=True):
    """All nodes from all pairs of conversation and depth."""
    own = defaultdict(list)
    digest = lambda role, text: hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0, digest(role, text)), role, text))
    turns = {c: [x[1:] for x in sorted(t)] for c, t in own.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in turns}
        base = {c: c - int(c - 20 * int(c / 20)) for c in turns}
        turns = {c: turns.get(base[c], [])[: h[c]] + t[h[c] :] for c, t in turns.items()}
    members = defaultdict(list)
    for c in sorted(turns):
        for d in range(len(turns[c]) + 1):
            members[tuple(turns[c][:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below = [sums[k] for k in kids[node]]
        sums[node] = ((sum(b[0] for b in below) if below else 1), (len(members[node]) - 1) * words + sum(b[1] for b in below))
    out = set()
    for node, who in members.items():
        ends = ",".join(str(c) for c in who if len(turns[c]) == len(node))
        out.add((who[0], len(node), members[node[:-1]][0] if node else None, len(who), len(kids[node]), *sums[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def awkward():
    r = random.Random(4)
    said = ["yes", "no  way", "", None, "a\tb\nc", "é ü", "x " * 3000]
    rows = []
    for c in range(120):
        for t in range(r.randrange(1, 9)):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(said[:3])))
    for c in range(120, 180):  # copies
        rows += [(c, 0, "user", "same"), (c, 1, "assistant", "again and again")]
    rows += [(200, t, "user", str(t // 30)) for t in range(150)] + [(201, t, "user", str(t // 30 + t // 140)) for t in range(150)]
    rows += [(-3, 0, "user", "yes"), (-40, 1, "user", "yes"), (-41, None, None, None), (None, 0, "user", "of nobody"), (300, None, "user", "first"), (300, 0, "user", "second"), (300, 0, "user", "second"), (300, 0, "a", "tie"), (301, 5, "user", said[6])]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*x, "conv", 7, "prefix") for x in rows], FORM).repartition(5)


def test_trie(spark):
    rows = awkward()
    got = [tuple(x) for x in trie.conversation_trie(table(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_deep_chains(spark, seed):
    """Chains that hang on chains: each conversation leaves another one's a turn later."""
    r = random.Random(seed)
    rows, texts = [], {}
    for c in range(25):
        texts[c] = [*texts.get(c - 1 if seed else r.randrange(c) if c else -1, [])[:c], *[f"{c} {t}" for t in range(r.randrange(3))]]
        rows += [(c, t, "user", x) for t, x in enumerate(texts[c])]
    turns = trie.numbered(table(spark, rows))
    convs = spark.range(25).withColumnRenamed("id", "conv")  # some have no turns
    want = brute(rows, rebuild=False)
    got = {tuple(x) for x in trie.prefix_trie(turns, convs).collect()}
    turnless = 25 - len({x[0] for x in rows})
    if not turnless:
        assert got == want
    root = next(x for x in got if x[1] == 0)
    assert root[0] == 0 and root[3] == 25 and len(got) == len(want)


def test_little(spark):
    assert trie.conversation_trie(table(spark, []).limit(0)).collect() == []
    assert trie.conversation_trie(table(spark, [(None, 0, "user", "x")])).collect() == []
    for rows in ([(0, 0, "user", "x")], [(7, 0, None, None)], [(5, 1, "user", "a"), (6, 1, "user", "a")]):
        assert {tuple(x) for x in trie.conversation_trie(table(spark, rows)).collect()} == brute(rows)


def test_same_as_sql(spark, tmp_path):
    data = "/root/testdata/sf0.001"
    got = trie.conversation_trie(spark.read.parquet(f"{data}/conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    said = con.sql(queries.SQL["op13_prefix_trie"])
    assert set(map(tuple, got.select(*said.columns).collect())) == set(said.fetchall())
