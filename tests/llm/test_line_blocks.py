"""Filters of an index in many blocks take the same way as in one; the commonest keys and the others come to the same."""

import pytest
from pyspark.sql import functions as F

from chronoloom.llm import line_dedup


@pytest.fixture(scope="module")
def docs(spark):
    lines = ["a line that very many of the documents hold, number %d" % k for k in range(30)]
    rows = [(d, "\n".join([*(x for k, x in enumerate(lines) if d % (k + 1) == 0), f"a line of its own that only document {d} holds, as it says"])) for d in range(300)]
    return spark.createDataFrame([*rows, (None, lines[0]), (300, None), (7, rows[7][1])], "doc_id long, text string").repartition(3)


def kept(docs, index):
    return sorted((r.doc_id is None, r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.dedup_lines(docs, index).collect())


def test_blocks_and_common_keys(spark, docs, monkeypatch):
    index = line_dedup.LineIndex.of(docs)
    whole = kept(docs, index)
    assert sum(r[3] for r in whole) > 500
    made = []
    probed = line_dedup.LineIndex._probed
    monkeypatch.setattr(line_dedup.LineIndex, "_probed", lambda self, shards: made.append(shards) or probed(self, shards))
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 1)
    assert kept(docs, index) == whole and len(made) > 16 and sorted(s for x in made for s in x) == sorted(r.shard for r in index.filters.collect())
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 64 << 20)
    for most in (1, 10):
        monkeypatch.setattr(line_dedup, "COMMONEST", most)
        assert kept(docs, index) == whole


def test_an_empty_table(spark, docs):
    index = line_dedup.LineIndex.of(docs.limit(0))
    assert line_dedup.dedup_lines(docs.limit(0), index).count() == 0
    assert line_dedup.dedup_lines(docs, index).agg(F.sum("n_dropped")).first()[0] == 0


def test_a_very_long_text(spark):
    long = "\n".join(f"this is line number {k % 5000} of a very long text that repeats itself" for k in range(60_000))
    docs = spark.createDataFrame([(k, long) for k in range(5)], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs, line_dedup.LineIndex.of(docs), whole=False).collect()}
    assert got == {k: (60_000, 60_000 if k < 4 else 0) for k in range(5)}
