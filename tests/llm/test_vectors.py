"""Operators on embeddings against numpy, on small tables that hold the awkward cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import multi_index, whitening

FORM = "vec_id long, embedding array<float>, n string, cell int, id string, x double, component int"


def table(spark, rows, parts=3):
    """Rows of (key, vector), beside columns whose names clash with the operators' own."""
    return spark.createDataFrame([(k, v, "n", 1, "id", 0.5, 3) for k, v in rows], FORM).repartition(parts)


def awkward(d):
    return [(900, None), (901, [1.0] * (d - 1) + [None]), (902, [float("nan")] + [0.0] * (d - 1)), (903, [float("inf")] * d), (904, [-float("inf")] + [1.0] * (d - 1)), (905, [0.5] * (d + 3)), (906, [])]


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(5)
    lot = r.standard_normal((300, 12)) * np.linspace(3, 0.2, 12) + 7
    lot[200:] = lot[150]  # a third are copies
    return [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(lot)]


def exact(rows):
    x = np.floor(np.array([v for _, v in rows]) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    y = (n * x - s) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    return n, ((n * x - s) ** 2).sum(1), y, e[::-1], u[:, ::-1], np.trace(y.T @ y / n)


@pytest.mark.parametrize("block", [1, 16])
def test_whitening(spark, vectors, block):
    got = whitening.whiten(table(spark, vectors + awkward(12)), block=block).collect()
    n, off, y, e, u, trace = exact(vectors)
    assert len(got) == 8 * n and {(r.vec_id, r.component) for r in got} == {(k, c) for k in range(n) for c in range(1, 9)}
    want = y @ u[:, :8] / np.sqrt(e[:8])
    sign = {r.component: np.sign(r.whitened * want[r.vec_id, r.component - 1]) for r in got if r.vec_id == 0}
    for r in got:
        assert r.n == n and r.deviation == off[r.vec_id]
        assert math.isclose(sign[r.component] * r.whitened, want[r.vec_id, r.component - 1], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.explained, e[r.component - 1] / trace, rel_tol=1e-12) and r.identity_error < 1e-10


def test_whitening_of_little(spark):
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])] * 9)).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])]).limit(0)).count() == 0
    assert whitening.whiten(table(spark, [(1, []), (2, None)])).count() == 0
    # one direction of variance; a null key and repeated rows are rows like others
    rows = whitening.whiten(table(spark, [(None, [0.0, 1.0]), (3, [2.0, 5.0]), (3, [2.0, 5.0])])).collect()
    assert sorted((r.vec_id is None, r.component, r.n) for r in rows) == [(False, 1, 3), (False, 1, 3), (True, 1, 3)]
    assert math.isclose(sum(r.whitened**2 for r in rows) / 3, 1) and math.isclose(rows[0].explained, 1)


def test_whitening_of_far_values(spark):
    """Sums and deviations stay exact where floats would not be; what no long holds is null."""
    rows = [(k, [2.0**38 + k * 2.0**20, float(k % 3)]) for k in range(64)] + [(99, [2.0**41, 0.0])]
    got = whitening.whiten(table(spark, rows)).where("component = 1").collect()
    n, off, *_ = 64, None
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows[:64]]
    sums = [sum(c) for c in zip(*x, strict=True)]
    for r in got:
        want = sum((n * c - s) ** 2 for c, s in zip(x[r.vec_id], sums, strict=True))
        assert r.deviation == (want if want < 1 << 63 else None)
    assert len(got) == 64 and got[0].identity_error < 1e-4


@pytest.mark.parametrize("values", [np.repeat([5.0, 3.0, 1.0, 0.0], 10), np.array([5.0, 3.0] + [0.0] * 38), np.array([4.0] * 7 + [2.0] * 33), np.zeros(40)])
def test_lanczos_restarts(values):
    """Few distinct eigenvalues: a block's powers soon span nothing new, and each eigenvalue stands several times."""
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((40, 40)))[0]
    v = q * values @ q.T
    asked = []
    e, u = whitening.lanczos(lambda b: asked.append(b.shape[1]) or v @ b, 40, 8, block=4)
    assert np.allclose(e, values[:8], atol=1e-12) and np.allclose(v @ u, values[:8] * u, atol=1e-10) and np.allclose(u.T @ u, np.eye(8), atol=1e-12)
    assert sum(asked) <= 40


def nearest(rows, asked, k=10):
    """Brute force: of rows that share a key the least vector counts."""
    best = {}
    for i, v in rows:
        best[i] = min(v, best.get(i, v))
    ids = np.array(sorted(best))
    lot = np.array([best[i] for i in ids])
    out = []
    for q in asked:
        far = np.sqrt(((lot - np.array(best[q])) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, far)) if ids[j] != q][:k]
        out += [(q, p, int(ids[j]), float(far[j])) for p, j in enumerate(order, 1)]
    return out


def asks(key):
    return key % 100 == 0


def test_search_with_many_copies(spark):
    """A third of the rows are equal: ties go to the smaller key, however many there are."""
    r = np.random.default_rng(3)
    lot = r.standard_normal((3000, 8)).astype(np.float32).astype(float)
    lot[1000:2000] = lot[100]
    rows = [(k, v.tolist()) for k, v in enumerate(lot)]
    extra = [(k, v) for k, v in awkward(8)] + [(910, [0.0] * 8), (None, [1.0] * 8)]
    rows = [x for x in rows if x[0] not in {k for k, _ in extra}] + [(100, lot[100].tolist()), (7, [9.0] * 8)]
    got = [tuple(x) for x in multi_index.search(table(spark, rows + extra, 5), asks).collect()]
    want = nearest(rows, sorted({k for k, _ in rows if k % 100 == 0}))
    by_key = {(q, v): s for q, _, v, s in want}
    assert len({(q, p) for q, p, _, _ in got}) == len(got) == len(want)
    assert sum((q, v) in by_key for q, _, v, _ in got) >= 0.9 * len(want)
    assert all(by_key.get((q, v), s) == s for q, _, v, s in got)
    of = lambda rows, q: sorted(x for x in rows if x[0] == q)
    for q in (100, 1000, 1900):
        assert of(got, q) == of(want, q) and of(got, q)[0][3] == 0.0


def test_search_orders_what_it_finds(spark):
    got = multi_index.search(table(spark, [(k, np.random.default_rng(k).standard_normal(6).tolist()) for k in range(400)]), asks).collect()
    for q in (0, 100, 200, 300):
        mine = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)


def test_search_of_little(spark):
    few = [(0, [1.0, 2.0]), (5, [1.0, 2.5]), (100, [3.0, 3.0])]
    assert sorted(map(tuple, multi_index.search(table(spark, few), asks).collect())) == nearest(few, [0, 100])
    assert multi_index.search(table(spark, few[:1]), asks).count() == 0
    assert multi_index.search(table(spark, few).limit(0), asks).count() == 0
    assert multi_index.search(table(spark, [(1, [1.0]), (2, [2.0])]), asks).count() == 0
    assert sorted(map(tuple, multi_index.search(table(spark, [(0, [1.0]), (2, [2.0])]), asks).collect())) == [(0, 1, 2, 1.0)]


def test_many_blocks_of_queries(spark, monkeypatch):
    """Queries beyond one block take the same way, one pass each."""
    rows = [(k * 50, np.random.default_rng(k).standard_normal(6).astype(np.float32).astype(float).tolist()) for k in range(500)]
    whole = sorted(map(tuple, multi_index.search(table(spark, rows), asks).collect()))
    monkeypatch.setattr(multi_index, "QUERY_BYTES", 6 * 8 * 30)
    assert sorted(map(tuple, multi_index.search(table(spark, rows), asks).collect())) == whole and len(whole) == 2500


def test_cells_come_off_the_heap_in_order():
    r = np.random.default_rng(2)
    a, b, counts = r.random(9), r.random(7), r.integers(0, 5, (9, 7))
    cells = multi_index.Cells(np.zeros((9, 1)), np.zeros((7, 1)))
    order = sorted((a[i] + b[j], counts[i, j]) for i in range(9) for j in range(7))
    for least in (1, 20, counts.sum()):
        seen = 0
        for far, c in order:
            seen += c
            if seen >= least:
                break
        assert math.isclose(cells.reach(a, b, counts, least), far, rel_tol=1e-8)
    assert cells.reach(a, b, counts, counts.sum() + 1) == np.inf


def test_recall_of_clustered_vectors(spark):
    """On vectors in clusters few cells are visited, and still nine tenths of the neighbours are found."""
    r = np.random.default_rng(8)
    centres = r.standard_normal((40, 16)) * 3
    lot = (centres[r.integers(0, 40, 6000)] + 0.3 * r.standard_normal((6000, 16))).astype(np.float32).astype(float)
    rows = [(k, v.tolist()) for k, v in enumerate(lot)]
    got = {(x.query_id, x.vec_id) for x in multi_index.search(table(spark, rows), asks).collect()}
    want = {(q, v) for q, _, v, _ in nearest(rows, range(0, 6000, 100))}
    assert len(got & want) >= 0.9 * len(want)
    assert multi_index.fit(lot[:4000], 14)[1] < 0.2


def test_column_types(spark):
    """Doubles are searched as they are, and keys of any whole type."""
    rows = spark.createDataFrame([(0, [0.1, 0.2]), (1, [0.1, 0.2000001])], "vec_id int, embedding array<double>")
    assert [tuple(x) for x in multi_index.search(rows, asks).collect()] == [(0, 1, 1, math.sqrt((0.2 - 0.2000001) ** 2))]
    assert whitening.whiten(rows.withColumn("embedding", F.transform("embedding", lambda c: c * 1e4))).count() == 2
