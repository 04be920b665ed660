"""Candidate pairs of the n-gram Jaccard join: the same as by brute force in all ways of pairing, in bounded memory."""

import tracemalloc

import numpy as np
import pytest

from chronoloom.llm import jaccard


def made(near, loose=0, seed=1):
    """Sets of near copies that share their first shingles, and others that share three of these."""
    rng = np.random.default_rng(seed)
    base = rng.integers(1, 1 << 60, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) > 0.06 * rng.random()], rng.integers(1, 1 << 60, rng.integers(0, 20)).astype(np.uint64)])) for _ in range(near)]
    sets += [np.unique(np.concatenate([base[:3], rng.integers(1, 1 << 60, 200).astype(np.uint64)])) for _ in range(loose)]
    cells = np.stack([np.bincount((s % np.uint64(jaccard.CELLS)).astype(int), minlength=jaccard.CELLS) for s in sets]).astype(np.uint8)
    doc = rng.permutation(len(sets)).astype(np.int64) * 7
    return doc, np.array([len(s) for s in sets], np.int64), cells, [np.intersect1d(s, base[:12]) for s in sets]


def brute(doc, n, label, cells, parts, most):
    found, sets = {}, [set(p.tolist()) for p in parts]
    for i in range(len(doc)):
        for j in range(len(doc)):
            if doc[i] < doc[j] and label[i] != label[j] and sets[i] & sets[j] and 100 * min(n[i], n[j]) >= 75 * max(n[i], n[j]):
                score = np.float32(np.minimum(cells[i], cells[j]).sum(dtype=np.int64) / jaccard.needed(n[i], n[j]))
                if score >= 1:
                    found.setdefault(int(doc[j]), []).append((-score, int(doc[i])))
    return {(a, b) for b, v in found.items() for _, a in sorted(v)[:most]}


@pytest.mark.parametrize("large, pairs", [(64, 1 << 20), (5, 300), (1000, 500)])
def test_partners_are_those_of_brute_force(monkeypatch, large, pairs):
    monkeypatch.setattr(jaccard, "LARGE", large)
    monkeypatch.setattr(jaccard, "PAIRS", pairs)
    doc, n, cells, parts = made(60, 30)
    for label in (doc, doc // 3 % 17, np.zeros(len(doc), np.int64)):
        for most in (3, None):
            got = [x for a, b in jaccard.partners(doc, n, label, cells, parts, most, 75) for x in zip(a.tolist(), b.tolist(), strict=True)]
            assert set(got) == brute(doc, n, label, cells, parts, most)
            assert most is None or len(got) == len(set(got))


def test_memory_grows_with_the_sets_not_their_pairs():
    peaks = []
    for m in (1000, 4000):
        doc, n, cells, parts = made(m)
        tracemalloc.start()
        assert sum(len(a) for a, _ in jaccard.partners(doc, n, doc, cells, parts, 3, 75)) == 3 * m - 6
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 150 << 20, peaks


def test_no_sets():
    none = np.zeros(0, np.int64)
    assert all(not len(a) for a, _ in jaccard.partners(none, none, none, np.zeros((0, jaccard.CELLS), np.uint8), [none.astype(np.uint64)], 3, 75))
