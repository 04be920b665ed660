"""Hashed word shingles of many texts at once, from their bytes and without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BLOCK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2^64."""
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _words(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word (run of other bytes than space and 09-0D; A-Z as a-z) of a block that begins and ends with a space."""
    b = np.frombuffer(block.lower(), np.uint8)
    space = SPACE[b]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    size = 1 << max(20, (len(b) - 1).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)), starts


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A long text in pieces of about BLOCK bytes, cut at spaces; a longer word stays whole."""
    at = 0
    while len(raw) - at > BLOCK:
        cut = max(raw.rfind(s, at, at + BLOCK) for s in (b" ", b"\n", b"\t"))
        if cut <= at:
            found = [x for x in (raw.find(s, at + BLOCK) for s in (b" ", b"\n", b"\t")) if x >= 0]
            if not found:
                break
            cut = min(found)
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def word_hashes(raws: list[bytes]) -> list[np.ndarray]:
    """The hashes of the words of each text, in order."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if group:
            h, starts = _words(b" " + b" ".join(group) + b" ")
            ends = np.cumsum([len(r) + 1 for r in group])
            out.extend(np.split(h, np.searchsorted(starts, ends[:-1] + 1)))
            group, size = [], 0

    for raw in raws:
        if len(raw) > BLOCK:
            flush()
            out.append(np.concatenate([_words(b" " + p + b" ")[0] for p in _pieces(raw)]))
            continue
        if size + len(raw) > BLOCK:
            flush()
        group.append(raw)
        size += len(raw) + 1
    flush()
    return out


def shingled(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of a text's runs of n words, in order; of all its words as one run if it has fewer; none without words."""
    k = min(n, len(words))
    if not k:
        return words
    m = len(words) - k + 1
    h = np.full(m, k, np.uint64)
    for i in range(k):
        h = mixed(h * np.uint64(BASE) + words[i : i + m])
    return h


def shingle_sets(raws: list[bytes], n: int = 5) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    return [np.unique(shingled(w, n)) for w in word_hashes(raws)]
