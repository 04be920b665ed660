"""Benchmark decontamination: windows of benchmark words as a broadcast hash set, looked for in the words of every training document.

A document's words are numbered by the benchmark's vocabulary, 0 for any other word. A window can only occur in a run of numbered words at least as
long, so only such runs are looked up, and a hit is a match of all its words, not of a hash alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, freeing, utf8, written

N = 10
#: Words are runs of these bytes of the UTF-8: digits, letters, and all of any character beyond ASCII. A-Z become lower case.
WORDS = bytes(ord(" ") if b < 0x30 or 0x39 < b < 0x41 or 0x5A < b < 0x61 or 0x7A < b < 0x80 else b + 32 * (0x41 <= b <= 0x5A) for b in range(256))
#: Bytes of benchmark text that one broadcast set may be made of; more items make more sets, each with a pass of its own.
BLOCK_BYTES = 16 << 20


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(WORDS).split(b" ")


def split_words(raw: bytes) -> list[bytes]:
    return [w for w in words_of(raw) if w]


class Windows:
    """Windows of benchmark items, by their length: sorted hashes of their word numbers, and where in `flat`, the items' words one after the other, each one is."""

    def __init__(self, items: list[tuple[str, bytes]], n: int = N) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        number = self.vocabulary.setdefault
        words = [np.array([number(w, len(self.vocabulary) + 1) for w in split_words(raw)], np.int32) for _, raw in items]
        self.flat = np.concatenate([np.zeros(0, np.int32), *words])
        size = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(size) - size
        self.sets: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in np.unique(np.minimum(size[size > 0], n)).tolist():
            mine = np.flatnonzero(np.minimum(size, n) == width)
            counts = size[mine] - width + 1
            at = np.repeat(first[mine] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            h = self._hashes(self.flat, at, width)
            order = np.argsort(h, kind="stable")
            self.sets[width] = h[order], at[order], np.repeat(mine, counts)[order]

    @staticmethod
    def _hashes(ids: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for k in range(width):
            h = (h ^ ids[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in a window's occurrence, and the items whose windows occur. A hash only proposes a window; its words decide."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))
        hit, items = np.zeros(len(words), bool), set()
        sums = np.concatenate([[0], np.cumsum(ids > 0)])
        for width, (hashes, places, owners) in self.sets.items():
            at = np.flatnonzero(sums[width:] - sums[:-width] == width)
            if not len(at):
                continue
            h = self._hashes(ids, at, width)
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for a, lo, hi in zip(*(x[low < high].tolist() for x in (at, low, high)), strict=True):
                steps = np.arange(width)
                same = (self.flat[places[lo:hi, None] + steps] == ids[a : a + width]).all(1)
                if same.any():
                    hit[a : a + width] = True
                    items.update(self.names[k] for k in owners[lo:hi][same].tolist())
        return hit, items


def digest(items: set[str] | list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def blocks(benchmark: DataFrame, item: str, text: str, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's items in lists of at most `most` bytes of text (one item at least), streamed to the driver one partition at a time."""
    part, size = [], 0
    for row in benchmark.select(F.coalesce(benchmark[item].cast("string"), F.lit("null")).alias("item"), utf8(text).alias("raw")).toLocalIterator():
        if part and size + len(row.raw) > most:
            yield part
            part, size = [], 0
        part.append((row.item, bytes(row.raw)))
        size += len(row.raw)
    yield part


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", n: int = N, remove: str | None = None, keep: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, n_words, n_hit, n_items, items, items_sha256, contaminated), the columns of `keep`, and with remove="spans" clean_text: the text without hit spans.

    Texts are lower-cased (A-Z) and cut into words; a window is n consecutive words of an item, or all of them where it has fewer; a word is hit if it
    lies in any occurrence. Null texts have no words. An item without words occurs nowhere; a null item id counts as "null"; items of equal text
    occur together. Every row is worked on alone, whatever its key; other columns are dropped. A span to remove reaches from its first word's first
    byte to its last word's last.

    The benchmark's size is never taken on trust: it is cut into blocks of `block_bytes`, each a broadcast set of its own, and every document goes
    through the sets one after the other, taking its hits along. The driver holds one block at a time; from the second one on, documents with their hits
    so far are a written table, so that no task holds two sets.
    """
    rows = docs.select(docs[key].cast("long").alias(key), utf8(text).alias("__raw"), F.lit(b"").alias("__bits"), F.array().cast("array<string>").alias("items"), *keep)
    for k, part in enumerate(blocks(benchmark, item, text, block_bytes)):
        if k:
            done = written(rows, "scanned")
            if k > 1:
                forget(before)
            rows = before = done
        rows = _marked(rows, part, n)
    return _finished(rows, key, remove, keep)


def _marked(rows: DataFrame, part: list[tuple[str, bytes]], n: int) -> DataFrame:
    """`rows` with a block's items and hit words added to items and __bits."""
    shared = rows.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(shared.value, n)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                bits, found = [], []
                for raw, old, items in zip(*(batch.column(c) for c in ("__raw", "__bits", "items")), strict=True):
                    hit, new = windows.scan(split_words(raw.as_buffer().to_pybytes()))
                    old = old.as_buffer().to_pybytes()
                    bits.append(old if not new else _merged(old, hit))
                    found.append(items.as_py() if not new else sorted({*items.as_py(), *new}))
                columns = {"__bits": pa.array(bits, pa.binary()), "items": pa.array(found, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([columns.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

    return rows.mapInArrow(freeing(run), rows.schema)


def _merged(old: bytes, hit: np.ndarray) -> bytes:
    return np.packbits(hit if not old else hit | np.unpackbits(np.frombuffer(old, np.uint8), count=len(hit)).view(bool)).tobytes()


def _finished(rows: DataFrame, key: str, remove: str | None, keep: tuple[str, ...]) -> DataFrame:
    kinds = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_()} | ({"clean_text": pa.string()} if remove == "spans" else {})
    first = [key, "items", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out: dict[str, list] = {c: [] for c in kinds}
                for raw, bits, items in zip(*(batch.column(c) for c in ("__raw", "__bits", "items")), strict=True):
                    raw, bits, items = raw.as_buffer().to_pybytes(), bits.as_buffer().to_pybytes(), items.as_py()
                    n = len(split_words(raw))
                    hit = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).view(bool) if bits else np.zeros(0, bool)
                    values = {"n_words": n, "n_hit": int(hit.sum()), "n_items": len(items), "items_sha256": digest(items), "contaminated": bool(hit.any())}
                    if remove == "spans":
                        values["clean_text"] = without(raw, hit) if hit.any() else raw.decode("utf-8", "replace")
                    for c, v in values.items():
                        out[c].append(v)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in first), *(pa.array(v, kinds[c]) for c, v in out.items())], [*first, *out])

    schema = rows.select(*first).schema
    for c in kinds:
        schema = schema.add(c, {"contaminated": "boolean", "items_sha256": "string", "clean_text": "string"}.get(c, "long"))
    return rows.mapInArrow(freeing(run), schema)


def without(raw: bytes, hit: np.ndarray) -> str:
    """A text without its runs of hit words and what stands between them."""
    low = raw.translate(WORDS)
    out, at, k, end = [], 0, 0, 0
    for w in low.split(b" "):
        if w:
            start = end
            if hit[k] and not (k and hit[k - 1]):
                out.append(raw[at:start])
            if hit[k]:
                at = start + len(w)
            k += 1
        end += len(w) + 1
    return (b"".join(out) + raw[at:]).decode("utf-8", "replace")
