"""Byte-level BPE encoding and decoding of whole texts, of any length.

Texts are cut into chunks that overlap. Chunks are split into pre-tokens on their own, also where a chunk starts within one; since a pre-token depends
only on what follows its start, two neighbours agree from the first start on that both have in their overlap, and are stitched there. The pieces are
then encoded one by one. Texts over `split_chars` are exploded into chunk rows that all executors share; others are worked on where they lie.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing

CHUNK, OVERLAP, SPLIT = 1 << 16, 1 << 9, 1 << 19
#: A match that ends so many characters before a chunk's end would be the same without the cut: contractions look 3 ahead, white space 2.
MARGIN = 4
PIECES = 150_000


class Coder:
    """Encodes pieces by a file of ranks; pieces seen are kept, at most PIECES of them."""

    def __init__(self, ranks: str, pattern: str) -> None:
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in table.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.split = regex.compile(pattern)
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.seen: dict[str, tuple[int, ...]] = {}

    def encode_pieces(self, pieces: list[str]) -> list[int]:
        seen = self.seen
        if missing := set(pieces).difference(seen):
            if len(seen) > PIECES:
                seen.clear()
                missing = set(pieces)
            for piece in missing:
                seen[piece] = tuple(self.library.encode_ordinary(piece))
        return list(chain.from_iterable(map(seen.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def coder(ranks: str, pattern: str) -> Coder:
    return Coder(ranks, pattern)


def starts_of(split: regex.Pattern, chunk: str, at: int, last: bool) -> list[int]:
    """Where the pre-tokens of a chunk that begins at `at` start, and where the last one ends; unless it is the last chunk, only those that the cut can't have changed."""
    found = [at]
    for m in split.finditer(chunk):
        if not last and m.end() > len(chunk) - MARGIN:
            break
        found.append(at + m.end())
    return found


def stitched(split: regex.Pattern, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Boundaries of all pre-tokens of a text, chunk by chunk."""
    if len(text) <= chunk + overlap:
        return starts_of(split, text, 0, True)
    parts = [starts_of(split, text[a : a + chunk + overlap], a, a + chunk + overlap >= len(text)) for a in range(0, len(text), chunk)]
    return join_parts(split, text, parts)


def join_parts(split: regex.Pattern, text: str, parts: list[list[int]]) -> list[int]:
    """Stitch the boundaries of neighbouring chunks where they first agree; where they don't within the overlap, split on from the last sure boundary until they do."""
    out = parts[0]
    for part in parts[1:]:
        if out[-1] >= part[-1]:
            continue
        mine = set(part)
        k = bisect_left(out, part[0])
        while k < len(out) and out[k] not in mine:
            k += 1
        if k == len(out):  # no common start yet
            at, reach = out[-1], 1 << 12
            while out[-1] not in mine and out[-1] < part[-1]:
                cut = text[at : at + reach]
                more = starts_of(split, cut, at, at + reach >= len(text))[1:]
                if not more:
                    reach *= 2
                    continue
                for x in more:
                    out.append(x)
                    if x in mine:
                        break
                at, reach = out[-1], 1 << 12
            k = len(out) - 1
        if out[k] in mine:
            out = out[:k] + part[bisect_left(part, out[k]) :]
    return out


def pieces_of(text: str, bounds: list[int]) -> list[str]:
    return [text[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def encode_text(c: Coder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    if len(text) <= chunk + overlap:
        return c.encode_pieces(c.split.findall(text))
    return c.encode_pieces(pieces_of(text, stitched(c.split, text, chunk, overlap)))


FIELDS = {"n_tokens": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "ids_sha256": ("string", pa.string()), "decoded": ("binary", pa.binary()), "decoded_sha256": ("string", pa.string())}


def _row(c: Coder, ids: list[int], wanted: tuple[str, ...]) -> dict:
    out: dict = {"n_tokens": len(ids), "ids": ids}
    if "ids_sha256" in wanted:
        out["ids_sha256"] = hashlib.sha256(" ".join(map(c.text_of.__getitem__, ids)).encode()).hexdigest()
    if "decoded" in wanted or "decoded_sha256" in wanted:
        out["decoded"] = c.decode(ids)
        out["decoded_sha256"] = hashlib.sha256(out["decoded"]).hexdigest()
    return out


def encode_documents(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", columns: tuple[str, ...] = ("n_tokens", "ids"), split_chars: int = SPLIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, *columns) with columns among n_tokens, ids, ids_sha256, decoded, decoded_sha256; `ranks` is a path that all executors have.

    One row per row of `docs`; a null text is an empty one and has no tokens. Repeated rows and null keys come out as they are: rows that share a key
    are told apart by their text, and equal ones counted and repeated. Other columns are dropped.
    """
    schema = f"{key} long, " + ", ".join(f"{x} {FIELDS[x][0]}" for x in columns)

    def emit(keys: list, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array([r[x] for r in rows], FIELDS[x][1]) for x in columns)], [key, *columns])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield emit(part.column(0).to_pylist(), [_row(c, encode_text(c, t.as_py(), chunk, overlap), columns) for t in part.column(1)])
        c.seen = {}  # the worker lives on

    whole = docs.select(docs[key].cast("long").alias(key), F.coalesce(docs[text], F.lit("")).alias("text"))
    small = whole.where(F.length("text") <= split_chars).mapInArrow(freeing(local), schema)
    return small.unionByName(_long(whole.where(F.length("text") > split_chars), key, ranks, pattern, schema, emit, columns, chunk, overlap))


def _long(docs: DataFrame, key: str, ranks: str, pattern: str, schema: str, emit, columns: tuple[str, ...], chunk: int, overlap: int) -> DataFrame:
    """Long texts: a row per chunk, split and encoded on all executors, then stitched by document."""
    docs = docs.groupBy(key, "text").agg(F.count("*").alias("copies"))
    rows = docs.select(key, "copies", F.md5("text").alias("of"), F.length("text").alias("size"), "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk).cast("int"))).alias("k"))
    rows = rows.select(key, "copies", "of", "size", "k", F.substring("text", F.col("k") * chunk + 1, F.lit(chunk + overlap)).alias("chunk")).repartition(F.col("of"), F.col("k"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks, pattern)
        for batch in batches:
            for row in batch.to_pylist():
                at = row["k"] * chunk
                bounds = starts_of(c.split, row["chunk"], at, at + chunk + overlap >= row["size"])
                pieces = pieces_of(row["chunk"], [b - at for b in bounds])
                counts, ids = [], []
                for piece in pieces:
                    one = c.encode_pieces([piece])
                    counts.append(len(one))
                    ids += one
                packed = [np.asarray(x, np.int32 if x is not bounds else np.int64).tobytes() for x in (bounds, counts, ids)]
                yield pa.RecordBatch.from_pylist([{**row, "bounds": packed[0], "counts": packed[1], "ids": packed[2]}], schema=full)
        c.seen = {}

    kinds = f"{key} long, copies long, of string, size int, k int, chunk string, bounds binary, counts binary, ids binary"
    full = pa.schema([(key, pa.int64()), ("copies", pa.int64()), ("of", pa.string()), ("size", pa.int32()), ("k", pa.int32()), ("chunk", pa.string()), ("bounds", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])

    def join(group: pa.Table) -> pa.Table:
        c = coder(ranks, pattern)
        rows = sorted(group.to_pylist(), key=lambda r: r["k"])
        parts = [np.frombuffer(r["bounds"], np.int64).tolist() for r in rows]
        body = "".join(r["chunk"][:chunk] for r in rows)
        bounds = join_parts(c.split, body, parts)
        known: dict[tuple[int, int], list[int]] = {}
        for r, b in zip(rows, parts, strict=True):
            ids, counts = np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.int32)
            ends = np.cumsum(counts)
            known.update({(b[i], b[i + 1]): ids[ends[i] - counts[i] : ends[i]].tolist() for i in range(len(counts))})
        ids = list(chain.from_iterable(known[x] if (x := (a, z)) in known else c.encode_pieces([body[a:z]]) for a, z in zip(bounds, bounds[1:], strict=False)))
        n = rows[0]["copies"]
        return pa.Table.from_batches([emit([rows[0][key]] * n, [_row(c, ids, columns)] * n)])

    return rows.mapInArrow(freeing(split), kinds).groupBy(key, "of").applyInArrow(join, schema)


def decode_documents(encoded: DataFrame, ranks: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded binary): the bytes of the ids, joined. A null list is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x.as_py() or []) for x in batch.column(1)], pa.binary())], [key, "decoded"])

    return encoded.select(encoded[key].cast("long").alias(key), encoded[ids].alias("ids")).mapInArrow(freeing(run), f"{key} long, decoded binary")
