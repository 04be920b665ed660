"""Reversible line deduplication: exact reference counts of line keys, with a cuckoo filter for each shard of keys in front.

A line's key is the line without white space at its ends and with A-Z lower-cased; keys of at least `min_chars` code points count. State is three tables:
postings (key, document), counts (key, references, largest document) and filters (a cuckoo filter of each shard's keys with `min_docs` references or
more). A document adds or takes away its postings; keys that cross the threshold enter or leave their shard's filter, so deletions undo insertions.
Keys are 128-bit hashes; no two of 10^12 different lines are expected to share one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, freeing, utf8, written

MIN_CHARS, MIN_DOCS, SHARDS = 40, 5, 64
SLOTS, KICKS = 4, 500
#: Bytes of filters in one broadcast. Keys that are joined by broadcast, the commonest ones: no other key has more than a thousandth of all postings.
FILTER_BYTES, COMMONEST = 64 << 20, 1000
KEY = ["shard", "h1", "h2"]


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key has two buckets, each found from the other and the fingerprint."""

    def __init__(self, buckets: int, table: np.ndarray | None = None) -> None:
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, len(keys)) / (SLOTS * 0.8)))))
        while True:
            out = cls(buckets)
            if all(out.add(int(k)) for k in keys):
                return out
            buckets *= 2

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = keys.view(np.uint64)
        mark = np.maximum(k >> np.uint64(48), np.uint64(1))
        one = k & np.uint64(self.buckets - 1)
        return mark.astype(np.uint16), one.astype(np.int64), (one ^ self._jump(mark)).astype(np.int64)

    def _jump(self, mark):
        return (mark * np.uint64(0x5BD1E995)) & np.uint64(self.buckets - 1)

    def add(self, key: int) -> bool:
        """False if no place was found; the filter is then to be built anew, larger."""
        marks, ones, twos = self._places(np.array([key], np.int64))
        mark, at = marks[0], int(ones[0])
        for place in (at, int(twos[0])):
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = mark
                return True
        for kick in range(KICKS):
            slot = kick % SLOTS
            mark, self.table[at, slot] = self.table[at, slot], mark
            at ^= int(self._jump(np.uint64(mark)))
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        return False

    def remove(self, key: int) -> bool:
        """Take one copy of a key's fingerprint out; only for keys that were added."""
        marks, ones, twos = self._places(np.array([key], np.int64))
        for place in (int(ones[0]), int(twos[0])):
            held = np.flatnonzero(self.table[place] == marks[0])
            if len(held):
                self.table[place, held[0]] = 0
                return True
        return False

    def might_hold(self, keys: np.ndarray) -> np.ndarray:
        marks, ones, twos = self._places(keys)
        return ((self.table[ones] == marks[:, None]) | (self.table[twos] == marks[:, None])).any(1)


def key_of(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The 16-byte key of a line, or None if it is too short to count."""
    if len(line) < min_chars:
        return None
    k = line.strip(b" \t\n\v\f\r").lower()
    if len(k) < min_chars or not k.isascii() and len(k.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(k)


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, shards: int = SHARDS) -> DataFrame:
    """(shard, h1, h2, doc): every key that counts, once for each document that holds it. Rows with a null key hold none; rows that share one are one document."""
    arrow = pa.schema([("shard", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, of = [], []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                mine = {k for line in raw.as_buffer().to_pybytes().split(b"\n") if (k := key_of(line, min_chars))}
                found += mine
                of += [doc] * len(mine)
            h = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            shard = (h[:, 1].view(np.uint64) % np.uint64(shards)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(of, pa.int64())], schema=arrow)

    rows = docs.where(docs[key].isNotNull()).select(docs[key].cast("long").alias("doc"), utf8(text).alias("raw"))
    return rows.mapInArrow(freeing(run), "shard int, h1 long, h2 long, doc long").distinct()


def counted(posted: DataFrame) -> DataFrame:
    return posted.groupBy(*KEY).agg(F.count("*").alias("refs"), F.max("doc").alias("last"))


def built(counts: DataFrame, min_docs: int) -> DataFrame:
    """(shard, n_keys, buckets, cells): a filter for each shard; a shard's keys are bounded by choosing enough shards."""

    def run(group: pa.Table) -> pa.Table:
        made = CuckooFilter.of(group.column("h1").to_numpy())
        return pa.table({"shard": group.column("shard")[:1], "n_keys": [group.num_rows], "buckets": [made.buckets], "cells": [made.table.tobytes()]}, schema=pa.schema([("shard", pa.int32()), ("n_keys", pa.int64()), ("buckets", pa.int64()), ("cells", pa.binary())]))

    return counts.where(F.col("refs") >= min_docs).select("shard", "h1").groupBy("shard").applyInArrow(run, "shard int, n_keys long, buckets long, cells binary")


@dataclass
class LineIndex:
    """The three tables, each written to the shared folder. `insert` and `delete` give the next state; the old one stays usable until `close`."""

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS
    shards: int = SHARDS

    @classmethod
    def of(cls, docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int = SHARDS) -> LineIndex:
        posted = written(postings(docs, key, text, min_chars, shards).sortWithinPartitions("shard"), "postings")
        counts = written(counted(posted), "counts")
        return cls(posted, counts, written(built(counts, min_docs), "filters"), min_chars, min_docs, shards)

    def _next(self, posted: DataFrame, counts: DataFrame, touched: DataFrame) -> LineIndex:
        posted, counts = written(posted.select(*KEY, "doc").sortWithinPartitions("shard"), "postings"), written(counts.select(*KEY, "refs", "last"), "counts")
        return LineIndex(posted, counts, written(self._refiltered(counts, touched), "filters"), self.min_chars, self.min_docs, self.shards)

    def _refiltered(self, counts: DataFrame, touched: DataFrame) -> DataFrame:
        """Filters with the touched keys that crossed the threshold put in or taken out; one that runs full is built anew by the exact counts."""
        before = self.counts.select(*KEY, F.col("refs").alias("was"))
        crossing = touched.select(*KEY).distinct().join(before, KEY, "left").join(counts.select(*KEY, "refs"), KEY, "left").na.fill(0, ["was", "refs"])
        up, down = f"was < {self.min_docs} and refs >= {self.min_docs}", f"was >= {self.min_docs} and refs < {self.min_docs}"
        steps = crossing.where(f"({up}) or ({down})").select("shard", "h1", F.expr(up).alias("enters"))
        out = "shard int, n_keys long, buckets long, cells binary"

        def run(old: pa.Table, new: pa.Table) -> pa.Table:
            schema = pa.schema([("shard", pa.int32()), ("n_keys", pa.int64()), ("buckets", pa.int64()), ("cells", pa.binary())])
            row = old.to_pylist()[0] if old.num_rows else {"shard": new.column("shard")[0].as_py(), "n_keys": 0, "buckets": 4, "cells": bytes(4 * SLOTS * 2)}
            made = CuckooFilter(row["buckets"], np.frombuffer(row["cells"], np.uint16).reshape(-1, SLOTS).copy())
            full = False
            for step in sorted(new.to_pylist(), key=lambda s: s["enters"]):
                ok = made.add(step["h1"]) if step["enters"] else made.remove(step["h1"])
                row["n_keys"] += 1 if step["enters"] else -1
                full |= not ok
            if full:  # marked; see below
                return pa.Table.from_pylist([row | {"buckets": -1, "cells": b""}], schema=schema)
            return pa.Table.from_pylist([row | {"buckets": made.buckets, "cells": made.table.tobytes()}], schema=schema)

        moved = written(self.filters.groupBy("shard").cogroup(steps.groupBy("shard")).applyInArrow(run, out), "moved")
        full = moved.where("buckets < 0").select("shard")
        return moved.where("buckets > 0").unionByName(built(counts.join(full, "shard", "left_semi"), self.min_docs))

    def insert(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> LineIndex:
        """With these documents added; a document that is there already adds only keys it didn't have."""
        new = written(postings(docs, key, text, self.min_chars, self.shards).join(self.postings, [*KEY, "doc"], "left_anti"), "new")
        counts = self.counts.unionByName(counted(new)).groupBy(*KEY).agg(F.sum("refs").alias("refs"), F.max("last").alias("last"))
        return self._next(self.postings.unionByName(new), counts, new)

    def delete(self, ids: DataFrame, key: str = "doc_id") -> LineIndex:
        """Without the documents of these ids: the counts of the keys they held are taken anew from the postings that stay."""
        gone = ids.select(ids[key].cast("long").alias("doc")).distinct()
        touched = written(self.postings.join(gone, "doc", "left_semi").select(*KEY).distinct(), "touched")
        left = self.postings.join(gone, "doc", "left_anti")
        counts = self.counts.join(touched, KEY, "left_anti").unionByName(counted(left.join(touched, KEY, "left_semi")))
        return self._next(left, counts, touched)

    def close(self) -> None:
        forget(self.postings, self.counts, self.filters)

    def _probed(self, shards: list[int]) -> DataFrame:
        """The postings of some shards that their filters might hold, written out. Postings lie by shard within their files, so others are skipped."""
        mine = F.col("shard").isin(shards)
        shared = self.postings.sparkSession.sparkContext.broadcast({r.shard: (r.buckets, bytes(r.cells)) for r in self.filters.where(mine).collect()})

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {s: CuckooFilter(b, np.frombuffer(c, np.uint16).reshape(-1, SLOTS)) for s, (b, c) in shared.value.items()}
            for batch in batches:
                shard, h1 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                keep = np.zeros(len(h1), bool)
                order = np.argsort(shard, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                    if len(part) and (f := filters.get(int(shard[part[0]]))):
                        keep[part] = f.might_hold(h1[part])
                yield batch.filter(pa.array(keep))

        found = written(self.postings.where(mine).mapInArrow(freeing(probe), "shard int, h1 long, h2 long, doc long"), "likely")
        shared.unpersist()
        return found

    def drops(self) -> DataFrame:
        """(doc, drop array<binary>): for each document the keys whose lines it loses: those of `min_docs` documents or more, unless it is the largest of them.

        Each shard's filter is probed first, so that few postings reach the join with the exact counts. Filters are broadcast in blocks of shards of
        FILTER_BYTES at most (or a single larger one), any number of blocks, one after the other. In the join the commonest keys are broadcast.
        """
        blocks: list[list[int]] = [[]]
        held = 0
        for shard, size in self.filters.select("shard", F.octet_length("cells")).orderBy("shard").collect():  # a row a shard
            if blocks[-1] and held + size > FILTER_BYTES:
                blocks.append([])
                held = 0
            blocks[-1].append(shard)
            held += size
        likely = reduce(DataFrame.unionByName, [self._probed(x) for x in blocks])
        hot = self.counts.where(F.col("refs") >= self.min_docs)
        common = hot.orderBy(F.desc("refs"), *KEY).limit(COMMONEST).select(*KEY, F.col("last").alias("most"))
        split = likely.join(F.broadcast(common), KEY, "left")
        rest = split.where("most is null").drop("most").join(hot, KEY).where("doc < last")
        lost = split.where("doc < most").select("doc", "h1", "h2").unionByName(rest.select("doc", "h1", "h2"))
        return lost.groupBy("doc").agg(F.collect_list(F.struct("h1", "h2")).alias("drop"))


def dedup_lines(docs: DataFrame, index: LineIndex, key: str = "doc_id", text: str = "text", whole: bool = True) -> DataFrame:
    """`docs` with columns n_lines, n_dropped and kept (the text without dropped lines, joined by newlines); without the text itself unless `whole`.

    Null and empty texts have one empty line, which stays. Rows with a null key lose nothing; rows that share a key are one document and lose the same
    lines. Added columns replace those of the same name.
    """
    doc, drop, raw_text = "__doc", "__drop", "__text"
    rows = docs.drop("n_lines", "n_dropped", "kept").withColumn(doc, docs[key].cast("long")).join(index.drops().select(F.col("doc").alias(doc), F.col("drop").alias(drop)), doc, "left")
    rest = [c for c in rows.columns if c not in (doc, drop, text)]
    last = [text] if whole else []
    min_chars = index.min_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for value, gone in zip(batch.column(raw_text), batch.column(drop), strict=True):
                raw, gone = value.as_buffer().to_pybytes() if value.is_valid else b"", gone.as_py()
                lines = raw.split(b"\n")
                stay = lines
                if gone:
                    keys = {np.array([g["h1"], g["h2"]], np.int64).tobytes() for g in gone}
                    stay = [x for x in lines if key_of(x, min_chars) not in keys]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append(raw if stay is lines else b"\n".join(stay))
            kept = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *[batch.column(raw_text)][: len(last)], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), kept], [*rest, *last, "n_lines", "n_dropped", "kept"])

    ready = rows.select(*rest, F.col(text).alias(raw_text), drop)
    schema = rows.select(*rest, *last).schema.add("n_lines", "long").add("n_dropped", "long").add("kept", "string")
    return ready.mapInArrow(freeing(run), schema)
