"""N-gram Jaccard join by vertical partitioning.

Texts of the same shingle set are one class, with its smallest document as representative. The shingles of all representatives are cut, by hash, into
fragments; a fragment's task counts in how many sets each of its shingles is. With that, shingles have a global order, rare ones first. Two sets that
reach the threshold share a shingle among the first ones of both, so a set whose first ones are in no other set has no partner and goes; this leaves
few sets, and of these only shingles that another set has as well. Candidate pairs come from shared first shingles, again by fragments. They are
verified by counting the overlap in each fragment of the order separately and summing per pair.

Only components are asked for, so a pair within one component needn't be looked at: a first round takes for each set only its most promising partners,
which joins large groups of near copies; the last round takes every pair of sets that are still apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forget, freeing, parts_of, utf8, written
from .shingles import shingle_sets

N, SIMILAR = 5, 75
#: Shingles that a fragment's task holds, sets in one block of a group that shares a shingle, and cells of a set's histogram.
FRAGMENT, GROUP, CELLS = 1 << 19, 20_000, 256
#: Pairs that are held at a time, and members of a group that aren't paired all at once.
PAIRS, LARGE = 1 << 20, 64
ROUNDS = (3, None)


def signatures(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(doc, n, h1, h2): how many shingles each text has, and a 128-bit hash of their set."""
    arrow = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets([r.as_buffer().to_pybytes() for r in batch.column(1)], n)
            h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1])], schema=arrow)

    return docs.select(docs[key].cast("long").alias("doc"), utf8(text).alias("raw")).mapInArrow(freeing(run), "doc long, n long, h1 long, h2 long")


def _packed(x) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _segments(docs: DataFrame, n: int, fragments: int) -> DataFrame:
    """(fragment, docs, sizes, counts, hashes): of each batch of texts, one row a fragment, with the shingles of all its texts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                sets = shingle_sets([r.as_buffer().to_pybytes() for r in batch.column(1)], n)
                docs, sizes = batch.column(0).to_numpy(), np.array([len(s) for s in sets], np.int32)
                every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
                part = (every >> np.uint64(40)) % np.uint64(fragments)
                rows = []
                for f, mine in parts_of(part):
                    at_doc, counts = np.unique(owner[mine], return_counts=True)
                    rows.append({"fragment": f, "docs": _packed(docs[at_doc]), "sizes": _packed(sizes[at_doc]), "counts": _packed(counts.astype(np.int32)), "hashes": _packed(every[mine])})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("fragment", pa.int32()), *((c, pa.binary()) for c in ("docs", "sizes", "counts", "hashes"))]))

    return docs.mapInArrow(freeing(run), "fragment int, docs binary, sizes binary, counts binary, hashes binary")


def _joined(group: pa.Table, column: str, kind) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), kind) for x in group.column(column)]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _shared(segments: DataFrame, buckets: int) -> DataFrame:
    """(bucket, docs, sizes, hashes, found): the shingles that are in two sets or more, with the number of sets, dealt by document."""

    def run(group: pa.Table) -> pa.Table:
        docs, sizes, counts, h = _joined(group, "docs", np.int64), _joined(group, "sizes", np.int32), _joined(group, "counts", np.int32), _joined(group, "hashes", np.uint64)
        owner = np.repeat(np.arange(len(docs), dtype=np.int32), counts)
        order = np.argsort(h)
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        found = np.diff(np.append(first, len(h)))
        keep = np.repeat(found > 1, found)
        h, owner, found = h[keep], owner[order][keep], np.repeat(found, found)[keep].astype(np.int32)
        bucket = (docs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)
        rows = [{"bucket": b, "docs": _packed(docs[owner[x]]), "sizes": _packed(sizes[owner[x]]), "hashes": _packed(h[x]), "found": _packed(found[x])} for b, x in parts_of(bucket[owner])]
        return pa.Table.from_pylist(rows, schema=pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("docs", "sizes", "hashes", "found"))]))

    return segments.groupBy("fragment").applyInArrow(run, "bucket int, docs binary, sizes binary, hashes binary, found binary")


def first_ones(n: int | np.ndarray, similar: int = SIMILAR):
    """How many shingles of a set of n, in the global order, must hold one of any partner's."""
    return n - -(-similar * n // 100) + 1


def _survivors(shared: DataFrame, similar: int) -> DataFrame:
    """(doc, n, first, hashes, found) of sets that can have a partner: their shared shingles in the global order, the first `first` of which partners must meet."""
    arrow = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("hashes", pa.binary()), ("found", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        docs, sizes, h, found = _joined(group, "docs", np.int64), _joined(group, "sizes", np.int32), _joined(group, "hashes", np.uint64), _joined(group, "found", np.int32)
        order = np.lexsort((h, found, docs))
        docs, sizes, h, found = docs[order], sizes[order], h[order], found[order]
        begins = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, int)
        rows = []
        for a, z in zip(begins, np.append(begins[1:], len(docs)), strict=True):
            n = int(sizes[a])
            first = first_ones(n, similar) - (n - int(z - a))  # shingles of this set alone come first
            if first > 0:
                rows.append({"doc": int(docs[a]), "n": n, "first": first, "hashes": _packed(h[a:z]), "found": _packed(found[a:z])})
        return pa.Table.from_pylist(rows, schema=arrow)

    return shared.groupBy("bucket").applyInArrow(run, "doc long, n long, first long, hashes binary, found binary")


def needed(a, b, similar: int = SIMILAR):
    """The least overlap at which sets of sizes a and b reach the threshold."""
    return -(-similar * (a + b) // (100 + similar))


def _apart(n: np.ndarray, label: np.ndarray, parts: list[np.ndarray], similar: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs x < y of sets with different labels that share a shingle of `parts` and whose sizes allow a link; sets come in order of size. At most about PAIRS pairs are
    held at a time. Small groups are paired all at once, and a pair may come again; in large ones each set is paired once with all its later partners."""
    h, owner = np.concatenate([np.zeros(0, np.uint64), *parts]), np.repeat(np.arange(len(parts)), np.array([len(p) for p in parts], np.int64))
    order = np.lexsort((owner, h))
    h, owner = h[order], owner[order]
    begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
    size = np.diff(np.append(begins, len(h)))
    several = np.minimum.reduceat(label[owner], begins) != np.maximum.reduceat(label[owner], begins) if len(h) else size > 0  # else nothing is apart
    live, apart, waiting = np.flatnonzero(np.repeat(several & (size <= LARGE), size)), 1, [np.zeros(0, np.int64)]
    while len(live):  # members of a small group, `apart` places from each other
        live = live[live + apart < len(h)]
        live = live[h[live] == h[live + apart]]
        live = live[100 * n[owner[live]] >= similar * n[owner[live + apart]]]  # a larger partner yet won't fit either
        for k in range(0, len(live), PAIRS):
            x, y = owner[live[k : k + PAIRS]], owner[live[k : k + PAIRS] + apart]
            waiting.append((x * len(n) + y)[label[x] != label[y]])
            if sum(map(len, waiting)) > PAIRS:
                both = np.unique(np.concatenate(waiting))
                yield both // len(n), both % len(n)
                waiting = waiting[:1]
        apart += 1
    both = np.unique(np.concatenate(waiting))
    yield both // max(1, len(n)), both % max(1, len(n))
    many = np.flatnonzero(np.repeat(several & (size > LARGE), size))
    end = np.repeat(begins + size, size)[many]
    order = np.argsort(owner[many], kind="stable")
    many, end, who = many[order], end[order], owner[many[order]]
    met = np.zeros(len(n), bool)
    edges = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.zeros(0, int)
    for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(who)], strict=True) if len(who) else ():
        x = int(who[lo])
        top = int(np.searchsorted(n, 100 * int(n[x]) // similar, "right"))  # larger ones don't fit
        for at, stop in zip(many[lo:hi].tolist(), end[lo:hi].tolist(), strict=True):
            met[owner[at + 1 : stop]] = True
        y = np.flatnonzero(met[x + 1 : top]) + x + 1
        met[x + 1 :] = False
        if len(y := y[label[y] != label[x]]):
            yield np.full(len(y), x), y


def partners(doc: np.ndarray, n: np.ndarray, label: np.ndarray, cells: np.ndarray, parts: list[np.ndarray], most: int | None, similar: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs a < b of documents for `_candidates`, in blocks: those whose histograms `cells` allow the overlap needed, of each b the `most` likeliest (all if None).

    Pairs are scored as they come and of these only the best are kept, so memory grows with the sets, not with their pairs."""
    order = np.lexsort((doc, n))
    doc, n, label, cells, parts = doc[order], n[order], label[order], cells[order], [parts[k] for k in order.tolist()]
    least = np.ones(len(doc), np.float32)  # what a pair must reach to be among the best of its later document
    best = np.zeros((2, 0), np.int64), np.zeros(0, np.float32)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        pair, score = (np.concatenate(w, axis=-1) for w in zip(best, *waiting, strict=True))
        waiting.clear()
        at = np.lexsort((doc[pair[0]], -score, pair[1]))
        at = at[np.concatenate([[True], (pair[:, at][:, 1:] != pair[:, at][:, :-1]).any(0)])] if len(at) else at
        pair, score = pair[:, at], score[at]
        if most is not None and len(at):
            begins = np.flatnonzero(np.concatenate([[True], pair[1, 1:] != pair[1, :-1]]))
            rank = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
            least[pair[1, rank == most - 1]] = score[rank == most - 1]
            pair, score = pair[:, rank < most], score[rank < most]
        return pair, score

    for x, y in _apart(n, label, parts, similar):
        for k in range(0, len(x), 4096):
            i, j = x[k : k + 4096], y[k : k + 4096]
            one = cells[i[:1]] if i[0] == i[-1] and (i == i[0]).all() else cells[i]
            score = (np.minimum(one, cells[j]).sum(1, dtype=np.int64) / needed(n[i], n[j], similar)).astype(np.float32)
            pair = np.where(doc[i] < doc[j], [i, j], [j, i])
            keep = score >= least[pair[1]]
            if keep.any():
                waiting.append((pair[:, keep], score[keep]))
                held += int(keep.sum())
        if held > PAIRS:
            best, held = merged(), 0
            if most is None:
                yield doc[best[0][0]], doc[best[0][1]]
                best = best[0][:, :0], best[1][:0]
    best = merged()
    yield doc[best[0][0]], doc[best[0][1]]


def _candidates(sets: DataFrame, fragments: int, most: int | None, similar: int) -> DataFrame:
    """(a, b) of sets with different labels that share a first shingle, whose sizes and histograms allow the overlap needed; for each b the `most` likeliest."""
    arrow = pa.schema([("part", pa.int64()), ("doc", pa.int64()), ("n", pa.int64()), ("label", pa.int64()), ("cells", pa.binary()), ("hashes", pa.binary())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                h, found = np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["found"], np.int32)
                cells = np.bincount((h % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
                one = {"doc": r["doc"], "n": r["n"], "label": r["label"], "cells": _packed(cells.astype(np.uint8 if cells.max() < 256 else np.uint32))}
                h, found = h[: r["first"]], found[: r["first"]]
                cool = found <= GROUP
                part = (h >> np.uint64(33)) % np.uint64(fragments)
                for p in np.unique(part[cool]):
                    rows.append({**one, "part": int(p), "hashes": _packed(h[cool & (part == p)])})
                for x, m in zip(h[~cool].tolist(), found[~cool].tolist(), strict=True):  # a hot shingle: pairs of blocks of its sets
                    blocks = -(-m // GROUP)
                    own = xxhash.xxh3_64_intdigest(str(r["doc"])) % blocks
                    for other in range(blocks):
                        where = xxhash.xxh3_64_intdigest(f"{x}:{min(own, other)}:{max(own, other)}") >> 2
                        rows.append({**one, "part": fragments + where, "hashes": _packed(np.array([x], np.uint64))})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        doc, n, label = (group.column(c).to_numpy() for c in ("doc", "n", "label"))
        parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("hashes")]
        cells = [x.as_buffer() for x in group.column("cells")]
        cells = np.stack([np.frombuffer(c, np.uint8 if len(c) == CELLS else np.uint32) for c in cells])  # wide ones if a set here has them
        del group
        for a, b in partners(doc, n, label, cells, parts, most, similar):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = sets.select("doc", "n", "label", "first", "hashes", "found").mapInArrow(freeing(emit), "part long, doc long, n long, label long, cells binary, hashes binary")
    return rows.groupBy("part").applyInArrow(pairs, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs that reach the threshold. Sets that candidate pairs connect meet in one task, or, where these have too many shingles, in one for each fragment; partial overlaps are summed."""
    groups = written(components(pairs), "groups")
    sized = sets.select("doc", "n", (F.octet_length("hashes") / 8).cast("long").alias("size")).join(groups.withColumnRenamed("node", "doc"), "doc")
    cuts = sized.groupBy("component").agg(F.ceil(F.sum("size") / FRAGMENT).cast("int").alias("cuts"))
    place = written(sized.select("doc", "component").join(cuts, "component"), "place")
    where = F.when(F.col("cuts") == 1, F.pmod(F.xxhash64("component"), F.lit(997))).otherwise(F.lit(997) + F.abs(F.xxhash64("component") % (1 << 40)))
    mine = sets.select("doc", "n", "hashes").join(place, "doc").select("doc", "n", "hashes", "cuts", where.alias("place"))
    arrow = pa.schema([("place", pa.int64()), ("cut", pa.int32()), ("doc", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                h = np.frombuffer(r["hashes"], np.uint64)
                for k in range(r["cuts"]):
                    rows.append({"place": r["place"], "cut": k, "doc": r["doc"], "n": r["n"], "hashes": _packed(np.sort(h if r["cuts"] == 1 else h[h % np.uint64(r["cuts"]) == k]))})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def overlaps(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = {d: (n, np.frombuffer(h.as_buffer(), np.uint64)) for d, n, h in zip(left.column("doc").to_pylist(), left.column("n").to_pylist(), left.column("hashes"), strict=True)}
        rows = []
        for a, b in zip(right.column("a").to_pylist(), right.column("b").to_pylist(), strict=True):
            (n, x), (m, y) = sets[a], sets[b]
            both = np.concatenate([x, y])
            both.sort()
            rows.append((a, b, int((both[1:] == both[:-1]).sum()), n + m))
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("a", "b", "overlap", "sizes"), cols, strict=True)})

    segments = mine.mapInArrow(freeing(cut), "place long, cut int, doc long, n long, hashes binary")
    put = pairs.join(place.select(F.col("doc").alias("a"), "cuts", where.alias("place")), "a")
    put = put.select("place", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), "a", "b")
    parts = segments.groupBy("place", "cut").cogroup(put.groupBy("place", "cut")).applyInArrow(overlaps, "a long, b long, overlap long, sizes long")
    total = parts.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), F.max("sizes").alias("sizes"))
    out = written(total.where(F.col("overlap") * 100 >= similar * (F.col("sizes") - F.col("overlap"))).select("a", "b"), "links")
    forget(groups, place)
    return out


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, similar: int = SIMILAR) -> DataFrame:
    """(key, n_shingles, component_id) for each row of `docs`: the size of its shingle set and the smallest key reachable by links.

    Words are runs of other characters than space and 09-0D, with A-Z lower-cased; the set holds the distinct runs of `n` words, or all words as one run
    where there are fewer. Two texts link when 100 * intersection >= similar * union. Null texts, and those without words, have no shingles and link
    with nothing; rows with a null key link with nothing and have no component; rows that share a key are one document. Shingles are compared by 64-bit
    hashes. Other columns are dropped.
    """
    spark = docs.sparkSession
    signed = written(signatures(docs, key, text, n), "signatures")
    real = signed.where(F.col("doc").isNotNull() & (F.col("n") > 0))
    classes = real.groupBy("h1", "h2").agg(F.min("doc").alias("top"), F.count("*").alias("copies"))
    copies = written(real.join(classes.where("copies > 1"), ["h1", "h2"]).where("doc > top").select("doc", "top").distinct(), "copies")
    # texts of representatives; documents that are only copies go
    total = real.agg(F.sum("n"), F.count("*")).first()
    links = copies.select(F.col("top").alias("a"), F.col("doc").alias("b"))
    made: list[DataFrame] = []
    if total[0]:
        fragments = int(-(-total[0] // FRAGMENT))
        texts = docs.select(docs[key].cast("long").alias("doc"), utf8(text).alias("raw")).where(F.col("doc").isNotNull()).join(copies.select("doc"), "doc", "left_anti").where(F.length("raw") > 0)
        sets = written(_survivors(_shared(_segments(texts, n, fragments), max(8, fragments)), similar), "sets")
        size = sets.agg(F.sum("first")).first()[0] or 0
        labels = None
        for most in ROUNDS:
            labelled = sets.withColumn("label", F.col("doc")) if labels is None else sets.join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
            pairs = written(_candidates(labelled, int(size // (1 << 20) + 1), most, similar), "pairs")
            if pairs.isEmpty():
                forget(pairs)
                break
            found = _verified(pairs, sets, similar)
            forget(pairs)
            made.append(found)
            links = links.unionByName(found)
            if labels is not None:
                forget(labels)
            labels = written(components(_union(made)).select(F.col("node").alias("doc"), F.col("component").alias("label")), "labels")
        forget(sets)
        if labels is not None:
            forget(labels)
    reached = components(links)
    out = signed.join(reached.withColumnRenamed("node", "doc"), "doc", "left")
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
