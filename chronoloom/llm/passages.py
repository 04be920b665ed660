"""Substring dedup by MinHash banding of paragraphs.

Repeated passages seldom fill a line, so paragraphs are cut by content, in two ways. Short ones begin at each word whose hash, with the next word's, is
the least within REACH words: a passage is thus cut alike wherever it stands, and short paragraphs of the same words in several documents are repeats.
Long ones are the WINDOW words from each word that is the least within SPREAD words (and a text's first and last WINDOW words), so that a passage with
changed words still holds some that differ little. Long paragraphs are joined if they collide in a band of MinHashes of their five-word runs and exact
Jaccard similarity holds; clusters are components, of which the first document keeps its paragraphs and the others' are removals. Repeated paragraphs
that touch or overlap make a passage, and passages of MIN_WORDS words or more count.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import wraps
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, forest, forget, freeing, give_back, parts_of, utf8, written
from .shingles import BASE, SPACE, _powers, mixed, word_hashes

REACH, MIN_WORDS, SIMILAR, N = 4, 25, 75, 5
#: Long paragraphs. Two of a text begin more than SPREAD words apart, too far to be similar to each other.
WINDOW, SPREAD = 40, 7
#: Texts of at least so many words, but fewer than WINDOW, are one long paragraph.
SHORT = 20
#: Paragraphs that a fragment's task holds, members in one block of a bucket, and members from which on a bucket is compared by itself.
FRAGMENT, GROUP, ALONE = 1 << 19, 1 << 15, 2048
#: Pairs that wait to be compared, pairs of a long list that are drawn at once, and elements that are counted at once.
WAITING, DRAWN, COUNTED = 1 << 17, 1 << 17, 1 << 19
LAST = np.uint64((1 << 64) - 1)
#: Bloom filters of more bits than this aren't broadcast; then all paragraphs go to the join.
BLOOM_BITS = 1 << 29
#: Texts that are worked on at once, by number and by bytes.
TEXTS, BYTES = 2048, 4 << 20


def bands(similar: int = SIMILAR, recall: float = 0.99, rows: int = 1) -> int:
    """How many bands of `rows` MinHashes find a pair of the threshold's similarity with probability `recall`; equal paragraphs are always found."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (similar / 100) ** rows))


class Laid(NamedTuple):
    """The words of several texts under each other, with PAD places between: word hashes, whether a place holds a word, each text's first place and end."""

    words: np.ndarray
    real: np.ndarray
    first: np.ndarray
    end: np.ndarray


class Found(NamedTuple):
    """Paragraphs: the number of the text, first place, number of words, hash of the word sequence."""

    text: np.ndarray
    place: np.ndarray
    length: np.ndarray
    own: np.ndarray


PAD = max(REACH, SPREAD) + 1


def laid(texts: list[np.ndarray]) -> Laid:
    size = np.array([len(w) for w in texts], np.int64)
    first = np.cumsum(size + PAD) - size
    flat, real = np.zeros(int((size + PAD).sum()) + PAD, np.uint64), np.zeros(int((size + PAD).sum()) + PAD, bool)
    for w, a in zip(texts, first.tolist(), strict=True):
        flat[a : a + len(w)] = w
        real[a : a + len(w)] = True
    return Laid(flat, real, first, first + size)


def least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of the `width` elements from each one on."""
    w = 1
    while 2 * w <= width:
        x = np.minimum(x[:-w], x[w:])
        w *= 2
    return np.minimum(x[: len(x) - (width - w)], x[width - w :]) if w < width else x


def anchors(t: Laid, reach: int) -> np.ndarray:
    """Places of words whose hash, with the next word's, is the least within `reach` words."""
    two = mixed(t.words[:-1] * np.uint64(BASE) + t.words[1:])
    two[~(t.real[:-1] & t.real[1:])] = LAST
    near = least(np.pad(two, reach, constant_values=LAST), 2 * reach + 1)
    return np.flatnonzero((two == near) & (two != LAST))


def _found(t: Laid, text: np.ndarray, place: np.ndarray, end: np.ndarray) -> Found:
    up, down = _powers(1 << max(20, len(t.words).bit_length()))
    sums = np.zeros(len(t.words) + 1, np.uint64)
    np.cumsum(t.words * up[: len(t.words)], out=sums[1:])
    return Found(text, place, end - place, mixed((sums[end] - sums[place]) * down[place] + (end - place).astype(np.uint64)))


def paragraphs(t: Laid) -> Found:
    """Short paragraphs: all words of each text, cut at its anchors."""
    place = np.union1d(anchors(t, REACH), t.first[t.end > t.first])
    text = np.searchsorted(t.first, place, "right") - 1
    after = np.append(place[1:], len(t.words))
    return _found(t, text, place, np.minimum(after, t.end[text]))


def long_paragraphs(t: Laid) -> Found:
    """The WINDOW words from each anchor that has them, from each text's start, and up to its end; all of a text that has fewer, if it has SHORT."""
    at = anchors(t, SPREAD)
    long = t.end - t.first >= WINDOW
    place = np.unique(np.concatenate([at[at + WINDOW <= t.end[np.searchsorted(t.first, at, "right") - 1]], t.first[long], t.end[long] - WINDOW, t.first[~long & (t.end - t.first >= SHORT)]]))
    text = np.searchsorted(t.first, place, "right") - 1
    return _found(t, text, place, np.minimum(place + WINDOW, t.end[text]))


def runs_of(t: Laid, n: int = N) -> np.ndarray:
    """Hashes of the runs of n words from each place; meaningless where these aren't words of one text."""
    m = max(0, len(t.words) - n + 1)
    h = np.full(m, n, np.uint64)
    for i in range(n):
        h = mixed(h * np.uint64(BASE) + t.words[i : i + m])
    return h


def minhashes(runs: np.ndarray, found: Found, count: int, n: int = N) -> np.ndarray:
    """`count` MinHashes of each long paragraph's runs of n words."""
    inside = found.length - n + 1
    width = 1 << (int(inside.min()).bit_length() - 1) if len(inside) else 1
    out = []
    for k in range(count):
        low = least(mixed(runs + np.uint64(k * 0x632BE59BD9B4E019 & (1 << 64) - 1)), width)
        m = np.minimum(low[found.place], low[found.place + inside - width])
        at = width
        while (rest := np.flatnonzero(inside > 2 * at)).size:  # long paragraphs beside shorter ones
            m[rest] = np.minimum(m[rest], low[found.place[rest] + at])
            at += width
        out.append(m)
    return np.stack(out, 1)


def _packed(x) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def freed(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """`run` for applyInArrow, giving the memory of each group back: an executor's tasks would keep that of their largest ones."""

    @wraps(run)
    def group(rows: pa.Table) -> pa.Table:
        try:
            return run(rows)
        finally:
            give_back()

    return group


def _joined(group: pa.Table, column: str, kind) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), kind) for x in group.column(column)]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Laid]]:
    """(documents, their words), TEXTS texts or about BYTES bytes at a time."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, "right"))
            upto = min(max(upto, at + 1), at + TEXTS, batch.num_rows)
            part = batch.slice(at, upto - at)
            yield part.column(0).to_numpy(), laid(word_hashes([r.as_buffer().to_pybytes() for r in part.column(1)]))
            at = upto


def _dealt(rows: dict[str, np.ndarray], part: np.ndarray, base: int = 0) -> list[dict]:
    return [{"fragment": base + f, **{k: _packed(v[x]) for k, v in rows.items()}} for f, x in parts_of(part)]


def _repeated(texts: DataFrame, fragments: int) -> DataFrame:
    """(doc, begin, length, own, removed): short paragraphs whose words stand in another document as well.

    Of equal paragraphs in one batch only the first goes to its fragment; the others are known to be removals, so a hot paragraph sends each fragment a
    row a batch at most.
    """
    columns = ("docs", "begins", "lengths", "owns", "more")
    arrow = pa.schema([("fragment", pa.int32()), *((c, pa.binary()) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, t in _texts(batches):
            found = paragraphs(t)
            docs, begin, length, own = names[found.text], (found.place - t.first[found.text]).astype(np.int32), found.length.astype(np.int32), found.own
            order = np.lexsort((begin, docs, own))
            docs, begin, length, own = docs[order], begin[order], length[order], own[order]
            first = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, bool)
            at = np.flatnonzero(first)
            size = np.diff(np.append(at, len(own)))
            several = docs[at] != docs[at + size - 1] if len(own) else first
            more = np.repeat(several, size).astype(np.int8)
            first |= more == 0  # what one document alone holds goes to its fragment whole
            rows = {"docs": docs, "begins": begin, "lengths": length, "owns": own, "more": more}
            part = ((own >> np.uint64(20)) % np.uint64(fragments)).astype(np.int64)
            out = _dealt({k: v[first] for k, v in rows.items()}, part[first])
            spread = (docs.view(np.uint64) % np.uint64(fragments)).astype(np.int64)
            out += _dealt({k: v[~first] for k, v in rows.items()}, spread[~first], fragments)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    def pick(group: pa.Table) -> pa.Table:
        own = _joined(group, "owns", np.uint64)
        removed = np.ones(len(own), bool)
        if group.column("fragment")[0].as_py() < fragments:
            docs, begin, more = _joined(group, "docs", np.int64), _joined(group, "begins", np.int32), _joined(group, "more", np.int8)
            order = np.lexsort((begin, docs, own))
            own, docs = own[order], docs[order]
            first = np.concatenate([[True], own[1:] != own[:-1]])
            at = np.flatnonzero(first)
            size = np.diff(np.append(at, len(own)))
            keep = np.repeat((docs[at] != docs[at + size - 1]) | (np.maximum.reduceat(more[order], at) > 0), size)
            removed, own, docs, begin = ~first[keep], own[keep], docs[keep], begin[order[keep]]
            length = _joined(group, "lengths", np.int32)[order[keep]]
        else:
            docs, begin, length = _joined(group, "docs", np.int64), _joined(group, "begins", np.int32), _joined(group, "lengths", np.int32)
        return pa.table({"doc": docs, "begin": begin, "length": length, "own": own.view(np.int64), "removed": removed})

    dealt = texts.mapInArrow(freeing(run), "fragment int, " + ", ".join(f"{c} binary" for c in columns))
    return dealt.groupBy("fragment").applyInArrow(freed(pick), "doc long, begin int, length int, own long, removed boolean")


def _collisions(texts: DataFrame, fragments: int, count: int) -> DataFrame:
    """(part, bucket, own): hashes of different long paragraphs that share a MinHash. Their bucket is named by its members, so that equal ones of several bands are one.

    Small buckets share a part. A large one is a part of its own, and a hot one comes as pairs of its blocks, each of them a part, so that any two members
    meet and no group holds more than two blocks.

    Paragraphs of one text overlap and so share buckets too. With each goes the sum of its documents' hashes; a bucket whose members all stand in the
    same documents, as in one text or in exact copies, has nothing to link and goes.
    """
    columns = ("marks", "owns", "documents")
    arrow = pa.schema([("fragment", pa.int32()), *((c, pa.binary()) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, t in _texts(batches):
            found = long_paragraphs(t)
            if not len(found.own):
                continue
            order = np.lexsort((found.text, found.own))
            own, doc = found.own[order], names.view(np.uint64)[found.text[order]]
            new = np.concatenate([[True], own[1:] != own[:-1]])
            once = new | np.concatenate([[True], doc[1:] != doc[:-1]])  # a document counts once
            documents = np.add.reduceat(np.where(once, mixed(doc), np.uint64(0)), np.flatnonzero(new))
            marks = minhashes(runs_of(t), Found(*(x[order[new]] for x in found)), count) ^ np.arange(count, dtype=np.uint64) << np.uint64(60)
            rows = {"marks": marks.ravel(), "owns": np.repeat(own[new], count), "documents": np.repeat(documents, count)}
            yield pa.RecordBatch.from_pylist(_dealt(rows, ((rows["marks"] >> np.uint64(20)) % np.uint64(fragments)).astype(np.int64)), schema=arrow)

    def pick(group: pa.Table) -> pa.Table:
        marks, own = _joined(group, "marks", np.uint64), _joined(group, "owns", np.uint64)
        order = np.lexsort((own, marks))
        marks, own = marks[order], own[order]
        at = np.flatnonzero(np.concatenate([[True], (marks[1:] != marks[:-1]) | (own[1:] != own[:-1])]))
        documents = np.add.reduceat(_joined(group, "documents", np.uint64)[order], at)
        marks, own = marks[at], own[at]
        at = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]]))
        size = np.diff(np.append(at, len(marks)))
        bucket = np.repeat(mixed(np.add.reduceat(mixed(own), at) + size.astype(np.uint64)), size)
        size = np.repeat(np.where(np.minimum.reduceat(documents, at) != np.maximum.reduceat(documents, at), size, 0), size)
        live = size > 1
        return pa.table({"bucket": bucket[live].view(np.int64), "own": own[live].view(np.int64), "size": size[live]})

    dealt = texts.mapInArrow(freeing(run), "fragment int, " + ", ".join(f"{c} binary" for c in columns))
    rows = dealt.groupBy("fragment").applyInArrow(freed(pick), "bucket long, own long, size long").distinct()
    blocks = F.ceil(F.col("size") / GROUP)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("own"), blocks)).withColumn("other", F.explode(F.when(F.col("size") > GROUP, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(F.lit(0).cast("long")))))
    bucket = F.when(F.col("size") > GROUP, F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other"))).otherwise(F.col("bucket"))
    return rows.select(F.when(F.col("size") > ALONE, bucket).otherwise(F.shiftrightunsigned("bucket", 8) % (8 * fragments)).alias("part"), bucket.alias("bucket"), "own")


#: Runs are compared by 48 bits of their hashes, which are kept in six bytes.
SHORTER = np.uint64((1 << 48) - 1)


def _short(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view(np.uint64).ravel()


#: Bits in one row of a filter.
ROW = 1 << 15


def _filter(names: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter with two bits for each name, packed; made on the executors, and brought in as rows of ROW bits."""
    bit = F.explode(F.array(F.col("own").bitwiseAND(bits - 1), F.shiftrightunsigned("own", 24).bitwiseAND(bits - 1)))
    rows = names.select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).alias("row")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(ROW - 1)).alias("cells"))
    out = np.zeros(bits // 8, np.uint8)
    for row in rows.toLocalIterator():  # at most BLOOM_BITS / ROW of them
        out[row.row * ROW // 8 : (row.row + 1) * ROW // 8] = np.frombuffer(row.cells, np.uint8)
    return out


def _held(cells: np.ndarray, own: np.ndarray) -> np.ndarray:
    bits = np.uint64(8 * len(cells) - 1)
    at = (own & bits, own >> np.uint64(24) & bits)
    one, two = (cells[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8) & 1 for x in at)
    return (one & two).astype(bool)


def _named(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(own, doc, begin, length, runs): the long paragraphs that are in `members`, and some others. Of equal ones in a batch the first has the distinct hashes of its runs."""
    names = members.select("own").distinct()
    bits = max(1 << 16, 1 << (16 * names.count() - 1).bit_length())
    shared = texts.sparkSession.sparkContext.broadcast(_filter(names, bits)) if bits <= BLOOM_BITS else None
    arrow = pa.schema([("own", pa.int64()), ("doc", pa.int64()), ("begin", pa.int32()), ("length", pa.int32()), ("runs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, t in _texts(batches):
            found = long_paragraphs(t)
            keep = _held(shared.value, found.own) if shared else np.ones(len(found.own), bool)
            if not keep.any():
                continue
            found = Found(*(x[keep] for x in found))
            h = runs_of(t) & SHORTER
            first = np.zeros(len(found.own), bool)
            first[np.unique(found.own, return_index=True)[1]] = True
            sets = [_short(np.unique(h[a:z])) if f else None for a, z, f in zip(found.place.tolist(), (found.place + found.length - N + 1).tolist(), first.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found.own.view(np.int64)), pa.array(docs[found.text]), pa.array((found.place - t.first[found.text]).astype(np.int32)), pa.array(found.length.astype(np.int32)), pa.array(sets, pa.binary())], schema=arrow)

    return texts.mapInArrow(freeing(run), "own long, doc long, begin int, length int, runs binary")


def needed(n, m, similar: int):
    """The least overlap at which sets of sizes n and m reach the threshold."""
    return -(-similar * (n + m) // (100 + similar))


def _crossed(x: np.ndarray, y: np.ndarray, same: bool, most: int = DRAWN) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of members of x and y, or of x and x, about `most` at a time."""
    step = max(1, most // max(1, len(y)))
    for k in range(0, len(x), step):
        a, b = np.repeat(np.arange(k, min(len(x), k + step)), len(y)), np.tile(np.arange(len(y)), min(len(x), k + step) - k)
        if same:
            a, b = a[a < b], b[a < b]
        yield x[a], y[b]


def _overlap(x: np.ndarray, y: np.ndarray, at: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """How many elements the sets x[k] and y[k] share; sets are sorted slices of `flat`."""
    out = np.zeros(len(x), np.int64)
    total = size[x] + size[y]
    begin = 0
    ends = np.cumsum(total)
    while begin < len(x):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + COUNTED, "right")))
        which = np.concatenate([x[begin:end], y[begin:end]])
        n = size[which]
        pair = np.repeat(np.tile(np.arange(end - begin), 2), n)
        value = flat[np.repeat(at[which] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        order = np.lexsort((value, pair))
        pair, value = pair[order], value[order]
        both = (pair[1:] == pair[:-1]) & (value[1:] == value[:-1])
        out[begin:end] = np.bincount(pair[1:][both], minlength=end - begin)
        begin = end
    return out


def links_within(bucket: np.ndarray, own: np.ndarray, size: np.ndarray, every: np.ndarray, similar: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of paragraphs of one bucket that connect all pairs there that reach the threshold. Sets have `size` elements each, one after the other in `every`.

    Elements of a bucket's sets are ordered, rare ones first. Two sets that reach the threshold share one of the first ones of both, at places that leave
    room for the overlap needed; members that share it are compared by size and place, so a bucket isn't expanded where no link is possible.
    """
    owner = np.repeat(np.arange(len(own), dtype=np.int32), size)
    whole = np.add.reduceat(mixed(every), np.cumsum(size) - size)
    order = np.lexsort((own, whole, size, bucket))
    same = (bucket[order][1:] == bucket[order][:-1]) & (size[order][1:] == size[order][:-1]) & (whole[order][1:] == whole[order][:-1])
    differ = own[order][1:] != own[order][:-1]
    a, b = [own[order[:-1][same & differ]]], [own[order[1:][same & differ]]]  # equal sets, in a chain; the first stands for them
    keep = np.ones(len(own), bool)
    keep[order[1:][same]] = False
    mine = keep[owner]
    every, owner = every[mine], owner[mine]
    held = np.where(keep, size, 0)
    at = np.cumsum(held) - held
    key = mixed(every ^ mixed(bucket)[owner])  # an element within its bucket
    order = np.argsort(key, kind="stable")
    value = key[order]
    first = np.concatenate([[True], value[1:] != value[:-1]]) if len(key) else np.zeros(0, bool)
    count = np.diff(np.append(np.flatnonzero(first), len(key))).astype(np.int32)
    found = np.empty(len(key), np.int32)
    found[order] = np.repeat(count, count)
    del order, value, first, count, mine
    order = np.lexsort((key, found, owner))
    key, found, owner = key[order], found[order], owner[order]
    del order
    place = (np.arange(len(key)) - at[owner]).astype(np.int32)
    n = size[owner].astype(np.int32)
    head = (place < n - -(-similar * n // 100) + 1) & (found > 1)
    key, owner, place, n = key[head], owner[head].astype(np.int64), place[head].astype(np.int64), n[head].astype(np.int64)
    del head, found
    order = np.lexsort((place, n, key))
    key, owner, place, n = key[order], owner[order], place[order], n[order]
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    ends = np.append(begins[1:], len(key))
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    label = np.arange(len(own))

    def flush() -> None:
        if waiting:
            x, y = (np.concatenate(w) for w in zip(*waiting, strict=True))
            waiting.clear()
            apart = label[x] != label[y]
            pair = np.unique(np.minimum(x, y)[apart] * len(own) + np.maximum(x, y)[apart])
            x, y = pair // len(own), pair % len(own)
            both = _overlap(x, y, at, size, every)
            good = 100 * both >= similar * (size[x] + size[y] - both)
            x, y = x[good], y[good]
            needed_ones = forest(x, y, label)
            a.append(own[x[needed_ones]])
            b.append(own[y[needed_ones]])

    def compare(x: np.ndarray, y: np.ndarray) -> None:
        apart = label[x] != label[y]
        if apart.any():
            waiting.append((x[apart], y[apart]))
            if sum(len(w[0]) for w in waiting) > WAITING:
                flush()

    many = np.repeat(ends - begins > 64, ends - begins)
    live, apart = np.flatnonzero(~many), 1
    while True:  # short lists: pairs `apart` places from each other in order of size
        live = live[live + apart < len(key)]
        live = live[key[live] == key[live + apart]]
        live = live[100 * n[live] >= similar * n[live + apart]]  # a larger partner yet won't fit either
        if not len(live):
            break
        x, y = live, live + apart
        room = np.minimum(n[x] - place[x], n[y] - place[y]) >= needed(n[x], n[y], similar)
        compare(owner[x[room]], owner[y[room]])
        apart += 1
    for lo, hi in zip(begins[ends - begins > 64].tolist(), ends[ends - begins > 64].tolist(), strict=True):  # long lists: by size and place
        k, p, o = n[lo:hi], place[lo:hi], owner[lo:hi]
        edge = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (p[1:] != p[:-1])]))
        groups = [(int(k[i]), int(p[i]), o[i:j]) for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(o)], strict=True)]
        for i, (small, here, xs) in enumerate(groups):
            for large, there, ys in groups[i:]:
                if 100 * small < similar * large:
                    break
                if min(small - here, large - there) >= needed(small, large, similar):
                    for x, y in _crossed(xs, ys, xs is ys):
                        compare(x, y)
    flush()
    return np.concatenate(a), np.concatenate(b)


def _close(members: DataFrame, named: DataFrame, similar: int) -> DataFrame:
    """(a, b): paragraphs of a bucket whose exact Jaccard similarity reaches the threshold."""
    sets = named.where("runs is not null").groupBy("own").agg(F.first("runs").alias("runs"))  # equal for equal hashes

    def check(group: pa.Table) -> pa.Table:
        bucket, own = (group.column(c).to_numpy().view(np.uint64) for c in ("bucket", "own"))
        size = pc.binary_length(group.column("runs")).to_numpy() // 6
        a, b = links_within(bucket, own, size.astype(np.int64), _long(_joined(group, "runs", np.uint8)), similar)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return members.join(sets, "own").select("part", "bucket", "own", "runs").groupBy("part").applyInArrow(freed(check), "a long, b long").distinct()


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: int = SIMILAR, min_words: int = MIN_WORDS, recall: float = 0.99) -> DataFrame:
    """(key, n_repeated, n_removed, passages array<struct<begin, end, removed, components, cuts>>): the documents that hold repeated passages.

    Words are counted as runs of other characters than space and 09-0D, letters compared without case of A-Z; begin and end (exclusive) count words from 0.
    A passage is made of repeated paragraphs that touch or overlap and has `min_words` words or more; `removed` counts its words in removals, which are
    its `cuts`. Only what stands in several documents is a repeat. Texts without one, null and empty ones and rows with a null key aren't in the result;
    rows that share a key are one document.
    """
    texts = docs.where(docs[key].isNotNull()).select(docs[key].cast("long").alias("doc"), utf8(text).alias("raw")).where(F.length("raw") > 0)
    size = texts.agg(F.sum(F.length("raw").cast("long"))).first()[0] or 0
    count = bands(similar, recall)
    found = written(_repeated(texts, int(size // 50 // FRAGMENT + 1)), "repeated")
    members = written(_collisions(texts, int(count * size // 70 // FRAGMENT + 1), count), "collisions")
    every, extra = found.withColumn("component", F.col("own")).drop("own"), []
    if not members.isEmpty():
        named = written(_named(texts, members), "named")
        links = written(_close(members, named, similar), "close")
        groups = written(components(links), "clusters")
        # long paragraphs of clusters that stand in several documents: the first of these keeps its own
        some = named.join(groups.withColumnRenamed("node", "own"), "own").select("doc", "begin", "length", "component")
        first = some.groupBy("component").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
        some = some.join(first, "component").select("doc", "begin", "length", (F.col("doc") != F.col("first")).alias("removed"), "component")
        every, extra = every.unionByName(some), [links]
    forget(members, *extra)
    return _passages(every, key, min_words)


def _passages(every: DataFrame, key: str, min_words: int) -> DataFrame:
    """Repeated paragraphs, put together: runs of what touches or overlaps, and in these the runs of removals."""
    at = Window.partitionBy("doc").orderBy("begin", "end")
    before, upto = at.rowsBetween(Window.unboundedPreceding, -1), at.rowsBetween(Window.unboundedPreceding, 0)
    gone = F.when(F.col("removed"), F.col("end"))
    rows = every.withColumn("end", F.col("begin") + F.col("length"))
    rows = rows.withColumns({"new": F.coalesce(F.col("begin") > F.max("end").over(before), F.lit(True)), "apart": F.coalesce(F.col("begin") > F.max(gone).over(before), F.lit(True)) & F.col("removed")})
    rows = rows.withColumns({"run": F.sum(F.col("new").cast("int")).over(upto), "cut": F.sum(F.col("apart").cast("int")).over(upto)})
    cuts = rows.groupBy("doc", "run", "cut").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.min(F.when(F.col("removed"), F.col("begin"))).alias("a"), F.max(gone).alias("z"), F.collect_set("component").alias("components"))
    whole = cuts.groupBy("doc", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.coalesce(F.sum(F.col("z") - F.col("a")), F.lit(0)).alias("removed"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("components")))).alias("components"), F.sort_array(F.collect_list(F.when(F.col("a").isNotNull(), F.struct(F.col("a").alias("begin"), F.col("z").alias("end"))))).alias("cuts"))
    whole = whole.where(F.col("end") - F.col("begin") >= min_words)
    return whole.groupBy(F.col("doc").alias(key)).agg(F.sum(F.col("end") - F.col("begin")).cast("long").alias("n_repeated"), F.sum("removed").cast("long").alias("n_removed"), F.sort_array(F.collect_list(F.struct("begin", "end", F.col("removed").cast("int").alias("removed"), "components", "cuts"))).alias("passages"))


def without_passages(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kept): texts without the removals of `found`; the first of each cluster stays everywhere, and null stays null."""
    spans = found.select(F.col(key).alias("__doc"), F.flatten("passages.cuts").alias("__spans"))
    rows = docs.select(docs[key].cast("long").alias(key), docs[text].alias("text")).join(spans, F.col(key) == F.col("__doc"), "left").select(key, "text", "__spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for value, gone in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                value = value.as_py()
                if value is not None and gone:
                    raw = value.encode()
                    space = np.concatenate([[True], SPACE[np.frombuffer(raw, np.uint8)], [True]])
                    edges = np.flatnonzero(space[1:] != space[:-1])
                    out, at = [], 0
                    for g in gone:
                        out.append(raw[at : edges[2 * g["begin"]]])
                        at = edges[2 * g["end"] - 1]
                    value = b"".join([*out, raw[at:]]).decode()
                kept.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], [key, "kept"])

    return rows.mapInArrow(freeing(run), f"{key} long, kept string")
