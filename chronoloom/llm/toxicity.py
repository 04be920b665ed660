"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks, trained on labelled sentences.

The kernel of two words sums, over all triples of letters that both have in this order, a weight that decays with the letters the triple spans, so
words with inserted letters stay close to their originals (Lodhi et al. 2002). A sentence's kernel with a landmark is that of its closest word; in the
landmarks' feature space a linear machine with squared hinge loss is fitted to sentences. Labels mark texts: sentences of clean ones are negative, and of
a toxic one those that the machine itself takes for the worst (multiple-instance learning; Andrews et al. 2002). A text's margin is that of its worst
sentence; a logistic curve turns it into a score. Words written with dots, blanks or other signs between their letters are also read without them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, freeing, written

#: Weight lost for each letter that a triple spans, and the most letters that one may span.
DECAY, SPAN = 0.6, 7
#: Longer words are cut into windows of LONG letters, STEP apart, which hold every word of up to LONG - STEP letters whole.
LONG, STEP = 24, 12
#: Labelled rows to fit on (a bound; fewer if there are fewer) and the sentences of each that are looked at in a round; words among which landmarks are
#: chosen; landmarks; words kept by a worker.
SAMPLE_ROWS, SENTENCES, CANDIDATES, LANDMARKS, KEPT = 4000, 6, 3000, 96, 120_000
ROUNDS = 3
#: Words whose kernels are gathered at once, fewer than a generation of words kept, and bytes of texts that are cut into words at once.
PART, BYTES = 40_000, 1 << 20
#: Sentences of more words come as windows of so many, half as far apart.
WORDS = 24
#: A toxic text whose worst sentence has a lower margin than this shows nothing that others show; it isn't learned from.
UNSEEN = -0.7
#: Triples of an alphabet that are tabled whole.
DENSE = 1 << 20
#: Words less like any clean one than this are also learned with a letter inserted.
APART = 0.4

WORD = re.compile(r"[^\W_]+")
SIGNS = ".,;:!?\"'()[]{}*#$%&_-"
#: Single letters with blanks between.
SPACED = re.compile(r"(?<!\S)[^\W_](?:\s[^\W_])+(?!\S)")


#: Where sentences end.
END = re.compile(r"(?<=[.!?;])\s+|\n+")


def _tokens(sentence: str) -> list[str]:
    """The words of three letters or more of a sentence in lower case: of a token with signs in it its parts and these joined, long words as windows."""
    out: list[str] = []
    for token in sentence.split():
        if token.isalnum() or (token := token.strip(SIGNS)).isalnum():
            out.append(token)
        elif parts := WORD.findall(token):
            out += parts
            if len(parts) > 1:
                out.append("".join(parts))
    out = [w for w in out if len(w) > 2]  # shorter ones have no triple
    if out and max(map(len, out)) > LONG:
        out = [x for w in out for x in ([w] if len(w) <= LONG else [w[k : k + LONG] for k in range(0, len(w) - STEP, STEP)])]
    return out


def sentences_of(text: str) -> list[list[str]]:
    """The words of each sentence; of letters with blanks between also what they spell. Long sentences are windows of WORDS words, half as far apart."""
    out = []
    text = text.lower()
    spaced = SPACED.search(text) is not None
    for sentence in END.split(text):
        words = _tokens(sentence)
        if spaced:
            words += ["".join(x.split()) for x in SPACED.findall(sentence)]
        if len(words) <= WORDS:
            if words:
                out.append(words)
        else:
            out += [words[k : k + WORDS] for k in range(0, len(words) - WORDS // 2, WORDS // 2)]
    return out


def words_of(text: str) -> set[str]:
    return {w for s in sentences_of(text) for w in s}


@lru_cache(maxsize=None)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Positions of all triples in n letters that span SPAN at most, their weights, and the scale that gives a word without repeated triples length 1."""
    t = np.array([(i, i + j, i + k) for i in range(n) for j, k in combinations(range(1, SPAN), 2) if i + k < n], np.int64).reshape(-1, 3)
    w = DECAY ** (t[:, 2] - t[:, 0] + 1.0)
    return t[:, 0], t[:, 1], t[:, 2], w.astype(np.float32), float(np.sqrt((w**2).sum())) or 1.0


def _by_length(words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    for n, at in groups.items():
        if n >= 3:
            for lo in range(0, len(at), 2048):
                part = at[lo : lo + 2048]
                yield part, np.frombuffer("".join([words[k] for k in part]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)


class Triples(NamedTuple):
    """Weights of triples, a column for each landmark. Most triples are in no landmark: `place` maps a triple's code to its row, 0 for those, whose row is zeros.

    Where an alphabet has too many triples for that, `place` is empty and the codes are looked up in the sorted `codes` of the landmarks' triples."""

    place: np.ndarray
    rows: np.ndarray
    codes: np.ndarray

    def at(self, code: np.ndarray) -> np.ndarray:
        if len(self.place):
            return self.place[code]
        if not len(self.codes):
            return np.zeros(code.shape, np.int64)
        found = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[found] == code, found + 1, 0)


@dataclass
class Machine:
    """Landmarks' triple weights over an alphabet (code 0: any other letter), their coefficients, the intercept, and the logistic curve from margin to score."""

    letters: str = ""
    triples: Triples = field(default_factory=lambda: Triples(np.zeros(1, np.int32), np.zeros((1, 0), np.float32), np.zeros(0, np.int64)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    intercept: float = -1.0
    slope: float = 0.0
    shift: float = -math.inf

    def features(self, words: list[str]) -> np.ndarray:
        return kernel(words, self.letters, self.triples)

    def score(self, margin: float) -> float:
        if self.shift == -math.inf:
            return 0.0
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.slope * margin + self.shift))))


def _coded(x: np.ndarray, letters: str) -> np.ndarray:
    """Places of characters in the sorted alphabet, from 1; 0 for others."""
    points = np.array([ord(c) for c in letters] or [0], np.uint32)
    found = np.minimum(np.searchsorted(points, x), len(points) - 1)
    return np.where(points[found] == x, found + 1, 0).astype(np.int32 if len(points) < 1000 else np.int64) if letters else np.zeros(x.shape, np.int64)


def tabled(marks: list[str], letters: str) -> Triples:
    """The triples of the landmarks, with a column of weights for each."""
    a = len(letters) + 1
    codes, columns, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
    for at, x in _by_length(marks):
        c = _coded(x, letters)
        i, j, k, w, scale = _triples(x.shape[1])
        row, column = np.nonzero((c[:, i] > 0) & (c[:, j] > 0) & (c[:, k] > 0))
        codes.append(((c[:, i] * a + c[:, j]) * a + c[:, k])[row, column])
        columns.append(np.array(at)[row])
        weights.append((w / scale)[column])
    found, where = np.unique(np.concatenate(codes), return_inverse=True)
    place, rows = np.zeros(a**3 if a**3 <= DENSE else 0, np.int32), np.zeros((len(found) + 1, len(marks)), np.float32)
    if len(place):
        place[found] = np.arange(1, len(found) + 1)
    np.add.at(rows, (where + 1, np.concatenate(columns)), np.concatenate(weights))
    return Triples(place, rows, found)


def kernel(words: list[str], letters: str, triples: Triples) -> np.ndarray:
    """Kernel of each word with each landmark: the mean of the subsequence kernel, which words with inserted letters keep, and its fourth power, which
    tells a form from others with the same root."""
    a = len(letters) + 1
    out = np.zeros((len(words), triples.rows.shape[1]), np.float32)
    for at, x in _by_length(words):
        c = _coded(x, letters)
        i, j, k, w, scale = _triples(x.shape[1])
        place = np.ascontiguousarray(triples.at((c[:, i] * a + c[:, j]) * a + c[:, k]).T)
        total, held = np.zeros((len(at), out.shape[1]), np.float32), np.empty((len(at), out.shape[1]), np.float32)
        for span in np.unique(k - i):  # triples of one span weigh the same
            first, *others = np.flatnonzero(k - i == span)
            some = triples.rows[place[first]]
            for t in others:
                some += np.take(triples.rows, place[t], axis=0, out=held, mode="clip")
            some *= np.float32(w[first] / scale)
            total += some
        out[at] = total
    return (out + out**4) / 2


def _hinge(z: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 20.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps on the rows inside the margin."""
    x = np.hstack([z, np.ones((len(z), 1))]).astype(np.float64)
    weight = weight * cost
    w, keep = np.zeros(x.shape[1]), np.eye(x.shape[1])
    keep[-1, -1] = 1e-6
    for _ in range(50):
        inside = y * (x @ w) < 1
        xi, ci = x[inside], weight[inside]
        new = np.linalg.solve(keep + 2 * (xi * ci[:, None]).T @ xi, 2 * xi.T @ (ci * y[inside]))
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w[:-1], float(w[-1])


def _spread(words: list[str], most: int, letters: str) -> list[str]:
    """Up to `most` words: the first, and then always the one that is least like those taken."""
    taken = [0]
    alike = kernel(words, letters, tabled(words[:1], letters))[:, 0]
    while len(taken) < min(most, len(words)):
        alike[taken] = np.inf
        taken.append(int(alike.argmin()))
        alike = np.maximum(alike, kernel(words, letters, tabled([words[taken[-1]]], letters))[:, 0])
    return [words[k] for k in taken]


def inserted(word: str) -> list[str]:
    """A word with a sign that is no letter, or with the letter before once more, at each place within it."""
    return [word[:k] + c + word[k:] for k in range(1, len(word)) for c in ("0", word[k - 1])] if len(word) >= 4 else []


def machine_of(marks: list[str], letters: str) -> tuple[Machine, np.ndarray]:
    """A machine without weights over landmarks, and the map from kernels to its feature space."""
    triples = tabled(marks, letters)
    values, vectors = np.linalg.eigh(kernel(marks, letters, triples) + 1e-4 * np.eye(len(marks)))
    return Machine(letters, triples), vectors / np.sqrt(np.maximum(values, 1e-4))


def fit_sentences(machine: Machine, root: np.ndarray, x: np.ndarray, docs: np.ndarray, toxic: np.ndarray, worst: np.ndarray, changed: np.ndarray) -> Machine:
    """Weights from sentences: their kernels x, the text of each, its label, and how toxic each sentence seems so far.

    Of each toxic text the worst sentence is positive, and so is any that the machine then takes for toxic; the other ones aren't used. `changed` are
    kernels of insults with an inserted letter; each is put into a clean sentence."""
    z, clean = x @ root, np.flatnonzero(toxic == 0)
    more = np.maximum(changed, x[clean[np.arange(len(changed)) % len(clean)]]) @ root if len(changed) and len(clean) else np.zeros((0, z.shape[1]))
    seen = worst.astype(float)
    for step in range(6):
        order = np.lexsort((-seen, docs))
        first = order[np.concatenate([[True], docs[order][1:] != docs[order][:-1]])]
        positive = np.zeros(len(z), bool)
        positive[first] = True
        positive &= toxic > 0
        if step:
            positive = (toxic > 0) & (positive & (seen > UNSEEN) | (seen > 0))
        if not positive.any():
            break
        rows = np.concatenate([z[positive], more, z[clean]])
        n = int(positive.sum()), len(more), len(clean)
        w, b = _hinge(rows, np.repeat([1.0, 1.0, -1.0], n), np.repeat([2.0, 2.0 * min(1.0, n[0] / max(1, n[1])) * 0.25, 1.0], n))
        new = z @ w + b
        done = np.abs(new - seen).max() < 1e-6
        seen = new
        machine.weights, machine.intercept = (root @ w).astype(np.float32), b
        if done:
            break
    return machine


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through margins and labels, slightly kept from infinity."""
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        g = np.array([(p - y) @ x + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
        q = p * (1 - p) + 1e-9
        h = np.array([[q @ (x * x) + 1e-2, q @ x], [q @ x, q.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def held_out(key: str = "doc_id", folds: int = 5) -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int) -> DataFrame:
    """(doc, toxic, text) of at most `rows` labelled rows that aren't held out, the first by a hash of their keys. Of several labels of a key the largest counts."""
    said = labels.where(~held_out(key)).where(labels[key].isNotNull() & labels[label].isNotNull()).groupBy(F.col(key).cast("long").alias("doc")).agg(F.max(label).cast("int").alias("toxic"))
    found = docs.select(docs[key].cast("long").alias("doc")).distinct().join(said, "doc").orderBy(F.xxhash64("doc"), "doc").limit(rows)
    texts = docs.select(docs[key].cast("long").alias("doc"), F.coalesce(docs[text], F.lit("")).alias("text"))
    return texts.join(F.broadcast(found), "doc")  # at most `rows` pairs of numbers


def _sketch(words: list[str], n: int = 8) -> list[int]:
    """Min-hashes of a text's runs of five words."""
    runs = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    h = np.array([xxhash.xxh3_64_intdigest(r) for r in runs], np.uint64)
    return [int((h * np.uint64(2 * k + 1) ^ (h >> np.uint64(k + 7))).min() >> np.uint64(1)) for k in range(n)]


def _unlike(rows: DataFrame) -> DataFrame:
    """The rows without those that share a min-hash with a row of smaller key: of near copies one stays, so that none of their words counts often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([_sketch(t.as_py().lower().split()) for t in texts], pa.list_(pa.int64()))], ["doc", "sketch"])

    marks = rows.select("doc", "text").mapInArrow(freeing(run), "doc long, sketch array<bigint>").select("doc", F.posexplode("sketch").alias("k", "mark"))
    first = marks.groupBy("k", "mark").agg(F.min("doc").alias("first"), F.collect_set("doc").alias("docs"))
    later = first.select("first", F.explode("docs").alias("doc")).where("doc > first").select("doc").distinct()
    return rows.join(later, "doc", "left_anti")


def _exploded(rows: DataFrame) -> DataFrame:
    """(doc, toxic, word, stem) for each distinct word of each text, stem false, and each distinct beginning of 4 to 6 letters of its longer words, stem true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words = [w for w in words_of(r["text"]) if len(w) >= 3]
                stems = list({w[:n] for w in words for n in (4, 5, 6) if len(w) > n})
                n = len(words) + len(stems)
                yield pa.RecordBatch.from_arrays([pa.array([r["doc"]] * n, pa.int64()), pa.array([r["toxic"]] * n, pa.int32()), pa.array(words + stems, pa.string()), pa.array([False] * len(words) + [True] * len(stems), pa.bool_())], ["doc", "toxic", "word", "stem"])

    return rows.select("doc", "toxic", "text").mapInArrow(freeing(run), "doc long, toxic int, word string, stem boolean")


def _threshold(sizes: list, rate: float) -> int:
    """The least count of toxic texts at which hardly any word or stem that is never in a clean text got there by chance. sizes: (count of texts, words with it)."""
    k = 2
    while sum(n * rate**c for c, n in sizes if c >= k) > 0.3:
        k += 1
    return k


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Machine:
    """Fit on a sample of at most `rows` labelled rows that aren't held out, near copies left out. Without a toxic one, the machine scores 0 everywhere.

    Landmarks are chosen among the words and stems that only toxic texts have, more of them than chance explains (up to 2 * CANDIDATES of these and
    CANDIDATES words that begin with such a stem, the most frequent first), and the 4 * LANDMARKS words of clean texts closest to them. The machine is
    then trained on sentences, in ROUNDS: in each, every sampled text's SENTENCES sentences that the machine takes for the worst come to the driver as
    rows of LANDMARKS numbers. Statistics of words, kernels and margins are made by Spark.
    """
    drawn = written(sample(docs, labels, key, text, label, rows), "drawn")  # cut here, or the planner moves the removal of copies below the draw, onto all texts
    chosen = written(_unlike(drawn), "sample")
    forget(drawn)
    counts = {r.toxic: r.n for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    stats = written(_exploded(chosen).groupBy("word", "stem").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")), "words")
    sizes = [(r.n_texts, r.n) for r in stats.groupBy((F.col("bad") + F.col("good")).alias("n_texts")).agg(F.count("*").alias("n")).collect()]
    least = _threshold(sizes, counts.get(1, 0) / max(1, sum(counts.values())))
    found = stats.where("good = 0").where(F.col("bad") >= least).orderBy(F.desc("bad"), "word").limit(2 * CANDIDATES)
    units = found.collect()
    stems = [r.word for r in units if r.stem]
    begins = F.lit(False)
    for n in (4, 5, 6):
        begins |= F.substring("word", 1, n).isin([x for x in stems if len(x) == n])
    positive = list(dict.fromkeys([r.word for r in units if not r.stem] + [r.word for r in stats.where("not stem and good = 0").where(begins).orderBy(F.desc("bad"), "word").limit(CANDIDATES).collect()]))
    if not positive:
        forget(chosen, stats)
        return Machine()
    # landmarks of both classes: insults, spread out, and the words of clean texts that come closest to these, spread out as well
    letters = "".join(sorted({c for w in [*positive, *stems] for c in w}))
    marks = _spread(list(dict.fromkeys(r.word for r in units)), LANDMARKS // 2, letters)
    nearest = _nearest(tabled(marks, letters), letters)
    close = [r.word for r in stats.where("not stem and good > 0").select("word", nearest("word").alias("near")).orderBy(F.desc("near"), "word").limit(4 * LANDMARKS).collect()]
    other = _spread(close, LANDMARKS // 2, letters) if close else []
    machine, root = machine_of(marks + other, letters)
    near = kernel(positive, letters, tabled(close, letters)).max(1) if close else np.zeros(len(positive))
    known = set(close)
    changed = machine.features([w for w in dict.fromkeys(chain.from_iterable(inserted(w) for w, k in zip(positive, near, strict=True) if k < APART)) if w not in known])
    rank = np.zeros(len(marks) + len(other), np.float32)
    rank[: len(marks)] = 1  # the first round takes the sentences closest to an insult
    seen: dict[tuple[int, int], tuple[int, np.ndarray, float]] = {}
    for k in range(ROUNDS):
        for r in _worst_sentences(chosen, machine, rank if not k else None).collect():
            seen[r.doc, r.place] = (r.toxic, np.frombuffer(r.x, np.float32), r.margin)
        keys = list(seen)
        x = np.stack([seen[i][1] for i in keys]).astype(np.float64)
        worst = np.array([seen[i][2] for i in keys]) if not k else x @ machine.weights + machine.intercept
        machine = fit_sentences(machine, root, x, np.array([i[0] for i in keys]), np.array([seen[i][0] for i in keys]), worst, changed)
    margins = scored(chosen, machine, "doc", "text", keep=("toxic",)).select("margin", "toxic").collect()
    machine.slope, machine.shift = _logistic(np.array([r.margin for r in margins], float), np.array([r.toxic for r in margins], float))
    forget(chosen, stats)
    return machine


def _nearest(triples: Triples, letters: str):
    """The kernel of a word with the closest of some landmarks, as a column."""

    @F.pandas_udf("double")
    def near(words):
        return words.__class__(kernel(words.tolist(), letters, triples).max(1).astype(float))

    return near


class Reader:
    """Kernels of words, kept for at most KEPT of them, and from these those of sentences."""

    def __init__(self, machine: Machine) -> None:
        self.machine, self.known, self.before = machine, {}, {}
        self.rows = self.rows_before = np.zeros((0, machine.triples.rows.shape[1]), np.float32)

    def _places(self, words: set[str]) -> None:
        """See to it that `words` are known. Words come in two generations; what the older one alone holds goes when the younger one is full."""
        missing = words - self.known.keys()
        if len(self.known) + len(missing) > KEPT // 2:
            self.before, self.rows_before = self.known, self.rows
            self.known, self.rows, missing = {}, self.rows[:0], words
        if missing:
            n, old = len(self.known), [w for w in missing if w in self.before]
            new = [w for w in missing if w not in self.before]
            if n + len(missing) > len(self.rows):
                rows = np.zeros((max(n + len(missing), min(2 * n, KEPT // 2), 1 << 10), self.rows.shape[1]), np.float32)
                rows[:n] = self.rows[:n]
                self.rows = rows
            self.rows[n : n + len(old)] = self.rows_before[[self.before[w] for w in old]]
            self.rows[n + len(old) : n + len(missing)] = self.machine.features(new)
            self.known.update(zip(chain(old, new), range(n, n + len(missing)), strict=True))

    def kernels(self, sentences: list[list[str]]) -> Iterator[np.ndarray]:
        """Of each sentence with each landmark that of its closest word, about PART words at a time."""
        at = 0
        while at < len(sentences):
            end, n = at, 0
            while end < len(sentences) and (n == 0 or n + len(sentences[end]) <= PART):
                n += len(sentences[end])
                end += 1
            part = sentences[at:end]
            self._places(set().union(*part))
            place = np.fromiter(map(self.known.__getitem__, chain.from_iterable(part)), np.int64, n)
            size = np.array(list(map(len, part)))
            order = np.argsort(-size, kind="stable")  # long sentences first: those with a k-th word are the first ones
            size, begin = size[order], (np.cumsum(size) - size)[order]
            most = self.rows[place[begin]]
            for k in range(1, int(size[0])):
                held = most[: np.searchsorted(-size, -k)]
                np.maximum(held, self.rows[place[begin[: len(held)] + k]], out=held)
            out = np.empty_like(most)
            out[order] = most
            yield out
            at = end


def _worst_sentences(rows: DataFrame, machine: Machine, rank: np.ndarray | None, most: int = SENTENCES) -> DataFrame:
    """(doc, toxic, place, margin, x): the kernels of each text's `most` sentences of the highest margin, or, with `rank`, of the highest kernel with a ranked landmark."""
    arrow = pa.schema([("doc", pa.int64()), ("toxic", pa.int32()), ("place", pa.int32()), ("margin", pa.float64()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(machine)
        for batch in batches:
            for doc, toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if not (sentences := sentences_of(text.as_py())):
                    continue
                x = np.concatenate(list(reader.kernels(sentences)))
                margin = (x * rank).max(1) if rank is not None else x @ machine.weights + np.float32(machine.intercept)
                top = np.argsort(-margin, kind="stable")[:most]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(top), pa.int64()), pa.array([toxic] * len(top), pa.int32()), pa.array(top.astype(np.int32)), pa.array(margin[top].astype(float)), pa.array([x[k].tobytes() for k in top], pa.binary())], schema=arrow)

    return rows.select("doc", "toxic", "text").mapInArrow(freeing(run), "doc long, toxic int, place int, margin double, x binary")


def scored(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, margin, score, predicted) of every row's whole text. Null and empty texts have no words and the intercept as their margin; rows are worked on alone.

    The text itself, if it is in `keep`, comes last before the margin, and goes to the tasks once."""
    rows = docs.select(docs[text].alias("__text"), docs[key].cast("long").alias(key), *[c for c in keep if c != text])
    whole = text in keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(machine)
        for batch in batches:
            margins = np.full(batch.num_rows, machine.intercept)
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy().astype(np.int64))
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, "right")))
                parts = [sentences_of(t.as_py() or "") for t in batch.column(0).slice(at, upto - at)]
                if every := list(chain.from_iterable(parts)):
                    each = np.concatenate([x @ machine.weights for x in reader.kernels(every)]) + np.float32(machine.intercept)
                    size = np.array([len(p) for p in parts])
                    begins = (np.cumsum(size) - size)[size > 0]
                    margins[at + np.flatnonzero(size)] = np.maximum.reduceat(each, begins)
                at = upto
            scores = [machine.score(m) for m in margins.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *batch.columns[:whole], pa.array(margins, pa.float64()), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], [*batch.schema.names[1:], *[text][:whole], "margin", "score", "predicted"])

    kept = rows.select(*rows.columns[1:], *([F.col("__text").alias(text)] if whole else []))
    schema = kept.schema.add("margin", "double").add("score", "double").add("predicted", "integer")
    return rows.mapInArrow(freeing(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(key, held_out, score, predicted, margin) for every row of `docs`, by a machine fitted on labelled rows that aren't held out."""
    return scored(docs, fit(docs, labels, key, text, label, rows), key, text).select(key, held_out(key).alias("held_out"), "score", "predicted", "margin")
