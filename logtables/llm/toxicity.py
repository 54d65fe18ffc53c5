"""Toxicity from the nearest labelled examples.

A text becomes a TF-IDF vector (occurrences times idf) over terms: words, and the first
``PREFIX`` letters of longer ones, which catch inflected forms. The vocabulary knows nothing of
labels: of the terms in at most ``SHARE`` of all documents, the ``TERMS`` most frequent, with
counts from every document. All sampled examples are indexed. The nearest ones by exact
cosine come from an inverted index whose postings are cut into blocks of examples; each term
keeps its largest weight per block, so a query bounds every block, looks into blocks from the
best bound down and stops when no block can beat what it has. They vote with their cosine; a
logistic curve fitted on left-out examples turns votes into scores, and the neighbours
themselves are the evidence.

Bounds: the fit reads at most about ``EXAMPLES`` labelled rows, chosen by a hash of their id,
one row an id. Examples with equal vectors are one entry with counts.

Defined results: a null or empty text, like any text without a term, has no neighbours and
gets the score of such examples; conflicting labels of one id count as toxic, of several texts
of one id the last in order is the example; labels that are null are left out; without any
example every score is 0. Equally near entries go by their order, which depends on their terms
alone. Repeated rows are scored alike, other columns are kept, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, hash_key, settled, unit

EXAMPLES = 4096
TERMS = 16384
#: Documents a term may be in, of all with a term.
SHARE = 0.05
NEIGHBOURS = 32
BLOCK = 256
#: Blocks looked into before the bounds of the others are tried.
FIRST = 4
#: Where the bounds leave most blocks to nearly every text, one text in so many tries them.
TRIED = 16
PREFIX = 5
WORD = re.compile(r"[^\W_]+")
#: The bytes, with a blank for what ``WORD`` leaves out of ASCII.
BLANKS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
#: Terms a counting task holds; texts a scoring task remembers.
REMEMBERED, SEEN = 200_000, 20_000


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of several ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def words_of(text: str) -> list[str]:
    """The matches of ``WORD`` in the text in lower case, in any order; the pattern itself is needed
    only where a letter of no ASCII is beside a character that is neither letter nor digit."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(BLANKS).decode("utf-8", "surrogatepass").split()
    good = [w for w in words if w.isalnum()]
    if len(good) < len(words):
        good += WORD.findall(" ".join([w for w in words if not w.isalnum()]))
    return good


class Model:
    """The index over example vectors, built once on the driver and broadcast."""

    def __init__(self, terms: list[str], idf: np.ndarray):
        self.terms, self.idf = terms, idf
        self.whole = {t[1:]: i for i, t in enumerate(terms) if t[0] == "="}
        self.starts = {t[1:]: i for i, t in enumerate(terms) if t[0] == "^"}
        self.platt = (0.0, 0.0)
        self.base = 0.0
        self.empty_score = 0.0
        self.seen: dict = {}
        self.lists: list[np.ndarray] | None = None
        self.wide, self.turn = 0.0, 0

    def __getstate__(self):
        return self.__dict__ | {"seen": {}, "lists": None}

    def counts(self, text: str | None) -> tuple[tuple[int, int], ...]:
        """(term, occurrences) of a text, in order of the term."""
        found: dict[int, int] = {}
        times = Counter(words_of(text)) if text else {}
        for word, number in zip(times, map(self.whole.get, times)):
            if number is not None:
                found[number] = times[word]
        long = [w for w in times if len(w) > PREFIX]
        for word, number in zip(long, map(self.starts.get, [w[:PREFIX] for w in long])):
            if number is not None:
                found[number] = found.get(number, 0) + times[word]
        return tuple(sorted(found.items()))

    def vector(self, counts) -> tuple[np.ndarray, np.ndarray]:
        flat = np.fromiter(chain.from_iterable(counts), np.int64, 2 * len(counts))
        numbers = flat[::2]
        weights = flat[1::2] * self.idf[numbers]
        return numbers, weights / np.sqrt((weights**2).sum())

    def build(self, examples: list[tuple[tuple, int, int, list[int]]]) -> None:
        """``examples``: (counts, rows, toxic rows, ids) of distinct vectors."""
        examples = [e for e in examples if e[0]]
        vectors = [self.vector(e[0]) for e in examples]
        # Examples with the same heaviest terms share blocks, which tightens the bounds.
        order = sorted(range(len(examples)), key=lambda i: (tuple(vectors[i][0][np.argsort(-vectors[i][1], kind="stable")][:3]), examples[i][0]))
        examples, vectors = [examples[i] for i in order], [vectors[i] for i in order]
        self.order = [e[0] for e in examples]
        self.rows = np.array([e[1] for e in examples], np.float64)
        self.toxic = np.array([e[2] for e in examples], np.float64)
        self.ids = [e[3] for e in examples]
        self.blocks = -(-len(examples) // BLOCK)
        sizes = np.array([len(v[0]) for v in vectors], np.int64)
        entry = np.repeat(np.arange(len(vectors)), sizes)
        term = np.concatenate([v[0] for v in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
        by_term = np.lexsort((entry, term))
        entry, term, weight = entry[by_term], term[by_term], weight[by_term]
        # A cell is a term's postings within a block of examples.
        key = term * max(self.blocks, 1) + entry // BLOCK
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        # A posting is one small number, times and entry, as they are read from all over the memory.
        times = np.array([c[1] for e in examples for c in e[0]], np.int64)[by_term]
        self.bits = len(vectors).bit_length()
        packed = (times << self.bits) | entry
        self.postings = packed.astype(np.min_scalar_type(int(packed.max(initial=0))))
        self.factor = np.array([w[0] / (e[0][0][1] * self.idf[e[0][0][0]]) for (_, w), e in zip(vectors, examples)])
        # The cells' first postings, sizes and largest weights, a line a term, a column a block.
        self.lists, self.cuts = None, np.searchsorted(term, np.arange(len(self.terms) + 1))
        shape = (len(self.terms), self.blocks)
        self.cell_start, self.cell_size, self.cell_most = np.zeros(shape, np.int32), np.zeros(shape, np.int32), np.zeros(shape)
        at = term[first], entry[first] // BLOCK
        self.cell_start[at] = first
        self.cell_size[at] = np.diff(np.append(first, len(key)))
        self.cell_most[at] = np.maximum.reduceat(weight, first) if len(first) else np.zeros(0)

    def nearest(self, counts, k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        """The k entries of largest cosine, (cosine, entry), ties to the earlier entry."""
        numbers, weights = self.vector(counts)
        # Of the cosine the entries' factors are left to the end.
        parts = weights * self.idf[numbers]
        self.turn += 1
        if self.wide > 0.9 and self.turn % TRIED:
            return self._whole(numbers, parts, k, 0.0)
        starts, sizes = self.cell_start[numbers], self.cell_size[numbers]
        bounds = weights @ self.cell_most[numbers]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        scores, found = self._cells(starts[:, order[:FIRST]], sizes[:, order[:FIRST]], parts, k, 0.0)
        rest, least = order[FIRST:], scores[-1] if len(scores) == k else 0.0
        rest = rest[bounds[rest] + 1e-12 >= least]
        self.wide += 0.1 * ((2 * len(rest) > self.blocks) - self.wide)
        if 2 * len(rest) > self.blocks:
            return self._whole(numbers, parts, k, least)
        if len(rest):
            more, new = self._cells(starts[:, rest], sizes[:, rest], parts, k, least)
            scores, found = np.append(scores, more), np.append(found, new)
            best = np.lexsort((found, -scores))[:k]
            scores, found = scores[best], found[best]
        return list(zip(scores.tolist(), found.tolist()))

    def _cells(self, starts: np.ndarray, sizes: np.ndarray, parts: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The best entries of some blocks."""
        posting = self.postings[_spread(starts.ravel(), sizes.ravel())]
        return self._best(posting, np.repeat(parts, sizes.sum(axis=1)), k, least)

    def _whole(self, numbers: np.ndarray, parts: np.ndarray, k: int, least: float) -> list[tuple[float, int]]:
        """The best entries of all blocks, from the whole lists of the terms."""
        if self.lists is None:
            self.lists = np.split(self.postings, self.cuts[1:-1])
        posting = np.concatenate([self.lists[t] for t in numbers.tolist()])
        scores, found = self._best(posting, np.repeat(parts, self.cuts[numbers + 1] - self.cuts[numbers]), k, least)
        return list(zip(scores.tolist(), found.tolist()))

    def _best(self, posting: np.ndarray, weights: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The k entries with the best sums over postings, best first, none below ``least``."""
        sums = np.bincount(posting & ((1 << self.bits) - 1), (posting >> self.bits) * weights, len(self.ids)) * self.factor
        found = np.flatnonzero(sums >= least if least > 0 else sums)
        scores = sums[found]
        if len(found) > k:
            best = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
            scores, found = scores[best], found[best]
        best = np.lexsort((found, -scores))[:k]
        return scores[best], found[best]

    def vote(self, near: list[tuple[float, int]], own: tuple[int, float, float] | None = None) -> float:
        """Log odds of the weighted vote; ``own`` (entry, rows, toxic rows) is taken out, when
        the query is an example itself."""
        yes = no = 0.0
        for cosine, entry in near:
            rows, toxic = self.rows[entry], self.toxic[entry]
            if own and entry == own[0]:
                rows, toxic = rows - own[1], toxic - own[2]
            weight = min(cosine, 1.0)
            yes += weight * toxic
            no += weight * (rows - toxic)
        return math.log((yes + self.base) / (no + 1 - self.base))

    def calibrate(self, examples: list[tuple[tuple, int, int, list[int]]]) -> None:
        points: list[tuple[float, float, float]] = []
        entry_of = {counts: i for i, counts in enumerate(self.order)}
        for counts, rows, toxic, _ in examples:
            if counts:
                near = self.nearest(counts)
                if toxic:
                    points.append((self.vote(near, (entry_of[counts], 1, 1)), 1.0, toxic))
                if rows > toxic:
                    points.append((self.vote(near, (entry_of[counts], 1, 0)), 0.0, rows - toxic))
        self.order = []
        a, b = 1.0, 0.0
        if points and len({p[1] for p in points}) == 2:
            x, y, w = (np.array(v) for v in zip(*points))
            for _ in range(50):
                p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
                slope, curve = w * (p - y), np.maximum(w * p * (1 - p), 1e-9)
                grad = np.array([(slope * x).sum() + 1e-3 * (a - 1), slope.sum() + 1e-3 * b])
                hess = np.array([[(curve * x * x).sum() + 1e-3, (curve * x).sum()], [(curve * x).sum(), curve.sum() + 1e-3]])
                step = np.linalg.solve(hess, grad)
                a, b = a - step[0], b - step[1]
                if np.abs(step).max() < 1e-8:
                    break
        self.platt = (float(max(a, 1e-3)), float(b))

    def score(self, text: str | None) -> tuple[float, list[int]]:
        """Score and the ids of the nearest examples, nearest first."""
        # Copies are scored once; the memory holds digests, not texts or their terms.
        key = hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()
        known = self.seen.get(key)
        if known is None:
            counts = self.counts(text)
            if not counts or not self.blocks:
                return self.empty_score, []
            near = self.nearest(counts)
            raw = self.platt[0] * self.vote(near) + self.platt[1]
            evidence = [self.ids[i][0] for _, i in near[:3] if self.ids[i]]
            known = (1 / (1 + math.exp(-max(-30.0, min(30.0, raw)))), evidence)
            if len(self.seen) > SEEN:
                self.seen.clear()
            self.seen[key] = known
        return known


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents with it) of a task's documents; the empty term counts documents with any."""
    words_in: Counter[str] = Counter()
    starts_in: Counter[str] = Counter()
    documents = 0

    def flush() -> pa.RecordBatch:
        terms = ["", *("=" + w for w in words_in), *("^" + w for w in starts_in)]
        columns = [pa.array(terms, pa.string()), pa.array([documents, *words_in.values(), *starts_in.values()], pa.int64())]
        words_in.clear()
        starts_in.clear()
        return pa.RecordBatch.from_arrays(columns, ["term", "n"])

    for batch in batches:
        for text in batch.column("text"):
            words = set(words_of(text.as_py() or ""))
            words_in.update(words)
            starts_in.update({w[:PREFIX] for w in words if len(w) > PREFIX})
            documents += bool(words)
        if len(words_in) + len(starts_in) > REMEMBERED:
            yield flush()
            documents = 0
    yield flush()


def vocabulary(docs: DataFrame, terms: int = TERMS) -> tuple[list[str], np.ndarray]:
    """The terms and their idf, from all documents and without any label."""
    counted = settled(docs.select("text").mapInArrow(_count_terms, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")))
    total = counted.where("term = ''").agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    kept = counted.where((F.col("term") != "") & (F.col("n") <= F.lit(max(1.0, SHARE * total))))
    best = kept.orderBy(F.desc("n"), "term").limit(terms).collect()
    return [r["term"] for r in best], np.array([math.log(1 + total / r["n"]) for r in best])


def train(docs: DataFrame, labels: DataFrame, seed: str = "toxicity", examples: int = EXAMPLES, terms: int = TERMS) -> Model | None:
    """A model of the documents with a label; None if there are none."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = marks.count()
    if not total:
        return None
    share = 1.0 if total <= 64 else examples / total
    chosen = settled(marks.withColumn("key", hash_key(seed, F.col("doc_id"))).where(unit(F.col("key")) < share).select("doc_id", "toxic"))
    # At most about ``examples`` narrow rows, so that the texts are not shuffled.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = settled(rows.groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic")))
    if rows.isEmpty():
        return None
    model = Model(*vocabulary(docs, terms))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        def step(part: pa.RecordBatch) -> list[pa.Array]:
            found = [shared.value.counts(t) for t in part.column("text").to_pylist()]
            return [pa.array([[c[0] for c in f] for f in found], pa.list_(pa.int32())), pa.array([[c[1] for c in f] for f in found], pa.list_(pa.int32()))]

        return step

    vectors = arrow_pass(rows, "terms array<int>, times array<int>", work, keep=["doc_id", "toxic"]).toArrow()
    toxic = (vectors["toxic"].to_numpy() > 0).astype(np.int64)
    groups: dict[tuple, list] = {}
    for doc, y, numbers, times in zip(vectors["doc_id"].to_pylist(), toxic.tolist(), vectors["terms"].to_pylist(), vectors["times"].to_pylist()):
        entry = groups.setdefault(tuple(zip(numbers, times)), [0, 0, []])
        entry[0] += 1
        entry[1] += y
        entry[2].append(doc)
    entries = [(k, v[0], v[1], sorted(v[2])[:1]) for k, v in sorted(groups.items())]
    model.base = min(max(float(toxic.mean()), 1e-3), 1 - 1e-3)
    model.build(entries)
    model.calibrate(entries)
    bare = groups.get((), [0, 0])
    model.empty_score = (bare[1] + model.base) / (bare[0] + 1)
    return model


def score(docs: DataFrame, model: Model | None, names: tuple[str, str] = ("score", "evidence"), keep: list[str] | None = None) -> DataFrame:
    """Adds the score and the ids of the nearest examples to every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        def step(part: pa.RecordBatch) -> list[pa.Array]:
            texts = part.column("text").to_pylist()
            found = [shared.value.score(t) if shared.value else (0.0, []) for t in texts]
            return [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))]

        return step

    return arrow_pass(docs, f"`{names[0]}` double, `{names[1]}` array<bigint>", work, keep)
