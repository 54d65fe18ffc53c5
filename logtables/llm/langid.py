"""Language identification with a string kernel.

A text is the set of its character n-grams (presence, not counts); the blended-spectrum
kernel of two texts is the weighted number of 1-, 2- and 3-grams they share, divided by the
root of both texts' own values. Grams are of whole code points, in lower case: letters and marks
as they are, every blank as one blank, every other sign as one sign. Nyström landmarks, a
fixed number of training texts of each language, turn the kernel into a feature space in which
ridge regression is solved once for all languages, one against the rest. A slice of texts is
scored by two matrix products: its presence matrix with that of the landmarks, over the
grams that occur on both sides, and the kernel values with the weights.

Bounds: the fit reads at most ``TEXTS_EACH`` labelled texts of a language, those of smallest
hash of their id, and of the ``LANGUAGES`` languages with most texts; of these texts,
``LANDMARKS`` divided by the languages are landmarks, four a language at least. So a rare
language is learned as well as a frequent one. Every text is scored whole.

Defined results: a text that is null or has no letter is ``und`` with score 0; with no
labelled text to learn from every text is ``und`` with score 0. Of languages with equal values
the first in code-point order is taken; of texts with one hash the smaller id, then text, is
learned from. Rows of the training table with null text, language or id are not learned from,
repeated ones once. Repeated rows are scored alike, other columns are kept, an empty table
gives no rows.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_pass, hash_key, settled

TEXTS_EACH = 1024
LANGUAGES = 1000
LANDMARKS = 192
#: Weight of shared 1-, 2- and 3-grams.
WEIGHTS = (0.2, 1.0, 1.0)
RIDGE = 1e-3
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
TEXTS_AT_ONCE = 16
#: A text is like no language if fewer of its grams are known than half of what all but this
#: share of the training texts reach.
UNLIKE = 0.001
BLANK, SIGN = 0x20, 0x2E

_signs: list[np.ndarray] = []


def _symbols(text: str) -> np.ndarray:
    """A text's symbols between two blanks."""
    if not _signs:  # once in a process
        kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
        table = np.array([c if k in "LM" else SIGN for c, k in enumerate(kinds)], np.int64)
        table[[c for c in range(0x3100) if chr(c).isspace()]] = BLANK
        _signs.append(table)
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return _signs[0][codes]


def grams(text: str) -> list[np.ndarray]:
    """The distinct 1-, 2- and 3-grams of a text as numbers in order."""
    symbols = _symbols(text)
    found, codes = [], symbols
    for n in range(len(WEIGHTS)):
        if n:
            codes = (codes[:-1] << 21) | symbols[n:]
        ordered = np.sort(codes)
        found.append(ordered[np.append(True, ordered[1:] != ordered[:-1])] if len(ordered) else ordered)
    return found


class Model:
    """Landmarks and weights; ``languages`` in the order of the weights' columns."""

    def __init__(self, texts: list[str]):
        sets = [grams(t) for t in texts]
        own = np.sqrt([sum(w * len(g) for w, g in zip(WEIGHTS, s)) for s in sets])
        self.columns, self.landmarks = [], []
        for n, weight in enumerate(WEIGHTS):
            columns = np.unique(np.concatenate([s[n] for s in sets])) if sets else np.zeros(0, np.int64)
            matrix = np.zeros((len(columns), len(texts)), np.float32)
            for i, s in enumerate(sets):
                matrix[np.searchsorted(columns, s[n]), i] = weight / own[i]
            self.columns.append(columns)
            self.landmarks.append(matrix)
        self.languages: list[str] = []
        self.weights: np.ndarray | None = None
        self.scale, self.floor = 1.0, 0.0

    def kernel(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Kernel values of every text with every landmark, and the weighted share of its grams that any landmark has."""
        rows, known = [np.zeros((0, self.landmarks[0].shape[1]))], [np.zeros(0)]
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            sets = [grams(t) for t in texts[at : at + TEXTS_AT_ONCE]]
            own = np.array([sum(w * len(g) for w, g in zip(WEIGHTS, s)) for s in sets])
            shared = np.zeros((len(sets), self.landmarks[0].shape[1]), np.float32)
            there = np.zeros(len(sets))
            for n, (weight, columns, matrix) in enumerate(zip(WEIGHTS, self.columns, self.landmarks)):
                codes = np.concatenate([s[n] for s in sets])
                row = np.repeat(np.arange(len(sets)), [len(s[n]) for s in sets])
                place = np.minimum(np.searchsorted(columns, codes), max(len(columns) - 1, 0))
                hit = columns[place] == codes if len(columns) else np.zeros(len(codes), bool)
                row, place = row[hit], place[hit]
                used, column = np.unique(place, return_inverse=True)
                presence = np.zeros((len(sets), len(used)), np.float32)
                presence[row, column] = 1
                shared += presence @ matrix[used]
                there += weight * np.bincount(row, minlength=len(sets))
            rows.append(shared / np.sqrt(np.maximum(own, 1e-9))[:, None])
            known.append(there / np.maximum(own, 1e-9))
        return np.concatenate(rows), np.concatenate(known)

    def fit(self, kernel: np.ndarray, labels: list[str], among: np.ndarray) -> None:
        """``kernel``: training texts with landmarks; ``among``: landmarks with landmarks."""
        self.languages = sorted(set(labels))
        values, vectors = np.linalg.eigh((among + among.T) / 2)
        good = values > 1e-6 * max(values.max(), 1e-12)
        root = vectors[:, good] / np.sqrt(values[good])
        features = np.hstack([kernel @ root, np.ones((len(kernel), 1))])
        targets = np.where(np.array(labels)[:, None] == np.array(self.languages)[None, :], 1.0, -1.0)
        # Languages weigh alike, however many texts each has.
        per = np.array([1.0 / labels.count(x) for x in self.languages])
        weigh = per[[self.languages.index(x) for x in labels]]
        weighted = features * weigh[:, None]
        inner = weighted.T @ features
        inner[np.diag_indices_from(inner)] += RIDGE * np.trace(inner) / len(inner)
        solved = np.linalg.solve(inner, weighted.T @ targets)
        self.weights = np.vstack([root @ solved[:-1], solved[-1:]])
        # The scale that makes the softmax of the margins most likely on the training texts.
        margins = features @ solved
        right = np.argmax(targets, axis=1)
        best = (-np.inf, 1.0)
        for scale in (1.0, 2.0, 3.0, 4.0, 6.0, 8.0):
            logits = margins * scale
            logits = logits - logits.max(1, keepdims=True)
            chance = logits[np.arange(len(right)), right] - np.log(np.exp(logits).sum(1))
            best = max(best, (float((chance * weigh).sum()), scale))
        self.scale = best[1]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Languages, scores, and the share of each text's grams that are known."""
        languages, scores, shares = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if known and self.weights is not None:
            kernel, there = self.kernel([texts[i] for i in known])
            margins = (kernel @ self.weights[:-1] + self.weights[-1]) * self.scale
            chances = np.exp(margins - margins.max(1, keepdims=True))
            chances /= chances.sum(1, keepdims=True)
            for i, best, row, share in zip(known, margins.argmax(1), chances, there.tolist()):
                languages[i], scores[i], shares[i] = self.languages[best], float(min(1.0, row[best])), share
        return languages, scores, shares


def train(labelled: DataFrame, seed: str = "language", texts: int = TEXTS_EACH, landmarks: int = LANDMARKS) -> Model | None:
    """A model of the rows (doc_id, text, lang); None if there is nothing to learn from.

    The driver gets the landmarks' texts and, for each training text, its language and its
    kernel values: both bounded by parameters.
    """
    rows = labelled.select("doc_id", "text", "lang").where("doc_id is not null and lang is not null").where(F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("key", hash_key(seed, F.col("doc_id")))
    languages = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not languages:
        return None
    # Only keys are ordered; the group limit works before the shuffle, so a frequent language costs no more.
    order = Window.partitionBy("lang").orderBy("key", "doc_id", "print")
    picked = rows.select("lang", "key", "doc_id", F.xxhash64("text").alias("print")).where(F.col("lang").isin([r["lang"] for r in languages]))
    picked = picked.withColumn("n", F.row_number().over(order)).where(F.col("n") <= texts).select("lang", "key", "doc_id", "print").distinct()
    chosen = rows.withColumn("print", F.xxhash64("text")).join(F.broadcast(settled(picked)), ["lang", "key", "doc_id", "print"])
    chosen = settled(chosen.dropDuplicates(["doc_id", "lang", "print"]))
    each = max(4, landmarks // len(languages))
    placed = Window.partitionBy("lang").orderBy("key", "doc_id", "print")
    marks = chosen.withColumn("n", F.row_number().over(placed)).where(F.col("n") <= each).orderBy("lang", "n").select("text").collect()
    model = Model([r.text for r in marks])
    among = model.kernel([r.text for r in marks])[0]
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def work():
        def step(part: pa.RecordBatch) -> list[pa.Array]:
            kernel, known = shared.value.kernel(part.column("text").to_pylist())
            return [pa.array(kernel.tolist(), pa.list_(pa.float32())), pa.array(known, pa.float64())]

        return step

    values = arrow_pass(chosen, "kernel array<float>, known double", work, keep=["doc_id", "print", "lang"]).toArrow()
    # In one order whatever the partitions, so that sums do not depend on them.
    values = values.sort_by([("lang", "ascending"), ("doc_id", "ascending"), ("print", "ascending")])
    kernel = values.column("kernel").combine_chunks().flatten().to_numpy().reshape(values.num_rows, -1)
    model.fit(kernel.astype(np.float64), values.column("lang").to_pylist(), among.astype(np.float64))
    model.floor = float(np.quantile(values.column("known").to_numpy(), UNLIKE)) / 2
    return model


def identify(docs: DataFrame, model: Model | None, names: tuple[str, ...] = ("lang_pred", "score"), keep: list[str] | None = None) -> DataFrame:
    """Adds the predicted language and its score to every row, and, given a third name, the
    share of its grams that are known; below ``model.floor`` it is like no learned language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        def step(part: pa.RecordBatch) -> list[pa.Array]:
            texts = part.column("text").to_pylist()
            none = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            found = none if shared.value is None else shared.value.predict(texts)
            return [pa.array(f, k) for f, k in zip(found, (pa.string(), pa.float64(), pa.float64()))][: len(names)]

        return step

    added = ", ".join(f"`{n}` {kind}" for n, kind in zip(names, ("string", "double", "double")))
    return arrow_pass(docs, added, work, keep)
