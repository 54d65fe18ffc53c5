"""Ranked lexical search by a dual tree over items and documents.

A document is a vector over the items' terms, its coordinates what a term adds to a score per
unit of the term's weight; an item is a vector of its terms' weights times their occurrences,
so a score is an inner product of whole numbers. Both sides are trees whose nodes hold the
largest value of each coordinate below them: the product of two nodes' maxima bounds every
score between them. A pair of nodes whose bound is below the weakest k-th score of the items
in it is left with everything below it; at the leaves scores are exact. Documents are dealt
by Spark: each task grows trees over batches of its documents, keeps the items' best over all
of them and passes on no more than k rows an item, which a window then ranks. The k-th scores
within a bounded sample of the documents are a lower bound to begin with; they leave out only
documents that k others beat.

Items are answered in blocks of about ``ITEM_BYTES`` of text, one pass over the documents each,
so that what is sent to the executors is bounded. Statistics are those of all documents.

Defined results: a null or blank text has no terms; such a document counts nowhere and such
an item has no rows. Every row is a document of its own, repeated ones too; a null doc_id
comes after the others among equal scores. Equal rows of an item are one item, rows of one id
with different texts are ranked each by itself. Empty tables give no rows; other columns are
not looked at. Texts are taken whole, a score stays exact for items of up to 300,000 terms
times distinct weights (their sum below 2 to the power 53), which is checked.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Text of the items that one pass over the documents answers.
ITEM_BYTES = 256 * 1024
#: Documents of the sample whose scores give the first lower bounds.
SAMPLE = 8192
#: Cells of a task's matrix of documents and terms.
CELLS = 1 << 23
LEAF_ITEMS = 8
LEAF_DOCS = 32
#: Fixed values of the scoring rule.
SATURATION, LENGTH_PART, SCALE = 8, 75, 1_000_000_000

_KEEP = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and everything beyond ASCII; only A-Z in lower case."""
    return text.encode().translate(_KEEP).split() if text else []


class Node:
    """Rows of a matrix with the largest value of each column; a leaf has no children."""

    __slots__ = ("rows", "most", "children", "columns")

    def __init__(self, rows: np.ndarray, most: np.ndarray):
        self.rows, self.most, self.children, self.columns = rows, most, (), None


def grow(matrix: np.ndarray, weights: np.ndarray, leaf: int) -> Node:
    """A tree whose splits part the rows with and without a heavy, often present column."""
    present = (matrix > 0).astype(np.float32)
    root = Node(np.arange(len(matrix)), matrix.max(axis=0).astype(np.float64))
    todo = [root]
    while todo:
        node = todo.pop()
        rows = node.rows
        if len(rows) <= leaf:
            node.columns = np.flatnonzero(node.most)
            continue
        share = present[rows].mean(axis=0)
        gain = weights * node.most * np.minimum(share, 1 - share)
        best = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[best] > 0:
            inside = present[rows, best] > 0
        else:  # the same columns everywhere: by the heaviest one's value
            heavy = int((weights * node.most).argmax()) if len(weights) else 0
            order = np.argsort(matrix[rows, heavy], kind="stable") if len(weights) else np.arange(len(rows))
            inside = np.zeros(len(rows), bool)
            inside[order[len(rows) // 2 :]] = True
        node.children = tuple(Node(part, matrix[part].max(axis=0).astype(np.float64)) for part in (rows[inside], rows[~inside]))
        todo.extend(node.children)
    return root


class Search:
    """The items of a block and the statistics; kept by each task while it reads documents."""

    def __init__(self, texts: list[str | None], k: int):
        self.k = k
        counted = [Counter(terms(t)) for t in texts]
        self.vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counted)))} if counted else {}
        self.counted = [{self.vocabulary[t]: n for t, n in c.items()} for c in counted]
        self.documents = self.length = 0
        self.floor = np.zeros(len(texts))

    def weigh(self, documents: int, length: int, frequency: dict[int, int]) -> None:
        self.documents, self.length = documents, length
        held = np.array([frequency.get(i, 0) for i in range(len(self.vocabulary))], np.float64)
        self.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * h + 1))) for h in held.tolist()], np.float64)
        self.items = np.zeros((len(self.counted), len(self.vocabulary)))
        for i, counts in enumerate(self.counted):
            for t, n in counts.items():
                self.items[i, t] = n * self.weights[t]
        if len(self.items) and self.items.sum(axis=1).max() * (SCALE / 1000) >= 2**53:
            raise ValueError("an item's weights are too large for exact scores")
        self.tree = grow(self.items, np.ones(len(self.vocabulary)), LEAF_ITEMS)
        for_leaf = [self.tree]
        while for_leaf:
            node = for_leaf.pop()
            if node.children:
                for_leaf.extend(node.children)
            else:
                node.columns = np.flatnonzero(node.most)

    def impacts(self, found: list[bytes]) -> list[tuple[int, int]]:
        """(term, what it adds per unit of weight) of a document."""
        m = 100 - LENGTH_PART + (LENGTH_PART * len(found) * self.documents) // self.length
        number = self.vocabulary.get
        counts = Counter(found)
        return [(t, (SCALE * n) // (1000 * n + SATURATION * m)) for w, n in counts.items() if (t := number(w)) is not None]


class Best:
    """The best documents of every item so far, and the search that finds them."""

    def __init__(self, search: Search):
        self.search = search
        self.found: list[list[tuple]] = [[] for _ in search.counted]
        self.weakest = search.floor.copy()

    def add(self, ids: list, vectors: list[list[tuple[int, int]]]) -> None:
        matrix = np.zeros((len(ids), len(self.search.vocabulary)), np.float32)
        for row, vector in enumerate(vectors):
            for t, value in vector:
                matrix[row, t] = value
        root = grow(matrix, self.search.weights, LEAF_DOCS)
        self._visit(self.search.tree, root, self.search.tree.most @ root.most, matrix, ids)

    def _visit(self, item: Node, doc: Node, bound: float, matrix: np.ndarray, ids: list) -> None:
        # Equal scores go by the smaller id, so only a smaller bound leaves a pair out.
        if bound <= 0 or bound < self.weakest[item.rows].min():
            return
        if not item.children and not doc.children:
            self._leaves(item, doc, matrix, ids)
            return
        pairs = [(x.most @ y.most, a, b) for a, x in enumerate(item.children or (item,)) for b, y in enumerate(doc.children or (doc,))]
        for value, a, b in sorted(pairs, reverse=True):
            self._visit((item.children or (item,))[a], (doc.children or (doc,))[b], value, matrix, ids)

    def _leaves(self, item: Node, doc: Node, matrix: np.ndarray, ids: list) -> None:
        columns = item.columns
        scores = matrix[np.ix_(doc.rows, columns)].astype(np.float64) @ self.search.items[np.ix_(item.rows, columns)].T
        for at, i in enumerate(item.rows.tolist()):
            column = scores[:, at]
            picked = np.flatnonzero(column >= max(self.weakest[i], 1))
            if len(picked):
                best = self.found[i]
                best.extend((-int(column[p]), ids[doc.rows[p]] is None, ids[doc.rows[p]]) for p in picked.tolist())
                best.sort()
                del best[self.search.k :]
                if len(best) == self.search.k:
                    self.weakest[i] = max(self.weakest[i], -best[-1][0])


def _statistics(docs: DataFrame, search: Search) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, their terms, and how many documents hold each term of the items."""
    shared = docs.sparkSession.sparkContext.broadcast(search.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, documents, length = shared.value, Counter(), 0, 0
        for batch in batches:
            for text in batch.column(0):
                found = terms(text.as_py())
                documents += bool(found)
                length += len(found)
                held.update(number.keys() & set(found))
        rows = [(-1, documents), (-2, length), *((number[w], n) for w, n in held.items())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["term", "n"])

    sums = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in sums.collect()}
    return found.pop(-1, 0), found.pop(-2, 0), found


def _candidates(docs: DataFrame, search: Search) -> DataFrame:
    """(item, doc_id, score): of each task's documents the best of every item."""
    shared = docs.sparkSession.sparkContext.broadcast(search)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = shared.value
        best, ids, vectors = Best(search), [], []
        rows = max(16, min(4096, CELLS // max(1, len(search.vocabulary))))
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = terms(text.as_py())
                vector = search.impacts(found) if found else ()
                if vector:
                    ids.append(doc)
                    vectors.append(vector)
                if len(ids) == rows:
                    best.add(ids, vectors)
                    ids, vectors = [], []
        if ids:
            best.add(ids, vectors)
        out = [(i, doc, -score) for i, found in enumerate(best.found) for score, _, doc in found]
        kinds = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kinds[c]) for c in range(3)], ["item", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "item int, doc_id long, score long")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(items: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of each item with a score above 0."""
    spark = docs.sparkSession
    asked = items.select("item_id", "text").where("text is not null").distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // ITEM_BYTES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    id_type = items.schema["item_id"].dataType
    parts = []
    for block in range(blocks):
        rows = asked.where(F.col("block") == block).orderBy("item_id", "text").collect()
        block_search = Search([r["text"] for r in rows], k)
        documents, length, frequency = _statistics(docs, block_search) if block_search.vocabulary else (0, 0, {})
        if not documents:
            continue
        block_search.weigh(documents, length, frequency)
        if documents > SAMPLE:
            sampled = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(documents // SAMPLE)) == 0)
            for r in _ranked(_candidates(sampled, block_search), k).where(F.col("rank") == k).collect():
                block_search.floor[r["item"]] = r["score"]
        found = _ranked(_candidates(docs, block_search), k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item int, item_id " + id_type.simpleString())
        parts.append(found.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not parts:
        return docs.select(F.lit(None).cast(id_type).alias("item_id"), F.lit(0).alias("rank"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    return reduce(DataFrame.unionAll, parts)


_WORDS = (
    r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
ORACLE = f"""
with i as (select item_id, text, row_number() over () as item from (select distinct item_id, text from benchmark where text is not null)),
q as (select item, term, count(*) as times from (select item, unnest({_WORDS}) as term from i) group by item, term),
d as (select row_number() over () as r, doc_id, {_WORDS} as words from documents where text is not null),
s as (select count(*) as docs, sum(len(words))::bigint as total from d where len(words) > 0),
t as (select r, term, count(*) as tf from (select r, unnest(words) as term from d) where term in (select term from q) group by r, term),
f as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w from t, s group by term, docs),
m as (select r, doc_id, (100 - 75 + (75 * len(words) * docs) // total)::bigint as m from d, s where len(words) > 0),
p as (select item, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from q join t using (term) join f using (term) join m using (r) group by item, doc_id, r)
select item_id, rank, doc_id, score from (
  select item_id, doc_id, score, row_number() over (partition by item order by score desc, doc_id nulls last)::int as rank
  from p join i using (item) where score > 0) where rank <= 10
"""
