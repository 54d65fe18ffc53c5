"""Spelling variants: words one code point apart, found in a trie of letter-group counts.

Letters fall into ``GROUPS`` groups by their frequency; a word becomes the vector of how many
of its letters each group has. One inserted, deleted or replaced code point adds at most one
to one count and takes at most one from another, so near words differ by a surplus and a
deficit of one each at most. Words are arranged as a trie by successive counts; a depth-first
search goes down with a set of words and each one's remaining budget, and spends it where a
child's count is one more or one less. What arrives at a leaf is verified letter by letter.

The trie is spread over tasks: nodes with more than ``LEAF`` words are open, every other child
of an open node is a bucket that one task holds. Only open nodes go to every task; a bucket
may hold W / ``OPEN`` of W words where that is more than ``LEAF``, so there are never more than
``OPEN`` open nodes a level. A word is sent to the buckets behind its own, in the order of
their counts, that its budget reaches, so every pair meets once, and a bucket's tasks emit
the number of near words and the best one per word, not the pairs. Forms are followed to
roots by pointer doubling; a form occurs at least twice as often as the word, so the number
of rounds is known from the largest number of occurrences.

Occurrences are counted inside the tasks first. Words of one vector are compared with each
other in one task; there is no other group.

Defined results: null and empty texts and texts without a run have no words; a null doc_id
counts as an empty text where the checksum is taken; repeated rows count again; ties of the
form go to the smaller word. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled

GROUPS = 16
#: Words a bucket of the trie holds.
LEAF = 2048
#: Open nodes a level has at most.
OPEN = 16384
#: Below this number of words a node's words are compared with what arrives there at once.
SMALL = 12
#: Words counted in a task before they are passed on; queries searched together; pairs verified together.
COUNTED, QUERIES, PAIRS = 400_000, 20_000, 1 << 16
#: Code points compared side by side; longer words one by one.
WIDTH = 40

# A run's letters in the one-byte code of U+0000 to U+00FF, only A-Z in lower case; the rest is blank.
_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 0x20 for c in range(256))


def runs(text: str | None) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, one byte a code point, A-Z in lower case."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split() if text else []


def spoiled(doc: str, found: Counter, drop_every: int) -> Iterator[tuple[bytes, int]]:
    """(word, occurrences) of a document's runs after the rule that deletes a code point."""
    seed = zlib.crc32(doc.encode() + b":")
    for run, n in found.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
        if h % drop_every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def count_words(docs: DataFrame, shortest: int, least: int, drop_every: int) -> DataFrame:
    """``word, n`` of all words with so many code points and occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in counts]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in spoiled(doc, Counter(runs(text.as_py())), drop_every):
                    if len(word) >= shortest:
                        counts[word] = counts.get(word, 0) + n
                if len(counts) > COUNTED:
                    yield flush()
                    counts = {}
        yield flush()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def letter_groups(words: DataFrame) -> bytes:
    """The group of every letter: the letters by falling frequency, dealt round."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").count().collect()
    table = bytearray(256)
    for rank, row in enumerate(sorted(letters, key=lambda r: (-r["count"], r["letter"]))):
        table[ord(row["letter"])] = rank % GROUPS
    return bytes(table)


def vectors(words: list[bytes], groups: bytes) -> np.ndarray:
    """Counts of letter groups, one row a word; counts beyond 255 are 255."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer(groups, np.uint8)[np.frombuffer(b"".join(words), np.uint8)]
    place = np.repeat(np.arange(len(words)), sizes) * GROUPS + letters
    return np.minimum(np.bincount(place, minlength=len(words) * GROUPS), 255).reshape(-1, GROUPS).astype(np.int16)


def buckets(vector: bytes, opened: frozenset[bytes]) -> tuple[bytes, list[bytes]]:
    """A word's own bucket, and those behind it that differ by a surplus and a deficit of one at most."""
    own = vector[:1]
    while own in opened:
        own = vector[: len(own) + 1]
    found, todo = [], [(b"", True, True)]
    while todo:
        node, more, less = todo.pop()
        if node and node not in opened:
            if node > own:
                found.append(node)
            continue
        # Behind a node before the own bucket nothing is behind it.
        if node < own[: len(node)]:
            continue
        here = vector[len(node)]
        todo.append((node + bytes((here,)), more, less))
        if more and here < 255:
            todo.append((node + bytes((here + 1,)), False, less))
        if less and here:
            todo.append((node + bytes((here - 1,)), more, False))
    return own, found


def near(a: bytes, b: bytes) -> bool:
    """Whether exactly one inserted, deleted or replaced letter parts two words."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


class Table:
    """Words beside each other, from the left and from the right, for comparisons in bulk."""

    def __init__(self, words: list[bytes], groups: bytes):
        self.words = words
        self.vectors = vectors(words, groups)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        short = [w if len(w) <= WIDTH else b"" for w in words]
        # Unequal fillings, so that no two words agree beyond their ends unless both end there.
        self.left = np.frombuffer(b"".join(w.ljust(WIDTH, b"\0") for w in short), np.uint8).reshape(-1, WIDTH)
        self.right = np.frombuffer(b"".join(w.rjust(WIDTH, b"\0") for w in short), np.uint8).reshape(-1, WIDTH)


def verified(x: Table, xs: np.ndarray, y: Table, ys: np.ndarray) -> np.ndarray:
    """Which of the pairs (xs[i], ys[i]) are near."""
    a, b = x.sizes[xs], y.sizes[ys]
    differ = x.left[xs] != y.left[ys]
    equal_size = (a == b) & (differ.sum(axis=1) == 1)
    head = np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)
    turned = (x.right[xs] != y.right[ys])[:, ::-1]
    tail = np.where(turned.any(axis=1), turned.argmax(axis=1), WIDTH)
    out = equal_size | ((np.abs(a - b) == 1) & (head + tail >= np.minimum(a, b)))
    for i in np.flatnonzero((a > WIDTH) | (b > WIDTH)).tolist():
        out[i] = near(x.words[xs[i]], y.words[ys[i]])
    return out


def search(trie: Table, asked: Table, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs (word of the trie, asked word); with ``own`` both are the same words, each pair once.

    The trie is its words sorted by their vectors: a node is a range that shares the counts so far.
    """
    order = np.lexsort(trie.vectors.T[::-1])
    rows = trie.vectors[order]
    todo = [(0, len(order), 0, np.arange(len(asked.words)), np.ones(len(asked.words), bool), np.ones(len(asked.words), bool))]
    while todo:
        low, high, level, at, more, less = todo.pop()
        if level == GROUPS or high - low <= SMALL:
            step = max(1, PAIRS // (high - low))
            for first in range(0, len(at), step):
                part = at[first : first + step]
                x, y = np.repeat(order[low:high], len(part)), np.tile(part, high - low)
                if own:
                    x, y = x[x < y], y[x < y]
                gap = trie.vectors[x] - asked.vectors[y]
                fits = (np.maximum(gap, 0).sum(axis=1) <= 1) & (np.maximum(-gap, 0).sum(axis=1) <= 1)
                x, y = x[fits], y[fits]
                good = verified(trie, x, asked, y)
                yield x[good], y[good]
            continue
        counts = rows[low:high, level]
        starts = np.flatnonzero(np.diff(counts, prepend=-1))
        ends = np.append(starts[1:], high - low)
        wanted = asked.vectors[at, level]
        for start, end in zip(starts.tolist(), ends.tolist()):
            gap = counts[start] - wanted
            go = (gap == 0) | ((gap == 1) & more) | ((gap == -1) & less)
            if go.any():
                todo.append((low + start, low + end, level + 1, at[go], (more & (gap != 1))[go], (less & (gap != -1))[go]))


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best`` of words that have near words; best: (-n, word) of the best of them."""
    spark = words.sparkSession
    groups = letter_groups(words)
    total = words.count()
    leaf = max(LEAF, -(-total // OPEN))

    def with_vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = vectors([w.encode("latin-1") for w in batch.column(0).to_pylist()], groups).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary())], ["vector"])

    prefixes = words.select("word").mapInArrow(with_vector, "vector binary").select(
        F.explode(F.transform(F.sequence(F.lit(1), F.lit(GROUPS - 1)), lambda d: F.substring("vector", F.lit(1), d))).alias("node")
    )
    crowded = prefixes.groupBy("node").count().where(F.col("count") > leaf).select("node").collect()
    opened = spark.sparkContext.broadcast(frozenset(bytes(r["node"]) for r in crowded))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "asks", "word", "n"]
        for batch in batches:
            texts = batch.column(0).to_pylist()
            out = ([], [], [], [])
            for word, n, row in zip(texts, batch.column(1).to_pylist(), vectors([w.encode("latin-1") for w in texts], groups).astype(np.uint8)):
                own, others = buckets(row.tobytes(), opened.value)
                for i, bucket in enumerate([own, *others]):
                    for column, value in zip(out, (bucket, i > 0, word, n)):
                        column.append(value)
            kinds = (pa.binary(), pa.bool_(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, home, trie, asked = None, [], None, []
        best: dict[str, list] = {}

        def note(word: str, other: str, n: int) -> None:
            entry = best.setdefault(word, [0, 1, ""])
            entry[0] += 1
            if (-n, other) < (entry[1], entry[2]) or entry[0] == 1:
                entry[1:] = [-n, other]

        def pairs(asked: list, own: bool) -> None:
            other = trie if own else Table([w.encode("latin-1") for w, _ in asked], groups)
            for xs, ys in search(trie, other, own):
                for x, y in zip(xs.tolist(), ys.tolist()):
                    (a, n), (b, m) = home[x], asked[y]
                    note(a, b, m)
                    note(b, a, n)

        def flush(force: bool) -> Iterator[pa.RecordBatch]:
            nonlocal asked, trie
            if home and trie is None:
                trie = Table([w.encode("latin-1") for w, _ in home], groups)
                pairs(home, True)
            if home and asked:
                pairs(asked, False)
            asked = []
            if best and (force or len(best) > COUNTED):
                columns = [list(best), *(list(c) for c in zip(*best.values()))]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "n_near", "less", "form"])
                best.clear()

        for batch in batches:
            for key, asks, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if key != bucket:
                    yield from flush(False)
                    bucket, home, trie = key, [], None
                if asks:
                    if home:  # else nothing lives here
                        asked.append((word, n))
                        if len(asked) == QUERIES:
                            yield from flush(False)
                else:
                    home.append((word, n))
        yield from flush(True)

    routed = words.select("word", "n").mapInArrow(route, "bucket binary, asks boolean, word string, n long")
    routed = routed.repartition("bucket").sortWithinPartitions("bucket", "asks")
    found = routed.mapInArrow(meet, "word string, n_near long, less long, form string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("best"))


def variants(docs: DataFrame, shortest: int = 5, least: int = 3, drop_every: int = 97, ratio: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word with ``least`` occurrences.

    A word's form is its most frequent near word if that occurs ``ratio`` times as often.
    """
    words = settled(count_words(docs, shortest, least, drop_every))
    near = near_words(words)
    listed = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    listed = listed.withColumn("form_n", F.when(F.col("form_n") >= ratio * F.col("n"), F.col("form_n")))
    listed = listed.select("word", F.when(F.col("form_n").isNotNull(), F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
    listed = settled(listed)
    # Along a chain of forms n grows by the ratio: that many doublings reach its end.
    most = listed.agg(F.max("n").alias("n")).first()["n"] or 1
    chain, steps = 0, 1
    while least * ratio ** (chain + 1) <= most:
        chain += 1
    links = listed.where("form is not null").select("word", F.col("form").alias("root"))
    while steps < chain:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        links = settled(links.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")))
        steps *= 2
    roots = listed.join(links, "word", "left")
    return roots.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# Near words share a word with a gap in one place: the deleted letter, or the replaced one.
ORACLE = r"""
with recursive bits as (
  select i, i::bigint as c, 0 as n from range(256) r(i)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n + 1 from bits where n < 8),
steps as (select list(c order by i) as step from bits where n = 8),
u as (
  select coalesce(doc_id::varchar, '') as doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) as run from documents),
g as (select doc, run, count(*) as times from u group by doc, run),
h as (
  select run, times, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(doc || ':' || run)), '..'), lambda x: ('0x' || x)::bigint)),
    lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) as h from g, steps),
w as (
  select case when h % 97 = 0 then substring(run, 1, (h % length(run))::bigint) || substring(run, (h % length(run))::bigint + 2) else run end as word, sum(times)::bigint as n from h group by 1),
v as (select word, n from w where length(word) >= 5 and n >= 3),
k as (
  select word, n, unnest(list_transform(range(1, length(word) + 1), lambda i: substring(word, 1, i - 1) || '*' || substring(word, i + 1))) as key, true as own from v
  union all select word, n, unnest(list_transform(range(1, length(word) + 2), lambda i: substring(word, 1, i - 1) || '*' || substring(word, i))) as key, false from v),
p as (select distinct a.word, b.word as other, b.n from k a join k b on a.key = b.key and a.word <> b.word and (a.own or b.own)),
f as (select word, count(*) as n_near, first(other order by n desc, other) as other, max(n) as other_n from p group by word),
o as (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when other_n >= 2 * n then other end as form, case when other_n >= 2 * n then other_n end as form_n
  from v left join f using (word)),
c as (select word, word as at from o union all select c.word, form from c join o on o.word = c.at where form is not null),
r as (select c.word, c.at as root from c join o on o.word = c.at where o.form is null)
select word, form, root, n, n_near, form_n from o join r using (word)
"""
