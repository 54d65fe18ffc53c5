"""Near-duplicate texts by a chosen-path set similarity join.

A text is the set of its word shingles, kept as 64-bit hashes; equal sets are one class from
the start. A class has a signature of ``COORDINATES`` minwise tokens. In each of several
independent trees a class walks down from the root: a node picks one coordinate, sometimes
two, by its own hash, and the class goes to the child named after its minwise token there.
The number of picks is 1 / threshold on average, so that a pair at the threshold keeps one
common path on average however deep the tree is, while unlike texts part at once. The depth
follows from the number of classes, the number of trees from the recall asked for.

Nodes of at most ``LEAF`` classes are compared exhaustively by their sketches; a leaf reports
a spanning forest of its likely pairs. Larger nodes, made of very many like texts, are linked
to a pivot. These pairs, about as many as there are texts, are confirmed on the full shingle
sets. Where a pair of a forest fails, or a large node still has several components, a second
round compares the full sets of the node's texts all with all, within tasks, and reports a
spanning forest of the links. Large nodes are dealt into blocks for that, of which those of
the most frequent component are not compared with each other; still larger ones meet further
pivots first, which makes that component larger. So no task gathers a large group and none emits all pairs of one.

Defined results: a text that is null or has no words has an empty set, is linked with
nothing and is its own component; a text with fewer words than a shingle is one shingle;
rows with equal texts are linked; a row without an id has no component, is linked with
nothing and is kept; texts of one id that is the smallest of both are linked. Other columns
are ignored by ``near_duplicates`` and kept by ``representatives``; an empty table gives no
rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, components, settled

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
COORDINATES = 128
#: The agreement of the signatures that the recall holds for, below the threshold: two
#: standard deviations of their estimate.
SPREAD = 0.07
#: A pair is likely if so much less than the threshold of its sketch agrees; about four
#: standard deviations of the estimate.
SLACK = 0.13
LEAF = 400
#: Classes up to which a node is compared in pairs of blocks without further pivots.
LARGE = 8000
#: Chance that unlike texts share a minwise token, for the depth of the trees.
UNLIKE = 0.03
#: Rounds of further pivots, at most, for nodes above that.
MORE_LEVELS = 10
#: Up to so many ids are broadcast to pick out the texts to confirm; more are joined.
BROADCAST_IDS = 200_000

_DRAWN = np.random.default_rng(20240607)
_TIMES = _DRAWN.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_AGAIN = _DRAWN.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without visible pattern."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles. Bytes lower-case A-Z only and split at
    the six ASCII blanks only."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(words, len(found))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(found) - size + 1, np.uint64)
        for i in range(size):
            sums = sums * np.uint64(0x9E3779B97F4A7C15) + scramble(hashes[i : len(found) - size + 1 + i])
    return np.unique(scramble(sums + np.uint64(size)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """16 bits of the least value of each of the coordinates' permutations."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 2048):
            part = _TIMES[:, None] * hashes[None, at : at + 2048]
            part ^= part >> np.uint64(32)
            part *= _AGAIN[:, None]
            np.minimum(least, part.min(axis=1), out=least)
    return (scramble(least) & np.uint64(0xFFFF)).astype("<u2")


def set_rows(docs: DataFrame, words: int) -> DataFrame:
    """Per row: doc_id, n_shingles, set_key (16 bytes) and signature."""

    def work():
        def step(part: pa.RecordBatch) -> list[pa.Array]:
            sizes, keys, marks = [], [], []
            for text in part.column("text").to_pylist():
                found = shingles(text, words)
                sizes.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                marks.append(signature(found).tobytes() if len(found) else None)
            return [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.binary())]

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return arrow_pass(rows, "n_shingles long, set_key binary, signature binary", work, keep=["doc_id"])


def children(nodes: np.ndarray, owners: np.ndarray, marks: np.ndarray, second: float) -> tuple[np.ndarray, np.ndarray]:
    """The next nodes of classes (``owners``: rows of ``marks``), one per coordinate the
    node picks: one always, a second one with chance ``second``."""
    drawn = scramble(nodes ^ np.uint64(0x5851F42D4C957F2D))
    first = (drawn % np.uint64(COORDINATES)).astype(np.int64)
    again = (scramble(drawn) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < second
    step = (scramble(drawn ^ np.uint64(0x14057B7EF767814F)) % np.uint64(COORDINATES - 1)).astype(np.int64) + 1
    picks = np.concatenate([first, ((first + step) % COORDINATES)[again]])
    nodes, owners = np.concatenate([nodes, nodes[again]]), np.concatenate([owners, owners[again]])
    tokens = marks[owners, picks].astype(np.uint64)
    with np.errstate(over="ignore"):
        names = scramble(nodes * np.uint64(0x2545F4914F6CDD1D) + ((picks.astype(np.uint64) << np.uint64(16)) | tokens))
    return names, owners


def plan_trees(classes: int, threshold: float, recall: float) -> tuple[int, int]:
    """Depth and number of trees for so many classes."""
    depth = max(1, math.ceil(math.log(max(2.0, 2.0 * classes)) / math.log(1 / UNLIKE)))
    alike, second = threshold - SPREAD, second_pick(threshold)
    apart = 0.0  # chance that such a pair shares no node at this depth
    for _ in range(depth):
        one = 1 - alike + alike * apart
        apart = (1 - second) * one + second * one * one
    return depth, max(1, math.ceil(math.log(1 - recall) / math.log(apart)))


def second_pick(threshold: float) -> float:
    """Chance that a node picks a second coordinate: a little more than would keep one
    common path of a pair at the threshold."""
    return min(1.0, 1 / (threshold - SPREAD / 2) - 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, COORDINATES)


def branch(rows: DataFrame, levels: int, threshold: float, trees: int) -> DataFrame:
    """(node, rep) from (rep, signature), ``levels`` down from the roots of ``trees``."""
    second = second_pick(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                marks = _matrix(part.column("signature"))
                nodes = np.repeat(scramble(np.arange(1, trees + 1, dtype=np.uint64)), len(marks))
                owners = np.tile(np.arange(len(marks)), trees)
                for _ in range(levels):
                    nodes, owners = children(nodes, owners, marks, second)
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(part.column("rep").to_numpy()[owners])], ["node", "rep"])

    return rows.mapInArrow(run, "node long, rep long")


def _groups(batches: Iterator[pa.RecordBatch], payload: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
    """(node, rep, component, payload) of each node, from batches sorted by node."""
    rest: list | None = None
    for batch in batches:
        part = [batch.column(c).to_numpy() for c in ("node", "rep", "component")] + [batch.column(payload).to_pylist()]
        if rest is not None:
            part = [np.concatenate([x, y]) for x, y in zip(rest[:3], part[:3])] + [rest[3] + part[3]]
        edges = [0, *(np.flatnonzero(np.diff(part[0])) + 1).tolist()]
        for x, y in zip(edges, edges[1:]):
            yield int(part[0][x]), part[1][x:y], part[2][x:y], part[3][x:y]
        rest = [p[edges[-1] :] for p in part]
    if rest is not None and len(rest[0]):
        yield int(rest[0][0]), rest[1], rest[2], rest[3]


def _forest(parts: np.ndarray, first: np.ndarray, second: np.ndarray, weight: np.ndarray) -> list[int]:
    """Pairs of a spanning forest over the components, heaviest first."""
    root = {int(p): int(p) for p in parts}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k in np.argsort(-weight, kind="stable").tolist():
        a, b = find(int(parts[first[k]])), find(int(parts[second[k]]))
        if a != b:
            root[a] = b
            kept.append(k)
    return kept


def _likely(reps: np.ndarray, parts: np.ndarray, marks: list[bytes], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs whose sketches, one byte per coordinate, agree in enough places."""
    sketches = (np.frombuffer(b"".join(marks), "<u2").reshape(-1, COORDINATES) & 0xFF).astype(np.uint8)
    needed = max(1, math.ceil(least * COORDINATES))
    firsts, seconds, agree = [], [], []
    for i in range(len(reps) - 1):
        same = np.count_nonzero(sketches[i + 1 :] == sketches[i], axis=1)
        good = np.flatnonzero(same >= needed)
        firsts.append(np.full(len(good), i))
        seconds.append(good + i + 1)
        agree.append(same[good])
    return np.concatenate(firsts), np.concatenate(seconds), np.concatenate(agree)


def _linked(reps: np.ndarray, parts: np.ndarray, sets: list[bytes], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs whose full sets are similar enough: shared shingles of all pairs at once, from
    the product of the texts' presence matrix with itself, in slices of its columns."""
    whole = [np.frombuffer(s, np.uint64) for s in sets]
    sizes = np.array([len(w) for w in whole], np.int64)
    _, column, times = np.unique(np.concatenate(whole), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(whole)), sizes)
    several = times[column] > 1
    number = np.cumsum(times > 1) - 1
    row, column = row[several], number[column[several]]
    shared = np.zeros((len(whole), len(whole)))
    for at in range(0, int((times > 1).sum()), 8192):
        here = (column >= at) & (column < at + 8192)
        present = np.zeros((len(whole), 8192), np.float32)
        present[row[here], column[here] - at] = 1
        shared += present @ present.T
    # Whole numbers, so that a pair on the threshold is not lost to rounding.
    shared = np.rint(shared).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - shared
    first, second = np.nonzero(np.triu(100 * shared >= round(100 * threshold) * union, 1))
    return first, second, shared[first, second] / np.maximum(union[first, second], 1)


def node_pairs(rows: DataFrame, payload: str, compare: Callable) -> DataFrame:
    """(node, a, b): a spanning forest of the pairs that ``compare`` finds in each node of
    (node, rep, component, payload), between components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int, int]] = []
        for node, reps, parts, loads in _groups(batches, payload):
            if len(reps) > 1 and not (parts == parts[0]).all():
                first, second, weight = compare(reps, parts, loads)
                apart = parts[first] != parts[second]
                first, second, weight = first[apart], second[apart], weight[apart]
                for k in _forest(parts, first, second, weight):
                    x, y = int(reps[first[k]]), int(reps[second[k]])
                    found.append((node, min(x, y), max(x, y)))
            if len(found) > 50_000:
                yield _pair_batch(found)
                found = []
        yield _pair_batch(found)

    rows = rows.select("node", "rep", "component", payload)
    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, "node long, a long, b long")


def _pair_batch(pairs: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in range(3)], ["node", "a", "b"])


def _keep_pairs(rows: DataFrame, good: Callable[[bytes, bytes], bool], left: str, right: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                mask = [good(x, y) for x, y in zip(part.column(left).to_pylist(), part.column(right).to_pylist())]
                yield part.select(["a", "b"]).filter(pa.array(mask, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(rep, hashes): the shingle sets of the texts of the ids (rep), and of no others."""
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text")).join(F.broadcast(ids) if few else ids, "rep")

    def work():
        return lambda part: [pa.array([shingles(t, words).tobytes() for t in part.column("text").to_pylist()], pa.binary())]

    return arrow_pass(texts, "hashes binary", work, keep=["rep"])


def confirm(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    rows = pairs.join(sets.select(F.col("rep").alias("a"), F.col("hashes").alias("left")), "a")
    rows = rows.join(sets.select(F.col("rep").alias("b"), F.col("hashes").alias("right")), "b")

    def good(left: bytes, right: bytes) -> bool:
        x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return len(x) > 0 and len(y) > 0 and 100 * shared >= round(100 * threshold) * (len(x) + len(y) - shared)

    return _keep_pairs(rows, good, "left", "right").distinct()


def _node_table(paths: DataFrame) -> DataFrame:
    """Nodes of at least two classes: size, smallest class and two checksums of the content."""
    return paths.groupBy("node").agg(
        F.count("*").alias("n"),
        F.min("rep").alias("pivot"),
        F.bit_xor(F.xxhash64("rep")).alias("sum1"),
        F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("sum2"),
    ).where("n > 1")


def _several(rows: DataFrame) -> DataFrame:
    """Size and most frequent component of the nodes that hold more than one."""
    parts = rows.groupBy("node", "component").agg(F.count("*").alias("m"))
    whole = parts.groupBy("node").agg(F.sum("m").alias("n"), F.max(F.struct("m", "component")).alias("main"), F.count("*").alias("parts"))
    return whole.where("parts > 1").select("node", "n", F.col("main.component").alias("main"), F.col("main.m").alias("m"))


def _blocks(rows: DataFrame) -> DataFrame:
    """Large nodes (node, rep, component) as nodes of at most about ``LEAF`` rows, which
    together hold every pair of different components."""
    done = rows.join(_several(rows), "node")
    # Blocks of the most frequent component, and of all others, half a leaf each.
    half = LEAF // 2
    mine = F.col("component") == F.col("main")
    main_blocks = F.ceil(F.col("m") / half).cast("int")
    other_blocks = F.greatest(F.ceil((F.col("n") - F.col("m")) / half), F.lit(1)).cast("int")
    spread = F.xxhash64("rep", F.lit(2))
    rows = done.withColumn("own", F.when(mine, other_blocks + F.pmod(spread, main_blocks)).otherwise(F.pmod(spread, other_blocks)).cast("int"))
    # A row of the main component meets the others' blocks, any other row all blocks.
    last = F.when(mine, other_blocks).otherwise(other_blocks + main_blocks) - 1
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), last)))
    name = F.xxhash64("node", F.least("own", "with"), F.greatest("own", "with"))
    return rows.select(name.alias("node"), "rep", "component")


def _joined(crowds: DataFrame, found: DataFrame) -> DataFrame:
    return settled(crowds.select("node", "rep").join(found, "rep", "left").select("node", "rep", F.coalesce("component", "rep").alias("component")))


def _more_pivots(crowds: DataFrame, first: DataFrame, found: DataFrame, sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, rep, component), links and components after rounds in which the rows outside
    a large node's most frequent component meet a further pivot of that component."""
    for turn in range(MORE_LEVELS):
        over = settled(_several(crowds).where(F.col("n") > LARGE))
        if over.isEmpty():
            break
        rows = crowds.join(over.select("node", "main"), "node")
        drawn = rows.where("component = main").groupBy("node").agg(F.min_by("rep", F.xxhash64("rep", F.lit(3 + turn))).alias("pivot"))
        tries = rows.where("component <> main").join(drawn, "node")
        tries = tries.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
        tries = settled(tries)
        good = settled(confirm(tries, sets, threshold))
        # The blocks compare what is left; rounds that join little don't pay.
        if 4 * good.count() < tries.count():
            break
        first = settled(first.union(good))
        found = settled(components(first)).withColumnRenamed("id", "rep")
        crowds = _joined(crowds, found)
    return crowds, first, found


def links(docs: DataFrame, classes: DataFrame, words: int, threshold: float, recall: float) -> DataFrame:
    """Confirmed links (a, b) that connect the classes (rep, signature)."""
    least = threshold - SLACK
    depth, trees = plan_trees(classes.count(), threshold, recall)
    paths = settled(branch(classes, depth, threshold, trees))
    nodes = settled(_node_table(paths))
    # Nodes with the same content, in whatever tree, are compared once.
    small = nodes.where(F.col("n") <= LEAF).groupBy("n", "sum1", "sum2").agg(F.min("node").alias("node"))
    large = nodes.where(F.col("n") > LEAF).groupBy("n", "sum1", "sum2").agg(F.min("node").alias("node"), F.min("pivot").alias("pivot"))
    members = settled(paths.join(small.select("node"), "node"))
    sketched = members.join(classes, "rep").withColumn("component", F.col("rep"))
    forest = settled(node_pairs(sketched, "signature", lambda reps, parts, marks: _likely(reps, parts, marks, least)))
    crowds = settled(paths.join(large.select("node", "pivot"), "node"))
    stars = crowds.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    stars = stars.join(classes.select(F.col("rep").alias("a"), F.col("signature").alias("left")), "a")
    stars = stars.join(classes.select(F.col("rep").alias("b"), F.col("signature").alias("right")), "b")

    def alike(left: bytes, right: bytes) -> bool:
        x, y = np.frombuffer(left, "<u2"), np.frombuffer(right, "<u2")
        return np.count_nonzero(x == y) >= least * COORDINATES

    pairs = settled(forest.select("a", "b").union(_keep_pairs(stars, alike, "left", "right")).distinct())
    ids = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(crowds.select("rep")).distinct()
    sets = settled(full_sets(docs, settled(ids), words))
    first = settled(confirm(pairs, sets, threshold))
    found = settled(components(first)).withColumnRenamed("id", "rep")
    crowds, first, found = _more_pivots(_joined(crowds, found), first, found, sets, threshold)
    component = F.coalesce("component", "rep").alias("component")

    # Nodes where a likely pair failed and its ends are not connected otherwise.
    ends = found.select(F.col("rep").alias("a"), F.col("component").alias("of_a")), found.select(F.col("rep").alias("b"), F.col("component").alias("of_b"))
    failed = forest.join(ends[0], "a", "left").join(ends[1], "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
    failed = failed.select("node").distinct()
    again = members.join(failed, "node").join(found, "rep", "left").select("node", "rep", component)
    # Texts without a likely partner have no full set here, and need none.
    rows = again.union(_blocks(crowds)).join(sets, "rep")
    more = node_pairs(rows, "hashes", lambda reps, parts, loads: _linked(reps, parts, loads, threshold))
    return first.union(more.select("a", "b").distinct())


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    rows = settled(set_rows(docs, words))
    named = rows.where("doc_id is not null and n_shingles > 0")
    classes = settled(named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")))
    whole = components(links(docs, classes.select("rep", "signature"), words, threshold, recall))
    reps = classes.select("set_key", "rep").join(whole.withColumnRenamed("id", "rep"), "rep", "left")
    reps = reps.select("set_key", F.coalesce("component", "rep").alias("found"))
    out = rows.drop("signature").join(reps, "set_key", "left")
    alone = F.col("n_shingles") == 0
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(alone, F.col("doc_id")).otherwise(F.col("found")).cast("long")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def representatives(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The documents that are kept, whole. Of rows with one id, one stays."""
    found = settled(near_duplicates(docs, words, threshold, recall))
    # An id is out if a text of it has another one's component, and no text its own.
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("times"))
    out = ids.where(~F.col("kept")).select(F.col("doc_id").alias("gone"))
    rest = docs.join(out, docs["doc_id"].cast("long") == F.col("gone"), "left_anti")
    repeated = settled(ids.where("kept and times > 1").select(F.col("doc_id").alias("again")))
    if repeated.isEmpty():
        return rest
    same = rest["doc_id"].cast("long") == F.col("again")
    return rest.join(repeated, same, "left_anti").unionByName(rest.join(repeated, same, "left_semi").dropDuplicates(["doc_id"]))
