"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learned on a bounded sample so that the signs of the rotated, centred vectors
are balanced bits with little loss. The bits are cut into substrings, each the key of a
table; vectors that share a key (and a label) are candidates. The substrings' length follows
the number of vectors; their number, from several rotations, is measured on pairs at the
threshold, made of the sample, for the recall asked for. Candidates are decided on the original vectors in double precision.

Very many like vectors are not compared pair by pair. Equal vectors are one point. In dense
table cells points join a pivot within half the threshold's angle; any two points of such a
cluster are then linked, by the triangle inequality of angles. Two clusters are compared by
their pivots first, and only if the radii leave the answer open, point by point.

Defined results: vectors without label or id, null, zero, of another length than most, or
with null or non-finite components link with nothing and are their own component; rows with
one id are one vector; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, components, settled
from .vectors import matrix, one_per_id, sample

THRESHOLD = 0.93
RECALL = 0.98
ROUNDS = 30
#: Points in a cell from which on it is dense.
DENSE = 16
#: Pairs of a kind that the tables are planned on, and rotations that their length is.
PAIRS, FIRST = 4096, 2
#: Room for rounding in angles, in radians.
ROOM = 1e-7


def learn_rotation(centred: np.ndarray, axes: np.ndarray, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """A matrix from centred vectors to bits; random and not learned with 0 rounds."""
    reduced, bits = centred @ axes, axes.shape[1]
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    for _ in range(rounds):
        signs = np.where(reduced @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(reduced.T @ signs)
        rotation = left @ right
    return axes @ rotation


def threshold_pairs(unit: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Kinds of pairs of unit vectors at the threshold: sampled vectors with partners in any
    direction, with partners along differences of sampled vectors, and the sample's own
    pairs next above the threshold."""
    rng = np.random.default_rng(7)
    first = unit[rng.integers(0, len(unit), PAIRS)]
    along = unit[rng.integers(0, len(unit), PAIRS)] - unit[rng.integers(0, len(unit), PAIRS)]
    kinds = []
    for step in (rng.standard_normal(first.shape), along):
        step = step - np.einsum("ij,ij->i", step, first)[:, None] * first
        size = np.linalg.norm(step, axis=1)
        some = size > 1e-6
        if some.any():
            x = first[some]
            kinds.append((x, threshold * x + math.sqrt(1 - threshold**2) * step[some] / size[some, None]))
    own = np.zeros((3, 0))
    for at in range(0, len(unit), 1024):
        cosine = unit[at : at + 1024] @ unit.T
        i, j = np.nonzero(cosine >= threshold)
        i, j, c = (v[j > i + at] for v in (i, j, cosine[i, j]))
        own = np.concatenate([own, [i + at, j, c]], axis=1)
        own = own[:, np.argsort(own[2], kind="stable")[:PAIRS]]
    if own.shape[1]:
        kinds.append((unit[own[0].astype(int)], unit[own[1].astype(int)]))
    return kinds


def _signs(unit: np.ndarray, mean: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    return (unit - mean) @ rotation >= 0


def plan_tables(vectors: np.ndarray, points: int, threshold: float, recall: float) -> tuple[np.ndarray, list[np.ndarray], int, int, int]:
    """Mean, rotations, substring length, number of tables, and the most bits that a pair at
    the threshold differs in.

    All is measured on pairs at the threshold, in the bits of the centred code: centring
    widens a pair's angle the more, the closer it is to the mean. The length is the one of
    least work up to the one where a cell holds a few unlike points; tables are added until
    the share ``recall`` of every kind of pairs shares a cell. Length 0, one cell for all
    points, is exact; it is taken where tables would be more work than that.
    """
    unit = scaled(vectors)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    mean = unit.mean(0)
    centred = unit - mean
    bits = min(62, unit.shape[1])
    _, axes = np.linalg.eigh(centred.T @ centred + 1e-9 * np.eye(centred.shape[1]))
    axes = axes[:, ::-1][:, :bits]
    rotations = [learn_rotation(centred, axes, seed) for seed in range(FIRST)]
    kinds = threshold_pairs(unit, threshold)
    rng = np.random.default_rng(8)
    # Two different vectors each: one paired with itself would agree in every bit.
    one = rng.integers(0, len(unit), PAIRS)
    other = (one + rng.integers(1, max(2, len(unit)), PAIRS)) % len(unit)
    unlike = unit[one], unit[other]

    def agreeing(pair: tuple[np.ndarray, np.ndarray], rotation: np.ndarray) -> np.ndarray:
        return _signs(pair[0], mean, rotation) == _signs(pair[1], mean, rotation)

    rates = [np.mean([agreeing(pair, r).mean(1) for r in rotations], axis=0) for pair in (*kinds, unlike)]
    work = {0: 1 + points / 2}
    for length in range(1, min(bits, 26, max(6, math.ceil(math.log2(max(2, points / 4))))) + 1):
        hit = min(1 - 1e-9, *((rate**length).mean() for rate in rates[:-1]))
        # Rows of the tables, and pairs of unlike points.
        if hit > 1e-9:
            work[length] = math.log(1 - recall) / math.log(1 - hit) * (1 + points / 2 * (rates[-1] ** length).mean())
    length = min(work, key=work.get)
    if not length:
        return mean, rotations[:1], 0, 1, bits
    each, tables = bits // length, 0
    missed = [np.ones(len(x), bool) for x, _ in kinds]
    most = work[0]
    planned = work[length] / (1 + points / 2 * (rates[-1] ** length).mean()) / each
    while any(m.sum() > (1 - recall) * len(m) for m in missed):
        if tables > most:
            return mean, rotations[:1], 0, 1, bits
        number = tables // each
        if number == len(rotations):
            # Learned ones can be alike; beyond the expected number they are random.
            rotations.append(learn_rotation(centred, axes, number, ROUNDS if number <= planned else 0))
        same = [agreeing(pair, rotations[number]) for pair in kinds]
        for s in range(each):
            for m, found in zip(missed, same):
                m &= ~found[:, s * length : (s + 1) * length].all(1)
            tables += 1
            if not any(m.sum() > (1 - recall) * len(m) for m in missed):
                break
    apart = [(~agreeing(pair, rotations[0])).sum(1) for pair in kinds]
    apart = max(max(a.max(), math.ceil(a.mean() + 4.5 * a.std())) for a in apart)
    return mean, rotations[: -(-tables // each)], length, tables, min(bits, int(apart))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows by the power of two that brings their largest component near 1: no digit changes, and
    no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = scaled(x), scaled(y)
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def _compared(pairs: DataFrame, added: str, decide) -> DataFrame:
    """Adds what ``decide(cosines, part)`` says about the vectors x and y; drops these."""

    def work():
        return lambda part: decide(_cosine(matrix(part.column("x")), matrix(part.column("y"))), part)

    return arrow_pass(pairs, added, work, keep=[c for c in pairs.columns if c not in ("x", "y")])


def _cells(points: DataFrame, threshold: float, recall: float, total: int) -> tuple[DataFrame, int]:
    """Adds code (bits of the first rotation) and cells (one key per table) to points; and
    the most bits that the codes of a pair at the threshold differ in."""
    drawn = sample(points.select(F.col("point").alias("vec_id"), "vector"), "itq", total)
    bits = min(62, drawn.shape[1])
    mean, rotations, length, tables, apart = plan_tables(drawn, total, threshold, recall)
    each = bits // max(1, length)
    shared = points.sparkSession.sparkContext.broadcast((mean, rotations))

    def work():
        def step(part: pa.RecordBatch) -> list[pa.Array]:
            mean, rotations = shared.value
            x = matrix(part.column("vector"))
            x = scaled(x)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            keys, first = [], None
            for n, rotation in enumerate(rotations):
                signs = _signs(x, mean, rotation).astype(np.int64)
                code = signs @ (1 << np.arange(bits, dtype=np.int64))
                first = code if first is None else first
                for s in range(each):
                    # The table's number in the high bits, the substring below.
                    keys.append(((n * each + s) << 32) | ((code >> (s * length)) & ((1 << length) - 1)))
            cells = np.stack(keys[:tables], axis=1) if len(x) else np.zeros((0, tables), np.int64)
            return [pa.array(first, pa.int64()), pa.array(cells.tolist(), pa.list_(pa.int64()))]

        return step

    return arrow_pass(points, "code long, cells array<bigint>", work), apart


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    wide = math.acos(threshold)
    vectors = settled(one_per_id(rows, "label"))
    good = vectors.where("vec_id is not null and label is not null and vector is not null")
    points = settled(good.groupBy("label", "vector").agg(F.min("vec_id").alias("point"), F.count("*").alias("size")))
    total = points.count()
    if not total:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    points, apart = _cells(points, threshold, recall, total)
    points = settled(points)
    cells = points.select("point", "label", "code", F.posexplode("cells").alias("nth", "cell"))

    # Clusters: a point joins the smallest pivot within half the angle.
    some = cells.where("nth < 4")
    dense = some.groupBy("label", "cell").agg(F.count("*").alias("n"), F.min("point").alias("pivot")).where(F.col("n") >= DENSE)
    dense = settled(dense)  # so that the join below can split a cell with very many points
    tries = some.join(dense, ["label", "cell"]).where("point <> pivot").select("point", "pivot").distinct()
    tries = tries.join(points.select("point", F.col("vector").alias("x")), "point")
    tries = tries.join(points.select(F.col("point").alias("pivot"), F.col("vector").alias("y")), "pivot")

    def angle(cosine: np.ndarray, part: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(np.arccos(np.clip(cosine, -1, 1)), pa.float64())]

    near = _compared(tries, "angle double", angle).where(F.col("angle") <= wide / 2 - ROOM)
    joined = near.groupBy("point").agg(F.min(F.struct("pivot", "angle")).alias("best"))
    members = points.join(joined, "point", "left").select(
        "point", "size", F.coalesce("best.pivot", "point").alias("leader"), F.coalesce("best.angle", F.lit(0.0)).alias("angle")
    )
    members = settled(members)
    clusters = members.groupBy("leader").agg(
        F.sum("size").alias("size"), F.max("angle").alias("radius"), F.count("*").alias("points"), F.min("point").alias("least"), F.max("point").alias("last")
    )
    clusters = settled(clusters.join(points.select(F.col("point").alias("leader"), "vector"), "leader"))

    # Candidate clusters share a cell; single points also agree in most of their code.
    held = cells.join(members.select("point", "leader"), "point").select("label", "cell", "leader").distinct()
    single = (F.col("points") == 1) & (F.col("leader") == F.col("least"))
    marks = clusters.join(points.select(F.col("point").alias("leader"), "code"), "leader").select("leader", F.when(single, F.col("code")).alias("code"))
    held = settled(held.join(marks, "leader"))
    other = held.select("label", "cell", F.col("leader").alias("b"), F.col("code").alias("code_b"))
    pairs = held.withColumnRenamed("leader", "a").join(other, ["label", "cell"]).where("a < b")
    pairs = pairs.where(F.coalesce(F.bit_count(F.col("code").bitwiseXOR(F.col("code_b"))) <= apart, F.lit(True))).select("a", "b").distinct()
    of = lambda side, vector: clusters.select(
        F.col("leader").alias(side), F.col("radius").alias(f"radius_{side}"), F.col("size").alias(f"size_{side}"), F.col("vector").alias(vector)
    )
    pairs = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b")

    def verdict(cosine: np.ndarray, part: pa.RecordBatch) -> list[pa.Array]:
        between = np.arccos(np.clip(cosine, -1, 1))
        reach = part.column("radius_a").to_numpy() + part.column("radius_b").to_numpy()
        all_linked = np.where(reach == 0, cosine >= threshold, between + reach <= wide - ROOM)
        none_linked = np.where(reach == 0, cosine < threshold, between - reach > wide + ROOM)
        return [pa.array(np.where(all_linked, 1, np.where(none_linked, 0, 2)), pa.int32())]

    judged = settled(_compared(pairs, "verdict int", verdict).where("verdict > 0"))
    whole = judged.where("verdict = 1")
    open_pairs = judged.where("verdict = 2").select("a", "b")
    side = members.join(points.select("point", "vector"), "point")
    open_pairs = open_pairs.join(side.select(F.col("leader").alias("a"), F.col("point").alias("p"), F.col("size").alias("size_p"), F.col("vector").alias("x")), "a")
    open_pairs = open_pairs.join(side.select(F.col("leader").alias("b"), F.col("point").alias("q"), F.col("size").alias("size_q"), F.col("vector").alias("y")), "b")

    def linked(cosine: np.ndarray, part: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(cosine >= threshold, pa.bool_())]

    single_links = settled(_compared(open_pairs, "linked boolean", linked).where("linked"))

    # Links of a vector: its cluster, clusters linked as a whole, and single points.
    by_cluster = whole.select(F.col("a").alias("leader"), F.col("size_b").alias("more")).union(whole.select("b", "size_a"))
    by_cluster = by_cluster.groupBy("leader").agg(F.sum("more").alias("more"))
    by_point = single_links.select(F.col("p").alias("point"), F.col("size_q").alias("few")).union(single_links.select("q", "size_p"))
    by_point = by_point.groupBy("point").agg(F.sum("few").alias("few"))
    edges = whole.select("a", "b").union(single_links.select("a", "b"))
    found = components(edges).withColumnRenamed("id", "leader")
    heads = clusters.select("leader", "least", F.col("size").alias("own")).join(found, "leader", "left").withColumn("component", F.coalesce("component", "leader"))
    firsts = heads.groupBy("component").agg(F.min("least").alias("component_id"))
    heads = heads.join(firsts, "component").join(by_cluster, "leader", "left")
    told = members.select("point", "leader").join(heads, "leader").join(by_point, "point", "left")
    told = told.select("point", "component_id", (F.col("own") - 1 + F.coalesce("more", F.lit(0)) + F.coalesce("few", F.lit(0))).alias("n_links"))
    told = points.select("point", "label", "vector").join(told, "point").drop("point")
    out = vectors.join(told, ["label", "vector"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


ORACLE = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
l as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
r as (select vec_id as id, vec_id as reached from embeddings union select r.id, l.b from r join l on r.reached = l.a),
c as (select id, min(reached) as component_id from r group by id),
n as (select a, count(*) as n from l group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join c on id = vec_id left join n on n.a = vec_id
"""
