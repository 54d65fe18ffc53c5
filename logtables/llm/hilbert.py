"""Nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions in several random ways; each way shifts its grid
and orders all vectors along a Hilbert curve. Near vectors tend to have near places in some
ordering. The orderings are cut into blocks of consecutive places; a query is compared with
the blocks that its window touches, in double precision, and the windows' best are merged.

How wide a window must be depends on the data: on clustered vectors a sliver of the ordering
is enough, on vectors without structure no ordering helps and the windows cover most of it. So
a bounded set of pilot queries is answered exactly first, by one pass over all vectors, and
the number of orderings and the window are the cheapest that find ``RECALL`` of the pilots'
neighbours. Largest inner products become nearest vectors by one more coordinate that
gives all vectors the same norm.

Defined results: vectors without id, null, zero, of another length than most, or with null
or non-finite components take no part, neither as query nor as candidate; rows with one id
are one vector; ties go to the smaller id; a query never finds itself; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_pass, bucket_count, hash_key, running_total, settled, unit
from .vectors import matrix, one_per_id, sample

NEIGHBOURS = 20
ORDERINGS = 4
DIMENSIONS, BITS, TIE_BITS = 8, 5, 23
PILOTS = 96
RECALL = 0.97
#: Places of a block, and the least half width of a window.
BLOCK = 4096
LEAST_WINDOW = 2048
#: Borders of the ranges an ordering is ranked in, at most.
RANGES = 1024


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of whole numbers below 2 ** bits.

    From the highest bit down, each cell's corner is reflected and its axes are exchanged
    as the curve enters it; the bits in Gray code are then the place, axis by axis.
    """
    x = grid.astype(np.int64).T.copy()
    axes = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(axes):
            inside = (x[i] & level) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(inside, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        level >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    level = 1 << (bits - 1)
    while level > 1:
        turn = np.where((x[-1] & level) != 0, turn ^ (level - 1), turn)
        level >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


class Curves:
    """The orderings: projections, grids and the borders of their ranges."""

    def __init__(self, drawn: np.ndarray, norm: float, ranges: int):
        self.norm = norm
        size = drawn.shape[1] + 1
        self.maps = []
        lifted = self._lift(drawn, False)
        for r in range(ORDERINGS):
            rng = np.random.default_rng(1000 + r)
            turn, _ = np.linalg.qr(rng.standard_normal((size, size)))
            turn = turn[:, : min(DIMENSIONS, size)]
            flat = lifted @ turn
            low, high = flat.min(0), flat.max(0)
            wide = np.maximum(high - low, 1e-12)
            # The grid is half as wide again as the data and starts at a random shift.
            self.maps.append((turn, low - wide * rng.uniform(0, 0.5, len(wide)), 1.5 * wide))
        tie = np.random.default_rng(7).integers(0, 1 << TIE_BITS, len(drawn))
        keys = self.keys(drawn, False, tie)
        self.borders = [np.quantile(k, np.arange(1, ranges) / ranges, method="lower") for k in keys]
        self.ranges = ranges

    def _lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        """One more coordinate: zero for a query, else what is missing to the largest norm."""
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return np.hstack([x, last[:, None]])

    def keys(self, x: np.ndarray, query: bool, tie: np.ndarray) -> list[np.ndarray]:
        lifted, out = self._lift(x, query), []
        for turn, low, wide in self.maps:
            grid = np.clip((lifted @ turn - low) / wide * (1 << BITS), 0, (1 << BITS) - 1)
            out.append((hilbert_keys(grid.astype(np.int64), BITS) << TIE_BITS) | tie)
        return out


def places(rows: DataFrame, curves: Curves) -> DataFrame:
    """(ordering, vec_id, is_query, place): how many vectors stand before the row in each
    ordering. Rows are (vec_id, is_query, vector); a query row marks its place only."""
    shared = rows.sparkSession.sparkContext.broadcast(curves)

    def work():
        def step(part: pa.RecordBatch) -> list[pa.Array]:
            curves = shared.value
            x, ids = matrix(part.column("vector")), part.column("vec_id").to_numpy()
            asked = part.column("is_query").to_numpy(zero_copy_only=False)
            spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TIE_BITS)).astype(np.int64)
            keys = [np.where(asked, q, d) for d, q in zip(curves.keys(x, False, spread), curves.keys(x, True, spread))]
            cells = [np.searchsorted(b, k, side="right") for b, k in zip(curves.borders, keys)]
            return [pa.array(np.stack(v, axis=1).tolist(), pa.list_(pa.int64())) for v in (keys, cells)]

        return step

    rows = arrow_pass(rows, "keys array<bigint>, ranges array<bigint>", work, keep=["vec_id", "is_query"])
    rows = rows.select("vec_id", "is_query", F.posexplode(F.arrays_zip("keys", "ranges")).alias("ordering", "at"))
    rows = settled(rows.select("vec_id", "is_query", "ordering", F.col("at.keys").alias("key"), F.col("at.ranges").alias("range")))
    order = [F.col("key"), F.col("is_query"), F.col("vec_id")]
    middle = (F.col("range") + 0.5) / curves.ranges
    rows = running_total(rows, ["ordering"], middle, order, F.when(F.col("is_query"), 0).otherwise(1), "place", curves.ranges)
    return rows.select("ordering", "vec_id", "is_query", "place")


def _exact(queries: np.ndarray, ids: np.ndarray, candidates: np.ndarray, names: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """The k best candidates of each query, (query, candidate, score), itself left out.

    A product of matrices selects, with room for its rounding; the scores are sums in the
    order of the components.
    """
    products = queries @ candidates.T
    for query, own, row in zip(queries, ids, products):
        other = np.flatnonzero(names != own)
        if len(other) > k:
            least = np.partition(row[other], len(other) - k)[len(other) - k]
            other = other[row[other] >= least - 1e-9 * max(1.0, abs(least))]
        scores = np.add.accumulate(candidates[other] * query, axis=1)[:, -1] if len(other) else np.zeros(0)
        for i in np.lexsort((names[other], -scores))[:k]:
            yield int(own), int(names[other[i]]), float(scores[i])


def _batch(found: list[tuple[int, int, float]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], ["query_id", "vec_id", "score"])


def _best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of each query."""
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scan(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """The exact neighbours of a bounded number of queries: one pass over all vectors, of
    which each batch passes on the k best."""
    shared = vectors.sparkSession.sparkContext.broadcast((ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        for batch in batches:
            if batch.num_rows:
                yield _batch(list(_exact(queries, ids, matrix(batch.column("vector")), batch.column("vec_id").to_numpy(), k)))

    return _best(vectors.select("vec_id", "vector").mapInArrow(run, "query_id long, vec_id long, score double"), k)


def plan_windows(gaps: np.ndarray, total: int, recall: float = RECALL) -> tuple[int, int]:
    """Number of orderings and half width of the windows, of least cost. ``gaps``: for each
    neighbour of a pilot, how far from the pilot it stands in each ordering."""
    if not len(gaps):
        return 1, LEAST_WINDOW
    best = None
    for n in range(1, gaps.shape[1] + 1):
        needed = np.sort(gaps[:, :n].min(1))
        window = max(LEAST_WINDOW, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1)
        cost = n * min(total, 2 * window + BLOCK)
        if best is None or cost < best[0]:
            best = (cost, n, window)
    return best[1], best[2]


def search(rows: DataFrame, is_query: Column, k: int = NEIGHBOURS, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each vector for which ``is_query``
    (on vec_id) holds."""
    vectors = settled(one_per_id(rows).where("vec_id is not null and vector is not null"))
    total = vectors.count()
    empty = "query_id long, rank int, vec_id long, score double"
    if not total:
        return rows.sparkSession.createDataFrame([], empty)
    norm = vectors.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).first()[0] ** 0.5
    curves = Curves(sample(vectors, "hilbert", total), norm, min(RANGES, bucket_count(total)))
    queries = vectors.where(is_query)
    asked = vectors.withColumn("is_query", F.lit(False)).unionByName(queries.withColumn("is_query", F.lit(True)))
    ranked = settled(places(asked, curves))

    # Pilots: their exact neighbours, and how far away these stand in each ordering.
    count = queries.count()
    share = 1.0 if count <= PILOTS else PILOTS / count
    pilots = queries.where(unit(hash_key("pilot", F.col("vec_id"))) < share).toArrow()
    if not pilots.num_rows:
        pilots = queries.limit(PILOTS).toArrow()
    gaps = np.zeros((0, ORDERINGS))
    if pilots.num_rows:
        ids = pilots.column("vec_id").to_numpy()
        near = settled(scan(vectors, ids, matrix(pilots.column("vector")), k))
        own = ranked.where("is_query").select("ordering", F.col("vec_id").alias("query_id"), F.col("place").alias("own"))
        # At most ``PILOTS`` times k pairs, in each ordering.
        stands = ranked.where("not is_query").join(F.broadcast(near.select("query_id", "vec_id")), "vec_id").join(own, ["ordering", "query_id"])
        stands = stands.groupBy("query_id", "vec_id").pivot("ordering", list(range(ORDERINGS))).agg(F.min(F.abs(F.col("place") - F.col("own"))))
        gaps = stands.drop("query_id", "vec_id").toPandas().to_numpy(dtype=np.float64).reshape(-1, ORDERINGS)
    orderings, window = plan_windows(gaps, total, recall)

    ranked = ranked.where(F.col("ordering") < orderings)
    blocks = ranked.where("not is_query").withColumn("block", F.expr(f"place div {BLOCK}"))
    low = F.expr(f"greatest(0L, place - {window}L) div {BLOCK}")
    high = F.expr(f"least({total - 1}L, place + {window}L) div {BLOCK}")
    touched = ranked.where("is_query").withColumn("block", F.explode(F.sequence(low, high)))
    work = blocks.unionByName(touched).join(vectors, "vec_id").select("ordering", "block", "is_query", "vec_id", "vector")
    work = work.repartition("ordering", "block").sortWithinPartitions("ordering", "block", "is_query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, block = None, [], None  # a block's vectors come before its queries
        for batch in batches:
            names, x = batch.column("vec_id").to_numpy(), matrix(batch.column("vector")) if batch.num_rows else None
            asked = batch.column("is_query").to_numpy(zero_copy_only=False)
            group = batch.column("ordering").to_numpy().astype(np.int64) << 40 | batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(group) != 0) | (np.diff(asked.astype(np.int8)) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if group[a] != at:
                    at, parts, block = group[a], [], None
                if not asked[a]:
                    parts.append((names[a:b], x[a:b]))
                    continue
                if block is None and parts:
                    block = tuple(np.concatenate(p) for p in zip(*parts))
                for s in range(a, b if block else a, 256):
                    e = min(s + 256, b)
                    yield _batch(list(_exact(x[s:e], names[s:e], block[1], block[0], k)))

    return _best(work.mapInArrow(run, "query_id long, vec_id long, score double"), k)


ORACLE = """
with v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(embedding, embedding) > 0),
s as (
  select a.vec_id as query_id, b.vec_id, list_dot_product(a.e, b.e) as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from s qualify rank <= 20
"""
