"""Operators on vectors and web pages against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from logtables.llm import hilbert, itq, warc

SCHEMA = "vec_id long, embedding array<float>, label int, point int, size string"


def _vectors(seed: int):
    """Random vectors, equal ones, a large crowd of like ones, and unusable ones."""
    rng = np.random.default_rng(seed)
    rows = []

    def add(vector, label):
        rows.append((len(rows), None if vector is None else [None if x is None else float(np.float32(x)) for x in vector], label, 1, "x"))

    for _ in range(150):
        add(rng.standard_normal(16), int(rng.integers(0, 3)))
    center = rng.standard_normal(16)
    for _ in range(120):
        add(center + 0.09 * rng.standard_normal(16), 1)
    for _ in range(60):
        add(center + 0.3 * rng.standard_normal(16), 1)
    for _ in range(40):
        add(center * 2, int(rng.integers(0, 2)))
    add(center, None)
    for bad in (None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0] * 3):
        add(bad, 1)
    return [*rows, rows[0], rows[200]]


def _usable(row):
    v = row[1]
    return v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("dense", [4, 16, 10_000])
def test_itq_equals_brute_force(spark, monkeypatch, dense):
    monkeypatch.setattr(itq, "DENSE", dense)
    rows = _vectors(4)
    found = {r.vec_id: r for r in itq.near_duplicates(spark.createDataFrame(rows, SCHEMA), recall=0.9999).collect()}
    unique = {r[0]: r for r in rows}
    assert sorted(found) == sorted(unique)
    good = [r for r in unique.values() if _usable(r) and r[2] is not None]
    x = np.array([r[1] for r in good])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.93) & (np.array([r[2] for r in good])[:, None] == np.array([r[2] for r in good])[None, :])
    np.fill_diagonal(linked, False)
    component = {r[0]: r[0] for r in unique.values()}
    for _ in range(len(good)):
        before = dict(component)
        for i, j in zip(*np.nonzero(linked)):
            component[good[i][0]] = min(component[good[i][0]], component[good[j][0]])
        if before == component:
            break
    links = {r[0]: int(n) for r, n in zip(good, linked.sum(1))}
    for i, r in found.items():
        assert r.n_links == links.get(i, 0), i
        assert r.component_id == component[i] and r.kept == (i == component[i])


@pytest.mark.parametrize("norm", [0.0, 0.8, 0.9])
def test_itq_keeps_its_recall_off_centre(spark, norm):
    """Pairs at a cosine of 0.935 among vectors with a common direction."""
    rng = np.random.default_rng(12)
    direction = rng.standard_normal(48)
    direction /= np.linalg.norm(direction)

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    x = rng.standard_normal((1500, 48))
    x = unit(norm * direction + np.sqrt(1 - norm**2) * unit(x - (x @ direction)[:, None] * direction))
    step = rng.standard_normal(x.shape)
    step = unit(step - np.einsum("ij,ij->i", step, x)[:, None] * x)
    x = np.concatenate([x, 0.935 * x + np.sqrt(1 - 0.935**2) * step])
    linked = (unit(x) @ unit(x).T >= 0.93).sum() - len(x)
    rows = [(i, v.tolist(), 1, 1, "x") for i, v in enumerate(x)]
    schema = SCHEMA.replace("array<float>", "array<double>")
    found = sum(r.n_links for r in itq.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert 0.965 * linked <= found <= linked


def test_itq_compares_two_vectors(spark):
    """Two vectors are opposite each other once their mean is taken off."""
    rows = [(1, [1.0, 0.0, 0.0], 1, 1, "x"), (2, [0.95, 0.3, 0.0], 1, 1, "x")]
    assert [r.n_links for r in itq.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()] == [1, 1]


def test_hilbert_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "BLOCK", 64)
    rows = _vectors(6)
    found = hilbert.search(spark.createDataFrame(rows, SCHEMA), hilbert.F.col("vec_id") % 5 == 0, k=7).collect()
    good = sorted((r for r in {r[0]: r for r in rows}.values() if _usable(r)), key=lambda r: r[0])
    x, ids = np.array([r[1] for r in good]), [r[0] for r in good]
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == [i for i in ids if i % 5 == 0]
    for q, mine in got.items():
        scores = np.add.accumulate(x * x[ids.index(q)], axis=1)[:, -1]
        want = sorted((-s, i) for s, i in zip(scores, ids) if i != q)[:7]
        assert sorted(mine) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


def test_hilbert_narrow_windows_reach_the_recall(spark, monkeypatch):
    """On clustered vectors the planned windows are narrow and still find the neighbours."""
    monkeypatch.setattr(hilbert, "BLOCK", 64)
    monkeypatch.setattr(hilbert, "LEAST_WINDOW", 16)
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((40, 12)) * 3
    x = (centers[rng.integers(0, 40, 4000)] + 0.3 * rng.standard_normal((4000, 12))).astype(np.float32)
    rows = [(i, v.tolist(), 0, 1, "x") for i, v in enumerate(x)]
    found = hilbert.search(spark.createDataFrame(rows, SCHEMA), hilbert.F.col("vec_id") % 20 == 0, k=10).collect()
    mine = {(r.query_id, r.vec_id) for r in found}
    x = x.astype(np.float64)
    hits = sum((q, int(i)) in mine for q in range(0, 4000, 20) for i in [j for j in np.argsort(-(x @ x[q]), kind="stable")[:11] if j != q][:10])
    assert hits >= 0.9 * 2000


def test_hilbert_curve_is_continuous():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        keys = hilbert.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_empty_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert itq.near_duplicates(empty).count() == 0
    assert hilbert.search(empty, hilbert.F.lit(True)).count() == 0
    unusable = spark.createDataFrame([(1, None, 1, 1, "x"), (2, [0.0], 1, 1, "x"), (None, [1.0], 1, 1, "x")], SCHEMA)
    assert sorted((str(r.vec_id), r.n_links, r.kept) for r in itq.near_duplicates(unusable).collect()) == [("1", 0, True), ("2", 0, True), ("None", 0, True)]
    assert hilbert.search(unusable, hilbert.F.lit(True)).count() == 0


def test_merge_runs():
    rng = random.Random(8)
    for _ in range(200):
        runs = [sorted((rng.randint(0, 9), rng.randint(0, 3)) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 9))]
        assert list(warc.merge_runs(runs)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert warc.url_key("https://user@WWW.Th.example.org:443/En/6?b=1#top") == "org,example,th)/en/6?b=1"
    assert warc.url_key("http://a.b:8080") == "b,a:8080)/"
    assert warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad"


def test_archive_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MERGE_ROWS", 20)
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    long_text = "ä\r\n\r\nWARC/1.1\r\n" * 200
    rows = [
        (1, "http://a.example/", None),
        (2, None, ""),
        (3, "http://b.example/x\r\ny z", "short"),
        (4, "http://b.example/", "short"),
        *[(10 + i, f"http://www.c.example/{i % 3}", long_text) for i in range(30)],
        (50, "http://d.example/", "x" * 300_000),
        (None, "http://e.example/", long_text),
        *[(60, "http://f.example/", "y" * 2000)] * 2,
        *[(100 + i, "http://hot.example/", f"{i}" * 400) for i in range(60)],
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "timestamp_seconds(coalesce(page_id, 0)) as captured", "1 as holder", "'x' as value")
    found = warc.round_trip(pages, str(tmp_path / "archive")).collect()
    assert len(found) == len(rows) and all(r.intact for r in found)
    payload = {r[0]: (r[2] or "").encode() for r in rows}
    holder = {}
    for i, body in payload.items():
        if len(body) >= 1000 and i is not None:
            holder[body] = max(i, holder.get(body, i))
    for r in found:
        body = payload[r.page_id]
        first = holder.get(body, r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if first == r.page_id else ("revisit", first))
    ordered = sorted(found, key=lambda r: (r.part, r.place))
    keys = [(r.surt, r.captured, r.record) for r in ordered]
    assert keys == sorted(keys) and len({r.part for r in found}) > 1
    empty = warc.round_trip(pages.limit(0), str(tmp_path / "empty"))
    assert empty.count() == 0


def test_itq_plan_grows_with_the_points():
    """No vector is its own unlike partner, so tables for more points have longer substrings."""
    vectors = np.random.default_rng(4).standard_normal((2000, 64))
    lengths = [itq.plan_tables(vectors, points, 0.93, 0.98)[2] for points in (50_000, 5_000_000)]
    assert lengths[1] > lengths[0] > 0


def test_itq_links_vectors_of_any_size(spark):
    rng = random.Random(8)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, "a", [x * size for x in v]) for i, (v, size) in enumerate((v, s) for v in base for s in (1.0, 1e-200, 1e200, 1e-300))]
    found = itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()
    assert {r.vec_id: r.component_id for r in found} == {i: i - i % 4 for i in range(24)} and all(r.n_links == 3 for r in found)
