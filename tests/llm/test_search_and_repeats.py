"""Ranked search, spelling variants and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from logtables.llm import dualtree, spelling, suffixes

from .data import CLASHING, DOC_SCHEMA, messy_documents, prose


@pytest.fixture(scope="module")
def messy(spark):
    return messy_documents(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


# Ranked search.


def ranking(items, docs, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    words = [(i, term.findall((t or "").translate(lower))) for i, t in docs]
    counts = [(i, len(w), Counter(w)) for i, w in words if w]
    n_docs, total = len(counts), sum(n for _, n, _ in counts)
    df = Counter(t for _, _, c in counts for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        asked, scored = Counter(term.findall((text or "").translate(lower))), []
        for doc, n, c in counts:
            m = 25 + (75 * n * n_docs) // total
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t, times in asked.items() if c[t]
            )
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, rank + 1, doc, -s) for rank, (s, _, doc) in enumerate(sorted(scored)[:k])]
    return out


def test_search_equals_brute_force(spark, messy, empty, monkeypatch):
    docs, rows = messy
    rng = random.Random(6)
    texts = [r[1] for r in rows if r[1]]
    items = [(n, " ".join(rng.choice(texts).split()[:30])) for n in range(25)]
    items += [(30, None), (31, ""), (32, "-- !"), (33, "WORD word"), (33, "word WORD"), (34, "中文 🙂 nowhere"), (35, items[0][1]), (3, items[3][1]), (None, "word")]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as rank", "'x' as score", "2 as item")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = sorted(ranking(items, [(r[0], r[1]) for r in rows], 7), key=key)
    assert sorted((tuple(r) for r in dualtree.search(asked, docs, 7).collect()), key=key) == want
    # In several blocks of items, and with first bounds from a sample of the documents.
    monkeypatch.setattr(dualtree, "ITEM_BYTES", 2000)
    monkeypatch.setattr(dualtree, "SAMPLE", 7)
    assert sorted((tuple(r) for r in dualtree.search(asked, docs.repartition(3), 7).collect()), key=key) == want
    for left, right in ((asked.limit(0), docs), (asked, empty)):
        assert dualtree.search(left, right).count() == 0


def test_search_prunes_and_stays_exact():
    """Scores of a tree equal the whole product, with most leaf pairs left out where texts differ."""
    rng = random.Random(1)
    topics = [[f"t{k}w{i}" for i in range(30)] for k in range(40)]
    docs = [" ".join(rng.choices(rng.choice(topics), k=30)) for _ in range(2000)]
    search = dualtree.Search([" ".join(rng.choices(topics[k], k=8)) for k in range(40)], 5)
    found = [dualtree.terms(t) for t in docs]
    df = Counter(search.vocabulary[t] for f in found for t in set(f) & set(search.vocabulary))
    search.weigh(len(docs), sum(map(len, found)), df)
    best, leaves = dualtree.Best(search), []
    inner = best._leaves
    best._leaves = lambda item, doc, *rest: (leaves.append((len(item.rows), len(doc.rows))), inner(item, doc, *rest))
    best.add(list(range(len(docs))), [search.impacts(f) for f in found])
    for i, counts in enumerate(search.counted):
        scores = [(-int(sum(search.items[i, t] * v for t, v in search.impacts(f) if t in counts)), False, d) for d, f in enumerate(found)]
        assert best.found[i] == sorted(s for s in scores if s[0])[:5]
    assert sum(a * b for a, b in leaves) < 0.3 * len(docs) * 40


# Spelling variants.


def edit_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows, shortest, least):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    out, form = {}, {}
    for w, n in words.items():
        near = [v for v in words if edit_one(v, w)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
        out[w] = (n, len(near), words[best] if form[w] else None)
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, *out[w])
    return out


def test_near_is_one_edit():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))).encode() for _ in range(300)} | {b"a" * n for n in (39, 40, 41, 42, 43)} | {b"a" * 40 + b"b"})
    groups = bytes(c % 16 for c in range(256))
    table = spelling.Table(words, groups)
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if edit_one(a, b)}
    assert {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if spelling.near(a, b)} == want
    found = [(words[x], words[y]) for xs, ys in spelling.search(table, table, True) for x, y in zip(xs.tolist(), ys.tolist())]
    assert {tuple(sorted(p)) for p in found} == want and len(found) == len(want)
    half = spelling.Table(words[::2], groups), spelling.Table(words[1::2], groups)
    crossed = [tuple(sorted((words[::2][x], words[1::2][y]))) for xs, ys in spelling.search(*half, False) for x, y in zip(xs.tolist(), ys.tolist())]
    assert sorted(crossed) == sorted(p for p in want if (words.index(p[0]) + words.index(p[1])) % 2)


@pytest.mark.parametrize("leaf", [2048, 3])
def test_variants_equal_brute_force(spark, messy, monkeypatch, leaf):
    """Also with a trie cut into many buckets, and nodes open down to the last letter group."""
    monkeypatch.setattr(spelling, "LEAF", leaf)
    rng, rows = random.Random(7), [(r[0], r[1]) for r in messy[1]]
    base = ["straße", "naïveté", "colour", "color", "colours", "recieve", "receive", "receives", "abcde", "edcba", "ecdab", "dabce", "x" * 60, "x" * 61]
    for doc in range(100, 160):
        rows.append((doc, " ".join(rng.choices(base, weights=range(1, 15), k=40)).title() + " ×÷ 中文word"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as word", "1 as n", "2 as bucket", "3 as root")
    want = variants(rows, 5, 3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs).collect()}
    assert got == want and any(v[0] and v[1] != v[0] for v in want.values())


def test_variants_empty(spark, messy, empty):
    assert spelling.variants(empty).count() == 0
    found = spelling.variants(messy[0].where("doc_id in (1, 2, 3, 4)"))
    assert found.count() == 0 and found.columns == ["word", "form", "root", "n", "n_near", "form_n"]


# Repeated passages.


def without_repeats(rows, window=50):
    first = defaultdict(lambda: suffixes.NO_ID)
    texts = [((suffixes.NO_ID if d is None else d), (t or "").encode()) for d, t in rows]
    for d, t in texts:
        for i in range(len(t) - window + 1):
            w = t[i : i + window]
            first[w] = min(first[w], d)
    out = []
    for (doc, _), (d, t) in zip(rows, texts):
        gone = bytearray(len(t) + 1)
        for i in range(len(t) - window + 1):
            if first[t[i : i + window]] < d:
                gone[i : i + window] = b"\1" * window
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((doc, len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def repeat_rows():
    rng = random.Random(4)
    passages = [prose(rng, rng.randint(8, 60)) for _ in range(6)] + ["ab" * 200, "z" * 300, "é" * 40]
    rows = [(i, " ".join(rng.choice(passages) if rng.random() < 0.5 else prose(rng, rng.randint(1, 20)) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    line = "the same common line of the documents stands here, 60 bytes."
    # A common line between texts that differ: many continuations of one beginning.
    rows += [(100 + i, prose(rng, 8) + line + prose(rng, 8)) for i in range(40)]
    rows += [(200, passages[0][:49]), (201, passages[0][:50]), (202, passages[0][:50]), (202, passages[0]), (202, passages[0]), (None, passages[0]), (None, line), (-5, passages[1])]
    return rows


@pytest.mark.parametrize("cell", [suffixes.CELL, 2])
def test_repeats_equal_brute_force(spark, cell):
    """Also with every bucket of more than two texts taken as hot."""
    rows = repeat_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    key = lambda r: (r[0] is None, r)
    got = sorted((tuple(r) for r in suffixes.without_repeats(docs, contents=False, cell=cell).collect()), key=lambda r: repr(r))
    assert got == sorted(without_repeats(rows), key=lambda r: repr(r))


def test_repeats_messy(spark, messy, empty):
    docs, rows = messy
    docs = docs.selectExpr("*", "'c' as n_bytes", "1 as row", "2 as twin", "3 as doc", "4 as owners")
    found = suffixes.without_repeats(docs)
    names = [c for c in found.columns if c not in docs.columns]
    assert names == ["n_bytes_", "n_removed", "n_spans", "kept_sha256", "removed"] or set(CLASHING) <= set(found.columns)
    got = found.select("doc_id", "n_bytes_", "n_removed", "n_spans", "kept_sha256", "kept_", "removed").collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(without_repeats([(r[0], r[1]) for r in rows]), key=repr)
    for r in got:
        assert hashlib.sha256(r.kept_).hexdigest() == r.kept_sha256 and sum(b - a for a, b in r.removed) == r.n_removed
    assert suffixes.without_repeats(empty).count() == 0


def test_repeats_of_long_texts(spark):
    """Pieces of a text longer than a slab, with a passage across their border."""
    rng = random.Random(12)
    long = "".join(chr(97 + rng.randrange(26)) for _ in range(suffixes.SLAB + 300_000))
    passage = long[suffixes.SLAB - 70 : suffixes.SLAB + 90]
    rows = [(1, "head " + passage), (2, long), (3, "x" + long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffixes.without_repeats(docs, contents=False).collect()}
    assert got == {1: (0, 0), 2: (160, 1), 3: (len(long), 1)}


def test_deep_shallow_order():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(50, 120))).encode() for _ in range(12)] + [b"ab" * 60, b"ab" * 40 + b"c" * 30] * 2
    texts += [t[:30] + b"z" + t[30:] for t in texts]
    cells = np.array([0] * 7 + [1] * (len(texts) - 7))
    low = np.array(rng.sample(range(100), len(texts)))
    first = np.cumsum([0, *(len(t) - 49 for t in texts)])[:-1]
    windows = [(i, at) for i, t in enumerate(texts) for at in range(len(t) - 49)]
    want = {}
    for i, at in windows:
        key = (cells[i], texts[i][at : at + 50])
        want[key] = min(want.get(key, 1000), low[i])
    lows = np.array([low[i] for i, _ in windows])
    suffixes.lower(texts, cells, low, lows, first)
    assert lows.tolist() == [want[cells[i], texts[i][at : at + 50]] for i, at in windows]
    letters = np.array([rng.randrange(3) for _ in range(500)], np.uint64), np.array([rng.randrange(3) for _ in range(500)], np.uint64)
    cell = np.array([rng.randrange(4) for _ in range(500)])
    order, new = suffixes.shallow(cell, list(letters))
    keys = list(zip(cell[order].tolist(), letters[0][order].tolist(), letters[1][order].tolist()))
    assert keys == sorted(keys) and new.tolist() == [i == 0 or k != keys[i - 1] for i, k in enumerate(keys)]


def test_blind_trie_sorts():
    rng = random.Random(6)
    windows = [("".join(rng.choice("ab") for _ in range(12)) * 5)[:50].encode() for _ in range(300)]
    trie = suffixes.BlindTrie(windows[0], 0)
    for i, window in enumerate(windows[1:], 1):
        trie.add(window, i)
    groups = [[windows[i] for i in g] for g in trie.groups()]
    assert [g[0] for g in groups] == sorted(set(windows)) and all(len(set(g)) == 1 for g in groups) and sum(map(len, groups)) == 300


def test_partners_lose_no_window():
    """Fragments with a window of another text are kept, most of those that only share a string are not."""
    rng = random.Random(1)
    kept = wanted = 0
    for trial in range(60):
        letters = rng.choice([1, 2, 4, 26])
        draw = lambda n: bytes(97 + rng.randrange(letters) for _ in range(n))
        texts = [draw(rng.randrange(200)) for _ in range(6)]
        string = draw(24)  # too short to be repeated
        for _ in range(4):
            source, rest = rng.choice(texts), rng.choice([b"", b"ab" * 40, b"a" * 60, draw(20) * 4])
            at = rng.randrange(max(1, len(source) - 50))
            texts.append(draw(rng.randrange(60)) + source[at : at + rng.randrange(50, 120)] + rest + draw(40) + string + draw(40))
        data, _, starts, _ = suffixes._slab([(i, 0, t) for i, t in enumerate(texts)])
        part, at, size, key = suffixes.keyed_fragments(data, starts)
        for i, text in enumerate(texts):
            alone = suffixes.keyed_fragments(text, np.array([0, len(text)]))
            assert alone[3].tolist() == key[part == i].tolist()  # a key follows from the text alone
        order = np.argsort(key)
        found = np.zeros(len(key), bool)
        found[order] = suffixes.partners(key[order], part[order])
        holders = defaultdict(set)
        for f, (a, n) in enumerate(zip(at.tolist(), size.tolist())):
            for i in range(a, a + n):
                holders[data[i : i + 50]].add(f)
        shared = {f for fs in holders.values() if len({part[f] for f in fs}) > 1 for f in fs}
        assert all(found[f] for f in shared)
        if letters == 26:
            kept, wanted = kept + int(found.sum()), wanted + len(shared)
    assert wanted and kept < 1.3 * wanted


def test_keys_of_texts_travel_small(spark):
    """Keys of texts that share nothing take about half of the 16 bytes of a key and a text, and none is marked."""
    rng = random.Random(2)
    rows = [(i, "".join(chr(97 + rng.randrange(26)) for _ in range(2000))) for i in range(200)] + [(900 + i, "the same text, which is long enough to be repeated") for i in range(50)]
    docs = suffixes.keyed(spark.createDataFrame(rows, "doc_id long, text string"), F.col("text"))
    hashes = suffixes._hashes(suffixes._packed(docs).coalesce(1).sortWithinPartitions("row", "twin"), 8).cache()
    lines = hashes.where("steps is not null").collect()
    keys = sum(len(suffixes._blob_keys(r.steps, r.sides, r.owners)[0]) for r in lines)
    assert keys > 15_000 and sum(len(r.steps) + len(r.sides) + len(r.owners) for r in lines) < 10 * keys
    assert suffixes._shared(hashes.coalesce(1).sortWithinPartitions("cell"), 4).where("steps is not null").count() == 0
    table = hashes.where("steps is null").collect()
    assert len(table) == 1 and len(table[0].owners) == 8 * 201


def test_shared_keys_looked_through_in_parts(monkeypatch):
    """A cell too large to be held gives the same marks; its hot buckets go on as they come."""

    class Tasks:
        def __init__(self, *batches):
            self.batches = batches

        def mapInArrow(self, run, _):
            return Tasks(*run(iter(self.batches)))

    rng = random.Random(3)
    passage = "a passage of more than fifty bytes that stands in each of the texts here"
    texts = [f"{prose(rng, 6)} {passage if i % 2 else ''} {prose(rng, 6)}" + "ab" * 500 * (i == 7) for i in range(60)]
    pack = lambda t: zstandard.compress(t.encode())
    parts = [pa.RecordBatch.from_pydict({"row": [i], "twin": [b"x"], "text": [pack(t)]}) for i, t in enumerate(texts)]

    def marks(cell):
        lines = [r for i in range(0, 60, 10) for b in suffixes._hashes(Tasks(*parts[i : i + 10]), 2).batches for r in b.to_pylist()]
        lines.sort(key=lambda r: r["cell"])
        found = suffixes._shared(Tasks(pa.RecordBatch.from_pylist(lines)), cell).batches
        shared = sorted((r for b in found for r in b.to_pylist()), key=lambda r: r["chunk"])
        schema = pa.schema([("cell", pa.int64()), ("chunk", pa.int64()), *((n, pa.binary()) for n in suffixes.KEY_NAMES[2:])])
        rows = suffixes._marks(Tasks(pa.RecordBatch.from_pylist(shared, schema))).batches
        out = {r["row"]: sorted(r["marks"]) for b in rows for r in b.to_pylist()}
        assert all(len(set(m)) == len(m) for m in out.values())
        return out

    whole, hot = marks(1000), marks(10)
    assert set(range(1, 60, 2)) <= set(whole) and any(m & 1 for m in hot[1]) and not any(m & 1 for m in whole[1])
    monkeypatch.setattr(suffixes, "LOOKED", 40)
    assert marks(1000) == whole and marks(10) == hot
