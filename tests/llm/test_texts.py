"""Operators on texts: exactness, held-out accuracy, and the cases of the messy table."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from logtables.llm import bpe, langid, licence, minhash, mixing, queries, sharding, toxicity

from .data import CLASHING, DOC_SCHEMA, messy_documents, near, prose

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def messy(spark):
    return messy_documents(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def test_bpe_equals_library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    mine, rng = bpe.codec(PATH), random.Random(1)
    letters = "abcdehinorstuABC'  \n\x1c\x85 éÀÅΣσİ中文🙂,.!?-_<|>0189"
    pieces = ["<|endoftext|>", "don't", "we'll", "'s", "hahahaha", "Å", "</w>", "aaaaaaaaaaaa", "é"]
    texts = ["", " ", "a" * 3000, "ab" * 500]
    texts += ["".join(rng.choice(pieces) if rng.random() < 0.1 else rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        ids = mine.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, repr(text)
        assert mine.decode(ids).decode() == tokenizer.decode(want.ids, skip_special_tokens=False), repr(text)


def test_bpe_equals_library_on_every_code_point():
    tokenizer = Tokenizer.from_file(PATH)
    mine = bpe.codec(PATH)
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(codes), 50_000):
        texts = ["a" + chr(c) + "b" for c in codes[at : at + 50_000]]
        for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
            assert np.frombuffer(mine.encode(text), "<u4").tolist() == want.ids, hex(ord(text[1]))
    rng = random.Random(9)
    texts = ["".join(chr(rng.choice(codes)) if rng.random() < 0.4 else rng.choice("aB 1'") for _ in range(30)) for _ in range(4000)]
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == want.ids, ascii(text)


def test_bpe_query_and_messy(spark, messy):
    tokenizer = Tokenizer.from_file(PATH)
    # The messy table has a column named ids; the tokens go beside it.
    rows = bpe.encode(messy[0], PATH, with_ids=True).collect()
    assert len(rows) == len(messy[1]) and all(r.ids in (None, "clash") for r in rows)
    for row in rows:
        want = tokenizer.encode(row.text or "", add_special_tokens=False).ids
        assert row.n_tokens == len(want) and row.ids_ == want
        assert row.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(tokenizer.decode(want, skip_special_tokens=False).encode()).hexdigest()


def _jaccard_components(texts: dict, words: int):
    sets = {i: minhash.shingles(t, words) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if len(x) and len(y):
                shared = len(np.intersect1d(x, y))
                if 100 * shared >= 80 * (len(x) + len(y) - shared):
                    low, high = sorted((find(a), find(b)))
                    parent[high] = low
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_shingles_are_words_of_ascii_blanks():
    assert len(minhash.shingles("A b C d", 2)) == 2
    assert np.array_equal(minhash.shingles("ÀB c", 2), minhash.shingles("Àb\tC", 2))
    assert len(minhash.shingles(" one ", 2)) == 1 and len(minhash.shingles(None, 2)) == 0


@pytest.mark.parametrize(("leaf", "large", "levels"), [(400, 8000, 10), (12, 8000, 10), (12, 24, 10), (12, 24, 0)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, leaf, large, levels):
    """Also with nodes that are too large for a leaf, in blocks, and branched on before."""
    monkeypatch.setattr(minhash, "LEAF", leaf)
    monkeypatch.setattr(minhash, "LARGE", large)
    monkeypatch.setattr(minhash, "MORE_LEVELS", levels)
    rng, texts = random.Random(5), {}
    for size, edits in ((60, 6), (30, 1), (5, 4), (2, 2)):
        base = prose(rng, 80)
        for _ in range(size):
            texts[len(texts) + 1] = near(rng, base, rng.randint(0, edits))
    for _ in range(60):
        texts[len(texts) + 1] = prose(rng, rng.randint(1, 80))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want, sizes = _jaccard_components(texts, 2)
    rows = minhash.near_duplicates(docs, words=2).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert {r.doc_id: r.n_shingles for r in rows} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_of_large_nodes_are_not_parted(spark, monkeypatch):
    """A chain of like texts, each linked with its neighbours only, in nodes above LARGE."""
    monkeypatch.setattr(minhash, "LEAF", 12)
    monkeypatch.setattr(minhash, "LARGE", 24)
    rng = random.Random(9)
    words = [f"w{rng.random()}" for i in range(2000)]
    texts = {i + 1: " ".join(words[i * 10 : i * 10 + 104]) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want, _ = _jaccard_components(texts, 5)
    assert set(want.values()) == {1}
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == want


def test_near_duplicates_messy(spark, messy, empty):
    docs, rows = messy
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    want, sizes = _jaccard_components(texts, 5)
    found = minhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles) == (want[r.doc_id], sizes[r.doc_id])
    kept = minhash.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, c in want.items() if i == c)
    assert ids.count(None) == 2
    assert minhash.near_duplicates(empty).count() == 0 and minhash.representatives(empty).count() == 0


def _targets(sizes: dict, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        left = total - sum(fixed.values())
        open_weight = sum(w for s, w in weight.items() if s not in fixed)
        share = {s: left * w / open_weight for s, w in weight.items() if s not in fixed}
        over = [s for s, t in share.items() if t > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mixing_messy(spark, messy, empty):
    docs, rows = messy
    words = lambda t: len((t or "").encode().split())
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += words(r[1])
    want = _targets(dict(sizes))
    plan = mixing.mix(docs).collect()
    assert sorted(r["size"] for r in plan) == sorted(words(r[1]) for r in rows)
    taken = defaultdict(int)
    for r in plan:
        source = None if r.src == "n" else r.src[1:]
        assert abs(r.target - want[source]) < 1e-6 * max(1, want[source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted((str(r.doc_id), r["size"], r.taken) for r in again) == sorted((str(r.doc_id), r["size"], r.taken) for r in plan)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and 0 < mixed.count() <= 3 * len(rows)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_sharding_messy(spark, messy, empty):
    docs, rows = messy
    found = sharding.shard(docs, 8).collect()
    text = lambda t: (t or "").encode()
    assert sorted((r["size"], r.text_crc32) for r in found) == sorted((len(text(r[1])) + 8, zlib.crc32(text(r[1]))) for r in rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shard(empty).count() == 0
    # More shards than rows: each row has one of its own.
    assert len({r.shard for r in sharding.shard(docs.limit(3), 8).collect()}) == 3


def test_sharding_matches_the_mixture(spark):
    found = sharding.shard(queries.table(spark, SF, "documents")).collect()
    counts = defaultdict(lambda: defaultdict(int))
    for r in found:
        counts[r.src][r.shard] += 1
    for by_shard in counts.values():
        assert max(by_shard.values()) - min(by_shard.get(s, 0) for s in range(24)) <= 2


def test_language_held_out(spark, empty, messy):
    rows = queries.QUERIES["op3_language_id"](spark, SF).collect()
    truth = {r.doc_id: r.lang for r in queries.table(spark, SF, "documents").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    model = langid.train(messy[0])
    found = langid.identify(messy[0], model, ("found", "chance")).collect()
    for r in found:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.found == "und") == (not letters) and 0 <= r.chance <= 1
    assert langid.train(empty) is None
    assert {r.lang_pred for r in langid.identify(messy[0].select("doc_id", "text"), None).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_language_kernel_is_a_count_of_shared_grams():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcÄß 中文字1.!") for _ in range(rng.randint(1, 60))) for _ in range(30)]

    def sets(text):
        signs = "".join(" " if c.isspace() else c if c.isalpha() else "." for c in f" {text.lower()} ")
        return [{signs[i : i + n] for i in range(len(signs) - n + 1)} for n in (1, 2, 3)]

    def shared(a, b):
        return sum(w * len(x & y) for w, x, y in zip(langid.WEIGHTS, sets(a), sets(b)))

    model = langid.Model(texts[:10])
    kernel, known = model.kernel(texts)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:10]):
            assert abs(kernel[i, j] - shared(a, b) / np.sqrt(shared(a, a) * shared(b, b))) < 1e-5
        every = [set().union(*(sets(b)[n] for b in texts[:10])) for n in range(3)]
        assert abs(known[i] - sum(w * len(x & y) for w, x, y in zip(langid.WEIGHTS, sets(a), every)) / shared(a, a)) < 1e-9


def test_languages_of_many_scripts_and_rare_ones(spark):
    rng = random.Random(0)
    letters = {
        "zh": [chr(0x4E00 + i) for i in range(3000)], "ko": [chr(0xAC00 + 7 * i) for i in range(1500)],
        "am": [chr(0x1200 + i) for i in range(200)], "he": [chr(0x5D0 + i) for i in range(26)],
        "la": list("abcdefghijklmnop"), "rare": list("qrstuvwxyzßþ"),
    }

    def text(lang):
        return " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(3, 40)))

    rows = [(n, text(lang), lang) for n in range(6000) for lang in [rng.choice(["zh", "ko", "am", "he", "la"])]]
    rows += [(9000 + n, text("rare"), "rare") for n in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.where("doc_id % 3 <> 0"), texts=200)
    found = langid.identify(docs.where("doc_id % 3 = 0"), model, ("found", "score", "known")).collect()
    for lang in letters:
        mine = [r.found == lang for r in found if r.lang == lang]
        assert mine and np.mean(mine) >= 0.95, lang
    assert sum(r.known < model.floor for r in found) <= 5
    # Letters and sequences of no learned language; ties go to the first language.
    foreign = spark.createDataFrame([(1, "".join(chr(0x3A3 + i) for i in range(20)) * 3, None)], docs.schema)
    assert langid.identify(foreign, model, ("found", "score", "known")).first().known < model.floor
    again = langid.train(docs.where("doc_id % 3 <> 0").repartition(7), texts=200)
    assert again.floor == model.floor and np.array_equal(again.weights, model.weights)


def test_toxicity_finds_copies_and_exact_neighbours(spark):
    """Over the real table: cosines of the neighbours equal those with all examples, copies come first."""
    docs, labels = (queries.table(spark, SF, t) for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = [(t, toxicity.Model.counts(model, t)) for t in texts.values()]
    dense = np.zeros((len(model.ids), len(model.terms)))
    for entry, ids in enumerate(model.ids):
        numbers, weights = model.vector(model.counts(texts[ids[0]]))
        dense[entry, numbers] = weights
    known = [c for _, c in rows if c]
    assert len(known) >= 0.95 * sum(bool(t and t.strip()) for t, _ in rows)
    for counts in known[:300]:
        numbers, weights = model.vector(counts)
        want = np.sort(dense[:, numbers] @ weights)[::-1][: toxicity.NEIGHBOURS]
        assert np.allclose([s for s, _ in model.nearest(counts)], want[want > 0])
    for entry, ids in enumerate(model.ids):
        assert entry in [i for s, i in model.nearest(model.counts(texts[ids[0]])) if s > 1 - 1e-9]


def test_toxicity_held_out(spark, empty, messy):
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op1_toxicity"](spark, sf).collect()
    truth = {r.doc_id: r.toxic for r in queries.table(spark, sf, "labels").collect()}
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    right = sum(p >= 0.5 and y for p, y in held)
    assert right / sum(y for _, y in held) > 0.86 and right / sum(p >= 0.5 for p, _ in held) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    labels = spark.createDataFrame([(1, 1), (5, None), (10, 0), (10, 1), (None, 1), (99, 0)], "doc_id long, toxic int")
    model = toxicity.train(messy[0], labels)
    scored = toxicity.score(messy[0], model, ("chance", "evidence")).collect()
    assert len(scored) == len(messy[1]) and all(0 <= r.chance <= 1 for r in scored)
    assert toxicity.train(messy[0], labels.limit(0)) is None and toxicity.train(empty, labels) is None
    assert toxicity.score(empty, model).count() == 0


def test_toxicity_neighbours_are_exact():
    rng = random.Random(2)
    model = toxicity.Model([f"^t{i:03d}" for i in range(60)], np.array([1 + rng.random() for _ in range(60)]))
    vectors = sorted({tuple(sorted((t, rng.randint(1, 4)) for t in rng.sample(range(60), rng.randint(1, 6)))) for _ in range(700)})
    model.build([(v, 1, rng.randint(0, 1), [i]) for i, v in enumerate(vectors)])
    by_id = {ids[0]: entry for entry, ids in enumerate(model.ids)}
    dense = np.zeros((len(vectors), 60))
    for i, v in enumerate(vectors):
        numbers, weights = model.vector(v)
        dense[by_id[i], numbers] = weights
    for _ in range(60):
        query = tuple(sorted((t, rng.randint(1, 3)) for t in rng.sample(range(60), rng.randint(1, 5))))
        numbers, weights = model.vector(query)
        want = np.sort(dense[:, numbers] @ weights)[::-1][: toxicity.NEIGHBOURS]
        got = [s for s, _ in model.nearest(query)]
        assert np.allclose(got, want[want > 0][: len(got)]) and len(got) == min(toxicity.NEIGHBOURS, (want > 0).sum())


def test_licences(spark, empty, messy):
    rows = queries.QUERIES["op2_licences"](spark, SF)
    texts = queries.table(spark, SF, "documents").select("doc_id", "text")
    marks = {"Version 2.0.": "apache-2.0", "the MIT License.": "mit", "CC BY-NC 4.0.": "cc-by-nc", "License, version 3.": "gpl-3.0"}
    for r in rows.join(texts, "doc_id").collect():
        want = [f for line in r.text.split("\n") for mark, f in marks.items() if line.endswith(mark)]
        assert sorted(r.families) == sorted(want)
        assert r.family == (r.families[0] if len(set(want)) == 1 else r.family) and (r.family == "unknown") == (not want)
    model = licence.train(empty)
    assert model.scan("x\nReleased under the MIT License.")[0][:2] == (1, "mit") and model.scan(None) == []
    found = licence.scan(messy[0].select("doc_id", "text"), model)
    assert {r.family for r in found.collect()} == {"unknown"} and licence.scan(empty, model).count() == 0
    assert set(CLASHING) <= set(messy[0].columns)


def test_toxicity_words_and_whole_lists():
    """Words without the pattern are its matches; texts whose bounds leave all blocks get the same
    neighbours from whole lists, and a text is searched once, not block by block."""
    every = "".join(map(chr, [*range(0x250), *range(0x2000, 0x2100), 0x130, 0x212A, 0x4E2D, 0xD800, 0x1F642]))
    texts = [every, "Plain text, under_score 12x\x1cy", "Émile—don’t «naïve» ½x²", "a\u00a0b\u2028c ١٢", ""]
    for text in texts:
        assert sorted(toxicity.words_of(text)) == sorted(toxicity.WORD.findall(text.lower()))
    rng = random.Random(8)
    model = toxicity.Model([f"={i}" for i in range(40)], np.array([1 + rng.random() for _ in range(40)]))
    draw = lambda: tuple((i, rng.randint(1, 3)) for i in sorted(rng.sample(range(40), 20)))
    model.build([(c, 1, 0, [i]) for i, c in enumerate({draw() for _ in range(16 * toxicity.BLOCK)})])
    queries = [draw() for _ in range(60)]
    first = [toxicity.Model.nearest(model, q) for q in queries]
    looked = []
    model._cells = lambda *a, real=model._cells: looked.append(1) or real(*a)
    again = [model.nearest(q) for q in queries]
    assert [[e for _, e in a] for a in first] == [[e for _, e in a] for a in again]
    assert model.wide > 0.9 and len(looked) < 10
    model.wide, model.turn = 0.0, 0
    assert np.allclose([[s for s, _ in model.nearest(q)] for q in queries], [[s for s, _ in a] for a in first])
