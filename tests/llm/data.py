"""Small tables with the cases every operator must bear."""

from __future__ import annotations

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside, or the tables have elsewhere.
CLASHING = ["size", "key", "src", "cell", "score", "node", "rep", "kept", "component", "place", "vector", "epochs", "lang_pred", "ids"]


def word(rng: random.Random) -> str:
    return "".join(rng.choice(["th", "er", "on", "an", "re", "in", "ed", "ou", "st"]) for _ in range(rng.randint(1, 4)))


def prose(rng: random.Random, words: int) -> str:
    return " ".join(word(rng) for _ in range(words))


def near(rng: random.Random, text: str, edits: int) -> str:
    found = text.split(" ")
    for _ in range(edits):
        found[rng.randrange(len(found))] = word(rng) + "x"
    return " ".join(found)


def messy_documents(spark, seed: int = 3):
    """Nulls in every column, empty and blank texts, a long one, copies, repeated rows and
    columns with clashing names."""
    rng = random.Random(seed)
    base = prose(rng, 60)
    rows = [
        (1, None, "en", "s1", None),
        (2, "", None, None, 0),
        (3, "   \n\t ", "en", "s1", 5),
        (4, "1234 !!! --", None, "s2", 9),
        (5, "Word", "en", "s2", 4),
        (None, base, "en", "s1", 1),
        (None, None, None, None, None),
        (7, prose(rng, 30_000), "en", "s3", None),
        *[(10 + i, base, "en", "s1", 1) for i in range(6)],
        *[(20 + i, near(rng, base, 1), "de", None, 1) for i in range(6)],
        *[(30, "the same row twice", "fr", "s2", 18)] * 3,
        (31, "Émile Σίσυφος don't 中文 🙂 <|endoftext|> x\x1cy", "fr", "", 20),
        *[(40 + i, prose(rng, 40), rng.choice(["en", "de"]), f"s{i % 4}", None) for i in range(30)],
    ]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    for i, name in enumerate(CLASHING):
        docs = docs.selectExpr("*", f"'clash' as {name}") if i % 2 else docs.selectExpr("*", f"cast(null as int) as {name}")
    return docs, rows
