"""Small document tables with the cases every operator must handle."""

from __future__ import annotations

import random

SYLLABLES = ["ta", "re", "mi", "lon", "der", "sta", "ver", "ing", "or", "ska", "été", "ßu"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]


def prose(rng: random.Random, n: int) -> str:
    out = words(rng, n)
    return "".join(w + ("\n" if rng.random() < 0.08 else ". " if rng.random() < 0.1 else " ") for w in out).strip()


def edited(rng: random.Random, text: str, changes: int) -> str:
    out = text.split(" ")
    for _ in range(changes):
        out[rng.randrange(len(out))] = words(rng, 1)[0]
    return " ".join(out)


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Prose, exact and near copies, a shared passage, junk, nulls, empties, a long text and repeated rows."""
    rng = random.Random(seed)
    texts: list = [prose(rng, rng.randint(30, 200)) for _ in range(n)]
    passage = prose(rng, 70).replace("\n", " ") + "\n" + prose(rng, 60).replace("\n", " ")
    texts += [texts[0]] * 4 + [edited(rng, texts[1], k) for k in (1, 2, 3, 8, 20)] + [edited(rng, texts[2], 2) for _ in range(6)]
    texts += [prose(rng, 20) + "\n" + passage + "\n" + prose(rng, 20) for _ in range(5)]
    texts += ["", " \n\t ", None, "one", "two words", "a b c", "the " * 300, "x" * 5000, "$$$ ### | <b>" * 20, prose(rng, 5000), "Éa ﬁ ́ 漢字 😀 \x1c   ▁"]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["s1", "s2", "s0", None]) if rng.random() < 0.6 else "s0", None) for i, t in enumerate(texts)]
    rows += [(rows[5][0], rows[5][1], "en", "s0", None), (rows[6][0], prose(rng, 40), "en", "s1", None), (None, texts[0], None, None, None), (None, None, None, None, None)]
    return rows


def table(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """The table with columns named as operators might name their own."""
    from pyspark.sql import functions as F

    names = ("id", "n", "key", "pos", "line", "score", "label", "a", "b", "size", "place", "row", "ids", "start", "component", "token", "ratio")
    return df.withColumns({k: F.lit(7) for k in names})
