"""Small documents with every awkward case, and brute-force helpers."""

import random
import sys

import pytest

sys.path.insert(0, "/root/repo")

EXTRA = "key string, t string, part int, score double, id long, n long, batch long, comp long, want int"
EXTRA_ROW = ("k", "t", 1, 0.5, 7, 8, 9, 10, 11)
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def words(rng, n, alphabet=400):
    return " ".join(f"w{rng.randrange(alphabet)}" for _ in range(n))


def corpus(seed=1):
    """(doc_id, text) rows: plain, near copies, exact copies, shared passages, a long
    text, null and empty texts, a null id, a repeated row, an id with two texts."""
    rng = random.Random(seed)
    base = words(rng, 120)
    passage = words(rng, 60, 100_000)
    rows = [(i, words(rng, 80)) for i in range(1, 9)]
    rows += [(10, base), (11, base + " tail one"), (12, "Head " + base.upper()), (13, base)]
    rows += [(20 + i, words(rng, 10) + " " + passage + " " + words(rng, 10)) for i in range(6)]
    rows += [(30, words(rng, 60_000, 5000)), (31, "tiny text"), (32, "tiny text"), (33, "one"),
             (34, "ab " * 300), (35, "zero\x00byte é ñ ß \u00a0 x\x1cy \u2003 end"), (36, "   \n\t ")]
    rows += [(40, None), (41, ""), (42, None), (None, base), (None, None), (50, words(rng, 70))]
    rows += [rows[-1], (51, "first text of an id"), (51, "second text of an id")]
    return rows


def frame(spark, rows):
    """Rows as a documents table, with extra columns of clashing names."""
    return spark.createDataFrame(
        [(i, t, "en", "s", len(t or ""), *EXTRA_ROW) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
