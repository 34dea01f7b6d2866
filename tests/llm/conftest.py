from __future__ import annotations

import random

import pytest

WORDS = "amber basil cedar delta ember fjord grove heron indigo jasper kelp lotus maple nectar onyx pearl quartz raven sable thyme umber violet willow xenon yarrow zephyr".split()


@pytest.fixture(scope="session")
def prose():
    def make(n: int, seed: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, blank, long and repeated texts, and columns with names that operators use."""
    rows = [
        (1, "plain words stand here in a row", "en"), (1, "plain words stand here in a row", "en"), (2, None, None), (3, "", "en"), (4, " \n\t", "de"), (None, "a row without a name", None), (None, None, None),
        (5, "word " * 60_000, "en"), (6, "x" * 100_000, "en"), (7, "😀 é ▁ \x00 ß", "fr"), (8, "!!! ??? 123", "en"),
    ]
    schema = "doc_id long, text string, lang string"
    clash = "score double, predicted int, ids int, n_tokens int, key int, rank int, part int, n_entities int, lang_pred string, held_out int, node int, length int"
    return spark.createDataFrame([(*r, 0.5, *[1] * 7, "zz", 1, 1, 1) for r in rows], f"{schema}, {clash}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")
