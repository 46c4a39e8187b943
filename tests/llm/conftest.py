from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, n_removed string, a double"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with further columns whose names the operators use inside."""
    def build(rows):
        return spark.createDataFrame(
            [(d, t, "en", None if d is None or d % 5 == 4 else f"s{d % 5}", len(t or ""), 7, None, "x", 0.5) for d, t in rows], SCHEMA)
    return build


@pytest.fixture(scope="session")
def prose():
    """A function that makes n words of text from a seed."""
    def make(n, seed, per_line=12):
        r = random.Random(seed)
        made = ["".join(r.choice("abcdefghiklmnoprstuwä") for _ in range(r.randint(2, 9))) for _ in range(n)]
        made = [r.choice(["the", "of", "and"]) if r.random() < 0.3 else w for w in made]
        return "\n".join(" ".join(made[i:i + per_line]) for i in range(0, n, per_line))
    return make


EDGES = [(None, "a text without a number of its own"), (9001, None), (9002, ""), (9003, " \n\t"), (9004, "one"), (9005, "one")]
