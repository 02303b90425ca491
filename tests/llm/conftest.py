from __future__ import annotations

import random

import pytest

WORDS = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyzéß", k=random.Random(i).randrange(1, 12))) for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, score string, h long"


def corpus(seed: int = 1) -> list[tuple]:
    """Documents with nulls, blanks, copies, near copies, shared passages, one very long text and repeated rows."""
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choices(WORDS, k=n))
    passage = say(60)
    texts: list[str | None] = [None, "", " \n\t", "one", "One TWO three", "one two three", say(4000)]
    base = say(120).split(" ")
    for i in range(25):  # near copies of one text
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    texts += [f"{say(rng.randrange(5, 90))}\n{passage}  {say(rng.randrange(5, 90))}" for _ in range(12)]
    texts += [texts[8], texts[8].upper(), texts[20]] + [say(rng.randrange(1, 80)) for _ in range(30)]
    rng.shuffle(texts)
    rows = [(3 * i + 1, t, rng.choice(["en", "de", None]), None, None if t is None else len(t), "x", None, 7) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[40]]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
