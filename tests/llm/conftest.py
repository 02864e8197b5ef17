from __future__ import annotations

import random

import pytest

CLASH = (
    "doc version original hits words group n size shard bin fp root node a b part key pos slice bitmap dropped "
    "kept spans terms base edges marks number lead bucket turns formatted mask anomaly label"
).split()
VOCABULARY = [a + b for a in ("ab", "ce", "dit", "of", "the", "lor", "ma", "né") for b in ("", "x", "ing", "s", "ère", "ön")]
LONG = " ".join(VOCABULARY[i * 7 % len(VOCABULARY)] + str(i % 97) for i in range(30_000))


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) + str(rng.randrange(300)) for _ in range(n))


def varied(seed: int = 1) -> list[tuple[int, str | None]]:
    """Documents with copies, near copies, shared lines and passages, and every odd text."""
    rng = random.Random(seed)
    texts: list[str | None] = [sentence(rng, rng.randint(1, 120)).replace(" the", "\n the") for _ in range(60)]
    line, passage = sentence(rng, 9), sentence(rng, 20)
    for i in range(12):
        texts.append(texts[i])
        words = texts[20 + i].split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
        texts.append(f"{sentence(rng, 15)}\n {line.upper()} \t\n{sentence(rng, 12)}")
        texts.append(f"{sentence(rng, 15)} {passage} {sentence(rng, 12)}")
    texts += [None, None, "", "", " \n\t ", "\n\n", "a", "A a a a a a a a a a", "x" * 300, "x" * 280, "\\ # <b>", "é" * 80, LONG, LONG + " end"]
    texts += ["word " * 40, "same line here\nsame line here\nsame line here\n", "0 1 2 3 4 5 6 7 8 9 10 11 12 13 14"]
    rng.shuffle(texts)
    return list(enumerate(texts, start=3))


@pytest.fixture(scope="session")
def rows() -> list[tuple[int, str | None]]:
    return varied()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, f"src{i % 3}" if i % 7 else None) for i, t in rows], "doc_id long, text string, source string")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, repeated rows, ids with two texts, and columns named like the operators' own."""
    base = [
        (None, "no id but the same line here\nx", "s"),
        (None, None, None),
        (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "s"),
        (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "s"),
        (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", None),
        (5, "no id but the same line here\ny", "t"),
        (5, "another text of the same id\nno id but the same line here", "t"),
        (6, "", "t"),
    ]
    extra = ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(*r, *["e"] * len(CLASH)) for r in base], f"doc_id long, text string, source string, {extra}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
