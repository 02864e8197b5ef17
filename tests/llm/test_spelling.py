from __future__ import annotations

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from keepline.llm import spelling


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_words(rows) -> dict[str, int]:
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute(words: dict[str, int]) -> list[tuple]:
    form, near = {}, {}
    for w, n in words.items():
        close = [x for x in words if one_edit(w, x)]
        near[w] = len(close)
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], near[w], words[form[w]] if form[w] else None))
    return sorted(out)


def alike(rng: random.Random, n: int) -> list[str]:
    """Words of a small alphabet with long runs of one letter, so that nearly all edits meet."""
    words = {"".join(rng.choice("aabé") for _ in range(rng.randint(5, 9))) for _ in range(n)}
    return sorted(words | {"a" * k for k in range(5, 12)} | {"ab" * k for k in range(3, 6)} | {"zzzzzq", "ÿ" * 6, "x" * 300, "x" * 301})


def texts(rng: random.Random) -> list[tuple[int, str]]:
    words = alike(rng, 300)
    return [(i, " ".join(rng.choice(words).upper() if rng.random() < 0.1 else rng.choice(words) for _ in range(120)) + ", 9x") for i in range(60)]


@pytest.mark.parametrize("block", [20_000, 40])
def test_variants_like_brute_force(spark, rows, block):
    rows = rows + [(i + 5000, t) for i, t in texts(random.Random(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in spelling.spelling_variants(docs, block=block).collect())
    want = brute(brute_words(rows))
    assert got == want
    assert sum(r[1] is not None for r in want) > 10 and any(r[1] and r[1] != r[2] for r in want)


def test_some_runs_lose_a_letter():
    found = [spelling.run_counts("Beautiful".encode(), str(i)) for i in range(400)]
    assert {len(next(iter(c))) for c in found} == {8, 9}


@pytest.mark.parametrize("backwards", [False, True])
def test_index_finds_each_pair_once(backwards):
    words = alike(random.Random(2), 400)
    counts = np.arange(len(words)) % 7
    got = {w: (k, n, f) for w, k, n, f in spelling.near_in_block(words, counts, words, backwards)}
    for w in words:
        m = len(w) // 2
        left = [x for x in words if one_edit(w, x) and x.startswith(w[:m])]
        close = [x for x in words if one_edit(w, x) and x not in left] if backwards else left
        best = min(close, key=lambda x: (-counts[words.index(x)], x), default=None)
        assert got.get(w) == ((len(close), counts[words.index(best)], best) if close else None)
    assert not spelling.near_in_block(words, counts, ["qqqqq", "aaqqaa"], backwards)


def test_odd_rows(spark, odd_docs, no_docs):
    got = spelling.spelling_variants(odd_docs, block=5)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got.collect())) == brute(brute_words(rows))
    assert spelling.spelling_variants(no_docs).collect() == []
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
