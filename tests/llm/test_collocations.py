from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from keepline.llm import collocations


def brute(rows, least=10, top=2000, covered=50) -> list[tuple]:
    f = defaultdict(Counter)
    for text, lang in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang or "und"][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        n = sum(k for p, k in counts.items() if len(p) == 1)
        longer = Counter()
        for p, k in counts.items():
            if len(p) == 3 and k >= least:
                for inner in (p[:2], p[1:]):
                    longer[inner] = max(longer[inner], k)
        found = []
        for p, a in counts.items():
            if len(p) == 1 or a < least or len(p) == 2 and longer[p] and 100 * longer[p] >= covered * a:
                continue
            score, _, l, r = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return sorted(out)


def prose(seed: int, n: int) -> list[tuple[str | None, str | None]]:
    rng = random.Random(seed)
    words = ["the", "of", "new", "york", "City", "ünter", "x|y", "a\x1fb", "z" * 70] + [f"w{i}" for i in range(40)]
    weight = [1 / (i + 1) for i in range(len(words))]
    rows: list[tuple[str | None, str | None]] = []
    for i in range(n):
        some = rng.choices(words, weight, k=rng.randint(0, 90))
        if rng.random() < 0.5:
            some[5:5] = ["New", "York", "city"]
        marks = rng.choices([" ", "  ", "\t", ". ", ",", "\n", "\x0b"], [80, 5, 2, 3, 3, 2, 1], k=len(some))
        rows.append(("".join(w + m for w, m in zip(some, marks)), rng.choice(["en", "de", None])))
    return rows + [(None, "en"), ("", None), (" . ,", "fr"), ("one two", "fr")]


@pytest.mark.parametrize("most_words,most_pairs", [(1 << 19, 1 << 18), (20, 10), (0, 0)])
def test_phrases_like_brute_force(spark, most_words, most_pairs):
    rows = prose(3, 250)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    got = collocations.collocations(docs, most_words=most_words, most_pairs=most_pairs)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == want
    assert {len(r[2].split(" ")) for r in want} == {2, 3} and "z" * 70 in " ".join(r[2] for r in want)


def test_top_is_cut_after_ranking(spark):
    rows = prose(8, 200)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert sorted(map(tuple, collocations.collocations(docs, top=7).collect())) == brute(rows, top=7)


def test_tiles_count_all_cells(monkeypatch):
    monkeypatch.setattr(collocations, "DENSE", 500)
    rng = np.random.default_rng(1)
    left = np.r_[rng.integers(0, 40, 5000), rng.integers(0, 1 << 19, 3000), rng.integers(1 << 20, 1 << 39, 50), rng.integers(1024, 1100, 4000)]
    right = np.r_[rng.integers(0, 40, 5000), rng.integers(0, 1 << 19, 3000), rng.integers(0, 99, 50), rng.integers(3000, 3020, 4000)]
    cells, counts = collocations.tiled_counts(left, right)
    assert dict(zip(cells.tolist(), counts.tolist())) == Counter(((left << 20) | right).tolist())
    assert len(set(cells.tolist())) == len(cells)
    none = np.zeros(0, dtype=np.int64)
    assert all(len(x) == 0 for x in collocations.tiled_counts(none, none))


def test_scores_pass_64_bits(spark):
    big = 4_000_000_000_000_000
    phrases = spark.createDataFrame([("en", "a b", big, 2), ("en", "b c", 3, 2)], "lang string, phrase string, f long, size int")
    words = spark.createDataFrame([("en", "a", big + 7), ("en", "b", big + 1), ("en", "c", 3)], "lang string, phrase string, f long")
    got = {r["phrase"]: r["score"] for r in collocations._scored(phrases, words).collect()}
    assert got == {"a b": 1000000 * big * big // ((big + 7) * (big + 1)), "b c": 1000000 * 9 // ((big + 1) * 3)}


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["text"], r["source"]) for r in odd_docs.select("text", "source").collect()]
    got = collocations.collocations(odd_docs, lang_col="source", least=2)
    assert sorted(map(tuple, got.collect())) == brute(rows, least=2)
    assert collocations.collocations(no_docs, lang_col="source").collect() == []
