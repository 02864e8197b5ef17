from __future__ import annotations

import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepline.llm import class_model


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w]


def held(doc) -> bool:
    return crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


def brute(rows, model):
    """Counts from the definition; class probabilities one token at a time."""
    c = Counter()
    for doc, text in rows:
        if not held(doc):
            c.update(words_of(text) + [""])
    n, v = sum(c.values()), len(c)
    g = len(model.m)
    number = {w.decode(): i for w, i in model.ids.items()} | {"": model.end}
    class_of = lambda w: model.classes[number[w]] if w in number else g - 1
    m = np.zeros((g, g))
    for doc, text in rows:
        if not held(doc):
            s = ["", *words_of(text), ""]
            for a, b in zip(s, s[1:]):
                m[class_of(a), class_of(b)] += 1
    np.testing.assert_array_equal(m, model.m)
    total = Counter()
    for w, k in c.items():
        total[class_of(w)] += k
    rare = [w for w in c if w not in number]
    out = []
    for doc, text in rows:
        s, base, score = ["", *words_of(text), ""], 0.0, 0.0
        for a, b in zip(s, s[1:]):
            base += math.log10((c[b] + 1) / (n + v + 1))
            i, j = class_of(a), class_of(b)
            score += math.log10((m[i, j] + 0.1) / (m[i].sum() + 0.1 * g))
            if b not in number:
                score += math.log10((c[b] + 1) / (sum(c[w] for w in rare) + len(rare) + 1))
            elif c[b]:
                score += math.log10(c[b] / total[j])
        out.append((doc, held(doc), len(s) - 1, sum(c[w] > 0 for w in s[1:]), n, base, score))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:7] for r in got], [r[5:7] for r in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("head", [class_model.HEAD, 60])
def test_scores_like_brute_force(spark, rows, docs, head):
    docs = docs.repartition(4)
    model, _, _ = class_model.trained(docs, "doc_id", "text", head, 8, 2)
    assert (len(model.ids) <= 60) == (head == 60)
    got = class_model.score_texts(docs, head=head, classes=8, rounds=2)
    same([tuple(r)[:7] for r in got.collect()], brute(rows, model))


def test_gains_are_those_of_the_likelihood():
    """Every move of every word, against the likelihood of the text with the word in its new class."""
    rng = np.random.default_rng(3)
    n, targets, g = 14, 4, 6
    text = np.r_[rng.integers(0, n, 400), np.repeat(rng.integers(0, n, 20), 3), n, n + 1, 5, n, 7]
    of = np.r_[rng.integers(0, targets, n), 4, 5]

    def matrix(of):
        m = np.zeros((g, g))
        np.add.at(m, (of[text[:-1]], of[text[1:]]), 1)
        return m

    right, left, self_ = np.zeros((n, g)), np.zeros((n, g)), np.zeros(n)
    for a, b in zip(text, text[1:]):
        if a < n:
            right[a, of[b]] += 1
            self_[a] += a == b
        if b < n:
            left[b, of[a]] += 1
    got = class_model.gains(matrix(of), of[:n], right, left, self_, targets)
    for w in range(n):
        for b in range(targets):
            new = of.copy()
            new[w] = b
            want = class_model.likelihood(matrix(new)) - class_model.likelihood(matrix(of))
            assert got[w, b] == pytest.approx(want, abs=1e-8)


def grammar(rng: random.Random, n: int) -> list[tuple[int, str]]:
    """Texts of three kinds of words that follow each other in turn."""
    kinds = [[f"{k}{i}" for i in range(30)] for k in ("noun", "verb", "end")]
    return [(i, " ".join(rng.choice(kinds[j % 3]) for j in range(rng.randint(3, 60)))) for i in range(n)]


def test_classes_are_found_and_held_out_texts_gain(spark):
    docs = spark.createDataFrame(grammar(random.Random(1), 400), "doc_id long, text string").repartition(3)
    model, _, _ = class_model.trained(docs, "doc_id", "text", 1000, 3, 8)
    assert model.likelihoods[-1] > model.likelihoods[0]
    kinds = {w.decode().rstrip("0123456789"): set() for w in model.ids}
    for w, i in model.ids.items():
        kinds[w.decode().rstrip("0123456789")].add(int(model.classes[i]))
    assert all(len(k) == 1 for k in kinds.values()) and len(set.union(*kinds.values())) == 3
    got = class_model.score_texts(docs, head=1000, classes=3, rounds=8).where("held_out")
    sums = got.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.max("perplexity").alias("p"), F.sum("n_tokens").alias("n")).first()
    assert (sums["s"] - sums["b"]) / sums["n"] > 0.4 and sums["p"] < 60


def test_probabilities_add_up(spark, docs):
    model, counts, _ = class_model.trained(docs, "doc_id", "text", 60, 8, 1)
    np.testing.assert_allclose((10 ** model.log_transitions()).sum(axis=1), 1)
    share = 10 ** model.log_emissions()
    for k in range(len(model.m) - 1):
        of_class = (model.classes == k) & (model.c > 0)
        assert not of_class.any() or share[of_class].sum() == pytest.approx(1)
    rare = [r["c"] for r in counts.collect() if r["word"] and r["word"].encode() not in model.ids]
    assert (sum(c + 1 for c in rare) + 1) / model.rare_total == pytest.approx(1)


def test_odd_rows(spark, odd_docs, no_docs):
    got = class_model.score_texts(odd_docs, classes=4, rounds=1)
    assert got.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    model, _, _ = class_model.trained(odd_docs, "doc_id", "text", class_model.HEAD, 4, 1)
    same([tuple(r)[:7] for r in got.collect()], brute(rows, model))
    assert class_model.score_texts(no_docs).collect() == []
    only = spark.createDataFrame([(i, "some words") for i in range(60) if held(i)], "doc_id long, text string")
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in class_model.score_texts(only).collect()} == {(0, 0, 0.0)}
    with pytest.raises(ValueError):
        class_model.score_texts(no_docs, head=1 << 17)
