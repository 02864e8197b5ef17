from __future__ import annotations

import random

from keepline.llm.token_counts import VOCABULARY, Automaton, read_ranks, token_counts


def greedy(word: bytes, pieces: set[bytes], inner: bytes = b"") -> int:
    """Longest piece first, building every piece."""
    at, n = 0, 0
    while at < len(word):
        mark = inner if at else b""
        end = next((e for e in range(len(word), at, -1) if mark + word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_small_vocabularies_against_greedy_matching():
    rng = random.Random(9)
    for _ in range(400):
        pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        automaton = Automaton(pieces)
        for _ in range(30):
            word = bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 12)))
            assert automaton.count(word) == greedy(word, pieces)


def test_marked_pieces_against_greedy_matching():
    rng = random.Random(10)
    for _ in range(400):
        pieces = set()
        for _ in range(rng.randint(1, 14)):
            piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 4)))
            pieces.add(b"##" + piece if rng.random() < 0.5 else piece)
        automaton = Automaton(pieces, b"##")
        for _ in range(30):
            word = bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 10)))
            assert automaton.count(word) == greedy(word, pieces, b"##")


def test_public_vocabulary(docs, rows):
    pieces = read_ranks(VOCABULARY)
    known = set(pieces)
    got = {r.doc_id: r for r in token_counts(docs, pieces).collect()}
    seen: dict[bytes, int] = {}
    for i, t in rows:
        words = (t or "").encode().split()
        assert got[i].n_words == len(words)
        for w in words:
            if w not in seen:
                seen[w] = greedy(b" " + w, known)
        assert got[i].n_tokens == sum(seen[w] for w in words)


def test_long_words_are_linear_and_right():
    automaton = Automaton([b"a", b"aa", b"aaaa", b"aaaaab"])
    assert automaton.count(b"a" * 200_003) == 50_000 + 2
    assert automaton.count(b"") == 0


def test_odd_rows_and_empty_table(odd_docs, no_docs):
    got = token_counts(odd_docs, [b"a"]).collect()
    assert len(got) == 8 and {r.n_tokens for r in got if r.n_words == 0} == {0}
    assert token_counts(no_docs, [b"a"]).count() == 0
