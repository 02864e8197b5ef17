"""Spelling variants: words one edit apart, found in both directions of an FM-index.

A word one edit away from another shares its left half or its right half exactly, the edit being in the
rest. The index of the delimited words is kept for both reading directions: one has intervals of
suffix ranks that grow to the left, the other, over the words read backwards, intervals that grow to
the right. A search starts at the delimiter, matches the near half exactly and goes on across the
other, where it allows one edit, up to the delimiter at the far end.

The vocabulary is cut by length and spelling into blocks of a bounded number of words, each an index of
its own; a word is looked for in the blocks whose range meets its exact half and a length that one edit
allows, so a common half is shared by several tasks and no pair is looked at twice.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepline.llm.common import stored

LETTERS = 5
OCCURRENCES = 3
SLIP = 97
BLOCK = 20_000
SAMPLED = 16
HELD = 300_000
QUERIES = 8192

#: Runs of A-Z, a-z and U+00C0 to U+00FF, in UTF-8 and lower case.
RUN = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")


# ---- words


def run_counts(text: bytes, doc: str, letters: int = LETTERS, slip: int = SLIP) -> Counter:
    """The words of one text and how often each stands in it."""
    start = crc32(f"{doc}:".encode())
    found: Counter = Counter()
    for run, k in Counter(RUN.findall(text.lower())).items():
        if len(run) < letters:
            continue
        h = crc32(run, start)
        if h % slip == 0:
            word = run.decode()
            at = h % len(word)
            run = (word[:at] + word[at + 1 :]).encode()
        found[run] += k
    return found


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS) -> DataFrame:
    """(word, n) over all texts, words of at least `letters` code points; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.update(run_counts(text.as_py() or b"", doc, letters))
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    rows = docs.select(
        F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("doc"), docs[text_col].cast("binary").alias("text")
    )
    return rows.mapInArrow(run, "word string, n long").where(F.length("word") >= letters).groupBy("word").agg(F.sum("n").alias("n"))


# ---- the index of one block


class Index:
    """FM-index of delimited words, matched from the last symbol to the first.

    The suffixes of all words, each up to its delimiter, are ranked; equal ones by their word. `step`
    turns the first rank of the suffixes that start with X into that of those that start with cX.
    """

    def __init__(self, words: list[str]) -> None:
        codes = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le"), dtype="<u4")
        self.alphabet = np.unique(codes)
        symbol = np.searchsorted(self.alphabet, codes)
        n = self.size = len(symbol)
        self.words = len(words)
        ends = np.flatnonzero(symbol == 0)
        own_end = np.repeat(ends, np.diff(np.r_[-1, ends]))
        rank, known, reach = symbol, len(self.alphabet), 1
        while known < n:
            ahead = np.arange(n) + reach
            after = np.where(ahead <= own_end, rank[np.minimum(ahead, n - 1)] + 1, 0)
            values, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
            if len(values) == known:
                break
            known, reach = len(values), 2 * reach
        order = np.argsort(rank, kind="stable")
        starts = np.r_[True, symbol[:-1] == 0][order]
        self.before = np.where(starts, 0, symbol[order - 1])  # the Burrows-Wheeler transform
        by_symbol = np.argsort(self.before, kind="stable")
        self.keys = self.before[by_symbol] * n + by_symbol
        self.whole = np.searchsorted(ends, order[starts])  # words in the order of their own ranks

    def symbols(self, words: list[str], width: int) -> np.ndarray:
        """Words of one length as rows of symbols, last letter first; a letter the block hasn't: no match."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), width)[:, ::-1]
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at, len(self.alphabet))

    def step(self, symbol: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, symbol * self.size + rank)

    def children(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each interval the symbols before it and the intervals that they lead to: the first child of
        each interval and the end of the list, then symbol, lo and hi of each child."""
        size = hi - lo
        owner = np.repeat(np.arange(len(lo)), size)
        rows = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        width = len(self.alphabet) + 1
        code = np.unique(owner * width + self.before[rows])
        owner, symbol = code // width, code % width
        owner, symbol = owner[symbol > 0], symbol[symbol > 0]
        return np.searchsorted(owner, np.arange(len(lo) + 1)), symbol, self.step(symbol, lo[owner]), self.step(symbol, hi[owner])

    def exactly(self, pattern: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, ...]:
        """Queries and intervals that are left after the symbols start..stop."""
        for j in range(start, stop):
            lo, hi = self.step(pattern[q, j], lo), self.step(pattern[q, j], hi)
            left = hi > lo
            q, lo, hi = q[left], lo[left], hi[left]
        return q, lo, hi

    def one_edit(self, pattern: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, word): words that end as the pattern's first `half` symbols say and are one edit away."""
        m = pattern.shape[1]
        found = []

        def ended(q: np.ndarray, lo: np.ndarray, hi: np.ndarray, start: int) -> None:
            q, lo, hi = self.exactly(pattern, q, lo, hi, start, m)
            first, last = self.step(0, lo), self.step(0, hi)
            whole = last > first
            found.append((q[whole], self.whole[first[whole]]))

        q = np.arange(len(pattern))
        q, lo, hi = self.exactly(pattern, q, np.zeros(len(q), dtype=np.int64), np.full(len(q), self.words), 0, half)
        for j in range(half, m + 1):
            if not len(q):
                break
            shared, of = np.unique(lo * (self.size + 1) + hi, return_inverse=True)
            first, symbol, to_lo, to_hi = self.children(shared // (self.size + 1), shared % (self.size + 1))
            many = first[of + 1] - first[of]
            who = np.repeat(np.arange(len(q)), many)
            child = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[of], many)
            if j < m:
                other = symbol[child] != pattern[q[who], j]
                who, child = who[other], child[other]
                ended(q[who], to_lo[child], to_hi[child], j + 1)  # replaced
                gone = (pattern[q, j] != pattern[q, j + 1]) if j + 1 < m else np.ones(len(q), dtype=bool)
                ended(q[gone], lo[gone], hi[gone], j + 1)  # deleted, the last of equal symbols
            ended(q[who], to_lo[child], to_hi[child], j)  # inserted, after equal symbols
            if j < m:
                q, lo, hi = self.exactly(pattern, q, lo, hi, j, j + 1)
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (q, q)


def near_in_block(words: list[str], counts: np.ndarray, queries: list[str], backwards: bool) -> list[tuple[str, int, int, str]]:
    """(query, near words here, n of the largest of them, that word) for queries with any.

    `words` are sought by their exact left half; backwards: by the right half, and only those that don't
    share the left half as well.
    """
    index = Index([w if backwards else w[::-1] for w in words])
    place = np.empty(len(words), dtype=np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    out: list[tuple[str, int, int, str]] = []
    by_length: dict[int, list[str]] = {}
    for query in queries:
        by_length.setdefault(len(query), []).append(query)
    for m, same in by_length.items():
        half = m - m // 2 if backwards else m // 2
        for i in range(0, len(same), QUERIES):
            some = same[i : i + QUERIES]
            q, w = index.one_edit(index.symbols([x if backwards else x[::-1] for x in some], m), half)
            if backwards:
                heads = [x[: m // 2] for x in some]
                new = np.array([not words[b].startswith(heads[a]) for a, b in zip(q.tolist(), w.tolist())], dtype=bool)
                q, w = q[new], w[new]
            order = np.lexsort((place[w], -counts[w], q))
            q, w = q[order], w[order]
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][: len(q)])
            number = np.diff(np.r_[first, len(q)])
            for a, k, b in zip(q[first].tolist(), number.tolist(), w[first].tolist()):
                out.append((some[a], k, int(counts[b]), words[b]))
    return out


# ---- the whole vocabulary


def _splitters(words: DataFrame, n_words: int, block: int) -> tuple[list, list]:
    """Where blocks begin, by (length, word) and by (length, word read backwards), from a sample of about
    SAMPLED words a block. It evens out the blocks only; the result does not depend on it."""
    blocks, every = -(-n_words // block), max(1, block // SAMPLED)
    some = [r[0] for r in words.where(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).select("word").collect()]

    def cuts(keys: list[tuple[int, str]]) -> list[tuple[int, str]]:
        return sorted({keys[i * len(keys) // blocks] for i in range(1, blocks)}) if keys else []

    return cuts(sorted((len(w), w) for w in some)), cuts(sorted((len(w), w[::-1]) for w in some))


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, form, form_n) of words (word, n) that have near words: how many are one edit away, and
    the one with the largest n, of several the smallest in code-point order. Words are distinct."""
    n_words = words.count()
    splitters = _splitters(words, n_words, block)
    apart = len(splitters[0]) + 1

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, kind, word, n = [], [], [], []
            for w, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m = len(w)
                for backwards, cut in enumerate(splitters):
                    key = w[::-1] if backwards else w
                    head = key[: m - m // 2 if backwards else m // 2]
                    meets = {
                        b
                        for length in (m - 1, m, m + 1)
                        for b in range(bisect_right(cut, (length, head)), bisect_right(cut, (length, head + "\U0010ffff")) + 1)
                    }
                    own = bisect_right(cut, (m, key))
                    rows = [(own, 0, k), *((b, 1, 0) for b in sorted(meets))]
                    where += [b + backwards * apart for b, _, _ in rows]
                    kind += [x for _, x, _ in rows]
                    n += [x for _, _, x in rows]
                    word += [w] * len(rows)
            columns = [pa.array(where, pa.int32()), pa.array(kind, pa.int32()), pa.array(word, pa.string()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "kind", "word", "n"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known, counts, queries = -1, [], [], []

        def out() -> pa.RecordBatch:
            found = near_in_block(known, np.array(counts, dtype=np.int64), queries, last >= apart) if known and queries else []
            columns = list(zip(*found)) if found else [(), (), (), ()]
            types = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["word", "n_near", "form_n", "form"])

        for batch in batches:
            for b, kind, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if b != last:
                    if last >= 0:
                        yield out()
                    last, known, counts, queries = b, [], [], []
                if kind:
                    queries.append(word)
                else:
                    known.append(word)
                    counts.append(n)
        if last >= 0:
            yield out()

    sent = words.select("word", "n").mapInArrow(dealt, "block int, kind int, word string, n long")
    together = sent.repartition("block").sortWithinPartitions("block")
    parts = together.mapInArrow(searched, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")
    )


def roots(links: DataFrame) -> DataFrame:
    """(word, root): where the chain of (word, form) that starts at each word ends, by doubling its steps.

    Chains have no circles, since a form occurs at least twice as often as its word.
    """
    now = stored(links.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = stored(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    letters: int = LETTERS,
    occurrences: int = OCCURRENCES,
    block: int = BLOCK,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word of `letters` code points that occurs
    `occurrences` times or more in all texts together.

    form is the near word of largest n (ties: the smallest in code-point order) if that n is at least
    twice the word's own, else null; root is the last of the forms, the word itself if there is none.
    Null and empty texts have no words, a null id counts as an empty one, repeated rows count each time,
    other columns are not looked at. No words give an empty result. Texts of any length are read whole,
    one at a time; a word longer than a block's others only makes its own index larger.
    """
    words = stored(word_counts(docs, id_col, text_col, letters).where(F.col("n") >= occurrences))
    found = near_words(words, block)
    judged = words.join(found, "word", "left").withColumn("close", F.col("form_n") >= 2 * F.col("n"))
    judged = stored(
        judged.select(
            "word",
            F.when(F.col("close"), F.col("form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(F.col("close"), F.col("form_n")).alias("form_n"),
        )
    )
    ends = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
