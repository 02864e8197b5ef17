"""Quality rules with an isolation forest on the rules' statistics.

Every document gets the counts of the usual rules. Trees of random splits, grown on small samples of
these counts, separate odd documents in few steps; the mean path length is the score. Where to cut is
read from labelled rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepline.llm.common import field, stored, type_of

TREES = 100
SAMPLE = 256
SEED = 7
BINS = 2000
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
EULER = 0.5772156649015329


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of `width` words that occur twice or more, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*[words[i:] for i in range(width)]))
    if len(set(windows)) == n:
        return 0
    seen = Counter(windows)
    total, end = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + width - max(end, i)
            end = i + width
    return total


def counts_of(text: bytes | None) -> tuple[int, ...]:
    """COUNTS of one text; null: all zero."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.split()] if b"\n" in text else [text] * bool(words)
    chars = sum(map(len, words)) if text.isascii() else len(b"".join(words).decode("utf-8", "replace"))
    return (
        len(words),
        chars,
        sum(text.count(s) for s in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, *COUNTS), one row per row of docs."""
    schema = T.StructType([field("doc", type_of(docs, id_col)), *[field(c, T.LongType()) for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([counts_of(t.as_py()) for t in batch.column(1)], dtype=np.int64)
            got = got.reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(got[:, i]) for i in range(len(COUNTS))]], ["doc", *COUNTS]
            )

    return docs.select(docs[id_col].alias("doc"), docs[text_col].cast("binary").alias("text")).mapInArrow(run, schema)


def features(counts: np.ndarray) -> np.ndarray:
    """What the forest splits on: mean word length, symbols a word, and the share of repeated words.

    Sizes are left out: a document is not odd for being long or short.
    """
    words, chars, symbols, _, repeat, _ = (counts[:, i].astype(float) for i in range(len(COUNTS)))
    n = np.maximum(words, 1)
    return np.column_stack([chars / n, symbols / n, repeat / n])


@dataclass
class Forest:
    """Trees as arrays: split column (-1: leaf), split value, left child (right is next), path length."""

    column: np.ndarray
    value: np.ndarray
    child: np.ndarray
    length: np.ndarray
    roots: np.ndarray
    sample: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path length / expected length): near 1 odd, below 0.5 ordinary."""
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        while True:
            col = self.column[at]
            if (col < 0).all():
                break
            step = self.child[at] + (x[rows, np.maximum(col, 0)] >= self.value[at])
            at = np.where(col < 0, at, step)
        return 2.0 ** (-self.length[at].mean(axis=1) / max(expected_length(self.sample), 1e-9))


def expected_length(n: int) -> float:
    """Mean length of an unsuccessful search in a random binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + EULER) - 2 * (n - 1) / n


def grow(samples: list[np.ndarray], seed: int = SEED) -> Forest:
    """One tree per sample, to the depth at which an average row would stand alone."""
    rng = np.random.default_rng(seed)
    size = max([len(s) for s in samples], default=0)
    limit = int(np.ceil(np.log2(max(size, 2))))
    column, value, child, length, roots = [], [], [], [], []

    def node() -> int:
        for xs, x in ((column, -1), (value, 0.0), (child, 0), (length, 0.0)):
            xs.append(x)
        return len(column) - 1

    for sample in samples:
        root = node()
        roots.append(root)
        todo = [(root, sample, 0)]
        while todo:
            at, rows, depth = todo.pop()
            low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
            open_columns = np.flatnonzero(high > low)
            if depth >= limit or len(rows) < 2 or not len(open_columns):
                length[at] = depth + expected_length(len(rows))
                continue
            c = int(rng.choice(open_columns))
            v = float(rng.uniform(low[c], high[c]))
            v = v if v > low[c] else float(high[c])
            column[at], value[at] = c, v
            left, right = node(), node()
            child[at] = left
            todo.append((left, rows[rows[:, c] < v], depth + 1))
            todo.append((right, rows[rows[:, c] >= v], depth + 1))
    return Forest(*(np.array(x) for x in (column, value, child, length)), np.array(roots, dtype=int), size)


def lowest_rows(counts: DataFrame, need: int, seed: int = SEED) -> np.ndarray:
    """COUNTS of the `need` rows that come first in the order of a hash, all rows if there are fewer.

    Only rows below a limit that about 2 * need of all rows fall under are looked at, equal ones once with
    their number, so that what all tasks together send does not grow with them; too few below it: the
    limit is doubled.
    """
    n = counts.count()
    order = F.xxhash64(F.lit(seed), "doc", *COUNTS)
    share = 2 * need / max(n, 1)
    while True:
        below = counts.select(*COUNTS, order.alias("o"))
        if share < 1:
            below = below.where(F.col("o") < F.lit(int(share * 2**64) - 2**63))
        rows = below.groupBy("o", *COUNTS).agg(F.count(F.lit(1)).alias("n")).orderBy("o", *COUNTS).limit(need).collect()
        if share >= 1 or sum(r["n"] for r in rows) >= need:
            break
        share *= 2
    got = np.array([tuple(r)[1:-1] for r in rows], dtype=np.int64).reshape(-1, len(COUNTS))
    times = np.array([min(r["n"], need) for r in rows], dtype=np.int64)
    return np.repeat(got, np.diff(np.minimum(np.r_[0, np.cumsum(times)], need)), axis=0)


def fit_forest(counts: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
    """A forest on trees x sample rows, drawn by hash from all rows: the method's own sub-sampling."""
    x = features(lowest_rows(counts, trees * sample, seed))
    each = max(1, min(sample, len(x) // trees or len(x)))
    return grow([x[i * each : (i + 1) * each] if len(x) >= trees * each else x for i in range(trees)], seed)


def scored(counts: DataFrame, forest: Forest) -> DataFrame:
    """counts with the column `anomaly`."""
    shared = counts.sparkSession.sparkContext.broadcast(vars(forest))  # plain arrays
    schema = T.StructType([*counts.schema.fields, field("anomaly", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown = Forest(**shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                some = batch.slice(i, 4096)
                got = np.column_stack([some.column(c).to_numpy(zero_copy_only=False) for c in COUNTS])
                score = grown.score(features(got))
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array(np.round(score, 9))], [*some.schema.names, "anomaly"]
                )

    return counts.mapInArrow(run, schema)


def calibrate(
    rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", spare: float = 0.01
) -> float:
    """The score above which a document goes: the cut that tells bad from good labelled rows best.

    Looked for among BINS cuts over all labelled rows that pass the base rules, and only where at most
    `spare` of the good ones lie above. Labels other than 0 and 1 and ids without a document don't
    count; an id with several labels counts as bad if any is. No bad labelled rows: nothing goes.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("doc")).agg(
        F.min(label_col).cast("int").alias("label")
    )
    binned = rows.where(~base_failed()).select(
        "doc", F.least(F.floor(F.col("anomaly") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")
    )
    tally = np.zeros((2, BINS + 1))
    for r in binned.join(known, "doc").groupBy("label", "bin").count().collect():
        tally[r["label"], r["bin"]] = r["count"]
    above = np.cumsum(tally[:, ::-1], axis=1)[:, ::-1]
    bad, good = above[0] / max(above[0, 0], 1), above[1] / max(above[1, 0], 1)
    gain = np.where(good <= spare, bad - good, -1.0)
    best = int(gain.argmax())
    return best / BINS if gain[best] > 0 else 2.0


def base_failed():
    """Too few words, or more than a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    label_col: str = "quality",
    trees: int = TREES,
    sample: int = SAMPLE,
    spare: float = 0.01,
    seed: int = SEED,
) -> DataFrame:
    """(id, *COUNTS, anomaly, base_failed, kept), one row per row of docs, with a null id or not.

    kept is false if the base rules fail or the anomaly score reaches the calibrated cut. A null text
    has no words and fails. Repeated rows get the same verdict. Empty docs give an empty result. A score
    equal to the cut goes, so documents of equal counts share their fate. Only the id and the text are
    looked at; texts of any length are counted whole, one at a time.
    """
    counts = stored(rule_counts(docs, id_col, text_col))
    rows = scored(counts, fit_forest(counts, trees, sample, seed))
    cut = calibrate(rows, labels, label_id_col, label_col, spare)
    return rows.select(
        F.col("doc").alias(id_col),
        *COUNTS,
        "anomaly",
        base_failed().alias("base_failed"),
        (~base_failed() & (F.col("anomaly") < cut)).alias("kept"),
    )
