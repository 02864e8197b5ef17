"""Language-model scores from Brown classes.

A word's probability after another is that of its class after the other's class, times that of the word
within its class. Classes come from exchange clustering: words move to the class that raises the
likelihood of the class bigrams most, given where all others stand. The counts a move needs, of each
word beside each class, are added up from the whole training text once a round; half of the words may
move in a round, so that neighbours don't move at once.

Words that don't fill a bounded table share one class of their own; how likely each of them is within
it is looked up by a join, so the counts kept grow with the text while what is broadcast does not.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepline.llm.common import field, head_of, stored, type_of

HEAD = (1 << 16) - 2  # words with ids; two more are the end and the rare words, 16 bits in all
WORD_BYTES = 64
CLASSES = 64
ROUNDS = 5
FOLDS, HELD_OUT = 7, 2
SMOOTHING = 0.1
HELD = 300_000
BLOCK = 256  # words to a block of counts
CHUNK = 1 << 20
MOVES = 64  # words judged at once
END = ""


def held_out(doc: Column) -> Column:
    """Whether a document is kept from training, by its id; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc = docs[id_col]
    return docs.select(
        F.monotonically_increasing_id().alias("key"),
        doc.alias("doc"),
        held_out(doc).alias("held_out"),
        docs[text_col].cast("binary").alias("text"),
    )


def token_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over training texts, an end for each text included; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "c"]
            )

        for batch in batches:
            for text in batch.column(0):
                held.update((text.as_py() or b"").lower().split())
                held[b""] += 1
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        yield out()

    return texts.where(~F.col("held_out")).select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def encoded(texts: DataFrame, ids: dict[bytes, int], rare: int) -> DataFrame:
    """(key, doc, held_out, n_tokens, ids, rare): the ids of the words as 16-bit numbers, and the words
    without one of their own, each with how often it occurs."""
    shared = texts.sparkSession.sparkContext.broadcast(ids)
    tail = T.ArrayType(T.StructType([field("word", T.StringType()), field("k", T.IntegerType())]))
    schema = T.StructType(
        [field("key", T.LongType()), texts.schema["doc"], field("held_out", T.BooleanType()), field("n_tokens", T.LongType()), field("ids", T.BinaryType()), field("rare", tail)]
    )
    kind = pa.list_(pa.struct([("word", pa.string()), ("k", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            numbers, others, sizes = [], [], []
            for text in batch.column("text"):
                words = (text.as_py() or b"").lower().split()
                got = np.fromiter(map(known.get, words, repeat(rare)), dtype=np.uint16, count=len(words))
                numbers.append(got.tobytes())
                sizes.append(len(words) + 1)
                other = Counter([words[i] for i in np.flatnonzero(got == rare).tolist()])
                others.append([{"word": w.decode(), "k": k} for w, k in other.items()])
            columns = [*(batch.column(c) for c in ("key", "doc", "held_out")), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers, pa.binary()), pa.array(others, kind)], schema.names)

    return texts.select("key", "doc", "held_out", "text").mapInArrow(run, schema)


def _bigrams(ids: bytes, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each token and the one before it; the first follows the end of the text before."""
    words = np.frombuffer(ids, dtype=np.uint16).astype(np.int64)
    return np.r_[end, words], np.r_[words, end]


def contexts(rows: DataFrame, classes: np.ndarray, n_classes: int, end: int) -> DataFrame:
    """(block, counts): for each block of words how often each class follows and precedes each word, and
    how often the word follows itself: int64 of [BLOCK, 2 * n_classes + 1], stored."""
    shared = rows.sparkSession.sparkContext.broadcast(classes)
    n_words, width = len(classes), 2 * n_classes + 1
    blocks, chunk, size = -(-n_words // BLOCK), CHUNK, BLOCK

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.astype(np.int64)
        sums = np.zeros((blocks * size, width), dtype=np.uint32)
        cells = blocks * size * n_classes
        before: list[np.ndarray] = []
        after: list[np.ndarray] = []
        held = 0

        def add() -> None:
            a, b = np.concatenate(before), np.concatenate(after)
            sums[:, :n_classes] += np.bincount(a * n_classes + of[b], minlength=cells).reshape(-1, n_classes).astype(np.uint32)
            sums[:, n_classes:-1] += np.bincount(b * n_classes + of[a], minlength=cells).reshape(-1, n_classes).astype(np.uint32)
            sums[:, -1] += np.bincount(a[a == b], minlength=blocks * size).astype(np.uint32)

        for batch in batches:
            for ids in batch.column(0):
                a, b = _bigrams(ids.as_py(), end)
                before.append(a)
                after.append(b)
                held += len(a)
                if held >= chunk:
                    add()
                    before, after, held = [], [], 0
        if before:
            add()
        pack = zstandard.ZstdCompressor(level=1).compress
        for i in range(blocks):
            some = sums[i * size : (i + 1) * size]
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pack(some.T.tobytes())], pa.binary())], ["block", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        last, sums = -1, np.zeros((size, width), dtype=np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["block", "counts"])

        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if block != last:
                    if last >= 0:
                        yield out()
                    last, sums = block, np.zeros((size, width), dtype=np.int64)
                sums += np.frombuffer(unpack(blob.as_py()), dtype=np.uint32).reshape(width, size).T
        if last >= 0:
            yield out()

    kind = "block int, counts binary"
    sent = rows.mapInArrow(counted, kind)
    return stored(sent.repartition("block").sortWithinPartitions("block").mapInArrow(added, kind))


def transitions(counts: DataFrame, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """How often each class follows each: from the blocks of words, each of which sends n_classes squared numbers."""
    shared = counts.sparkSession.sparkContext.broadcast(classes)
    size = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_classes, n_classes), dtype=np.int64)
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                of = shared.value[block * size : (block + 1) * size]
                rows = np.frombuffer(blob.as_py(), dtype=np.int64).reshape(size, -1)[: len(of), :n_classes]
                np.add.at(total, of, rows)
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(total[a, b])], ["a", "b", "n"])

    out = np.zeros((n_classes, n_classes), dtype=np.int64)
    for r in counts.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        out[r["a"], r["b"]] = r["n"]
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(m: np.ndarray) -> float:
    """The part of the log-likelihood of the training text that the classes decide (natural logarithm)."""
    return float(_xlogx(m).sum() - _xlogx(m.sum(axis=0)).sum() - _xlogx(m.sum(axis=1)).sum())


def gains(m: np.ndarray, own: np.ndarray, right: np.ndarray, left: np.ndarray, self_: np.ndarray, targets: int) -> np.ndarray:
    """[words, targets]: what `likelihood` gains if the word leaves its class for each of the first ones.

    right and left count the classes after and before each word, self_ the word after itself.
    """
    n, g = right.shape
    at = np.arange(n)
    m = m.astype(float)
    right, left, self_ = right.astype(float), left.astype(float), self_.astype(float)
    out_total, in_total = right.sum(axis=1), left.sum(axis=1)
    row, column = m.sum(axis=1), m.sum(axis=0)
    # without the word: its own class loses its contexts, and its contexts lose what was the word itself
    right_own, left_own = right[at, own] - self_, left[at, own] - self_
    f = _xlogx
    rest_row = m[own] - right  # row of its class, by following class; [own] is put right below
    rest_column = m[:, own].T - left
    rest_own = m[own, own] - right[at, own] - left[at, own] + self_
    drop_row, drop_column = f(rest_row) - f(m[own]), f(rest_column) - f(m[:, own].T)
    drop_row[at, own] = drop_column[at, own] = 0.0
    base = drop_row.sum(axis=1) + drop_column.sum(axis=1) + f(rest_own) - f(m[own, own])
    base -= f(row[own] - out_total) - f(row[own]) + f(column[own] - in_total) - f(column[own])
    # with the word in class b
    after, before = right.copy(), left.copy()
    after[at, own], before[at, own] = right_own, left_own
    b = np.arange(targets)
    gain_row = f(m[None, :targets, :] + after[:, None, :]) - f(m)[None, :targets, :]
    gain_column = f(m.T[None, :targets, :] + before[:, None, :]) - f(m.T)[None, :targets, :]
    # cells that both changes touch: (b, b), (b, own) and (own, b)
    gain_row[:, b, b] = gain_column[:, b, b] = 0.0
    gain_row[at, :, own] = gain_column[at, :, own] = 0.0
    total = base[:, None] + gain_row.sum(axis=2) + gain_column.sum(axis=2)
    total += f(m[b, b][None, :] + right[:, :targets] + left[:, :targets] + self_[:, None]) - f(m[b, b])[None, :]
    to_own = m[:targets, own].T  # (b, own): loses what preceded the word, gains what of its class follows it
    total += f(to_own - left[:, :targets] + right_own[:, None]) - f(to_own - left[:, :targets])
    from_own = m[own][:, :targets]
    total += f(from_own - right[:, :targets] + left_own[:, None]) - f(from_own - right[:, :targets])
    total -= f(row[None, :targets] + out_total[:, None]) - f(row)[None, :targets]
    total -= f(column[None, :targets] + in_total[:, None]) - f(column)[None, :targets]
    inside = own < targets
    total[at[inside], own[inside]] = 0.0
    return total


def moved(counts: DataFrame, classes: np.ndarray, m: np.ndarray, targets: int, n_words: int, turn: int) -> np.ndarray:
    """The classes after every second word of the first n_words has gone where it raises the likelihood most."""
    shared = counts.sparkSession.sparkContext.broadcast((classes, m))
    n_classes, size, step = len(m), BLOCK, MOVES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, matrix = shared.value
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = np.frombuffer(blob.as_py(), dtype=np.int64).reshape(size, -1)
                word = np.arange(block * size, min((block + 1) * size, n_words))
                word = word[(word + turn) % 2 == 0]
                for i in range(0, len(word), step):
                    w = word[i : i + step]
                    own = rows[w - block * size]
                    gain = gains(matrix, of[w], own[:, :n_classes], own[:, n_classes:-1], own[:, -1], targets)
                    best = gain.argmax(axis=1)
                    go = gain[np.arange(len(w)), best] > 1e-9
                    yield pa.RecordBatch.from_arrays([pa.array(w[go], pa.int32()), pa.array(best[go], pa.int32())], ["word", "class"])

    found = counts.mapInArrow(run, "word int, class int").toArrow()
    out = classes.copy()
    out[found.column("word").to_numpy()] = found.column("class").to_numpy()
    return out


@dataclass
class ClassModel:
    """Words by id, their classes, and counts. The end has id and class of its own, so have rare words."""

    ids: dict[bytes, int]
    c: np.ndarray  # by id; 0 for the rare words
    classes: np.ndarray  # by id
    m: np.ndarray  # class bigrams
    n_train: int
    n_distinct: int
    likelihoods: list[float]

    @property
    def end(self) -> int:
        return len(self.ids)

    @property
    def rare_total(self) -> int:
        """Rare tokens and rare words of the training text, and one for all words it hasn't."""
        return int(self.n_train - self.c.sum()) + (self.n_distinct - int((self.c > 0).sum())) + 1

    def log_transitions(self, smoothing: float = SMOOTHING) -> np.ndarray:
        """log10 P(class | class before), additively smoothed."""
        m = self.m + smoothing
        return np.log10(m / m.sum(axis=1, keepdims=True))

    def log_emissions(self) -> np.ndarray:
        """log10 P(word | its class) by id; 0 for the rare words, whose part is log10((c + 1) / rare_total)."""
        total = np.bincount(self.classes, weights=self.c, minlength=len(self.m))
        share = self.c / np.maximum(total[self.classes], 1)
        share[self.end + 1] = 1.0
        return np.log10(np.where(share > 0, share, 1.0))


def fit(rows: DataFrame, head: list[tuple[str, int]], n_ends: int, n_train: int, n_distinct: int, classes: int = CLASSES, rounds: int = ROUNDS) -> ClassModel:
    """A model of the stored training rows (`encoded`), words dealt to classes by rank and then exchanged.

    The classes with the highest likelihood of all rounds are kept.
    """
    n = len(head)
    end, g = n, classes + 2
    of = np.r_[np.arange(n) % classes, classes, classes + 1].astype(np.int64)
    best, found = None, []
    for turn in range(rounds + 1):
        counts = contexts(rows, of, g, end)
        m = transitions(counts, of, g)
        found.append(likelihood(m.astype(float)))
        if best is None or found[-1] > best[0]:
            best = (found[-1], of, m)
        if turn < rounds:
            of = moved(counts, of, m, classes, n, turn)
    ids = {w.encode(): i for i, (w, _) in enumerate(head)}
    c = np.array([k for _, k in head] + [n_ends, 0], dtype=np.int64)
    return ClassModel(ids, c, best[1], best[2], n_train, n_distinct, found)


def trained(docs: DataFrame, id_col: str, text_col: str, head: int, classes: int, rounds: int) -> tuple[ClassModel, DataFrame, DataFrame]:
    """The model, the stored token counts and the stored encoded texts of all documents."""
    texts = _texts(docs, id_col, text_col)
    counts = stored(token_counts(texts))
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("word") == END, F.col("c"))).alias("ends")).first()
    short = counts.where((F.octet_length("word") <= WORD_BYTES) & (F.col("word") != END))
    table = head_of(short, "c", head)[0].toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    words = list(zip(table.column("word").to_pylist(), table.column("c").to_pylist()))
    rows = stored(encoded(texts, {w.encode(): i for i, (w, _) in enumerate(words)}, len(words) + 1))
    model = fit(rows.where(~F.col("held_out")).select("ids"), words, total["ends"] or 0, total["n"] or 0, total["v"] or 0, classes, rounds)
    return model, counts, rows


def score_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    head: int = HEAD,
    classes: int = CLASSES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity), one row per row of docs.

    Scores are log10 probabilities of the words and the end of the text, base_score by add-one word
    counts, score by the class model; perplexity is that of score per token. The model learns from
    documents that `held_out` leaves. A null or empty text is one end; a null id counts as an empty text;
    repeated rows are learned and scored each; other columns are not looked at; no rows give no rows. With
    no training text every base probability is 1. `head` is at most HEAD; among words as frequent as the
    last that fits, all or none have ids.
    """
    if head > HEAD:
        raise ValueError(f"at most {HEAD} words can have ids")
    model, counts, rows = trained(docs, id_col, text_col, head, classes, rounds)
    size = float(model.n_train + model.n_distinct + 1)
    plain = (model.classes, model.c, model.log_transitions(), model.log_emissions(), np.log10(model.c + 1.0), model.end)
    shared = docs.sparkSession.sparkContext.broadcast(plain)
    name = type_of(docs, id_col)
    schema = T.StructType(
        [field("key", T.LongType()), field("doc", name), field("held_out", T.BooleanType()), field("n_tokens", T.LongType()),
         field("known", T.LongType()), field("base", T.DoubleType()), field("own", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, c, follows, within, log_c, end = shared.value
        for batch in batches:
            got = []
            for ids in batch.column("ids"):
                before, after = _bigrams(ids.as_py(), end)
                got.append((int((c[after] > 0).sum()), float(log_c[after].sum()), float((follows[of[before], of[after]] + within[after]).sum())))
            known, base, own = zip(*got) if got else ((), (), ())
            columns = [*(batch.column(x) for x in ("key", "doc", "held_out", "n_tokens"))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())], schema.names)

    scored = rows.select("key", "doc", "held_out", "n_tokens", "ids").mapInArrow(run, schema)
    tail = rows.select("key", F.explode("rare").alias("r")).select("key", "r.word", "r.k").join(counts, "word", "left")
    seen = F.coalesce("c", F.lit(0)) + 1.0
    rest = tail.groupBy("key").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known_rare"),
        F.sum(F.col("k") * F.log10(seen)).alias("base_rare"),
        F.sum(F.col("k") * F.log10(seen / F.lit(float(model.rare_total)))).alias("own_rare"),
    )
    none = {"known_rare": 0, "base_rare": 0.0, "own_rare": 0.0}
    score = F.col("own") + F.col("own_rare")
    return scored.join(rest, "key", "left").fillna(none).select(
        F.col("doc").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("known_rare")).alias("n_known"),
        F.lit(int(model.n_train)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("base_rare") - F.col("n_tokens") * F.log10(F.lit(size))).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
