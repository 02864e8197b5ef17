"""Collocations of two and three words, counted in tiles of frequency-ranked ids.

Frequent words get ids by rank. A pair is a cell of the square of ids, and the square is cut into tiles
of 1,024 by 1,024: those that fill up, next to the corner of the frequent words, are counted by address
(numpy bincount), all others as sorted coordinates. Frequent pairs are then ranked in their turn, and a
phrase of three words is a pair and a word in tiles of the same kind. Each task counts its own texts and
Spark adds the counts up by cell.

Only words that fill a bounded table have ids. Phrases with any other word are counted as text, so no
word is left out.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keepline.llm.common import head_of, stored

LEAST = 10
TOP = 2000
COVERED = 50
WORDS = 1 << 19  # of at most WORD_BYTES each: the words with ids
WORD_BYTES = 64
PAIRS = 1 << 18  # the pairs with ids
BITS = 20  # of an id in a cell's number
TILE = 10
CORNER = 16  # tiles each way that may fill up
DENSE = 1 << 16  # so many pairs in a tile are counted by address
CHUNK = 1 << 19
HELD = 300_000
SLOTS = 33_554_393  # of the bit map of frequent pairs, a prime below 2 ** 25
SLOT_BLOCK = 32_768
SALTS = 64

#: One mark for every character between pieces.
BREAKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z), and b"." between pieces."""
    return text.lower().translate(BREAKS).replace(b".", b" . ").split()


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].cast("binary").alias("text")
    )


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, f) of single words; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                words.pop(b".", None)
                columns = [pa.array([lang] * len(words), pa.string()), pa.array([w.decode() for w in words], pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(words.values(), pa.int64())], ["lang", "phrase", "f"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held[lang].update(tokens(text.as_py() or b""))
                if sum(map(len, held.values())) >= HELD:
                    yield from out()
        yield from out()

    counted = _texts(docs, text_col, lang_col).mapInArrow(run, "lang string, phrase string, f long")
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def tiled_counts(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different cells left << BITS | right, and how often each occurs."""
    row, column = left >> TILE, right >> TILE
    corner = (row < CORNER) & (column < CORNER)
    tile = np.where(corner, row * CORNER + column, CORNER * CORNER)
    cells, counts = [], []
    low = (1 << TILE) - 1
    for t in np.flatnonzero(np.bincount(tile, minlength=CORNER * CORNER)[: CORNER * CORNER] >= DENSE):
        some = tile == t
        dense = np.bincount((left[some] & low) << TILE | right[some] & low, minlength=1 << 2 * TILE)
        full = np.flatnonzero(dense)
        cells.append(((t // CORNER << TILE) + (full >> TILE)) << BITS | (t % CORNER << TILE) + (full & low))
        counts.append(dense[full])
        tile[some] = -1
    rest = np.sort((left[tile >= 0] << BITS) | right[tile >= 0])
    first = np.flatnonzero(np.r_[True, rest[1:] != rest[:-1]][: len(rest)])
    cells.append(rest[first])
    counts.append(np.diff(np.r_[first, len(rest)]))
    return np.concatenate(cells).astype(np.int64), np.concatenate(counts).astype(np.int64)


class Ranked:
    """Ids by rank, handed to the tasks: words by language, frequent pairs, and a bit for each frequent pair."""

    def __init__(self, words: dict[str, dict[bytes, int]], whole: bool) -> None:
        self.words = words
        self.whole = whole  # all frequent words have ids
        self.bits: np.ndarray | None = None
        self.pairs = self.pair_ids = self.by_id = np.zeros(0, dtype=np.int64)


def _phrases(docs: DataFrame, ranked: Ranked, width: int) -> tuple[DataFrame, DataFrame | None]:
    """(cell, f) of phrases of `width` words that all have ids, and (phrase, f) with lang of those that
    have not, None where no frequent word is without.

    Phrases of three are counted only where the bits of both their pairs are set: others can't be frequent.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(ranked))
    chunk, held_most = CHUNK, HELD

    def numbers(lang: str, words: list[bytes]) -> np.ndarray:
        ids = shared.value["words"].get(lang, {})
        return np.fromiter(map(ids.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def frequent(pair: np.ndarray) -> np.ndarray:
        slot = np.maximum(pair, 0) % SLOTS
        return (pair >= 0) & ((shared.value["bits"][slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)

    def cells(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] << BITS | ids[1:], -1)
        if width == 2:
            some = pair >= 0
            return tiled_counts(ids[:-1][some], ids[1:][some])
        often = frequent(pair)
        some = np.flatnonzero(often[:-1] & often[1:])
        pair, word = pair[some], ids[some + 2]
        pairs, by_id = shared.value["pairs"], shared.value["by_id"]
        if not len(pairs):
            return tiled_counts(pair + (1 << BITS), word)
        at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
        left = np.where(pairs[at] == pair, shared.value["pair_ids"][at], pair + (1 << BITS))
        got, count = tiled_counts(left, word)
        left, word = got >> BITS, got & ((1 << BITS) - 1)
        pair = np.where(left < len(by_id), by_id[np.minimum(left, len(by_id) - 1)], left - (1 << BITS))
        return pair << BITS | word, count

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, size = [], 0

        def out() -> pa.RecordBatch:
            got, count = cells(np.concatenate(buffer))
            return pa.RecordBatch.from_arrays([pa.array(got), pa.array(count)], ["cell", "f"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = numbers(lang, tokens(text.as_py() or b""))
                buffer += [ids, np.full(2, -1)]
                size += len(ids) + 2
                if size >= chunk:
                    yield out()
                    buffer, size = [], 0
        if buffer:
            yield out()

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            langs, phrases = zip(*held) if held else ((), ())
            columns = [pa.array(langs, pa.string()), pa.array([p.decode() for p in phrases], pa.string())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(held.values(), pa.int64())], ["lang", "phrase", "f"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = tokens(text.as_py() or b"")
                mark = np.fromiter(map(b".".__eq__, words), dtype=bool, count=len(words))
                other = np.r_[0, np.cumsum((numbers(lang, words) < 0) & ~mark)]
                breaks = np.r_[0, np.cumsum(mark)]
                n = max(len(words) - width + 1, 0)
                for i in np.flatnonzero((other[width:] > other[:n]) & (breaks[width:] == breaks[:n])).tolist():
                    held[lang, b" ".join(words[i : i + width])] += 1
                if len(held) >= held_most:
                    yield out()
                    held.clear()
        yield out()

    sums = docs.mapInArrow(counted, "cell long, f long").groupBy("cell").agg(F.sum("f").alias("f"))
    if ranked.whole:
        return sums, None
    rest = docs.mapInArrow(spelled, "lang string, phrase string, f long")
    return sums, rest.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _bits(pairs: DataFrame) -> np.ndarray:
    """A bit map over SLOTS with the slots of all pairs set; its size does not depend on them."""
    slot = F.pmod(F.col("cell"), F.lit(SLOTS))
    rows = (
        pairs.groupBy(F.floor(slot / SLOT_BLOCK).alias("block"))
        .agg(F.bitmap_construct_agg(F.pmod(slot, F.lit(SLOT_BLOCK))).alias("bits"))
        .collect()
    )
    bits = np.zeros(SLOTS // SLOT_BLOCK + 1 << 12, dtype=np.uint8)
    for r in rows:
        bits[r["block"] << 12 : r["block"] + 1 << 12] = np.frombuffer(r["bits"], dtype=np.uint8)
    return bits


def frequent_phrases(
    docs: DataFrame,
    words: DataFrame,
    least: int = LEAST,
    text_col: str = "text",
    lang_col: str = "lang",
    most_words: int = WORDS,
    most_pairs: int = PAIRS,
) -> DataFrame:
    """(lang, phrase, f, size): phrases of two and three words that occur `least` times or more. `words` are
    the stored (lang, phrase, f) of single words that do."""
    spark = docs.sparkSession
    texts = _texts(docs, text_col, lang_col)
    short = words.where(F.octet_length("phrase") <= WORD_BYTES)
    head, n_head = head_of(short, "f", most_words)
    table = head.select("lang", "phrase", "f").toArrow().sort_by([("f", "descending"), ("lang", "ascending"), ("phrase", "ascending")])
    ids: dict[str, dict[bytes, int]] = {}
    for i, (lang, word) in enumerate(zip(table.column("lang").to_pylist(), table.column("phrase").to_pylist())):
        ids.setdefault(lang, {})[word.encode()] = i
    ranked = Ranked(ids, n_head == words.count())
    names = stored(
        spark.createDataFrame(
            pa.table({"id": pa.array(np.arange(len(table))), "lang": table.column("lang"), "word": table.column("phrase")}),
            "id long, lang string, word string",
        )
    )
    often = F.col("f") >= least

    cells, pair_texts = _phrases(texts, ranked, 2)
    pairs = stored(cells.where(often))
    top = head_of(pairs, "f", most_pairs)[0].toArrow().sort_by([("f", "descending"), ("cell", "ascending")])
    ranked.by_id = top.column("cell").to_numpy().astype(np.int64)
    ranked.pair_ids = np.argsort(ranked.by_id)
    ranked.pairs = ranked.by_id[ranked.pair_ids]
    ranked.bits = _bits(pairs)
    cells, triple_texts = _phrases(texts, ranked, 3)

    def spelled(cells: DataFrame, size: int) -> DataFrame:
        rows = cells
        for i in range(size):
            number = F.shiftright("cell", BITS * (size - 1 - i)).bitwiseAND(F.lit((1 << BITS) - 1))
            own = names.select(F.col("id").alias(f"id{i}"), F.col("word").alias(f"word{i}"), *([F.col("lang")] if not i else []))
            rows = rows.withColumn(f"id{i}", number).join(own, f"id{i}")
        return rows.select("lang", F.concat_ws(" ", *[f"word{i}" for i in range(size)]).alias("phrase"), "f", F.lit(size).alias("size"))

    found = spelled(pairs, 2).unionByName(spelled(cells.where(often), 3))
    for size, rest in ((2, pair_texts), (3, triple_texts)):
        if rest is not None:
            found = found.unionByName(rest.where(often).withColumn("size", F.lit(size)))
    return stored(found)


def _scored(phrases: DataFrame, known: DataFrame) -> DataFrame:
    """phrases with the l, r and score of their lowest cut; known has f of all their parts."""
    word = F.split("phrase", " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", F.col("f").alias("a"), "size", "k",
        F.array_join(F.slice(word, F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice(word, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
    )
    for part, n in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(part), F.col("f").alias(n)), ["lang", part])

    def exact(c: str) -> str:
        return f"cast({c} as decimal(19, 0))"

    score = F.expr(f"({exact('a')} * {exact('a')} * 1000000) div ({exact('l')} * {exact('r')})")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return cuts.groupBy("lang", "phrase", "a", "size").agg(lowest.alias("cut")).select(
        "lang", "phrase", "a", "size", "cut.l", "cut.r", "cut.score"
    )


def _uncovered(phrases: DataFrame, covered: int) -> DataFrame:
    """Without the pairs inside a phrase of three words that has `covered` hundredths of their occurrences or more."""
    word = F.split("phrase", " ")
    inner = F.array(*[F.concat_ws(" ", word[i], word[i + 1]) for i in (0, 1)])
    longer = (
        phrases.where("size = 3").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    )
    rows = phrases.join(longer, ["lang", "phrase"], "left")
    return rows.where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("f")) | (F.col("size") == 3)).drop("longer")


def _first(rows: DataFrame, top: int) -> DataFrame:
    """Each language's first rows; each of SALTS parts of a language keeps its own first before they meet."""
    order: list[Column] = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top)


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    top: int = TOP,
    covered: int = COVERED,
    most_words: int = WORDS,
    most_pairs: int = PAIRS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of two or three words.

    A null language is `und`, a null text has no words, repeated rows count each time; other columns are
    not looked at; no phrases give an empty result. Ties rank by a, then by the phrase. Phrases don't
    cross the marks between pieces nor texts. most_words and most_pairs bound what is broadcast: the rest
    is counted exactly by other ways.
    """
    counts = stored(word_counts(docs, text_col, lang_col))
    words = stored(counts.where(F.col("f") >= least))
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    phrases = frequent_phrases(docs, words, least, text_col, lang_col, most_words, most_pairs)
    known = words.unionByName(phrases.where("size = 2").select("lang", "phrase", "f"))
    ranked = _first(_scored(_uncovered(phrases, covered), known), top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
