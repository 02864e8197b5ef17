"""Benchmark decontamination: windows of test words looked up in every document. DataFrame functions alone.

The windows of the test items are a hash table that goes to every task (checked against a size bound;
beyond it the same join shuffles). Documents are scanned once for window hashes; the few documents
with hits then have them verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepline.llm.common import ascii_lower, bound, stored

WIDTH = 13
MOST_BYTES = 32 << 20
OUTSIDE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_AND_REST = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
LEAD = r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def words_of(text: Column) -> Column:
    """Letters, digits and all beyond ASCII, A-Z lower-cased; null: none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), OUTSIDE, -1), lambda w: w != "")


def _window_hashes(words: Column, widths: list[int]) -> Column:
    """Hashes of all windows, by start and then in the order of the widths; null beyond the end.

    get() takes one word in constant time; slice() would copy all words for every window.
    """

    def every(hashes: Column) -> Column:
        def of(i: Column, width: int) -> Column:
            window = F.xxhash64(*[F.get(hashes, i + k) for k in range(width)])
            return F.when(i + width <= F.size(hashes), window)

        starts = F.transform(hashes, lambda _, i: i)
        if len(widths) == 1:
            return F.transform(starts, lambda i: of(i, widths[0]))
        return F.flatten(F.transform(starts, lambda i: F.array(*[of(i, w) for w in widths])))

    return bound(F.transform(words, lambda w: F.xxhash64(w)), every)


def _hash_of(window: str, width: int) -> Column:
    """The hash that `_window_hashes` gives such a window, whatever its width up to `width`."""
    out = F.lit(None).cast("long")
    for n in range(1, width + 1):
        words = [F.xxhash64(F.get(window, F.lit(k))) for k in range(n)]
        out = F.when(F.size(window) == n, F.xxhash64(*words)).otherwise(out)
    return out


def _stretch(words: Column, start: Column, width: Column) -> Column:
    """`width` words from place `start` (from 1), in time that does not depend on the other words."""
    return F.transform(F.sequence(start - 1, start + width - 2), lambda j: F.get(words, j))


def item_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(hash, width, window, items): each distinct window with the ids, as strings, of its items.

    An item of fewer words than `width`, but not none, is one window. Null texts and texts without
    words give none; a null id is not listed; repeated items count once.
    """
    rows = benchmark.select(
        benchmark[item_col].cast("string").alias("item"), words_of(benchmark[text_col]).alias("words")
    ).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (width - 1), F.lit(1)))
    windows = bound(
        F.col("words"), lambda ws: F.transform(starts, lambda i: _stretch(ws, i, F.least(F.lit(width), F.size(ws))))
    )
    rows = rows.select("item", F.explode(windows).alias("window"))
    grouped = rows.groupBy("window").agg(F.collect_set("item").alias("items"))
    return grouped.select(
        _hash_of("window", width).alias("hash"),
        F.size("window").alias("width"),
        F.array_join("window", " ").alias("window"),
        "items",
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    one_in: int = 20,
    most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """(`original`, n_words, n_hit, items, contaminated, cleaned), one row per row of docs.

    A word inside any occurrence of a test window is hit; a document is contaminated if at least one
    word in `one_in` is. `original` is a struct of all columns of docs, whatever their names; `items`
    the sorted ids, as strings, of the items found; `cleaned` the text without the hit words and what
    follows each up to the next word. Null and empty texts have no words and are never contaminated.
    Repeated rows are treated alike. Rows without an id are checked too. No benchmark: no hits; no
    documents: no rows. Items of equal id are one item. Texts of any length are checked whole.
    """
    windows = stored(item_windows(benchmark, item_col, item_text_col, width))
    by_width = windows.groupBy("width").agg(F.sum(F.length("window") + 40 + 16 * F.size("items")).alias("bytes")).collect()
    widths = sorted((r["width"] for r in by_width), reverse=True)
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("original"),
        docs[id_col].alias("doc"),
        F.xxhash64(docs[text_col]).alias("version"),
    )
    words = words_of(F.col("original").getField(text_col))
    if widths:
        table = F.broadcast(windows) if sum(r["bytes"] for r in by_width) <= most_bytes else windows
        hits = _hits(docs, id_col, text_col, widths, table)
        rows = rows.join(
            hits, rows["doc"].eqNullSafe(hits["hit_doc"]) & (rows["version"] == hits["hit_version"]), "left"
        ).select("original", "hits")
    else:
        none = F.expr("cast(array() as array<struct<start:int,width:int,window:string,items:array<string>>>)")
        rows = rows.select("original", none.alias("hits"))
    verified = F.when(
        F.col("hits").isNotNull(),
        bound(
            words,
            lambda ws: F.filter(
                "hits", lambda h: F.array_join(_stretch(ws, h["start"], h["width"]), " ") == h["window"]
            ),
        ),
    ).otherwise(F.expr("cast(array() as array<struct<start:int,width:int,window:string,items:array<string>>>)"))
    found = rows.select("original", F.size(words).cast("long").alias("n_words"), verified.alias("hits"))
    places = F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["width"] - 1))
    found = found.select(
        "original",
        "n_words",
        F.array_distinct(F.flatten(places)).alias("places"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"])))).alias("items"),
    ).withColumn("n_hit", F.size("places").cast("long"))
    text = F.col("original").getField(text_col)
    return found.select(
        "original",
        "n_words",
        "n_hit",
        "items",
        ((F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words"))).alias("contaminated"),
        F.when(F.col("n_hit") == 0, text).otherwise(_without(text, F.col("places"))).alias("cleaned"),
    )


def _hits(docs: DataFrame, id_col: str, text_col: str, widths: list[int], windows: DataFrame) -> DataFrame:
    """(hit_doc, hit_version, hits) of the documents with windows whose hash is in the table."""
    text = docs[text_col]
    # the hash of a text is worked out here, once, and not after the explode, for every window
    rows = docs.select(docs[id_col].alias("hit_doc"), F.xxhash64(text).alias("hit_version"), text.alias("text"))
    rows = rows.select(
        "hit_doc", "hit_version", F.posexplode(_window_hashes(words_of(F.col("text")), widths)).alias("at", "hash")
    ).where(F.col("hash").isNotNull())
    hit = rows.join(windows, "hash").withColumn("start", F.expr(f"at div {len(widths)} + 1").cast("int"))
    return (
        hit.select("hit_doc", "hit_version", F.struct("start", "width", "window", "items").alias("hit"))
        .groupBy("hit_doc", "hit_version")
        .agg(F.collect_set("hit").alias("hits"))
    )


def _without(text: Column, places: Column) -> Column:
    """The text without the words at these places (from 1) and the separators after them."""
    pieces = F.regexp_extract_all(text, F.lit(WORD_AND_REST), F.lit(0))

    def rest(both: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(1), F.size(both["pieces"])), both["places"])
        kept = F.transform(kept, lambda i: F.element_at(both["pieces"], i))
        return F.concat(F.regexp_extract(both["text"], LEAD, 0), F.array_join(kept, ""))

    return bound(F.struct(text.alias("text"), pieces.alias("pieces"), places.alias("places")), rest)
