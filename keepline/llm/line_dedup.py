"""Line deduplication: every repeated line stays in one document only. DataFrame functions alone.

Line hashes are range-partitioned and sorted by document and position; a window streams the first
occurrence of each hash. What comes back per document is a compressed bitmap of its lines, never text.
A line that very many documents hold is cut into slices by document: each slice finds its own
first document, and only these meet in a second, small window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepline.llm.common import SPACE, ascii_lower, bound, stored

MIN_CHARS = 10
SLICES = 64


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    # the hash of a text is worked out once, below the explode, and not for every line
    text = docs[text_col]
    rows = docs.select(docs[id_col].alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))
    keys = F.transform(_lines(ascii_lower(F.col("text"))), lambda x: F.btrim(x, F.lit(SPACE)))
    rows = rows.where("doc is not null").select("doc", "version", F.posexplode(keys).alias("pos", "key"))
    return rows.where(F.length("key") >= min_chars).select(
        "doc", "version", "pos", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2")
    )


def drop_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, slices: int = SLICES
) -> DataFrame:
    """One row per document that loses lines: doc, version (hash of its text) and `bitmap`.

    `bitmap` is a sorted array of (word, bits): bit b of word w stands for line 64 w + b, and a set
    bit says that the line goes. Words without a set bit are left out.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least
    `min_chars` code points that two or more documents hold lose all lines but those of the smallest
    document id. Rows without an id keep all lines and hold none. Rows that repeat an id count as
    one document; each of its texts gets its own bitmap.
    """
    hashes = stored(
        _hashes(docs, id_col, text_col, min_chars).withColumn(
            "slice", F.pmod(F.xxhash64("doc"), F.lit(slices)).cast("int")
        )
    )
    within = Window.partitionBy("h1", "h2", "slice").orderBy("doc", "pos")
    ranked = stored(
        hashes.repartitionByRange("h1", "h2", "slice")
        .withColumn("first_doc", F.first("doc").over(within))
        .withColumn("rank", F.row_number().over(within))
    )
    late = ranked.where(F.col("doc") > F.col("first_doc")).select("doc", "version", "pos")
    heads = ranked.where(F.col("rank") == 1).select("h1", "h2", "slice", "doc")
    across = Window.partitionBy("h1", "h2").orderBy("doc", "slice")
    lost = (
        heads.repartitionByRange("h1", "h2")
        .withColumn("overall", F.first("doc").over(across))
        .where(F.col("doc") > F.col("overall"))
        .select("h1", "h2", "slice")
    )
    beaten = ranked.where(F.col("doc") == F.col("first_doc")).join(lost, ["h1", "h2", "slice"], "left_semi")
    drops = late.unionAll(beaten.select("doc", "version", "pos"))
    words = drops.select(
        "doc",
        "version",
        (F.col("pos") / 64).cast("int").alias("word"),
        F.expr("shiftleft(1L, pos % 64)").alias("bit"),
    )
    return (
        words.groupBy("doc", "version", "word")
        .agg(F.bit_or("bit").alias("bits"))
        .groupBy("doc", "version")
        .agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("bitmap"))
    )


def _dropped(bitmap: Column) -> Column:
    """The positions of a bitmap's set bits, in order."""
    bits = F.transform(
        bitmap,
        lambda w: F.filter(
            F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: w["word"] * 64 + b),
            lambda p: F.getbit(w["bits"], p % 64) == 1,
        ),
    )
    return F.coalesce(F.flatten(bits), F.array().cast("array<int>"))


def _kept(lines: Column, dropped: Column) -> Column:
    """The lines whose positions are not dropped, in time linear in the lines."""

    def rest(both: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(both["lines"]) - 1), both["dropped"])
        return F.transform(places, lambda i: F.get(both["lines"], i))

    return bound(F.struct(lines.alias("lines"), dropped.alias("dropped")), rest)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """(`original`, `n_lines`, `n_dropped`, `kept`) for every row of docs.

    `original` is a struct with all columns of docs, whatever their names. `kept` is the text left:
    the lines that stay, joined by line feeds. A null or empty text is one empty line. Ids may be negative.
    Rows that share an id are one document: none of its lines goes because of the other row. Rows
    without an id keep all lines. Of equal lines in one document all stay or all go.
    A text is held whole as the array of its lines. No rows give no rows.
    """
    bitmaps = drop_bitmaps(docs, id_col, text_col, **options)
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("original"),
        docs[id_col].alias("doc"),
        F.xxhash64(docs[text_col]).alias("version"),
    )
    joined = rows.join(bitmaps, ["doc", "version"], "left").select("original", _dropped(F.col("bitmap")).alias("dropped"))
    lines = _lines(F.col("original").getField(text_col))
    return joined.select(
        "original",
        F.size(lines).cast("long").alias("n_lines"),
        F.size("dropped").cast("long").alias("n_dropped"),
        F.array_join(_kept(lines, F.col("dropped")), "\n").alias("kept"),
    )
