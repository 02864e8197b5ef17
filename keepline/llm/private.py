"""Personal data, and the words that give it away.

Patterns find the protected values themselves. Then the corpus tells which words of its texts reveal
it: where a word's pointwise mutual information with the value comes close to all the information the
value carries, whoever reads the word learns the value, and the word is generalised or removed too.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepline.llm.common import ascii_lower, field, stored, type_of

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT = 2
DISCLOSES = 0.8
REMOVES = 0.95
MOST_BYTES = 32 << 20

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start. Linear in the text, whatever it holds."""
    found = [(0, s, e) for s, e in _emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            found.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                found.append((3, *m.span()))
    return found


def words_of(text: str, spans: list[tuple[int, int, int]], near: int | None = None) -> list[tuple[str, int, int]]:
    """(term, start, end) of the words of a text with values, the values left out; `near`: only so many
    words on either side of a value."""
    if not spans:
        return []
    taken = sorted((s, e) for _, s, e in spans)
    starts = [s for s, _ in taken]

    def free(s: int, e: int) -> bool:
        i = bisect_left(starts, e)
        return all(x <= s for _, x in taken[max(0, i - len(KINDS)) : i])

    words = [m.span() for m in TERM.finditer(text)]
    words = [w for w in words if free(*w)]
    if near is not None:
        at, chosen = [w[0] for w in words], set()
        for s, e in taken:
            i, j = bisect_left(at, s), bisect_left(at, e)
            chosen.update(range(max(0, i - near), i), range(j, min(j + near, len(words))))
        words = [words[i] for i in sorted(chosen)]
    return [(text[a:b].encode().lower().decode(), a, b) for a, b in words]


SPANS = T.ArrayType(T.StructType([field("kind", T.IntegerType()), field("start", T.IntegerType()), field("end", T.IntegerType())]))
TERMS = T.ArrayType(T.StructType([field("term", T.StringType())] + SPANS.elementType.fields[1:]))


def found(docs: DataFrame, id_col: str, text_col: str, near: int | None = None) -> DataFrame:
    """(doc, version, spans, entities, terms) of every row; version is the hash of the text."""
    schema = T.StructType(
        [field("doc", type_of(docs, id_col)), field("version", T.LongType()), field("spans", SPANS)]
        + [field("entities", T.ArrayType(T.StringType())), field("terms", TERMS)]
    )
    span_type, term_type = (
        pa.list_(pa.struct([(n, t) for n, t in names]))
        for names in (
            [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())],
            [("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())],
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, entities, terms = [], [], []
            for value in batch.column(2):
                text = value.as_py() or ""
                got = base_spans(text)
                spans.append([dict(zip(("kind", "start", "end"), x)) for x in got])
                entities.append(sorted({f"{KINDS[k]}:{text[s:e]}" for k, s, e in got}))
                terms.append([dict(zip(("term", "start", "end"), x)) for x in words_of(text, got, near)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(spans, span_type),
                    pa.array(entities, pa.list_(pa.string())),
                    pa.array(terms, term_type),
                ],
                schema.names,
            )

    text = docs[text_col]
    rows = docs.select(docs[id_col].alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))
    return rows.mapInArrow(run, schema)


def protected(rows: DataFrame) -> DataFrame:
    """(version, entity, with_entity): the protected values of each different text, and in how many they are.

    All values that stand in one text only stand in the same texts as each other: they are one entity,
    text:version, so that a text of many values costs no more rows than its words.
    """
    each = rows.select("version", F.explode("entities").alias("entity")).distinct()
    counted = each.groupBy("entity").agg(F.count("*").alias("with_entity"))
    own = F.concat(F.lit("text:"), F.col("version"))
    key = F.when(F.col("with_entity") == 1, own).otherwise(F.col("entity"))
    return each.join(counted, "entity").select("version", key.alias("entity"), "with_entity").distinct()


def disclosing(docs: DataFrame, rows: DataFrame, text_col: str, support: float, least: float, most_bytes: int) -> DataFrame:
    """(entity, term, share): how much of an entity's information a word of its texts gives away.

    share = PMI(term; entity) / -log2 p(entity), from the number of different texts with the term, with
    the entity, and with both, over all texts. A pair comes back if its share is
    still `least` after smoothing: as if the term stood in `support` more texts, with the entity in as
    many of them as anywhere. Entities are those of `protected`.
    """
    copies = rows.groupBy("version").agg(F.count("*").alias("copies"))
    total = copies.count()
    per_text = rows.where(F.size("entities") > 0).select("version", F.explode("terms").alias("t"))
    per_text = per_text.select("version", "t.term").distinct()
    joint = stored(
        protected(rows).join(per_text, "version").groupBy("entity", "term", "with_entity").agg(F.count("*").alias("both"))
    )
    wanted = joint.select("term").distinct()
    size = wanted.agg(F.sum(F.length("term") + 32).alias("n")).first()["n"] or 0
    repeated = copies.where("copies > 1")
    weights = F.broadcast(repeated) if 16 * repeated.count() <= most_bytes else repeated
    # The same words as TERM's: letters, and the numbers that are no decimal digits (as in km²).
    words = F.array_distinct(F.split(ascii_lower(F.col("text")), r"[^\p{L}\p{Nl}\p{No}]+", -1))
    each = docs.select(docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("version")).join(weights, "version", "left")
    each = each.select(F.explode(words).alias("term"), (1 / F.coalesce("copies", F.lit(1))).alias("part"))
    if size <= most_bytes:
        each = each.join(F.broadcast(wanted), "term")
    counted = each.groupBy("term").agg(F.round(F.sum("part")).alias("with_term"))  # a text once, not its copies
    n = F.lit(float(max(total, 1)))
    held = F.greatest("with_term", "both")
    base = F.col("with_entity") / n
    whole = -F.log2(base)
    smooth = (F.col("both") + support * base) / (held + support)
    return (
        joint.join(counted, "term")
        .select(
            "entity",
            "term",
            F.when(whole > 0, F.log2(F.col("both") / held / base) / whole).otherwise(0.0).alias("share"),
            F.when(whole > 0, F.log2(smooth / base) / whole).otherwise(0.0).alias("sure"),
        )
        .where(F.col("sure") >= least)
        .drop("sure")
    )


def find_private(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    near: int | None = None,
    support: float = SUPPORT,
    least: float = DISCLOSES,
    most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """(id, version, base, terms), one row per row of docs.

    `base` has the spans of the patterns (kind, start, end), `terms` those of the disclosing words
    anywhere in the same text (start, end, share), each once and sorted; offsets count code points. `version` is the hash of
    the text. A null text is empty. Repeated rows and null ids are treated like others; copies of a text
    count as one text. A value needs no number of texts; `support` is the weight of the smoothing. Values
    that overlap are all listed; of a word's shares the largest is given. No rows give no rows, only the two
    columns are looked at, and texts of any length are searched whole, in linear time.
    """
    rows = stored(found(docs, id_col, text_col, near))
    shares = disclosing(docs, rows, text_col, support, least, most_bytes)
    in_texts = protected(rows).join(shares, "entity").groupBy("version", "term").agg(F.max("share").alias("share"))
    places = rows.select("version", F.explode("terms").alias("t")).select("version", "t.*").distinct()
    marked = (
        places.join(in_texts, ["version", "term"])
        .groupBy("version", "start", "end")
        .agg(F.max("share").alias("share"))
        .groupBy("version")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end", "share"))).alias("marked"))
    )
    none = F.expr("cast(array() as array<struct<start:int,end:int,share:double>>)")
    return rows.join(marked, "version", "left").select(
        F.col("doc").alias(id_col), "version", F.col("spans").alias("base"), F.coalesce("marked", none).alias("terms")
    )


def span_list(base: Column, terms: Column) -> Column:
    """kind:start:end of all spans, by kind as listed, then start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    own = F.transform(base, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    more = F.transform(terms, lambda s: F.concat_ws(":", F.lit(KINDS[-1]), s["start"], s["end"]))
    return F.array_join(F.concat(own, more), ",")


def masked(text: str, base: list, terms: list, removes: float = REMOVES) -> str:
    """The text with values replaced by their kind; a disclosing word becomes a mere class of words,
    or goes if its share reaches `removes`. Overlapping values are replaced together by the first."""
    cuts = [(s["start"], s["end"], f"[{KINDS[s['kind']].upper()}]") for s in base]
    for t in terms:
        word = text[t["start"] : t["end"]]
        cuts.append((t["start"], t["end"], "" if t["share"] >= removes else "[NAME]" if word[0].isupper() else "[WORD]"))
    out, at = [], 0
    for start, end, instead in sorted(cuts):
        if start >= at:
            out += [text[at:start], instead]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removes: float = REMOVES, **options) -> DataFrame:
    """docs with personal data and disclosing words taken out of the text; all other columns as they are."""
    spans = find_private(docs, id_col, text_col, **options)
    spans = spans.groupBy("version").agg(F.first("base").alias("base"), F.first("terms").alias("terms"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("original"), F.xxhash64(docs[text_col]).alias("version"))

    @F.pandas_udf("string")
    def mask(text, base, terms):  # noqa: ANN001, ANN202
        return text.combine(base.combine(terms, lambda b, t: (b, t)), lambda x, s: None if x is None else masked(x, *s, removes))

    joined = rows.join(spans, "version").select(
        "original", mask(F.col("original").getField(text_col), "base", "terms").alias("clean")
    )
    return joined.select(
        *[(F.col("clean") if c == text_col else F.col("original").getField(c)).alias(c) for c in docs.columns]
    )
