from __future__ import annotations

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from keepline.llm import private as P
from keepline.llm import queries as Q

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def by_pattern(text: str) -> list[tuple[int, int, int]]:
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and P.luhn(digits):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    parts = "a b @ . - + 1 2 25 255 256 007 4111111111111111 ( ) é _ % x.y @a.b +1(234)567-8901 1.2.3.4".split() + [" ", "\n"]
    for _ in range(8000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert P.base_spans(text) == by_pattern(text)


def test_long_runs_take_linear_time():
    def seconds(n: int) -> float:
        start = time.perf_counter()
        for unit in ("a", "1", "1.", "@", "a@", "a@b.", "+1", "+1 ", "1 ", "0", "-"):
            P.base_spans(unit * n)
        return time.perf_counter() - start

    seconds(100)
    assert seconds(80_000) < 12 * max(seconds(20_000), 0.05)


def docs(spark, copies: int = 1):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    rows = [f"{' '.join(word() for _ in range(40))} the of and" for _ in range(150)]
    for i in range(4):
        rows.append(f"{word()} {word()} the Zanzibarian clerk mails jo@x.org and {word()} {word()} {i}")
    rows += [f"{word()} the clerk at +1 (234) 567-8901 and the rest", None, ""]
    rows += [f"the clerk {word()} of {word()}" for _ in range(40)]
    return spark.createDataFrame(list(enumerate(rows * copies)), "doc_id long, text string")


def test_disclosing_words_against_counting(spark):
    df = docs(spark)
    texts = [t or "" for _, t in df.collect()]
    with_zan = [t for t in texts if "zanzibarian" in t.lower()]
    assert len(with_zan) == 4
    found = P.find_private(df).collect()
    named = {r.doc_id: [(s.start, s.end) for s in r.terms] for r in found}
    for r in found:
        text = texts[r.doc_id]
        words = [text[a:b] for a, b in named[r.doc_id]]
        if "jo@x.org" in text:
            assert "Zanzibarian" in words and "mails" in words  # only ever beside the address
            assert "the" not in words and "clerk" not in words  # common elsewhere
        else:
            assert words == []


def test_share_is_pmi_over_information(spark):
    import math

    df = docs(spark)
    rows = P.stored(P.found(df, "doc_id", "text", 8))
    shares = {(r.entity, r.term): r.share for r in P.disclosing(df, rows, "text", 2, 0.0, 1 << 20).collect()}
    texts = [re.findall(r"[a-z]+", (t or "").lower()) for _, t in df.collect()]
    n = len(texts)
    with_clerk = sum("clerk" in t for t in texts)
    want = math.log2(4 * n / (with_clerk * 4)) / math.log2(n / 4)
    assert abs(shares["email:jo@x.org", "clerk"] - want) < 1e-9
    assert abs(shares["email:jo@x.org", "zanzibarian"] - 1) < 1e-9


def test_without_broadcast_the_result_is_the_same(spark):
    one, other = (sorted(str(r) for r in P.find_private(docs(spark), most_bytes=n).collect()) for n in (0, 1 << 20))
    assert one == other


def test_copies_alone_disclose_nothing(spark):
    df = spark.createDataFrame([(i, "Quentinius writes to jo@x.org now") for i in range(9)] + [(20, "other text")], "doc_id long, text string")
    assert all(r.terms == [] for r in P.find_private(df).collect())


def test_sanitise(spark):
    clean = {r.doc_id: r.text for r in P.sanitise(docs(spark)).collect()}
    assert all("jo@x.org" not in (t or "") and "Zanzibarian" not in (t or "") for t in clean.values())
    assert any("[EMAIL]" in (t or "") for t in clean.values())
    assert any("[PHONE]" in (t or "") for t in clean.values())
    terms = [{"start": 0, "end": 3, "share": 0.85}, {"start": 4, "end": 7, "share": 0.99}]
    assert P.masked("Ann sat a@b.c", [{"kind": 0, "start": 8, "end": 13}], terms) == "[NAME]  [EMAIL]"


def test_odd_rows_and_empty_table(spark, odd_docs, no_docs):
    assert P.find_private(odd_docs).count() == 8
    assert P.sanitise(odd_docs).columns == odd_docs.columns
    assert P.find_private(no_docs).count() == 0
    text = P.span_list(F.col("base"), F.col("terms"))
    got = P.find_private(docs(spark)).select("doc_id", text.alias("s")).where("doc_id = 154").first()
    assert got.s.startswith("phone:")


def single(spark, far: int = 0):
    """600 texts; a hidden name beside one address that stands in one text only, and a copy of that text."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(2))
    rows = [" ".join(word() for _ in range(30)) for _ in range(600)]
    common = " ".join(" ".join(rows[:40]).split()[:far])
    rows += [f"Quentinius {common} writes to q@x.org now {common} and Quentinius again"] * 2
    rows += [f"{word()} writes to {word()} now and again" for _ in range(60)]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def marked_words(df, **options):
    texts = dict(df.collect())
    return {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.terms] for r in P.find_private(df, **options).collect()}


def test_value_of_a_single_text_has_disclosing_words(spark):
    got = marked_words(single(spark))
    assert got[600] == got[601] == ["Quentinius", "Quentinius"]
    assert not any(words for i, words in got.items() if i not in (600, 601))


def test_words_far_from_the_value_count_and_go(spark):
    df = single(spark, far=60)
    got = marked_words(df)
    assert got[600] == got[601] == ["Quentinius", "Quentinius"]
    assert not any(words for i, words in got.items() if i not in (600, 601))


def test_words_with_other_numbers_are_counted_alike(spark):
    """km² in all texts discloses nothing; a word with a Roman numeral that one text has does."""
    rows = [(i, f"An area of 3 km² and ⅷ more, text {chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(400)]
    rows.append((400, "An area of 3 km² and ⅷ more, write to some.one@example.com on levelⅣx of km²km"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in P.find_private(docs).collect()}
    text = rows[-1][1]
    assert {text[t["start"] : t["end"]] for t in got[400]["terms"]} == {"write", "levelⅣx", "km²km"}


def test_a_very_long_text_is_searched_whole(spark):
    """Two million characters with values at both ends, and a telling word a million characters from them."""
    common = "plain words go on here "
    text = "at@the.start.org " + common * 45_000 + "Quentinius " + common * 45_000 + "+1 (234) 567-8901"
    rows = [(i, f"{common} and text number{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(600)] + [(600, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in P.find_private(docs).collect()}
    assert [(s.kind, text[s.start : s.end]) for s in got[600].base] == [(0, "at@the.start.org"), (3, "+1 (234) 567-8901")]
    assert [text[s.start : s.end] for s in got[600].terms] == ["Quentinius"]
    assert not any(r.terms or r.base for i, r in got.items() if i != 600)


def test_query_counts_the_spans_of_each_kind(spark, tmp_path):
    texts = {
        1: "4111 1111 1111 1111 and 1.2.3.4 5.6.7.8 at a@b.org",
        2: "+1 (234) 567-8901, +1 (234) 567-8902 and 1.2.3.4",
        3: "a@b.org c@d.org e@f.org",
        4: None,
        5: "nothing",
    }
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in Q.QUERIES["op8_private"](spark, str(tmp_path)).collect()}
    for i, text in texts.items():
        spans = by_pattern(text or "")
        assert [got[i][f"n_{k}"] for k in P.KINDS[:4]] == [sum(k == j for k, _, _ in spans) for j in range(4)]
        listed = ",".join(f"{P.KINDS[k]}:{s}:{e}" for k, s, e in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
