from __future__ import annotations

import html
import re
import time

from keepline.llm.html_text import extract, main_text

ARTICLE = (
    "<p>The cat was on the mat and it was there for all of the day with the dog, and the bird of which we had "
    "heard so much was there too, so that all of them were in the house by the time the night was over for us.</p>"
)


def test_given_pages(spark):
    """The given pages mark their article: all of it, and nothing else, comes back."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        inner = r.html.split("<article>")[1].split("</article>")[0]
        parts = re.split(r"<p>|</p>|</h1>", inner)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_boilerplate_goes():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header><h2>My site</h2></header>"
        "<nav><a href=/>Home</a> <a href=/x>More</a></nav><div class='cookie-notice'>We use cookies and you agree to all of them.</div>"
        f"<div id=content><h1>A title</h1>{ARTICLE}<p>Short.</p><script>var a = '<p>no</p>';</script>{ARTICLE}"
        "<form><p>Your name and your mail for the list of all that is new</p><input></form><aside>See also this</aside></div>"
        "<div class='comments'><p>I think that this is the best of all that I have read in the last year, and you?</p></div>"
        "<footer>&copy; 2020 by us</footer></body></html>"
    )
    body = re.sub("</?p>", "", ARTICLE)
    assert main_text(page) == f"A title\n{body}\nShort.\n{body}"


def test_two_passes_on_unmarked_pages():
    body = re.sub("</?p>", "", ARTICLE)
    links = "<p><a href=1>one</a> <a href=2>two</a></p>"
    page = f"{links}<p>Lost here</p>{links}{ARTICLE}<p>Near it</p>{ARTICLE}{links}<p>Far off</p>{links}"
    assert main_text(page) == f"{body}\nNear it\n{body}"


def test_references_space_and_breaks():
    page = "<article><p>a&nbsp;&amp; b\n\t c&#233;<br>d &lt;p&gt; &am</p><p>x<b>y</b>z</p></article>"
    assert main_text(page) == "a & b cé d <p> &am\nxyz"


def test_broken_markup():
    assert main_text("<article><p>one<p>two <a href='x>y'>three</a> and four five six</article><p>out") == "one\ntwo three and four five six"
    assert main_text("<article>text <!-- never closed <p>x</p>") == "text"
    assert main_text("<nav><ul><li>menu<article><p>kept</p></article>") == "kept"
    assert main_text("<article><p>kept</p><p cla") == "kept"
    assert main_text("1 < 2 and <3") in ("", "1 < 2 and <3")


def test_long_pages_take_linear_time():
    def seconds(n: int) -> float:
        start = time.perf_counter()
        for unit in ("<p>a", "<a href=\"", "<!-- ", "&amp;", "<div><b>", "< ", "<script>"):
            main_text("<article>" + unit * n)
        return time.perf_counter() - start

    seconds(100)
    assert seconds(40_000) < 12 * max(seconds(10_000), 0.05)


def test_odd_rows_and_empty_table(spark):
    rows = [(1, "u", None, "x"), (1, "u", "", "x"), (None, None, f"<article>{ARTICLE}</article>", "x"), (2, "v", "<p></p>", "x"), (2, "v", "<p></p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract(pages).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 0, 0, len(re.sub("</?p>", "", ARTICLE))]
    assert extract(pages.limit(0)).count() == 0


def test_sign_and_links_inside_the_article():
    body = re.sub("</?p>", "", ARTICLE)
    signed = body + " The sign © is on it."
    page = f"<article><h2><a href=1>A linked title</a></h2><p>{signed}</p><p>See <a href=2>this and that</a> too</p>{ARTICLE}</article>"
    assert main_text(page) == f"A linked title\n{signed}\nSee this and that too\n{body}"
    assert main_text(f"<div>{ARTICLE}<p>{signed}</p><p>© 2020 by us</p></div>") == f"{body}\n{signed}"


def test_page_in_another_language():
    long = "Kissa istui matolla koko päivän koiran kanssa ja lintu josta olimme kuulleet niin paljon oli siellä myös. " * 3
    other = "Yöllä kaikki olivat talossa ennen kuin aamu koitti meille kaikille jälleen kerran."
    menu = "<p>" + " ".join(f"<a href={i}>Valikon kohta numero {i}</a>" for i in range(9)) + "</p>"
    assert main_text(f"{menu}<p>{long}</p><p>{other}</p>{menu}") == f"{long.strip()}\n{other}"
    assert main_text(f"<p>{other}</p>{menu}") == other


def test_article_keeps_its_own_header_and_lists():
    body = re.sub("</?p>", "", ARTICLE)
    page = (
        f"<article><div class=header><h1>The title</h1></div>{ARTICLE}<p class='related-work'>Other work on the same.</p>"
        f"<ul><li><a href=1>A first source</a><li><a href=2>A second source</a></ul><p><a href=3>All of it as one link</a></p>{ARTICLE}"
        "<div class='related-posts'><p>Read this next</p></div><p class=related>And this</p><div class=share><a href=4>Share</a></div></article>"
    )
    want = ["The title", body, "Other work on the same.", "A first source", "A second source", "All of it as one link", body]
    assert main_text(page) == "\n".join(want)


def test_a_notice_does_not_decide_the_language():
    notice = "<p>This site is for all of you, and it is by us that it was made for the year.</p>"
    long = "Kissa istui matolla koko päivän koiran kanssa ja lintu josta olimme kuulleet niin paljon oli siellä myös. " * 3
    other = "Yöllä kaikki olivat talossa ennen kuin aamu koitti meille kaikille jälleen kerran."
    got = main_text(f"{notice}<p>{long}</p><p>{other}</p>")
    assert long.strip() in got and other in got
    body = re.sub("</?p>", "", ARTICLE)
    assert main_text(f"{ARTICLE}{ARTICLE}<p>{other}</p>") == f"{body}\n{body}"


def test_end_tags_without_a_start_take_linear_time():
    def seconds(n: int) -> float:
        start = time.perf_counter()
        for page in ("<div>" * n + "</b>" * n, "<b>" * n + "</i>" * n, "<article>" * n, "<div>" * n + "<p>" * n, "<ul><li>" + "<b>" * n + "</p>" * n):
            main_text(page + "text")
        return time.perf_counter() - start

    seconds(100)
    assert seconds(24_000) < 12 * max(seconds(6_000), 0.05)
