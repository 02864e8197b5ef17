"""Main text of web pages by block rules in two passes.

The first pass judges each block by its length, link density, stop-word density and the elements it
stands in; what stays open, mostly short blocks and headings, takes the label of its nearest decided
neighbours in the second.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field as dataclass_field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepline.llm.common import field, type_of

SHORT, LONG = 70, 200
MOST_LINKS = 0.33
FEW_STOPS, MANY_STOPS = 0.12, 0.2

# Element names, words in class names, and frequent function words.
RAW = "script|style|noscript|template|svg|math|iframe|object|textarea|select|title|canvas|audio|video|noframes|xmp"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
ENDS_P = BLOCKS - set("body html head".split())
AROUND = set("nav footer aside form menu dialog head button label fieldset".split())
MAIN = set("article main".split())
AROUND_WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent "
    "cookie cookies copyright disclaimer disqus footer form header login masthead menu modal nav navbar navigation "
    "newsletter notice pager pagination paywall popup promo promotion recommended related search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar widget".split()
)
TEXT_BLOCKS = HEADINGS | set("p blockquote pre li dd dt figcaption caption td th".split())
OWN_WORDS = set("article body content entry main post story text".split())
AROUND_ROLES = set(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
)
STOP_WORDS = set(
    # English
    "a about all also an and are as at be been but by can for from had has have he her his i if in is it its more "
    "not of on one or our out she so than that the their there they this to was we were what when which who will "
    "with would you your "
    # French
    "au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur mais même ne nous on ou "
    "où par pas plus pour qu que qui sa se ses son sont sur un une vous y à été être "
    # German
    "aber als am auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat "
    "ich im ist mit nach nicht noch nur oder sich sie sind so über um und uns vom von vor war was wie wird zu zum zur "
    # Spanish
    "al como con del el ella entre era eran es esta este fue ha hay la las lo los más me mi muy no o para pero por "
    "porque qué sin sobre su sus también te tiene todo una uno y ya".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    text: str
    links: int
    around: bool
    main: bool
    heading: bool
    label: str = ""


@dataclass
class _Open:
    name: str
    around: bool
    main: bool


@dataclass
class _Page:
    """Open elements and the block being read."""

    stack: list[_Open] = dataclass_field(default_factory=list)
    open: Counter = dataclass_field(default_factory=Counter)  # of each name in the stack
    parts: list[str] = dataclass_field(default_factory=list)
    linked: list[str] = dataclass_field(default_factory=list)
    blocks: list[Block] = dataclass_field(default_factory=list)
    in_link: int = 0
    heading: int = 0
    breaks: int = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.stack[-1] if self.stack else _Open("", False, False)
            links = len(" ".join("".join(self.linked).split()))
            self.blocks.append(Block(text, links, top.around, top.main, self.heading > 0))
        self.parts, self.linked, self.breaks = [], [], 0

    def text(self, raw: str) -> None:
        if raw:
            text = unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if not text.isspace():
                self.breaks = 0
            if self.in_link:
                self.linked.append(text)

    def start(self, name: str, rest: str) -> None:
        if name == "br":
            self.breaks += 1
            if self.breaks > 1:
                self.flush()
            else:
                self.parts.append(" ")
            return
        if name in BLOCKS:
            self.flush()
        if name in VOID:
            return
        if name in ENDS_P:
            self._close("p", BLOCKS - {"p"})
        if name in ("li", "dt", "dd", "option", "tr", "td", "th"):
            self._close(name, {"ul", "ol", "dl", "select", "table"})
        if name in MAIN and (self.open["nav"] or self.open["header"] or self.open["head"]):  # an end tag is missing
            for at, x in enumerate(self.stack):
                if x.name in ("nav", "header", "head"):
                    self._pop(at)
                    break
        above = self.stack[-1] if self.stack else _Open("", False, False)
        main = above.main or name in MAIN
        around = above.around or name in AROUND or (name == "header" and not main)
        if rest and not around and name not in ("html", "body"):
            around = _marked(rest, name, main)
        self.in_link += name == "a"
        self.heading += name in HEADINGS
        self.stack.append(_Open(name, around, main))
        self.open[name] += 1

    def end(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
        self._close(name, set())

    def _close(self, name: str, stop: set[str]) -> None:
        if not self.open[name]:
            return
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].name == name:
                self._pop(at)
                return
            if self.stack[at].name in stop:
                return

    def _pop(self, at: int) -> None:
        for x in self.stack[at:]:
            self.in_link -= x.name == "a"
            self.heading -= x.name in HEADINGS
            self.open[x.name] -= 1
        del self.stack[at:]


def _marked(rest: str, element: str, main: bool) -> bool:
    """Whether attributes say that an element is not part of the article.

    Inside a marked article a header belongs to it, and of a paragraph, heading or the like all words of a
    class have to say so: `related` does, `related-work` does not.
    """
    enough = all if main and element in TEXT_BLOCKS else any
    own_header = {"header"} if main else set()
    for m in ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and HIDDEN.search(value):
            return True
        if name == "role" and value.lower() in AROUND_ROLES:
            return True
        if name in ("class", "id"):
            for token in value.lower().split():
                words = [w for w in re.split(r"[-_]+|\d+", token) if w]
                own = bool(words) and words[0] in OWN_WORDS and not {"comments", "comment", "ad", "ads"} & set(words)
                if words and not own and enough(w in AROUND_WORDS and w not in own_header for w in words):
                    return True
    return False


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page in order; markup, comments, scripts and styles are gone."""
    page, at = _Page(), 0
    for m in TOKEN.finditer(html):
        page.text(html[at : m.start()])
        at = m.end()
        if m["name"]:
            (page.end if m["end"] else lambda n, r=m["rest"]: page.start(n, r))(m["name"].lower())
    page.text(html[at:])
    page.flush()
    return page.blocks


def judge(block: Block) -> str:
    """good, bad, near (good if any neighbour is), short (as its nearest neighbour) or unlike (running text
    by length, but without the stop words of a known language)."""
    n = len(block.text)
    if block.around or ("©" in block.text and n < SHORT and not block.main):
        return "bad"
    if block.links > MOST_LINKS * n:
        return "short" if block.main else "bad"
    if block.heading:
        return "short"
    if n < SHORT:
        return "bad" if block.links and not block.main else "short"
    words = block.text.lower().split()
    stops = sum(map(STOP_WORDS.__contains__, words)) / max(len(words), 1)
    if stops >= MANY_STOPS:
        return "good" if n > LONG else "near"
    if stops >= FEW_STOPS or block.main:
        return "near"
    return "unlike"


def label(blocks: list[Block]) -> None:
    """Both passes. Where a page marks its article, only blocks inside it can be good, and an open
    block with no good neighbour on either side is good there."""
    marked = any(b.main and not b.around for b in blocks)
    for b in blocks:
        b.label = "bad" if marked and not b.main else judge(b)
    known = sum(len(b.text) * ((b.label in ("good", "near")) - (b.label == "unlike")) for b in blocks) > 0
    for b in blocks:
        if b.label == "unlike":  # most of the page is in no known language: length and links decide
            b.label = "bad" if known else "good" if len(b.text) > LONG else "near"
    if not any(b.label == "good" for b in blocks):  # nothing certain: trust what is like running text
        for b in blocks:
            b.label = "good" if b.label == "near" else b.label
    first = [b.label for b in blocks]
    decided = ("good", "bad")
    before, after, last = [], [], (None, 0)
    for i, x in enumerate(first):
        before.append(last)
        if x in decided and (x == "good" or not (blocks[i].around and marked)):
            last = (x, i)
    last = (None, 0)
    for i in range(len(first) - 1, -1, -1):
        after.append(last)
        if first[i] in decided and (first[i] == "good" or not (blocks[i].around and marked)):
            last = (first[i], i)
    after.reverse()
    for i, b in enumerate(blocks):
        if first[i] in decided:
            continue
        (left, l_at), (right, r_at) = before[i], after[i]
        sides = {x for x in (left, right) if x}
        if marked and b.main and first[i] == "short" and "good" not in sides:
            b.label = "good"
        elif first[i] == "near":
            b.label = "good" if "good" in sides or b.main or not sides else "bad"
        elif sides == {"good", "bad"}:
            nearer_left = i - l_at <= r_at - i
            b.label = left if nearer_left and not b.heading else right
        else:
            b.label = "good" if sides == {"good"} else "bad"


def main_text(html: str | None) -> str:
    """The article's blocks, joined by line feeds."""
    if not html:
        return ""
    blocks = blocks_of(html)
    label(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extract(
    pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)
) -> DataFrame:
    """(id, *keep, text, n_chars), one row per row of pages.

    Character references are decoded, white space in a block is one space, blocks are joined by one
    line feed. A null or empty page has the empty text. Repeated rows and null ids are like others, no rows
    give no rows, only the named columns are looked at. Of two decided neighbours as near as each other the
    one before decides, for a heading the one after. Pages of any length are read whole, in linear time.
    """
    schema = T.StructType(
        [field(c, type_of(pages, c)) for c in (id_col, *keep)] + [field("text", T.StringType()), field("n_chars", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                texts = [main_text(h.as_py()) for h in some.column(some.num_columns - 1)]
                columns = [*some.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return pages.select(*[pages[c] for c in (id_col, *keep)], F.col(html_col)).mapInArrow(run, schema)
