"""Main text of web pages by two passes of rules over their blocks.

A page is cut into blocks at block-level tags. The first pass labels a block by where it stands (menus, headers, footers,
sidebars, notices, adverts, forms and comments are known by their elements or by their class, id and role), by the share
of its text that is links, by its share of stop words and by its length. Short blocks stay undecided; the second pass
gives each of them the label of the nearest decided block. Inside an article only links and such places count against a
block, so its short or unusual paragraphs stay; once a page has an article, what stands outside is none.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.store import slices, values

# Elements that begin and end blocks, elements without readable text, elements of page furniture.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style noscript template textarea title iframe object svg math select button canvas audio video noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HOLDERS = frozenset(BLOCKS - HEADINGS - frozenset("p hr li dd dt option tr td th legend summary".split()))
FURNITURE = frozenset("nav footer aside form menu dialog search head".split())
ARTICLES = frozenset("article main".split())

# Words in class, id or role that name page furniture, and those that do so even on an article.
REMARKS = frozenset("comment comments commentlist reply replies respond responses disqus discussion".split())
HINTS = REMARKS | frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice"
    " notices alert alerts popup modal overlay newsletter subscribe subscription signup login sidebar sidebars widget widgets menu"
    " menus nav navbar navigation breadcrumb breadcrumbs pagination pager masthead footer copyright share sharing social related"
    " recommended complementary contentinfo toolbar skip".split()
)
PAGE_HEADER = frozenset(("header", "masthead", "topbar"))

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to a in is it that for was on are as with his they at be this have from or had by but not what all were we when"
    " der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach"
    " le de un une et être à il avoir ne je son que se qui ce dans du elle au pour pas par sur les la est"
    " el los las y que en un una por con para no se su al lo como más pero sus o este sí porque".split()
)

LINKED = 0.5
SHORT, LONG = 70, 200
FEW_STOPS, MANY_STOPS = 0.10, 0.25

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[^\W\d_]+")


class Block:
    """A run of text between block boundaries."""

    __slots__ = ("furniture", "article", "heading", "place", "parts", "linked")

    def __init__(self, furniture: bool, article: bool, heading: bool, place: int):
        self.furniture, self.article, self.heading, self.place = furniture, article, heading, place
        self.parts: list[str] = []
        self.linked = 0


def _is_furniture(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in FURNITURE or tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "main"):
        return False
    words = {w for m in MARKS.finditer(attributes) for w in re.findall(r"[a-z]+", (m[1] or m[2] or m[3] or "").lower())}
    return bool(words & (REMARKS if tag == "article" else HINTS if in_article else HINTS | PAGE_HEADER))


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, those without text left out."""
    stack = [("", False, False, 0)]  # tag, in furniture, in article, place
    out, at, links, places, heading = [Block(False, False, False, 0)], 0, 0, 0, False

    def begin() -> None:
        _, furniture, article, place = stack[-1]
        out.append(Block(furniture, article, heading, place))

    def add(raw: str) -> None:
        if raw:
            out[-1].parts.append(text := html.unescape(raw))
            out[-1].linked += len("".join(text.split())) if links else 0

    while found := TAG.search(page, at):
        add(page[at : found.start()])
        at = found.end()
        close, name = found[1] or found[4], (found[2] or found[5] or "").lower()
        if not name:
            continue
        if name in RAW and not close:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else at if name in ("select", "button") else len(page)
            add(" ")
        elif name == "a":
            links = 0 if close else 1
        elif name == "br":
            add(" ")
        elif name in BLOCKS:
            links, heading = 0, name in HEADINGS and not close
            if name in HOLDERS and close:
                depth = max((i for i, x in enumerate(stack) if x[0] == name), default=0)
                del stack[depth or len(stack) :]
            elif name in HOLDERS:
                _, furniture, article, _ = stack[-1]
                places += 1
                furniture = furniture or _is_furniture(name, found[3] or found[6] or "", article)
                stack.append((name, furniture, article or name in ARTICLES, places))
            begin()
    add(page[at:])
    for block in out:
        block.parts = " ".join("".join(block.parts).split())
    return [b for b in out if b.parts]


def first_pass(block: Block, has_article: bool) -> bool | None:
    """True: text, False: none, None: undecided."""
    size = len(block.parts)
    if block.furniture or has_article and not block.article:
        return False
    if block.linked > LINKED * len(block.parts.replace(" ", "")):
        return False
    words = WORDS.findall(block.parts.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if block.article:
        return True if size >= SHORT or stops >= FEW_STOPS else None
    if size < SHORT:
        return False if block.linked else None
    if stops >= MANY_STOPS:
        return True
    if stops >= FEW_STOPS:
        return True if size > LONG else None
    return False


def second_pass(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided one, of two as near the next one's.

    In an article only its own blocks count, and where none is decided all are text; a heading looks ahead first.
    """
    size = len(labels)
    before, after = [-1] * size, [-1] * size
    last: dict[bool, int] = {}
    for side, order in ((before, range(size)), (after, range(size - 1, -1, -1))):
        last.clear()
        for i in order:
            side[i] = last.get(found[i].article and not found[i].furniture, -1)
            if labels[i] is not None:
                last[found[i].article and not found[i].furniture] = i
    out = []
    for i, label in enumerate(labels):
        if label is None:
            a, b = before[i], after[i]
            ahead = b >= 0 and (a < 0 or found[i].heading or b - i <= i - a)
            label = labels[b] if ahead else labels[a] if a >= 0 else found[i].article
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    """Main text of a page; its blocks have single spaces inside and between them. Null or no text: empty."""
    found = blocks(page or "")
    has_article = any(b.article and not b.furniture for b in found)
    labels = second_pass(found, [first_pass(b, has_article) for b in found])
    return " ".join(b.parts for b, label in zip(found, labels) if label)


def extracted(pages: DataFrame, page: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of ``page`` in place of it, in the column ``text``.

    Every row gives a row, repeated ones and those without a page too; an empty table gives an empty one. A column already
    named ``text`` is replaced, all others stay.
    """
    rows = pages.select(*(F.col(c) for c in pages.columns if c not in (page, text)), F.col(page).alias(text))
    place = len(rows.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, place):
                texts = pa.array((main_text(x) for x in values(part.column(place))), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], part.schema.names)

    return rows.mapInArrow(run, rows.schema)
