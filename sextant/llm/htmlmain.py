"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of tokens: each word scores its weight, which is positive, and each tag a negative one. The
contiguous run with the largest sum is the content region; one linear scan finds it. Weights are log-odds of a
token's kind inside and outside the main text of the labelled pages, so a word in running text counts more than one in a link. Menus, headers, footers,
sidebars, notices, adverts, forms and comments that are marked as such by element or by a word of class, id or role score like tags, or nothing where they are set into an article, and their
words are no part of the text even inside the region. A class that only says what a page has (``has-sidebar``, ``comments-open``) marks nothing, and the page's first
article or main element ends an outer mark that is no menu, footer or sidebar by its element.

The region is made whole: if the run meets article elements, it is these (else main elements, with the headings right before them); on other pages it grows to the ends of its
blocks and takes the headings right before it. Nothing inside the region is dropped but marked containers. The region's blocks give the text.

Defined cases: a null or empty page, and one without words outside marked containers, gives the empty text; a tag, comment or
container cut off by the page's end is markup to the end, but an article or main element ends an open container that is never closed, and a marked paragraph, list item or
table cell without end tag ends where HTML ends it; unknown references
stay as written; repeated rows are extracted one by one; other columns are ignored. A page of any size is read whole, in time linear in it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*(?:>|\Z)|[^>]*(?:>|\Z))""", re.S)
_MARKS = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PIECES = re.compile(r"[a-z]+")

# Element names of the HTML standard by their part in the page.
RAW = frozenset("script style noscript template iframe svg math object canvas textarea select title head".split())
CONTAINERS = frozenset("nav footer aside form dialog button menu".split())
BLOCKS = frozenset("address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Words in class, id or role that mark a container as no part of the article.
MARKED = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus disclaimer footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related replies respond sidebar share sharing signup skip social sponsor sponsored subscribe subscription toolbar widget".split())


# Words that make a class one of what a page has or of its state, or the name of the content itself.
STATES = frozenset("has is with without no not open opened closed enabled disabled free on off allowed ready supports support active".split())
CONTENT = frozenset("article content main post entry story body page layout wrapper".split())
# Elements whose end tag may be left out, the containers that nest them, and page parts that no article inside unmarks.
OPTIONAL = frozenset("p li td th dd dt tr".split())
NESTING = frozenset("ul ol dl table".split())
FIRM = frozenset("nav footer aside dialog menu button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Token(NamedTuple):
    kind: str  # a tag's name, or word, linked, marked, inset or space
    count: int  # words of a text, 1 for a tag
    text: str
    end: bool = False  # of an end tag


def _is_marked(name: str, attributes: str, depth: int) -> bool:
    if name in CONTAINERS or name == "header" and not depth:
        return True
    if name in ("html", "body", "main") or "=" not in attributes:
        return False
    marked = False
    for m in _MARKS.findall(attributes):
        for value in "".join(m).split():
            parts = set(_PIECES.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
            if parts <= CONTENT and parts:
                return False
            marked = marked or not MARKED.isdisjoint(parts) and STATES.isdisjoint(parts)
    return marked


def _ends_itself(skip: str, name: str, closing: bool, nested: int) -> bool:
    """Does this tag end the open marked element ``skip``, whose own end tag may be left out?"""
    if skip not in OPTIONAL or nested:
        return False
    if closing:
        return name in NESTING or name in ("div", "section", "article", "main", "body", "tbody", "tr") and name != skip
    if skip == "p":
        return name in BLOCKS and name != "br"
    return name == skip or skip in ("td", "th") and name in ("td", "th", "tr") or skip in ("dd", "dt") and name in ("dd", "dt")


def tokens(page: str) -> Iterator[Token]:
    """The page's tags and texts in order; contents of raw elements and comments are left out."""
    at, skip, firm, depth, nested, links, inside, seen = 0, "", False, 0, 0, 0, 0, False  # inside: open article or main elements

    def text(upto: int) -> Iterator[Token]:
        piece = html.unescape(page[at:upto])
        if n := len(piece.split()):
            yield Token("inset" if skip and inside else "marked" if skip else "linked" if links else "word", n, piece)
        elif piece:
            yield Token("space", 0, piece)

    while m := _MARKUP.search(page, at):
        yield from text(m.start())
        at, name, closing = m.end(), (m[2] or "").lower(), bool(m[1])
        if not name:
            continue
        if skip and _ends_itself(skip, name, closing, nested):
            skip, depth = "", 0
        if closing:
            links -= name == "a" and links > 0
            nested -= bool(skip) and name in NESTING and nested > 0
            if name == skip:
                depth -= 1
                skip = skip if depth else ""
            elif not skip:
                inside -= name in ("article", "main") and inside > 0
        elif name in RAW:
            end = re.compile(rf"</{name}\s*>|<(?=body\b)" if name == "head" else rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() - (name == "head" and end[0] == "<") if end else len(page)
            yield Token(name, 1, "")
            continue
        else:
            links += name == "a"
            if name in ("article", "main") and skip and not inside:
                own = _is_marked(name, m[3], 0)
                if not own and (not firm and not seen or not re.compile(rf"</{re.escape(skip)}\b", re.I).search(page, at)):
                    skip, depth, links = "", 0, 0  # the mark of what only holds the article, or of a container that never ends
            if skip:
                depth += name == skip
                nested += name in NESTING
            elif name not in VOID and _is_marked(name, m[3], inside):
                skip, firm, depth, nested = name, name in FIRM, 1, 0
            inside += name in ("article", "main") and not skip
            seen = seen or name in ("article", "main") and not skip
        yield Token("inset" if skip and inside else name, 1, "", closing)
    yield from text(len(page))


@cache
def weights() -> dict[str, float]:
    """Log-odds of each kind of token; words at least 0.1 above zero, tags and marked words at least 0.1 below."""
    from sextant.llm.labelled_pages import PAGES

    inside: Counter = Counter()
    outside: Counter = Counter()
    for page in PAGES:
        before, rest = page.split("<!--main-->")
        main, after = rest.split("<!--/main-->")
        for part, into in ((before, outside), (main, inside), (after, outside)):
            for t in tokens(part):
                into[t.kind] += t.count
    kinds = {*inside, *outside} - {"space", "inset"}
    a, b = inside.total() + len(kinds), outside.total() + len(kinds)
    odds = {k: math.log((inside[k] + 1) / a) - math.log((outside[k] + 1) / b) for k in kinds}
    floor = min(odds.values())
    return {k: max(0.1, v) if k == "word" else min(-0.1, v) for k, v in odds.items()} | {"marked": floor, "inset": 0.0, "space": 0.0, "": -0.1}


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the largest positive sum, the first and shortest of equals; (0, 0) if none is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, found = total, (start, k + 1)
    return found


def _elements(ts: list[Token], name: str) -> list[tuple[int, int]]:
    """[start, end) of the outermost elements of this name; one that is not closed goes to the end."""
    out, depth, start = [], 0, 0
    for k, t in enumerate(ts):
        if t.kind == name:
            if not t.end:
                depth, start = depth + 1, start if depth else k
            elif depth:
                depth -= 1
                if not depth:
                    out.append((start, k + 1))
    return out + [(start, len(ts))] * (depth > 0)


def _whole(ts: list[Token], lo: int, hi: int) -> list[tuple[int, int]]:
    """The spans of tokens that make the region of a run whole."""
    for name in ("article", "main"):
        spans = [s for s in _elements(ts, name) if s[0] < hi and s[1] > lo]
        if spans:
            lo, hi = spans[0][0], -1
            break
    else:
        spans = [(lo, hi)]
        while hi < len(ts) and ts[hi].kind not in BLOCKS and ts[hi].kind not in ("marked", "inset"):
            hi += 1
        while lo and ts[lo - 1].kind not in BLOCKS and ts[lo - 1].kind not in ("marked", "inset"):
            lo -= 1
        spans = [(lo, hi)]
    k = lo  # headings right before: nothing else but tags between them and the region
    while k and ts[k - 1].kind not in ("marked", "inset"):
        k -= 1
        if ts[k].kind in HEADINGS and not ts[k].end:
            lo = k
        elif ts[k].kind in ("word", "linked") and not any(t.kind in HEADINGS and not t.end for t in _back(ts, k)):
            break
    return [(lo, spans[0][1]), *spans[1:]]


def _back(ts: list[Token], k: int) -> Iterator[Token]:
    """The tags before a text up to the block that it is in."""
    while k:
        k -= 1
        yield ts[k]
        if ts[k].kind in BLOCKS:
            return


def main_text(page: str) -> str:
    """Blocks of the content region, one per line."""
    w, ts = weights(), list(tokens(page))
    lo, hi = best_run([t.count * w.get(t.kind, w[""]) for t in ts])
    if lo == hi:
        return ""
    blocks, open_ = [], []
    for lo, hi in _whole(ts, lo, hi):
        for t in ts[lo:hi]:
            if t.kind in ("word", "linked", "space"):
                open_.append(t.text)
            elif t.kind in BLOCKS or t.kind == "inset":
                blocks.append("".join(open_))
                open_ = []
        blocks.append("".join(open_))
        open_ = []
    return "\n".join(x for b in blocks if (x := " ".join(b.split())))


def extract(pages: DataFrame, text_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""
    rows = pages.select("page_id", "url", F.col(text_col).cast("string").alias("html"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [main_text(x.as_py() or "") for x in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = [f.dataType.simpleString() for f in rows.schema.fields]
    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
