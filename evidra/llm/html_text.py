"""Operator 1: main text of HTML pages by two passes of block rules.

A page is cut into blocks at block elements; script, style and the like are left out. Regions that are no
article by their element (nav, aside, footer, form, ...), by a class, id or role name (ad, cookie-bar, comments,
teaser, ...) or as articles within an article are a signal of the first pass: their blocks are bad, and no neighbours of
others. A name counts by its
parts: not where a part says that it tells of the page (has-sidebar, no-comments), and words that often tell of something
else (social, legal, ...) only where all other parts are words of layout. Wrappers are no such regions: what was named
out, a form or an article, if the page's first article or main element is inside and none outside, or if it holds a good
block and half of the page's text or more while no good block is outside. First pass: a block is good or bad by its
link density, its length and its density of stop words; short or doubtful blocks stay undecided. Second pass: an
undecided block takes the label of the nearest decided neighbour (the one before on a tie; a heading that of the next).
Where a page marks exactly one article or main region and no good block is outside it, blocks outside are bad, and
inside an undecided block without a decided neighbour is good; several such regions, or good blocks outside, bound nothing.

Tags are read in one pass: a quote opens an attribute's value only behind an equals sign, other values run to a blank or
the tag's end, and a quote that nothing closes opens nothing. The time is proportional to the page.

Defined cases: null and empty html give an empty text; unclosed elements end with the page and never
swallow it, but for script, style, textarea and title, whose text is no markup; every page gives one row (repeated rows and null ids
too); an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

# Element names and class words of HTML pages, and frequent function words.
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "canvas", "head", "title", "select", "button", "math", "video", "audio"}
SIBLING = {"p", "li", "dd", "dt"}  # end where the next of their kind begins
TEXT_ONLY = {"script", "style", "textarea", "title"}  # without an end tag the rest of the page is theirs
OUT = {"nav", "aside", "footer", "form", "menu", "dialog"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br"}
OUT_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert "
    "popup modal overlay newsletter subscribe signup paywall sidebar aside menu nav navbar navigation breadcrumb breadcrumbs toc footer masthead "
    "comment comments commentlist disqus replies reply respond share sharing social related recommended recommendations teaser widget pagination "
    "pager login search skip byline metadata tags copyright legal disclaimer complementary contentinfo".split()
)
ABOUT_WHETHER = set("has have no not without with hide hides hidden show shows is are off on enable enabled disable disabled layout free".split())
#: Words that are names of regions only beside words of layout: not `social-history`, `legal-news`.
WEAK = set("alert social share sharing legal notice respond login search skip tags copyright metadata related toc recommended reply promo promotion".split())
LAYOUT = set("bar box bars list wrap wrapper container content inner outer block section area item items link links button buttons btn icon icons top bottom left right widget module panel form js id col row post posts article articles page media my the main header content".split())
ABOUT_PAGE = ABOUT_WHETHER | set("page site main article post entry".split())
STOP = set(
    "the of and to a in is that for it as was with be by on not he his this are or from at which but have an had they you were their "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son elle "
    "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am "
    "que el los y del se las por con no una su para es al lo como mas o pero sus le ya este si porque esta entre cuando".split()
)

_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_STOPS = re.compile("[=>]")
_VALUE_END = re.compile(r"[\s>]")
_NOT_BLANK = re.compile(r"\S")
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-zà-öø-ÿ]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


@dataclass
class Block:
    text: str
    linked: int
    bound: int  # number of the outermost article or main element around it; -1: none
    regions: tuple[int, ...]
    heading: bool = False
    out: bool = False

    @property
    def article(self) -> bool:
        return self.bound >= 0


def _names_out(name: str) -> bool:
    """Whether a class, id or role name tells that its element is no article: `comments`, `site-footer`, `adBox`, not `has-sidebar`."""
    parts = [w.lower() for w in _PART.findall(name)]
    hits = [w in OUT_WORDS for w in parts]
    if not any(hits):
        return False
    others = {w for w, h in zip(parts, hits, strict=True) if not h}
    if not {w for w, h in zip(parts, hits, strict=True) if h} - WEAK and others - LAYOUT - ABOUT_PAGE:
        return False
    return not others & ABOUT_PAGE or hits[-1] and not others & ABOUT_WHETHER


def _is_out(name: str, attrs: str, in_article: bool) -> bool:
    if name in OUT or name == "header" and not in_article:
        return True
    if not attrs or name in ("body", "html", "main"):
        return False
    return any(_names_out(w) for m in _NAMED.finditer(attrs) for w in (m[1] or m[2] or m[3] or "").split()) or bool(_HIDDEN.search(attrs))


class _Tags:
    """The tags of a page from left to right: (start, end, closing, name, attributes); name is empty for comments and the like."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.none_after = {'"': len(page), "'": len(page)}  # from where on no such quote is left

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        page = self.page
        while m := _OPEN.search(page, at):
            if m[2]:
                end = self._end(m.end())
                if end:
                    return m.start(), end, bool(m[1]), m[2].lower(), page[m.end() : end - 1]
                at = m.end()  # no tag: text
                continue
            close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
            end = page.find(close, m.end())
            return m.start(), end + len(close) if end >= 0 else len(page), False, "", ""
        return None

    def _end(self, at: int) -> int:
        """Behind the > that ends the tag whose attributes begin at at; 0 without one."""
        while at <= self.last:
            m = _STOPS.search(self.page, at)
            if not m or m[0] == ">":
                return m.end() if m else 0
            value = _NOT_BLANK.search(self.page, m.end())
            if not value:
                return 0
            at = value.start()
            if value[0] in self.none_after:
                closing = self.page.find(value[0], at + 1) if at < self.none_after[value[0]] else -1
                if 0 <= closing < self.last:
                    at = closing + 1
                    continue
                if closing < 0:
                    self.none_after[value[0]] = min(at, self.none_after[value[0]])
                at += 1
            end = _VALUE_END.search(self.page, at)
            if not end:
                return 0
            at = end.start()
        return 0


def _lower(text: str) -> str:
    """Lower case with every offset kept: U+0130 alone would become two code points."""
    return text.replace("\u0130", "\ufffd").lower()


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, white space made one space."""
    found: list[Block] = []
    text: list[str] = []
    linked, links, n_bounds, at = 0, 0, 0, 0
    open_regions: list[tuple[str, int, int]] = []  # name, how often its element was open then, number
    opened: dict[str, int] = {}
    soft: set[int] = set()  # regions that may turn out to be wrappers
    bounding: list[bool] = []  # open article and main elements: is it an article
    around: tuple[int, ...] | None = None  # regions around the first article or main element
    number, last_end, within = 0, {}, set()  # within: regions that are articles within an article
    lower, heading, tags = _lower(page), False, _Tags(page)

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                found.append(Block(whole, linked, n_bounds if bounding else -1, tuple(r[2] for r in open_regions), heading))
            text.clear()
        linked = 0

    def closes(tag: str) -> bool:
        """Whether an end tag follows."""
        if tag not in last_end:
            last_end[tag] = lower.rfind(f"</{tag}")
        return last_end[tag] >= at

    def after_end(tag: str) -> int | None:
        """Behind the next end tag of this name."""
        here = at
        while closes(tag) and (start := lower.find(f"</{tag}", here)) >= 0:
            here = start + len(tag) + 2
            if lower[here : here + 1] in ("", ">", "/") or lower[here].isspace():
                end = lower.find(">", here)
                return end + 1 if end >= 0 else len(page)
        last_end[tag] = -1  # what looked like one is of a longer name
        return None

    for start, stop, close, name, attrs in iter(lambda: tags.next(at), None):
        if start > at:
            piece = page[at:start]
            text.append(piece)
            linked += len(piece.strip()) if links else 0
        at = stop
        if not name:
            continue
        if name in RAW and not close:
            if not attrs.endswith("/"):
                end = after_end(name)
                at = end if end else (len(page) if name in TEXT_ONLY else at)
            text.append(" ")
            continue
        if name == "br":
            text.append(" ")
            continue
        if name == "a":
            links = 0 if close else 1
        void = name in VOID or name in INLINE and attrs.endswith("/")
        ends = close or name in SIBLING and bool(open_regions) and open_regions[-1][0] == name
        ended = next((k for k, r in enumerate(open_regions) if r[0] == name and r[1] == opened.get(name, 0)), None) if ends else None
        nested = name == "article" and any(bounding)
        region = not close and not void and (_is_out(name, attrs, bool(bounding)) or nested) and (name in SIBLING or closes(name))
        if name not in INLINE or region or ended is not None:
            flush()
            heading = bool(re.fullmatch("h[1-6]", name)) and not close
        if ended is not None:  # and with it what was left open inside
            del open_regions[ended:]
        if close:
            opened[name] = max(0, opened.get(name, 0) - 1)
        elif not void:
            opened[name] = opened.get(name, 0) + (not (name in SIBLING and ended is not None))
        if region:
            open_regions.append((name, opened[name], number))
            if name == "form" or name not in OUT and name != "header":
                soft.add(number)
            if nested and not _is_out(name, attrs, True):
                within.add(number)
            number += 1
        if name in ("article", "main"):
            if close:
                bounding[-1:] = []
            else:
                n_bounds += not bounding
                bounding.append(name == "article")
                if not region and (around is None or around and not open_regions):
                    around = tuple(r[2] for r in open_regions)
    if at < len(page):
        text.append(page[at:])
        linked += len(page[at:].strip()) if links else 0
    flush()
    return _judged(found, soft, {r for r in around or () if r in soft}, within)


def _judged(found: list[Block], soft: set[int], wrappers: set[int], within: set[int]) -> list[Block]:
    """The blocks, out where a region that is no wrapper holds them."""
    good, whole = [bool(first_pass(b, False)) for b in found], sum(len(b.text) for b in found)
    while True:
        for b in found:
            b.out = any(r not in wrappers for r in b.regions)
        if any(g and not b.out for g, b in zip(good, found, strict=True)):
            return found
        size: dict[int, int] = {}
        for b in found:
            for r in soft.intersection(b.regions) - wrappers:
                size[r] = size.get(r, 0) + len(b.text)
        more = [r for r, n in size.items() if 2 * n >= whole and any(g and r in b.regions for g, b in zip(good, found, strict=True))]
        if not more and within <= wrappers:
            return found
        wrappers = wrappers | ({min(more)} if more and min(more) not in within else within)  # the outermost one, or all articles of a list


def first_pass(b: Block, marked: bool, long: int = 200, short: int = 70) -> bool | None:
    """True: good, False: bad, None: undecided. marked: the page has an article region."""
    if b.out or marked and not b.article:
        return False
    density = b.linked / len(b.text)
    if density > 0.5:
        return False
    words = b.text.lower().split()
    stops = sum(w.strip(".,;:!?&*%$#\"'()") in STOP for w in words) / len(words)
    if len(b.text) >= short and stops >= (0.3 if len(b.text) < long else 0.15):
        return True
    if len(b.text) >= long:
        return True if b.article else (None if density < 0.2 else False)
    return None


def second_pass(labels: list[bool | None], default: bool, headings: list[bool] | None = None) -> list[bool]:
    """Undecided ones take the label of their nearest decided neighbours; headings that of the next."""
    before: list[tuple[int, bool] | None] = []
    last = None
    for k, x in enumerate(labels):
        if x is not None:
            last = (k, x)
        before.append(last)
    out, after = [True] * len(labels), None
    for k in range(len(labels) - 1, -1, -1):
        if labels[k] is not None:
            after = (k, labels[k])
            out[k] = labels[k]
        elif before[k] is None and after is None:
            out[k] = default
        elif headings and headings[k] and after is not None:
            out[k] = after[1]
        elif before[k] is None or after is None:
            out[k] = (before[k] or after)[1]
        else:
            out[k] = before[k][1] if k - before[k][0] <= after[0] - k else after[1]
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    marked = len({b.bound for b in found if b.article and not b.out}) == 1 and not any(first_pass(b, False) for b in found if not b.article)
    # blocks of left-out regions, and those outside the article, say nothing about their neighbours
    found = [b for b in found if not b.out and (b.article or not marked)]
    labels = second_pass([first_pass(b, marked) for b in found], marked or sum(len(b.text) for b in found) >= 70, [b.heading for b in found])
    return " ".join(b.text for b, keep in zip(found, labels, strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars): the main text of each page and its code points."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html_col):
            texts = [main_text(h) for h in batch.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column(url_col), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
