"""Main text of HTML pages by two-pass block rules.

A page becomes blocks at block-level tags. Each block has its number of words, stop-word density, link density and
the kind of element it stands in. Pass one calls blocks good or bad by those figures alone, and leaves short blocks
and middling ones open. Pass two gives every open block the label of its nearest decided neighbours: of both if they
agree, of the nearer one otherwise, within the same container where there is one. Headings lean towards the text
that follows them.

Elements whose purpose is not text (menus, footers, forms, adverts, notices, reader comments and the like, by tag,
role, class or id) decide their blocks in pass one. Article and main elements decide nothing there: where they hold at
least as many words of good blocks as the rest of the page, blocks that pass two can't settle by their neighbours lean
to good inside them and to bad outside; where they hold fewer, as cards beside a body do, they lean to bad. On a page
with hardly any stop word at all (a language without a list) low density rejects nothing.

One pass over the rows, no shuffle; memory is one Arrow batch. Whole pages, no caps.

Defined results: null or empty html gives empty text; broken mark-up is read as a browser would, unclosed elements
end with their parent; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import pick

# Element names of the HTML standard, and frequent function words of four languages.
BLOCK_TAGS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW_TAGS = frozenset("script style noscript template textarea title iframe noembed noframes svg math object canvas select".split())
DROPPED_TAGS = frozenset("nav footer aside form header menu dialog button fieldset label head audio video map".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar note".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial alert author-box banner breadcrumb breadcrumbs byline-share comment comments comment-list "
    "consent cookie cookies copyright cta disclaimer disqus dropdown feedback footer form gdpr header hidden legal login masthead menu menubar message meta modal "
    "nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup privacy promo promotion promoted reactions read-more recirculation "
    "recommended related replies reply respond responses search share sharing sidebar sidenav signup site-footer site-header skip skip-link social sponsor sponsored "
    "subscribe subscription tags teaser toc toolbar topbar trending warning widget widgets discussion topnav sub-nav side rail infobar flash bottom-bar top-bar".split()
)
#: Names that say nothing as a part of a compound name.
WEAK_PARTS = frozenset("hidden message meta form side legal flash warning alert note feedback reply replies respond responses reactions discussion tags rail login dropdown overlay privacy search skip".split())
DROPPED_PARTS = DROPPED_WORDS - WEAK_PARTS
CONTENT_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he i this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen "
    "le la les de des et un une du que qui en dans est pour par sur au pas avec ce il plus se ne sont sa ou son aux cette "
    "el los las del y que en un una por con no para su es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son".split()
)
EDGES = ".,;:!?\"'()[]{}<>«»“”„‘’…–—¿¡#$%&*+-/=@\\^_`|~"
#: Words from which a block is long enough to be decided alone; densities of stop words and of words in links.
LONG_WORDS, SHORT_WORDS, STOP_HIGH, STOP_LOW, LINK_HIGH = 25, 8, 0.15, 0.05, 0.35

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR_NAME = re.compile(r"[\s/]*([^\s/>=]*)\s*(=?)\s*")
_BARE = re.compile(r"[^\s>]*")
_PARTS = re.compile(r"[-_]+")
_KEPT_ATTRS = frozenset("class id role hidden aria-hidden style".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE) for t in RAW_TAGS}
_CLOSES_P = BLOCK_TAGS - {"br"}
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_FENCE = frozenset("ul ol dl table div section article main body aside nav header footer form blockquote figure".split())


class Scanner:
    """Tags of a page from left to right, each character looked at a bounded number of times.

    Attributes are read by name; quotes count only after an equals sign, and one that nothing closes ends at the next
    ``>``. What isn't there beyond some position (a quote, a ``>``) is remembered, not searched for again.
    """

    def __init__(self, html: str):
        self.html, self.absent = html, set()

    def find(self, what: str, at: int) -> int:
        if what in self.absent:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def next(self, at: int) -> tuple[int, int, str, bool, dict[str, str], bool] | None:
        """(start, end, name, is an end tag, attributes that matter, closes itself); the name is empty for comments and the like."""
        html = self.html
        while (start := self.find("<", at)) >= 0:
            head = html[start + 1 : start + 2]
            if html.startswith("<!--", start):
                end = self.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(html), "", False, {}, False
            closing = head == "/"
            name = _NAME.match(html, start + 1 + closing)
            if name:
                attrs, end, itself = self.attributes(name.end())
                return start, end, name[0].lower(), closing, attrs, itself
            if head in ("!", "?", "/") and head and (end := self.find(">", start)) >= 0:
                return start, end + 1, "", False, {}, False
            at = start + 1
        return None

    def attributes(self, at: int) -> tuple[dict[str, str], int, bool]:
        html, attrs = self.html, {}
        while at < len(html):
            m = _ATTR_NAME.match(html, at)
            name, value = m[1].lower(), ""
            at = m.end()
            if m[2]:
                quote = html[at : at + 1]
                if quote in ('"', "'") and quote:
                    end = self.find(quote, at + 1)
                    if end < 0:
                        end = self.find(">", at)
                        end = len(html) if end < 0 else end
                        value, at = html[at + 1 : end], end
                    else:
                        value, at = html[at + 1 : end], end + 1
                else:
                    bare = _BARE.match(html, at)
                    value, at = bare[0], bare.end()
            if name in _KEPT_ATTRS and name not in attrs:
                attrs[name] = unescape(value).lower()
            if html[at : at + 1] == ">":
                return attrs, at + 1, html[at - 1] == "/"
        return attrs, len(html), False


def _is_dropped(tag: str, attrs: dict[str, str]) -> bool:
    """By tag, role, hiding attributes, whole class or id names, and the first or last part of compound names.

    Parts such as ``hidden`` or ``message`` say nothing about a compound name (``overflow-hidden``, ``message-body``).
    """
    if tag in DROPPED_TAGS:
        return True
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""):
        return True
    if attrs.get("role") in DROPPED_ROLES:
        return True
    if tag in ("body", "html"):
        return False
    for word in (attrs.get("class", "") + " " + attrs.get("id", "")).split():
        if word in DROPPED_WORDS:
            return True
        parts = _PARTS.split(word)
        if tag not in CONTENT_TAGS and len(parts) > 1 and not DROPPED_PARTS.isdisjoint((parts[0], parts[-1])):
            return True
    return False


class Block:
    __slots__ = ("text", "words", "linked", "stops", "tag", "dropped", "content", "label")

    def __init__(self, text: str, linked: int, tag: str, dropped: bool, content: int):
        self.text, self.tag, self.dropped, self.content = text, tag, dropped, content
        words = text.split()
        self.words, self.linked = len(words), linked
        self.stops = sum(w.strip(EDGES).lower() in STOP_WORDS for w in words)
        self.label = ""


def blocks_of(html: str) -> list[Block]:
    """Blocks in page order, white space made single; blank ones left out."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # tag, dropped, number of the content element or 0
    places: dict[str, list[int]] = {}  # of open tags in the stack
    fences: list[int] = []
    blocks: list[int] = []  # open block tags, for the tag that a block stands in
    parts: list[str] = []
    linked_parts: list[str] = []
    contents = at = 0
    scanner = Scanner(html)

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split())
        if text:
            linked = len(unescape(" ".join(linked_parts)).split())
            out.append(Block(text, linked, stack[blocks[-1]][0] if blocks else "", bool(stack) and stack[-1][1], stack[-1][2] if stack else 0))
        parts.clear()
        linked_parts.clear()

    def last(tags: tuple[str, ...]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def pop_to(index: int) -> None:
        while len(stack) > index:
            places[stack.pop()[0]].pop()
        for held in (fences, blocks):
            while held and held[-1] >= index:
                held.pop()

    def close(tags: tuple[str, ...]) -> None:
        """Ends the innermost open element of these tags, if no fence is between."""
        i = last(tags)
        if i >= 0 and i > (fences[-1] if fences else -1):
            pop_to(i)

    def say(text: str) -> None:
        parts.append(text)
        if places.get("a"):
            linked_parts.append(text)

    while at < len(html):
        found = scanner.next(at)
        say(html[at : found[0]] if found else html[at:])
        if not found:
            break
        _, at, tag, closing, attrs, itself = found
        if not tag:
            continue
        if closing:
            if tag in BLOCK_TAGS:
                flush()
            if tag in _FENCE or tag in BLOCK_TAGS or tag == "a":
                if (i := last((tag,))) >= 0:
                    pop_to(i)
            else:
                close((tag,))
            continue
        if tag in RAW_TAGS:
            if tag == "title":
                flush()
            if not itself or tag not in ("svg", "math", "object", "canvas", "iframe"):
                end = _RAW_END[tag].search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag in BLOCK_TAGS:
            flush()
            if tag in _CLOSES_P:
                close(("p", *HEADINGS) if tag in HEADINGS else ("p",))
        if tag in _SAME:
            close(_SAME[tag])
        if tag in VOID_TAGS:
            continue
        dropped, content = stack[-1][1:] if stack else (False, 0)
        if tag in CONTENT_TAGS and not dropped:
            contents += 1
            content = contents
        header_of_article = tag == "header" and content
        if tag == "body" or tag == "html":
            dropped = False
        elif not header_of_article:
            dropped = dropped or _is_dropped(tag, attrs)
        for held, yes in ((fences, tag in _FENCE), (blocks, tag in BLOCK_TAGS)):
            if yes:
                held.append(len(stack))
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, dropped, content))
    flush()
    return out


def _nearest(blocks: list[Block], first: list[str], order: range) -> list[int]:
    """For each block the nearest decided one before it in ``order``, of the same container, or -1."""
    out, seen = [-1] * len(blocks), {}
    for i in order:
        b = blocks[i]
        out[i] = seen.get(b.content, -1)
        if first[i] and not (b.content and b.dropped):
            seen[b.content] = i
    return out


def label_blocks(blocks: list[Block]) -> None:
    """Pass one decides what figures alone can decide; pass two lets open blocks inherit."""
    free = [b for b in blocks if not b.dropped]
    known = sum(b.stops for b in free) >= STOP_LOW * sum(b.words for b in free)
    for b in blocks:
        links, stops = b.linked / b.words, b.stops / b.words
        if b.dropped:
            b.label = "bad"
        elif links > LINK_HIGH and b.tag not in HEADINGS:
            b.label = "bad"
        elif b.words >= LONG_WORDS:
            b.label = "good" if stops >= STOP_HIGH or not known else "bad" if stops < STOP_LOW else ""
        elif b.words >= SHORT_WORDS and stops >= STOP_HIGH:
            b.label = "good"
    first = [b.label for b in blocks]
    has_content = any(b.content for b in free)
    main = has_content and sum(b.words if b.content else -b.words for b in free if b.label == "good") >= 0
    sides = (_nearest(blocks, first, range(len(blocks))), _nearest(blocks, first, range(len(blocks) - 1, -1, -1)))
    for i, b in enumerate(blocks):
        if b.label:
            continue
        near = [(abs(side[i] - i), first[side[i]]) if side[i] >= 0 else (len(blocks) + 1, "") for side in sides]
        (left_d, left), (right_d, right) = near
        lean = "good" if main == bool(b.content) else "bad"
        if left == right:
            b.label = left or (lean if main or b.content else "good" if b.tag not in ("li", "td", "th", "a") else "bad")
        elif b.tag in HEADINGS and right:
            b.label = right
        elif main or b.content:
            b.label = lean
        else:
            b.label = left if left and left_d <= right_d or not right else right


def main_text(html: str) -> str:
    blocks = blocks_of(html)
    label_blocks(blocks)
    return " ".join(b.text for b in blocks if b.label == "good")


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text for every row."""
    pages = pick(df, page_id=id_col, url=url_col, html=html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(h.as_py() or "") for h in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], names=["page_id", "url", "text"])

    types = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return pages.mapInArrow(run, f"{types}, text string").withColumn("n_chars", F.length("text").cast("bigint"))
