"""Main text of HTML pages by two passes of block rules.

The page is cut into tags, comments and text; tags that start or end a block close the block before
them, scripts, styles and the like are left out whole, and what stands in menus, headers, footers,
sidebars, forms, notices, adverts or reader comments (by element, role, class or id) is set aside. Where
a page has next to no good text outside such marks, a mark that holds most of it, in LAYOUT_BLOCKS good
blocks or more, is one of layout and void; marks of hidden parts, menus, comments and adverts always hold.
First pass, each other block alone: by link density, length and density of stop words it is good, bad,
near good or short. A block inside an article or main element starts one class higher. Second pass:
near-good blocks are good unless the nearest decided blocks before and after are bad; then short blocks
take the label of their nearest decided neighbours. Where these differ, a block of an article or main
element is good, a heading follows the block after it, and others are bad. Short lines that state rights
are bad outside an article. A page of short texts alone keeps them.

Blocks inside and outside of article and main elements are judged alike, but a short block only by
neighbours on its own side of the border; without a decided one there it is bad.

Stop words tell only of the languages listed. Where blocks that reach STOP_HIGH hold less than KNOWN_SHARE
of the characters of a page's longer, link-poor blocks, its language counts as unknown and these blocks
are judged by length and link density alone: what is no list of links and no short line is near good or
good. Characters of scripts without spaces count as WIDE_CHARS each. On a page in a listed language a
long block of few stop words (a table's text, code) outside article and main is still bad.

Defined cases: null and empty pages give empty text; unclosed, crossed and unknown tags are read as
far as they go; a `<` that starts no tag is text; repeated rows give equal rows; other columns are
ignored; nothing is capped. A page is read in time proportional to its length, however broken it is.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import common

GOOD, NEAR, SHORT, BAD = "good", "near", "short", "bad"
LINK_SHARE, SHORT_CHARS, LONG_CHARS = 0.4, 70, 200
STOP_LOW, STOP_HIGH = 0.15, 0.30
KNOWN_SHARE = 0.2
WIDE_CHARS = 3  # what a sign of Chinese, Japanese or Thai tells, in letters

#: The commonest function words of a few languages.
STOP_WORDS = frozenset(
    "the of and to a in is that it was for on are as with this be by from at or an not have has "
    "le la les de des du un une et est en que qui dans pour par sur avec pas au aux "
    "der die das und von zu den dem mit sich des ist im nicht ein eine auf für als "
    "el los las y del se por con no su para lo al una".split()
)

_HIDDEN = "script style template noscript svg math iframe object canvas select textarea title head"
_RAW = frozenset("script style textarea title noscript iframe template xmp".split())
_SKIP = frozenset(_HIDDEN.split()) | frozenset("nav header footer aside form button dialog menu".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
_MAIN = frozenset(("article", "main"))
_SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_SIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended trending sidebar aside "
    "widget nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer toolbar comment comments commentlist "
    "reply replies respond disqus discussion skip copyright disclaimer alert warning paywall teaser toast".split()
)
_TOP_NAMES = frozenset(("header", "masthead"))  # of the page; inside an article they hold its title
_ABOUT = frozenset(("with", "has", "no", "without"))  # "has-sidebar" tells of a layout, not of the element
_WHOLE = frozenset(("html", "body", "main", "article"))
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)|<!--|<!\[CDATA\[|<[!?]")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS_OWN = frozenset(("p", "li", "h1", "h2", "h3", "h4", "h5", "h6"))
HIDDEN = "hidden"
#: Marks that always hold: what is not shown, true menus, and other people's words.
_ALWAYS = frozenset(_HIDDEN.split()) | frozenset(
    "hidden nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager comment comments commentlist reply replies respond "
    "disqus discussion footer contentinfo cookie cookies consent gdpr ad ads advert adverts advertisement advertising dialog modal popup".split()
)
LAYOUT_BLOCKS = 3  # good blocks that a mark of layout holds at the least
LAYOUT_SHARE = 0.1  # with less of a page's good text outside all marks, the mark that holds most of it is one of layout
_WORD = re.compile(r"[^\W\d_]+")
_WIDE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_RIGHTS = re.compile(r"^\W*(?:©|\(c\)|copyright\b)|all rights reserved", re.I)


class Block:
    """`side`: what put the block beside the main text (a class word, role or element), empty if nothing did."""

    __slots__ = ("parts", "link_chars", "side", "main", "heading", "label", "text")

    def __init__(self, side: str, main: bool, heading: bool) -> None:
        self.parts: list[str] = []
        self.link_chars, self.side, self.main, self.heading, self.label, self.text = 0, side, main, heading, "", ""


def _is_side(attributes: str, main: bool) -> str:
    """What in an element's own attributes puts it beside the main text; empty if nothing does."""
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            for word in value.split():
                parts = {p.lower() for p in _NAME_PARTS.findall(word)}
                beside = sorted(parts & _SIDE_NAMES) or not main and sorted(parts & _TOP_NAMES)
                if beside and not parts & _ABOUT:
                    return beside[0]
        elif name == "role":
            if value.lower() in _SIDE_ROLES:
                return value.lower()
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return HIDDEN
    return ""


class _Tags:
    """Tags of a page in order; every part of it is read once, however it is broken."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.missing = dict.fromkeys((">", '"', "'", "-->", "]]>"), len(page) + 1)  # from here on there is none

    def _find(self, what: str, at: int) -> int:
        if at >= self.missing[what]:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing[what] = at
        return found

    def _end(self, at: int) -> int:
        """Place of the > that ends a tag, past quoted values; an open quote is an ordinary sign. -1: none."""
        while at < self.missing[">"]:
            found = _STOP.search(self.page, at)
            if found is None:
                self.missing[">"] = at
                return -1
            at = found.end()
            if found.group() == ">":
                return at - 1
            close = self._find(found.group(), at)
            if close >= 0 and self._find(">", close) >= 0:
                at = close + 1
        return -1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the next tag; without a name for what is no element."""
        found = _TAG.search(self.page, at)
        if found is None:
            return None
        start, at, opening = found.start(), found.end(), found.group()
        if found.group(2) is None:
            close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(opening, ">")
            end = self._find(close, at)
            if end < 0 and close == "]]>":
                close = ">"
                end = self._find(close, at)
            return start, len(self.page) if end < 0 else end + len(close), "", "", ""
        end = self._end(at)
        if end < 0:  # no tag ends any more: what is left is text
            return None
        return start, end + 1, found.group(1), found.group(2).lower(), self.page[at:end]


class _Open:
    """Open elements (tag, side, main, heading), with the places of each tag and of the last that is no inline element."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str, bool, bool]] = []
        self.where: dict[str, list[int]] = {}
        self.solid: list[int] = []
        self.walls: list[int] = []  # solid ones but paragraphs

    def push(self, name: str, side: str, main: bool, heading: bool) -> None:
        self.where.setdefault(name, []).append(len(self.stack))
        if name not in _INLINE:
            self.solid.append(len(self.stack))
            if name != "p":
                self.walls.append(len(self.stack))
        self.stack.append((name, side, main, heading))

    def cut(self, depth: int) -> None:
        """Close everything from a place on."""
        while len(self.stack) > depth:
            name = self.stack.pop()[0]
            self.where[name].pop()
            for places in (self.solid, self.walls):
                if places and places[-1] == len(self.stack):
                    places.pop()

    def last(self, name: str) -> int:
        places = self.where.get(name)
        return places[-1] if places else -1

    def state(self) -> tuple[str, bool, bool]:
        return self.stack[-1][1:] if self.stack else ("", False, False)


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order, side ones included."""
    out: list[Block] = []
    tags, open_ = _Tags(page), _Open()
    side, main, heading = open_.state()
    links = 0
    block = Block("", False, False)
    at, end = 0, len(page)

    def add(raw: str) -> None:
        if raw:
            block.parts.append(raw)
            if links:
                block.link_chars += len(raw.strip())

    def turn() -> Block:
        if block.parts:
            out.append(block)
        return Block(side, main, heading)

    while at < end:
        found = tags.next(at)
        if found is None:
            add(page[at:])
            break
        start, after, slash, name, attributes = found
        add(page[at:start])
        at = after
        if not name:
            continue
        if slash:
            if name == "a":
                links = max(links - 1, 0)
            depth = open_.last(name)
            inner = depth >= 0 and (not open_.solid or open_.solid[-1] < depth)  # only inline elements are open above it
            if name in _INLINE and (depth < 0 or inner) and not (depth >= 0 and open_.stack[depth][1] != side):
                if depth >= 0:
                    open_.cut(depth)
                continue
            if depth >= 0 and name not in _INLINE:
                open_.cut(depth)
                side, main, heading = open_.state()
                links = len(open_.where.get("a", ()))
            block = turn()
            continue
        if name in _RAW and not attributes.endswith("/"):
            close = _close_of(name).search(page, at)
            at = close.end() if close else end
            block = turn()
            continue
        if name == "br" or name == "hr":
            block = turn()
            continue
        if name in _VOID:
            continue
        hinted = _is_side(attributes, main) if attributes and name not in _WHOLE else ""
        mine = side or (name if name in _SKIP and not (name == "header" and main) else "") or hinted
        if name in _INLINE and mine == side:
            open_.push(name, side, main, heading)
            links += name == "a"
            continue
        if name in _ENDS_OWN:  # these end an open one of their kind
            depth = open_.last(name)
            if depth >= 0 and (not open_.walls or open_.walls[-1] <= depth):
                open_.cut(depth)
                side, main, heading = open_.state()
                mine = side or (_is_side(attributes, main) if attributes else "")
                links = 0
        side, main, heading = mine, main or name in _MAIN, len(name) == 2 and name[0] == "h" and name[1] in "123456"
        open_.push(name, side, main, heading)
        links += name == "a"
        block = turn()
    if block.parts:
        out.append(block)
    kept = []
    for b in out:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
        if b.text:
            kept.append(b)
    return kept


def _few_links(block: Block, inside_main: bool) -> bool:
    n = len(block.text)
    return block.link_chars <= LINK_SHARE * n and (inside_main or n >= LONG_CHARS or not _RIGHTS.search(block.text))


def _stops(block: Block) -> float:
    """Density of stop words."""
    found = _WORD.findall(block.text.lower())
    return sum(w in STOP_WORDS for w in found) / len(found) if found else 0.0


def knows_language(blocks: list[Block]) -> bool:
    """Whether stop words can judge a page: enough of its longer text is dense in them."""
    long = [b for b in blocks if _letters(b.text) >= SHORT_CHARS and _few_links(b, b.main)]
    return sum(len(b.text) for b in long if _stops(b) >= STOP_HIGH) >= KNOWN_SHARE * sum(len(b.text) for b in long)


def _letters(text: str) -> int:
    """Length in letters of alphabets."""
    return len(text) if text.isascii() else len(text) + (WIDE_CHARS - 1) * len(_WIDE.findall(text))


def first_pass(block: Block, inside_main: bool, known: bool = True) -> str:
    if not _few_links(block, inside_main):
        return BAD
    n = len(block.text) if known else _letters(block.text)
    if n < SHORT_CHARS:
        label = SHORT
    elif not known:
        label = GOOD if n > LONG_CHARS else NEAR
    else:
        stops = _stops(block)
        if stops >= STOP_HIGH:
            label = GOOD if n > LONG_CHARS else NEAR
        elif stops >= STOP_LOW:
            label = NEAR
        else:
            label = BAD
    if inside_main:
        return {BAD: NEAR, NEAR: GOOD}.get(label, label)
    return label


def _nearest(labels: list[str]) -> list[tuple[str, str]]:
    """The nearest decided label before and after each block, "" at the page's edge."""
    before, after, seen = [], [], ""
    for label in labels:
        before.append(seen)
        seen = label if label in (GOOD, BAD) else seen
    seen = ""
    for label in reversed(labels):
        after.append(seen)
        seen = label if label in (GOOD, BAD) else seen
    return list(zip(before, reversed(after)))


def second_pass(blocks: list[Block]) -> None:
    """Decide near-good blocks, then short ones, by their nearest decided neighbours."""
    for b, around in zip(blocks, _nearest([b.label for b in blocks])):
        if b.label == NEAR:
            b.label = BAD if around == (BAD, BAD) else GOOD
    if not any(b.label == GOOD for b in blocks):  # a page of short texts alone
        for b in blocks:
            b.label = GOOD if b.label == SHORT else b.label
    own = {}
    for main in (False, True):
        part = [b for b in blocks if b.main == main]
        own.update(zip(map(id, part), _nearest([b.label for b in part])))
    for b in blocks:
        if b.label == SHORT:
            before, after = own[id(b)]
            sides = {before, after} - {""}
            b.label = sides.pop() if len(sides) == 1 else GOOD if sides and b.main or b.heading and after == GOOD else BAD


@lru_cache(64)
def _close_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>", re.I)


def unmarked(blocks: list[Block]) -> list[Block]:
    """The blocks that no mark puts beside the main text.

    Where next to no text that the rules find good stands outside all marks, the mark that holds most of
    it tells of the page's layout (a form around everything, a builder's widgets, a class of its columns)
    and its blocks are judged like others.
    """
    found = [b for b in blocks if not b.side]
    marked = [b for b in blocks if b.side and b.side not in _ALWAYS]
    if marked:
        known = knows_language([*found, *marked])
        sizes = {id(b): len(b.text) for b in (*found, *marked) if first_pass(b, False, known) in (GOOD, NEAR)}
        inside, good = Counter(), Counter()
        for b in marked:
            inside[b.side] += sizes.get(id(b), 0)
            good[b.side] += id(b) in sizes
        outside = sum(sizes.get(id(b), 0) for b in found)
        layout = max(sorted(inside), key=inside.__getitem__)
        if outside < LAYOUT_SHARE * (outside + inside.total()) and good[layout] >= LAYOUT_BLOCKS:
            found = [b for b in blocks if not b.side or b.side == layout]
    return found


def main_text(page: str) -> str:
    blocks = unmarked(blocks_of(page))
    known = knows_language(blocks)
    for b in blocks:
        b.label = first_pass(b, b.main, known)
    second_pass(blocks)
    return "\n".join(b.text for b in blocks if b.label == GOOD)


def extract(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per row: key, url, text, n_chars (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (keys, urls), data in common.chunks(batches):
            found = [main_text(x.decode("utf-8", "replace")) for x in data]
            yield pa.RecordBatch.from_arrays([keys.cast(pa.int64()), urls, pa.array(found), pa.array([len(x) for x in found], pa.int64())], [key, url, "text", "n_chars"])

    rows = common.lean(df).select(F.col(f"`{key}`").alias("_key"), F.col(f"`{url}`").cast("string").alias("_url"), F.coalesce(F.col(f"`{page}`"), F.lit("")).alias("_page"))
    return rows.mapInArrow(run, f"`{key}` long, `{url}` string, text string, n_chars long")
