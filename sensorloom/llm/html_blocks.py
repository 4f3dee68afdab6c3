"""Leaf blocks of a web page: its texts in order, each with the tags and names around it."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

_SPECIAL = re.compile(r"[>\"']")
_OPENING = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_RAW = re.compile(r"<(script|style|textarea|title)(?=[\s/>])", re.IGNORECASE)
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in ("script", "style", "textarea", "title")}
# A slash after an unquoted value belongs to the value.
_EMPTY = re.compile(r"(?:^|[\s\"'])/\Z")
_NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Fixed values of the markup language: elements that stand inside a line, and elements without content.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("svg template select noscript iframe".split())
# A head ends at its end tag or, as that may be left out, at the first text or tag that is none of these.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
_HIDDEN_OPENING = re.compile(r"<(/?)(svg|template|select|noscript|iframe)(?=[\s/>])", re.IGNORECASE)
# An open paragraph ends where any block begins; these end where their own kind begins.
ENDS_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
KEEPS_OPEN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ()}


class Level:
    """An open element: its tag, the words of its names, and what is around it.

    What is new compared with the levels around it is kept apart, so that a page's levels take no more room than its tags.
    """

    __slots__ = ("tag", "names", "parent", "new_tag", "new_names", "nearest")

    def __init__(
        self, tag: str, names: frozenset[str], parent: Level | None, new_tag: bool, new_names: frozenset[str]
    ) -> None:
        self.tag, self.names, self.parent = tag, names, parent
        self.new_tag, self.new_names = new_tag, new_names
        self.nearest: frozenset[str] = names or (parent.nearest if parent else frozenset())

    def outwards(self) -> Iterator[Level]:
        """This level and those around it, without the page itself."""
        level: Level | None = self
        while level is not None and level.parent is not None:
            yield level
            level = level.parent


PAGE = Level("", frozenset(), None, False, frozenset())


@dataclass(frozen=True)
class Block:
    """A text, the innermost element around it, and the share of it in links."""

    text: str
    level: Level
    linked: float

    @property
    def tags(self) -> tuple[str, ...]:
        """The tags around the text, innermost last."""
        return tuple(level.tag for level in self.level.outwards())[::-1]

    @property
    def names(self) -> frozenset[str]:
        """The words of all names around the text."""
        return frozenset().union(*(level.new_names for level in self.level.outwards()))

    @property
    def nearest(self) -> frozenset[str]:
        """The words of the innermost name."""
        return self.level.nearest


class _Open:
    """The open elements of a page while it is read, with the places of each kind, so that no search walks them."""

    def __init__(self) -> None:
        self.levels = [PAGE]
        self.places: dict[str, list[int]] = {}
        self.worn: dict[str, int] = {}

    @property
    def top(self) -> Level:
        return self.levels[-1]

    def last(self, tags: tuple[str, ...]) -> int:
        """Place of the innermost element of some kinds, 0 if there is none."""
        return max((places[-1] for tag in tags if (places := self.places.get(tag))), default=0)

    def push(self, tag: str, names: frozenset[str]) -> None:
        fresh = frozenset(name for name in names if not self.worn.get(name))
        places = self.places.setdefault(tag, [])
        self.levels.append(Level(tag, names, self.top, not places, fresh))
        places.append(len(self.levels) - 1)
        for name in names:
            self.worn[name] = self.worn.get(name, 0) + 1

    def pop(self) -> None:
        level = self.levels.pop()
        self.places[level.tag].pop()
        for name in level.names:
            self.worn[name] -= 1

    def close(self, wanted: tuple[str, ...], stop: tuple[str, ...] = ()) -> None:
        """End the innermost wanted element and all inside it, unless one of the stops is inside it."""
        place = self.last(wanted)
        if place > self.last(stop):
            while len(self.levels) > place:
                self.pop()


@dataclass(frozen=True)
class _Token:
    """A stretch of markup; ``tag`` is empty for comments, declarations and elements with raw content."""

    start: int
    end: int
    tag: str = ""
    closing: bool = False
    names: str = ""


class _Markup:
    """A page with what its rest holds, so that looking for an end never reads a stretch twice."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.last_end = page.rfind(">")
        # For each quote and ">" the place of the ">" that ends a tag which reaches it outside quotes, or -1.
        self.special = [match.start() for match in _SPECIAL.finditer(page)]
        self.ends = [-1] * len(self.special)
        nearest = {'"': -1, "'": -1}
        for k in range(len(self.special) - 1, -1, -1):
            sign = page[self.special[k]]
            if sign == ">":
                self.ends[k] = self.special[k]
                continue
            closing = nearest[sign]
            if 0 <= closing < len(self.special) - 1:
                self.ends[k] = self.ends[closing + 1]
            nearest[sign] = k

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` of a tag whose attributes begin here, or -1; quotes may hold one."""
        k = bisect_left(self.special, at)
        return self.ends[k] if k < len(self.ends) else -1

    def raw(self, at: int) -> _Token | None:
        """The element here if its content is raw, up to its end tag or the page's end."""
        opening = _RAW.match(self.page, at)
        if not opening or opening.end() > self.last_end:
            return None
        content = self.page.find(">", opening.end()) + 1
        ending = _RAW_END[opening[1].lower()].search(self.page, content)
        return _Token(at, ending.end() if ending else len(self.page))

    def token(self, at: int) -> _Token | None:
        """The next stretch of markup from here; a ``<`` that begins none is text."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return _Token(at, end + 3 if end >= 0 else len(page))
            if token := self.raw(at):
                return token
            if page[at + 1 : at + 2] in ("!", "?") and at + 2 <= self.last_end:
                return _Token(at, page.find(">", at + 2) + 1)
            opening = _OPENING.match(page, at)
            if opening and (end := self.tag_end(opening.end())) >= 0:
                return _Token(at, end + 1, opening[2].lower(), bool(opening[1]), page[opening.end() : end])
            at += 1
        return None


def _hidden_token(markup: _Markup, at: int, raw: bool) -> _Token | None:
    """The next comment, element with raw content if these count, or tag of a hidden element."""
    page = markup.page
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            return markup.token(at)
        if raw and (token := markup.raw(at)):
            return token
        opening = _HIDDEN_OPENING.match(page, at)
        if opening and (end := markup.tag_end(opening.end())) >= 0:
            return _Token(at, end + 1, opening[2].lower(), bool(opening[1]), page[opening.end() : end])
        at += 1
    return None


def name_parts(attributes: str) -> frozenset[str]:
    found = set()
    for match in _NAMES.finditer(attributes):
        value = match[1] or match[2] or match[3] or ""
        found.update(_PART.findall(_CAMEL.sub(" ", value).lower()))
    return frozenset(found)


def hidden_ends(markup: _Markup) -> dict[int, int]:
    """Where the elements without text of the page end, by where they begin; those that are empty or never end are left
    out."""
    ends: dict[int, int] = {}
    begun: dict[str, list[int]] = {tag: [] for tag in HIDDEN}
    token = _hidden_token(markup, 0, True)
    while token:
        if token.tag:
            places = begun[token.tag]
            if not token.closing:
                if not _EMPTY.search(token.names):
                    places.append(token.start)
            elif places:
                ends[places.pop()] = token.end
        # Inside these, script and title are tags as any other, which can be empty, or text.
        token = _hidden_token(markup, token.end, not (begun["svg"] or begun["iframe"]))
    return ends


def leaf_blocks(page: str | None) -> list[Block]:
    """Blocks with a text, in page order. White space is single, character references are decoded; scripts, styles,
    comments and hidden elements that end are no text. A NULL or empty page has none; tags that are not closed end with
    what is around them. Takes time in proportion to the page, however broken it is."""
    page = page or ""
    markup = _Markup(page)
    ends = hidden_ends(markup)
    blocks: list[Block] = []
    stack = _Open()
    pieces: list[str] = []
    linked = 0
    in_link = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            blocks.append(Block(text, stack.top, min(1.0, linked / len(text))))
        pieces.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text.strip():
            stack.close(("head",))
        pieces.append(text)
        if in_link:
            linked += len(text.strip())

    last = 0
    while token := markup.token(last):
        if token.start > last:
            add(page[last : token.start])
        last = token.end
        tag = token.tag
        if not tag:
            continue
        if tag in HIDDEN and not token.closing:
            last = ends.get(token.start, last)
            if token.start not in ends and not _EMPTY.search(token.names):
                flush()
            continue
        if tag not in IN_HEAD and not token.closing:
            stack.close(("head",))
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            elif tag == "a":
                in_link = 0 if token.closing else 1
            continue
        flush()
        in_link = 0
        if token.closing:
            stack.close((tag,))
            continue
        if tag in ENDS_ITSELF:
            stack.close(ENDS_ITSELF[tag], KEEPS_OPEN[tag])
        elif stack.top.tag == "p":
            stack.pop()
        if tag not in VOID and not token.names.endswith("/"):
            stack.push(tag, name_parts(token.names))
    add(page[last:])
    flush()
    return blocks
