"""Leaf blocks of an HTML page: the text between two block-level tags, with its ancestors.

One pattern cuts the page into tags and text, so reading is linear in the page, also for pages of unclosed
comments, quotes or tags. A stack of open elements follows the rules for implied ends (a block closes an open
``p``, an item closes an item, a cell a cell); an end tag without its start is ignored. Text of elements that
a browser does not lay out (scripts, styles, titles, templates, form values) is no block. Inline tags and
``br`` are white space or nothing inside a block.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape
from typing import NamedTuple

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style title template noscript textarea select iframe noembed noframes xmp svg math object".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p "
    "pre section select summary table tbody td tfoot th thead tr ul textarea title script style template".split())
KEEPS_P = frozenset("button label legend option optgroup td th tr tbody thead tfoot caption head html body script style "
                    "template title textarea select".split())
IMPLIED = {  # a start tag ends open elements of these names, up to the given container
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("tbody", "thead", "tfoot", "table")), "option": (("option",), ("select",)),
    "tbody": (("tbody", "thead"), ("table",)), "tfoot": (("tbody", "thead"), ("table",)),
}

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>\"']*+)((?:[^'\">]++|\"[^\"]*\"|'[^']*')*+)(?:[>\"']|\Z)", re.S)
NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
MARKED = re.compile(r"(?<![\w-])data-(main|other)(?![\w-])", re.I)  # labels of training pages
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


DEPTH = 200  # of more open elements than this the further ones add no names or class words


class Block(NamedTuple):
    """Text with single spaces, letters inside links, and where it stands."""

    text: str
    linked: int
    tag: str  # innermost block element
    inside: frozenset[str]  # names of all block ancestors
    words: frozenset[str]  # parts of class, id and role names of all ancestors
    holder: int  # number of the element around the innermost block element
    marked: bool  # label: data-main on the element or above it, nearer than data-other


class _Open(NamedTuple):
    name: str
    words: frozenset[str]
    inside: frozenset[str]
    number: int
    block: int  # depth of the innermost block element
    marked: bool


_ROOT = _Open("body", frozenset(), frozenset({"body"}), 0, 0, False)  # text outside all tags is body text


def class_words(attributes: str) -> frozenset[str]:
    """Lower-case parts of class, id and role names; ``hidden`` for elements that are not shown."""
    found: set[str] = set()
    for match in NAMED.finditer(attributes):
        found.update(p.lower() for p in PARTS.findall(match.group(1) or match.group(2) or match.group(3) or ""))
    if ("idden" in attributes or "none" in attributes) and HIDDEN.search(attributes):
        found.add("hidden")
    return frozenset(found)


class Reader:
    """Open elements of one page and the block that is being read."""

    def __init__(self) -> None:
        self.stack = [_ROOT]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.text: list[str] = []
        self.linked = self.unseen = self.links = self.numbers = 0
        self.found: list[Block] = []
        self.where: tuple[_Open, _Open, _Open] = (_ROOT, _ROOT, _ROOT)

    def add(self, raw: str) -> None:
        if self.unseen:
            return
        if not self.text:
            if raw.isspace():
                return
            top = self.stack[-1]
            self.where = (top, self.stack[top.block], self.stack[max(top.block - 1, 0)])
        value = unescape(raw) if "&" in raw else raw
        self.text.append(value)
        if self.links:
            self.linked += len(value.strip())

    def end_block(self) -> None:
        if self.text:
            whole = " ".join("".join(self.text).split())
            if whole:
                top, block, holder = self.where
                self.found.append(Block(whole, min(self.linked, len(whole)), block.name, top.inside, top.words,
                                        holder.number, top.marked))
            self.text, self.linked = [], 0

    def open(self, name: str, attributes: str) -> None:
        above, depth = self.stack[-1], len(self.stack)
        words, inside, block, marked = above.words, above.inside, above.block, above.marked
        if name in BLOCK:
            block = depth
        if depth <= DEPTH:
            if name in BLOCK and name not in inside:
                inside = inside | {name}
            own = class_words(attributes) if "=" in attributes or "idden" in attributes else words
            words = words if own <= words else words | own
            label = MARKED.search(attributes) if "ata-" in attributes else None
            marked = label.group(1).lower() == "main" if label else marked
        self.numbers += 1
        self.stack.append(_Open(name, words, inside, self.numbers, block, marked))
        self.places[name].append(depth)
        self.unseen += name in UNSEEN
        self.links += name == "a"

    def close(self, depth: int) -> None:
        """Close the open elements from ``depth`` on."""
        while len(self.stack) > depth:
            name = self.stack.pop().name
            self.places[name].pop()
            self.unseen -= name in UNSEEN
            self.links -= name == "a"

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self.end_block()
            if self.places["p"] and name not in KEEPS_P:
                self.close(self.places["p"][-1])
        elif name == "br" and self.text:
            self.text.append(" ")
        if name in IMPLIED:
            ends, limits = IMPLIED[name]
            last = max((self.places[e][-1] for e in ends if self.places[e]), default=0)
            if last > max((self.places[e][-1] for e in limits if self.places[e]), default=0):
                self.close(last)
        if name not in VOID and not attributes.endswith("/"):
            self.open(name, attributes)

    def end(self, name: str) -> None:
        if name in BLOCK:
            self.end_block()
        if self.places[name]:
            last = self.places[name][-1]
            # an inline end does not close the blocks that were opened inside it
            if name in BLOCK or self.stack[-1].block < last:
                self.close(last)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in page order."""
    reader = Reader()
    at, end = 0, len(page)
    while at < end:
        match = TOKEN.search(page, at)
        if match is None:
            reader.add(page[at:])
            break
        if match.start() > at:
            reader.add(page[at: match.start()])
        at = match.end()
        name = match.group(2)
        if name is None:
            continue
        name = name.lower()
        if match.group(1):
            reader.end(name)
            continue
        reader.start(name, match.group(3))
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = stop.start() if stop else end
    reader.end_block()
    return reader.found
