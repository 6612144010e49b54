"""Leaf blocks of an HTML page, read tolerantly in one pass, inside tasks.

A block is the text between two block-level boundaries. Scripts, styles, templates, comments, the head and
the contents of text fields are passed over; all other text is read, also that of hidden elements, formulas,
drawings and fallbacks. Inline markup disappears; character references are decoded; white space
becomes one space. Missing end tags are closed by what follows, stray ones are ignored, a tag or comment
cut off at the end of the page ends it.

An element knows its parent and only the marks that none of its ancestors has, so pages of any depth take
memory in proportion to their length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

# Element names of the HTML standard.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav ol optgroup option p "
    "pre search section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template title textarea head".split())
ONE_LEVEL = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"),
             "th": ("tr", "table"), "option": ("select",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACES = re.compile(r"\s+")


@dataclass
class Element:
    tag: str
    names: tuple[str, ...]
    parent: Element | None
    fresh: tuple[str, ...]  # marks of the element that its ancestors lack


@dataclass
class Leaf:
    text: str
    inside: Element | None
    linked: int  # characters inside links

    def path(self) -> Iterator[Element]:
        """The elements around, innermost first."""
        element = self.inside
        while element is not None:
            yield element
            element = element.parent


def _marks(tag: str, names: tuple[str, ...], hidden: bool) -> set[str]:
    marks = {f"in {tag}", *(f"name {n}" for n in names)}
    if hidden:
        marks.add("hidden")
    if tag in ("article", "main"):
        marks.add("inside")
    return marks


def _names(attributes: str) -> tuple[tuple[str, ...], bool]:
    names, hidden = [], False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop"):
            names += [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()) if w]
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
    return tuple(dict.fromkeys(names)), hidden


def leaves(page: str) -> list[Leaf]:
    out: list[Leaf] = []
    stack: list[Element] = []
    marked: Counter[str] = Counter()  # how many open elements bear a mark as a fresh one: one or none
    opened: Counter[str] = Counter()  # open elements by tag
    pieces: list[str] = []
    linked, links = 0, 0

    def close_block() -> None:
        nonlocal linked
        text = SPACES.sub(" ", html.unescape("".join(pieces))).strip()
        pieces.clear()
        if text:
            out.append(Leaf(text, stack[-1] if stack else None, min(linked, len(text))))
        linked = 0

    def push(tag: str, names: tuple[str, ...], hidden: bool) -> None:
        fresh = tuple(sorted(m for m in _marks(tag, names, hidden) if not marked[m]))
        marked.update(fresh)
        opened[tag] += 1
        stack.append(Element(tag, names, stack[-1] if stack else None, fresh))

    def pop() -> None:
        element = stack.pop()
        opened[element.tag] -= 1
        marked.subtract(element.fresh)

    def close_to(tag: str, within: tuple[str, ...] = ()) -> None:
        """Close the nearest open `tag`, unless an element of `within` lies between."""
        if not opened[tag]:
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag == tag:
                while len(stack) > k:
                    pop()
                return
            if stack[k].tag in within:
                return

    at, end = 0, len(page)
    while at < end:
        found = TOKEN.search(page, at)
        if not found:
            pieces.append(page[at:])
            break
        text = page[at : found.start()]
        if text:
            pieces.append(text)
            if links:
                linked += len(text.strip())
        at = found.end()
        closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            if found[0].startswith("<![CDATA["):
                pieces.append(html.escape(found[0][9:-3]))
            continue
        tag = tag.lower()
        if not closing and tag in RAW and not attributes.endswith("/"):
            finish = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            if tag == "head" and not finish:
                finish = re.compile(r"(?=<body\b)", re.I).search(page, at)
            at = finish.end() if finish else (at if tag == "head" else end)
            if tag in BLOCK:
                close_block()
            continue
        if tag == "a":
            links = 0 if closing else 1
        elif tag in VOID:
            if tag == "hr":
                close_block()
            elif tag == "br":
                pieces.append(" ")
        elif tag in BLOCK:
            close_block()
            links = 0
            if closing:
                close_to(tag)
                continue
            if tag in ONE_LEVEL:
                close_to(tag, ONE_LEVEL[tag])
            elif stack and stack[-1].tag in ("p", *HEADINGS):
                pop()
            names, hidden = _names(attributes) if attributes else ((), False)
            if not attributes.endswith("/"):
                push(tag, names, hidden)
    close_block()
    return out
