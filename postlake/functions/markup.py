"""A page as numbered elements: nested tags, any quoting, decoded entities.

One pass finds the tags with string searches and numbers the elements in document order; an element holds the numbers up to its
``last``. The text of a page stands once, and an element has its place in it. Both grow in line with the page. What to look for
on a page is not known here: rules are joined with the element table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Their content is text up to their own closing tag; that of the unseen ones never counts as text.
RAW = frozenset("script style title textarea".split())
UNSEEN = frozenset("script style noscript template".split())
#: A new element of these ends an open one of the same kind when nothing else was opened since.
SIBLINGS = frozenset("p li option tr td th dt dd".split())
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>`]+)))?""")
_TAG_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_BLANKS = re.compile(r"[\s ﻿]+")


class Element:
    __slots__ = ("tag", "source", "begin", "end", "number", "last")

    def __init__(self, tag: str, source: str, begin: int, number: int) -> None:
        self.tag, self.source, self.begin, self.end, self.number, self.last = tag, source, begin, begin, number, number

    def attributes(self) -> dict[str, str]:
        found: dict[str, str] = {}
        for name, double, single, bare in _ATTRIBUTE.findall(self.source):
            found.setdefault(name.lower(), html.unescape(double or single or bare))
        return found


def elements_of(source: str) -> tuple[list[Element], str]:
    """The elements of a page in document order and its text.

    Tags part words, blanks of a piece are collapsed, entities are decoded once. ``begin`` and ``end`` of an element are its
    place in the text; ``last`` is the number of its last descendant.
    """
    elements: list[Element] = []
    texts: list[str] = []
    stack: list[Element] = []
    open_: dict[str, int] = {}
    unseen = size = 0

    def close(depth: int) -> None:
        nonlocal unseen
        while len(stack) > depth:
            e = stack.pop()
            e.end, e.last = size, len(elements) - 1
            open_[e.tag] -= 1
            unseen -= e.tag in UNSEEN

    for kind, value, inside in _tags(source):
        if kind == "text":
            if not unseen and (piece := _BLANKS.sub(" ", html.unescape(value)).strip(" ")):
                texts.append(piece)
                size += len(piece) + 1
        elif kind == "open":
            if value in SIBLINGS and stack and stack[-1].tag == value:
                close(len(stack) - 1)
            e = Element(value, inside, size, len(elements))
            elements.append(e)
            if value not in VOID:
                stack.append(e)
                open_[value] = open_.get(value, 0) + 1
                unseen += value in UNSEEN
        elif open_.get(value):
            depth = len(stack) - 1
            while stack[depth].tag != value:
                depth -= 1
            close(depth)
    close(0)
    return elements, " ".join(texts)


def _tags(page: str) -> Iterator[tuple[str, str, str]]:
    at, size, quoted = 0, len(page), True
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        mark = page[lt + 1 : lt + 2]
        letter = page[lt + 2 : lt + 3] if mark == "/" else mark
        if letter.isascii() and letter.isalpha():
            if lt > at:
                yield "text", page[at:lt], ""
            gt = page.find(">", lt)
            if gt < 0:
                return
            if quoted and ('"' in (inside := page[lt:gt]) or "'" in inside):
                whole = _TAG_END.match(page, lt)
                if whole:
                    gt = whole.end() - 1
                else:
                    quoted = False  # a quote stays open to the end of the page
            inside = page[lt + (2 if mark == "/" else 1) : gt]
            name = re.match(r"[^\s/]+", inside)[0]
            tag = name.lower()
            at = gt + 1
            if mark == "/":
                yield "close", tag, ""
                continue
            yield "open", tag, inside[len(name) :]
            if tag in RAW:
                end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
                yield "text", page[at : end.start()] if end else page[at:], ""
                at = end.start() if end else size
        elif mark and mark in "!?/":
            if lt > at:
                yield "text", page[at:lt], ""
            end = page.find("-->", lt + 2) if page.startswith("<!--", lt) else page.find(">", lt)
            at = size if end < 0 else end + (3 if page.startswith("<!--", lt) else 1)
        else:
            yield "text", page[at : lt + 1], ""
            at = lt + 1
