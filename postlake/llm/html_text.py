"""Visible text of HTML pages, laid out as a browser would.

A tree builder applies the implied-tag rules (paragraphs, list items, table parts and definition entries close each other),
visibility rules drop what a browser does not show, and the renderer keeps block spacing, list markers with their nesting,
preformatted text and aligned table cells. Tokens are found with string searches that never look at a byte twice, so time
grows in line with the page.

Defined results: a null page is empty text; markup cut off at the end of a page is dropped, its text before that kept;
repeated rows repeat; an empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import encoded

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content that is text to the parser up to its own closing tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(
    "head script style title template noscript iframe noembed noframes object audio video canvas svg math datalist area base "
    "link meta param source track".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split()
)
#: Blocks set off by an empty line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset hr menu dir".split())
TABLE_PARTS = frozenset("table caption colgroup thead tbody tfoot tr td th".split())
#: A start tag closes these open elements, up to the listed barriers.
_CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    **{t: (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])) for t in ("thead", "tbody", "tfoot")},
    **{f"h{n}": (frozenset(f"h{k}" for k in range(1, 7)), frozenset("div section article td th li body".split())) for n in range(1, 7)},
}
_P_BARRIER = frozenset("table td th caption button object body html".split())
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>`]+)))?""")
_TAG_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")
#: Columns wider than this are not padded, so one long cell does not blow up its table.
PAD_WIDTH, MAX_SPAN = 60, 100


def _attributes(inside: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(inside):
        out.setdefault(name.lower(), html.unescape(double or single or bare))
    return out


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', text, ''), ('open', tag, attribute source) and ('close', tag, ''), each part of the page once."""
    at, size, quoted = 0, len(page), True
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        mark = page[lt + 1 : lt + 2]
        closing = mark == "/"
        letter = page[lt + 2 : lt + 3] if closing else mark
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
                    quoted = False  # a quote stays open to the end of the page: from here on, quotes are plain characters
            inside = page[lt + (2 if closing else 1) : gt]
            cut = next((k for k, c in enumerate(inside) if c in " \t\n\r\f/"), len(inside))
            tag = inside[:cut].lower()
            yield ("close", tag, "") if closing else ("open", tag, inside[cut:])
            at = gt + 1
            if not closing and tag in RAW:
                end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
                yield "text", page[at : end.start()] if end else page[at:], ""
                at = end.start() if end else size
        elif mark and mark in "!?/":
            if lt > at:
                yield "text", page[at:lt], ""
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2)
                at = size if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
        else:
            yield "text", page[at : lt + 1], ""
            at = lt + 1


class Node:
    __slots__ = ("tag", "children", "attributes", "hidden")

    def __init__(self, tag: str, inside: str = "") -> None:
        self.tag, self.children = tag, []
        self.attributes = _attributes(inside) if inside.strip(" /\n\t") else {}
        a = self.attributes
        self.hidden = tag in HIDDEN or (
            bool(a) and ("hidden" in a or bool(_UNSEEN.search(a.get("style", ""))) or (tag == "input"))
        ) or tag == "input" or (tag == "dialog" and "open" not in a)


def build(page: str) -> Node:
    """The tree of a page. Open elements form a stack; a tag closes what its rule implies before it opens or closes."""
    root = Node("html")
    stack, texts = [root], []
    open_count: dict[str, int] = {"html": 1}

    def flush() -> None:
        if texts:
            stack[-1].children.append("".join(texts))
            texts.clear()

    def close_to(depth: int) -> None:
        flush()
        while len(stack) > depth:
            open_count[stack.pop().tag] -= 1

    def close_implied(names: frozenset, barriers: frozenset) -> None:
        lowest = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in barriers:
                break
            if stack[k].tag in names:
                lowest = k
        if lowest is not None:
            close_to(lowest)

    for kind, value, inside in tokens(page):
        if kind == "text":
            texts.append(value)
            continue
        if kind == "close":
            if value == "br":
                flush()
                stack[-1].children.append(Node("br"))
            elif value == "p" and not open_count.get("p"):
                flush()
                stack[-1].children.append(Node("p"))
            elif value not in ("html", "body") and open_count.get(value):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == value:
                        close_to(k)
                        break
                    if stack[k].tag in ("td", "th", "table") and value not in TABLE_PARTS:
                        break
            continue
        if value in ("html", "body") and (value == "html" or open_count.get("body")):
            continue
        flush()
        if value in BLOCK and open_count.get("p") and value not in ("body", "option", "optgroup"):
            close_implied(frozenset(["p"]), _P_BARRIER)
        rule = _CLOSES.get(value)
        if rule and any(open_count.get(n) for n in rule[0]):
            close_implied(*rule)
        if value == "body" and open_count.get("head"):
            close_implied(frozenset(["head"]), frozenset())
        node = Node(value, inside)
        stack[-1].children.append(node)
        if value not in VOID:
            stack.append(node)
            open_count[value] = open_count.get(value, 0) + 1
    flush()
    return root


class _Out:
    """Lines with pending breaks: breaks are written only once something visible follows."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.breaks, self.space, self.at_start = 0, False, True
        self.prefix, self.prefix_indent = "", ""

    def block(self, lines: int) -> None:
        self.space = False
        self.breaks = max(self.breaks, lines)

    def line(self) -> None:
        """A forced line break, counted on top of those already waiting."""
        self.space = False
        if self.parts:
            self.breaks += 1

    def _start(self, indent: str) -> None:
        if self.breaks and self.parts:
            self.parts.append("\n" * self.breaks)
            self.at_start = True
        self.breaks = 0
        if self.at_start:
            self.parts.append(self.prefix_indent + self.prefix if self.prefix else indent)
            self.prefix = ""
            self.at_start = self.space = False

    def text(self, value: str, indent: str) -> None:
        value = _SPACE.sub(" ", value)
        body = value.strip(" ")
        if not body:
            self.space = self.space or bool(value)
            return
        led = value[0] == " " or self.space
        fresh = not self.parts or self.breaks or self.at_start
        self._start(indent)
        if led and not fresh:
            self.parts.append(" ")
        self.parts.append(body)
        self.space = value[-1] == " "

    def verbatim(self, value: str, indent: str) -> None:
        if value:
            fresh = not self.parts or self.breaks or self.at_start
            if self.space and not fresh:
                self.parts.append(" ")
            self._start(indent)
            self.parts.append(value.replace("\n", "\n" + indent) if indent else value)
            self.space = False

    def done(self) -> str:
        return "".join(self.parts)


def _unescape(text: str) -> str:
    return html.unescape(text) if "&" in text else text


def _rows(table: Node) -> list[list[Node]] | None:
    """The visible cells by row, or None when a cell holds blocks of its own (a layout table)."""
    rows, todo = [], table.children[::-1]
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            if c.strip():
                return None
        elif c.hidden:
            continue
        elif c.tag == "tr":
            cells = [x for x in c.children if not isinstance(x, str) and not x.hidden]
            if any(x.tag not in ("td", "th") for x in cells) or any(isinstance(x, str) and x.strip() for x in c.children):
                return None
            rows.append(cells)
        elif c.tag in ("thead", "tbody", "tfoot", "colgroup"):
            todo += reversed(c.children)
        elif c.tag not in ("caption", "col"):
            return None
    for cells in rows:
        for cell in cells:
            inner = list(cell.children)
            while inner:
                x = inner.pop()
                if not isinstance(x, str) and not x.hidden:
                    if x.tag in BLOCK and x.tag != "p" or x.tag == "table":
                        return None
                    inner += x.children
    return rows


def _aligned(rows: list[list[Node]]) -> list[str]:
    grid = []
    for cells in rows:
        line = []
        for cell in cells:
            line.append(_SPACE.sub(" ", render(cell)).strip())
            span = cell.attributes.get("colspan", "")
            if span.isascii() and span.isdigit():
                line += [""] * (min(int(span), MAX_SPAN) - 1)
        if any(line):
            grid.append(line)
    width: dict[int, int] = {}
    for line in grid:
        for k, cell in enumerate(line):
            if len(cell) <= PAD_WIDTH:
                width[k] = max(width.get(k, 0), len(cell))
    return [" | ".join(c.ljust(width.get(k, 0)) for k, c in enumerate(line)).rstrip() for line in grid]


def render(root: Node) -> str:
    """The text below a node. A caption is one line: it is written to an ``_Out`` of its own, however deep captions nest in it."""
    out, outer = _Out(), None
    # (node or text, indent, preformatted, list state) to enter; a tag to leave; a caption's end; the lines of a table
    todo: list[tuple] = [("enter", c, "", False, None) for c in reversed(root.children)]
    while todo:
        what, node, indent, pre, items = todo.pop()
        if what == "leave":
            out.block(2 if node in SPACED else 1)
            continue
        if what == "caption":
            if node == "begin":
                outer, out = out, _Out()
            else:
                outer.text(out.done(), indent)
                outer, out = None, outer
                out.block(1)
            continue
        if what == "lines":
            for line in node:
                out.block(1)
                out.verbatim(line, indent)
            continue
        if isinstance(node, str):
            value = _unescape(node)
            (out.verbatim if pre else out.text)(value, indent)
            continue
        if node.hidden:
            continue
        tag = node.tag
        if tag == "br":
            out.line()
            continue
        if tag in ("tr", "caption", "td", "th"):  # of a layout table, or outside any
            out.block(1)
            todo.append(("leave", "div", "", False, None))
        elif tag in BLOCK:
            out.block(2 if tag in SPACED and not (items is not None and tag in ("ul", "ol")) else 1)
            todo.append(("leave", "div" if items is not None and tag in ("ul", "ol") else tag, "", False, None))
        if tag == "table":
            rows = _rows(node)
            if rows is not None:
                todo.append(("lines", _aligned(rows), indent, False, None))
                captions = [c for c in node.children if not isinstance(c, str) and c.tag == "caption" and not c.hidden]
                for c in reversed(captions):
                    inside = [("enter", x, "", False, None) for x in reversed(c.children)]
                    if outer is None:
                        todo += [("caption", "end", indent, False, None), *inside, ("caption", "begin", "", False, None)]
                    else:  # all of the outer caption becomes one line
                        todo += [("leave", "div", "", False, None), *inside]
                continue
        inner = indent
        if tag in ("ul", "ol", "menu", "dir"):
            start = node.attributes.get("start", "1")
            items = [tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1]
        elif tag == "li":
            if items and items[0]:
                marker = f"{items[1]}. "
                items[1] += 1
            else:
                marker = "- "
            out.block(1)
            out.prefix, out.prefix_indent = marker, indent  # for the first line; later lines are set in
            inner = indent + "  "
        elif tag in ("dd", "blockquote"):
            inner = indent + "  "
        child_pre = pre or tag in ("pre", "textarea", "xmp")
        kids = node.children
        if tag == "pre" and kids and isinstance(kids[0], str):
            kids = [kids[0].removeprefix("\n"), *kids[1:]]
        todo.extend(("enter", c, inner, child_pre, items) for c in reversed(kids))
    return out.done()


def visible_text(page: str) -> str:
    """The text a reader sees, without trailing blanks on any line."""
    text = render(build(page.replace("\r\n", "\n").replace("\r", "\n")))
    return "\n".join(line.rstrip(" ") for line in text.split("\n")).strip("\n")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_lines) for each row of pages(page_id, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(page.decode()) for page in encoded(batch.column("html"))]
            lines = [t.count("\n") + 1 if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array(texts, pa.string()), pa.array(lines, pa.int32())], ["page_id", "text", "n_lines"]
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, text string, n_lines int")
