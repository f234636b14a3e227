"""Per-document HTML helpers, run inside Arrow-batched tasks (never on the driver).

One small tree builder over the standard-library tokenizer, with the tag-soup rules
real pages need: ``p`` closes at a block start, ``li``/``tr``/``td``/``th``/``option``
close their open sibling, void elements never open, stray end tags are ignored,
``script``/``style``/``template`` text is not text, comments are dropped.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "template", "noscript"))
BLOCK = frozenset((
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main nav ol p pre section summary table "
    "tbody td tfoot th thead title tr ul br"
).split())
CLOSES_P = frozenset((
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr main nav ol p pre section table ul"
).split())
_WS = " \t\n\r\f"


class Node:
    """An element with its children; none points back at its parent, so a tree is freed as soon as it is let go."""

    __slots__ = ("tag", "children")

    def __init__(self, tag):
        self.tag = tag
        self.children = []

    def iter(self, tag=None):
        """Descendants (self excluded) in document order."""
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, Node):
                if tag is None or n.tag == tag:
                    yield n
                stack.extend(reversed(n.children))

    def element_children(self):
        return [c for c in self.children if isinstance(c, Node)]

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                parts.append(n)
                continue
            block = n.tag in BLOCK and n is not self
            if block:
                parts.append(" ")
                stack.append(" ")
            stack.extend(reversed(n.children))
        return normalize_ws("".join(parts))


_WS_RUN = re.compile(f"[{_WS}]+")


def normalize_ws(s: str) -> str:
    return _WS_RUN.sub(" ", s).strip(" ")


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]  # the open elements, innermost last
        self.raw_depth = 0

    def _close_to(self, tag, stop=("table",)):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return True
            if self.open[i].tag in stop:
                return False
        return False

    def handle_starttag(self, tag, attrs):
        if self.raw_depth:
            if tag in RAW:
                self.raw_depth += 1
            return
        if tag in CLOSES_P:
            self._close_to("p", stop=("table", "td", "th", "li", "button"))
        if tag == "li":
            self._close_to("li", stop=("ul", "ol", "table"))
        if tag in ("td", "th"):
            self._close_to("td", stop=("tr", "table")) or self._close_to("th", stop=("tr", "table"))
        if tag == "tr":
            self._close_to("td", stop=("tr", "table"))
            self._close_to("th", stop=("tr", "table"))
            self._close_to("tr", stop=("table",))
        if tag in ("dt", "dd"):
            self._close_to("dt", stop=("dl",)) or self._close_to("dd", stop=("dl",))
        if tag == "option":
            self._close_to("option", stop=("select",))
        node = Node(tag)
        self.open[-1].children.append(node)
        if tag in RAW:
            self.raw_depth = 1
            return
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and not self.raw_depth and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        if self.raw_depth:
            if tag in RAW:
                self.raw_depth -= 1
            return
        if tag in VOID:
            return
        stop = ("table",) if tag not in ("table",) else ()
        if tag == "p" and all(n.tag != "p" for n in self.open):
            self.open[-1].children.append(Node("p"))  # a stray </p> is an empty paragraph
            return
        self._close_to(tag, stop=stop)

    def handle_data(self, data):
        if not self.raw_depth:
            self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    if html:
        b.feed(html)
        b.close()
    return b.root


def visible_text(html: str | None) -> str:
    """EXT1: all text outside script/style, whitespace runs collapsed, trimmed."""
    return parse(html).text() if html else ""


def text_blocks(html: str | None, tags=("p", "h1", "h2", "h3", "h4", "h5", "h6")) -> list[str]:
    """PRS4: depth-first texts of block tags that hold non-blank text, not descending
    into a block once taken; NBSP becomes a blank."""
    return blocks_of(parse(html), tags)


def blocks_of(root: Node, tags=("p", "h1", "h2", "h3", "h4", "h5", "h6")) -> list[str]:
    """:func:`text_blocks` on an already parsed document."""
    out = []
    body = next(root.iter("body"), None)
    stack = list(reversed((body if body is not None else root).children))
    while stack:
        c = stack.pop()
        if not isinstance(c, Node):
            continue
        if c.tag in tags:
            t = c.text()
            if t.strip():
                out.append(t.replace("\u00a0", " "))
                continue
        stack.extend(reversed(c.children))
    return out


def tables(html: str | None):
    """EXT2-EXT4: yields ``(table_no, row_no, col_no, header, value)`` for every body
    cell of every table in document order (nested tables included, and their rows
    also counted in the outer table). Row 0 is the header row and is consumed; a
    header is the cell text when the first row holds any ``th`` and the cell has
    text, else ``Row_<i>``; a missing cell gives ``""``; duplicate headers take the
    first column's value."""
    root = parse(html)
    for t_no, table in enumerate(root.iter("table")):
        rows = list(table.iter("tr"))
        if not rows:
            continue
        head_cells = rows[0].element_children()
        has_th = next(rows[0].iter("th"), None) is not None
        headers = []
        for i, cell in enumerate(head_cells):
            t = cell.text() if has_th else ""
            headers.append(t if t.strip() else f"Row_{i}")
        first_index = {}
        for i, h in enumerate(headers):
            first_index.setdefault(h, i)
        for r_no, row in enumerate(rows[1:], start=1):
            cells = row.element_children()
            for h, i in first_index.items():
                val = cells[i].text() if i < len(cells) else ""
                yield t_no, r_no, i, h, val if val.strip() else ""
