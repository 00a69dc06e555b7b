"""HTML extraction: a tree builder with implied tags and a layout-aware text renderer.

The builder tokenises the page once, closes what the start of another element implies
(paragraphs before blocks, list items, table parts, options), supplies missing table rows,
ends the head at the first body content and ignores stray end tags.  The renderer walks the
tree without recursion and emits all visible text:

* hidden are scripts, styles, templates, the head with its title, elements with ``hidden`` or
  an inline ``display: none``, what inherits an inline ``visibility: hidden`` (a child may be visible
  again; style sheets are not read), data lists, what only stands in for
  frames and media that cannot be shown, and the descriptions and definitions within svg and
  math; formulas, the text of drawings, maps and objects, and the options of a select are inline;
* blocks start on lines of their own; paragraphs, headings, lists, tables, quotes and
  preformatted text are set off by one empty line (adjacent margins collapse);
* list items get ``- `` or their number and hang under it, nested lists are indented, by
  ``INDENT`` columns at most;
* table cells are padded to the width of their column, two spaces apart; a cell may have
  several lines; ``colspan`` and ``rowspan`` are honoured; beyond column ``LINE`` cells are only
  two spaces apart;
* white space collapses outside ``pre``; ``br`` breaks the line; images give their ``alt``.

Edge cases: null and empty pages give the empty text; broken or endless markup is read to the
end; the text grows in proportion to the page, however deep its lists are; numbers are clamped
to what browsers take; repeated rows are rendered once each; a null ``page_id`` is kept; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterable, Iterator
from html import unescape
from itertools import accumulate, zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# fixed values: element kinds of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes audio video canvas datalist".split())
#: Hidden within svg or math only.
FOREIGN = frozenset("svg math".split())
FOREIGN_HIDDEN = frozenset("desc metadata defs symbol clippath mask pattern marker annotation annotation-xml".split())
#: Inline, but apart from what stands before and after.
APART = frozenset("option optgroup select text mtr mlabeledtr mtd svg math".split())
#: Inputs whose value is not shown as text.
UNSHOWN_INPUT = frozenset("hidden password checkbox radio file image range color".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu pre xmp blockquote table figure fieldset hr".split())
BLOCK = SPACED | frozenset("html body address article aside details dialog dd div dt figcaption footer form header hgroup legend li main nav section summary caption center textarea tr td th thead tbody tfoot".split())
ENDS_P = BLOCK - frozenset("html body td th tr thead tbody tfoot caption textarea legend".split())
TABLE_PARTS = frozenset("td th tr thead tbody tfoot caption".split())
#: What a start tag closes if it is open, up to the nearest of the elements that bound the search.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
}
#: A cell wider than this does not widen its column, so that padding stays in proportion.
COLUMN_WIDTH = 80
#: Deeper indents and wider padding are cut off, so that the text stays in proportion to the page.
INDENT, LINE = 64, 1000

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?/](?![a-zA-Z])[^>]*(?:>|\Z)|<![^>]*(?:>|\Z)"""
    r"""|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"""
    r"""|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<(?P<odd>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_INTEGER = re.compile(r"\s*([+-]?)0*(\d{1,10})(\d*)")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(source: str) -> dict[str, str]:
    if not source.strip(" \t\n\r\f/"):
        return {}
    found: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(source):
        found.setdefault(name.lower(), unescape(a or b or c))
    return found


def build(html: str) -> Node:
    """The tree of a page below one root."""
    root = Node("#root", {})
    open_: list[Node] = [root]
    places: dict[str, list[int]] = {}  # where each element is open, outermost first
    at, n = 0, len(html)

    def push(tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        open_[-1].children.append(node)
        places.setdefault(tag, []).append(len(open_))
        open_.append(node)
        return node

    def pop_to(index: int) -> None:
        while len(open_) > index:
            places[open_.pop().tag].pop()

    def innermost(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags: set[str], bounds: set[str]) -> None:
        """Close up to the outermost of ``tags`` that is open within ``bounds``."""
        some = [places[t] for t in tags if places.get(t)]
        if some:
            bound = innermost(bounds)
            if found := min((p[bisect_right(p, bound)] for p in some if p[-1] > bound), default=0):
                pop_to(found)

    def text(s: str) -> None:
        if not s:
            return
        if places.get("head") and not s.isspace():
            close({"head"}, set())
        open_[-1].children.append(unescape(s) if "&" in s else s)

    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            open_[-1].children.append(m["cdata"])
        elif end := m["end"]:
            end = end.lower()
            if end == "br":
                open_[-1].children.append(Node("br", {}))
            elif places.get(end):
                bounds = ("table",) if end in TABLE_PARTS else () if end in ("table", "html", "body") else ("td", "th", "caption")
                if innermost(bounds) < places[end][-1]:
                    pop_to(places[end][-1])
        elif tag := m["start"] or m["odd"]:
            tag, attrs = tag.lower(), _attributes(m["attrs"] or m["rest"] or "")
            foreign = any(places.get(t) for t in FOREIGN)
            if foreign and tag in FOREIGN_HIDDEN:
                attrs["hidden"] = ""
            if places.get("head") and tag not in HEAD_ONLY and tag != "head":
                close({"head"}, set())
            if tag in ("html", "head", "body") and (places.get(tag) or tag == "head" and places.get("body")):
                continue
            if tag in ENDS_P and places.get("p"):
                close({"p"}, {"td", "th", "caption", "button", "table"} if tag != "table" else {"td", "th", "caption", "button"})
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            if tag in ("td", "th") and open_[-1].tag in ("table", "thead", "tbody", "tfoot"):
                push("tr", {})
            if tag in VOID or ((foreign or tag in FOREIGN) and (m["attrs"] or "").endswith("/")):
                open_[-1].children.append(Node(tag, attrs))
                continue
            node = push(tag, attrs)
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
                body = html[at : stop.start() if stop else n]
                node.children.append(unescape(body) if tag in ("textarea", "title") else body)
                at = stop.end() if stop else n
                pop_to(len(open_) - 1)
    return root


def displayed(node: Node) -> bool:
    """Whether an element and what it holds takes part at all."""
    if node.tag in HIDDEN:
        return False
    a = node.attrs
    return not a or not ("hidden" in a or (node.tag == "dialog" and "open" not in a) or ("style" in a and _NO_DISPLAY.search(a["style"])))


def visible(node: Node, inherited: bool) -> bool:
    """Whether an element's own text shows."""
    m = _VISIBILITY.search(node.attrs["style"]) if "style" in node.attrs else None
    return inherited if m is None else m[1].lower() == "visible"


class _Lines:
    """Lines, and lines of inner tables by reference with the columns that they are moved by.

    So a line is not copied at each table that it lies in.  How many lines there are of each length that counts for
    a column's width is kept along; what is taken from the front is gone.
    """

    def __init__(self) -> None:
        self.items: deque[str | tuple[int, _Lines]] = deque()
        self.count = 0
        self.lengths: dict[int, int] = {}

    def append(self, line: str) -> None:
        self.items.append(line)
        self.count += 1
        if len(line) <= COLUMN_WIDTH:
            self.lengths[len(line)] = self.lengths.get(len(line), 0) + 1

    def extend(self, moved: int, other: _Lines) -> None:
        if other.count:
            self.items.append((moved, other))
            self.count += other.count
            for length, n in other.lengths.items():
                length += moved if length else 0  # an empty line stays empty
                if length <= COLUMN_WIDTH:
                    self.lengths[length] = self.lengths.get(length, 0) + n

    def take(self, most: int) -> list[str]:
        """The first lines, ``most`` at most, taken away.  Lines that have been passed on may not be used on their own."""
        out: list[str] = []
        stack: list[tuple[int, _Lines]] = [(0, self)]
        while stack:
            moved, own = stack[-1]
            if len(out) == most:
                break
            if not own.items:
                stack.pop()
                if stack:
                    stack[-1][1].items.popleft()
            elif isinstance(item := own.items[0], str):
                own.items.popleft()
                out.append(" " * min(moved, LINE) + item if item else item)
                if item and len(item) + moved <= COLUMN_WIDTH or not item:
                    self.lengths[len(item) + moved if item else 0] -= 1
            else:
                stack.append((moved + item[0], item[1]))
        self.count -= len(out)
        return out


class _Flow:
    """Lines that grow; margins collapse, indents and list marks go before each line."""

    def __init__(self) -> None:
        self.lines = _Lines()
        self.buffer: list[str] = []
        self.gap = 0
        self.indent = 0
        self.mark = ""

    def write(self, s: str, pre: bool) -> None:
        if pre:
            first, *more = s.split("\n")
            self.buffer.append(first)
            for line in more:
                self.end_line(True)
                self.buffer.append(line)
            return
        s = _SPACE.sub(" ", s)
        if s.startswith(" ") and (not self.buffer or self.buffer[-1].endswith(" ")):
            s = s[1:]
        if s:
            self.buffer.append(s)

    def end_line(self, keep_empty: bool = False) -> None:
        line = "".join(self.buffer).rstrip()
        self.buffer.clear()
        if line or keep_empty or self.mark:
            self.put(line)

    def put(self, line: str) -> None:
        for _ in range(self.gap if self.lines.count else 0):
            self.lines.append("")
        self.gap = 0
        self.lines.append((" " * min(self.indent - len(self.mark), INDENT) + self.mark + line).rstrip())
        self.mark = ""

    def put_all(self, lines: _Lines) -> None:
        for first in lines.take(1):
            self.put(first)
        self.lines.extend(min(self.indent, INDENT), lines)

    def block(self, margin: int) -> None:
        if self.buffer:
            self.end_line()
        if not self.mark:  # nothing comes between a list mark and its first line
            self.gap = max(self.gap, margin)


def _placed(rows: list[list[tuple[int, int, _Lines]]]) -> list[list[tuple[int, int, _Lines]]]:
    """Cells as ``(column, columns, lines)``; a cell that spans rows keeps its columns in those below."""
    out, held = [], {}  # column -> the last row that a cell above takes it in
    for r, row in enumerate(rows):
        placed, at = [], 0
        for columns, down, lines in row:
            while held.get(at, -1) >= r:
                at += 1
            placed.append((at, columns, lines))
            if down > 1:
                held |= dict.fromkeys(range(at, min(at + columns, LINE)), r + down - 1)
            at += columns
        out.append(placed)
    return out


def _table_lines(rows: list[list[tuple[int, int, _Lines]]]) -> _Lines:
    placed = _placed(rows)
    widths: dict[int, int] = {}
    for row in placed:
        for at, columns, lines in row:
            if columns == 1:
                widths[at] = max([widths.get(at, 0), *(length for length, n in lines.lengths.items() if n)])
    known = sorted(widths)
    before = list(accumulate((widths[c] for c in known), initial=0))
    start = lambda at: min(2 * at + before[bisect_left(known, at)], LINE)
    out = _Lines()
    for row in placed:
        cells = [(at, lines) for at, _, lines in row if lines.count]
        *_, second, _ = sorted([0, 0, *(lines.count for _, lines in cells)])
        for together in zip_longest(*(lines.take(second) for _, lines in cells)):
            line, length = [], 0
            for (at, _), part in zip(cells, together):
                if part:
                    pad = max(start(at) - length, 2 if line else 0)
                    line.append(" " * pad + part)
                    length += pad + len(part)
            out.append("".join(line).rstrip())
        for at, lines in cells:  # what the highest cell has beyond the others
            out.extend(start(at), lines)
    return out


def _number(value: str | None, default: int, least: int = -(2**31), most: int = 2**31 - 1) -> int:
    """The integer that an attribute begins with, within the given limits."""
    m = _INTEGER.match(value or "")
    if not m:
        return default
    size = most + 1 if m[3] else int(m[2])
    return max(least, min(most, -size if m[1] == "-" else size))


def render(root: Node) -> str:
    """All visible text of a tree."""
    flows, tables, lists, pre = [_Flow()], [], [], 0
    # (node, next child, whether its text shows); an element is entered at child 0 and left after the last
    stack: list[list] = [[root, 0, True]]
    while stack:
        frame = stack[-1]
        node, i, shown = frame[:3]
        tag, flow = node.tag, flows[-1]
        if i == 0:
            if tag in BLOCK:
                nested = tag in ("ul", "ol", "menu") and bool(lists)
                flow.block(1 if tag in SPACED and not nested else 0)
            if tag in APART:
                flow.write(" ", False)
                if shown and (tag == "optgroup" or (tag == "option" and not node.children)):
                    flow.write(node.attrs.get("label", ""), False)
            if tag in ("pre", "xmp", "textarea"):
                pre += 1
            elif tag in ("ul", "ol", "menu"):
                lists.append([tag, _number(node.attrs.get("start"), 1)])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                if kind[0] == "ol":
                    kind[1] = _number(node.attrs.get("value"), kind[1])
                mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                flow.end_line()
                frame.append(len(mark))
                flow.indent += len(mark)
                flow.mark = mark if shown else ""
            elif tag in ("blockquote", "dd"):
                flow.indent += 2
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                flows.append(_Flow())
        if i < len(node.children):
            frame[1] += 1
            child = node.children[i]
            if isinstance(child, str):
                if shown and (tag not in ("table", "thead", "tbody", "tfoot", "tr") or not child.isspace()):
                    flow = flows[-1]
                    flow.write(child[1:] if pre and i == 0 and child.startswith("\n") else child, pre > 0)
            elif child.tag == "br":
                flows[-1].end_line(True)
            elif child.tag == "hr":
                if displayed(child) and visible(child, shown):
                    flows[-1].block(1)
                    flows[-1].put("---")
                    flows[-1].gap = 1
            elif child.tag == "img":
                if displayed(child) and visible(child, shown) and child.attrs.get("alt"):
                    flows[-1].write(child.attrs["alt"], False)
            elif child.tag == "input":
                if displayed(child) and visible(child, shown) and child.attrs.get("type", "").lower() not in UNSHOWN_INPUT and child.attrs.get("value"):
                    flows[-1].write(child.attrs["value"], False)
            elif child.tag not in VOID and displayed(child):
                stack.append([child, 0, visible(child, shown)])
            if i + 1 < len(node.children) or stack[-1] is not frame:
                continue
            if frame[1] < len(node.children):
                continue
        if stack[-1] is not frame:
            continue
        stack.pop()
        flow = flows[-1]
        if tag in ("td", "th") and tables:
            flow.end_line()
            flows.pop()
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((_number(node.attrs.get("colspan"), 1, 1, 1000), _number(node.attrs.get("rowspan"), 1, 1, 65534), flow.lines))
            continue
        if tag in APART:
            flow.write(" ", False)
        if tag in BLOCK:
            flow.block(0)
        if tag in ("pre", "xmp", "textarea"):
            pre -= 1
        elif tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag == "li":
            if flow.mark:
                flow.put("")
            flow.indent -= frame[3]
        elif tag in ("blockquote", "dd"):
            flow.indent -= 2
        elif tag == "table":
            flow.put_all(_table_lines(tables.pop()))
        if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists):
            flow.gap = max(flow.gap, 1)
    flows[0].end_line()
    return "\n".join(flows[0].lines.take(flows[0].lines.count)).strip("\n")


def extract_text(html: str | None) -> str:
    return render(build(html)) if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(page_id, text)``, a row per row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array([extract_text(x) for x in b.column("html").to_pylist()], pa.string())], ["page_id", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, text string")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
