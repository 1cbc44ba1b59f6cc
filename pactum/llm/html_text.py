"""HTML extraction by layout-aware rendering.

A tokenizer gives tags and text; the tree builder adds the end tags that HTML implies and leaves out end tags that
match nothing; the renderer walks the tree and emits all visible text. Neither recurses, so depth has no limit.

Not visible: head, scripts, styles, templates, what stands in for media, and the parts of drawings that aren't drawn;
elements with the hidden attribute, display:none or visibility:hidden (a descendant may be visible again); a closed
details but for its summary; a closed dialog; the options of a list box that shows one, but for that one. Of a drawing
(svg) its texts are visible, of a formula (math) all but annotations. Paragraphs and headings are set off by a blank line, other blocks by a line break, br breaks a line, pre keeps its
blanks. List items get '- ' or their number, nested ones are indented, by at most MOST_INDENT blanks. Cells of a table
row stand side by side, columns padded to one width and two blanks apart; a cell that spans rows or columns leaves the
covered places empty, and one wider than WIDEST sets its own line off only. Numbers are held to the standard's bounds.
Time and space grow with the page, however its elements are nested or left open.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes title object audio video canvas datalist annotation annotation-xml desc metadata defs symbol clippath mask pattern marker".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table hr figure fieldset".split())
BLOCK = SPACED | frozenset("html body div section article header footer nav aside main form address li dt dd tr td th thead tbody tfoot caption figcaption details summary center legend dialog menu select option optgroup".split())
ENDS_P = (BLOCK - frozenset("tr td th thead tbody tfoot caption li dt dd html body summary legend select option optgroup".split())) | frozenset(["li", "dt", "dd"])
#: The largest numbers of columns and of rows of a cell, and of a list item.
COLUMNS, DOWN, ITEM = 1000, 65534, 2147483647
MOST_INDENT, WIDEST = 80, 200

_TAG = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_BLANKS = re.compile(r"[ \t\n\r\f]+")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_SEEN = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


_BLOCK_STOPS = BLOCK - {"p"}
#: What the start of an element ends, and what keeps it from ending that.
_IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "td", "th")),
    **dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl", "td", "th"))),
    **dict.fromkeys(("td", "th"), (("td", "th"), ("table", "tr"))),
    "tr": (("tr",), ("table", "thead", "tbody", "tfoot")),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (("thead", "tbody", "tfoot", "caption"), ("table",))),
    "body": (("head",), ()),
    "option": (("option",), ("select", "optgroup", "datalist")),
    "optgroup": (("option", "optgroup"), ("select", "datalist")),
}


class Open:
    """The open elements, innermost last, and the places of each tag among them."""

    def __init__(self, root: Node):
        self.stack, self.places, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in _BLOCK_STOPS:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def last(self, tags) -> int:
        """The place of the innermost open element of these tags; 0: none."""
        return max((at[-1] for tag in tags if (at := self.places.get(tag))), default=0)

    def close(self, tags, stop: int) -> None:
        """Ends the innermost element of these tags that stands inside the place stop, and all in it."""
        first = self.last(tags)
        if first > stop:
            for node in self.stack[first:]:
                self.places[node.tag].pop()
                if node.tag in _BLOCK_STOPS:
                    self.blocks.pop()
            del self.stack[first:]

    def start(self, tag: str) -> None:
        """End tags that the start of an element implies."""
        if tag in _IMPLIED:
            tags, stops = _IMPLIED[tag]
            self.close(tags, self.last(stops))
        if tag in ENDS_P:
            self.close(("p",), self.blocks[-1] if self.blocks else 0)

    def end(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            stops = () if tag == "table" else ("table",)
        else:
            stops = () if tag in ("body", "html") else ("td", "th")
        self.close((tag,), self.last(stops))


def tree(text: str) -> Node:
    root = Node("#root", {})
    opened, at, size = Open(root), 0, len(text)
    stack = opened.stack
    while at < size:
        found = _TAG.search(text, at)
        if found is None:
            stack[-1].children.append(text[at:])
            break
        if found.start() > at:
            stack[-1].children.append(text[at : found.start()])
        at = found.end()
        end, start, rest = found.groups()
        if end:
            opened.end(end.lower())
        elif start:
            tag = start.lower()
            attributes = {}
            if rest:
                for name, a, b, c in _ATTRIBUTE.findall(rest):
                    attributes.setdefault(name.lower(), a or b or c)
            opened.start(tag)
            node = Node(tag, attributes)
            stack[-1].children.append(node)
            if tag in RAW:
                close = re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I).search(text, at)
                node.children.append(text[at : close.start() if close else size])
                at = close.start() if close else size
                if close:
                    at = (text.find(">", close.end()) + 1) or size
            elif tag not in VOID and not (rest or "").endswith("/") or tag in BLOCK:
                if tag not in VOID:
                    opened.push(node)
    return root


class Flow:
    """Lines of a block of text: the page, or one table cell."""

    def __init__(self):
        self.lines, self.parts, self.blank, self.gap, self.indent, self.marker = [], [], True, 0, "", ""

    def add(self, text: str) -> None:
        if text:
            self.parts.append(text)
            self.blank = text[-1] == " "

    def text(self, text: str, keep: bool) -> None:
        if keep:
            first, *others = text.split("\n")
            self.add(first)
            for part in others:
                self.end(True)
                self.add(part)
            return
        text = _BLANKS.sub(" ", text)
        self.add(text[1:] if text[:1] == " " and self.blank else text)

    def end(self, always: bool = False) -> None:
        line = "".join(self.parts).rstrip(" ")
        self.parts, self.blank = [], True
        if line or always:
            if self.lines and self.gap:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            lead = self.indent[: max(0, len(self.indent) - len(self.marker))] + self.marker if self.marker else self.indent
            self.lines.append((lead + line).rstrip(" "))
            self.marker = ""

    def deeper(self, blanks: int) -> None:
        self.indent += " " * min(blanks, max(0, MOST_INDENT - len(self.indent)))

    def space(self, lines: int) -> None:
        self.end()
        self.gap = max(self.gap, lines)

    def block(self, lines: list[str]) -> None:
        for line in lines:
            self.add(line)
            self.end(True)

    def result(self) -> str:
        self.end()
        return "\n".join(self.lines)


def _number(text: str | None, otherwise: int, least: int, most: int) -> int:
    """The integer that a text begins with, held to bounds."""
    found = re.match(r"[ \t\n\f\r]*([+-]?)0*([0-9]*)", text or "")
    if not re.match(r"[ \t\n\f\r]*[+-]?[0-9]", text or ""):
        return otherwise
    size = int(found[2][:12] or 0) if len(found[2]) <= 12 else 10**12
    return min(max(-size if found[1] == "-" else size, least), most)


def _options(select: Node) -> list[Node] | None:
    """The options that a closed list box shows; None where it shows all."""
    if "multiple" in select.attributes or _number(select.attributes.get("size"), 1, 0, ITEM) > 1:
        return None
    found, work = [], [select]
    while work:
        node = work.pop()
        if isinstance(node, Node):
            if node.tag == "option":
                found.append(node)
            elif node.tag in ("select", "optgroup"):
                work.extend(reversed(node.children))
    chosen = [o for o in found if "selected" in o.attributes]
    return chosen[-1:] or [o for o in found if "disabled" not in o.attributes][:1] or found[:1]


def table_lines(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Lines of a table; a cell is its text, columns and rows."""
    grid, held = [], {}
    for row in rows:
        line, column = {}, 0
        held = {c: n - 1 for c, n in held.items() if n > 1}
        now = dict(held)
        for text, columns, down in row:
            while column in now:
                column += 1
            line[column] = text.split("\n")
            for c in range(column, column + columns):
                if down > 1:
                    held[c] = down
            column += columns
        grid.append(line)
    width: dict[int, int] = {}
    for line in grid:
        for column, parts in line.items():
            width[column] = max(width.get(column, 0), max(map(len, parts)))
    order, out = sorted(c for c, w in width.items() if w), []
    for line in grid:
        for k in range(max((len(p) for p in line.values()), default=0)):
            parts = [(line[c][k] if c in line and k < len(line[c]) else "").ljust(min(width[c], WIDEST)) for c in order]
            text = "  ".join(parts).rstrip(" ")
            if text:
                out.append(text)
    return out


def _shown(node: Node, parent: Node | None, seen: bool) -> tuple[bool, bool]:
    """Whether the element is there at all, and whether its own text is visible."""
    a = node.attributes
    if node.tag in UNSEEN or "hidden" in a or (node.tag == "dialog" and "open" not in a):
        return False, False
    if parent is not None and parent.tag == "details" and "open" not in parent.attributes and node.tag != "summary":
        return False, False
    style = a.get("style")
    if style:
        if _NONE.search(style):
            return False, False
        for value in _SEEN.findall(style):
            seen = value.lower() == "visible"
    return True, seen


def render(text: str | None) -> str:
    """The visible text of a page; of null or empty html the empty text."""
    if not text:
        return ""
    flows, tables, lists, drawn = [Flow()], [], [], []
    work: list = [(tree(text), None, True, False, False)]
    while work:
        item, parent, seen, keep, leaving = work.pop()
        flow = flows[-1]
        if isinstance(item, str):
            if seen and not (parent.tag == "details" and "open" not in parent.attributes):
                if tables and tables[-1][1] == len(flows) and not item.strip():
                    continue
                flow.text(html.unescape(item), keep)
            continue
        tag = item.tag
        if leaving:
            if tag == "svg":
                drawn.pop()
            if tag in ("td", "th") and tables and tables[-1][1] == len(flows) - 1:
                cell = flows.pop().result()
                # No rows at all means all that follow.
                down = _number(item.attributes.get("rowspan"), 1, 0, DOWN) or DOWN
                tables[-1][0][-1].append((cell, _number(item.attributes.get("colspan"), 1, 1, COLUMNS), down))
                continue
            if tag == "table" and tables and tables[-1][2] is item:
                rows = tables.pop()[0]
                flow.end()
                flow.block(table_lines(rows))
            elif tag in ("ul", "ol", "menu", "dl") and lists and lists[-1][2] is item:
                lists.pop()
            elif tag == "li" or tag in ("dd", "blockquote"):
                flow.end()
                flow.marker = ""
                flow.indent = work.pop()
            if tag in SPACED:
                flow.space(0 if tag in ("ul", "ol") and lists else 1)
            elif tag in BLOCK:
                flow.space(0)
            continue
        there, seen = _shown(item, parent, seen) if parent is not None else (True, True)
        if not there:
            continue
        children = item.children
        if tag == "svg":
            outside, seen = seen, False
            drawn.append(outside)
        elif tag in ("text", "foreignobject") and drawn:
            seen = seen or drawn[-1]
        elif tag == "select":
            children = children if (only := _options(item)) is None else only
        keep = keep or tag in ("pre", "textarea")
        if tag == "br":
            if seen:
                flow.end(True)
            continue
        if tag in SPACED:
            flow.space(0 if tag in ("ul", "ol") and lists else 1)
        elif tag in BLOCK and not (tag in ("td", "th") and tables):
            flow.space(0)
        if tag == "li" or tag in ("dd", "blockquote"):
            work.append(flow.indent)
        work.append((item, parent, seen, keep, True))
        if tag == "li":
            mark = "- "
            if lists and lists[-1][0] == "ol":
                lists[-1][1] = _number(item.attributes.get("value"), lists[-1][1], -ITEM, ITEM)
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            flow.deeper(len(mark))
            flow.marker = mark
        elif tag in ("dd", "blockquote"):
            flow.deeper(2)
        elif tag in ("ul", "ol", "menu", "dl"):
            lists.append([tag, _number(item.attributes.get("start"), 1, -ITEM, ITEM), item])
        elif tag == "table":
            tables.append(([], len(flows), item))
        elif tag == "tr" and tables and tables[-1][1] == len(flows):
            tables[-1][0].append([])
        elif tag in ("td", "th") and tables and tables[-1][1] == len(flows):
            if not tables[-1][0]:
                tables[-1][0].append([])
            flows.append(Flow())
        work.extend((child, item, seen, keep, False) for child in reversed(children))
    while len(flows) > 1:
        cell = flows.pop().result()
        flows[-1].text(cell, True)
    return flows[0].result()


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text, n_lines) of every row: null and empty html give an empty text of 0 lines. Repeated rows give a row each; other columns are not read."""
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").cast("string").alias("html"))

    def run(parts):
        for batch in parts:
            for lo in range(0, batch.num_rows, 256):
                texts = [render(x) for x in batch.column(1)[lo : lo + 256].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo : lo + 256], pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], names=["id", "text", "n_lines"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string, n_lines long").withColumnRenamed("id", id_col)
