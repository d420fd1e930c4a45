"""Layout-aware rendering of HTML to text.

A tree is built from the markup with the usual implied tags (a block ends an open
paragraph, list items, table cells, rows and options end each other, a cell opens a
row, body content ends the head). Invisible parts are left out: head, scripts, styles,
templates, ``hidden``, ``display:none``, ``visibility:hidden`` (unless set visible again
inside), closed dialogs, the body of closed details, fallback content of media. All
other text is emitted:

* blocks start and end lines, paragraphs, headings, lists, tables and quotes are set off
  by a blank line;
* white space collapses outside ``pre`` and ``textarea``; ``br`` breaks the line, ``hr``
  is a line of its own;
* list items carry ``-`` or their number, and continuation lines are indented;
* table cells are aligned in columns two spaces apart, a cell of several lines takes
  several lines. Columns are at most ``MAX_COLUMN`` wide; longer cells run over.

Edge cases: null gives null, an empty page an empty text; a ``<`` that starts no tag is
text; unclosed comments, tags and quoted values run to the end of the page, a stray quote
in a tag is a plain character; end tags without start are dropped; nesting may be of any depth (no recursion); work and output grow in
proportion to the page, except for column padding, which is bounded by ``MAX_COLUMN`` a
cell. Repeated rows give repeated results, an empty table gives an empty one.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_COLUMN = 80
MAX_SPAN = 1000
#: an attribute; a quote opens a string only directly after the equals sign
_PAIR = r"""[^\s/>][^\s/>=]*(?:\s*=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'>][^\s>]*)?)?"""
_TOKEN = re.compile(rf"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]+|{_PAIR})*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>][^\s>]*))?)?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_LANGUAGE = re.compile(r"\s*([a-z]{2,3})\b", re.I | re.A)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style title textarea xmp iframe noembed noframes noscript".split()}
_HEAD = frozenset("head base link meta title script style noscript template".split())
_INVISIBLE = frozenset("head script style title template noscript iframe noembed noframes object audio video canvas datalist".split())
_WIDE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl table pre hr figure fieldset".split())
_BLOCK = _WIDE | frozenset("html body div section article aside header footer nav main address li dt dd form details summary "
                           "figcaption center caption tr option optgroup select legend dialog menu search hgroup".split())
_ENDS_P = _BLOCK - frozenset("html body option optgroup select caption tr legend li dt dd".split()) | {"li", "dt", "dd"}
#: start tag -> (open elements it ends, elements that stop the search)
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    **{t: ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}) for t in ("thead", "tbody", "tfoot")},
    **{f"h{i}": ({f"h{k}" for k in range(1, 7)}, _BLOCK - {f"h{k}" for k in range(1, 7)}) for i in range(1, 7)},
}
_SCOPE = frozenset("td th table caption".split())


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag, attrs=None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []


def _attributes(text: str) -> dict:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)} if text and not text.isspace() else {}


def parse(page: str) -> Node:
    """The tree of a page. Text is a plain string among a node's kids. The root has the
    attributes of all ``html`` tags, the first of a name counts."""
    root = Node("html")
    stack = [root]
    opened: dict[str, int] = {"html": 1}    # how often each tag is open, to skip searches

    def pop_to(n):
        while len(stack) > n:
            opened[stack.pop().tag] -= 1

    def close(tags, stops):
        if not any(opened.get(t) for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                pop_to(i)
                if not any(opened.get(t) for t in tags):
                    return
            elif stack[i].tag in stops:
                return

    def push(tag, attrs=None):
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        stack.append(node)
        opened[tag] = opened.get(tag, 0) + 1

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        text = page[at:m.start()] if m else page[at:]
        if text:
            if opened.get("head") and not text.isspace():
                close({"head"}, ())
            stack[-1].kids.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if opened.get(tag) and tag != "html":
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        pop_to(i)
                        break
                    if stack[i].tag in _SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "caption"):
                        break
            elif tag == "br":
                stack[-1].kids.append(Node("br"))
            continue
        if tag == "html":
            root.attrs = _attributes(m[3]) | root.attrs
            continue
        if opened.get("head") and tag not in _HEAD:
            close({"head"}, ())
        if tag in _ENDS_P:
            close({"p"}, _SCOPE | {"button"})
        if tag in _IMPLIED:
            close(*_IMPLIED[tag])
        if tag in ("td", "th") and opened.get("table") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            push("tr")
        attrs = _attributes(m[3])
        if tag in _VOID:
            stack[-1].kids.append(Node(tag, attrs))
        elif tag in _RAW:
            stop = _RAW[tag].search(page, at)
            node = Node(tag, attrs)
            if tag in ("textarea", "xmp"):
                node.kids.append(html.unescape(page[at:stop.start() if stop else end]))
            stack[-1].kids.append(node)
            close_at = page.find(">", stop.start()) if stop else -1
            at = close_at + 1 if close_at >= 0 else end
        else:
            push(tag, attrs)
            if m[3].endswith("/") and tag in ("svg", "path", "g", "use", "rect", "circle", "math"):
                pop_to(len(stack) - 1)
    return root


def _shown(node: Node, visible: bool) -> tuple[bool, bool]:
    """(is laid out, text is visible) of a node."""
    a = node.attrs
    if node.tag in _INVISIBLE or "hidden" in a or (node.tag == "dialog" and "open" not in a):
        return False, False
    style = a.get("style")
    if style:
        style = _SPACE.sub("", style.lower())
        if "display:none" in style:
            return False, False
        if "visibility:hidden" in style or "visibility:collapse" in style:
            visible = False
        elif "visibility:visible" in style:
            visible = True
    return True, visible


class Canvas:
    """Lines of text, with requested line breaks that collapse, and prefixes of list items."""

    def __init__(self):
        self.lines, self.parts = [], []
        self.breaks, self.space = 0, False
        self.indent: list[str] = []
        self.marker: str | None = None

    def text(self, s: str) -> None:
        words = _SPACE.sub(" ", s)
        if words == " ":
            self.space = True
            return
        if not words:
            return
        if words[0] == " ":
            self.space = True
        body = words.strip(" ")
        if self.parts and self.space:
            body = " " + body
        self._put(body)
        self.space = words[-1] == " "

    def raw(self, s: str) -> None:
        lines = s.split("\n")
        for i, line in enumerate(lines):
            if i:
                self.flush(force=True)
            if line:
                self._put(line)
        self.space = False

    def _put(self, s: str) -> None:
        if not self.parts:
            if self.lines:
                self.lines.extend([""] * (self.breaks - 1))
            self.breaks = 1
            self.parts.append("".join(self.indent[:-1]) + self.marker if self.marker is not None else "".join(self.indent))
            self.marker = None
        self.parts.append(s)

    def flush(self, force: bool = False) -> None:
        if self.parts:
            self.lines.append("".join(self.parts).rstrip(" "))
            self.parts = []
            self.breaks = 1
        elif force:
            self.breaks += 1
        self.space = False

    def break_(self, n: int) -> None:
        self.flush()
        self.breaks = max(self.breaks, n)

    def block(self, lines) -> None:
        for line in lines:
            self.flush()
            self._put(line) if line else self.flush(force=True)
        self.flush()

    def done(self) -> list[str]:
        self.flush()
        return self.lines


def _width(s: str) -> int:
    return len(s) if s.isascii() else sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in s)


def _table(rows) -> list[str]:
    """Aligned lines of rows of (cell lines, span)."""
    grid, wide = [], []
    for row in rows:
        cells, column = [], 0
        for lines, span in row:
            cells.append((column, lines, span))
            if span == 1:
                while len(wide) <= column:
                    wide.append(0)
                wide[column] = max([wide[column], *(w for w in map(_width, lines) if w <= MAX_COLUMN)])
            column += span
        grid.append(cells)
    starts = [0]
    for w in wide:
        starts.append(starts[-1] + (w + 2 if w else 0))
    out = []
    for cells in grid:
        for k in range(max((len(lines) for _, lines, _ in cells), default=0)):
            line, at = "", 0
            for column, lines, _ in cells:
                s = lines[k] if k < len(lines) else ""
                if not s:
                    continue
                pad = max(starts[min(column, len(starts) - 1)] - at, 2 if line else 0)
                line += " " * pad + s
                at += pad + _width(s)
            out.append(line)
    return out


def declared_language(root: Node) -> str:
    """The language a page declares for itself: ``lang`` (or ``xml:lang``) of ``html``, else its
    first ``content-language`` meta; the primary subtag in lower case, or an empty string."""
    for name in ("lang", "xml:lang"):
        m = _LANGUAGE.match(root.attrs.get(name, ""))
        if m:
            return m[1].lower()
    todo = list(reversed(root.kids))
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            continue
        if node.tag == "meta" and "content-language" in (node.attrs.get("http-equiv", "").strip().lower(), node.attrs.get("name", "").strip().lower()):
            m = _LANGUAGE.match(node.attrs.get("content", ""))
            if m:
                return m[1].lower()
        todo.extend(reversed(node.kids))
    return ""


def render(page: str | None) -> str | None:
    return None if page is None else lay_out(parse(page))


def lay_out(root: Node) -> str:
    """The text of a parsed page."""
    canvas, tables, lists = Canvas(), [], []
    outer: list[Canvas] = []
    todo = [(kid, True, True) for kid in reversed(root.kids)]    # (node, entering, visible)
    pre = 0
    while todo:
        node, entering, visible = todo.pop()
        if isinstance(node, str):
            if visible:
                canvas.raw(node) if pre else canvas.text(node)
            continue
        tag = node.tag
        if entering:
            laid_out, visible = _shown(node, visible)
            if not laid_out:
                continue
            if tag == "br":
                canvas.flush(force=True)
                continue
            if tag == "hr":
                canvas.break_(1), canvas.text("---"), canvas.break_(1)
                continue
            if tag == "input":
                if node.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text") and node.attrs.get("value"):
                    canvas.text(" " + node.attrs["value"] + " ")
                continue
            if tag in ("td", "th") and tables:
                outer.append(canvas)
                canvas = Canvas()
            elif tag == "caption" and tables:
                canvas.break_(1)
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag == "table":
                canvas.break_(2)
                tables.append([])
            elif tag in _BLOCK:
                canvas.break_(2 if tag in _WIDE and not (tag in ("ul", "ol") and lists) else 1)
            if tag in ("ul", "ol", "menu"):
                first = node.attrs.get("start", "1")
                lists.append([tag, int(first) if re.fullmatch(r"-?\d{1,9}", first) else 1])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                value = node.attrs.get("value", "")
                if re.fullmatch(r"-?\d{1,9}", value):
                    kind[1] = int(value)
                canvas.marker = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                canvas.indent.append(" " * min(len(canvas.marker), 12))
            elif tag in ("blockquote", "dd"):
                canvas.indent.append("  ")
            elif tag in ("pre", "textarea", "xmp"):
                pre += 1
            todo.append((node, False, visible))
            kids = node.kids
            if tag == "details" and "open" not in node.attrs:
                kids = [k for k in kids if not isinstance(k, str) and k.tag == "summary"][:1]
            todo.extend((k, True, visible) for k in reversed(kids))
            continue
        if tag in ("td", "th") and tables:
            lines, canvas = canvas.done(), outer.pop()
            span = node.attrs.get("colspan", "1")
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((lines, min(max(int(span), 1), MAX_SPAN) if re.fullmatch(r"\d{1,9}", span) else 1))
        elif tag == "table":
            canvas.block(_table(tables.pop()))
            canvas.break_(2)
        elif tag in _BLOCK and not (tag == "tr" and tables):
            if tag in ("ul", "ol", "menu"):
                lists.pop()
            elif tag == "li":
                canvas.flush()
                canvas.indent.pop()
                canvas.marker = None
            elif tag in ("blockquote", "dd"):
                canvas.flush()
                canvas.indent.pop()
            elif tag == "pre":
                pre -= 1
            canvas.break_(2 if tag in _WIDE and not (tag in ("ul", "ol") and lists) else 1)
        elif tag in ("textarea", "xmp"):
            pre -= 1
    return "\n".join(canvas.done())


def extract_text(pages: DataFrame, column: str = "html", out: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all but the markup) with the rendered text as ``out``."""
    kept = [c for c in pages.columns if c != column] if keep is None else keep
    packed = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(f"`{column}`").alias("_html"))

    def run(batches):
        for batch in batches:
            markup = batch.column("_html")
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array([render(x.as_py()) for x in markup], type=pa.string())],
                                             names=["_row", "_text"])

    rendered = packed.mapInArrow(run, packed.select("_row", F.col("_html").alias("_text")).schema)
    return rendered.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], F.col("_text").alias(out))
