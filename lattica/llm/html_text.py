"""Layout-aware text of web pages.

A small tree builder follows the HTML rules for implied tags (paragraphs, list
items, table parts, head and body), then the tree is rendered as a reader would
see it: hidden elements go, blocks get lines of their own, lists get markers,
cells of a table are aligned in columns, preformatted text keeps its spacing.
All visible text stays, menus and footers included. Both passes keep stacks of
their own and do a bounded amount of work for each tag, so pages may be long
and nested at will.

Visible is what a page shows with its scripts and media not loaded: computed
display (none takes all inside along) and visibility (inherited, and a child may
be shown again) from style attributes and ``hidden``; fallbacks of objects;
values of text fields, the chosen option of a menu, all options of a list box;
summaries of closed details; not closed dialogs, nor what stands in for scripts,
canvases, sound and video. Style sheets are not looked at.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard: kinds of elements and which of them end others by starting.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = frozenset("head script style template noscript title meta link datalist iframe noembed noframes canvas audio video progress meter rp defs desc metadata annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption optgroup option".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr main menu nav ol p pre search section table ul summary dd dt li".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: A start tag ends the nearest open one of these, searched up to the barrier.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
    "tr": (frozenset("tr td th caption colgroup".split()), frozenset("table tbody thead tfoot".split())),
    "td": (frozenset("td th".split()), frozenset("table tr".split())),
    "th": (frozenset("td th".split()), frozenset("table tr".split())),
    "tbody": (frozenset("tbody thead tfoot caption colgroup".split()), frozenset(["table"])),
    "thead": (frozenset("tbody thead tfoot caption colgroup".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot caption colgroup".split()), frozenset(["table"])),
}
#: Elements that an end tag inside them does not reach beyond.
SCOPE = frozenset("html table td th caption template".split())
TABLE_PARTS = frozenset("tr td th tbody thead tfoot".split())
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())
#: Rules of the start tags: what is ended, up to which barrier. Those of IMPLIED go by their own tag.
RULES = IMPLIED | {"p": (frozenset(["p"]), SCOPE | {"button"}), "a": (frozenset(["a"]), SCOPE), "row": (frozenset(["tr"]), frozenset(["table"]))}
#: For each tag the rules it matters to, as what is ended (True) or as a barrier.
_MARKS: dict[str, list[tuple[str, bool]]] = defaultdict(list)
for _rule, (_ended, _barrier) in RULES.items():
    for _tag in sorted(_ended | _barrier):
        _MARKS[_tag].append((_rule, _tag in _ended))
#: Values of display by what they make of an element, values of visibility, inputs that show their value.
DISPLAY_BLOCK = frozenset("block flow-root list-item flex grid table table-caption table-row table-cell table-row-group table-header-group table-footer-group".split())
DISPLAY_INLINE = frozenset("inline inline-block inline-flex inline-grid inline-table contents ruby".split())
VISIBILITY = frozenset("visible hidden collapse".split())
SHOWN_INPUTS = frozenset(["", *"text search url tel email number date month week time datetime-local submit button reset".split()])
#: Aligned tables inside one another, levels of indent, and columns or rows that a cell may span, beyond which text stays but layout is plain.
MOST_ALIGNED, MOST_INDENT, MOST_SPAN = 6, 32, 100

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?:[!?])[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+\"[^\"]*+(?:\"|\Z)|=\s*+'[^']*+(?:'|\Z)|[^>])*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s\"'>]++)))?")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


class _Open:
    """The stack of open elements; for each rule and tag it knows at once where the nearest one that matters stands."""

    def __init__(self, root: Node):
        self.nodes: list[Node] = []
        self.marks: dict[str, list[tuple[int, bool]]] = defaultdict(list)
        self.at: dict[str, list[int]] = defaultdict(list)  # by tag
        self.scopes: list[int] = []
        self.push(root)

    def push(self, node: Node) -> None:
        k = len(self.nodes)
        for rule, ended in _MARKS.get(node.tag, ()):
            self.marks[rule].append((k, ended))
        self.at[node.tag].append(k)
        if node.tag in SCOPE:
            self.scopes.append(k)
        self.nodes.append(node)

    def cut(self, k: int) -> list[Node]:
        """Close everything from place k on."""
        gone = self.nodes[k:]
        del self.nodes[k:]
        for node in gone:
            for rule, _ in _MARKS.get(node.tag, ()):
                self.marks[rule].pop()
            self.at[node.tag].pop()
            if node.tag in SCOPE:
                self.scopes.pop()
        return gone

    def end(self, rule: str) -> None:
        """Close the nearest element that the rule ends, unless a barrier stands before it."""
        marks = self.marks[rule]
        if marks and marks[-1][1] and marks[-1][0] > 0:
            self.cut(marks[-1][0])

    def nearest(self, tag: str) -> int:
        """The place of the nearest open element of this tag, -1 if there is none."""
        return self.at[tag][-1] if self.at[tag] else -1


def parse(source: str) -> Node:
    """The element tree; text children are str. Never fails: what cannot be a tag is text."""
    root = Node("html")
    stack = _Open(root)
    body_open = False

    def open_body() -> None:
        nonlocal body_open
        if not body_open:
            stack.cut(1)
            body = Node("body")
            root.children.append(body)
            stack.push(body)
            body_open = True

    def text(value: str) -> None:
        if not value:
            return
        if not body_open and stack.nodes[-1].tag in ("html", "head"):
            if not value.strip():
                return
            open_body()
        top = stack.nodes[-1]
        if top.tag in ("table", "tbody", "thead", "tfoot", "tr") and value.strip() and (k := stack.nearest("table")) > 0:
            # text between cells is shown before the table
            before = stack.nodes[k - 1].children
            before.insert(max(0, len(before) - 1), value)
            return
        top.children.append(value)

    at, n = 0, len(source)
    for_raw = source.lower() if len(source.lower()) == n else re.sub("[A-Z]", lambda m: m[0].lower(), source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            text(html.unescape(source[at:]))
            break
        m = _TOKEN.match(source, lt)
        if not m:
            text(html.unescape(source[at : lt + 1]))
            at = lt + 1
            continue
        text(html.unescape(source[at:lt]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            _end(stack, tag)
            if tag == "head":
                open_body()
            continue
        if tag == "html":
            continue
        if tag == "head":
            if not body_open and stack.nodes[-1] is root:
                head = Node("head")
                root.children.append(head)
                stack.push(head)
            continue
        if tag == "body":
            open_body()
            continue
        if not body_open and tag not in HEAD_ONLY:
            open_body()
        attrs = {}
        if m[3] and m[3] != "/":
            for a in _ATTRIBUTE.finditer(m[3]):
                value = a[2] if a[2] is not None else a[3] if a[3] is not None else a[4]
                attrs.setdefault(a[1].lower(), html.unescape(value) if value else "")
        if tag in ENDS_P:
            stack.end("p")
        if tag in HEADINGS and stack.nodes[-1].tag in HEADINGS:
            stack.cut(len(stack.nodes) - 1)
        if tag in IMPLIED:
            stack.end(tag)
            if tag == "tr":
                stack.end("row")
        if tag == "a":
            stack.end("a")
        node = Node(tag, attrs)
        stack.nodes[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW and not (tag in ("title", "style", "script") and stack.nearest("svg") > 0 and m[3].rstrip().endswith("/")):
            stop = n if tag == "plaintext" else for_raw.find(f"</{tag}", at)
            stop = n if stop < 0 else stop
            value = source[at:stop]
            node.children.append(html.unescape(value) if tag in ("textarea", "title") else value)
            gt = source.find(">", stop)
            at = n if gt < 0 else gt + 1
            continue
        if m[3].endswith("/") and (stack.nearest("svg") > 0 or stack.nearest("math") > 0 or tag in ("svg", "math")):
            continue  # in these two an element may end itself
        stack.push(node)
    return root


def _end(stack: _Open, tag: str) -> None:
    if tag in ("body", "html") or tag in VOID:
        return
    k = max(map(stack.nearest, HEADINGS)) if tag in HEADINGS else stack.nearest(tag)
    if tag == "p" and k < 0:
        stack.nodes[-1].children.append(Node("p"))
        return
    if tag in TABLE_PARTS:
        barrier = stack.nearest("table")
    else:
        barrier = stack.scopes[-1] if stack.scopes and tag != "table" else 0
    if k <= 0 or k < barrier:
        return
    gone = stack.cut(k)
    if tag not in FORMATTING and tag in BLOCK:
        again = [Node(x.tag, x.attrs) for x in gone[1:] if x.tag in FORMATTING]
        for node in again[:8]:  # formatting that was left open goes on behind the block
            stack.nodes[-1].children.append(node)
            stack.push(node)


def computed(node: Node, shown: bool) -> tuple[bool, bool, bool]:
    """(displayed at all, a block, text directly inside is visible); ``shown``: the visibility that is inherited.

    Of several declarations the last valid one counts, an important one before others.
    """
    tag, attrs = node.tag, node.attrs
    if tag in HIDDEN or (tag == "dialog" and "open" not in attrs) or (tag == "input" and attrs.get("type", "").lower() == "hidden"):
        return False, False, shown
    display = "none" if "hidden" in attrs else ""
    style = attrs.get("style")
    if style:
        found: dict[str, tuple[bool, str]] = {}
        for part in (_COMMENT.sub(" ", style) if "/*" in style else style).split(";"):
            name, colon, value = part.partition(":")
            name = name.strip().lower()
            if not colon or name not in ("display", "visibility"):
                continue
            value = value.strip().lower()
            important = value.endswith("important") and "!" in value
            value = value.partition("!")[0].strip()
            known = VISIBILITY if name == "visibility" else DISPLAY_BLOCK | DISPLAY_INLINE | {"none"}
            if value in known and (important or not found.get(name, (False, ""))[0]):
                found[name] = (important, value)
        display = found["display"][1] if "display" in found else display
        if "visibility" in found:
            shown = found["visibility"][1] == "visible"
    if display == "none":
        return False, False, shown
    return True, display in DISPLAY_BLOCK or (tag in BLOCK and display not in DISPLAY_INLINE), shown


class _Page:
    """Lines in the making: blank lines between blocks collapse, spaces in a line too."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False  # a space is due before the next word
        self.blank = False  # a blank line is due before the next line
        self.prefix: list[str] = []  # indents and list markers
        self.fresh = 0  # from here on they have not been shown yet

    def word(self, value: str) -> None:
        parts = _SPACE.split(value)
        for i, p in enumerate(parts):
            if i:
                self.gap = bool(self.line)
            if p:
                if self.gap:
                    self.line.append(" ")
                    self.gap = False
                self.line.append(p)

    def flush(self) -> None:
        if self.line:
            self.put("".join(self.line))
        self.line, self.gap = [], False

    def put(self, value: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.lines.append("".join(self.prefix[:MOST_INDENT]) + value)
        for k in range(min(self.fresh, MOST_INDENT), min(len(self.prefix), MOST_INDENT)):  # markers are shown once
            self.prefix[k] = " " * len(self.prefix[k])
        self.fresh = len(self.prefix)

    def indent(self, value: str) -> None:
        self.prefix.append(value)

    def outdent(self) -> None:
        self.prefix.pop()
        self.fresh = min(self.fresh, len(self.prefix))

    def brk(self) -> None:
        if self.line:
            self.flush()
        elif self.lines and not self.blank:
            self.blank = True


    def text(self) -> list[str]:
        """The lines, without blank ones at either end."""
        self.flush()
        return "\n".join(line.rstrip() for line in self.lines).strip("\n").split("\n")


class _Table:
    """Cells of a table in the making, and which columns those above still cover."""

    def __init__(self):
        self.lines: list[str] = []
        self.grid: list[list[tuple[int, list[str]]]] = []
        self.held: dict[int, int] = {}  # column -> rows that a cell above still covers
        self.cover: dict[int, int] = {}
        self.column = 0

    def row(self) -> None:
        self.grid.append([])
        self.cover = self.held
        self.held = {c: r - 1 for c, r in self.held.items() if r > 1}
        self.column = 0

    def place(self, cell: Node) -> int:
        while self.column in self.cover:
            self.column += 1
        column, across, down = self.column, _span(cell, "colspan"), _span(cell, "rowspan")
        if down > 1:
            self.held.update({c: down - 1 for c in range(column, column + across)})
        self.column += across
        return column

    def aligned(self) -> list[str]:
        """One line per row and line of its cells; columns start at one place."""
        widths: dict[int, int] = {}
        for cells in self.grid:
            for column, text in cells[:-1]:
                widths[column] = max(widths.get(column, 0), max(map(len, text)))
        starts: dict[int, int] = {}
        at = 0
        for column in sorted({c for cells in self.grid for c, _ in cells}):
            starts[column] = at
            at += widths.get(column, 0) + 2
        lines = self.lines
        for cells in self.grid:
            for k in range(max((len(t) for _, t in cells), default=0)):
                line = ""
                for column, text in cells:
                    if k < len(text) and text[k]:
                        line = line.ljust(starts[column]) if len(line) <= starts[column] else line + "  "
                        line += text[k]
                lines.append(line)
        return [x for x in lines if x.strip()]


def _table_parts(table: Node, shown: bool) -> list[tuple[Node, bool]]:
    """The displayed rows, captions and whatever else stands in a table, with their inherited visibility."""
    out, work = [], [(c, shown) for c in reversed(table.children) if isinstance(c, Node)]
    while work:
        node, seen = work.pop()
        displayed, _, own = computed(node, seen)
        if not displayed or node.tag in ("colgroup", "col"):
            continue
        if node.tag in ("tbody", "thead", "tfoot"):
            work.extend((c, own) for c in reversed(node.children) if isinstance(c, Node))
        else:
            out.append((node, seen))
    return out


def _chosen(select: Node) -> Node:
    """What a menu shows: its last option marked selected, else its first one."""
    options, work = [], list(reversed(select.children))
    while work:
        node = work.pop()
        if isinstance(node, Node):
            if node.tag == "option":
                options.append(node)
            else:
                work.extend(reversed(node.children))
    marked = [o for o in options if "selected" in o.attrs]
    shown = Node("span")
    shown.children = (marked[-1:] or options[:1])
    return shown


def render(root: Node) -> str:
    """The visible text of a tree. Walks with a stack of its own through blocks, lists and tables."""
    pages, tables = [_Page()], []
    # (what, node or value, preformatted, visible)
    work: list[tuple] = [("open", root, False, True)]
    lists: list[list] = []
    while work:
        what, node, pre, shown = work.pop()
        page = pages[-1]
        if what == "open":
            if isinstance(node, str):
                if shown:
                    _text(page, node, pre)
                continue
            displayed, block, shown = computed(node, shown)
            if displayed:
                _element(node, block, pre, shown, page, pages, tables, lists, work)
        elif what == "close":
            page.flush()
            if node.tag in SPACED and not (node.tag in ("ul", "ol") and lists[1:]):
                page.blank = True
        elif what == "list":
            lists.pop()
        elif what == "outdent":
            page.flush()
            page.outdent()
        elif what == "row":
            tables[-1].row()
        elif what == "cell":
            column = tables[-1].place(node)
            pages.append(_Page())
            work.append(("cell end", column, False, True))
            work.extend(("open", c, pre, shown) for c in reversed(node.children))
        elif what == "cell end":
            tables[-1].grid[-1].append((node, pages.pop().text()))
        elif what == "loose":
            pages.append(_Page())
            work.extend([("loose end", node, False, True), ("open", node, pre, shown)])
        elif what == "loose end":
            tables[-1].lines += [x for x in pages.pop().text() if x]
        elif what == "table end":
            for line in tables.pop().aligned():
                page.put(line)
            page.blank = True
        elif what == "gap":
            page.gap = bool(page.line)
    return "\n".join(pages[0].text())


def _text(page: _Page, value: str, pre: bool) -> None:
    if not pre:
        page.word(value)
        return
    for i, row in enumerate(value.split("\n")):
        if i:
            page.put("".join(page.line))
            page.line = []
        if row:
            page.line.append(row)


def _element(node: Node, block: bool, pre: bool, shown: bool, page: _Page, pages: list, tables: list, lists: list, work: list) -> None:
    """Enter a displayed element: what it shows itself goes to the page, its children to the work."""
    tag, attrs = node.tag, node.attrs
    if tag == "br":
        page.brk()
        return
    if tag == "hr":
        page.flush()
        return
    if tag in ("img", "input", "area"):
        kind = attrs.get("type", "").lower()
        value = attrs.get("alt", "") if tag != "input" or kind == "image" else (attrs.get("value") or attrs.get("placeholder", "")) if kind in SHOWN_INPUTS else ""
        if shown and tag != "area" and value.strip():
            page.word(f" {value} ")
        return
    if block:
        page.flush()
        if tag in SPACED and not (tag in ("ul", "ol") and lists):
            page.blank = True
    if tag == "table":
        parts = _table_parts(node, shown)
        if len(tables) >= MOST_ALIGNED or all(len([c for c in p.children if isinstance(c, Node)]) < 2 for p, _ in parts if p.tag == "tr"):
            # nothing to align: cells follow one another
            work.append(("close", node, pre, shown))
            for part, seen in reversed(parts):
                if part.tag != "tr":
                    work.append(("open", part, pre, seen))
                    continue
                own = computed(part, seen)[2]
                work.append(("close", Node("tr"), pre, own))
                for cell in reversed(part.children):
                    if isinstance(cell, Node) and cell.tag in ("td", "th"):
                        inside = Node("span", cell.attrs)
                        inside.children = cell.children
                        work.extend([("gap", None, pre, own), ("open", inside, pre, own)])
                    else:
                        work.append(("open", cell, pre, own))
            return
        tables.append(_Table())
        work.append(("table end", node, pre, shown))
        for part, seen in reversed(parts):
            if part.tag != "tr":
                work.append(("loose", part, pre, seen))
                continue
            own = computed(part, seen)[2]
            cells = []
            for cell in part.children:
                if isinstance(cell, str):
                    continue  # the builder puts text before the table
                displayed, _, inner = computed(cell, own)
                if displayed:
                    cells.append(("cell", cell, pre, inner))
            work.extend([*reversed(cells), ("row", part, pre, own)])
        return
    if block:
        work.append(("close", node, pre, shown))
    children = node.children
    if tag in ("ul", "ol", "menu", "dir"):
        begin = attrs.get("start", "1")
        lists.append([tag == "ol", int(begin) if re.fullmatch(r"-?\d{1,9}", begin) else 1])
        work.append(("list", node, pre, shown))
    elif tag == "li":
        marker = "- "
        if lists and lists[-1][0]:
            value = attrs.get("value", "")
            if re.fullmatch(r"-?\d{1,9}", value):
                lists[-1][1] = int(value)
            marker = f"{lists[-1][1]}. "
            lists[-1][1] += 1
        page.indent(marker if shown else "")
        work.append(("outdent", node, pre, shown))
    elif tag in ("blockquote", "dd"):
        page.indent("  ")
        work.append(("outdent", node, pre, shown))
    elif tag == "select":
        if "multiple" not in attrs and attrs.get("size", "1").strip() in ("", "0", "1"):
            inside = _chosen(node).children
            children = [Node("span", x.attrs) for x in inside]
            for new, old in zip(children, inside, strict=True):
                new.children = old.children
            work.append(("gap", None, pre, shown))
            page.gap = bool(page.line)
    elif tag == "optgroup" and attrs.get("label", "").strip():
        if shown:
            page.word(attrs["label"])
            page.flush()
    elif tag == "option" and attrs.get("label", "").strip() and not any(isinstance(c, str) and c.strip() for c in children):
        children = [attrs["label"]]
    elif tag == "details" and "open" not in attrs:
        children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
    elif tag in ("svg", "g", "symbol", "marker", "pattern", "clippath", "mask"):
        children = [c for c in children if isinstance(c, Node)] if tag in ("svg", "g") else []
    elif tag == "textarea" and not any(isinstance(c, str) and c.strip() for c in children):
        children = [attrs.get("placeholder", "")]
    inner = pre or tag in ("pre", "textarea", "xmp", "listing", "plaintext")
    work.extend(("open", c, inner, shown) for c in reversed(children))


def _span(cell: Node, name: str) -> int:
    value = cell.attrs.get(name, "1")
    return min(MOST_SPAN, max(1, int(value))) if re.fullmatch(r"\d{1,6}", value) else 1


def page_text(source: str | None) -> str:
    """The visible text of one page; empty for null or empty input."""
    return render(parse(source)) if source else ""


def extract_text(pages: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """Add ``out``, the visible text of ``column``. Rows and further columns stay as they are.

    Null and empty pages give empty text; an existing ``out`` column is refused.
    """
    if out in pages.columns:
        raise ValueError(f"column exists already: {out}")

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([page_text(x) for x in s], dtype=object)

    return pages.withColumn(out, extract(F.col(column)))
