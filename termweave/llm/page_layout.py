"""HTML to text as a reader sees it: a small tree builder, visibility rules, and layout-aware rendering."""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm import shared

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
NEVER_SHOWN = frozenset("head script style title template noscript noembed noframes iframe object audio video canvas datalist meta link base param source track area map desc defs metadata annotation".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset hr form article section header footer nav aside main hgroup".split())
BLOCK = SPACED | frozenset("html body div li dt dd address center details summary dialog figcaption legend menu tr td th caption thead tbody tfoot search".split())
#: Start tags that end an open element: tag -> (elements it ends, elements beyond which it does not look).
_CELLS, _ROWS, _GROUPS = {"td", "th"}, {"tr"}, {"thead", "tbody", "tfoot", "caption", "colgroup"}
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": (_CELLS, {"tr", "table"}),
    "th": (_CELLS, {"tr", "table"}),
    "tr": (_CELLS | _ROWS, {"table"}),
    "thead": (_CELLS | _ROWS | _GROUPS, {"table"}),
    "tbody": (_CELLS | _ROWS | _GROUPS, {"table"}),
    "tfoot": (_CELLS | _ROWS | _GROUPS, {"table"}),
    "body": ({"head"}, {"html"}),
}
ENDS_P = (SPACED | {"div", "address", "center", "details", "summary", "dialog", "figcaption", "menu", "li", "dt", "dd"}) - {"hr"} | {"hr"}
P_SCOPE = frozenset({"td", "th", "table", "caption", "button", "object", "html"})
#: Inputs whose value is text on the page.
WRITTEN = frozenset(["", *"text search email url tel number date time month week button submit reset".split()])
MAX_DEPTH = 2000  # deeper elements that say nothing about visibility become children of the element at this depth
WIDE = 1280  # the screen, in px, that media queries are asked about

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_STYLE = re.compile(r"(display)\s*:\s*none|visibility\s*:\s*(?:(hidden|collapse)|(visible))", re.I)
_BRACE = re.compile(r"([^{};]*)([{};])")
_WIDTH = re.compile(r"(min|max)-(?:device-)?width\s*:\s*([\d.]+)\s*(px|em|rem)?", re.I)
GONE, HIDDEN, SHOWN = "gone", "hidden", "shown"
_SIMPLE = re.compile(r"([a-z][a-z0-9]*)?([.#][\w-]+)?", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f]+")
BREAK = "\x00"


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(text: str) -> dict[str, str]:
    if not text or text.isspace():
        return {}
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        out.setdefault(m[1].lower(), html.unescape(value))
    return out


def parse(page: str) -> tuple[Node, list[str]]:
    """The tree of a page, and the texts of its style elements. Missing html, head, body, tbody and tr, and
    missing end tags of p, li, dt, dd, rows, cells and options are implied."""
    root = Node("html", {})
    stack = [root]
    styles: list[str] = []
    at = 0

    def text(value: str) -> None:
        if value:
            stack[-1].children.append(value)

    def end_until(ends: set[str] | frozenset[str], stops: set[str] | frozenset[str]) -> None:
        """Closes the outermost open element of ``ends`` inside the nearest of ``stops``."""
        found = 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in ends:
                found = i
            elif stack[i].tag in stops:
                break
        if found:
            del stack[found:]

    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag == "p" and not any(n.tag == "p" for n in stack):
                stack[-1].children.append(Node("p", {}))
            else:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if stack[i].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                        break  # an end tag inside a cell never ends what is around the table
            continue
        if tag == "html":
            root.attrs = attributes(m[3]) | root.attrs
            continue
        if tag in ENDS:
            end_until(*ENDS[tag])
        elif tag in BLOCK and stack[-1].tag == "head":
            stack.pop()
        if tag in ENDS_P:
            end_until({"p"}, P_SCOPE)
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and re.fullmatch("h[1-6]", stack[-1].tag):
            stack.pop()
        if tag in _CELLS and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr", {})
            stack[-1].children.append(row)
            stack.append(row)
        node = Node(tag, attributes(m[3]))
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            inner = page[at : end.start() if end else len(page)]
            at = end.end() if end else len(page)
            if tag == "style":
                styles.append(inner)
            elif tag not in ("script", "style"):
                node.children.append(inner)
            continue
        if len(stack) < MAX_DEPTH or node.attrs or tag in NEVER_SHOWN:
            stack.append(node)
    text(page[at:])
    return root, styles


def _said(style: str) -> str | None:
    """What declarations say about being seen; being taken out of the page goes first, else the last one counts."""
    out = None
    for m in _STYLE.finditer(style):
        if m[1]:
            return GONE
        out = HIDDEN if m[2] else SHOWN
    return out


def _on_screen(query: str) -> bool:
    """Whether one of a media rule's queries holds on a screen of WIDE px."""
    for one in query.lower().split(","):
        if re.search(r"\b(print|speech|tty|projection)\b", one) and not re.search(r"\bnot\b", one) or re.search(r"\bnot\s+(screen|all)\b|\bprefers-|orientation\s*:\s*portrait", one):
            continue
        sizes = [(m[1], float(m[2]) * (1 if m[3] in (None, "px") else 16)) for m in _WIDTH.finditer(one)]
        if all(WIDE <= n if side == "max" else WIDE >= n for side, n in sizes):
            return True
    return False


def visibility_rules(styles: list[str]) -> list[tuple[str, str, str, str]]:
    """(tag, class, id, what they say) of simple selectors of rules that hold on a screen; other selectors are not judged."""
    found = []
    for style in styles:
        style = re.sub(r"/\*.*?\*/", "", style, flags=re.S)
        open_blocks: list[tuple[str, str]] = []  # kind and selector of the blocks around
        said = ""
        for m in _BRACE.finditer(style):
            head = m[1].strip()
            if m[2] == "{":
                if head.startswith("@"):
                    name = re.match(r"@([\w-]*)", head)[1].lower()
                    holds = _on_screen(head[6:]) if name == "media" else name in ("supports", "layer", "container", "scope", "document")
                    open_blocks.append(("group" if holds else "off", ""))
                else:
                    open_blocks.append(("rule", head))
                said = ""
            elif m[2] == ";":
                said += head + ";"
            elif open_blocks:
                kind, selector = open_blocks.pop()
                what = _said(said + head)
                said = ""
                if kind == "rule" and what and not any(k == "off" for k, _ in open_blocks):
                    for one in selector.split(","):
                        if (s := _SIMPLE.fullmatch(one.strip())) and s[0]:
                            mark = s[2] or ""
                            found.append(((s[1] or "").lower(), mark[1:] if mark[:1] == "." else "", mark[1:] if mark[:1] == "#" else "", what))
    return found


class Renderer:
    """Lines of text of a tree. Block elements start lines, spaced ones leave one blank line around them."""

    def __init__(self, rules: list[tuple[str, str, str, str]]):
        self.rules = rules
        self.tables = self.hidden = 0
        self.seen = True  # what visibility says here

    def visible(self, node: Node) -> bool:
        """False if the element takes no part in the page at all."""
        return self.state(node) != GONE

    def state(self, node: Node) -> str | None:
        if node.tag in NEVER_SHOWN:
            return GONE
        a = node.attrs
        if not a and not self.rules:
            return None
        if "hidden" in a or node.tag == "input" and a.get("type", "").lower() == "hidden":
            return GONE
        own = _said(a["style"]) if "style" in a else None
        if own == GONE or not self.rules:
            return own
        classes = a.get("class", "").split()
        said = [what for t, c, i, what in self.rules if (not t or t == node.tag) and (not c or c in classes) and (not i or i == a.get("id"))]
        if GONE in said and not re.search(r"display\s*:", a.get("style", ""), re.I):
            return GONE
        return own or next((x for x in reversed(said) if x != GONE), None)

    def within(self, node: Node, state: str | None, work):
        """``work(node)`` with the element's own visibility, which its children inherit."""
        before = self.seen
        self.seen = before if state is None else state == SHOWN
        out = work(node)
        self.seen = before
        return out

    @staticmethod
    def chosen(node: Node) -> list[str]:
        """Texts of a select element's options that are on the page."""
        options: list[Node] = []
        todo = list(reversed(node.children))
        while todo:
            x = todo.pop()
            if isinstance(x, Node):
                if x.tag == "option":
                    options.append(x)
                else:
                    todo.extend(reversed(x.children))
        size = node.attrs.get("size", "")
        if "multiple" not in node.attrs and not (size.isdecimal() and int(size[:6]) > 1):
            options = [x for x in options if "selected" in x.attrs][-1:] or options[:1]
        return ["".join(html.unescape(c) for c in x.children if isinstance(c, str)) for x in options if "hidden" not in x.attrs]

    def render(self, root: Node) -> str:
        lines = self.block(root)
        return "\n".join(lines)

    def block(self, node: Node) -> list[str]:
        lines: list[str] = []
        inline: list[str] = []
        gap = False

        def flush() -> None:
            nonlocal gap
            if inline:
                joined = "".join(inline)
                inline.clear()
                parts = [_BLANKS.sub(" ", x).strip(" ") for x in joined.split(BREAK)]
                for i, part in enumerate(parts):
                    if part:
                        add([part])
                    elif 0 < i < len(parts) - 1 and lines and lines[-1]:
                        lines.append("")

        def add(more: list[str]) -> None:
            nonlocal gap
            if more:
                if gap and lines and lines[-1]:
                    lines.append("")
                gap = False
                lines.extend(more)

        def walk(n: Node) -> None:
            nonlocal gap
            counter = 0
            if n.tag == "ol":
                try:
                    counter = int(n.attrs.get("start", "1")) - 1
                except ValueError:
                    counter = 0
            for child in n.children:
                if isinstance(child, str):
                    if self.seen:
                        inline.append(html.unescape(child) if "&" in child else child)
                    continue
                tag = child.tag
                state = self.state(child)
                if state == GONE:
                    self.hidden += tag not in NEVER_SHOWN
                    continue
                self.hidden += state == HIDDEN
                seen = self.seen if state is None else state == SHOWN
                if tag == "br":
                    inline.append(BREAK)
                elif tag in ("wbr", "img"):
                    pass
                elif tag == "input":
                    if seen and child.attrs.get("type", "").lower() in WRITTEN:
                        inline.append(" " + child.attrs.get("value", "") + " ")
                elif tag == "select":
                    if seen:
                        inline.append(" " + " ".join(self.chosen(child)) + " ")
                elif tag == "textarea":
                    if seen:
                        inline.append(" " + " ".join(html.unescape(x) for x in child.children if isinstance(x, str)) + " ")
                elif tag not in BLOCK:
                    self.within(child, state, walk)
                else:
                    flush()
                    spaced = tag in SPACED and not (tag in ("ul", "ol") and n.tag == "li")
                    gap |= spaced
                    if tag == "table":
                        add(self.within(child, state, self.table))
                    elif tag == "pre":
                        add(self.within(child, state, self.pre))
                    elif tag == "hr":
                        add(["---"] if seen else [])
                    elif tag == "li":
                        counter += 1
                        mark = f"{counter}. " if n.tag == "ol" else "- "
                        inner = self.within(child, state, self.block)
                        add([(mark if k == 0 else " " * len(mark)) + x if x else "" for k, x in enumerate(inner)] or ([mark.rstrip()] if seen else []))
                    elif tag in ("dd", "blockquote"):
                        add(["  " + x if x else "" for x in self.within(child, state, self.block)])
                    else:
                        add(self.within(child, state, self.block))
                    gap |= spaced

        walk(node)
        flush()
        while lines and not lines[-1]:
            lines.pop()
        return lines

    def pre(self, node: Node) -> list[str]:
        out: list[str] = []
        todo: list[tuple[Node | str, bool]] = [(x, self.seen) for x in reversed(node.children)]
        while todo:
            x, seen = todo.pop()
            if isinstance(x, str):
                if seen:
                    out.append(html.unescape(x))
            elif x.tag == "br":
                out.append("\n")
            elif (state := self.state(x)) != GONE:
                inside = seen if state is None else state == SHOWN
                todo.extend((c, inside) for c in reversed(x.children))
        found = [x.rstrip() for x in "".join(out).replace("\r\n", "\n").strip("\n").split("\n")]
        return found if any(found) else []

    def table(self, node: Node) -> list[str]:
        """Cells stand under each other by column, beside the places that cells of earlier rows take up; a cell over
        several columns counts for its first one only, and a cell of several lines makes a row of several lines."""
        self.tables += 1
        rows: list[list[tuple[int, list[str], int]]] = []
        caption: list[str] = []
        taken: dict[int, int] = {}  # rows that a column is still taken for
        todo: list[tuple[Node, bool]] = [(node, self.seen)]
        before = self.seen
        while todo:
            n, self.seen = todo.pop()
            for child in reversed(n.children):
                if isinstance(child, Node) and child.tag in ("thead", "tbody", "tfoot", "tr", "caption") and (state := self.state(child)) != GONE:
                    todo.append((child, self.seen if state is None else state == SHOWN))
            if n.tag == "caption":
                caption += self.block(n)
            elif n.tag == "tr":
                row, col = [], 0
                for c in n.children:
                    if isinstance(c, Node) and c.tag in _CELLS and (state := self.state(c)) != GONE:
                        over = [min(1000, int(x)) if (x := c.attrs.get(side, "1")).isdecimal() and int(x[:6]) > 0 else 1 for side in ("colspan", "rowspan")]
                        while taken.get(col):
                            col += 1
                        row.append((col, self.within(c, state, self.block), over[0]))
                        for k in range(col, col + over[0]):
                            taken[k] = over[1]
                        col += over[0]
                taken = {k: n - 1 for k, n in taken.items() if n > 1}
                if row:
                    rows.append(row)
            stray = [x for x in n.children if (isinstance(x, str) and x.strip()) or (isinstance(x, Node) and x.tag not in ("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup", "col"))]
            if stray and n.tag not in ("caption",):
                holder = Node("div", {})
                holder.children = stray
                caption += self.block(holder)
        self.seen = before
        widths: dict[int, int] = {}
        for row in rows:
            for col, lines, span in row:
                if span == 1:
                    widths[col] = max(widths.get(col, 0), max((len(x) for x in lines), default=0))
                else:
                    widths.setdefault(col, 0)
        out = list(caption)
        for row in rows:
            for k in range(max(1, max(len(lines) for _, lines, _ in row))):
                parts, at = [], 0
                for col, lines, span in row:
                    parts += [" " * widths.get(c, 0) for c in range(at, col)]
                    width = sum(widths.get(c, 0) for c in range(col, col + span)) + 3 * (span - 1)
                    parts.append((lines[k] if k < len(lines) else "").ljust(width))
                    at = col + span
                out.append(" | ".join(parts).rstrip())
        return out


def extract(page: str | None) -> tuple[str, int, int]:
    """Visible text, number of tables shown, number of hidden elements of one page."""
    if not page:
        return "", 0, 0
    root, styles = parse(page.replace(BREAK, ""))
    renderer = Renderer(visibility_rules(styles))
    depth, level = 0, [root]
    while level:
        depth, level = depth + 1, [c for n in level for c in n.children if isinstance(c, Node)]
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 8 * depth + 1000))  # frames of Python functions live on the heap
    try:
        return renderer.render(root), renderer.tables, renderer.hidden
    finally:
        sys.setrecursionlimit(before)


SCHEMA = "page_id long, text string, n_chars long, n_tables long, n_hidden long"


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Visible text of every page, one row for each row, in a narrow map that shuffles nothing.

    Null or empty pages, and pages that show nothing, give the empty text. Malformed pages never fail: what is
    not a tag is text. Rules of style sheets count where they hold on a wide screen; what ``aria-hidden`` names is seen all
    the same. Form fields show their value (of a select the chosen option), not their hints. n_hidden counts elements that are
    taken out or made invisible. Repeated rows repeat, extra columns are ignored. Memory follows the longest page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.steps(batches, 1):
            found = [extract(x) for x in batch.column(1).to_pylist()]
            texts, tables, hidden = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(tables, pa.int64()), pa.array(hidden, pa.int64())], names=["page_id", "text", "n_chars", "n_tables", "n_hidden"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, SCHEMA)
