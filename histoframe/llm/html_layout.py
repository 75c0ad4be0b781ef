"""Layout-aware text of web pages.

A tolerant builder turns markup into a tree, written as properly nested open, text and close events: it closes what a new
tag implies closed (paragraphs, list items, table parts, options, the head at what can't stand in it), opens rows that
cells lack, ignores stray end tags and closes the rest at the end. Style sheets hide by their rules for the screen, wherever
they stand. The renderer walks the tree and writes what a reader would see: hidden elements are left out;
blocks start on their own lines with blank lines where browsers put margins; lists have bullets or numbers and nest by
indent; table cells stand in aligned columns; white space collapses except in preformatted text. All visible text is
kept, navigation and footers included. Nothing recurses, so deep nesting is safe.

Time and output grow in proportion to a page, whatever its markup: lines are indented by MOST_INDENT columns at most, a
column is MOST_WIDE wide at most and begins MOST_PLACE columns from its table's edge at most (what is longer reaches beyond
it, two spaces from its neighbours), and the cells of tables inside MOST_NESTED other cells are blocks. No text is cut.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histoframe.llm.encoder import slices

SCHEMA = "page_id long, n_chars long, n_lines long, n_tables long, text string"

#: HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title meta link datalist iframe object svg audio video canvas noembed noframes".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr".split())
BLOCK = SPACED | frozenset("html body div section article header footer nav aside main address form li dt dd figcaption details summary legend caption center menu dir option select tr td th thead tbody tfoot dialog hgroup search".split())
CLOSES_P = BLOCK - frozenset("html body td th tr thead tbody tfoot caption option select legend".split())
#: New tag: (open elements it closes, elements beyond which it doesn't look).
IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "td": (frozenset({"td", "th", "caption"}), frozenset({"table"})),
    "th": (frozenset({"td", "th", "caption"}), frozenset({"table"})),
    "tr": (frozenset({"tr", "td", "th", "caption"}), frozenset({"table"})),
    "thead": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}), frozenset({"table"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}), frozenset({"table"})),
    "tfoot": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}), frozenset({"table"})),
}
#: Tags that leave an open head open.
IN_HEAD = frozenset("head base basefont bgsound link meta title noscript noframes style script template html".split())
SCOPE = frozenset({"table", "td", "th", "caption", "html", "button", "object", "template"})
#: Elements that end tags close across those.
UNSCOPED = frozenset("table tr tbody thead tfoot html body".split())
ROW = frozenset({"tr"})
#: Controls inside a line, set apart from what is beside them.
CONTROLS = frozenset({"button", "textarea"})

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_EDGE = re.compile("[\"'>]")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SHOWING = re.compile(r"(?:^|[;\s])(display|visibility)\s*:\s*([a-z-]+)", re.IGNORECASE)
_WHOLE = re.compile(r"\s*([+-]?)0*(\d+)", re.ASCII)
_CSS_SKIPPED = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.DOTALL)
_CSS = re.compile(r"""[{};]|"(?:[^"\\\n]|\\.)*+"?|'(?:[^'\\\n]|\\.)*+'?""", re.DOTALL)
_AT_RULE = re.compile(r"@([\w-]+)(.*)", re.DOTALL)
_SIMPLE = re.compile(r"[a-zA-Z][\w-]*|[.#][\w-]+")
_SPACE = re.compile(r"[ \t\n\f\r]+")
BLANK = " \t\n\f\r"
#: Columns and rows that a cell may span by the HTML standard.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: Bounds of the layout, in columns of text, and of tables in tables.
MOST_INDENT, MOST_WIDE, MOST_PLACE, MOST_NESTED = 64, 80, 400, 8
#: Media queries that hold on every screen; those with conditions don't hide text.
SCREEN = frozenset({"", "all", "screen", "only all", "only screen", "not print"})


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        found.setdefault(m[1].lower(), unescape(m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""))
    return found


def _whole(text: str | None, default: int, least: int, most: int) -> int:
    """An attribute's whole number within bounds; `default` where it has none."""
    m = _WHOLE.match(text or "")
    if not m:
        return default
    size = int(m[2]) if len(m[2]) < 10 else 10**9
    return max(least, min(most, -size if m[1] == "-" else size))


def _shown(declarations: str) -> dict[str, bool]:
    """Whether style declarations show an element: by property, the last one of each; what only inherits says nothing."""
    found: dict[str, bool] = {}
    for m in _SHOWING.finditer(declarations):
        name, value = m[1].lower(), m[2].lower()
        if value not in ("inherit", "unset", "revert", "revert-layer"):
            found[name] = value != "none" if name == "display" else value not in ("hidden", "collapse")
    return found


class _Markup:
    """The markup of a page from left to right: (start, end, / of an end tag, name or None, attribute source) at a time.

    A tag ends at the first > outside quotes, or where there is none at the first > at all; then it has no meaning, as have
    declarations and comments. Where tags end is found once for the whole page, from its end, so a page of stray quotes or
    brackets takes no longer than any other.
    """

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.edges = [m.start() for m in _EDGE.finditer(html)]
        #: For each quote or >: where a tag ends that meets it outside quotes; -1 where it doesn't.
        self.ends = [-1] * (len(self.edges) + 1)
        later = {'"': -1, "'": -1}
        for k in range(len(self.edges) - 1, -1, -1):
            sign = html[self.edges[k]]
            if sign == ">":
                self.ends[k] = self.edges[k]
            else:
                if later[sign] >= 0:
                    self.ends[k] = self.ends[later[sign] + 1]
                later[sign] = k

    def next(self, at: int) -> tuple[int, int, str, str | None, str] | None:
        html = self.html
        while (start := html.find("<", at)) >= 0:
            if html.startswith("<!--", start):
                stop = html.find("-->", start + 4)
                return start, len(html) if stop < 0 else stop + 3, "", None, ""
            if start > self.last:
                at = start + 1
                continue
            name = _NAME.match(html, start)
            if name:
                stop = self.ends[bisect.bisect_left(self.edges, name.end())]
                if stop >= 0:
                    return start, stop + 1, "/" if html[start + 1] == "/" else "", name[1], html[name.end() : stop]
            if name or html[start + 1] in "!?/":
                return start, html.find(">", start + 1) + 1, "", None, ""
            at = start + 1
        return None


def _on_screen(queries: str) -> bool:
    return any(" ".join(q.lower().split()) in SCREEN for q in queries.split(","))


def screen_rules(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the style rules for every screen: those at the top, in layers and in such media."""
    css, at = _CSS_SKIPPED.sub(" ", css), 0
    blocks: list[tuple[str, str, list[str]]] = []
    for m in _CSS.finditer(css):
        part = css[at : m.start()]
        if m[0] == "{":
            prelude, kind = part.strip(), "skipped"
            if not blocks or blocks[-1][0] == "group":
                rule = _AT_RULE.match(prelude)
                if rule is None:
                    kind = "style"
                elif rule[1].lower() == "layer" or rule[1].lower() == "media" and _on_screen(rule[2]):
                    kind = "group"
            blocks.append((kind, prelude, []))
        elif m[0] == ";":
            if blocks:
                blocks[-1][2].append(part)
        elif m[0] == "}":
            if blocks:
                kind, prelude, declarations = blocks.pop()
                if kind == "style":
                    yield prelude, ";".join([*declarations, part])
        else:
            continue
        at = m.end()


def tree_events(html: str) -> Iterator[tuple[str, str, str]]:
    """The tree as ("open", tag, attribute source), ("text", "", text) and ("close", tag, "") events, properly nested."""
    stack: list[str] = []
    open_at: dict[str, list[int]] = {}  # depths of the open elements of a tag, in rising order

    def close_to(depth: int) -> Iterator[tuple[str, str, str]]:
        while len(stack) > depth:
            tag = stack.pop()
            open_at[tag].pop()
            yield "close", tag, ""

    def opened(tag: str, source: str) -> tuple[str, str, str]:
        open_at.setdefault(tag, []).append(len(stack))
        stack.append(tag)
        return "open", tag, source

    def innermost(tags: frozenset[str]) -> int:
        """The depth of the innermost open element of some tags, or -1."""
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=-1)

    at, end, markup = 0, len(html), _Markup(html)
    head_over = False  # a head can't begin after other tags or text
    while at < end:
        m = markup.next(at)
        stop = m[0] if m else end
        if stop > at:
            text = unescape(html[at:stop])
            if text.strip(BLANK):
                head_over = True
                if stack and stack[-1] == "head":
                    yield from close_to(len(stack) - 1)
            yield "text", "", text
        if m is None:
            break
        _, at, ending, name, source = m
        if name is None:
            continue
        tag = name.lower()
        if stack and stack[-1] == "head" and (tag == "br" if ending else tag not in IN_HEAD):
            yield from close_to(len(stack) - 1)
        if ending:
            if tag == "br":
                yield from (("open", "br", ""), ("close", "br", ""))
            elif tag == "p" and not open_at.get("p"):
                yield from (("open", "p", ""), ("close", "p", ""))
            elif open_at.get(tag):
                depth = open_at[tag][-1]
                if tag in UNSCOPED or innermost(SCOPE) <= depth:
                    yield from close_to(depth)
            continue
        if tag == "head" and head_over:
            continue
        head_over = head_over or tag != "html"
        if tag in CLOSES_P and open_at.get("p") and innermost(SCOPE) < open_at["p"][-1]:
            yield from close_to(open_at["p"][-1])
        if tag in IMPLIED:
            closing, limits = IMPLIED[tag]
            limit = innermost(limits)
            if tag in ("li", "dt", "dd", "option"):
                found = [innermost(closing)]
            else:  # the outermost one inside the limit
                found = [x[bisect.bisect_right(x, limit)] for t in closing if (x := open_at.get(t)) and x[-1] > limit]
            if found and min(found) > limit:
                yield from close_to(min(found))
        if tag in ("td", "th") and open_at.get("table") and innermost(ROW) < open_at["table"][-1]:
            yield opened("tr", "")
        if tag in VOID:
            yield from (("open", tag, source), ("close", tag, ""))
            continue
        yield opened(tag, source)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*+>", re.IGNORECASE).search(html, at) if markup.last >= at else None
            inner = html[at : stop.start() if stop else end]
            yield "text", "", unescape(inner) if tag in ("title", "textarea") else inner
            at = stop.end() if stop else end
            yield from close_to(len(stack) - 1)
    yield from close_to(0)


class _Canvas:
    """Lines that are finished, the line that is written, and the blank lines due before the next."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.margin = 0
        self.indents: list[int] = []  # widths of the leads before each step in
        self.lead = ""
        self.bullet = ""

    def step_in(self, lead: str) -> None:
        self.indents.append(len(self.lead))
        if len(self.lead) + len(lead) <= MOST_INDENT:
            self.lead += lead

    def step_out(self) -> None:
        if self.indents:
            self.lead = self.lead[: self.indents.pop()]

    def write(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if text[:1] == " " and (not self.line or self.line[-1][-1:] in (" ", "\n")):
            text = text[1:]
        if text:
            self.line.append(text)

    def flush(self) -> None:
        content = "".join(self.line).rstrip(" ")
        self.line = []
        if content:
            self.put([content])

    def put(self, rows: list[str]) -> None:
        if self.margin and self.lines:
            self.lines += [""] * self.margin
        self.margin = 0
        for row in rows:
            if self.bullet:
                self.lines.append((self.lead[: -len(self.bullet)] + self.bullet + row).rstrip(" "))
                self.bullet = ""
            else:
                self.lines.append((self.lead + row).rstrip(" "))

    def space(self, blank: int) -> None:
        self.flush()
        self.margin = max(self.margin, blank)


def _aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table: the cells of a column start in the same place, two spaces apart; columns that a cell spans, and
    those that a cell of a row above reaches down to, stay empty."""
    furthest = MOST_PLACE // 2  # columns from there on all begin at MOST_PLACE
    widths = [0] * (furthest + 1)
    taken = [0] * (furthest + 1)  # for each column, the row from which it is free again
    placed: list[list[tuple[int, list[str]]]] = []
    for at, row in enumerate(rows):
        column, cells = 0, []
        for lines, span, depth in row:
            while column < furthest and taken[column] > at:
                column += 1
            if span == 1 and column < furthest:
                widths[column] = min(MOST_WIDE, max([widths[column], *map(len, lines)]))
            cells.append((column, lines))
            stop = min(column + span, furthest)
            if depth > 1:
                taken[column:stop] = [at + depth] * (stop - column)
            column = stop
        placed.append(cells)
    starts = [0]
    for width in widths:
        starts.append(min(starts[-1] + width + 2, MOST_PLACE))
    out = []
    for cells in placed:
        for k in range(max([1, *(len(lines) for _, lines in cells)]) if cells else 0):
            text = ""
            for column, lines in cells:
                place = starts[column]
                text = text.ljust(place) if not text or len(text) + 2 <= place else text + "  "
                text += lines[k] if k < len(lines) else ""
            out.append(text.rstrip())
    return out


def _style_rules(events: list[tuple[str, str, str]]) -> dict[str, dict[str, bool]]:
    """What the page's style sheets show or hide on screen, wherever in the page they stand: by simple selector."""
    rules: dict[str, dict[str, bool]] = {}
    in_style, unscripted = False, 0
    for kind, tag, value in events:
        if kind == "text":
            for selectors, declarations in screen_rules(value) if in_style else ():
                if shown := _shown(declarations):
                    for s in map(str.strip, selectors.split(",")):
                        if _SIMPLE.fullmatch(s):
                            rules.setdefault(s.lower(), {}).update(shown)
            continue
        unscripted += (tag in ("noscript", "template")) * (1 if kind == "open" else -1)
        in_style = kind == "open" and tag == "style" and not unscripted and _on_screen(_attributes(value).get("media", ""))
    return rules


def render(html: str | None) -> tuple[str, int]:
    """The visible text of a page and its number of tables; null and empty pages give an empty text.

    What isn't displayed goes with all it holds; visibility is inherited, and a descendant can take it back. An element's own
    style comes before the sheets', where an id comes before classes, these before tags, and later rules before earlier.
    """
    canvas, outer, tables, lists = _Canvas(), [], [], []  # tables: rows, in a cell, the cell's span
    hidden_depth, depth, preformatted, n_tables = 0, 0, 0, 0
    events = list(tree_events(html or ""))
    rules = _style_rules(events)
    visible = [True]  # of the open elements that are displayed
    fresh = False  # right behind <pre>, where a line break doesn't count
    for kind, tag, value in events:
        if kind == "text":
            if not hidden_depth and visible[-1]:
                if preformatted:
                    if fresh and value[:1] == "\n":
                        value = value[1:]
                    fresh = False
                    first, *rest = value.expandtabs().split("\n")
                    canvas.line.append(first)
                    for row in rest:
                        content = "".join(canvas.line)
                        canvas.line = [row]
                        canvas.put([content])
                else:
                    canvas.write(value)
            continue
        fresh = False
        if kind == "open":
            depth += 1
            if hidden_depth:
                continue
            a = _attributes(value) if value.strip(" /") and tag not in HIDDEN else {}
            shown: dict[str, bool] = {}
            if rules:
                for selector in (tag, *("." + c for c in a.get("class", "").lower().split()), "#" + a.get("id", "").lower()):
                    shown |= rules.get(selector, {})
            if "hidden" in a and "display" not in shown:
                shown["display"] = False
            if "style" in a:
                shown |= _shown(a["style"])
            hide = tag in HIDDEN or (tag == "input" and a.get("type", "").lower() == "hidden") or (tag == "dialog" and "open" not in a)
            if hide or not shown.get("display", True):
                hidden_depth = depth
                continue
            visible.append(shown.get("visibility", visible[-1]))
            if tag == "br":
                if canvas.line:
                    canvas.flush()
                else:
                    canvas.margin = max(canvas.margin, 1)
            elif tag == "hr":
                canvas.space(0)
                if visible[-1]:
                    canvas.put(["---"])
            elif tag in ("td", "th") and tables and len(outer) < MOST_NESTED:
                outer.append((canvas, preformatted, lists))
                tables[-1][2] = [_whole(a.get("colspan"), 1, 1, MOST_COLUMNS), _whole(a.get("rowspan"), 1, 0, MOST_ROWS) or MOST_ROWS]
                canvas, preformatted, lists = _Canvas(), 0, []
                tables[-1][1] = True
            elif tag == "table":
                canvas.space(1)
                tables.append([[], False, [1, 1]])
                n_tables += visible[-1]
            elif tag == "tr" and tables:
                tables[-1][0].append([])
            elif tag in BLOCK:
                nested = tag in ("ul", "ol") and lists
                canvas.space(1 if tag in SPACED and not nested else 0)
                if tag in ("ul", "ol", "menu", "dir"):
                    lists.append([tag == "ol", _whole(a.get("start"), 1, -(10**9), 10**9)])
                    canvas.step_in("  ")
                elif tag == "li":
                    bullet = "* "
                    if lists and lists[-1][0]:
                        number = _whole(a.get("value"), lists[-1][1], -(10**9), 10**9)
                        bullet = f"{number}. "
                        lists[-1][1] = number + 1
                    canvas.step_in(" " * len(bullet))
                    canvas.bullet = bullet if visible[-1] else ""
                elif tag == "dd":
                    canvas.step_in("    ")
                elif tag == "blockquote":
                    canvas.step_in("> ")
                elif tag == "pre":
                    preformatted, fresh = preformatted + 1, True
            elif tag in CONTROLS:
                canvas.write(" ")
            continue
        if hidden_depth:
            if depth == hidden_depth:
                hidden_depth = 0
            depth -= 1
            continue
        depth -= 1
        visible.pop()
        if tag in ("td", "th") and tables and outer and tables[-1][1]:
            canvas.flush()
            cell = canvas.lines
            canvas, preformatted, lists = outer.pop()
            rows = tables[-1][0]
            if not rows:
                rows.append([])
            rows[-1].append((cell, *tables[-1][2]))
            tables[-1][1] = False
        elif tag == "table" and tables:
            rows = tables.pop()[0]
            canvas.space(1)
            lines = _aligned(rows)
            if any(lines):
                canvas.put(lines)
            canvas.space(1)
        elif tag in BLOCK and tag != "tr":
            nested = tag in ("ul", "ol") and len(lists) > 1
            if tag == "pre" and canvas.line:
                content = "".join(canvas.line).rstrip()
                canvas.line = []
                if content:
                    canvas.put([content])
            canvas.space(1 if tag in SPACED and not nested else 0)
            if tag in ("ul", "ol", "menu", "dir") and lists:
                lists.pop()
                canvas.step_out()
            elif tag == "li":
                canvas.step_out()
                canvas.bullet = ""
            elif tag in ("dd", "blockquote"):
                canvas.step_out()
            elif tag == "pre":
                preformatted = max(0, preformatted - 1)
        elif tag in CONTROLS:
            canvas.write(" ")
    while outer:
        canvas.flush()
        rest = canvas.lines
        canvas, _, _ = outer.pop()
        canvas.space(0)
        if rest:
            canvas.put(rest)
    canvas.flush()
    return "\n".join(canvas.lines), n_tables


def extract_text(pages: DataFrame) -> DataFrame:
    """One row a page: its rendered text with counts. Null pages give an empty text; repeated rows and null ids stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in slices(batch.column(1).to_pylist()):
                found = [render(x) for x in some]
                yield pa.RecordBatch.from_pydict(
                    {
                        "page_id": batch.column(0).slice(at, len(some)),
                        "n_chars": pa.array([len(t) for t, _ in found], pa.int64()),
                        "n_lines": pa.array([t.count("\n") + bool(t) for t, _ in found], pa.int64()),
                        "n_tables": pa.array([n for _, n in found], pa.int64()),
                        "text": pa.array([t for t, _ in found], pa.string()),
                    }
                )
                at += len(some)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, SCHEMA)
