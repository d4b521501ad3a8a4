"""Visible text of web pages by layout: a tree builder with implied tags, visibility rules, and a renderer.

The tokenizer finds tags, comments and raw-text elements. The builder keeps a stack of open elements and closes what HTML
lets authors leave out: a paragraph ends where a block starts, list items, definition terms, options, rows and cells end
where the next begins, and an end tag closes what is open inside its element. Elements that browsers do not show (head,
script, style, template, ..., `hidden`, `display:none`, `visibility:hidden`) stand on the same stack, so that implied ends and ancestors' end tags close
them too; what is in them is not rendered. An open head ends at the first tag or word that may not stand in it. Text of
`svg` and `math` is shown, but for their definitions and descriptions.

The renderer emits all visible text: white space collapses outside `pre` and `textarea`; blocks start on a line of their
own, and paragraphs, headings, lists and tables are set off by a blank line; list items have a bullet or their number and
are indented by depth; table cells stand on the grid that their column and row spans make, are padded to their column's width (at
most PAD characters) and joined by " | ".

Defined results: null or empty html gives empty text. Tags that do not end, stray end tags and unknown elements never fail:
what is not a tag is text. Null ids are kept, repeated rows rendered each, other columns ignored. Pages are read whole; the
work is linear in their length.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from phenogrid.llm.common import table

# Fixed values of the HTML standard: kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
HIDDEN = frozenset("head script style template title iframe noembed noframes object audio video canvas datalist meta link".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
#: What may stand in a head.
IN_HEAD = frozenset("html head base basefont bgsound link meta title script noscript noframes style template".split())
#: Content that is not HTML, where HTML stands in it, what of it is not shown, and the tags that end it.
FOREIGN = frozenset("svg math".split())
INTEGRATION = frozenset("foreignobject desc mi mo mn ms mtext annotation-xml".split())
FOREIGN_HIDDEN = frozenset("defs desc metadata symbol clippath mask marker pattern lineargradient radialgradient annotation annotation-xml".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
LISTS = frozenset("ul ol menu dir".split())
#: What a start tag ends if it is open, and the elements beyond which it does not reach.
IMPLIED = {
    "li": (frozenset(["li"]), LISTS),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["td", "th", "tr", "caption", "colgroup"]), frozenset(["table"])),
    "tbody": (frozenset(["td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
}
IMPLIED["thead"] = IMPLIED["tfoot"] = IMPLIED["tbody"]
#: An end tag of an inline element does not close these around it.
SCOPE = frozenset("table td th caption html template".split())
_TEMPLATE = frozenset(["template"])
#: Characters that a cell is padded to, and that a line is aligned to, at most: alignment never outgrows the text by more.
PAD, ALIGN = 60, 400
#: What to undo at the end of an element that is not shown, and of a line of drawn text.
_UNSEEN, _LINE = object(), object()

TAG = re.compile(r"""<(?:!--(?:.*?--!?>|.*\Z)|([a-zA-Z][^\s/><]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|/([a-zA-Z][^\s/><]*+)[^<>]*+>|[!?/][^<>]*+>)""", re.S)
ATTR = re.compile(r"""([^\s=/"'<>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'<>]++)))?+""")
GAP = re.compile(r"[ \t\n\r\f]+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTR.finditer(text):
        out.setdefault(m[1].lower(), unescape(next((x for x in m.groups()[1:] if x is not None), "")))
    return out


def span(value: str | None, most: int, zero: int = 1) -> int:
    """A span attribute: 1 if it is no number; of 0, `zero` (rows: all that follow)."""
    found = re.match(r"\s*(\d{1,9})", value or "1")
    return min(int(found[1]), most) or zero if found else 1


class Table:
    def __init__(self):
        #: cells of each row: text, columns and rows that it spans
        self.rows: list[list[tuple[str, int, int]]] = []

    def lines(self) -> list[str]:
        """Cells placed on the grid as their spans say, each padded to its columns' width; a cell of several lines takes as many rows."""
        placed, hang = [], {}  # hang: first column -> (row and column after the cell)
        for r, row in enumerate(self.rows):
            at, line = 0, []
            for text, columns, rows in row:
                while (over := hang.get(at, (0, 0)))[0] > r:
                    at = over[1]
                line.append((at, at + columns, text.split("\n")))
                if rows > 1:
                    hang[at] = (r + rows, at + columns)
                at += columns
            if line:
                placed.append(line)
        # columns at which a cell starts; others have no width of their own
        starts = sorted({begin for line in placed for begin, _, _ in line})
        number = {c: i for i, c in enumerate(starts)}
        width, wide = [0] * len(starts), []
        for line in placed:
            for begin, end, cell in line:
                i, j, w = number[begin], bisect_left(starts, end), min(max(map(len, cell)), PAD)
                if j - i == 1:
                    width[i] = max(width[i], w)
                elif w > 3 * (j - i - 1):
                    wide.append((j - i, i, w))
        for n, i, w in sorted(wide):  # what a spanning cell lacks, its last column gets
            width[i + n - 1] += max(0, w - sum(width[i : i + n]) - 3 * (n - 1))
        offset, at = [], 0
        for w in width:
            offset.append(at)
            at += w + 3
        out = []
        for line in placed:
            for k in range(max(len(cell) for _, _, cell in line)):
                now = ""
                for begin, _, cell in line:
                    i = number[begin]
                    if i:
                        now = now.ljust(min(offset[i] - 3, ALIGN)) + " | "
                    now += cell[k] if k < len(cell) else ""
                out.append(now.rstrip())
        return out


class Lines:
    """The text that one block flow has so far: of the page, or of a table cell."""

    def __init__(self):
        self.done: list[str] = []
        self.now: list[str] = []
        self.blank = False  # a blank line is due before the next line
        self.space = False  # a space is due before the next word
        self.mark = ""  # the bullet or number of the item that starts
        self.indent = 0

    def text(self, s: str) -> None:
        words = GAP.split(s)
        if len(words) == 1:
            if words[0]:
                self._word(words[0])
            return
        if not words[0]:
            self.space = True
        body = " ".join(w for w in words if w)
        if body:
            self._word(body)
            self.space = not words[-1]

    def _word(self, s: str) -> None:
        if self.space and self.now:
            self.now.append(" ")
        self.space = False
        self.now.append(s)

    def end(self) -> None:
        """End the line, if it has text."""
        if self.now:
            self._put("".join(self.now).rstrip(" "))
            self.now = []
        self.space = False

    def _put(self, line: str) -> None:
        if self.blank and self.done:
            self.done.append("")
        self.blank = False
        pad = "  " * self.indent
        if self.mark:
            pad, self.mark = pad[: -2 or None] + self.mark + " ", ""
        self.done.append(pad + line)

    def block(self, spaced: bool) -> None:
        self.end()
        if spaced:
            self.blank = True

    def whole(self, lines: list[str]) -> None:
        self.end()
        for line in lines:
            self._put(line)

    def result(self) -> str:
        self.end()
        return "\n".join(self.done)


class Renderer:
    def __init__(self):
        self.flow = Lines()
        #: open elements: (name, what to undo at its end)
        self.stack: list[tuple[str, object]] = []
        #: where in the stack each name stands, lowest first: what closes an element finds it, and walls, without a walk
        self.at: dict[str, list[int]] = {}
        self.lists: list[list] = []
        self.tables: list[tuple[Table, Lines]] = []
        self.pre = 0
        self.hidden = 0  # open elements that are not shown
        self.foreign: list[bool] = []  # open svg and math: True; HTML inside them: False

    def _leave_head(self, tag: str) -> None:
        """End an open head at a tag, or at text (""), that may not stand in it."""
        if self.at.get("head") and self.stack[-1][0] in ("head", "noscript") and tag not in IN_HEAD:
            self._close_to("head", _TEMPLATE)

    def start(self, name: str, rest: str) -> bool:
        """A start tag; whether the element is shown."""
        self._leave_head(name)
        if name == "head" and (any(n != "html" for n, _ in self.stack[:2]) or self.flow.done or self.flow.now):
            return not self.hidden  # too late for a head: the tag counts for nothing
        while self.foreign and self.foreign[-1] and name in BREAKOUT:
            while self.stack[-1][0] not in FOREIGN:
                self._pop()
            self._pop()
        if name in CLOSES_P and self.at.get("p"):
            self._close_to("p", SCOPE)
        if name in IMPLIED:
            ends, beyond = IMPLIED[name]
            self._end_any(ends, beyond)
        elif name == "select" and self.at.get("select"):
            self._close_to("select", SCOPE)
        elif name == "a" and self.at.get("a"):
            self._close_to("a", SCOPE)
        foreign = bool(self.foreign) and self.foreign[-1]
        given = attributes(rest) if "=" in rest or "hidden" in rest.lower() else {}
        unseen = self.hidden or name in HIDDEN or "hidden" in given or UNSEEN.search(given.get("style", "")) or foreign and name in FOREIGN_HIDDEN
        if (foreign or name in FOREIGN) and rest.endswith("/"):
            return not unseen
        if unseen:
            if name not in VOID:
                self._push(name, _UNSEEN)
            return False
        flow = self.flow
        if name == "br":
            if flow.now:
                flow.end()
            else:
                flow.blank = True
            return True
        if name in BLOCK:
            flow.block(name in SPACED)
        if name in VOID:
            if name == "hr":
                flow.whole(["---"])
            elif name == "img" and given.get("alt"):
                flow.text(given["alt"])
            elif name == "input" and given.get("type", "text").lower() in ("submit", "button", "reset") and given.get("value"):
                flow.text(given["value"])
            elif name == "wbr":
                pass
            return True
        undo: object = None
        if foreign and name == "text":
            flow.block(False)
            undo = _LINE
        if name in LISTS:
            begin = given.get("start", "1")
            self.lists.append([name == "ol", int(begin) if re.fullmatch(r"-?\d{1,9}", begin) else 1])
            flow.indent += 1
            if len(self.lists) > 1:
                flow.blank = False
        elif name == "li":
            if self.lists:
                ordered, n = self.lists[-1]
                self.lists[-1][1] += 1
                flow.mark = f"{n}." if ordered else "-"
            else:
                flow.mark = "-"
        elif name == "dd" or name == "blockquote":
            flow.indent += 1
        elif name == "pre":
            self.pre += 1
        elif name == "table":
            self.tables.append((Table(), flow))
            undo = self.lists
            self.lists = []
        elif name == "tr" and self.tables:
            self.tables[-1][0].rows.append([])
        elif name in ("td", "th") and self.tables:
            t = self.tables[-1][0]
            if not t.rows:
                t.rows.append([])  # the row's tag is implied
            undo = span(given.get("colspan"), 1000), span(given.get("rowspan"), 65534, 65534)
            self.flow = Lines()
        elif name == "q":
            flow.text('"')
        self._push(name, undo)
        return True

    def _push(self, name: str, undo: object) -> None:
        self.at.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, undo))
        self.hidden += undo is _UNSEEN
        if name in FOREIGN:
            self.foreign.append(True)
        elif self.foreign and name in INTEGRATION:
            self.foreign.append(False)

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", "")
        elif name == "p" and not self.at.get("p"):
            if not self.hidden:
                self.flow.block(True)
        elif self.at.get(name):
            self._close_to(name, frozenset() if name == "template" else _TEMPLATE if name in SCOPE or name in BLOCK or name == "tr" else SCOPE)

    def _wall(self, names: frozenset) -> int:
        """Where the uppermost open element of these names stands, or -1."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def _cut(self, to: int) -> None:
        while len(self.stack) > to:
            self._pop()

    def _end_any(self, names: frozenset, beyond: frozenset) -> None:
        """Close all elements of these names above the uppermost wall."""
        wall = max(self._wall(beyond), self._wall(_TEMPLATE))
        above = [at[bisect_right(at, wall)] for n in names if (at := self.at.get(n)) and at[-1] > wall]
        if above:
            self._cut(min(above))

    def _close_to(self, name: str, wall: frozenset) -> None:
        at = self.at[name][-1] if self.at.get(name) else -1
        if at >= 0 and at >= self._wall(wall):
            self._cut(at)

    def _pop(self) -> None:
        name, undo = self.stack.pop()
        self.at[name].pop()
        if name in FOREIGN or self.foreign and name in INTEGRATION:
            self.foreign.pop()
        if undo is _UNSEEN:
            self.hidden -= 1
            return
        flow = self.flow
        if undo is _LINE:
            flow.block(False)
            return
        if name in ("td", "th") and self.tables:
            self.tables[-1][0].rows[-1].append((flow.result(), *undo))  # type: ignore[misc]
            self.flow = self.tables[-1][1]
            return
        if name == "table":
            t, outer = self.tables.pop()
            self.flow, self.lists = outer, undo  # type: ignore[assignment]
            outer.blank = True
            outer.whole(t.lines())
            outer.blank = True
            return
        if name in BLOCK:
            flow.block(name in SPACED)
        if name in LISTS:
            flow.indent -= 1
            self.lists.pop()
            if self.lists:
                flow.blank = False
        elif name == "li":
            if flow.mark:  # an item without text keeps its mark
                flow.whole([""])
        elif name in ("dd", "blockquote"):
            flow.indent -= 1
        elif name == "pre":
            self.pre -= 1
        elif name == "q":
            flow.text('"')

    def text(self, s: str) -> None:
        if self.hidden and self.at.get("head") and s.strip(" \t\n\r\f"):
            self._leave_head("")
        if self.hidden:
            return
        if "&" in s:
            s = unescape(s)
        if self.pre:
            first, *more = s.replace("\r\n", "\n").split("\n")
            if first:
                self.flow.now.append(first)
            for line in more:
                if self.flow.now:
                    self.flow.end()
                else:
                    self.flow._put("") if self.flow.done else None
                if line:
                    self.flow.now.append(line)
        else:
            self.flow.text(s)

    def result(self) -> str:
        while self.stack:
            self._pop()
        return self.flow.result()


def render(html: str | None) -> str:
    """The visible text of a page."""
    if not html:
        return ""
    r = Renderer()
    at, n = 0, len(html)
    lower: str | None = None
    while at < n:
        m = TAG.search(html, at)
        if m is None:
            r.text(html[at:])
            break
        if m.start() > at:
            r.text(html[at : m.start()])
        at = m.end()
        name = m[1]
        if name is not None:
            name = name.lower()
            rest = m[2]
            if name in RAW:
                if lower is None:
                    lower = html.lower() if len(html.lower()) == n else re.sub("[A-Z]+", lambda x: x[0].lower(), html)
                stop = lower.find("</" + name, at)
                body = html[at : stop if stop >= 0 else n]
                close = html.find(">", stop) if stop >= 0 else -1
                at = close + 1 if close >= 0 else n
                if name in HIDDEN:
                    r._leave_head(name)
                else:
                    if r.start(name, rest):
                        r.flow.text(unescape(body) if name == "textarea" else body)
                    r.end(name)
            else:
                r.start(name, rest)
        elif m[3] is not None:
            r.end(m[3].lower())
    return r.result()


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id and text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([render(x) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    named = pages.select(pages[id_col].alias("id"), pages[html_col].alias("html"))
    return named.mapInArrow(run, f"id {named.schema['id'].dataType.simpleString()}, text string")


def op9_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
