"""Operator 5: HTML extraction by layout-aware rendering.

A page is read once from left to right into tags and text. A tree builder adds the end tags that HTML lets authors leave out, and closes what an end tag encloses.
Rendering walks the tree: what isn't displayed (by element, hidden attribute or inline style) is left out, while what is only kept from screen readers, text areas
and all options of a select are displayed, and so is a visible part of an element of hidden visibility; all other text is emitted, with white space collapsed as
browsers do; blocks stand on lines of their own, paragraphs and headings a blank line apart; list items have a mark or number and are indented below it; table cells,
of several lines, columns or rows too, are padded to their columns' width.

No markup raises an error: as in browsers, comments and declarations that never end, and tags that never end, take the rest of the page; any other < is text. The work is in
proportion to the page, but for indentation, which grows with the depth of lists, so n lists within each other give text of size n * n, and for tables within each other.

Nulls: null or empty html gives the empty text. Rows are independent; repeated rows give repeated results; an empty table gives an empty one; there are no ties;
columns besides the named ones are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Generator, Iterator
from html import unescape
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard: elements without content, elements that aren't displayed, blocks, and blocks with a blank line around them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style template noscript iframe object svg canvas audio video datalist meta link base".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form header hgroup html legend li main menu nav ol section summary table tr ul caption thead tbody tfoot".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote ul ol table hr dl".split())
# Parts of forms that stand on lines of their own without closing a paragraph.
FIELDS = frozenset("select option optgroup textarea".split())
# What an opening tag closes, up to the element that bounds the search.
CLOSES = {
    **dict.fromkeys(BLOCKS | APART - {"html", "body"}, ({"p"}, {"button", "td", "th", "table", "li", "div"})),
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p", "caption"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot", "tr", "td", "th", "p", "caption"}, {"table"})),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head", "title"}, set()),
}
# What may stand in head; anything else, text included, ends it.
IN_HEAD = frozenset("title meta link base script style template noscript noframes".split())
# Elements whose content holds no tags, without and with character references.
RAW, ESCAPED = frozenset("script style xmp iframe noembed noframes".split()), frozenset("textarea title".split())
SPACE = " \t\r\n\f"
NAME = re.compile(r"[^\s/>]+")
#: An attribute of a tag: name and value. The first character of a name may be =.
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
#: A value whose quotation mark never closes.
OPEN_VALUE = re.compile(r"""\s*=\s*["']""")
END_OF_TAG = re.compile(r"[\s/]*>")
CONTENT_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW | ESCAPED}
DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children", "shown", "visible")

    def __init__(self, tag: str, attributes: dict[str, str], visible: bool = True):
        """shown: takes part in the layout; visible: so does its text, unless an element within says otherwise."""
        self.tag, self.attributes = tag, attributes
        self.children: list[Node | str] = []
        style = {k.lower(): v.lower() for k, v in DECLARATION.findall(attributes["style"])} if "style" in attributes else {}
        self.shown = tag not in UNSEEN and "hidden" not in attributes and style.get("display") != "none"
        how = style.get("visibility")
        self.visible = how == "visible" or (visible and how not in ("hidden", "collapse"))


class Tree:
    """The tree of a page. where: for each tag the positions of its open elements, so that none is searched for."""

    def __init__(self, html: str):
        self.root = Node("html", {})
        self.open = [self.root]
        self.where: dict[str, list[int]] = {}
        at = 0
        while at < len(html):
            at = self.read(html, at)

    def read(self, html: str, at: int) -> int:
        """Takes in what begins at a position, and gives the position behind it."""
        end = len(html)
        if html[at] != "<":
            then = html.find("<", at)
            then = end if then < 0 else then
            self.text(unescape(html[at:then]))
            return then
        if html.startswith("<!--", at):
            then = html.find("-->", at + 2)  # <!--> is a comment, too
            return end if then < 0 else then + 3
        closing = html.startswith("</", at)
        start = at + 1 + closing
        if html[start : start + 1].isascii() and html[start : start + 1].isalpha():
            return self.tag(html, start, closing)
        if closing and start < end or html.startswith(("<!", "<?"), at):
            then = html.find(">", start)
            return end if then < 0 else then + 1
        self.text("<")
        return at + 1

    def tag(self, html: str, at: int, closing: bool) -> int:
        name = NAME.match(html, at)
        tag, at, attributes = name[0].lower(), name.end(), {}
        while not (done := END_OF_TAG.match(html, at)):
            found = ATTRIBUTE.match(html, at)
            if not found or OPEN_VALUE.match(html, found.end()):
                return len(html)
            attributes.setdefault(found[1].lower(), unescape(found[2] or found[3] or found[4] or ""))
            at = found.end()
        at = done.end()
        if closing:
            self.handle_endtag(tag)
            return at
        self.handle_starttag(tag, attributes)
        if tag in CONTENT_ENDS:
            stop = CONTENT_ENDS[tag].search(html, at)
            then = stop.start() if stop else len(html)
            self.text(html[at:then] if tag in RAW else unescape(html[at:then]))
            at = then
        return at

    def cut(self, k: int) -> None:
        """Closes the open elements from position k on."""
        for node in self.open[k:]:
            self.where[node.tag].pop()
        del self.open[k:]

    def handle_starttag(self, tag: str, attributes: dict[str, str]) -> None:
        if tag == "html":
            return
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self.cut(len(self.open) - 1)
        closed, bounds = CLOSES.get(tag, ((), ()))
        bound = max((w[-1] for t in bounds if (w := self.where.get(t))), default=0)
        self.cut(min((w[bisect_right(w, bound)] for t in closed if (w := self.where.get(t)) and w[-1] > bound), default=len(self.open)))
        if tag == "body" and self.open[-1].tag != "html":
            self.cut(1)
        node = Node(tag, attributes, self.open[-1].visible)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.where.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if at := self.where.get(tag):
            if tag in BLOCKS or all(w[-1] <= at[-1] for t in ("td", "th", "table") if (w := self.where.get(t))):
                self.cut(at[-1])

    def text(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip(SPACE):
            self.cut(len(self.open) - 1)
        if self.open[-1].visible:
            self.open[-1].children.append(data)


#: A finished line: text, or a prefix and the line that it stands before.
Line = str | tuple


def plain(line: Line) -> str:
    parts = []
    while isinstance(line, tuple):
        parts.append(line[0])
        line = line[1]
    return "".join(parts) + line


class Lines:
    """Lines of text under construction. glue: a space is due before the next word; gap: blank lines due before the next line."""

    def __init__(self) -> None:
        self.done: list[Line] = []
        self.now, self.glue, self.gap = "", False, 0

    def text(self, data: str) -> None:
        for k, word in enumerate(re.split(r"[ \t\r\n\f]+", data)):
            self.glue |= k > 0
            if word:
                self.now += (" " if self.glue and self.now and self.now[-1] != " " else "") + word
                self.glue = False

    def end(self, blank: int = 0) -> None:
        if self.now:
            self.done += [""] * (self.gap if self.done else 0) + [self.now.rstrip()]
            self.gap = 0
        self.now, self.glue, self.gap = "", False, max(self.gap, blank)

    def take(self, lines: list[Line], first: str = "", then: str = "") -> None:
        """Finished lines of a part, with a prefix for the first and for the others."""
        self.end()
        for k, line in enumerate(lines):
            if line:
                prefix = first if k == 0 else then
                self.done += [""] * (self.gap if self.done else 0) + [(prefix, line) if prefix else line]
                self.gap = 0
            else:
                self.gap = max(self.gap, 1)


#: Yields parts that are to be rendered and is sent their lines.
Rendering = Generator["Rendering", list[Line], list[Line]]


def run(job: Rendering) -> list[Line]:
    """The lines of a part. Parts within parts are a list here, not recursion, so depth has no bound."""
    jobs, lines = [job], None
    while jobs:
        try:
            jobs.append(jobs[-1].send(lines))
            lines = None
        except StopIteration as end:
            jobs.pop()
            lines = end.value
    return lines


def span(cell: Node, name: str) -> int:
    """How many columns or rows a cell takes, 1000 at most, as in browsers."""
    digits = re.match(r"\s*([0-9]{1,9})", cell.attributes.get(name) or "")
    return min(max(int(digits[1]), 1), 1000) if digits else 1


def aligned(rows: list[list[tuple[Node, list[Line]]]]) -> list[Line]:
    """The lines of a table's rows of cells."""
    if [len(r) for r in rows if r] == [1]:
        return [line for r in rows for _, lines in r for line in lines]
    taken: list[tuple[int, int, int]] = []  # first column, column behind, last row of cells of several rows
    placed: list[list[tuple[int, int, list[str]]]] = []
    for k, row in enumerate(rows):
        taken, at, here = [x for x in taken if x[2] >= k], 0, []
        busy = sorted(taken)
        for cell, lines in row:
            wide, high = span(cell, "colspan"), span(cell, "rowspan")
            while busy and busy[0][0] < at + wide:
                at = max(at, busy.pop(0)[1])
            here.append((at, at + wide, [plain(x) for x in lines if x]))
            if high > 1:
                taken.append((at, at + wide, k + high - 1))
            at += wide
        placed.append(here)
    # Columns are the places where cells begin, so that wide cells cost nothing.
    starts = sorted({a for row in placed for a, _, _ in row})
    widths = [0] * len(starts)
    cells = [[(bisect_left(starts, a), bisect_left(starts, b), lines) for a, b, lines in row] for row in placed]
    for row in cells:
        for a, b, lines in row:
            if b == a + 1:
                widths[a] = max([widths[a], *map(len, lines)])
    upto, more = [0, *accumulate(w + 2 for w in widths)], [0] * len(widths)
    for row in cells:
        for a, b, lines in row:
            if b > a + 1:
                more[b - 1] = max([more[b - 1], *(len(x) - (upto[b] - upto[a] - 2) for x in lines)])
    upto = [0, *accumulate(w + m + 2 for w, m in zip(widths, more, strict=True))]
    out: list[Line] = []
    for row in cells:
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            parts, length = [], 0
            for a, _, lines in row:
                if k < len(lines):
                    parts += [" " * (upto[a] - length), lines[k]]
                    length = max(length, upto[a]) + len(lines[k])
            out.append("".join(parts).rstrip())
    return [x for x in out if x]


def table_lines(table: Node) -> Rendering:
    rows: list[list[tuple[Node, list[Line]]]] = []
    out = Lines()
    stack = [iter(table.children)]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
        elif isinstance(child, str):
            out.text(child)
        elif not child.shown:
            continue
        elif child.tag == "tr":
            rows.append(row := [])
            for c in child.children:
                if isinstance(c, str):
                    out.text(c)
                elif c.shown and c.tag in ("td", "th"):
                    row.append((c, (yield rendered(c))))
                elif c.shown:
                    out.take((yield rendered(c)))
        elif child.tag in ("thead", "tbody", "tfoot", "colgroup"):
            stack.append(iter(child.children))
        else:
            out.end()
            out.take((yield rendered(child)))
    out.end()
    return out.done + aligned(rows)


def rendered(node: Node) -> Rendering:
    """The lines of an element."""
    out = Lines()
    # Open elements: tag, children to come, whether preformatted, list items so far, blank lines after it (None: no block).
    stack: list[list] = [[node.tag, iter(node.children), node.tag == "textarea", 0, None]]
    while stack:
        parent = stack[-1]
        child, pre = next(parent[1], None), parent[2]
        if child is None:
            stack.pop()
            if parent[4] is not None:
                out.end(parent[4])
            continue
        if isinstance(child, str):
            if pre:
                for k, line in enumerate(child.split("\n")):
                    if k:
                        out.end()
                    out.now += line
            else:
                out.text(child)
            continue
        if not child.shown:
            continue
        tag, blank = child.tag, int(child.tag in APART)
        if tag == "br":
            out.end()
        elif tag == "img":
            out.text(f" {child.attributes.get('alt') or ''} " if child.visible else " ")
        elif tag in ("table", "li", "blockquote"):
            out.end(blank)
            if tag == "table":
                out.take((yield table_lines(child)))
            elif tag == "li":
                parent[3] += 1
                mark = f"{parent[3]}. " if parent[0] == "ol" else "- "
                out.take((yield rendered(child)), mark, " " * len(mark))
            else:
                out.take((yield rendered(child)), "> ", "> ")
            out.end(blank)
        elif tag in BLOCKS or tag in APART or tag in FIELDS:
            out.end(blank)
            stack.append([tag, iter(child.children), pre or tag in ("pre", "textarea"), 0, blank])
        else:
            if tag in ("td", "th"):
                out.glue = True
            stack.append([tag, iter(child.children), pre, 0, None])
    out.end()
    return out.done


def visible_text(html: str | None) -> str:
    return "\n".join(map(plain, run(rendered(Tree(html).root)))) if html else ""


def extract(pages: DataFrame, id_column: str = "page_id") -> DataFrame:
    """page_id and text of each page."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({id_column: f[id_column], "text": f["html"].map(visible_text, na_action=None)})

    return pages.select(F.col(id_column).cast("long"), "html").mapInPandas(task, f"{id_column} long, text string")
