"""Visible text of HTML pages, laid out as a reader would see it.

A tokenizer feeds a tree builder that supplies the tags authors leave out and closes the ones they
forget. Elements are rendered as they close: hidden subtrees give nothing, blocks stand on lines of
their own with blank lines where browsers put margins, list items carry bullets or numbers, and the
cells of a table are aligned in columns. Pages are independent, so one pass over the rows does it.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"[ \t\n\r\f]+")
LOOKS_HIDDEN = re.compile(r"hidden|display|visibility", re.I)

# Fixed values of the HTML standard: kinds of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr basefont bgsound frame keygen".split())
RAW = set("script style xmp iframe noembed noframes".split())
RCDATA = {"title", "textarea"}
NEVER_SHOWN = set(
    "head script style template noscript iframe noembed noframes title datalist object audio video canvas".split()
)
#: Of drawings and formulas, what is described but not drawn.
UNDRAWN = {"svg": set("desc defs metadata symbol clippath mask pattern marker".split()),
           "math": {"annotation", "annotation-xml"}}
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote figure table menu fieldset hr".split())
BLOCKS = SPACED | set(
    "html body address article aside center details dialog dd dir div dt figcaption footer form header hgroup legend"
    " li main nav search section summary option optgroup caption tr thead tbody tfoot td th".split()
)
ENDS_P = (BLOCKS - {"html", "body", "option", "optgroup", "legend", "caption", "tr", "thead", "tbody", "tfoot",
                    "td", "th"}) | {"table"}
IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
#: A start tag closes these, up to the nearest of the elements that hold it.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
#: Closing tags look no further up than this.
SCOPES = {"table", "td", "th", "caption", "html"}
#: Cells are padded to their column's width, but no further than this, as each row pays for the widest.
WIDEST_PADDING = 80
#: Tables inside this many others are laid out as plain blocks, as each level lays out its text again.
DEEPEST_TABLE = 32
#: Columns and rows that a cell may span, as in the standard.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
SIMPLE = re.compile(r"(\*|[a-z][a-z0-9-]*)?((?:[.#][a-z_-][a-z0-9_-]*)*)", re.I)


class Flow:
    """Lines of one block of text: the page's, or a table cell's."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = self.spaced = False
        self.indent, self.marker = 0, ""

    def text(self, text: str) -> None:
        if "\n" in text or "  " in text or "\t" in text or "\r" in text or "\f" in text:
            text = SPACE.sub(" ", text)
        if text[:1] == " ":
            if not self.line or self.spaced:
                text = text[1:]
        if text:
            self.line.append(text)
            self.spaced = text[-1] == " "

    def end_line(self, gap: bool = False) -> None:
        if self.line:
            line = "".join(self.line).rstrip(" ")
            if line:
                self.put(line)
            self.line, self.spaced = [], False
        self.gap |= gap

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append("  " * max(0, self.indent - 1) + (self.marker or "  " * (self.indent > 0)) + line)
        self.marker = ""

    def verbatim(self, text: str) -> None:
        first, *rest = text.split("\n")
        if first:
            self.line.append(first)
        for line in rest:
            whole = "".join(self.line)
            self.line = [line] if line else []
            self.put(whole.rstrip("\r"))
        self.spaced = False


class Cell:
    __slots__ = ("column", "lines", "rows", "span")

    def __init__(self, lines: list[str], span: int, rows: int):
        self.lines, self.span, self.rows, self.column = lines, span, rows, 0


class Table:
    """Rows of cells; a cell is its lines and the columns and rows it spans."""

    def __init__(self) -> None:
        self.rows: list[list[Cell]] = []
        self.caption: list[str] = []

    def place(self) -> None:
        """Give each cell the first column that no cell from above takes."""
        taken: dict[int, int] = {}  # column to the first row that is free again
        for number, row in enumerate(self.rows):
            column = 0
            for cell in row:
                while taken.get(column, 0) > number:
                    column += 1
                cell.column = column
                if cell.rows > 1:
                    for c in range(column, column + cell.span):
                        taken[c] = number + cell.rows
                column += cell.span

    def lines(self) -> Iterator[str]:
        yield from self.caption
        self.place()
        widths: dict[int, int] = {}
        for row in self.rows:
            for cell in row:
                if cell.span == 1 and cell.lines:
                    widths[cell.column] = max(widths.get(cell.column, 0), min(WIDEST_PADDING, max(map(len, cell.lines))))
        columns = sorted(widths)
        starts, at = {}, 0
        for column in columns:
            starts[column] = at
            at += widths[column] + 2
        # A column that no cell has for itself begins where the next one that has text does.
        begin = lambda column: starts[columns[i]] if (i := bisect.bisect_left(columns, column)) < len(columns) else at
        above: list[tuple[int, Cell, int]] = []  # lines of cells that go on: last row, cell, lines given
        for number, row in enumerate(self.rows):
            cells = [(number + cell.rows - 1, cell, 0) for cell in row] + above
            last = number == len(self.rows) - 1
            # Cells that end here are given whole, others as far as the row goes.
            height = max((len(c.lines) - given for end, c, given in cells if end <= number or last), default=0)
            cells.sort(key=lambda x: x[1].column)
            for i in range(height):
                out = ""
                for _, cell, given in cells:
                    text = cell.lines[given + i] if given + i < len(cell.lines) else ""
                    if text:
                        out = out.ljust(begin(cell.column)) + ("  " if len(out) > begin(cell.column) else "") + text
                yield out.rstrip()
            above = [(end, c, given + height) for end, c, given in cells if end > number and given + height < len(c.lines)]


class Element:
    __slots__ = ("hides", "number", "pre", "put", "shown", "tag")

    def __init__(self, tag: str, shown: bool, hides: bool, pre: bool):
        self.tag, self.shown, self.hides, self.pre = tag, shown, hides, pre
        self.number: int | None = None
        self.put = None


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def spanned(text: str, most: int) -> int:
    return min(most, max(1, int(text))) if re.fullmatch(r"[0-9]{1,9}", text.strip()) else 1


class Rules:
    """Rules of style elements that hide or show by tag, class or id; others are left out."""

    def __init__(self) -> None:
        self.known: list[tuple[tuple[int, int, int], int, str, frozenset[str], frozenset[str], dict[str, str]]] = []

    def read(self, text: str) -> None:
        text = re.sub(r"/\*.*?(?:\*/|\Z)", " ", text, flags=re.S)
        for selectors, body in RULE.findall(without_at_rules(text)):
            said = {}
            for part in body.lower().split(";"):
                name, _, value = part.partition(":")
                if name.strip() in ("display", "visibility"):
                    said[name.strip()] = value.replace("!important", "").strip()
            for selector in selectors.split(",") if said else ():
                if (m := SIMPLE.fullmatch(selector.strip())) and m[0]:
                    names = re.findall(r"[.#][^.#]+", m[2])
                    ids = frozenset(n[1:] for n in names if n[0] == "#")
                    classes = frozenset(n[1:] for n in names if n[0] == ".")
                    tag = "" if m[1] in (None, "*") else m[1].lower()
                    self.known.append(((len(ids), len(classes), bool(tag)), len(self.known), tag, classes, ids, said))

    def of(self, tag: str, given: dict[str, str]) -> dict[str, str]:
        """What the rules say of an element; the most specific and then the last one counts."""
        classes, ids = set(given.get("class", "").split()), {given.get("id", "")}
        met = [r for r in self.known if r[2] in ("", tag) and r[3] <= classes and r[4] <= ids]
        return {name: value for r in sorted(met, key=lambda r: r[:2]) for name, value in r[5].items()}


def without_at_rules(text: str) -> str:
    """A style sheet without rules that begin with an at sign, and what is nested in them."""
    out, at = [], 0
    while (start := text.find("@", at)) >= 0:
        out.append(text[at:start])
        stop = re.compile(r"[;{]|\Z").search(text, start).start()
        depth = int(text[stop : stop + 1] == "{")
        at = stop + 1
        while depth and at < len(text):
            depth += {"{": 1, "}": -1}.get(text[at], 0)
            at += 1
    return "".join(out) + text[at:]


class Page:
    """Tree builder and renderer; only the open elements are kept."""

    def __init__(self) -> None:
        self.open: list[Element] = []
        self.counts: Counter[str] = Counter()  # of open elements, so that deep pages aren't searched in vain
        self.flows, self.tables = [Flow()], []
        self.title: str | None = None
        self.lists = 0
        self.rules = Rules()

    # Tree building

    def start(self, tag: str, attrs: str) -> None:
        open_ = self.open
        if tag in ("html", "head", "body"):
            if tag == "body":
                self.leave_head()
            if any(e.tag == tag for e in open_[:3]):
                return
        elif open_ and open_[-1].tag == "head" and tag not in IN_HEAD:
            self.leave_head()
        if tag in ENDS_P:
            self.close_within({"p"}, SCOPES | {"button"})
        if tag in IMPLIED_ENDS:
            ends, within = IMPLIED_ENDS[tag]
            self.close_within(ends, within)
        if tag in ("td", "th") and self.inside("table") and not self.inside("tr", {"table"}):
            self.start("tr", "")
        if tag[0] == "h" and tag in ("h1", "h2", "h3", "h4", "h5", "h6") and open_ and open_[-1].tag[0] == "h" \
                and open_[-1].tag[1:].isdigit():
            self.end_top()
        self.push(tag, attrs)
        if tag in VOID:
            self.end_top()

    def leave_head(self) -> None:
        while self.counts["head"]:
            self.end_top()

    def inside(self, tag: str, stop: set[str] = frozenset()) -> bool:
        if not self.counts[tag]:
            return False
        for e in reversed(self.open):
            if e.tag == tag:
                return True
            if e.tag in stop:
                return False
        return False

    def close_within(self, tags: set[str], stop: set[str]) -> None:
        """Close the outermost open element of ``tags`` that no element of ``stop`` encloses."""
        last = None
        if not any(self.counts[tag] for tag in tags):
            return
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.open[depth].tag
            if tag in tags:
                last = depth
            elif tag in stop:
                break
        while last is not None and len(self.open) > last:
            self.end_top()

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        elif tag == "p" and not self.inside("p", SCOPES):
            self.start("p", "")
            self.end_top()
        elif tag not in ("html", "body"):
            stop = SCOPES - {tag}
            if tag in ("table", "tr", "thead", "tbody", "tfoot"):
                stop = {"html"} if tag == "table" else {"table"}
            if tag in ("td", "th", "caption"):
                stop = {"table"}
            if self.inside(tag, stop):
                while self.open[-1].tag != tag:
                    self.end_top()
                self.end_top()

    # Rendering

    def push(self, tag: str, attrs: str) -> None:
        above = self.open[-1] if self.open else None
        hides = above.hides if above else False
        shown = above.shown if above else True
        if tag in NEVER_SHOWN or any(tag in names and self.counts[around] for around, names in UNDRAWN.items()):
            hides = True
        given: dict[str, str] = {}
        if attrs and (tag in ("ol", "li", "td", "th", "input") or self.rules.known or LOOKS_HIDDEN.search(attrs)):
            given = attributes(attrs)
        said = self.rules.of(tag, given) if self.rules.known else {}
        if "hidden" in given and given["hidden"].lower() != "until-found":
            said.setdefault("display", "none")
        for part in given.get("style", "").lower().split(";"):
            name, _, value = part.partition(":")
            said[name.strip()] = value.replace("!important", "").strip()
        if said.get("display") == "none":
            hides = True
        if said.get("visibility") in ("hidden", "collapse"):
            shown = False
        elif said.get("visibility") == "visible":
            shown = True
        element = Element(tag, shown, hides, tag in ("pre", "textarea") or bool(above and above.pre))
        self.open.append(element)
        self.counts[tag] += 1
        if hides:
            return
        flow = self.flows[-1]
        if tag in BLOCKS or tag == "text" and self.counts["svg"]:
            flow.end_line(tag in SPACED and not (self.lists and tag in ("ul", "ol", "menu", "dir")))
        if tag in ("ul", "ol", "menu", "dir"):
            self.lists += 1
            flow.indent += 1
            start = given.get("start", "1")
            element.number = int(start) if tag == "ol" and re.fullmatch(r"-?[0-9]{1,9}", start) else 1 if tag == "ol" else None
        elif tag == "li":
            marker = "- "
            for e in reversed(self.open[:-1]):
                if e.tag in ("ul", "ol", "menu", "dir"):
                    if e.number is not None:
                        if re.fullmatch(r"-?[0-9]{1,9}", value := given.get("value", "")):
                            e.number = int(value)
                        marker, e.number = f"{e.number}. ", e.number + 1
                    break
            flow.marker = marker if shown else ""
        elif tag in ("dd", "blockquote"):
            flow.indent += 1
        elif tag == "br":
            if flow.line:
                flow.end_line()
            else:
                flow.gap = True
        elif tag == "table" and len(self.tables) < DEEPEST_TABLE:
            self.tables.append(Table())
            element.put = self.tables[-1]
        elif tag in ("td", "th", "caption", "tr") and self.tables and (table := self.nearest_table()) is not None:
            if tag == "tr":
                table.rows.append([])
            else:
                if tag != "caption" and not table.rows:
                    table.rows.append([])
                self.flows.append(Flow())
                rows = given.get("rowspan", "1")
                rows = MOST_ROWS if rows.strip() == "0" else spanned(rows, MOST_ROWS)
                element.put = (table, spanned(given.get("colspan", "1"), MOST_COLUMNS), rows)
        elif tag == "input" and given.get("type", "text").lower() in ("submit", "button", "reset") and shown:
            flow.text(" " + given.get("value", "") + " ")

    def nearest_table(self) -> Table | None:
        for e in reversed(self.open[:-1]):
            if e.tag == "table":
                return e.put
        return None

    def end_top(self) -> None:
        e = self.open.pop()
        self.counts[e.tag] -= 1
        if e.hides:
            return
        flow, tag = self.flows[-1], e.tag
        if tag in BLOCKS or tag == "text" and self.counts["svg"]:
            flow.end_line(tag in SPACED and not (self.lists > 1 and tag in ("ul", "ol", "menu", "dir")))
        if tag in ("ul", "ol", "menu", "dir"):
            self.lists -= 1
            flow.indent -= 1
            flow.gap = flow.gap or not self.lists
            flow.marker = ""
        elif tag in ("dd", "blockquote"):
            flow.indent -= 1
        elif e.put is not None and tag == "table":
            self.tables.pop()
            for line in e.put.lines():
                if line:
                    flow.put(line)
                else:  # between blocks of a cell
                    flow.lines.append("")
            flow.gap = True
        elif e.put is not None:
            self.flows.pop()
            table, span, rows = e.put
            if tag == "caption":
                table.caption += flow.lines
            else:
                table.rows[-1].append(Cell(flow.lines, span, rows))

    def text(self, text: str) -> None:
        if not self.open or self.open[-1].tag == "head":
            if not text.strip():
                return
            self.leave_head()
        e = self.open[-1] if self.open else None
        if e is not None and (e.hides or not e.shown):
            return
        if "&" in text:
            text = html.unescape(text)
        if e is not None and e.pre:
            self.flows[-1].verbatim(text)
        else:
            self.flows[-1].text(text)

    def raw(self, tag: str, attrs: str, text: str) -> None:
        """An element whose content has no tags."""
        self.start(tag, attrs)
        if tag == "title" and self.title is None and not self.inside("svg"):
            self.title = SPACE.sub(" ", html.unescape(text)).strip()
        elif tag == "textarea":
            self.text(text)
        elif tag == "style":
            self.rules.read(text)
        self.end(tag)


def render(source: str) -> tuple[str, str | None]:
    """Visible text and title of one page."""
    page, at, source = Page(), 0, source.replace("\0", "")
    while token := TOKEN.search(source, at):
        if token.start() > at:
            page.text(source[at : token.start()])
        at = token.end()
        if tag := token["tag"] or token["tag2"]:
            tag, attrs = tag.lower(), token["attrs"] if token["tag"] else token["attrs2"]
            if token["close"] or token["close2"]:
                page.end(tag)
            elif tag in RAW or tag in RCDATA:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                page.raw(tag, attrs, source[at : end.start() if end else len(source)])
                at = end.end() if end else len(source)
            elif tag == "plaintext":
                break
            else:
                page.start(tag, attrs)
        elif token["data"] and (page.inside("svg") or page.inside("math")):
            page.text(token["data"].replace("&", "&amp;"))
    page.text(source[at:])
    while page.open:
        page.end_top()
    page.flows[0].end_line()
    return "\n".join(page.flows[0].lines), page.title


def extract(pages: DataFrame, page_id: str = "page_id", source: str = "html") -> DataFrame:
    """Visible text of every page; one row for each input row.

    Returns ``page_id, title, text, n_chars, n_lines``. A null page or one without visible text has
    an empty text and no lines; without a title element the title is null. Broken markup is mended
    as browsers do in the common cases: missing and superfluous tags, unclosed comments and quotes.
    Text of drawings and formulas is shown, their descriptions aren't. Rules of style elements hide if
    they name a tag, classes or an id, and stand before what they hide. Columns are aligned up to
    ``WIDEST_PADDING`` characters, in tables inside fewer than ``DEEPEST_TABLE`` others. A null page_id stays null; repeated rows are rendered each; other columns are left out.
    """
    kind = pages.schema[page_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = [("", None) if x is None else render(x) for x in part.column(1).to_pylist()]
                texts = [text for text, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([title for _, title in found], pa.string()),
                        pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
                    ],
                    ["page_id", "title", "text", "n_chars", "n_lines"],
                )

    return pages.select(page_id, source).mapInArrow(
        run, f"page_id {kind}, title string, text string, n_chars long, n_lines long"
    )
