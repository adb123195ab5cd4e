"""Main-text extraction from HTML by the line-block distribution.

Markup is stripped into lines: one for each block of text (paragraph, heading, list item, cell...),
empty ones where a section of the page's body begins or ends outside its article. ``S[i]``, the text length
summed over ``window`` lines from line ``i``, is then the line-block distribution. It surges where the
text begins and dives where it ends; the stretch between with the most text is the main text. With it
go all lines of the section that holds most of it or, where that is an article, of all articles, so that
adverts and lists of links inside do not cut it. Text in links counts against its line.

Elements of markup for menus, headers, footers, sidebars, adverts, forms and scripts give no lines, nor do
those whose class, id or role has a word of ``MARKS``. Words of ``HINTS`` also name ordinary things (side
effects, a map to share), so they only weigh: such an element goes if half its text is links or, outside
an article, if none of its lines is as long as ``SURGE``. A <header> inside an article is the article's heading.

Defined results: a null or empty page, or one without text, gives ''; unclosed and truncated markup is
read to its end; time grows with a page's length alone; of equally long stretches the first is taken;
repeated rows give repeated rows; other columns pass by untouched, but for ``html_col``, which goes, and
columns named text or n_chars, which the results replace.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import ship_code

WINDOW = 3

#: Text length of a window at which a line is prose.
SURGE = 86

#: Elements that never hold main text.
DROPPED = frozenset("nav header footer aside form button select option input textarea label fieldset iframe svg canvas noscript template dialog menu object audio video map head title script style math".split())
#: Words of class, id and role that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr sidebar nav navbar navigation breadcrumb breadcrumbs masthead comment comments disqus respond replies newsletter subscribe subscription signup login popup modal overlay widget toolbar pagination pager copyright complementary contentinfo".split()
)
#: Words that mark boilerplate where the text looks like it.
HINTS = frozenset("promo promotion banner notice notices alert side menu header footer foot reply share sharing social related recommended search form hidden".split())
#: Elements whose begin and end separate blocks.
BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption section article main blockquote pre hr figure figcaption address details summary body html center nav header footer aside form fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements kept on the stack, so that a boilerplate element ends where it or its parent ends.
CONTAINERS = frozenset("div section article main body html ul ol table".split()) | DROPPED
#: Elements that make the text inside them one section.
SECTIONS = frozenset("div section article main".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S | re.I,
)
MARKED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPLIT = re.compile(r"[^a-z]+")


def _words(attrs: str) -> set[str]:
    return {w for m in MARKED.finditer(attrs) for w in SPLIT.split((m[1] or m[2] or m[3] or "").lower())}


def _boilerplate(name: str, attrs: str, inside: bool) -> str:
    """'drop', 'weigh' or ''; ``inside``: an article."""
    if name in DROPPED and not (inside and name == "header"):
        return "drop"
    if not attrs or name in ("html", "body"):
        return ""
    found = _words(attrs)
    if name in ("article", "main"):
        return "drop" if found & {"comment", "comments", "reply", "ad", "advert"} else ""
    return "drop" if found & MARKS else "weigh" if found & HINTS else ""


#: Text, characters in links, number of the section (0: none) and whether that is an article.
Line = tuple[str, int, int, bool]
EMPTY: Line = ("", 0, 0, False)


class Reader:
    """Lines of one page; ``last``: of each section, the number of the last one inside it.

    A line's section is the outermost article or main around it, else the innermost of ``SECTIONS``.
    """

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.last = [0]
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.stack: list[str] = []
        self.open: dict[str, int] = {}  # how often each name is on the stack
        self.homes: list[tuple[int, int, bool]] = []  # stack height, number, in an article
        self.drop: tuple[int, str] | None = None  # stack height from which, and name by which, text is boilerplate
        self.depth = 0  # of elements of that name, where the stack does not count them
        self.doubts: list[tuple[int, int]] = []  # stack height and first line of elements to be weighed
        self.links = 0

    @property
    def inside(self) -> bool:
        return bool(self.homes) and self.homes[-1][2]

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                number, whole = self.homes[-1][1:] if self.homes else (0, False)
                self.lines.append((text, len(" ".join(html.unescape("".join(self.linked)).split())), number, whole))
            self.parts.clear()
            self.linked.clear()

    def gap(self, section: bool = False) -> None:
        """Sections part here, but where something is removed inside one."""
        self.flush()
        if not self.inside and (section or not self.homes):
            self.lines.extend([EMPTY] * WINDOW)

    def text(self, text: str) -> None:
        if not self.drop:
            self.parts.append(text)
            if self.links:
                self.linked.append(text)

    def _undrop(self) -> None:
        self.drop, self.depth = None, 0
        self.gap()

    def _push(self, name: str) -> None:
        self.stack.append(name)
        self.open[name] = self.open.get(name, 0) + 1

    def _pop_to(self, height: int) -> None:
        """Ends all elements from this height of the stack on."""
        if self.homes and self.homes[-1][0] > height or self.doubts and self.doubts[-1][0] > height:
            self.flush()
        while self.doubts and self.doubts[-1][0] > height:
            _, first = self.doubts.pop()
            held = self.lines[first:]
            if 2 * sum(x[1] for x in held) >= sum(len(x[0]) for x in held) or not self.inside and all(len(x[0]) < SURGE for x in held):
                del self.lines[first:]
        while len(self.stack) > height:
            self.open[self.stack.pop()] -= 1
        parted = False
        while self.homes and self.homes[-1][0] > height:
            _, number, whole = self.homes.pop()
            self.last[number] = max(self.last[number], len(self.last) - 1)
            parted = whole and not self.inside
        if parted and not self.drop:
            self.gap(True)
        if self.drop and len(self.stack) < self.drop[0]:
            self._undrop()

    def end(self, name: str) -> None:
        if name in CONTAINERS:
            if self.open.get(name):
                height = len(self.stack) - 1
                while self.stack[height] != name:
                    height -= 1
                self._pop_to(height)
        elif self.drop and self.drop[1] == name and self.depth:
            self.depth -= 1
            if not self.depth:
                self._undrop()
        if not self.drop:
            if name == "a":
                self.links = max(0, self.links - 1)
            elif name in BLOCKS:
                self.flush()
                self.links = 0

    def begin(self, name: str, attrs: str) -> None:
        empty = name in VOID or attrs.endswith("/")
        if self.drop and name in ("article", "main") and not self.inside and not _boilerplate(name, attrs, False):
            self._pop_to(self.drop[0] - 1)  # a menu or header that was never closed
            if self.drop:
                self._undrop()
        if self.drop and self.depth and name == self.drop[1]:
            if name in ("p", "li"):  # ends the one before
                self._undrop()
            elif not empty:
                self.depth += 1
        if self.drop:
            if name in CONTAINERS and not empty:
                self._push(name)
            return
        if name == "br":
            self.parts.append(" ")
            return
        what = _boilerplate(name, attrs, self.inside)
        if what == "drop" or what and name not in CONTAINERS and not self.inside:
            self.gap()
            if not empty:
                if name in CONTAINERS:
                    self._push(name)
                else:
                    self.depth = 1
                self.drop = (len(self.stack), name)
            return
        if name in CONTAINERS and not empty:
            if name in ("article", "main") and not self.inside:
                self.gap(True)
            if name in SECTIONS or what:
                self.flush()
            self._push(name)
            if what:
                self.doubts.append((len(self.stack), len(self.lines)))
            if name in SECTIONS:
                self.last.append(0)
                inner = self.inside
                self.homes.append((len(self.stack), self.homes[-1][1] if inner else len(self.last) - 1, inner or name in ("article", "main")))
        elif name == "a" and not empty:
            self.links += 1
        if name in BLOCKS:
            self.flush()
            self.links = 0

    def read(self, page: str) -> list[Line]:
        at = 0
        for m in TOKEN.finditer(page):
            if m.start() > at:
                self.text(page[at : m.start()])
            at = m.end()
            if name := (m["name"] or m["name2"] or "").lower():
                if m["end"] or m["end2"]:
                    self.end(name)
                else:
                    self.begin(name, m["attrs"] or m["attrs2"] or "")
        if at < len(page):
            self.text(page[at:])
        self.flush()
        self._pop_to(0)
        return self.lines


def main_lines(lines: list[Line], window: int = WINDOW) -> tuple[int, int]:
    """First and last + 1 of the lines between the surge and the dive that hold the most text."""
    n = len(lines)
    own = [max(len(t) - 2 * k, 0) for t, k, _, _ in lines]
    sums, total = [0] * n, 0
    for i in range(n - 1, -1, -1):  # S[i] = own[i] + ... + own[i + window - 1]
        total += own[i] - (own[i + window] if i + window < n else 0)
        sums[i] = total
    best, i = (0, 0, 0), 0
    while i < n:
        if not sums[i]:
            i += 1
            continue
        j, text = i, 0
        while j < n and sums[j]:
            text += own[j]
            j += 1
        first, last = i, j
        while first < last and not lines[first][0]:
            first += 1
        while last > first and not lines[last - 1][0]:
            last -= 1
        if text > best[0]:
            best = (text, first, last)
        i = j
    return best[1], best[2]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    reader = Reader()
    lines = reader.read(page)
    first, last = main_lines(lines)
    held: dict[tuple[int, bool], int] = {}
    for t, k, home, whole in lines[first:last]:
        held[home, whole] = held.get((home, whole), 0) + max(len(t) - 2 * k, 0)
    main, article = max(held, key=held.get, default=(0, False))
    inside = lambda home, whole: whole if article else main <= home <= reader.last[main] if main else not home
    return "\n\n".join(t for i, (t, _, home, whole) in enumerate(lines) if t and (first <= i < last or inside(home, whole)))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col``, with text and n_chars (code points) of each row."""
    ship_code(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = pages.select(*kept).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(p) for p in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=schema.names,
                )

    return pages.select(*kept, F.col(html_col)).mapInArrow(run, schema)


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
