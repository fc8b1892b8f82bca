"""Main text of a page by the line-block distribution.

Markup is stripped to lines, one a block element, and each line weighs as many characters as it shows.
Lines of parts that are no article by their markup (menus, headers, footers, sidebars, notices, adverts,
forms, comments, hidden parts) are left out; a class, id or role does not exclude what holds a <main> or the largest
<article>, or most of the text of a page without either. A line that is little but links weighs nothing, and on a page
with an <article> or <main> a line outside weighs ``OUTSIDE`` of its characters.

What is left is decided by the distribution alone, on every page. Lines inside and outside of an article element are
blocks of their own. In each, the weights are summed over windows of ``WINDOW`` lines. Text surges where a window reaches
``THRESHOLD`` (or the largest sum, where the page, or all of its article elements, have none so large) and dives where a
whole window weighs nothing. The lines from the surge to the dive are the text; a surge reaches back over headings, and within
an article element over all lines of weight.

Character references are decoded, white space within a block becomes one space (a <br> or a table cell is
white space), and blocks are joined by one line feed. Nothing else is dropped or capped.

Defined results: null or empty html, or a page without text, gives "". Scripts and styles end at their own
end tag, whatever they hold; a tag cut off by the end of the page is dropped; a tag whose quotes never close ends at its
first ">", and so does every later one; an excluded part that is never closed ends where an <article> or <main>
begins. Work grows with the length of a page, whatever it holds. Repeated rows get equal results. Input columns named
like a result column are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import map_texts

WINDOW, THRESHOLD = 3, 80
#: Share of the characters that must be links for a line to weigh nothing; weight of a character outside of the page's article elements.
LINKS, OUTSIDE = 0.7, 0.25

REST = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?=/?[a-zA-Z])[^<]*+\Z"
TOKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|" + REST, re.S)
#: The same, but blind to quotes; and for what follows the last ">".
LOOSE, CUT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|" + REST, re.S), re.compile(r"()()()(?!)|" + REST, re.S)
UNCLOSED = re.compile(r"<!--|<!\[CDATA\[|<[!?]|(</?[a-zA-Z])")
CLOSING = re.compile(r"</([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table caption tbody thead tfoot tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BARRED = frozenset("head script style noscript template svg math iframe object audio video canvas nav aside footer form button select textarea fieldset dialog menu".split())
HOLDERS = frozenset(("article", "main"))
#: Parts of a class, id or role that name what is no article.
BARRED_NAMES = frozenset("ad ads adv advert adverts advertisement sponsor sponsored promo promoted sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices banner alert comment comments disqus respond replies share sharing social related recommended footer masthead newsletter subscribe signup login popup modal overlay toolbar pagination pager widget widgets copyright complementary contentinfo search".split())
#: Those that bar an element only where no part of its name speaks of the article itself.
WEAK_NAMES, ARTICLE_NAMES = frozenset("header banner search related".split()), frozenset("article post entry content story text title".split())

#: Beside these a part only says how a page is laid out.
FORMS = frozenset("with without has have no not non enabled disabled".split())


def named(values: list[str]) -> bool:
    """Whether class, id or role name what is no article; a name such as "with-sidebar" or "share-enabled" does not."""
    names = [{x.lower() for x in NAME_PART.findall(name)} for value in values for name in value.split()]
    parts: set[str] = set().union(*names)
    found = set().union(*(x & (BARRED_NAMES | WEAK_NAMES) for x in names if not x & FORMS))
    return bool(found - WEAK_NAMES) or bool(found) and not parts & ARTICLE_NAMES


def barred(name: str, attributes: str, inside: bool) -> str:
    """"part" for an element that is no part of an article, "named" where only its class, id or role say so, else "";
    ``inside`` an article element a header is."""
    if name in BARRED:
        return "part"
    if name == "header":
        return "" if inside else "part"
    if not attributes or name in ("html", "body", *HOLDERS):
        return ""
    values = []
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return "part"
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return "part"
        elif key in ("class", "id", "role"):
            values.append(value)
    return "named" if named(values) else ""


def tokens(html: str) -> Iterator[tuple[str, re.Match | None]]:
    """(text before it, tag, comment or the like) one after another, the last with None; ``send`` moves the place."""
    at, n, last, token = 0, len(html), html.rfind(">"), TOKEN
    while at < n:
        m = (CUT if at > last else token).search(html, at)
        if token is TOKEN and at <= last and (x := UNCLOSED.search(html, at)) and x[1] and x.start() <= last and (not m or m.start() > x.start()):
            token = LOOSE  # quotes that never close: not tried again, for each try reads to the end
            m = token.search(html, at)
        go = yield html[at : m.start() if m else n], m
        at = go if go is not None else m.end() if m else n


class Extents:
    """Where the elements of a page end, and how much text they hold."""

    def __init__(self, html: str) -> None:
        self.ends: dict[int, int] = {}
        self.marks, self.sums = [0], [0]
        holders: list[tuple[int, str]] = []
        stack: list[tuple[str, int]] = []
        opened: Counter[str] = Counter()
        self.n, go = len(html), None
        scan = tokens(html)
        while True:
            try:
                before, m = scan.send(go)
            except StopIteration:
                break
            go = None
            if shown := sum(map(len, before.split())):
                self.marks.append(m.start() if m else self.n)
                self.sums.append(self.sums[-1] + shown)
            if not m:
                break
            name, closing = (m[2] or "").lower(), bool(m[1])
            if not closing and name in RAW:
                go = raw_end(html, name, m.end())
            elif closing:
                while opened[name]:
                    other, start = stack.pop()
                    opened[other] -= 1
                    self.ends[start] = m.start()
                    if other == name:
                        break
            elif name and name not in VOID and not m[3].endswith("/"):
                stack.append((name, m.start()))
                opened[name] += 1
                if name in HOLDERS and not named([a or b or c for key, a, b, c in ATTRIBUTE.findall(m[3]) if key.lower() in ("class", "id", "role")]):
                    holders.append((m.start(), name))
        articles = [x for x, name in holders if name == "article"]
        #: Every <main>, and the <article> with the most text.
        self.holders = sorted({x for x, name in holders if name == "main"} | ({max(articles, key=self.shown)} if articles else set()))

    def shown(self, start: int) -> int:
        """Characters of text, without white space, in the element that starts there."""
        upto = lambda pos: self.sums[bisect_right(self.marks, pos) - 1]
        return upto(self.ends.get(start, self.n)) - upto(start)

    def whole(self, start: int) -> bool:
        """Whether the element holds the page's article element, or most of the text of a page without one."""
        if self.holders:
            k = bisect_right(self.holders, start)
            return k < len(self.holders) and self.holders[k] < self.ends.get(start, self.n)
        return 2 * self.shown(start) > self.sums[-1]


class Line:
    __slots__ = ("heading", "held", "links", "parts")

    def __init__(self, heading: bool, held: bool) -> None:
        self.parts, self.links, self.heading, self.held = [], 0, heading, held


def raw_end(html: str, name: str, at: int) -> int:
    """Where the raw text of an element ends, its end tag included."""
    end = RAW_ENDS[name].search(html, at)
    return end.end() if end else len(html)


def lines(html: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters in links, is a heading, is held by an article element) of each block that is not barred."""
    out: list[Line] = []
    line: Line | None = None
    extents: Extents | None = None
    closes: dict[str, int] | None = None  # where each name is closed last
    stack: list[str] = []  # names open inside the barred part, the barred element first
    opened: Counter[str] = Counter()
    held = links = 0
    heading = False

    def text(s: str) -> None:
        nonlocal line
        if s:
            if line is None:
                line = Line(heading, held > 0)
                out.append(line)
            line.parts.append(s)
            if links:
                line.links += len(s)

    scan, go = tokens(html), None
    while True:
        try:
            before, m = scan.send(go)
        except StopIteration:
            break
        go = None
        if not stack:
            text(before)
        if not m:
            break
        name = (m[2] or "").lower()
        if not name:
            if not stack and m[0].startswith("<![CDATA["):
                text(m[0][9:-3])
            continue
        closing = bool(m[1])
        if not closing and name in RAW:
            go = raw_end(html, name, m.end())
            continue
        if stack:
            if name in HOLDERS and not closing and stack[0] not in HOLDERS:
                if closes is None:
                    closes = {x[1].lower(): x.start() for x in CLOSING.finditer(html)}
                if closes.get(stack[0], -1) < m.end():
                    stack.clear()
                    opened.clear()
            if stack and closing:
                if opened[name]:
                    while stack:
                        other = stack.pop()
                        opened[other] -= 1
                        if other == name:
                            break
                if stack or name not in BLOCKS:
                    continue
            elif stack:
                if name not in VOID and not m[3].endswith("/"):
                    stack.append(name)
                    opened[name] += 1
                continue
        if name in HOLDERS:
            held = max(0, held + (-1 if closing else 1))
        why = barred(name, m[3], held > 0) if not closing and name not in VOID else ""
        if why == "named":
            extents = extents or Extents(html)
            why = "" if extents.whole(m.start()) else why
        if why:
            stack.append(name)
            opened[name] += 1
            line = None
        elif name in BLOCKS:
            line = None
            if name in HEADINGS:
                heading = not closing
            elif not closing:
                heading = False
            if not closing and name in ("p", "div", "li", "article", "section"):
                links = 0  # a link does not go on into the next block
        elif name == "a":
            links = 0 if closing else 1
        elif name in ("br", "td", "th", "img", "input"):
            text(" ")
    shown = [(" ".join(unescape("".join(x.parts)).split()), x.links, x.heading, x.held) for x in out]
    return [x for x in shown if x[0]]


def window_sums(weight: list[float], window: int) -> list[float]:
    """Of each line, the weight of the window that begins there."""
    n = len(weight)
    sums = [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        sums[i] = sums[i + 1] + weight[i] - (weight[i + window] if i + window < n else 0)
    return sums[:n]


def surges(weight: list[float], sums: list[float], least: float, back: list[bool]) -> Iterator[tuple[int, int]]:
    """(begin, end) of each run of lines from a surge to its dive; ``back`` says over which lines a surge reaches back."""
    i = done = 0
    while i < len(weight):
        if not weight[i] or sums[i] < least:
            i += 1
            continue
        begin = i
        while begin > done and weight[begin - 1] and back[begin - 1]:
            begin -= 1
        while i < len(weight) and sums[i]:
            i += 1
        end = i
        while end > begin and not weight[end - 1]:
            end -= 1
        yield begin, end
        done = i


def main_text(html: str | None, window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    found = lines(html or "")
    articles = any(held for *_, held in found)
    blocks = []  # (held, lines, weights, window sums) of each run of lines inside or outside of an article element
    for held, group in groupby(found, key=lambda x: x[3]):
        own = list(group)
        weight = [0.0 if links >= LINKS * len(shown) and not held else len(shown) * (OUTSIDE if articles and not held else 1.0) for shown, links, *_ in own]
        blocks.append((held, own, weight, window_sums(weight, window)))
    most = max((x for held, _, _, sums in blocks if held or not articles for x in sums), default=0)
    keep: list[str] = []
    for held, own, weight, sums in blocks:
        least = threshold if articles and not held else min(threshold, most)
        if least:
            for begin, end in surges(weight, sums, least, [held or x[2] for x in own]):
                keep += [x[0] for x in own[begin:end]]
    return "\n".join(keep)


RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame, *, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Kept columns, text and n_chars (its code points)."""

    def make():
        def f(html: pa.StringArray) -> list[pa.Array]:
            texts = [main_text(x) for x in html.to_pylist()]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return f

    return map_texts(pages, html_col, keep, RESULT, make)
