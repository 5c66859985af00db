"""Main text of web pages by wrappers: union-free regular expressions inferred from a host's pages.

A page is a stream of block tags and texts. Tags that are never closed end where HTML ends them, so the stream nests.
Streams of a host are aligned one after another with the wrapper found so far: neighbours of one kind become a
repeated group, what one side lacks becomes optional, and texts that differ become slots. A wrapper holds, for each place,
how many pages have it, how much text stands there and, until it becomes a slot, the text itself (its hash if it is long).

The wrapper of a host tells where its article is: in article or main, or else in the element that holds most of the text that
varies. Menus, headers, footers, asides, forms, notices, adverts and comments are left out by tag, class, id or role; classes
never leave out html, body, main or article (but for a comment inside another article), and has-sidebar and the like only tell
of a layout. Within article or main nothing else is left out. Where a place is found only by its text, texts other than
headings that are the same on nearly all of a host's pages, three at least, belong to the template, when others vary; pages that
repeat count once. A page is aligned with its host's wrapper, and the texts at the article's places are its blocks. A page that
has no article or main, and less than half of its varying text at its host's place, has its own place: its element that holds
most of that text.

Each page is cut down to the wrapper of itself alone, a few hundred bytes, before anything is shuffled. These are merged in the
order of the pages' hashes, FAN at a time, then FAN of the results, until a host has one: the result does not depend on how the
table is partitioned, and no task meets all pages of a large host. A wrapper's size follows the variety of its host's structure,
not the number of pages. Trees are flat lists in the order of the page, so no depth of tags is too much; long unlike
sequences are aligned in linear time and space.

Defined results: a null or empty page, or one without article text, has the text '' and n_chars 0; pages of a null or
malformed url share the wrapper of the nameless host; repeated rows are extracted one by one; further columns are ignored.
"""

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter, OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.scratch import saved

#: Wrappers that are merged at once.
FAN = 256
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "canvas", "title", "select", "annotation")
VOID = frozenset("area base col embed hr img input link meta param source track wbr".split())
#: Tags inside a line of text, those of formulas too.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var"
    " math mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split()
)
BOILERPLATE = frozenset("head nav header footer aside form menu dialog button".split())
#: Whole words in class, id or role that name something else than the article.
MARKS = re.compile(
    r"(?<!\bhas)(?<!\bwith)(?<!\bno)(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|complementary|contentinfo|cookie|cookies|consent|disqus|footer|header|login|masthead|menu|menubar|modal|nav|navbar|navigation|newsletter|notice|notices|notification|pagination|popup|promo|promoted|promotion|recommended|related|share|sharing|sidebar|sidebars|signup|social|sponsor|sponsored|subscribe|subscription|toolbar|tracking|widget|widgets)(?=$|[\s_-]|\d)",
    re.IGNORECASE,
)
#: An article within an article that is a reader's.
READERS = re.compile(r"(?:^|[\s_-])(?:comment|comments|reply|replies)(?=$|[\s_-]|\d)", re.IGNORECASE)
#: Open tags that a new one closes, up to the tag that holds both.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.DOTALL | re.IGNORECASE,
)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
TEXT = "#"
#: A text that is the same on so large a part of a host's different pages, and on three at least, belongs to the template.
TEMPLATE = 0.9
#: Tags that classes never leave out, and blocks of text, which are never the article's place.
KEPT = frozenset("html body main article".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote figure figcaption caption address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Cells of a table of alignment; longer unlike sequences are aligned greedily.
CELLS = 40_000


class Tree:
    """Nodes in the order of the page, each with the end of its part; end[0] is their number."""

    def __init__(self) -> None:
        self.kind: list[str] = []
        self.text: list[str | None] = []
        self.end: list[int] = []

    def children(self, node: int) -> Iterator[int]:
        at, end = node + 1, self.end[node]
        while at < end:
            yield at
            at = self.end[at]


class Wrapper(Tree):
    """A regular expression: nodes stand least times at least and, where most is 2, any number of times; a text that is
    None is a slot. pages: how many have the node; chars: of text on all of them."""

    def __init__(self) -> None:
        super().__init__()
        self.least: list[int] = []
        self.most: list[int] = []
        self.pages: list[int] = []
        self.chars: list[int] = []

    def pack(self) -> str:
        return json.dumps([self.kind, self.text, self.end, self.least, self.most, self.pages, self.chars], ensure_ascii=False, separators=(",", ":"))

    @classmethod
    def unpack(cls, raw: str) -> "Wrapper":
        out = cls()
        out.kind, out.text, out.end, out.least, out.most, out.pages, out.chars = json.loads(raw)
        return out


def parse(html: str) -> Tree:
    """The page as a tree; a text has the kind '#'."""
    tree = Tree()
    kind, text, end = tree.kind, tree.text, tree.end
    stack: list[int] = []
    tags: list[str] = []
    opened: Counter = Counter()
    held: list[str] = []

    def push(name: str, tag: str) -> None:
        stack.append(len(kind))
        tags.append(tag)
        opened[tag] += 1
        kind.append(name)
        text.append(None)
        end.append(0)

    def flush() -> None:
        if held:
            line = " ".join(entities.unescape("".join(held)).split())
            if line:
                kind.append(TEXT)
                text.append(line)
                end.append(len(kind))
            held.clear()

    def cut(depth: int) -> None:
        while len(stack) > depth:
            end[stack.pop()] = len(kind)
            opened[tags.pop()] -= 1

    def close(names: set, until: set) -> None:
        if any(opened[x] for x in names):
            for i in range(len(stack) - 1, 0, -1):
                if tags[i] in until:
                    return
                if tags[i] in names:
                    cut(i)
                    return

    push("", "")
    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            held.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if m["close"]:
            if tag not in INLINE or opened[tag]:
                flush()
                close({tag}, set())
            continue
        rest = m["rest"]
        names = [a or b or c for _, a, b, c in NAMES.findall(rest)] if rest else []
        if tag in INLINE and not (names and MARKS.search(" ".join(names))):
            continue
        flush()
        if tag in CLOSES:
            close(*CLOSES[tag])
        elif tag not in INLINE and opened["p"]:
            close({"p"}, {"article", "main", "section", "div", "td", "li", "blockquote"})
        push(" ".join([tag, *sorted({re.sub(r"\d+", "0", x) for n in names for x in n.lower().split()})]) if names else tag, tag)
        if rest.endswith("/") and tag not in ("p", "div", "article", "section"):
            cut(len(stack) - 1)
    if at < len(html):
        held.append(html[at:])
    flush()
    cut(0)
    return tree


def mark(text: str) -> str:
    """What stands for a text in a wrapper: itself, or its hash where that is shorter."""
    return text if len(text) <= 64 else TEXT + xxhash.xxh128_hexdigest(text.encode("utf-8", "surrogatepass"))


def single(page: Tree) -> Wrapper:
    """A page as the wrapper of itself alone."""
    one = Wrapper()
    n = len(page.kind)
    one.kind, one.end, one.text = page.kind, page.end, [x if x is None else mark(x) for x in page.text]
    one.least, one.most, one.pages, one.chars = [1] * n, [1] * n, [1] * n, [len(x or "") for x in page.text]
    return merged([one])


# While wrappers are merged, a place is [kind, least, most, pages, text, chars, {wrapper: its nodes there}].


def places(number: int, wrapper: Wrapper, node: int) -> list[list]:
    w = wrapper
    return [[w.kind[c], w.least[c], w.most[c], w.pages[c], w.text[c], w.chars[c], {number: [c]}] for c in w.children(node)]


def join(a: list, b: list, repeat: bool) -> list:
    """One place for two. repeat: they stand on one page, one after the other."""
    least = max(1, a[1], b[1]) if repeat else min(a[1], b[1])
    most = 2 if repeat else max(a[2], b[2])
    pages = max(a[3], b[3]) if repeat else a[3] + b[3]
    nodes = a[6]
    for number, own in b[6].items():
        nodes.setdefault(number, []).extend(own)
    return [a[0], least, most, pages, a[4] if a[4] == b[4] else None, a[5] + b[5], nodes]


def fold(row: list[list]) -> list[list]:
    """Neighbours of one kind become a repeated group."""
    out: list = []
    for place in row:
        if out and out[-1][0] == place[0]:
            out[-1] = join(out[-1], place, True)
        else:
            out.append(place)
    return out


def pairs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a common order of two rows of kinds: the longest one, or that of the next equal kinds in long rows."""
    lo, n, m = 0, len(a), len(b)
    while lo < min(n, m) and a[lo] == b[lo]:
        lo += 1
    while n > lo and m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    out = [(i, i) for i in range(lo)]
    if (n - lo) * (m - lo) <= CELLS:
        width = m - lo + 1
        table = [[0] * width for _ in range(n - lo + 1)]
        for i in range(n - 1, lo - 1, -1):
            below, row = table[i - lo + 1], table[i - lo]
            for j in range(m - 1, lo - 1, -1):
                row[j - lo] = below[j - lo + 1] + 1 if a[i] == b[j] else max(below[j - lo], row[j - lo + 1])
        i = j = lo
        while i < n and j < m:
            if a[i] == b[j]:
                out.append((i, j))
                i, j = i + 1, j + 1
            elif table[i - lo + 1][j - lo] >= table[i - lo][j - lo + 1]:
                i += 1
            else:
                j += 1
    else:
        where: dict[str, list[int]] = {}
        for j in range(lo, m):
            where.setdefault(b[j], []).append(j)
        j = lo
        for i in range(lo, n):
            own = where.get(a[i], ())
            k = bisect_left(own, j)
            # A kind that stands only far ahead would leave out all between.
            if k < len(own) and own[k] - j <= 2 * (i - lo) + 64 - (j - lo):
                out.append((i, own[k]))
                j = own[k] + 1
    return out + [(n + i, m + i) for i in range(len(a) - n)]


def align(a: list[list], b: list[list], repeat: bool) -> list[list]:
    """One row of places for two: what both have in a common order stays, the rest is optional."""
    out, i, j = [], 0, 0
    for x, y in [*pairs([p[0] for p in a], [p[0] for p in b]), (len(a), len(b))]:
        out += [[p[0], 0, *p[2:]] for p in a[i:x]] + [[p[0], 0, *p[2:]] for p in b[j:y]]
        if x < len(a):
            one = join(a[x], b[y], False)
            if repeat:  # of one page
                one[3] = max(a[x][3], b[y][3])
            out.append(one)
        i, j = x + 1, y + 1
    return fold(out)


def merged(wrappers: list[Wrapper]) -> Wrapper:
    """One wrapper for several of different pages, aligned one after another, level by level."""
    out, depth = Wrapper(), []
    root = ["", 1, 1, sum(w.pages[0] for w in wrappers), None, 0, {i: [0] for i in range(len(wrappers))}]
    stack = [(root, 0)]
    while stack:
        (kind, least, most, pages, text, chars, nodes), level = stack.pop()
        for column, value in zip((out.kind, out.least, out.most, out.pages, out.text, out.chars, depth), (kind, least, most, pages, text, chars, level), strict=True):
            column.append(value)
        if kind == TEXT:
            continue
        row: list | None = None
        for number, own in nodes.items():
            here: list | None = None
            for node in own:
                one = fold(places(number, wrappers[number], node))
                here = one if here is None else align(here, one, True)
            row = here if row is None else align(row, here, False)
        stack += [(place, level + 1) for place in reversed(row or [])]
    open_: list[int] = []
    out.end = [len(depth)] * len(depth)
    for i, level in enumerate(depth):
        while len(open_) > level:
            out.end[open_.pop()] = i
        open_.append(i)
    return out


def expression(w: Wrapper) -> str:
    """The wrapper as a regular expression, for people."""
    signs = {(1, 1): "", (0, 1): "?", (1, 2): "+", (0, 2): "*"}
    out: list[str] = []
    closing: list[tuple[int, str]] = []
    for i, kind in enumerate(w.kind):
        while closing and closing[-1][0] <= i:
            out.append(closing.pop()[1])
        sign = signs[w.least[i], w.most[i]]
        if kind == TEXT:
            out.append(("(.*)" if w.text[i] is None else re.escape(w.text[i])) + sign)
        elif kind:
            out.append(f"(<{kind}>" if sign else f"<{kind}>")
            closing.append((w.end[i], f"</{kind.partition(' ')[0]}>" + (f"){sign}" if sign else "")))
    return "".join(out) + "".join(x for _, x in reversed(closing))


@lru_cache(100_000)
def left_out(kind: str) -> bool:
    tag, _, names = kind.partition(" ")
    return tag in BOILERPLATE or bool(names and tag not in KEPT and MARKS.search(names))


@lru_cache(100_000)
def is_named(kind: str) -> bool:
    tag, _, names = kind.partition(" ")
    return tag in ("article", "main") or "main" in names.split()


@lru_cache(100_000)
def of_reader(kind: str) -> bool:
    tag, _, names = kind.partition(" ")
    return tag == "article" and bool(READERS.search(names))


@lru_cache(100_000)
def is_block(kind: str) -> bool:
    return kind == TEXT or kind.partition(" ")[0] in BLOCKS


def sums(tree: Tree, own: list[int]) -> list[int]:
    """Of each node, the sum over its part."""
    total, out = [0], []
    for x in own:
        total.append(total[-1] + x)
    for i, end in enumerate(tree.end):
        out.append(total[end] - total[i])
    return out


def heaviest(tree: Tree, mass: list[int], once: list[int] | None = None) -> int:
    """The innermost container that holds most of the text."""
    node = 0
    while mass[node]:
        inner = next((x for x in tree.children(node) if not is_block(tree.kind[x]) and mass[x] > 0.8 * mass[node] and (once is None or once[x] == 1)), None)
        if inner is None:
            break
        node = inner
    return node


class Article:
    """Where a host's article stands in its wrapper, and which texts belong to the template."""

    def __init__(self, wrapper: Wrapper) -> None:
        w = self.wrapper = wrapper
        n = len(w.kind)
        fixed = [k == TEXT and t is not None and p >= max(3, TEMPLATE * w.pages[0]) for k, t, p in zip(w.kind, w.text, w.pages, strict=True)]
        seen, heading = [True] * n, [False] * n
        self.tops: set[int] = set()
        within = [False] * n
        i = 0
        while i < n:  # what isn't left out
            kind, end = w.kind[i], w.end[i]
            if kind and kind != TEXT and left_out(kind):
                seen[i:end] = [False] * (end - i)
                i = end
                continue
            if kind != TEXT and is_named(kind) and not within[i]:
                self.tops.add(i)
                within[i:end] = [True] * (end - i)
            if kind.partition(" ")[0] in HEADINGS:
                heading[i:end] = [True] * (end - i)
            i += 1
        named = bool(self.tops)
        if not named:
            top = heaviest(w, sums(w, [0 if not s or f else c for s, f, c in zip(seen, fixed, w.chars, strict=True)]), w.most)
            self.tops = {top}
            within[top : w.end[top]] = [True] * (w.end[top] - top)
        texts = [i for i in range(n) if w.kind[i] == TEXT and seen[i]]
        vary = lambda some: any(w.text[i] is None for i in some)
        inner = [] if named else [i for i in texts if within[i]]
        outer = [i for i in texts if not within[i]]
        self.template = {i for i in inner if fixed[i] and not heading[i]} if vary(inner) else set()
        if vary(texts):  # what every page's own place may leave out
            self.template |= {i for i in outer if fixed[i]}
        self.where: dict[int, dict[str, list[int]]] = {}

    def mate(self, node: int, kind: str, after: int) -> int | None:
        """The node's child of that kind: the next one after a place, or else the first."""
        found = self.where.get(node)
        if found is None:
            found = self.where[node] = {}
            for c in self.wrapper.children(node):
                found.setdefault(self.wrapper.kind[c], []).append(c)
        own = found.get(kind)
        if not own:
            return None
        k = bisect_left(own, after)
        return own[k] if k < len(own) else own[0]


def extract(page: Tree, article: Article) -> list[str]:
    """The texts of a page at the article's places of its host's wrapper, or else at its own place."""
    w = article.wrapper
    own = [0] * len(page.kind)  # characters that are not the template's
    out: list[str] = []
    named, i, n = False, 0, len(page.kind)
    open_: list[list] = []  # [end, mate or None, place after the last child's mate, whether in the article]
    while i < n:
        kind, end = page.kind[i], page.end[i]
        while open_ and open_[-1][0] <= i:
            open_.pop()
        inside, mate = False, 0
        if open_:
            up = open_[-1]
            inside = up[3]
            if kind != TEXT and (left_out(kind) or inside and of_reader(kind)):
                i = end
                continue
            mate = article.mate(up[1], kind, up[2]) if up[1] is not None else None
            if mate is not None:
                up[2] = mate
        if kind == TEXT:
            text = page.text[i]
            if not (mate in article.template and w.text[mate] == mark(text)):
                own[i] = len(text)
                if inside:
                    out.append(text)
        else:
            top = is_named(kind)
            named |= top
            open_.append([end, mate, 0, inside or top or mate in article.tops])
        i += 1
    if named or 2 * sum(map(len, out)) >= sum(own):
        return out
    top = heaviest(page, sums(page, own))
    return [page.text[i] for i in range(top, page.end[top]) if own[i]]


def host(url: str = "url"):
    return F.lower(F.coalesce(F.try_parse_url(F.col(url), F.lit("HOST")), F.lit("")))


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper), a row for each host of pages (url, html)."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([single(parse(x)).pack() for x in batch.column(2).to_pylist()], pa.string())], names=["host", "h", "wrapper"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x[0] if len(x) == 1 else merged([Wrapper.unpack(raw) for raw in x]).pack() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["host", "h", "wrapper"])

    shape = "host string, h long, wrapper string"
    some = pages.where("html <> ''").select(host().alias("host"), F.xxhash64("html").alias("h"), "html")
    groups = -(-pages.count() // FAN)
    some = some.mapInArrow(local, shape).groupBy("host", "h").agg(F.min("wrapper").alias("wrapper"))  # copies count once
    group = F.pmod("h", F.lit(max(1, groups)))
    while True:
        some = some.groupBy("host", group.alias("part")).agg(F.sort_array(F.collect_list(F.struct("h", "wrapper"))).alias("own")).select("host", "part", F.col("own.wrapper").alias("own")).mapInArrow(combine, shape)
        if groups <= 1:
            return some.select("host", "wrapper")
        groups = -(-groups // FAN)
        group = F.floor(F.col("h") / FAN) if groups > 1 else F.lit(0).cast("long")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""
    wrappers = saved(infer(pages), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[str, Article] = OrderedDict()  # of the hosts met last
        for batch in batches:
            texts = []
            for html, raw in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                if not html:
                    texts.append("")
                    continue
                raw = raw.as_py()
                if raw not in known:
                    known[raw] = Article(Wrapper.unpack(raw))
                    if len(known) > FAN:
                        known.popitem(last=False)
                known.move_to_end(raw)
                texts.append("\n\n".join(extract(parse(html), known[raw])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host().alias("host"))
    out = rows.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper").mapInArrow(run, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op9_main_text(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
