"""Main text of web pages: blocks in and out of the article, and nearest-URL page differencing.

A page is cut into lines, one for each block of text, each with what the markup says about it: furniture (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments; scripts, styles and comments give no line at all), article, or neither. Pages of a host are ordered by
their URL's path and each is paired with the neighbour whose path has the longer beginning in common with its own. The lines of
the two are aligned by their longest common subsequence; lines that both have are the host's template and are deleted.

Differencing decides wherever the markup names no article. Where it does, the article's lines stay even if the neighbour has them
too, and other lines go even if it has not: menus and adverts that are drawn anew for each page are no template, and a passage
that two articles share is. A page that has nearly all its text in common with its neighbour is a copy of it and keeps its text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([\w:-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACES = re.compile(r"\s+")
NAME = re.compile(r"[a-z]+")

RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "select", "noembed", "noframes", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FURNITURE = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "head", "label"}
#: Words in class, id and role that mark furniture. Those of the second line hold whatever is inside them.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar nav navbar navigation menu "
    "breadcrumb breadcrumbs masthead header share sharing social newsletter subscribe subscription signup login search pagination pager widget toolbar skip contentinfo complementary form".split()
)
INNER = set("comment comments disqus reply replies respond discussion footer aside related recommended".split())
ARTICLE, LOOSE, DROPPED = 2, 1, 0


def furniture(tag: str, attributes: str, in_article: bool) -> str:
    """'' if not; 'soft' if an article inside it ends it, else 'hard'."""
    kind = "hard" if tag in ("footer", "aside") else "soft" if tag in FURNITURE or (tag == "header" and not in_article) else ""
    if kind == "hard" or tag in ("html", "body") or not attributes.strip():
        return kind
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role"):
            names = set(NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
            if names & INNER:
                return "hard"
            if tag not in ("article", "main") and names & MARKS and not (in_article and names & MARKS <= {"header"}):
                kind = "soft"
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return "hard"
    return kind


class Open:
    """The open elements, with counts of what they are, so that a line costs the same at any depth."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str, int]] = []  # tag, furniture, article level
        self.tags: Counter[str] = Counter()
        self.kinds: Counter[str] = Counter()
        self.levels: Counter[int] = Counter()

    def push(self, tag: str, kind: str, level: int) -> None:
        self.stack.append((tag, kind, level))
        self.tags[tag] += 1
        self.kinds[kind] += 1
        self.levels[level] += 1

    def pop(self) -> str:
        tag, kind, level = self.stack.pop()
        self.tags[tag] -= 1
        self.kinds[kind] -= 1
        self.levels[level] -= 1
        return tag

    def close(self, tag: str) -> bool:
        """Closes the innermost element of this name and what is open in it; False if there is none."""
        if not self.tags[tag]:
            return False
        while self.pop() != tag:
            pass
        return True

    def clear_furniture(self) -> None:
        if self.kinds["soft"]:
            self.stack = [(t, "", level) for t, _, level in self.stack]
            self.kinds = Counter({"": len(self.stack)})

    @property
    def level(self) -> int:
        """-1 in furniture, else how surely this is an article."""
        if self.kinds["soft"] or self.kinds["hard"]:
            return -1
        return 2 if self.levels[2] else 1 if self.levels[1] else 0


def lines_of(page: str) -> list[tuple[str, int]]:
    """The page's lines with ARTICLE, LOOSE or DROPPED, in page order."""
    found: list[tuple[str, int]] = []
    text: list[str] = []
    open_ = Open()
    at = 0

    def flush() -> None:
        if text:
            line = SPACES.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if line:
                found.append((line, open_.level))

    while True:
        m = TOKEN.search(page, at)
        if not m:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                text.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag in BLOCK or open_.tags[tag]:
                flush()
            open_.close(tag)
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page) if tag in ("script", "style", "textarea") else at
            text.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                text.append(" ")
            continue
        level = 2 if tag == "article" else 1 if tag == "main" else 0
        kind = furniture(tag, attributes, bool(open_.levels[1] or open_.levels[2]))
        if tag in BLOCK:
            flush()
            if open_.stack and open_.stack[-1][0] == "p":
                open_.pop()
            ended = ENDED_BY.get(tag)
            while ended and open_.stack and open_.stack[-1][0] in ended:
                open_.pop()
        if level and not kind and not open_.kinds["hard"]:
            open_.clear_furniture()  # furniture that was never closed, or is none
        if tag in BLOCK or kind:
            if kind:
                flush()
            open_.push(tag, kind, 0 if kind else level)
    flush()
    best = max((level for _, level in found), default=0)
    return [(line, DROPPED if level < 0 or level < best else ARTICLE if best else LOOSE) for line, level in found]


def shared_lines(a: list[int], b: list[int]) -> list[bool]:
    """Which of a's lines a longest common subsequence of a and b has.

    Equal ends are cut off. Rows of the table are numbers of a bit for each line of b, 0 where the subsequence grows by one; only
    every so many rows are kept and those between are made again on the way back, so memory grows with the root of a's length.
    """
    out = [False] * len(a)
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        out[head] = True
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
        out[-tail] = True
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return out
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1

    def below(v: int, x: int) -> int:
        u = v & where.get(x, 0)
        return ((v + u) | (v - u)) & full

    step = math.isqrt(len(a)) + 1
    kept, v = [], full
    for i, x in enumerate(a):
        if i % step == 0:
            kept.append(v)
        v = below(v, x)
    j = len(b)
    for k in reversed(range(len(kept))):
        rows, lo = [kept[k]], k * step
        for x in a[lo : lo + step]:
            rows.append(below(rows[-1], x))
        i = len(rows) - 1
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            if rows[i] >> (j - 1) & 1:
                out[head + lo + i] = True
                j -= 1
    return out


def template(lines: list[str | None], kinds: list[int], own: list[int], other: list[int] | None, copy: float) -> list[bool]:
    """Which lines the neighbour has too; none if it has more than the share `copy` of the text that may stay."""
    if not other:
        return [False] * len(own)
    shared = shared_lines(own, other)
    sizes = [len(x) if x is not None and k == LOOSE else 0 for x, k in zip(lines, kinds, strict=True)]
    if sum(n for n, s in zip(sizes, shared, strict=True) if s) > copy * sum(sizes):
        return [s and k != LOOSE for s, k in zip(shared, kinds, strict=True)]
    return shared


@dataclass(frozen=True)
class Pages:
    """ranges: how many ranges the ordered URLs are cut into; None: as many as shuffle partitions. copy: share of its text that a
    page must have in common with its neighbour, and more, to be a copy of it. rows: pages that a worker holds as objects."""

    ranges: int | None = None
    copy: float = 0.9
    rows: int = 64


def nearest(urls: DataFrame, p: Pages = Pages()) -> DataFrame:
    """(rid, other): the nearest page of the same host by path; pages that are alone on their host are left out.

    `urls` has rid (distinct), host and path. Pages are sorted by host and path over ranges; a range's ends are joined through
    one row for each range, so a host of any size is dealt out.
    """
    order = ["host", "path", "rid"]
    dealt = urls.repartitionByRange(p.ranges, *order) if p.ranges else urls.repartitionByRange(*order)
    placed = stored(dealt.select(*order, F.spark_partition_id().alias("part")), "urls")
    row = F.struct(*order)
    inside = Window.partitionBy("part").orderBy(*order)
    ends = placed.groupBy("part").agg(F.min(row).alias("low"), F.max(row).alias("high"))
    along = Window.orderBy("part")  # one row for each range
    ends = ends.select("part", F.lag("high").over(along).alias("left"), F.lead("low").over(along).alias("right"))
    both = placed.select(*order, "part", F.lag(row).over(inside).alias("before"), F.lead(row).over(inside).alias("after")).join(ends, "part")
    before, after = F.coalesce("before", "left"), F.coalesce("after", "right")
    same = lambda x: F.when(x["host"] == F.col("host"), x)
    pairs = both.select("rid", "path", same(before).alias("before"), same(after).alias("after"))
    steps = F.sequence(F.lit(1), F.greatest(F.char_length("path"), F.lit(1)))
    begin = lambda x: F.size(F.filter(steps, lambda n: F.substring(F.col("path"), F.lit(1), n) == F.substring(x["path"], F.lit(1), n)))
    other = F.when(F.col("after").isNull() | (F.col("before").isNotNull() & (begin(F.col("before")) >= begin(F.col("after")))), F.col("before")["rid"]).otherwise(F.col("after")["rid"])
    return pairs.select("rid", other.alias("other")).where("other is not null")


def extract(pages: DataFrame, p: Pages = Pages()) -> DataFrame:
    """One row for each row of `pages` (page_id, url, html): page_id, url, text, n_chars, n_lines, n_shared.

    n_shared: lines of the page that its neighbour has too. Null html has no text; a null url is a host of its own with an empty
    path. Equal rows are one page and have equal results; a copy under another id is a page of its own. An empty table gives
    no rows; other columns are not read.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    markup = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", markup.alias("html"), F.xxhash64(F.col("page_id"), url, markup).alias("rid"))
    kind = pages.schema["page_id"].dataType.simpleString()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, p.rows):
                yield batch.slice(lo, p.rows)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [lines_of(x) for x in batch.column(2).to_pylist()]
            lines = pa.array([[a for a, _ in x] for x in found], pa.list_(pa.string()))
            kinds = pa.array([[k for _, k in x] for x in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), lines, kinds], ["page_id", "url", "rid", "lines", "kinds"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts, counts = [], []
            for lines, kinds, own, other in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                shared = template(lines, kinds, own, other, p.copy)
                texts.append("\n".join(a for a, k, s in zip(lines, kinds, shared, strict=True) if k == ARTICLE or (k == LOOSE and not s)))
                counts.append((len(lines), sum(shared)))
            numbers = [pa.array(x, pa.int64()) for x in ([len(t) for t in texts], [n for n, _ in counts], [s for _, s in counts])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), *numbers], ["page_id", "url", "text", "n_chars", "n_lines", "n_shared"])

    # pages are parsed once for the hashes of their lines and once more for their text, which so is neither stored nor shuffled twice
    parsed = rows.mapInArrow(parse, f"page_id {kind}, url string, rid long, lines array<string>, kinds array<int>").withColumn("own", F.transform("lines", lambda x: F.xxhash64(x)))
    narrow = stored(parsed.select("rid", "url", "own"), "lines")
    hashed = parsed.withColumn("lines", F.zip_with("lines", "kinds", lambda x, k: F.when(k != DROPPED, x)))
    bare = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|^//", "")
    host, path = F.lower(F.regexp_extract(bare, r"^[^/?#]*", 0)), F.regexp_extract(bare, r"^[^/?#]*([^?#]*)", 1)
    links = nearest(narrow.select("rid", host.alias("host"), path.alias("path")).distinct(), p)
    given = narrow.select(F.col("rid").alias("other"), F.col("own").alias("others")).dropDuplicates(["other"]).join(links, "other").select("rid", "others")
    return hashed.join(given, "rid", "left").select("page_id", "url", "lines", "kinds", "own", "others").mapInArrow(close, f"page_id {kind}, url string, text string, n_chars long, n_lines long, n_shared long")
