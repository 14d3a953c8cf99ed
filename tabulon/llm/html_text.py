"""Main text of web pages, by differencing each page with the nearest page of its host.

Every page becomes blocks of text with a role: inside an article or main element, inside a container that says that it
is something else (menu, footer, advert, form, comment ...), or neither. Pages of a host are put in the order of their
URL paths; each is paired with the neighbour of different content whose path shares the longest beginning (copies of a
page that follow each other are skipped: contents are equal where all blocks are that no container says is something
else). The blocks of both are aligned by their longest common subsequence and shared blocks are deleted, unless they
stand inside a declared article (a copy or quotation of an article elsewhere on the host is still its text). Blocks of
containers that say that they are something else go too. Blocks beside an article stay if the neighbour does not have
them.

The order is made by a range partitioning of keys alone, so that a host with a third of all pages is spread over tasks;
alignment moves hashes of blocks, not texts.

A null html or one without text gives an empty text; pages without a URL share one nameless host; repeated rows are
copies of each other and give equal results; an empty table gives an empty one; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import html as entities
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import arrow_schema, stage, text_slices

OTHER, MAIN, DROP = 0, 1, 2
#: Dropped for a name alone, outside an article: an article inside it starts afresh.
NAMED = 3
#: Pages with shared blocks and such blocks that are broadcast at most; more of them are joined by a shuffle of the texts.
BROADCAST_NUMBERS = 4_000_000
#: Elements that end a block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text.
NOT_TEXT = frozenset("aside button dialog footer form head iframe menu nav noscript object option search select svg template textarea title video audio canvas".split())
#: Whole names of class, id or role that say so.
NOT_TEXT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar aside comment comments disqus cookie cookies consent gdpr notice notices alert banner "
    "menu nav navbar navigation breadcrumb breadcrumbs footer contentinfo complementary popup modal overlay newsletter subscribe signup social share sharing related recommended widget search pagination pager toolbar "
    "cookie-notice cookie-banner cookie-consent nav-bar nav-menu site-nav site-footer share-buttons social-share related-posts comment-list".split()
)
#: What a starting element ends, and the elements that such an end does not pass ("" stands for all blocks
#: but address, div, p and the parts of lists).
ENDS = {"li": (("li",), ""), "dt": (("dt", "dd"), ""), "dd": (("dt", "dd"), ""), "tr": (("tr",), "table"), "td": (("td", "th"), "table"), "th": (("td", "th"), "table"), "option": (("option",), "select")}
PASSED = frozenset("address div p li dt dd".split())
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<[/a-zA-Z][^>]*(?:>|\Z)",  # quotes that do not end
    re.S | re.I,
)
NAMING = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


def is_dropped(tag: str, attributes: str, in_article: bool) -> int:
    """DROP or NAMED where the element says that it is something else, or 0. In an article an id is an anchor; a heading's
    names tell of its text."""
    if tag in NOT_TEXT or tag == "header" and not in_article:
        return DROP
    if not attributes or tag in ("html", "body") or tag in ("article", "main") and "comment" not in attributes.lower():
        return 0
    if HIDDEN.search(re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)) or re.search(r"display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", attributes, re.I):
        return DROP
    if tag in HEADINGS:
        return 0
    names = {x for kind, a, b, c in NAMING.findall(attributes) if not (in_article and kind.lower() == "id") for x in (a or b or c).lower().split()}
    return 0 if NOT_TEXT_WORDS.isdisjoint(names) else DROP if in_article or tag in ("article", "main") else NAMED


def role_inside(role: int, tag: str, attributes: str) -> int:
    """The role inside an element that stands in ``role``."""
    if role == DROP:
        return DROP
    article = tag in ("article", "main") or 'role="main"' in attributes
    return is_dropped(tag, attributes, role == MAIN) or (MAIN if role == MAIN or article else role)


class Open:
    """The open elements of a page, each with the role inside it."""

    def __init__(self):
        self.elements: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}  # of each tag
        self.walls: list[int] = []  # places of blocks
        self.stops: list[int] = []  # places of blocks that no list item's end passes

    @property
    def role(self) -> int:
        return self.elements[-1][1] if self.elements else OTHER

    def push(self, tag: str, role: int) -> None:
        at = len(self.elements)
        self.elements.append((tag, role))
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCKS or tag in NOT_TEXT:
            self.walls.append(at)
            if tag not in PASSED:
                self.stops.append(at)

    def cut(self, size: int) -> None:
        while len(self.elements) > size:
            self.places[self.elements.pop()[0]].pop()
        for places in (self.walls, self.stops):
            while places and places[-1] >= size:
                places.pop()

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def end(self, tag: str) -> None:
        """An end tag; that of an inline element does not leave a block."""
        at = self.last(tag)
        if at >= 0 and (tag in BLOCKS or tag in NOT_TEXT or not self.walls or at > self.walls[-1]):
            self.cut(at)

    def before(self, tag: str) -> None:
        """What a start tag ends: a block ends a paragraph that is the innermost block, an item the item before it."""
        if tag in BLOCKS and self.walls and self.last("p") == self.walls[-1]:
            self.cut(self.walls[-1])
        if tag in ENDS:
            tags, stop = ENDS[tag]
            at = self.last(*tags)
            if at > (self.last(stop) if stop else self.stops[-1] if self.stops else -1):
                self.cut(at)


def blocks_of(page: str) -> list[tuple[str, int]]:
    """(text, role) of a page's blocks in page order."""
    found: list[tuple[str, int]] = []
    open_, role = Open(), OTHER
    text: list[str] = []

    def flush() -> None:
        if text:
            block = " ".join("".join(text).split())
            if block:
                found.append((block, min(role, DROP)))
            text.clear()

    at = 0
    for m in TAG.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(entities.unescape(piece) if "&" in piece else piece)
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCKS or tag in NOT_TEXT:
            flush()
        if m[2]:
            open_.end(tag)
            inner = open_.role
        else:
            open_.before(tag)
            inner = open_.role
            if tag not in VOID and not m[4].endswith("/"):
                inner = role_inside(inner, tag, m[4])
                open_.push(tag, inner)
        if inner != role:
            flush()
        role = inner
    piece = page[at:]
    text.append(entities.unescape(piece) if "&" in piece else piece)
    flush()
    return found


def _lengths(a: list[int], b: list[int]) -> list[int]:
    """Lengths of the longest common subsequences of ``a`` and each beginning of ``b``, by bit-parallel rows over b."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    out, n = [0], 0
    for j in range(len(b)):
        n += not row >> j & 1
        out.append(n)
    return out


def common_subsequence(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence, in linear memory (divide and conquer over ``a``)."""
    def solve(lo: int, hi: int, left: int, right: int) -> Iterator[int]:
        while lo < hi and left < right and a[lo] == b[left]:
            yield lo
            lo, left = lo + 1, left + 1
        tail = []
        while lo < hi and left < right and a[hi - 1] == b[right - 1]:
            hi, right = hi - 1, right - 1
            tail.append(hi)
        if lo < hi and left < right:
            if hi - lo == 1:
                if a[lo] in b[left:right]:
                    yield lo
            else:
                mid = (lo + hi) // 2
                first = _lengths(a[lo:mid], b[left:right])
                second = _lengths(a[mid:hi][::-1], b[left:right][::-1])
                at = max(range(right - left + 1), key=lambda j: first[j] + second[right - left - j])
                yield from solve(lo, mid, left, left + at)
                yield from solve(mid, hi, left + at, right)
        yield from reversed(tail)

    both = {*a} & {*b}
    places = [i for i, x in enumerate(a) if x in both]
    a, b = [a[i] for i in places], [x for x in b if x in both]
    return [places[i] for i in solve(0, len(a), 0, len(b))]


LINES = T.StructType([
    T.StructField("row", T.LongType()),
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("host", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("blocks", T.ArrayType(T.StringType())),
    T.StructField("roles", T.ArrayType(T.IntegerType())),
    T.StructField("hashes", T.ArrayType(T.LongType())),
])
ORDERED = T.StructType([
    T.StructField("row", T.LongType()),
    T.StructField("host", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("content", T.LongType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("run", T.LongType()),
    T.StructField("last", T.StructType([T.StructField("row", T.LongType()), T.StructField("path", T.StringType())])),
    T.StructField("next", T.StructType([T.StructField("row", T.LongType()), T.StructField("path", T.StringType())])),
])
SHARED = T.StructType([T.StructField("row", T.LongType()), T.StructField("shared", T.ArrayType(T.IntegerType()))])


def split_url(url: str) -> tuple[str, str]:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)([^?#]*)", url or "")
    return (m[1].lower(), m[2]) if m else ("", url or "")


def extract_lines(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    out = arrow_schema(LINES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in text_slices(batches, "html"):
            rows = []
            for key, link, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                blocks = blocks_of(page or "")
                hashes = [int.from_bytes(hashlib.blake2b(b.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) for b, _ in blocks]
                rows.append((row, key, link, *split_url(link), [b.encode("utf-8", "replace").decode() for b, _ in blocks], [r for _, r in blocks], hashes))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return own.mapInArrow(run, LINES)


def nearest(lines: DataFrame) -> DataFrame:
    """(row, partner): the neighbour of other content in the order of (host, path) that shares the longest beginning of the
    path. Pages of equal content that follow each other are a run; all of a run have the same two neighbours."""
    out = arrow_schema(ORDERED)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, run, last = TaskContext.get().partitionId(), 0, [], None

        def done(next_: dict | None) -> Iterator[pa.RecordBatch]:
            sides = [None if x is None or x["host"] != run[0]["host"] else {"row": x["row"], "path": x["path"]} for x in (last, next_)]
            for at in range(0, len(run), 10_000):
                made.extend({**x, "part": part, "run": n, "last": sides[0], "next": sides[1]} for x in run[at : at + 10_000])
                if len(made) >= 10_000:
                    yield pa.RecordBatch.from_pylist(made, schema=out)
                    made.clear()

        made: list[dict] = []
        for batch in batches:
            for x in batch.to_pylist():
                if run and (run[0]["host"], run[0]["content"]) != (x["host"], x["content"]):
                    yield from done(x)
                    last, n, run = run[-1], n + 1, []
                run.append(x)
        if run:
            yield from done(None)
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=out)

    spoken = F.filter(F.arrays_zip("hashes", "roles"), lambda x: x["roles"] != DROP)
    keys = lines.select("row", "host", "path", F.xxhash64(F.transform(spoken, lambda x: x["hashes"])).alias("content"))
    ordered = stage(keys.repartitionByRange("host", "path", "row").sortWithinPartitions("host", "path", "row").mapInArrow(neighbours, ORDERED), "ordered")
    ends = ordered.groupBy("part").agg(
        F.max("run").alias("runs"), *(f(F.struct("host", "content", "row", "path", "last", "next"), F.struct("host", "path", "row")).alias(name) for name, f in (("first", F.min_by), ("final", F.max_by)))
    )
    ends = sorted(ends.collect(), key=lambda x: x["part"])  # a row a partition

    def beyond(i: int, step: int) -> tuple | None:
        """The page of other content next to a range's first (step -1) or last run, in the ranges before or after it."""
        own = ends[i]["first" if step < 0 else "final"]
        near, side = ("final", "last") if step < 0 else ("first", "next")
        while 0 <= (i := i + step) < len(ends):
            x = ends[i][near]
            if x["host"] != own["host"]:
                return None
            if x["content"] != own["content"]:
                return x["row"], x["path"]
            if ends[i]["runs"]:
                return x[side]
        return None

    kind = "struct<row: long, path: string>"
    borders = lines.sparkSession.createDataFrame([(x["part"], x["runs"], beyond(i, -1), beyond(i, 1)) for i, x in enumerate(ends)], f"part int, runs long, before {kind}, after {kind}")
    both = ordered.join(F.broadcast(borders), "part").select(
        "row", "path", F.when(F.col("run") == 0, F.col("before")).otherwise(F.col("last")).alias("last"), F.when(F.col("run") == F.col("runs"), F.col("after")).otherwise(F.col("next")).alias("next")
    )

    def beginning(c: str):
        """Characters that two paths share at their beginning."""
        letters = F.sequence(F.lit(1), F.greatest(F.length("path"), F.lit(1)))
        differs = F.filter(letters, lambda i: F.substring(F.col("path"), i, F.lit(1)) != F.substring(F.col(c), i, F.lit(1)))
        return F.when(F.col(c).isNull(), -1).otherwise(F.coalesce(F.try_element_at(differs, F.lit(1)) - 1, F.length("path")))

    partner = F.when(beginning("next.path") > beginning("last.path"), F.col("next.row")).otherwise(F.col("last.row"))
    return both.select("row", partner.alias("partner")).filter("partner is not null")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, blocks shared with the nearest page (shared), of every page."""
    lines = stage(extract_lines(pages, page_id, url, html), "lines")
    own, other = lines.select("row", "hashes", "roles"), lines.select(F.col("row").alias("partner"), F.col("hashes").alias("other"))
    out = arrow_schema(SHARED)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, a, roles, b in zip(*(batch.column(c).to_pylist() for c in ("row", "hashes", "roles", "other"))):
                shared = [i for i in common_subsequence(a, b) if roles[i] != MAIN]
                if shared:
                    rows.append((row, shared))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    shared = stage(nearest(lines).join(own, "row").join(other, "partner").select("row", "hashes", "roles", "other").mapInArrow(align, SHARED), "shared")
    size = shared.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("shared")), F.lit(0)).alias("blocks")).first()
    if size["rows"] + size["blocks"] <= BROADCAST_NUMBERS:  # else both sides are shuffled
        shared = F.broadcast(shared)
    kept = F.filter("blocks", lambda x, i: (F.get("roles", i) != DROP) & ~F.array_contains(F.coalesce("shared", F.array().cast("array<int>")), i))
    done = lines.drop("hashes", "host", "path").join(shared, "row", "left").withColumn("text", F.array_join(kept, "\n"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.size(F.coalesce("shared", F.array())).alias("n_shared"))
