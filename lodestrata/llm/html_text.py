"""Main text of web pages, by nearest-URL page differencing and by element roles.

Each page is parsed into text blocks; blocks in navigation, header, footer,
sidebar, notice, advert, form or comment elements go by their role. Pages are
ordered by host and URL path over the cluster (by ranges of keys, so that one
large host is many partitions; the pages at the edge of a range also go to its
neighbour). Each page is compared with the pages next to it on its host: their
blocks are aligned by longest common subsequence.

What a page shares with the nearest page goes, as the site's template. Two
things are told apart from it. Pages that share most of what is left of them are
copies, and lose nothing by that. And a line inside an article element goes only
if all pages around have it, four at least, and only while less than half of the
article goes this way: articles quote and share passages, so one or two
witnesses do not do.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, released

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|template|iframe|svg|math|object|select)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>"
    r"|<[!?][^>]*+>",
    re.S | re.I,
)
#: A comment or an element of raw text that is never closed hides what follows.
_HIDES, _ENDED = re.compile("<!--|<[a-zA-Z]"), re.compile(r"(?:-->|</[a-zA-Z]+\s*>)\Z")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never part of an article's text.
_AWAY = frozenset("nav header footer aside form button menu dialog head canvas audio video".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class or id that mark such content, whole or as parts between separators.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side rail widget widgets header masthead footer comment comments disqus replies reply respond discussion share sharing social related recommended pagination pager toolbar search skip".split()
)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
#: Elements that a start tag ends if they are open, and what they are not looked for beyond.
_ENDS = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist"),
    "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    **dict.fromkeys("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split(), ("p", "td th table caption button template")),
}
_ENDS = {k: (tuple(a.split()), tuple(b.split())) for k, (a, b) in _ENDS.items()}
#: Pages that share at least this part of what they have beside the template are copies.
COPY_SHARE = 0.5
#: A page that the template covers to this part is a copy too.
WHOLE_SHARE = 0.9
#: Pages on each side that are asked for a line of an article, and how many there must be.
AROUND, WITNESSES = 4, 4


@dataclass(frozen=True)
class Block:
    text: str
    away: bool
    article: bool


def _is_away(name: str, attrs: str) -> bool:
    if name in _AWAY:
        return True
    if "=" not in attrs and "hidden" not in attrs or name in ("html", "body", "article", "main"):
        return False
    for key, *values in _ATTR.findall(attrs):
        value = next((v for v in values if v), "")
        key = key.lower()
        if key in ("class", "id"):
            for word in _SPACE.split(value):
                if not _MARKS.isdisjoint(_PART.split(_CAMEL.sub("-", word).lower())):
                    return True
        elif key == "role" and value.strip().lower() in _ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        elif key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


class _Open:
    """The open elements. Where an element of a name lies is known without a search, at any depth."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool]] = []
        self.at: dict[str, list[int]] = defaultdict(list)

    def last(self, *names: str) -> int:
        """The place of the innermost open element of these names, or -1."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def push(self, name: str, away: bool, article: bool) -> None:
        self.at[name].append(len(self.stack))
        self.stack.append((name, away, article))

    def cut(self, place: int) -> tuple[bool, bool]:
        """Close what is open from ``place`` on; what holds then (away, article)."""
        while len(self.stack) > place:
            self.at[self.stack.pop()[0]].pop()
        return self.stack[-1][1:] if self.stack else (False, False)


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order; a null page has none.

    List items, table cells, options and paragraphs end where HTML says that they
    do, other unclosed elements where an element around them ends; an article or
    main element also ends any unclosed marked element before it that is not
    around it by its own end tag. Elements may lie as deep as they like.
    """
    page = page or ""
    out: list[Block] = []
    open_ = _Open()
    away = article = False
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append(Block(text, away, article))

    at = 0
    hidden = False
    closes: dict[str, int] = {}

    def closed_after(name: str, place: int) -> bool:
        if name not in closes:
            closes[name] = max((x.start() for x in re.finditer(rf"</{name}\s*>", page, re.I)), default=-1)
        return closes[name] > place

    # no tag begins after the last one's end
    for m in _TOKEN.finditer(page, 0, page.rfind(">") + 1):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            hidden = _HIDES.match(m.group()) is not None and not _ENDED.search(m.group())
            if m["raw"] and m["raw"].lower() in ("title", "textarea", "select", "iframe"):
                flush()
            continue
        name = name.lower()
        if m["end"]:
            if name not in _INLINE:
                flush()
            place = open_.last(name)
            if place >= 0 and not (name in _INLINE or name == "p") or place > open_.last("article", "main", "body"):
                away, article = open_.cut(place)
            continue
        if name not in _INLINE:
            flush()
        if name in _ENDS:
            ended, beyond = _ENDS[name]
            place = min((x for x in (open_.last(n) for n in ended) if x > open_.last(*beyond)), default=-1)
            if place >= 0:
                away, article = open_.cut(place)
        if name in _VOID:
            continue
        if name in ("article", "main") and away:
            # an advert or menu that was never closed does not swallow the article
            while open_.stack and open_.stack[-1][1] and not closed_after(open_.stack[-1][0], m.start()):
                away, article = open_.cut(len(open_.stack) - 1)
        # an article's own header holds its title
        away = away or not (article and name == "header") and _is_away(name, m["attrs"] or "")
        article = article or name == "article"
        open_.push(name, away, article)
    if not hidden:
        parts.append(page[at:].partition("<!--")[0])
    flush()
    return out


def common_subsequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence.

    Lines that both ends share, and lines that only one side has, are set aside.
    For the rest, row i of the table of lengths is one integer with a bit for
    each line of b, so that a row costs a few operations on long integers
    (repeated lines cost no more than others). Rows are kept at intervals and
    made again for the way back, so that memory grows with the root of the table.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    both = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    rows = [i for i in range(head, len(a) - tail) if a[i] in both]
    cols = [j for j in range(head, len(b) - tail) if b[j] in both]
    places: dict[str, list[int]] = defaultdict(list)
    for k, j in enumerate(cols):
        places[b[j]].append(k)
    every = (1 << len(cols)) - 1
    masks: dict[str, int] = {}

    def mask(line: str) -> int:
        if line in masks:
            return masks[line]
        raw = bytearray(len(cols) // 8 + 1)
        for k in places[line]:
            raw[k >> 3] |= 1 << (k & 7)
        made = int.from_bytes(raw, "little")
        if len(places[line]) * 1000 >= len(cols):  # a thousand lines at most are this common
            masks[line] = made
        return made

    def step(v: int, i: int) -> int:
        u = v & mask(a[rows[i]])
        return ((v + u) | (v - u)) & every

    every_rows = max(256, math.isqrt(len(rows)))
    kept, v = [every], every
    for i in range(len(rows)):
        v = step(v, i)
        if (i + 1) % every_rows == 0:
            kept.append(v)
    middle = []
    j = len(cols)
    for block in range((len(rows) - 1) // every_rows, -1, -1):
        first = block * every_rows
        table = [kept[block]]
        for i in range(first, min(len(rows), first + every_rows)):
            table.append(step(table[-1], i))
        # a zero bit: one more line is common up to this column; the row where it first is zero has the match
        i = len(table) - 1
        while i and j:
            if table[i] >> (j - 1) & 1:
                j -= 1
            elif (table[i - 1] >> (j - 1) & 1) == 0:
                i -= 1
            else:
                i, j = i - 1, j - 1
                middle.append((rows[first + i], cols[j]))
    return [(i, i) for i in range(head)] + middle[::-1] + [(len(a) - 1 - k, len(b) - 1 - k) for k in range(tail - 1, -1, -1)]


def common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def template(own: list[Block], near: list[set[int]], around: list[frozenset[str]]) -> set[int]:
    """The indices of the template's blocks: ``near`` has what is shared with the nearest page, then with the page on the other side, ``around`` the lines of all pages around."""
    size = lambda ids: sum(len(own[i].text) for i in ids)
    every = set(range(len(own)))
    twice = near[0] & near[1] if len(near) > 1 else set()
    if size(twice) >= WHOLE_SHARE * size(every):
        twice = set()
    once = near[0] - twice if near else set()
    if size(once) >= COPY_SHARE * size(every - twice):
        once = set()
    article = {i for i in every if own[i].article}
    inside = {i for i in twice & article if all(own[i].text in x for x in around)} if len(around) >= WITNESSES else set()
    if 2 * size(inside) >= size(article):
        inside = set()
    return inside | ((twice | once) - article)


def _text(own: list[Block], near: list[set[int]], around: list[frozenset[str]]) -> str:
    gone = template(own, near, around)
    whole = any(b.article for b in own)
    return "\n".join(b.text for i, b in enumerate(own) if i not in gone and (b.article or not whole))


def main_text(own: list[Block], *near: list[Block] | None) -> str:
    """The page's article, from its unmarked blocks and what others share with it: the nearest page, the page on the other side, then any pages around.

    Where a page has an article element, its text lies there; else it is all that is left.
    """
    own, *others = ([b for b in page if not b.away] for page in (own, *near) if page is not None)
    texts = [b.text for b in own]
    shared = [{i for i, _ in common_subsequence(texts, [b.text for b in other])} for other in others[:2]]
    return _text(own, shared, [frozenset(b.text for b in other) for other in others])


def _packed(page: str | None) -> bytes:
    """The unmarked blocks of a page."""
    lines = ("+-"[b.article] + b.text for b in blocks(page) if not b.away)
    return zstandard.ZstdCompressor(level=3).compress("\n".join(lines).encode("utf-8", "surrogatepass"))


def _unpacked(raw: bytes) -> list[Block]:
    text = zstandard.ZstdDecompressor().decompress(raw).decode("utf-8", "surrogatepass")
    return [Block(x[1:], False, x[0] == "-") for x in text.split("\n")] if text else []


@dataclass
class _Page:
    host: object
    path: str
    blocks: list[Block]
    wanted: bool
    page: object
    #: What this page shares with the one before and the one after it; None where that is on another host.
    before: set[int] | None = None
    after: set[int] | None = None

    def __post_init__(self) -> None:
        self.lines = frozenset(b.text for b in self.blocks)


def along(pages: Iterator[tuple]) -> Iterator[tuple]:
    """(page, text) of each of (host, path, packed blocks, is it to be returned, page) in order of host and path.

    A page's neighbours are the pages before and after it on the same host; the one
    whose path has more in common with its own is the nearest, at a tie the one before.
    """
    held: list[_Page] = []

    def done(k: int) -> tuple:
        now = held[k]
        sides = [(common_prefix(held[j].path, now.path), j < k, shared) for j, shared in ((k - 1, now.before), (k + 1, now.after)) if shared is not None]
        around = [x.lines for j, x in enumerate(held[max(0, k - AROUND) : k + AROUND + 1], max(0, k - AROUND)) if j != k and x.host == now.host]
        return now.page, _text(now.blocks, [x[2] for x in sorted(sides, key=lambda x: x[:2], reverse=True)], around)

    for host, path, raw, wanted, page in pages:
        new = _Page(host, path, _unpacked(raw), wanted, page)
        if held and held[-1].host == host:
            found = common_subsequence([b.text for b in held[-1].blocks], [b.text for b in new.blocks])
            held[-1].after, new.before = {i for i, _ in found}, {j for _, j in found}
        held.append(new)
        if len(held) > 2 * AROUND + 1:
            held.pop(0)
        if len(held) > AROUND and held[-1 - AROUND].wanted:
            yield done(len(held) - 1 - AROUND)
    for k in range(max(0, len(held) - AROUND), len(held)):
        if held[k].wanted:
            yield done(k)


#: Ranges of keys at most; a few keys of each are on the driver.
RANGES = 50_000


def _ranges(keys: DataFrame, names: list[str], parts: int) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """The first keys of ranges of about equal size, in order, and the other ranges that a key near an end also goes to; keys are (host, path, id), a null id first."""
    number = f"{OWN}range"
    schema = keys.select(*names).withColumn(number, F.lit(0)).schema

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        n = 0
        for b in batches:
            n += b.num_rows
            t = pa.Table.from_batches([b])
            low = t.slice(0, AROUND) if low is None else low if low.num_rows == AROUND else pa.concat_tables([low, t]).slice(0, AROUND)
            high = t if high is None else pa.concat_tables([high, t])
            high = high.slice(max(0, high.num_rows - AROUND)).combine_chunks()
        if n:
            if n < 2 * AROUND:
                high = high.slice(high.num_rows - max(0, n - low.num_rows)) if n > low.num_rows else high.slice(0, 0)
            rows = pa.concat_tables([low, high])
            own = pa.array([TaskContext.get().partitionId()] * rows.num_rows, pa.int32())
            yield from rows.append_column(pa.field(number, pa.int32(), False), own).combine_chunks().to_batches()

    rows = keys.select(*names).repartitionByRange(parts, *names).sortWithinPartitions(*names).mapInArrow(released(ends), schema).collect()
    found: dict[int, list[tuple]] = defaultdict(list)
    for *key, own in rows:
        found[own].append(_key(*key))
    edges = sorted(sorted(x) for x in found.values())
    flat = [(key, k) for k, x in enumerate(edges) for key in x]
    extra: dict[tuple, set[int]] = defaultdict(set)
    at = 0
    for k, x in enumerate(edges):
        for key, other in (*flat[max(0, at - AROUND) : at], *flat[at + len(x) : at + len(x) + AROUND]):
            extra[key].add(k)
        at += len(x)
    return [x[0] for x in edges], {k: sorted(v) for k, v in extra.items()}


def _key(host: str, path: str, id: object) -> tuple:
    return host, path, (id is not None, id if id is not None else 0)


def with_main_text(pages: DataFrame, id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text) for every row; a page without text has an empty one.

    A null or empty page has an empty text, a null URL is one more host, a null id
    comes first among equal URLs, and repeated rows stay, each compared with the
    other. Other columns are not read. The result does not depend on how pages are
    dealt: ranges of keys come from one pass over the URLs alone, and the first and
    the last pages of a range also go to the ranges next to it. Nine pages in a row
    are held at once, whole.
    """
    host, path, tie, part, own, packed = (f"{OWN}{x}" for x in ("host", "path", "tie", "part", "own", "packed"))
    low = F.lower(F.coalesce(F.col(url), F.lit("")))
    keyed = pages.select(F.col(id), F.col(url), F.col(page), F.regexp_extract(low, r"^[a-z]+://([^/?#]*)", 1).alias(host), F.regexp_replace(F.regexp_extract(low, r"^(?:[a-z]+://[^/?#]*)?([^?#]*)", 1), r"(?:\.html?|/)+$", "").alias(path))
    names = [host, path, id]
    parts = min(RANGES, max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), pages.rdd.getNumPartitions()))
    ranges = pages.sparkSession.sparkContext.broadcast(_ranges(keyed, names, parts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, extra = ranges.value
        for b in batches:
            rows, to, mine, raw = [], [], [], []
            for i, (h, p, x, text) in enumerate(zip(*(b.column(c) for c in (host, path, id, page)))):
                key = _key(h.as_py(), p.as_py(), x.as_py())
                at = bisect_right(firsts, key) - 1
                made = _packed(text.as_py())
                for other in (at, *extra.get(key, ())):
                    rows.append(i)
                    to.append(other)
                    mine.append(other == at)
                    raw.append(made)
            kept = b.select([id, url, host, path, tie]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(to, pa.int32()), pa.array(mine, pa.bool_()), pa.array(raw, pa.binary())], [*kept.schema.names, part, own, packed])

    head = keyed.withColumn(tie, F.xxhash64(page))
    shape = head.select(id, url, host, path, tie, F.lit(0).alias(part), F.lit(True).alias(own), F.lit(b"").alias(packed)).schema
    dealt = head.mapInArrow(released(deal), shape).repartition(parts, part).sortWithinPartitions(part, host, path, id, tie, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []

        def rows() -> Iterator[tuple]:
            for b in batches:
                types[:] = [b.schema.field(c).type for c in (id, url)]
                for r in zip(*(b.column(c) for c in (part, host, path, packed, own, id, url))):
                    at, h, p, raw, mine, *page_ = (x.as_py() for x in r)
                    # pages of two ranges are no neighbours
                    yield (at, h), p, raw, mine, page_

        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*held))
            held.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types)), pa.array(cols[2], pa.string())], [id, url, "text"])

        size = 0
        for (i, u), text in along(rows()):
            held.append((i, u, text))
            size += len(text)
            if len(held) >= 500 or size >= 4_000_000:
                yield batch()
                size = 0
        if held:
            yield batch()

    return dealt.mapInArrow(released(run), pages.select(id, url, F.lit("").alias("text")).schema)
