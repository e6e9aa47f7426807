"""Main text of web pages: page differencing against the nearest URL, within what the markup allows.

Pages of one host are paired by URL path. The text lines of a pair are aligned
by a longest common subsequence; lines that both share are the site's own
furniture and are deleted. Where a page marks its article, the marks tell where
it is, and furniture that differs from page to page (adverts, menus of the day)
is left out by its markup; two pages may well share a paragraph of an article,
so of its lines those are deleted that most pages of the host share.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fill, small

#: A comment, a tag, a tag that is broken or breaks off, a declaration, text. Quotes end at the next "<" at
#: the latest, so that no input is read more than a few times.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>|</?[a-zA-Z][^<>]*(?:>|\Z)|<[!?/][^>]*>|[^<]+|<", re.S
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)")

#: Elements whose content is no page text; the parser looks for the end tag only.
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never part of an article.
FURNITURE = frozenset("nav footer aside form menu button select option dialog svg canvas object audio video head datalist fieldset".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words of a class, id or role that name furniture.
FURNITURE_WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner popup modal overlay "
    "cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup paywall "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar sidebars aside widget widgets toolbar topbar masthead "
    "header footer copyright legal share sharing social related recommended recommendations trending "
    "comment comments commentlist disqus reply replies respond discussion pagination pager search searchbox login form skip hidden "
    "complementary contentinfo dialog teaser teasers disclaimer announcement announcements".split()
)
#: The same as the beginning or the end of a word.
FURNITURE_BEGINS = ("advert", "sidebar", "cookie", "newsletter", "navbar", "breadcrumb", "subscri", "commentlist", "commentform")
FURNITURE_ENDS = ("nav", "menu", "sidebar", "banner", "comments", "footer", "popup", "toolbar")
#: Words that make a class a state of the page: "comments-open".
STATES = frozenset("open opened closed enabled disabled allowed on off".split())
#: Words beside which "header" names an article's own heading.
ARTICLE_WORDS = frozenset("article post entry story content title".split())
WORD_SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")

#: Elements that end where the next one begins, or where a list ends.
LOOSE = frozenset(("p", "li", "option", "dd", "dt", "tr", "td", "th"))
LISTS = frozenset("ul ol menu select datalist dl table tbody thead tfoot".split())

ARTICLE, BODY = 1, 2


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        name = m[1] or m[5]
        found.setdefault(name.lower(), unescape(next((x for x in (m[2], m[3], m[4]) if x is not None), "")))
    return found


def _is_furniture(name: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether an element's name or attributes name furniture; of an article only a class that begins so, and tells no state."""
    if name in FURNITURE:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return True
    if name in ("html", "body", "main"):
        return False
    if name == "article":
        names = [[w.lower() for w in WORD_SPLIT.split(n) if w] for k in ("class", "id", "role") for n in attributes.get(k, "").split()]
        return any(n and n[0] in FURNITURE_WORDS and n[-1] not in STATES for n in names)
    words = {w.lower() for k in ("class", "id", "role") for w in WORD_SPLIT.split(attributes.get(k, "")) if w}
    if name == "header" and not in_article:
        return not words & ARTICLE_WORDS
    named = words & FURNITURE_WORDS | {w for w in words if w.startswith(FURNITURE_BEGINS) or w.endswith(FURNITURE_ENDS)}
    if named <= {"header", "content"} and (in_article or words & ARTICLE_WORDS):
        return False
    return bool(named)


REGION = re.compile(r"<(?:article|main)(?=[\s/>])", re.I)
#: Elements that may hold a whole page.
HOLDERS = frozenset("div section form body center table tbody tr td span".split())


def _holds_region(html: str, pos: int, name: str) -> bool:
    """Whether an element that begins before pos holds an article or main element."""
    region = REGION.search(html, pos)
    if not region:
        return False
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])", re.I).finditer(html, pos, region.start()):
        depth += -1 if m[1] else 1
        if not depth:
            return False
    return True


def blocks_of(html: str, named: bool = True) -> list[tuple[int, str]]:
    """(zone, text) of the blocks that the markup doesn't name as furniture, in page order.

    An element that holds an article or main element is never furniture itself.
    Without `named`, attributes don't make furniture, only elements' names do.

    The zone is ARTICLE inside an article or, in a page without one, main
    element, and BODY elsewhere. White space in a block is one space; character
    references are decoded; a line break counts as white space.
    """
    out: list[tuple[str, str]] = []  # (innermost region, text)
    parts: list[str] = []
    regions: list[str] = []  # open article and main elements
    skip, depth = "", 0  # the furniture element that is open, and how many of its name
    within: list[str] = []  # articles that began inside it
    pos, end = 0, len(html)

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(("article" if "article" in regions else "main" if regions else "", text))

    while pos < end:
        m = TOKEN.match(html, pos)
        pos = m.end()
        name = m[2]
        if name is None:
            piece = m[0]
            if not skip and (piece[0] != "<" or piece == "<"):
                parts.append(unescape(piece) if "&" in piece else piece)
            continue
        name, closing = name.lower(), m[1] == "/"
        if skip and name != skip and (name in within if closing else name == "article"):
            if closing:
                within.remove(name)
            else:
                within.append(name)
            if skip != "p":
                continue
        if skip:
            ends = skip == "p" and name in BLOCK and name != "p" or skip in LOOSE and name == skip and not closing
            ends = ends or closing and name != skip and (name in ("body", "html") or name in regions or skip in LOOSE and name in LISTS)
            if not ends:
                if name == skip:
                    depth += -1 if closing else not m[3].endswith("/")
                    if not depth:
                        skip, within = "", []
                elif name in RAW and not closing:
                    pos = _raw_end(html, pos, name)
                continue
            skip, within = "", []
        if closing:
            if name in BLOCK:
                flush()
            if name in regions:
                while regions.pop() != name:
                    pass
            continue
        if name in RAW:
            pos = _raw_end(html, pos, name)
            parts.append(" ")
            continue
        if name in BLOCK:
            flush()
        elif name == "br":
            parts.append(" ")
        if name in VOID:
            continue
        if m[3].endswith("/") and name not in BLOCK:
            continue
        if name in FURNITURE or name == "header" or m[3]:
            furniture = _is_furniture(name, _attributes(m[3]) if m[3] and named else {}, "article" in regions)
            if furniture and not (name in HOLDERS and not regions and _holds_region(html, pos, name)):
                flush()
                skip, depth = name, 1
                continue
        if name in ("article", "main"):
            regions.append(name)
    flush()
    has_article = any(z == "article" for z, _ in out)
    inside = {"article"} if has_article else {"main"}
    return [(ARTICLE if z in inside else BODY, text) for z, text in out]


def _raw_end(html: str, pos: int, name: str) -> int:
    m = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, pos)
    return m.end() if m else len(html)


#: Bits of the alignment's table that are held at a time; larger ones are halved.
TABLE_BITS = 1 << 27


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each prefix of a, as bits over b: 0 where the common subsequence with b grows (Hyyro 2004)."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        met = row & places.get(x, 0)
        row = ((row + met) | (row - met)) & full
        yield row


def _grown(a: list[int], b: list[int]) -> np.ndarray:
    """The length of the common subsequence of a and each prefix of b."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of one longest common subsequence of a and b.

    A line of a is one operation on bits over b, whatever the lines are; tables
    beyond TABLE_BITS are halved (Hirschberg 1975), so memory is bounded.
    """
    lead = 0
    while lead < len(a) and lead < len(b) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found: list[int] = []
    parts = [(lead, a[lead : len(a) - tail], b[lead : len(b) - tail])]
    while parts:
        start, x, y = parts.pop()
        if not x or not y:
            continue
        if len(x) * len(y) > TABLE_BITS and len(x) > 1:
            half = len(x) // 2
            cut = int(np.argmax(_grown(x[:half], y) + _grown(x[half:][::-1], y[::-1])[::-1]))
            parts += [(start, x[:half], y[:cut]), (start + half, x[half:], y[cut:])]
            continue
        rows = [(1 << len(y)) - 1, *_rows(x, y)]
        i, j = len(x), len(y)
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            if rows[i] >> (j - 1) & 1:
                found.append(start + i)
                j -= 1
    return [*range(lead), *sorted(found), *range(len(a) - tail, len(a))]


def line_hash(text: str) -> int:
    from hashlib import blake2b

    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def page_blocks(html: str) -> list[tuple[int, str]]:
    """The blocks of a page; where the attributes name all of it furniture, they aren't heeded."""
    return blocks_of(html) or blocks_of(html, named=False)


def main_text(blocks: list[tuple[int, str]], shared: frozenset[int] | set[int]) -> str:
    """The article of a page from its blocks and the positions of those that its partner shares.

    Shared lines go, unless nothing else is left: then the page is a copy of its
    partner. A page that marks its article consists of that; there they stay
    where they are half of it or more.
    """
    marked = [(i, t) for i, (z, t) in enumerate(blocks) if z == ARTICLE]
    whole = marked or [(i, t) for i, (_, t) in enumerate(blocks)]
    own = [t for i, t in whole if i not in shared]
    return "\n".join(own if own and (not marked or 2 * len(own) > len(whole)) else [t for _, t in whole])


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each page, and whether it marks its article."""
    for batch in batches:
        blocks = [page_blocks(h.as_py()) for h in fill(batch.column(1))]
        marked = pa.array([any(z == ARTICLE for z, _ in own) for own in blocks], pa.bool_())
        hashes = pa.array([[line_hash(t) for _, t in own] for own in blocks], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), marked, hashes], names=["key", "marked", "lines"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = len(batch)
        columns = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "place"])
        at += n


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The positions of the lines that each page shares with its partner, and their hashes."""
    for batch in batches:
        lines = [x.as_py() or [] for x in batch.column(2)]
        found = [common_lines(a, b.as_py() or []) for a, b in zip(lines, batch.column(3), strict=True)]
        same = [[a[i] for i in at] for a, at in zip(lines, found, strict=True)]
        columns = [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32())), pa.array(same, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["own", "marked", "shared", "same"])


#: Pages of a host, and more than half of them, that share a line with their partners where it goes from marked articles.
VOTES = 3


def voted(found: DataFrame, keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(own, shared): of shared lines of marked pages those that most pages of the host share; found is what `_shared` gives."""
    each = F.explode(F.arrays_zip("shared", "same")).alias("x")
    hosts = keys.select(F.col("page_id").alias("own"), "host")
    at = found.where("marked").join(hosts, "own").select("own", "host", each).select("own", "host", F.col("x.shared").alias("at"), F.col("x.same").alias("line"))
    at = scratch.write(at, "at")
    many = at.select("host", "line", "own").distinct().groupBy("host", "line").agg(F.count("*").alias("many")).where(F.col("many") >= VOTES)
    votes = many.join(hosts.groupBy("host").agg(F.count("*").alias("pages")), "host").where("2 * many > pages").select("host", "line")
    return at.join(small(scratch.write(votes, "votes")), ["host", "line"]).groupBy("own").agg(F.collect_set("at").alias("shared"))


def nearest_pages(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id, partner) from (page_id, host, path): the closer neighbour in the order of the host's paths.

    Pages are ordered by one range sort, so a host of any size is spread over
    tasks; neighbours across tasks meet through their place in the whole order.
    """
    ordered = keys.repartitionByRange("host", "path", "page_id").sortWithinPartitions("host", "path", "page_id")
    ordered = scratch.write(ordered.mapInArrow(_numbered, "page_id long, host string, path string, part int, place long"), "ordered")
    sizes = sorted((r.part, r.n) for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row for each task
    first, total = [], 0
    for part, n in sizes:
        first.append((part, total))
        total += n
    if not total:
        return keys.sparkSession.createDataFrame([], "page_id long, partner long")
    offsets = F.broadcast(keys.sparkSession.createDataFrame(first, "part int, first long"))
    ranked = scratch.write(ordered.join(offsets, "part").select("page_id", "host", "path", (F.col("first") + F.col("place")).alias("rank")), "ranked")

    def beside(step: int, name: str) -> DataFrame:
        return ranked.select((F.col("rank") + step).alias("rank"), F.col("host").alias(f"{name}_host"), F.col("path").alias(f"{name}_path"), F.col("page_id").alias(name))

    near = ranked.join(beside(1, "before"), "rank", "left").join(beside(-1, "after"), "rank", "left")
    for name in ("before", "after"):
        near = near.withColumn(f"{name}_far", F.when(F.col(f"{name}_host") == F.col("host"), F.levenshtein("path", f"{name}_path")))
    nearer = F.col("after_far").isNull() | (F.col("before_far") <= F.col("after_far"))
    partner = F.when(F.col("before_far").isNotNull() & nearer, F.col("before")).when(F.col("after_far").isNotNull(), F.col("after"))
    return near.select("page_id", partner.alias("partner")).where("partner is not null")


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages.

    A null page is empty; a page without a URL has no partner, and pages
    alone on their host have none either. Blocks are joined by one line feed;
    nothing is capped. Rows of one id are pages each by itself, known by a hash of
    all three columns; rows that are alike in all are one page to its
    neighbours and have the same text. Other columns are ignored. An empty table gives an empty
    result.
    """
    scratch = Scratch(pages.sparkSession, "pages")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("key", F.xxhash64(F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "url", "html"))
    host = F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)
    keys = rows.where("url is not null").select(F.col("key").alias("page_id"), host.alias("host"), path.alias("path")).where("host <> ''")
    keys = keys.dropDuplicates(["page_id"])
    pairs = scratch.write(nearest_pages(keys, scratch), "pairs")
    lines = scratch.write(rows.select("key", "html").mapInArrow(_line_hashes, "key long, marked boolean, lines array<long>"), "lines")
    own = lines.select(F.col("key").alias("page_id"), "marked", "lines").dropDuplicates(["page_id"])
    other = lines.select(F.col("key").alias("partner"), F.col("lines").alias("theirs")).dropDuplicates(["partner"])
    both = pairs.join(own, "page_id").join(other, "partner").select("page_id", "marked", "lines", "theirs")
    found = both.mapInArrow(_shared, "own long, marked boolean, shared array<int>, same array<long>").where("size(shared) > 0")
    found = scratch.write(found, "found")
    shared = scratch.write(found.where("not marked").select("own", "shared").union(voted(found, keys, scratch)), "shared")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page_blocks(h.as_py()), set(s.as_py() or ())) for h, s in zip(fill(batch.column(2)), batch.column(3), strict=True)]
            count = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), count], names=["page_id", "url", "text", "n_chars"])

    joined = rows.join(shared, rows["key"] == shared["own"], "left").select("page_id", "url", "html", "shared")
    return joined.mapInArrow(cut, "page_id long, url string, text string, n_chars long")
