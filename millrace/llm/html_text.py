"""Operator 4: main text of web pages by nearest-URL page differencing.

Pages are sorted by host and URL path; each is paired with the neighbour of its host that shares the
longer path prefix, their text lines (blocks) are aligned by a longest common subsequence, and shared
lines are deleted. Differencing alone cannot tell a page's own advert from its article, nor an article
passage that two pages share from a menu. So lines carry a zone read from the markup, which settles
those two cases only: shared lines inside <article> or <main> are protected, and of the lines that are
not shared those of menus, headers, footers, sidebars, notices, adverts, forms and reader comments go.
(README: choice of method, with the number of lines that each decides.)

Neighbours are found by a sort over ranges of (host, path, page_id) with the edge rows of each range
copied to the next, so a host with most pages is dealt out like any other.

Edge cases: null html is an empty page with empty text; a null url has the empty host and path; pages
cut off in the middle of a tag, comment or character reference are read up to there; a page alone on
its host is not differenced; pages whose lines are all shared keep them, as nothing tells them apart;
rows that repeat a page_id give repeated results; extra columns are left out; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

OPEN, MAIN, CHROME = 0, 1, 2

# Elements whose content is never text, containers, blocks, and names of page furniture.
RAW = frozenset("script style noscript template svg math iframe object canvas audio video title textarea select option button datalist head-only".split())
FURNITURE = frozenset("nav header footer aside form menu dialog".split())
CONTAINERS = frozenset("html body main article section div nav header footer aside form menu dialog ul ol dl table thead tbody tfoot fieldset blockquote figure details center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption figcaption pre hr address summary legend".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promotion banner "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars aside rail masthead topbar toolbar "
    "header footer foot copyright legal colophon share sharing social related recommended recommendations newsletter subscribe subscription signup login widget widgets "
    "comment comments commentlist disqus respond replies".split()
)
OWN = frozenset("article content main entry story body text post".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form alertdialog".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_PART = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _furniture(tag: str, attributes: str) -> bool:
    """Whether an element is page furniture by its class, id or role."""
    if "=" not in attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next(filter(None, values), "")
        if name.lower() == "role":
            if value.lower() in ROLES:
                return True
            continue
        for one in value.split():
            parts = _PART.findall(_CAMEL.sub(" ", one).lower())
            found = NAMES.intersection(parts)
            if found and not (found <= {"header", "text", "notice", "legal"} and OWN.intersection(parts)):
                return True
    return False


def lines(html: str) -> list[tuple[str, int]]:
    """(text, zone) of each block with text, in page order."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []  # containers with the zone inside them
    zone, own, skip, held, at = OPEN, None, "", [], 0

    def flush() -> None:
        text = " ".join(unescape("".join(held)).split())
        if text:
            out.append((text, zone if own is None else own))
        held.clear()

    while at < len(html):
        if skip:  # raw text ends with its own end tag only
            end = re.compile(rf"</{re.escape(skip)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
            at, skip = (end.end() if end else len(html)), ""
            continue
        found = _TAG.search(html, at)
        if not found:
            tail = html[at:]
            cut = re.search(r"<[/!?a-zA-Z]?[^<>]*\Z", tail) if re.search(r"<[/!?a-zA-Z][^<>]*\Z", tail) else None
            held.append(tail[: cut.start()] if cut else tail)
            break
        held.append(html[at : found.start()])
        at = found.end()
        closing, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW:
            if not closing and not (attributes or "").rstrip().endswith("/"):
                skip = name
            continue
        if name == "br":
            held.append(" ")
            continue
        if name not in BLOCKS:
            if not closing and name == "head":
                continue
            held.append("")
            continue
        flush()
        own = None
        if name in CONTAINERS:
            if closing:
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
                if k is not None:
                    del stack[k:]
            elif not attributes.rstrip().endswith("/"):
                inner = zone
                if zone != CHROME:
                    if name in ("article", "main"):
                        inner = MAIN
                    elif (name in FURNITURE and not (name == "header" and zone == MAIN)) or _furniture(name, attributes):
                        inner = CHROME
                stack.append((name, inner))
            zone = stack[-1][1] if stack else OPEN
        elif not closing and zone != CHROME and _furniture(name, attributes):
            own = CHROME
    flush()
    return out


def shared(a: list[str], b: list[str]) -> set[int]:
    """Positions of a's lines in one longest common subsequence of a and b, by bit-parallel rows."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    out = {*range(first), *range(len(a) - last, len(a))}
    x, y = a[first : len(a) - last], b[first : len(b) - last]
    place: dict[str, int] = {}
    for k, line in enumerate(y):
        place[line] = place.get(line, 0) | 1 << k
    full = (1 << len(y)) - 1
    row, rows = full, []
    for line in x:
        mask = place.get(line, 0)
        hit = row & mask
        row = ((row + hit) | (row & ~mask)) & full
        rows.append(row)
    # a zero bit at k in row i: the subsequence of x[:i + 1] grows when y reaches k
    k = len(y)
    for i in range(len(x) - 1, -1, -1):
        now, before = rows[i] & ((1 << k) - 1), (rows[i - 1] if i else full) & ((1 << k) - 1)
        if k - now.bit_count() > k - before.bit_count():  # line i is needed for the length so far
            hit = place.get(x[i], 0) & ((1 << k) - 1)
            want = k - now.bit_count() - 1
            while hit:
                j = hit.bit_length() - 1
                if j - (before & ((1 << j) - 1)).bit_count() == want:
                    out.add(first + i)
                    k = j
                    break
                hit ^= 1 << j
    return out


KEPT, SHARED, FURNISHED, PROTECTED = "kept", "shared", "furniture", "protected"


def decisions(page: list[tuple[str, int]], partner: list[tuple[str, int]] | None) -> list[str]:
    """What becomes of each line: differencing comes first, the markup settles what it cannot know.

    A line shared with the partner goes (SHARED) unless it stands inside <article> or <main> (PROTECTED);
    of the lines that are the page's own those of page furniture go (FURNISHED) and the others stay (KEPT).
    """
    gone = shared([text for text, _ in page], [text for text, _ in partner]) if partner else set()
    out = [(PROTECTED if zone == MAIN else SHARED) if k in gone else (FURNISHED if zone == CHROME else KEPT) for k, (_, zone) in enumerate(page)]
    if len(gone) == len(page) and PROTECTED not in out:  # nothing tells the two pages apart
        out = [FURNISHED if zone == CHROME else KEPT for _, zone in page]
    return out


def main_text(page: list[tuple[str, int]], partner: list[tuple[str, int]] | None) -> str:
    """The page's own lines, joined by blank lines."""
    return "\n\n".join(text for (text, _), why in zip(page, decisions(page, partner), strict=True) if why in (KEPT, PROTECTED))


_URL = re.compile(r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)")
_NONE = -(1 << 63)


def key(url: str | None, page_id: int | None) -> tuple[str, str, int]:
    """(host, path, page_id): the order in which neighbours stand."""
    found = _URL.match(url or "")
    return (found[1].lower(), found[2], _NONE if page_id is None else page_id) if found else ("", url or "", _NONE if page_id is None else page_id)


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


#: Pages a range aims at, and the most ranges, each of which sends an edge to the driver.
RANGE, MOST_RANGES = 2_000, 50_000
#: Keys sampled for each range, and in all; the sample reaches the driver.
SAMPLED, MOST_SAMPLED = 30, 200_000


def extract(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared, n_furniture, n_protected), one row per page; the last three
    count the lines that differencing deleted, that the markup alone deleted, and that are shared but protected."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    names = rows.select("page_id", "url")
    ranges = ranges or max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, names.count() // RANGE))
    picked = names.orderBy(F.xxhash64("url", "page_id"), "url", "page_id").limit(min(MOST_SAMPLED, SAMPLED * ranges)).collect()
    keys = sorted(key(x["url"], x["page_id"]) for x in picked)
    cuts = [keys[k * len(keys) // ranges] for k in range(1, ranges)] if keys else []

    def edges(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = {}, {}
        for batch in frames:
            for page_id, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k = key(url, page_id)
                r = bisect_right(cuts, k)
                low[r], high[r] = min(low.get(r, k), k), max(high.get(r, k), k)
        if low:
            rows = [{"r": r, "low": {"h": low[r][0], "p": low[r][1], "i": low[r][2]}, "high": {"h": high[r][0], "p": high[r][1], "i": high[r][2]}} for r in low]
            yield pa.RecordBatch.from_pylist(rows, schema=_EDGE)

    found = names.mapInArrow(edges, "r int, low struct<h:string,p:string,i:long>, high struct<h:string,p:string,i:long>")
    ends = sorted(found.groupBy("r").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect())  # one row per range
    up = {tuple(x["high"]): y["r"] for x, y in zip(ends[:-1], ends[1:], strict=True)}
    down = {tuple(y["low"]): x["r"] for x, y in zip(ends[:-1], ends[1:], strict=True)}

    def parse(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for first in range(0, len(batch), 200):
                some = batch.slice(first, 200)
                out = []
                for page_id, url, html in zip(*[some.column(k).to_pylist() for k in range(3)], strict=True):
                    k = key(url, page_id)
                    page = lines(html or "")
                    row = {"h": k[0], "p": k[1], "page_id": page_id, "url": url, "texts": [t for t, _ in page], "zones": [z for _, z in page]}
                    out.append({"r": bisect_right(cuts, k), "edge": False, **row})
                    out += [{"r": r, "edge": True, **row} for r in (up.get(k), down.get(k)) if r is not None]
                yield pa.RecordBatch.from_pylist(out, schema=_PAGE)

    kind = "r int, edge boolean, h string, p string, page_id long, url string, texts array<string>, zones array<int>"
    dealt = rows.mapInArrow(parse, kind).repartitionById(ranges, F.col("r")).sortWithinPartitions("r", "h", "p", "page_id")
    return dealt.mapInArrow(_differenced, "page_id long, url string, text string, n_chars long, n_shared int, n_furniture int, n_protected int")


_EDGE_KEY = pa.struct([("h", pa.string()), ("p", pa.string()), ("i", pa.int64())])
_EDGE = pa.schema([("r", pa.int32()), ("low", _EDGE_KEY), ("high", _EDGE_KEY)])
_PAGE = pa.schema([("r", pa.int32()), ("edge", pa.bool_()), ("h", pa.string()), ("p", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("texts", pa.list_(pa.string())), ("zones", pa.list_(pa.int32()))])
_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), *[(x, pa.int32()) for x in ("n_shared", "n_furniture", "n_protected")]])


def _differenced(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each sorted page, from itself and its nearer neighbour."""

    def stream():
        for batch in frames:
            for first in range(0, len(batch), 200):
                yield from batch.slice(first, 200).to_pylist()

    def near(row, other) -> int:
        """Common path length; -1 where the other page is none of this host, or the same page."""
        if other is None or (other["r"], other["h"]) != (row["r"], row["h"]) or (other["p"], other["page_id"]) == (row["p"], row["page_id"]):
            return -1
        return _prefix(row["p"], other["p"])

    def text(before, row, after) -> dict:
        a, b = near(row, before), near(row, after)
        other = (before if a >= b else after) if max(a, b) >= 0 else None
        pair = list(zip(other["texts"], other["zones"], strict=True)) if other else None
        why = decisions(list(zip(row["texts"], row["zones"], strict=True)), pair)
        found = "\n\n".join(x for x, y in zip(row["texts"], why, strict=True) if y in (KEPT, PROTECTED))
        return {"page_id": row["page_id"], "url": row["url"], "text": found, "n_chars": len(found), "n_shared": why.count(SHARED), "n_furniture": why.count(FURNISHED), "n_protected": why.count(PROTECTED)}

    before, row, out = None, None, []
    for after in stream():
        if row is not None and not row["edge"]:
            out.append(text(before, row, after))
        before, row = row, after
        if len(out) >= 500:
            yield pa.RecordBatch.from_pylist(out, schema=_TEXT)
            out = []
    if row is not None and not row["edge"]:
        out.append(text(before, row, None))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_TEXT)
