"""Main text of web pages by nearest-URL page differencing.

Pages are put in the order of host and URL path, and each is compared with its two nearest on the host, the one before it
and the one after it. Text lines are aligned by longest common subsequence. A neighbour with which the article itself is
shared (more than half of its lines; all lines, where no element marks the article) is a copy and no evidence.

1. What both neighbours share with a page is the site's and goes, wherever it stands.
2. What one of two shares, or the only one, is undecided, and the structure breaks the tie: it goes unless it stands in an
   article or main element.
3. What none shares is the page's own. Differencing can't tell an article from a menu, advert or comment that no other page
   has, so of these lines those in elements that name themselves as such go, and those outside the article where an
   element marks it.

Order without one big sort: bounds are keys of a bounded sample of pages; each range between two bounds is sorted by
itself, and the page on each side of a bound is also sent to the range on the other side. Only extracted lines are
shuffled, once. A host or a path that holds a third of the pages spans many ranges.

Tags are read with quoted attributes of any length; a quote that is never closed ends with its tag. Elements end with those
around them.
A boilerplate or text-less element that is never closed is taken for no element (script and style reach to the end).

Defined results: null html has no lines; a null URL is host '' and path ''; pages of equal URL follow by id and then lines;
a page alone on its host loses no line to differencing; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import html as entities
import math
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_below

#: Elements of HTML by what they mean here.
RAW = frozenset({"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "head", "title", "textarea", "select"})
BOILER = frozenset({"nav", "footer", "aside", "form", "dialog", "menu", "button"})
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: A class, id or role is boilerplate if its words are of these kinds: one of the first or second, none but those and the
#: third; next to a word for the article only the second counts (the header of an article belongs to it).
SITE_WORDS = frozenset("banner breadcrumb breadcrumbs cookie cookies footer header masthead menu nav navbar navigation notice popup sidebar toolbar widget".split())
SIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising comment comments disqus newsletter promo promoted related reply replies respond share sharing social sponsor sponsored subscribe".split())
PLACE_WORDS = frozenset("area bar block body bottom box buttons consent container content form global group inner item left link links list main outer page panel primary right secondary section site text thread title top wrap wrapper".split())
ARTICLE_WORDS = frozenset("article blog entry news post story".split())

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:-->|\Z))|<(/?)([a-zA-Z][^\s/>]*)|<[!?/][^>]*>", re.S)
_ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_MARK = re.compile(r"[>\"']")
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PARTS = re.compile(r"[_-]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
OTHER, MAIN, BOILERPLATE = 0, 1, 2


@lru_cache(10_000)
def names_boilerplate(name: str) -> bool:
    """Whether a whole class name, id or role stands for something beside the article."""
    parts = {x.lower() for x in _PARTS.split(name) if x}
    of_article = bool(parts & ARTICLE_WORDS)
    if not parts & (SIDE_WORDS if of_article else SITE_WORDS | SIDE_WORDS):
        return False
    return parts <= SITE_WORDS | SIDE_WORDS | PLACE_WORDS | ARTICLE_WORDS


class _Tags:
    """Where the tags of a page end: at the first > outside quotes, or if a quote is never closed at the first > at all.

    Until a quote is left open each tag is one match. From then on quotes are followed one by one, and those from which
    none closes are remembered, so that no part of a page is gone through again for each of its tags.
    """

    def __init__(self, page: str):
        self.page, self.open, self.dead = page, False, set()

    def end(self, at: int) -> int:
        """The place of the > of a tag whose attributes begin at a place; the page's length if there is none."""
        page = self.page
        if not self.open:
            stop = _ATTRIBUTES.match(page, at).end()
            if stop < len(page) and page[stop] == ">":
                return stop
            self.open = True
        here, seen = at, []
        while m := _MARK.search(page, here):
            if m[0] == ">":
                return m.start()
            if m.start() in self.dead:
                break
            seen.append(m.start())
            here = page.find(m[0], m.end()) + 1
            if not here:
                break
        self.dead.update(seen)
        stop = page.find(">", at)
        return len(page) if stop < 0 else stop


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """Text lines in page order, with whether each is in the main element, in boilerplate, or neither."""
    out: list[tuple[str, int]] = []
    buffer: list[str] = []
    opened: list[tuple[str, int]] = []  # elements around, with what they are
    count = [0, 0, 0]
    page, at, lower = page or "", 0, None
    last: dict[str, int] = {}
    tags = _Tags(page)

    def closed_later(tag: str) -> bool:
        nonlocal lower
        if tag not in last:
            lower = page.lower() if lower is None else lower
            last[tag] = lower.rfind(f"</{tag}")
        return last[tag] >= at

    def flush() -> None:
        line = _SPACE.sub(" ", entities.unescape("".join(buffer))).strip(" ")
        buffer.clear()
        if line:
            out.append((line, BOILERPLATE if count[BOILERPLATE] else MAIN if count[MAIN] else OTHER))

    while True:
        m = _TOKEN.search(page, at)
        if not m:
            buffer.append(page[at:])
            break
        buffer.append(page[at : m.start()])
        at = m.end()
        slash, tag = m[1], m[2]
        if not tag:
            continue
        stop = tags.end(at)
        attributes, at = page[at:stop], stop + 1
        tag, closing = tag.lower(), bool(slash)
        if tag in BLOCKS or tag in RAW:
            flush()
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}(?![^\s/>])[^>]*>", re.I).search(page, at) if closed_later(tag) else None
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    at = len(page)
            continue
        if tag in VOID:
            continue
        if closing:
            if any(t == tag for t, _ in opened):
                if tag not in BLOCKS and any(k for _, k in opened[max(i for i, (t, _) in enumerate(opened) if t == tag) :]):
                    flush()
                while True:
                    t, kind = opened.pop()
                    count[kind] -= 1
                    if t == tag:
                        break
            continue
        if attributes.endswith("/") and tag not in BLOCKS:
            continue
        kind = OTHER
        if tag == "main":
            kind = MAIN
        elif tag not in ("html", "body"):
            named = [x for _, *g in _NAMED.findall(attributes) for x in "".join(g).split()] if attributes else []
            if tag == "article":
                kind = BOILERPLATE if any(x.lower() in SIDE_WORDS for x in named) else MAIN
            elif tag in BOILER or (tag == "header" and not count[MAIN]) or any(map(names_boilerplate, named)):
                kind = BOILERPLATE
            if kind == BOILERPLATE and not closed_later(tag):
                kind = OTHER
        if kind and tag not in BLOCKS:
            flush()
        if tag in ("p", "li", "option"):  # ended by the next of its kind
            while opened and opened[-1][0] == tag:
                count[opened.pop()[1]] -= 1
        opened.append((tag, kind))
        count[kind] += 1
    flush()
    return out


def shared_places(a: list, b: list) -> set[int]:
    """Places of `a` in a longest common subsequence of both.

    Bit-parallel: a row of the table is one integer of a bit for each line of `b`. Only every so many rows are kept, and those
    between two are made again on the way back, so memory is of the order of len(b) * sqrt(len(a)) bits.
    """
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    step = math.isqrt(len(a)) + 1

    def following(row: int, lines: list) -> Iterator[int]:
        for x in lines:
            u = row & where.get(x, 0)
            row = ((row + u) | (row - u)) & full
            yield row

    kept, row = [full], full
    for i, row in enumerate(following(full, a), 1):
        if i % step == 0:
            kept.append(row)
    out, i, j = set(), len(a), len(b)
    here = j - row.bit_count()
    first, rows = len(a) + 1, []  # rows[k] is the one after first + k lines
    while here:
        if i - 1 < first:
            block = (i - 1) // step
            first, rows = block * step, [kept[block], *following(kept[block], a[block * step : i])]
        up = j - (rows[i - 1 - first] & ((1 << j) - 1)).bit_count()
        if up == here:
            i -= 1
        elif j - 1 - (rows[i - first] & ((1 << (j - 1)) - 1)).bit_count() == here:
            j -= 1
        else:
            i, j, here = i - 1, j - 1, here - 1
            out.add(i)
    return out


def _key(host: str, path: str, page_id: int | None) -> str:
    number = "" if page_id is None else f"{page_id + (1 << 63):020d}"
    return f"{host}\x01{path}\x01{number}"


def _lined(batches: Iterator[pa.RecordBatch], bounds: list[str], openers: list[str]) -> Iterator[pa.RecordBatch]:
    """Lines of the pages by range. side: 0 a page of the range, -1 the last of the range before, 1 the first of the one after."""
    names = ["page_id", "url", "key", "host", "slot", "side", "lines", "kinds"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int8(), pa.list_(pa.string()), pa.list_(pa.int8())]
    for b in batches:
        rows = []
        for page, url, host, path, text in zip(*(b.column(i).to_pylist() for i in range(5))):
            found = lines_of(text)
            lines, marks = [x for x, _ in found], [k for _, k in found]
            key = _key(host, path, page)
            slot = bisect.bisect_left(bounds, key)
            rows.append((page, url, key, host, slot, 0, lines, marks))
            if slot < len(bounds) and bounds[slot] == key:
                rows.append((page, url, key, host, slot + 1, -1, lines, marks))
            if slot and openers[slot] == key:
                rows.append((page, url, key, host, slot - 1, 1, lines, marks))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)


def decide(lines: list[str], kinds: list[int], neighbours: list[list[str]]) -> tuple[list[int], int, int]:
    """Places of the lines that stay, how many differencing deleted, and how many only the structure."""
    marked = MAIN in kinds
    own = [i for i, k in enumerate(kinds) if k == (MAIN if marked else OTHER)]
    votes, evidence = [0] * len(lines), 0
    for theirs in neighbours:
        shared = shared_places(lines, theirs)
        common = sum(i in shared for i in own)
        if own and (2 * common > len(own) if marked else common == len(own)):
            continue  # the same article
        evidence += 1
        for i in shared:
            votes[i] += 1
    stay, by_difference, by_structure = [], 0, 0
    for i, k in enumerate(kinds):
        if votes[i] == 2 or (votes[i] == 1 and k != MAIN):
            by_difference += 1
        elif k == (MAIN if marked else OTHER):
            stay.append(i)
        else:
            by_structure += 1
    return stay, by_difference, by_structure


def _differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["page_id", "url", "text", "n_chars", "n_shared", "n_named", "n_lines"], [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    before = held = None
    out: list[tuple] = []

    def settle(after: tuple | None) -> None:
        if held is None or held[5]:
            return
        page, url, _, host, slot, _, lines, marks = held
        stay, shared, named = decide(lines, marks, [x[6] for x in (before, after) if x is not None and x[4] == slot and x[3] == host])
        text = "\n".join(lines[i] for i in stay)
        out.append((page, url, text, len(text), shared, named, len(lines)))

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=names)
        out.clear()
        return batch

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            settle(row)
            before, held = held, row
        yield flush()
    settle(None)
    yield flush()


def extract_pages(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", range_pages: int = 200, sample_keys: int = 50_000) -> DataFrame:
    """page_id, url, text, n_chars, n_shared (lines that differencing deleted), n_named (by structure alone), n_lines."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    base = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), path.alias("path"), F.col(html_col).cast("string").alias("html"))
    number = F.when(F.col("page_id").isNull(), F.lit("")).otherwise(F.lpad((F.col("page_id").cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0"))
    keys = base.select(F.concat_ws("\x01", "host", "path", number).alias("key"))
    pages = keys.count()
    ranges = int(min(10_000, pages // range_pages))
    bounds: list[str] = []
    openers: list[str] = [""]
    if ranges > 1:
        drawn = keys.where(hash_below(F.col("key"), 2 * sample_keys / pages)).distinct()
        sample = sorted(r[0] for r in drawn.orderBy(F.xxhash64("key"), "key").limit(sample_keys).collect())
        bounds = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
        openers = [""] * (len(bounds) + 1)
        for r in keys.mapInArrow(partial(_least, bounds=bounds), "slot int, key string").groupBy("slot").agg(F.min("key").alias("key")).collect():
            openers[r["slot"]] = r["key"]
    schema = "page_id long, url string, key string, host string, slot int, side tinyint, lines array<string>, kinds array<tinyint>"
    lined = base.select("page_id", "url", "host", "path", "html").mapInArrow(partial(_lined, bounds=bounds, openers=openers), schema)
    placed = lined.repartition(F.col("slot")).sortWithinPartitions("slot", "side", "key", "lines")
    return placed.mapInArrow(_differenced, "page_id long, url string, text string, n_chars long, n_shared int, n_named int, n_lines int")


def _least(batches: Iterator[pa.RecordBatch], bounds: list[str]) -> Iterator[pa.RecordBatch]:
    """The least key of each range: one row for each task and range."""
    least: dict[int, str] = {}
    for b in batches:
        for key in b.column(0).to_pylist():
            slot = bisect.bisect_left(bounds, key)
            if slot not in least or key < least[slot]:
                least[slot] = key
    yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), pa.array(list(least.values()), pa.string())], names=["slot", "key"])
