"""Operator 10: main text of web pages by differencing pages of near URLs.

Pages are ordered by host and URL path, those of equal text as one. The
partners of a page are the nearest pages before and after it on its host that
differ from it, or the one of them whose path shares more directories with its
own. The text lines of a page and of each partner are aligned by longest common
subsequence, and what all partners share is deleted: the template's lines.

Markup settles what alignment cannot. A marked article's lines stay if the
partner has them in its article, too (two pages may carry the same one), or in
an element that is never article text. Of the lines that no partner shares, those in elements that are never article text (menus, forms,
adverts, readers' comments) go, and where a page marks its article, those
outside go.

Alignment needs hashes of lines only, so a page is a few hundred bytes when it
is dealt to ranges of (host, path) with the neighbours' edge rows; a large host
spreads over many tasks. The few whose partner lies beyond their range are
looked up on the whole host. Pages are parsed again to write their texts; they
are shuffled only if lines that markup keeps go on very many of them.
"""

from __future__ import annotations

import bisect
import functools
import html
import os.path
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obspark.llm import common

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|([^<]+|<)", re.S)
MARKS = re.compile(r"(?:class|id|role|data-role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|=|$)|display\s*:\s*none", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("head script style noscript template title svg math iframe object nav footer aside form button select textarea canvas audio video dialog menu".split())
UNWANTED = frozenset("nav navigation menu header footer sidebar notice notices cookie cookies ad ads advert adverts advertisement banner newsletter comment comments replies breadcrumb breadcrumbs share related".split())
COMMENTS = frozenset("comment comments replies".split())
ARTICLE = frozenset(("article", "main"))
ARTICLE_MARKS = frozenset(("articlebody", "main"))
#: Pages (hashes of their lines) that are looked up on their whole hosts at once.
OPEN = 2000
#: Kinds of lines: plain, of a marked article, in an unwanted element.
PLAIN, MARKED, OUT = 0, 1, 2


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """The text lines of a page, one for each block, and their kinds.

    An unwanted element that is never closed ends where an article begins.
    """
    out: list[tuple[str, int]] = []
    text: list[str] = []
    page = page or ""
    article: list[str] = []  # open elements since the article began
    skip, depth, told = "", 0, False  # the unwanted element, how many of its name are open, whether of comments
    raw_until = 0

    def close() -> None:
        line = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if line:
            out.append((line, OUT if skip else MARKED if article else PLAIN))

    for m in TOKEN.finditer(page):
        if m.start() < raw_until:
            continue
        name = m[2]
        if name is None:
            if m[4] is not None:
                text.append(m[4])
            continue
        name, closing, attributes = name.lower(), bool(m[1]), m[3] or ""
        if not closing and name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, m.end())
            raw_until = end.end() if end else len(page)
            continue
        if name in BLOCKS or name == skip:
            close()
        elif name == "br":
            text.append(" ")
        if skip:
            if name == skip:
                depth += -1 if closing else 0 if attributes.endswith("/") else 1
                if depth <= 0:
                    skip = ""
                continue
            if not (name in ARTICLE and not closing and not told and not article):
                continue
            close()
            skip = ""
        if closing:
            if name in article:
                while article.pop() != name:
                    pass
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        marks: set[str] = set()
        if attributes:
            values = ["".join(v) for v in MARKS.findall(attributes)]
            marks = {w.lower() for v in values for w in WORD.findall(v)} | {v.lower() for v in values}
        if name in NEVER or name == "header" and not article or marks & UNWANTED and name not in ("body", "html", "main") or attributes and HIDDEN.search(attributes):
            close()
            skip, depth, told = name, 1, bool(marks & COMMENTS)
        elif article:
            if name in BLOCKS and name not in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):
                article.append(name)
        elif name in ARTICLE or marks & ARTICLE_MARKS:
            article.append(name)
    close()
    return out


def kept(kinds) -> list[int]:
    """Positions of the lines that markup keeps: a marked article's, else all that are in no unwanted element."""
    wanted = MARKED if MARKED in kinds else PLAIN
    return [i for i, k in enumerate(kinds) if k == wanted]


def matches(a: list, b: list) -> list[tuple[int, int]]:
    """Positions in ``a`` and ``b`` of a longest common subsequence, by the matches of equal lines."""
    where = defaultdict(list)
    for j, line in enumerate(b):
        where[line].append(j)
    tails: list[int] = []
    chain: list[tuple[int, int, tuple | None]] = []
    for i, line in enumerate(a):
        for j in reversed(where.get(line, ())):
            k = bisect.bisect_left(tails, j)
            link = (i, j, chain[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                chain.append(link)
            else:
                tails[k], chain[k] = j, link
    out: list[tuple[int, int]] = []
    node = chain[-1] if chain else None
    while node:
        out.append(node[:2])
        node = node[2]
    return out[::-1]


def own(page: dict) -> list:
    """The lines of a page that markup keeps."""
    return [page["lines"][i] for i in kept(page["kinds"])]


def comparable(a: dict, b: dict) -> bool:
    """Whether all lines that one page keeps are among the other's, in order: differencing would delete a whole page."""
    x, y = own(a), own(b)
    return len(matches(x, y)) == min(len(x), len(y))


def drops(page: dict, partner: dict) -> set[int]:
    """Places, among the kept lines of a page, of those that its partner shares; a marked article's go only for a plain line there."""
    of = {i: k for k, i in enumerate(kept(page["kinds"]))}
    return {of[i] for i, j in matches(page["lines"], partner["lines"]) if i in of and (page["kinds"][i] == PLAIN or partner["kinds"][j] == PLAIN)}


def nearest(now: dict, before: dict | None, after: dict | None) -> list[dict]:
    """Of two candidates, the one whose path shares more directories with the page's; both in a tie."""
    near = lambda p: os.path.commonprefix((p["path"], now["path"])).count("/")
    some = [p for p in (before, after) if p]
    return [p for p in some if near(p) == max(map(near, some))]


def differenced(now: dict, before: dict | None, after: dict | None) -> list[int]:
    """Places, among a page's kept lines, of those that all of its nearest partners share."""
    each = [drops(now, p) for p in nearest(now, before, after)]
    return sorted(functools.reduce(set.intersection, each)) if each else []


def main_text(lines: list[tuple[str, int]], gone: list[int] | None) -> str:
    """The lines that markup keeps without those at the places ``gone``."""
    without = set(gone or ())
    return "\n\n".join(lines[i][0] for k, i in enumerate(kept([kind for _, kind in lines])) if k not in without)


def keyed(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with host, path, and a digest of host and html."""
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return pages.select("page_id", "url", "html", host.alias("host"), path.alias("path"), F.md5(F.concat_ws("\n", host, "html")).alias("digest"))


LINES = "host string, path string, digest string, content long, lines array<long>, kinds binary"
ROW = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.binary()]


def hashed_pages(pages: DataFrame) -> DataFrame:
    """Rows of LINES: hashes of the lines of each page, and of those that markup keeps as a whole."""

    def hashed(x: str) -> int:
        return xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hosts, paths, digests, pages in common.batches(frames, "host", "path", "digest", "html"):
            lines = [lines_of(x) for x in pages]
            kinds = [bytes(k for _, k in x) for x in lines]
            contents = [hashed("\n".join(x[i][0] for i in kept(k))) for x, k in zip(lines, kinds, strict=True)]
            cols = (hosts, paths, digests, contents, [[hashed(line) for line, _ in x] for x in lines], kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, ROW, strict=True)], names=["host", "path", "digest", "content", "lines", "kinds"])

    return pages.select("host", "path", "digest", "html").mapInArrow(task, LINES)


NAMES = ["host", "content", "path", "lines", "kinds", "_key", "_tie"]
SETTLED = "host string, content long, path string, lines array<long>, kinds binary, _key string, _tie long, gone array<int>"


def settle(contents: DataFrame) -> DataFrame:
    """Adds ``gone`` to ``contents`` (NAMES): places of kept lines that go; null where a partner lies beyond the bucket."""

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(run):
            for i, now in enumerate(run):
                if now["_side"]:
                    continue
                sides = run[i - 1 :: -1] if i else [], run[i + 1 :]
                near = [next((p for p in side if not comparable(now, p)), None) for side in sides]
                # the host goes on beyond the bucket, and all on this side is comparable
                gone = None
                if not any(p is None and side and side[-1]["_side"] for p, side in zip(near, sides, strict=True)):
                    if near == [None, None]:
                        near = [next((p for p in side if len(own(p)) < len(own(now))), None) for side in sides]
                    gone = differenced(now, *near)
                yield *[now[c] if gone is None or c in ("host", "content") else None for c in NAMES], gone

        def batch(rows):
            types = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary(), pa.string(), pa.int64(), pa.list_(pa.int32())]
            cols = list(zip(*rows, strict=True)) or [()] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[*NAMES, "gone"])

        run: list[dict] = []
        columns = ("_bucket", "_side", *NAMES)
        for part in common.batches(frames, *columns):
            for row in zip(*part, strict=True):
                now = dict(zip(columns, row, strict=True))
                if run and (run[0]["_bucket"], run[0]["host"]) != (now["_bucket"], now["host"]):
                    yield batch(list(found(run)))
                    run = []
                run.append(now)
        yield batch(list(found(run)))

    return common.range_buckets(contents).select("_bucket", "_side", *NAMES).mapInArrow(task, SETTLED)


def settle_rest(contents: DataFrame, rest: list) -> list[tuple]:
    """Rows (host, content, gone) of the pages that a bucket left open, by one look at all contents of their hosts.

    Open rows of a bucket and side are comparable with each other and differ,
    so they are at most as many as a page has lines.
    """
    by_host = defaultdict(list)
    for i, r in enumerate(rest):
        by_host[r["host"]].append((i, r.asDict(), (r["_key"].encode(), r["_tie"])))
    sought = dict(by_host)

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, tuple] = {}
        columns = NAMES
        for part in common.batches(frames, *columns):
            for row in zip(*part, strict=True):
                page = dict(zip(columns, row, strict=True))
                for i, mine, place in sought.get(page["host"], ()):
                    level = 0 if not comparable(mine, page) else 1 if len(own(page)) < len(own(mine)) else None
                    if page["content"] == mine["content"] or level is None:
                        continue
                    at = (page["_key"].encode(), page["_tie"])
                    slot = (i, level, at > place)
                    if slot not in best or (at < best[slot][0] if at > place else at > best[slot][0]):
                        best[slot] = (at, page)
        rows = [(i, level, after, p["_key"], p["_tie"], p["path"], p["lines"], p["kinds"]) for (i, level, after), (_, p) in best.items()]
        types = [pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()]
        cols = list(zip(*rows, strict=True)) or [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["i", "level", "after", "_key", "_tie", "path", "lines", "kinds"])

    seen = contents.select(*NAMES).mapInArrow(task, "i int, level int, after boolean, _key string, _tie long, path string, lines array<long>, kinds binary")
    place, page = F.struct("_key", "_tie"), F.struct("path", "lines", "kinds")
    near = seen.groupBy("i", "level", "after").agg(F.min_by(page, place).alias("first"), F.max_by(page, place).alias("last")).collect()
    slots = {(r["i"], r["level"], r["after"]): (r["first"] if r["after"] else r["last"]).asDict() for r in near}
    out = []
    for i, r in enumerate(rest):
        level = 0 if (i, 0, False) in slots or (i, 0, True) in slots else 1
        out.append((r["host"], r["content"], differenced(r.asDict(), slots.get((i, level, False)), slots.get((i, level, True)))))
    return out


def gone_lines(pages: DataFrame) -> DataFrame:
    """Digests of the pages of ``pages`` (see ``keyed``) that lose kept lines to differencing, and the places of these."""
    spark = pages.sparkSession
    parsed = common.stash(hashed_pages(pages), "pages")
    at = F.struct("path", "digest", "lines", "kinds")
    contents = parsed.filter(F.size("lines") > 0).groupBy("host", "content").agg(F.min(at).alias("_at")).select("host", "content", "_at.path", "_at.lines", "_at.kinds")
    contents = contents.withColumn("_key", F.concat_ws(" ", "host", "path")).withColumn("_tie", F.col("content"))
    contents = common.stash(contents, "contents")
    settled = common.stash(settle(contents), "settled")
    gone = settled.filter(F.size("gone") > 0).select("host", "content", "gone")
    rest = settled.filter("gone IS NULL")
    blocks = -(-rest.count() // OPEN)
    for k in range(blocks):  # a block is bounded, whatever the number of hosts and ranges
        block = rest.filter(F.pmod(F.xxhash64("host", "content"), F.lit(blocks)) == k).collect()
        gone = gone.unionByName(spark.createDataFrame([r for r in settle_rest(contents, block) if r[2]], gone.schema))
    out = common.stash(parsed.join(gone, ["host", "content"]).select("digest", "gone").dropDuplicates(["digest"]), "gone")
    common.discard(parsed, contents, settled)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """Main text of each row of ``pages`` (page_id, url, html; others are ignored).

    A null html counts as empty and gives an empty text; a null url is a host
    of its own name. Pages of a host whose kept lines are equal are one content,
    which is differenced once, at its first path, so they get one text. Its
    candidates are the next contents on either side that neither hold all its
    kept lines nor have all of their own in it; where the host has none, the
    next one that leaves lines over; with none at all the lines stay. Repeated
    rows get equal texts; an empty table gives no rows.
    """
    ready = keyed(pages)
    gone = gone_lines(ready)

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, bodies, places in common.batches(frames, "page_id", "url", "html", "gone"):
            texts = [main_text(lines_of(x), g) for x, g in zip(bodies, places, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    few = gone.count() <= common.FEW // 16
    both = ready.select("page_id", "url", "html", "digest").join(F.broadcast(gone) if few else gone, "digest", "left")
    return both.select("page_id", "url", "html", "gone").mapInArrow(task, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
