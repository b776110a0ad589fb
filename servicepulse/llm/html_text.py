"""Main text of web pages by differencing with the nearest page of the site.

A page becomes a list of text lines, one per block.  Within a host the pages
are ordered by URL path, and each is paired with its neighbours in that order:
the lines of both are aligned by a longest common subsequence, and lines that a
neighbour shares are template text and are deleted.  A neighbour that shares
every line is a copy of the page and tells nothing about the template, so
copies that follow each other count as one page between the nearest pages that
differ, and each is cleaned alike.

What the page itself marks is heeded first.  Navigation, footers, sidebars,
forms, notices, adverts, reader comments, scripts and styles are not lines at
all.  Where a page marks its article, lines outside are dropped, and a line
inside goes if it aligns through three pages that follow each other and that
are unlike, i.e. hold less than half of their text in common.  Two pages, or
pages alike, that share lines are copied articles or passages and keep them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from servicepulse.llm.common import map_arrow
from servicepulse.session import materialize

#: Pages of a host that are ordered in one task; larger hosts are split into ranges of about that size.
GROUP = 200
#: Ranges of large hosts in all, about; with more pages than GROUP times this the ranges get longer.
RANGES = 20_000

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(?P<raw>script|style|textarea|title|noscript|template|iframe|svg|select|object)\b[^>]*>(?:.*?</(?P=raw)\s*>|.*)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attr>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attr2>[^>]*)>",
    re.IGNORECASE | re.DOTALL,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")

_INLINE = frozenset("math mi mn mo ms mtext mrow msup msub mfrac msqrt a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that never hold main text.
_NEVER = frozenset("nav footer aside form head button dialog menu fieldset".split())
_ARTICLE = frozenset(("article", "main"))
#: Elements whose marks say nothing about all they hold.
_WHOLE = frozenset(("html", "body", "article", "main"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CUES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments reply replies disqus "
    "share sharing social related recommended widget toolbar pagination pager search skip".split()
)
#: Within an article: whole names of a class that say the same, and of an id (else an id names what a section is about).
_INNER_CLASSES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments replies disqus share sharing widget toolbar pagination pager".split()
)
_INNER_IDS = frozenset("comments disqus disqus_thread sidebar newsletter".split())
_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert menu menubar toolbar".split())


def _boilerplate(tag: str, attr: str, inside: bool) -> bool:
    """Whether an element holds no main text, by its name and its marks."""
    if tag in _NEVER or (tag == "header" and not inside):
        return True
    if not attr or tag in _WHOLE:
        return False
    for m in _ATTR.finditer(attr):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if inside and name in ("class", "id"):
            if not (_INNER_CLASSES if name == "class" else _INNER_IDS).isdisjoint(value.split()):
                return True
        elif name in ("class", "id"):
            if not _CUES.isdisjoint(_WORDS.findall(value)) or (not inside and "header" in _WORDS.findall(value)):
                return True
        elif (name == "role" and value in _ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        elif name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def lines_of(html: str) -> list[tuple[str, bool]]:
    """Text of the page's blocks, in page order, and whether each is inside an article element.

    References are decoded, white space becomes single spaces, empty blocks and
    elements that never hold main text are left out.
    """
    out: list[tuple[str, bool]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # open containers: tag, left out, in an article
    hidden = inside = False

    def flush():
        if held:
            text = _SPACE.sub(" ", unescape("".join(held))).strip()
            held.clear()
            if text:
                out.append((text, inside))

    at = 0
    for m in _TOKEN.finditer(html):
        if not hidden and m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _INLINE and not (m["attr"] or m["attr2"]):
            if tag == "br" and not hidden:
                held.append(" ")
            continue
        if m["end"] or m["end2"]:
            open_ = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if tag not in _INLINE:
                flush()
            if open_ is not None:
                del stack[open_:]
                hidden, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            continue
        if tag not in _INLINE:
            flush()
        if tag == "body":  # ends a head that was left open
            stack, hidden, inside = [], False, False
        left_out = _boilerplate(tag, m["attr"] or m["attr2"] or "", inside)
        if tag in _VOID or (m["attr"] or m["attr2"] or "").rstrip().endswith("/"):
            if tag == "br" and not hidden:
                held.append(" ")
            continue
        if tag == "p" or (tag == "li" and stack and stack[-1][0] == "li"):
            if stack and stack[-1][0] == tag:
                stack.pop()
                hidden, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            left_out = _boilerplate(tag, m["attr"] or m["attr2"] or "", inside)
        if tag in _INLINE and not left_out:
            continue
        hidden, inside = hidden or left_out, inside or tag in _ARTICLE
        stack.append((tag, hidden, inside))
    if not hidden and at < len(html):
        held.append(html[at:])
    flush()
    return out


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each prefix of ``b`` (bit-parallel rows)."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer((full & ~v).to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits)])


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence (divide and conquer, linear memory)."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            if a[a0] in b[b0:b1]:
                out.append((a0, b.index(a[a0], b0, b1)))
            continue
        mid = (a0 + a1) // 2
        left, right = _lengths(a[a0:mid], b[b0:b1]), _lengths(a[mid:a1][::-1], b[b0:b1][::-1])
        cut = b0 + int((left + right[::-1]).argmax())
        todo += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
    return sorted(out)


def shared_lines(a: list[str], b: list[str]) -> tuple[set[int], set[int]]:
    """Positions in either list of the lines that align; none if one page holds all lines of the other and no more (a copy)."""
    if a == b:
        return set(), set()
    both = set(a) & set(b)
    if not both:
        return set(), set()
    number = {x: i for i, x in enumerate(sorted(both))}
    pa_, pb = [i for i, x in enumerate(a) if x in both], [i for i, x in enumerate(b) if x in both]
    pairs = common([number[a[i]] for i in pa_], [number[b[i]] for i in pb])
    return {pa_[i] for i, _ in pairs}, {pb[j] for _, j in pairs}


def main_text(lines: list[tuple[str, bool]], shared: set[int], template: set[int] = frozenset()) -> str:
    """The text of a page, given the lines that a neighbour shares and those that recur over three unlike pages."""
    if any(inside for _, inside in lines):
        return "\n".join(t for i, (t, inside) in enumerate(lines) if inside and i not in template)
    return "\n".join(t for i, (t, _) in enumerate(lines) if i not in shared)


class _Page:
    """A page, or copies of it that follow each other, between the neighbours that differ."""

    def __init__(self, lines: list[tuple[str, bool]]):
        self.lines, self.texts = lines, [t for t, _ in lines]
        self.rows: list[tuple] = []
        self.shared: set[int] = set()
        self.template: set[int] = set()
        #: Positions of the lines that align with the page before, and their positions there.
        self.back: dict[int, int] = {}
        self.body = {t for t, inside in lines if inside} or set(self.texts)
        self.weight = sum(map(len, self.body))

    def unlike(self, other: _Page) -> bool:
        """Whether what both hold is less than half of either's text; more is a copied article."""
        return 2 * sum(map(len, self.body & other.body)) < min(self.weight, other.weight)

    def follow(self, last: _Page, older: _Page | None) -> None:
        """Align with the page before; lines that run through three pages, each unlike the others, are template."""
        mine, other = shared_lines(self.texts, last.texts)
        self.shared |= mine
        last.shared |= other
        self.back = dict(zip(sorted(mine), sorted(other)))
        through = [(i, j, last.back[j]) for i, j in self.back.items() if j in last.back]
        if through and self.unlike(last) and self.unlike(older) and last.unlike(older):
            for page, places in zip((self, last, older), zip(*through)):
                page.template.update(places)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages sorted by group and path in; their texts out.  Only three neighbouring pages that differ are held."""
    done: list[tuple] = []
    held: list[_Page] = []  # of one group, the last two at most
    at = None

    def close(page: _Page) -> Iterator[pa.RecordBatch]:
        texts: dict[tuple, str] = {}
        for page_id, url, inside in page.rows:
            if inside not in texts:
                texts[inside] = main_text(list(zip(page.texts, inside)), page.shared, page.template)
            done.append((page_id, url, texts[inside], len(texts[inside])))
            if len(done) >= 500:
                yield drain()

    def drain():
        columns = list(zip(*done)) if done else [[]] * 4
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            for r in batch.slice(a, 500).to_pylist():
                page = _Page(lines_of(r["html"] or ""))
                row = (r["page_id"], r["url"], tuple(inside for _, inside in page.lines))
                if at != (r["host"], r["part"]):
                    for p in held:
                        yield from close(p)
                    held, at = [], (r["host"], r["part"])
                if held and held[-1].texts == page.texts:
                    if r["own"]:
                        same = held[-1].rows[-1][2] if held[-1].rows else row[2]
                        held[-1].rows.append((*row[:2], same if same == row[2] else row[2]))
                    continue
                if r["own"]:
                    page.rows.append(row)
                if held:
                    page.follow(held[-1], held[-2] if len(held) > 1 else None)
                held.append(page)
                if len(held) > 2:
                    yield from close(held.pop(0))
            yield drain()
    for p in held:
        yield from close(p)
    yield drain()


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, part, path, page_id, tie and a digest of the page's lines."""
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            b = batch.slice(a, 500)
            digest = [hashlib.blake2b("\n".join(t for t, _ in lines_of(h or "")).encode("utf-8", "surrogatepass"), digest_size=16).digest() for h in b.column("html").to_pylist()]
            names = [n for n in b.schema.names if n != "html"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(digest, pa.binary())], names=[*names, "digest"])


def _borders(ends: list) -> list[tuple]:
    """(host, path, page_id, tie, parts): the two nearest differing pages before and after every range, and the ranges they are to meet.

    ``ends``: a row (host, part, firsts, lasts) per range in order, with the first
    and the last three of its runs of equal pages as (path, page_id, tie, digest).
    """
    want: dict[tuple, set[int]] = {}

    def walk(rows, near, far):
        # ``ahead``: the first three runs from the range last seen on.
        host, ahead = None, []
        for r in rows:
            if r["host"] != host:
                host, ahead = r["host"], []
            edge = far(r)[0]["digest"]
            for page in [p for k, p in enumerate(ahead) if k or p["digest"] != edge][:2]:
                want.setdefault((host, page["path"], page["page_id"], page["tie"]), set()).add(r["part"])
            joined = []
            # A range of three runs or more hides what lies behind it.
            for page in near(r) + (ahead if len(near(r)) < 3 else []):
                if not joined or joined[-1]["digest"] != page["digest"]:
                    joined.append(page)
            ahead = joined[:3]

    walk(ends[::-1], lambda r: r["firsts"], lambda r: r["lasts"][::-1])
    walk(ends, lambda r: r["lasts"][::-1], lambda r: r["firsts"])
    return [(*key, sorted(parts)) for key, parts in want.items()]


def _split(src: DataFrame, width: int) -> DataFrame:
    """``src`` with ``part`` and ``own``: hosts of over ``width`` pages in ranges of the page order.

    Pages are drawn by hash, about 16 in ``width``, and every sixteenth of them in
    the order starts a range, so that the ranges are of like size.  Each also gets the two nearest differing pages on either side, with ``own`` false.
    """
    spark, key = src.sparkSession, ["path", "page_id", "tie"]
    large = materialize(src.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > width).select("host"), "html-hosts")
    if not large.limit(1).count():
        return src.withColumn("part", F.lit(0)).withColumn("own", F.lit(True))
    step = min(width, 16)
    drawn = src.join(F.broadcast(large), "host", "left_semi").where(F.pmod(F.xxhash64(F.lit("range"), *key), F.lit(width)) < step)
    drawn = drawn.groupBy("host").agg(F.array_sort(F.collect_set(F.struct(*key))).alias("drawn"))
    starts = materialize(drawn.select("host", F.filter("drawn", lambda _, i: i % step == step - 1).alias("starts")), "html-ranges")
    part = F.coalesce(F.size(F.filter("starts", lambda s: s <= F.struct(*key))), F.lit(0))
    placed = src.join(F.broadcast(starts), "host", "left").withColumn("part", F.when(F.col("starts").isNull(), 0).otherwise(part)).drop("starts")

    pages = placed.join(F.broadcast(starts.select("host")), "host", "left_semi").select("host", "part", *key, "html")
    pages = materialize(map_arrow(pages, _heads, "host string, part int, path string, page_id long, tie long, digest binary"), "html-digests")
    near = Window.partitionBy("host", "part")
    order = [F.col(c) for c in key]
    runs = pages.withColumn("before", F.lag("digest").over(near.orderBy(*order))).where("before is null or before <> digest")
    runs = runs.withColumn("k", F.row_number().over(near.orderBy(*order))).withColumn("n", F.count(F.lit(1)).over(near))
    few = lambda c: F.array_sort(F.collect_list(F.when(c, F.struct("k", *key, "digest"))))
    ends = runs.groupBy("host", "part").agg(few(F.col("k") <= 3).alias("firsts"), few(F.col("k") > F.col("n") - 3).alias("lasts"))
    ends = sorted(ends.collect(), key=lambda r: (r["host"], r["part"]))
    guests = spark.createDataFrame(_borders(ends), "host string, path string, page_id long, tie long, guest array<int>")
    same = [placed["host"] == guests["host"], placed["path"] == guests["path"], placed["page_id"].eqNullSafe(guests["page_id"]), placed["tie"] == guests["tie"]]
    met = placed.join(F.broadcast(guests), same, "left").select(*(placed[c] for c in placed.columns), "guest")
    to = F.concat(F.array(F.struct(F.col("part"), F.lit(True).alias("own"))), F.transform(F.coalesce("guest", F.array().cast("array<int>")), lambda g: F.struct(g.alias("part"), F.lit(False).alias("own"))))
    return met.withColumn("to", F.explode(to)).select(*src.columns, "to.part", "to.own")


def extract(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of ``pages`` (page_id, url, html).

    Null or empty pages have an empty text.  Pages without a URL, or whose URL has
    no host, form one host of their own.  Query and fragment do not count for the
    order; pages of one path follow each other by page_id.  A host of more than
    ``group`` pages is split into ranges of that order, each of which also sees
    the nearest pages of its neighbours, so the result does not depend on
    ``group``.  Repeated rows are each returned; other columns are ignored; a
    page alone in its host has nothing to be compared with.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*?)/?(?:[?#].*)?$", 1)
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"), path.alias("path"))
    src = src.withColumn("tie", F.xxhash64("url", "html"))
    dealt = _split(src, max(group, -(-pages.count() // RANGES)))
    dealt = dealt.repartition("host", "part").sortWithinPartitions("host", "part", "path", "page_id", "tie", F.desc("own")).drop("path", "tie")
    return map_arrow(dealt, _extract, "page_id long, url string, text string, n_chars long")
