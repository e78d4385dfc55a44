"""Operator 3, HTML extraction: nearest-URL page differencing.

A page becomes text lines, one for each block.  Scripts, styles, comments, the head, navigation,
forms, headers, footers, asides and elements whose class, id or role names them as such give no
lines; a header inside ``article`` or ``main`` is part of it.  Then pages are paired: within a host,
pages are put in order of their URL's path, and of its two neighbours a page takes the one with
which it shares more leading path segments, then characters; of two equally near ones the earlier.
The lines of both are aligned by longest common subsequence, and lines they share are deleted as
the site's furniture, on every page.

Inside an ``article`` or ``main`` element structure hides only what is named, whole, as comments,
adverts or forms.  Differencing decides there too, but needs more support, as neighbouring URLs often hold
copies of an article or quote the same passages: a line that is links for the most part (a share row,
"read also") goes if it is aligned with both neighbours and the page's other lines are not the partner's
by half.  A page without such an element that shares nine tenths of its characters with its partner is
taken for a copy and is left whole.

Html never moves: each page becomes its lines where it is read.  Lines are range-partitioned by
(host, path, page_id), which cuts a host of any size, and written; the first and the last page of
each range then also go to the ranges beside it, so a page has the same two neighbours wherever the
ranges are cut.  A page alone on its host has no partner and loses nothing but its furniture.

Defined results: null or empty html gives an empty text; a null url is a host of its own; repeated
rows come back each and are neighbours of each other.  A very long page is one row; alignments of any
size are found by the same rule, in rows of bits of which a square root is kept.  An empty table gives no
rows.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from math import isqrt
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, longs, written

#: A comment, a declaration, a tag with its attributes, or text.
MARKUP = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
#: Elements whose content is not markup: it ends at the closing tag alone.
RAW = frozenset("script style textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("head nav header footer aside form menu button select dialog iframe noscript template svg canvas audio video object".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dir div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: Elements that end where the next of the same kind begins.
OPEN_ENDED = frozenset("p li dd dt tr td th option".split())
#: Words of class, id and role that mark furniture.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsored sponsor promo promotion banner cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay sidebar sidenav aside menu menubar nav navbar navigation breadcrumb breadcrumbs header masthead "
    "footer comment comments commentlist replies reply respond disqus discussion related recommended share sharing social newsletter subscribe "
    "signup login search toolbar widget pagination pager skip complementary contentinfo".split()
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=\s|/|$)", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


#: Elements that hide neither themselves nor, by a name, what they head.
NEVER = frozenset("body html main h1 h2 h3 h4 h5 h6".split())
#: Of the names only these hide an article.
REMARKS = frozenset("comment comments reply replies".split())
#: Whole names of class, id or role that hide an element inside the main text.
INSIDE = frozenset(
    "ad ads advert adverts advertisement advertisements adsbygoogle sponsored comment comments commentlist comment-list comment-form "
    "comment-section comments-section comments-area disqus_thread form search-form signup-form newsletter-form contact-form".split()
)
#: Share of a line's characters in links from which it is a line of links.
LINKED = 0.8


def furniture(tag: str, attributes: str, inside: bool = False) -> bool:
    """Whether an element's name, class, id or role marks it as no part of the main text."""
    if tag in HIDDEN and not (inside and tag == "header"):
        return True
    if not attributes or tag in NEVER:
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if inside:
            if any(w in INSIDE for w in value.lower().split()):
                return True
        elif any(w.lower() in (REMARKS if tag == "article" else NAMES) for w in WORD.findall(value)):
            return True
    return False


ROLE_MAIN = re.compile(r"(?:^|\s)role\s*=\s*[\"']?main\b", re.I)


#: Where a line lies: outside article and main, inside, inside and for the most part links.
OUT, IN, LINKS = 0, 1, 2


def unclosed(page: str, at: int, tag: str) -> bool:
    """Whether an element that is open at ``at`` has no end tag of its own in the rest of the page."""
    return len(re.findall(f"</{tag}\\s*>", page[at:], re.I)) <= len(re.findall(f"<{tag}[\\s>]", page[at:], re.I))


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """(line, where it lies) of a page, in page order.

    Open elements are kept in a stack; an end tag closes all that is still open inside its element,
    and one without a start is ignored.
    """
    page = page or ""
    out: list[tuple[str, int]] = []
    buffer: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # (tag, hidden, main)
    hidden = main = linked = 0
    link = False

    def flush() -> None:
        nonlocal linked
        if buffer:
            line = " ".join(entities.unescape("".join(buffer)).split())
            if line:
                out.append((line, OUT if not main else LINKS if linked >= LINKED * sum(map(len, buffer)) else IN))
            buffer.clear()
            linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        buffer.append(piece)
        linked += len(piece) if link else 0

    def close(k: int) -> None:
        nonlocal hidden, main
        for _, h, m in stack[k:]:
            hidden, main = hidden - h, main - m
        del stack[k:]

    at, n = 0, len(page)
    while at < n:
        m = MARKUP.search(page, at)
        if m is None:
            if not hidden:
                text(page[at:])
            break
        if not hidden and m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1]), m[3]
        if tag == "a":
            link = not closing
        if tag in RAW and not closing:
            end = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in BLOCK and not hidden:
            flush()
        elif tag in ("br", "td", "th") and not hidden:
            buffer.append(" ")
        if closing:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if k is not None:
                if any(x[2] for x in stack[k:]):  # what stands in the buffer still lies in the main text
                    flush()
                close(k)
            continue
        if tag in VOID:
            continue
        if stack and stack[-1][0] == tag and tag in OPEN_ENDED or stack and stack[-1][0] == "p" and tag in BLOCK:
            close(len(stack) - 1)
        if tag in ("body", "main") or ROLE_MAIN.search(attributes):  # these stand in no other element but body
            k = next((k for k, x in enumerate(stack) if x[1]), len(stack))
            close(k)
        elif tag == "article" and hidden:  # an element that never ends does not hide what follows it
            k = next(k for k, x in enumerate(stack) if x[1])
            if unclosed(page, at, stack[k][0]):
                close(k)
        hides, mains = furniture(tag, attributes, main > 0), tag in ("article", "main") or bool(ROLE_MAIN.search(attributes))
        if hides and not hidden:
            flush()
        if not attributes.endswith("/") and (tag in BLOCK or hides or tag in OPEN_ENDED or hidden or tag in HIDDEN):
            stack.append((tag, hides, mains and not hides))
            hidden, main = hidden + hides, main + (mains and not hides)
    flush()
    return out


def _bit_rows(start: int, codes: list[int], masks: dict[int, int], full: int) -> list[int]:
    """Rows of the alignment's table as bits, from the row ``start`` on: a bit is 0 where the length of the
    longest common subsequence grows by one from left to right."""
    rows = [start]
    for c in codes:
        v, m = rows[-1], masks[c]
        rows.append(((v + (v & m)) | (v & ~m)) & full)
    return rows


def _pairs(cx: list[int], cy: list[int]) -> list[int]:
    """Places in ``cx`` of a longest common subsequence with ``cy``, traced back from the ends: a match is
    taken where it lengthens the subsequence, else the step goes up if that loses nothing, else left.

    Every ``isqrt``-th row is kept and the rows between are made again on the way back, so the result is
    the same at any size and memory grows with rows of bits times the root of their number.
    """
    full, masks = (1 << len(cy)) - 1, {}
    for k, c in enumerate(cy):
        masks[c] = masks.get(c, 0) | 1 << k
    every, kept = isqrt(len(cx)) + 1, [full]
    for at in range(0, len(cx), every):
        kept.append(_bit_rows(kept[-1], cx[at : at + every], masks, full)[-1])
    length = lambda row, c: c - (row & ((1 << c) - 1)).bit_count()
    found, r, c, block, rows = [], len(cx), len(cy), -1, []
    while r and c:
        if (r - 1) // every != block:
            block = (r - 1) // every
            rows = _bit_rows(kept[block], cx[block * every : (block + 1) * every], masks, full)
        here, up = rows[r - block * every], rows[r - 1 - block * every]
        now, above = length(here, c), length(up, c)
        if cx[r - 1] == cy[c - 1] and now == length(up, c - 1) + 1:
            found.append(r - 1)
            r, c = r - 1, c - 1
        elif above >= now - (not here >> (c - 1) & 1):
            r -= 1
        else:
            c -= 1
    return found


def common(a: list[str], b: list[str]) -> set[int]:
    """Indexes in ``a`` of a longest common subsequence with ``b``."""
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    found = set(range(i)) | set(range(len(a) - j, len(a)))
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    both = set(x) & set(y)  # lines of one side alone take no part
    xs, ys = [k for k, s in enumerate(x) if s in both], [k for k, s in enumerate(y) if s in both]
    code = {s: k for k, s in enumerate(both)}
    return found | {i + xs[k] for k in _pairs([code[x[k]] for k in xs], [code[y[k]] for k in ys])}


def address(url: str | None) -> tuple[str, str]:
    """(host without www., path) of a URL; an unreadable one is its own path."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return "", url or ""
    return host, parts.path.rstrip("/") or "/"


def closeness(a: tuple[str, str], b: tuple[str, str]) -> tuple[int, int]:
    """Shared leading segments and characters of two paths of a host; (-1, 0) across hosts."""
    if a[0] != b[0]:
        return -1, 0
    x, y = a[1].split("/"), b[1].split("/")
    segments = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    characters = next((k for k, (p, q) in enumerate(zip(a[1], b[1], strict=False)) if p != q), min(len(a[1]), len(b[1])))
    return segments, characters


def main_text(own: list[tuple[str, int]], partner: list[tuple[str, int]] | None, other: list[tuple[str, int]] | None = None) -> str:
    """The main text of a page with lines ``own`` beside its nearest page and the neighbour on its other side."""
    if partner and not all(where == IN for _, where in own):
        lines = [line for line, _ in own]
        shared = common(lines, [line for line, _ in partner])
        sizes = lambda at: sum(len(lines[k]) for k in at)
        copy = not any(where for _, where in own) and 10 * sizes(shared) >= 9 * sum(map(len, lines))
        gone = set() if copy else {k for k in shared if own[k][1] == OUT}
        text = [k for k, x in enumerate(own) if x[1] == IN]
        if other and any(where == LINKS for _, where in own) and 2 * sizes(shared.intersection(text)) < sizes(text):
            twice = shared & common(lines, [line for line, _ in other])
            gone |= {k for k in twice if own[k][1] == LINKS}
        own = [x for k, x in enumerate(own) if k not in gone]
    return "\n".join(line for line, _ in own)


KEY = ("host", "path", "page_id", "tie")
LINES = "page_id string, url string, host string, path string, lines binary"


def folded(lines: list[tuple[str, int]]) -> bytes:
    """Lines as they travel: each behind a mark of where it lies, compressed."""
    return zlib.compress("\n".join("012"[where] + line for line, where in lines).encode("utf-8", "surrogatepass"), 6)


def unfolded(data: bytes) -> list[tuple[str, int]]:
    text = zlib.decompress(data).decode("utf-8", "surrogatepass")
    return [(x[1:], int(x[0])) for x in text.split("\n")] if text else []


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path, lines) of each page, made where the page is read."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places = [address(u) for u in batch["url"]]
            yield batch[["page_id", "url"]].assign(host=[h for h, _ in places], path=[p for _, p in places], lines=[folded(lines_of(x)) for x in batch["html"]])

    return pages.select(id_text("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInPandas(task, LINES)


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Task over the pages of ranges, in order, each range between its neighbours' nearest pages."""
    range_, before, due = None, None, None

    def text(page, after) -> str:
        beside = sorted((x for x in (before, after) if x and x[0][0] == page[0][0]), key=lambda x: closeness(x[0], page[0]), reverse=True)
        return main_text(page[1], *(x[1] for x in beside)) if beside else main_text(page[1], None)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["page_id", "url", "text"])
        return out.assign(page_id=longs(out["page_id"]), n_chars=out["text"].map(len).astype("int64"))

    for batch in batches:
        out = []
        for part, page_id, url, host, path, lines, context in zip(*(batch[c] for c in ("part", "page_id", "url", "host", "path", "lines", "context")), strict=True):
            page = ((host, path), unfolded(bytes(lines)), page_id, url, context)
            if part != range_:
                if due and not due[4]:
                    out.append((due[2], due[3], text(due, None)))
                range_, before, due = part, None, None
            elif due and not due[4]:
                out.append((due[2], due[3], text(due, page)))
            before, due = due, page
        if out:
            yield frame(out)
    if due and not due[4]:
        yield frame([(due[2], due[3], text(due, None))])


def extract(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per page: (page_id, url, text, n_chars)."""
    partitions = partitions or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = page_lines(pages).withColumn("tie", F.xxhash64("url", "lines"))
    keys = ["host", "path", F.col("page_id").cast("long"), "tie"]
    ranges = written(lines.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()), "ranges")
    key, page = F.struct("host", "path", F.col("page_id").cast("long").alias("page_id"), "tie"), F.struct(*lines.columns)
    edges = ranges.groupBy("part").agg(F.min_by(page, key).alias("first"), F.max_by(page, key).alias("last"))
    order = Window.orderBy("part")  # one number for each range
    beside = ranges.select("part").distinct().select("part", F.lag("part").over(order).alias("previous"), F.lead("part").over(order).alias("next"))
    previous = beside.join(edges.select(F.col("part").alias("previous"), F.col("last").alias("page")), "previous").select("part", "page.*")
    following = beside.join(edges.select(F.col("part").alias("next"), F.col("first").alias("page")), "next").select("part", "page.*")
    context = previous.unionByName(following).withColumn("context", F.lit(True))
    whole = ranges.withColumn("context", F.lit(False)).unionByName(context)
    return whole.repartition(partitions, "part").sortWithinPartitions("part", *keys).mapInPandas(_aligned, "page_id long, url string, text string, n_chars long")
