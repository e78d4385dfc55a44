"""Operator 9, benchmark decontamination: Wu-Manber multi-pattern search over words.

Words are runs of ASCII digits, ASCII letters (lower-cased) and characters beyond ASCII.  The
patterns are all windows of ``window`` consecutive words of the benchmark's items; an item of
fewer words, but not none, is one window.  For each pattern length there is a table:

* shift: for each block of up to three words, how far the search may jump after seeing it;
  blocks of no pattern allow the longest jump,
* buckets: patterns by their last block, and within it by their first,

and a candidate is confirmed by comparing all its words.  Nothing is decided by a hash alone.

Documents are never shuffled.  The patterns are distinct windows, counted before they are sent
out: at most ``most`` make one set; more make several sets, by a hash of the window, and a pass
over the documents for each.  The first pass has one row for each document, the others have hits
only, and these are put together by document.

Defined results: null or empty texts have no words.  A text of any length is one row; a window that
several items hold counts for each of them.  Rows of the benchmark with the same item_id
are one item, a null item_id counts as the empty string.  Repeated document rows come back each.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, longs, row_number, written

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
PARTS = "row long, doc_id long, n_words long, spans array<array<long>>, items array<string>"
#: Digits, lower-case letters and bytes beyond ASCII stand; all else becomes a space.
FOLD = bytes(ord(chr(c).lower()) if chr(c).isascii() and chr(c).isalnum() else c if c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Table:
    """Patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.m, self.b = length, min(3, length)
        self.far = length - self.b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list]] = defaultdict(dict)
        for words, items in patterns.items():
            for end in range(self.b, length + 1):
                block = words[end - self.b : end]
                self.shift[block] = min(self.shift.get(block, self.far), length - end)
            self.buckets[words[-self.b :]].setdefault(words[: self.b], []).append((words, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(start, items) of every occurrence."""
        m, b, far, shift, buckets = self.m, self.b, self.far, self.shift, self.buckets
        at, n = m, len(words)  # at: just after the window
        while at <= n:
            block = tuple(words[at - b : at])
            jump = shift.get(block, far)
            if not jump:
                start = at - m
                for pattern, items in buckets[block].get(tuple(words[start : start + b]), ()):
                    if tuple(words[start:at]) == pattern:
                        yield start, items
                jump = 1
            at += jump


def tables(rows: list[tuple[str, str]]) -> list[Table]:
    """Search tables of (item, window's words with spaces between)."""
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = defaultdict(lambda: defaultdict(list))
    for item, window in rows:
        words = tuple(window.encode("utf-8", "surrogatepass").split())
        by_length[len(words)][words].append(item)
    return [Table(n, patterns) for n, patterns in sorted(by_length.items())]


def scan(text: str | None, searched: list[Table]) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged hit spans and items found."""
    words, spans, items = words_of(text), [], set()
    for t in searched:
        for start, found in t.search(words):
            spans.append((start, start + t.m))
            items.update(found)
    return len(words), merge(spans), items


def merge(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def windows(benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Distinct (item, window)."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, text in zip(batch["item"], batch["text"], strict=True):
                words = words_of(text)
                for i in range(max(1, len(words) - window + 1) if words else 0):
                    out.append((item, b" ".join(words[i : i + window]).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["item", "window"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(task, "item string, window string").distinct()


def _figures(n_words: int, spans, items) -> tuple:
    hit = sum(b - a for a, b in spans)
    return n_words, hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, most: int = 50_000) -> DataFrame:
    """One row per document; see SCHEMA."""
    sc = docs.sparkSession.sparkContext
    patterns = written(windows(benchmark, window), "windows")
    n_sets = max(1, -(-patterns.count() // most))
    docs = docs.select(row_number(docs).alias("row"), id_text(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def chosen(k: int):
        rows = patterns.where(F.pmod(F.xxhash64("window"), F.lit(n_sets)) == k)
        return sc.broadcast([(r["item"], r["window"]) for r in rows.collect()])  # about ``most`` windows

    def one(rows):
        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            searched = tables(rows.value)
            for batch in batches:
                out = [(d, *_figures(*scan(t, searched))) for d, t in zip(batch["doc_id"], batch["text"], strict=True)]
                out = pd.DataFrame(out, columns=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
                yield out.assign(doc_id=longs(batch["doc_id"]))

        return task

    def part(rows, hits_only: bool):
        """One row for each document with a hit; the first pass also has those without."""

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            searched = tables(rows.value)
            for batch in batches:
                found = [scan(t, searched) for t in batch["text"]]
                out = batch[["row"]].assign(doc_id=longs(batch["doc_id"]), n_words=[n for n, _, _ in found], spans=[[list(s) for s in spans] for _, spans, _ in found], items=[sorted(i) for _, _, i in found])
                yield out[out["items"].map(len) > 0] if hits_only else out

        return task

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [_figures(n, merge(s), set(i)) for n, s, i in zip(batch["n_words"], batch["spans"], batch["items"], strict=True)]
            yield pd.DataFrame(out, columns=["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]).assign(doc_id=longs(batch["doc_id"]))

    if n_sets == 1:
        return docs.mapInPandas(one(chosen(0)), SCHEMA)
    found = None
    for k in range(n_sets):
        more = written(docs.mapInPandas(part(chosen(k), k > 0), PARTS), "hits")
        found = more if found is None else found.union(more)
    whole = found.groupBy("row").agg(F.first("doc_id").cast("string").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return whole.mapInPandas(joined, SCHEMA)


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs``, unchanged, without any word of a benchmark window."""
    sc = docs.sparkSession.sparkContext
    patterns = written(windows(benchmark, window), "windows")
    n_sets = max(1, -(-patterns.count() // 50_000))
    for k in range(n_sets):
        rows = sc.broadcast([(r["item"], r["window"]) for r in patterns.where(F.pmod(F.xxhash64("window"), F.lit(n_sets)) == k).collect()])
        docs = docs.where(_clean(rows)(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return docs


def _clean(rows):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        searched = tables(rows.value)
        for texts in batches:
            yield pd.Series([not any(True for t in searched for _ in t.search(words_of(x))) for x in texts], dtype=bool)

    return clean
