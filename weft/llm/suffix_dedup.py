"""Operator 2, suffix-array dedup: external induced sorting of the passages that can repeat.

Every byte covered by a ``length``-byte string that also starts anywhere else (in any document,
the same one included) is removed.  Texts are UTF-8; null is empty; matches never cross documents.

1. Windows.  Each window of ``length`` bytes has a key: the least hash of the ``gram``-byte strings
   in it, which depends on its content alone.  Runs of windows with their least hash in one place
   are pieces; a window lies in one piece.  Equal windows have equal keys, so keys met once are dropped: their windows
   are unique.  What remains is a small part of a corpus.
2. Pieces.  The remaining pieces are cut from the texts.  Equal pieces are one row with a count;
   a piece met twice or more repeats as a whole.
3. Hot keys.  A passage that very many documents hold in different surroundings gives one key very
   many distinct pieces.  Such pieces are cut in two by where the gram stands in the window; all
   windows of a half share more bytes than before, and their hash is the half's key.  Halves met
   once are dropped, and halves that are still hot are cut again, down to single windows.
4. Sorting.  Distinct pieces go to shards by key.  A task sorts a shard's suffixes by induced
   sorting with disk-backed queues (see induced_sort) and common-prefix values; a window repeats
   if a neighbour in the order shares ``length`` bytes with it.  Files are in the task's own
   temporary folder, removed when the shard is done.
5. Removal.  Repeated windows come back to the documents by piece and are cut out.

Counting keys and pieces pre-aggregates before each shuffle, so that copies of a passage, however
many, are one row when they are sorted.

Defined results: empty and short texts lose nothing.  Repeated rows are further places, so they
lose all they share.  Rows come back one for one, null doc_ids too.  A text of any length is one
row whose pieces go their own ways.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Beside, beside, id_text, longs, remove, row_number, written
from .induced_sort import descending

LENGTH, GRAM = 200, 40
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of each ``gram``-byte string, by joining hashes of powers of two."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    out, done, size = None, 0, 1
    factor = np.uint64(0xD6E8FEB86659FD93)
    while True:
        if gram & size:
            if out is None:
                out, done = h, size
            else:
                n = len(data) - done - size + 1
                out, done = out[:n] * factor + h[done : done + n], done + size
        if 2 * size > gram:
            break
        h = h[:-size] * factor + h[size:]
        h ^= h >> np.uint64(31)
        size *= 2
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    out = values
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def pieces(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, windows) of each piece of a text of at least ``length`` bytes.

    A piece ends where the least hash changes or its first place leaves the window, so a text that
    repeats itself has one key several times.
    """
    hashes = gram_hashes(np.frombuffer(data, np.uint8), gram)
    keys = sliding_least(hashes, length - gram + 1)
    start = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]) | (keys[:-1] == hashes[: len(keys) - 1])) + 1))
    return keys[start].view(np.int64), start, np.diff(np.append(start, len(keys)))


def _numbered(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(row_number(docs).alias("row"), id_text(), text.alias("data"))


def _windows(length: int, gram: int):
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, found = [], []
            for row, data in zip(batch["row"], batch["data"], strict=True):
                if len(data) >= length:
                    found.append(pieces(data, length, gram))
                    rows.append(np.full(len(found[-1][0]), row, np.int64))
            if found:
                key, start, size = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pd.DataFrame({"key": key, "row": np.concatenate(rows), "start": start, "size": size})

    return task


def _cut(length: int, path: str):
    """Task over texts (row, data): the pieces that the side table asks for."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        side = Beside(path)
        for batch in batches:
            table, at = side.at(batch["row"].to_numpy(np.int64))
            out = []
            for row, data, k in zip(batch["row"], batch["data"], at, strict=True):
                if k < 0:
                    continue
                key, start, size = (table[c][int(k)].values.to_numpy().tolist() for c in ("keys", "starts", "sizes"))
                for x, s, n in zip(key, start, size, strict=True):
                    piece = bytes(data[s : s + n + length - 1])
                    out.append((x, row, s, hashlib.md5(piece, usedforsecurity=False).digest(), piece))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=["key", "row", "start", "digest", "piece"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["key", "row", "start", "digest", "piece"])

    return task


HALVES = "key long, digest binary, piece binary, n long, low int, high int, gram_at int, of binary, offset int"


def halves(length: int, gram: int):
    """Task over pieces (digest, piece, n, low, high, gram_at) of hot keys: each cut in two.

    low and high bound how many bytes before the gram a window begins; gram_at is -1 at first.  The
    bytes that all windows of a half have, wherever they begin, give the half's key.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, digest, piece, n, low, high, p in zip(*(batch[c] for c in ("key", "digest", "piece", "n", "low", "high", "gram_at")), strict=True):
                piece, windows = bytes(piece), len(piece) - length + 1
                if p < 0:
                    p = int(np.flatnonzero(gram_hashes(np.frombuffer(piece, np.uint8), gram).view(np.int64) == key)[0])
                middle = (low + high + 1) // 2
                for a, b in ((low, middle - 1), (middle, high)):
                    first, last = max(0, p - b), min(windows - 1, p - a)
                    if first <= last:
                        part, core = piece[first : last + length], piece[p - a : p - b + length]
                        name = xxhash.xxh64_intdigest(core, seed=(a << 16) + b)
                        out.append((np.uint64(name).view(np.int64), hashlib.md5(part, usedforsecurity=False).digest(), part, n, a, b, p - first, bytes(digest), first))
            yield pd.DataFrame(out, columns=["key", "digest", "piece", "n", "low", "high", "gram_at", "of", "offset"])

    return task


def cooled(distinct: DataFrame, length: int, gram: int, hot: int) -> tuple[DataFrame, list[DataFrame]]:
    """(pieces with no hot key, tables (digest, of, offset) that lead from halves back to pieces)."""
    ready, back = None, []
    at = distinct.withColumns({"low": F.lit(0), "high": F.lit(length - gram), "gram_at": F.lit(-1)})
    while True:
        many = written(at.where("low < high").groupBy("key").agg(F.count("*").alias("pieces")).where(F.col("pieces") > hot).select("key"), "hot", "zstd")
        none = many.isEmpty()
        # Only pieces of this level can have a key that is hot here; those that were cold before are not read again.
        cold = (at if none else at.join(many, "key", "left_anti")).select("key", "digest", "piece", "n")
        ready = cold if ready is None else ready.unionByName(cold)
        if none:
            return ready, back
        cut = written(at.join(many, "key", "left_semi").select("key", "digest", "piece", "n", "low", "high", "gram_at").mapInPandas(halves(length, gram), HALVES), "halves", "zstd")
        back.append(cut.select("digest", "of", "offset"))
        same = ("piece", "low", "high", "gram_at")
        each = cut.groupBy("key", "digest").agg(*(F.first(c).alias(c) for c in same), F.sum("n").alias("n"))
        again = cut.groupBy("key").agg(F.sum("n").alias("met")).where("met > 1").select("key")
        at = written(each.join(again, "key", "left_semi"), "pieces", "zstd")


class Shard:
    """Pieces in a file of 16-bit characters: byte + 2, a 1 after each piece, a 0 at the end."""

    def __init__(self, length: int):
        self.length, self.folder = length, tempfile.TemporaryDirectory(prefix="weft-shard-")
        self.path = os.path.join(self.folder.name, "text")
        self.file, self.n = open(self.path, "wb"), 0  # noqa: SIM115
        self.digests, self.starts, self.counts = [], [], []

    def add(self, digest: bytes, piece: bytes, count: int) -> None:
        self.digests.append(digest)
        self.starts.append(self.n)
        self.counts.append(count)
        (np.frombuffer(piece, np.uint8).astype("<u2") + 2).tofile(self.file)
        self.file.write(b"\x01\x00")
        self.n += len(piece) + 1

    def repeats(self, memory: int) -> pd.DataFrame:
        """(digest, low, high): bytes of each piece that repeated windows cover."""
        self.file.write(b"\x00\x00")
        self.file.close()
        starts = np.array(self.starts, np.int64)
        ends = np.append(starts[1:], self.n) - 1
        whole = np.array(self.counts) > 1
        flags = np.zeros(self.n + 1, bool)
        if len(starts) > 1 or len(starts) and not whole[0]:
            text = np.memmap(self.path, "<u2", "r")
            above = -1
            for at, prefix in descending(text, 258, self.folder.name, self.length, memory):
                hit = np.flatnonzero(prefix >= self.length)
                flags[at[hit]] = True
                flags[at[hit[hit > 0] - 1]] = True
                if len(hit) and hit[0] == 0 and above >= 0:
                    flags[above] = True
                above = int(at[-1])
            del text
        self.folder.cleanup()
        out = [(self.digests[k], 0, int(ends[k] - starts[k])) for k in np.flatnonzero(whole)]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
        for a, b in edges.reshape(-1, 2).tolist():
            # A run of flags can go on into the short suffixes at a piece's end and to the next piece.
            k = int(np.searchsorted(starts, a, "right")) - 1
            while k < len(starts) and starts[k] < b:
                low, high = max(a, starts[k]), min(b, ends[k] - self.length + 1)
                if low < high and not whole[k]:
                    out.append((self.digests[k], int(low - starts[k]), int(high - 1 + self.length - starts[k])))
                k += 1
        return pd.DataFrame(out, columns=["digest", "low", "high"])


def _sort(length: int, shard_bytes: int, memory: int):
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, last = None, None
        for batch in batches:
            for key, digest, piece, count in zip(batch["key"], batch["digest"], batch["piece"], batch["n"], strict=True):
                if shard is not None and shard.n >= shard_bytes and key != last:
                    yield shard.repeats(memory)
                    shard = None
                if shard is None:
                    shard = Shard(length)
                shard.add(bytes(digest), bytes(piece), int(count))
                last = key
        if shard is not None:
            yield shard.repeats(memory)

    return task


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = 4 << 20, memory: int = 2_000_000, hot: int = 1000) -> DataFrame:
    """(row, low, high): for each row that loses bytes, the bounds of its spans, by start.

    ``hot``: distinct pieces of a key beyond which it is cut up.
    """
    texts = _numbered(docs).select("row", "data")
    windows = written(texts.mapInPandas(_windows(length, gram), "key long, row long, start int, size int"), "windows", "zstd")
    # Written, so that both sides of the join come from a plain shuffle and a key that very many
    # windows share can be split over tasks.
    again = written(windows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "again", "zstd")
    own = windows.join(again, "key", "left_semi").groupBy("row").agg(F.collect_list(F.struct("key", "start", "size")).alias("own"))
    path = beside(own.select("row", F.col("own.key").alias("keys"), F.col("own.start").alias("starts"), F.col("own.size").alias("sizes")), "own")
    cut = written(texts.mapInPandas(_cut(length, path), "key long, row long, start int, digest binary, piece binary"), "pieces", "zstd")
    remove(windows)
    remove(again)
    remove(path, docs.sparkSession)
    distinct = written(cut.groupBy("key", "digest").agg(F.first("piece").alias("piece"), F.count("*").alias("n")), "distinct", "zstd")
    ready, back = cooled(distinct, length, gram, hot)
    shards = ready.repartition("key").sortWithinPartitions("key", "digest")
    found = written(shards.mapInPandas(_sort(length, shard_bytes, memory), "digest binary, low int, high int"), "found", "zstd")
    known, deeper = found, None
    for step in reversed(back):  # what is known of halves leads to the pieces they were cut from
        below = found if deeper is None else found.union(deeper)
        offset = F.col("offset")
        deeper = written(below.join(step, "digest").select(F.col("of").alias("digest"), (F.col("low") + offset).alias("low"), (F.col("high") + offset).alias("high")).distinct(), "mapped", "zstd")
        known = known.union(deeper)
    span = F.struct((F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))
    marks = known.join(cut.select("digest", "row", "start"), "digest").select("row", span.alias("span")).distinct()
    spans = marks.groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans")).select("row", F.col("spans.low").alias("low"), F.col("spans.high").alias("high"))
    out = written(spans, "spans", "zstd")
    remove(cut)
    remove(distinct)
    return out


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in spans:
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for low, high in spans:
        out.append(data[at:low])
        at = high
    return b"".join([*out, data[at:]])


def digests(docs: DataFrame, **options) -> DataFrame:
    """One row per document: what it loses and the SHA-256 of what is left; see SCHEMA."""
    spans = repeated_spans(docs, **options)
    path = beside(spans, "spans")
    remove(spans)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        side = Beside(path)
        for batch in batches:
            table, at = side.at(batch["row"].to_numpy(np.int64))
            out = []
            for data, k in zip(batch["data"], at, strict=True):
                bounds = [table[c][int(k)].values.to_numpy().tolist() for c in ("low", "high")] if k >= 0 else [[], []]
                cut = merged(zip(*bounds, strict=True))
                rest = kept_bytes(data, cut)
                out.append((len(data), len(data) - len(rest), len(cut), hashlib.sha256(rest).hexdigest()))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"]).assign(doc_id=longs(batch["doc_id"]))

    return _numbered(docs).mapInPandas(task, SCHEMA)
