"""The pipeline's near-duplicate stage: wide SimHash, multi-index hashing, exact Jaccard.

Two documents link if their sets of ``size``-word shingles (words as in operator 8; all words where
there are fewer) have a Jaccard similarity of ``similarity`` or more.  Equal sets are one node, so
copies cost one row, and a document without words equals any other such.

* Candidates: a fingerprint of 1024 bits over the distinct shingles, cut into 64 segments of 16 bits
  with balls of radius 0.  At Jaccard 0.8 about 15 % of the bits differ, so that one segment
  agrees with 7 % and any of 64 with 99 %.  Rows of a bucket that differ in at most ``distance`` of
  the first 128 bits (there 19 on average at Jaccard 0.8, 64 by chance) and whose set sizes allow
  the similarity are joined; a task emits a spanning forest.
* Verification: documents of a cluster of candidates bring their sets once and are compared
  exactly, unless already joined.  Only these links count.  Texts are fetched where they are read.

Defined results: null and empty texts have no words and are one group; repeated rows are one set;
of equal doc_ids the first row stays; a text of any length is one row.  An empty table gives no rows.

Full buckets and large clusters are dealt out: each block of stored rows meets all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Beside, beside, longs, only, remove, row_number, written
from .components import connected
from .simhash_mih import _plain

#: Longs of a fingerprint, and bits of a segment; the first two longs are compared whole.
LONGS, BITS = 16, 16
#: Stored rows of one task, of a bucket and of a cluster.
BLOCK, CLUSTER = 4096, 1024
#: Rows of a run up to which all its pairs are compared at once.
SMALL = 256

_STEP = np.arange(1, LONGS + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans), np.uint64, len(words) - k + 1))


def wide(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint: LONGS words of majorities over the hashes, remixed for each word."""
    total = np.zeros((LONGS, 64), np.int64)
    for at in range(0, len(hashes), 255):
        x = hashes[at : at + 255][None, :] + _STEP  # SplitMix64
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
        total += bits.reshape(LONGS, -1, 8).sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(LONGS, 64)  # bytes hold up to 255
    return np.packbits(2 * total > len(hashes), axis=1, bitorder="little").view("<i8").ravel()


def node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), 7) if len(hashes) else 0


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, row, id, n, f) of each document: its set's hash, the set's size, the fingerprint."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t, size) for t in batch["text"]]
            ids = np.array([node(s) for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": longs(batch["doc_id"]), "row": batch["row"], "id": ids, "n": [len(s) for s in sets], "f": [wide(s).tolist() for s in sets]})

    return docs.mapInPandas(task, "doc_id long, row long, id long, n long, f array<long>")


def _near(p, q, n, i, j, distance: int, similarity: float) -> np.ndarray:
    bits = np.bitwise_count(p[i] ^ p[j]).astype(np.int64) + np.bitwise_count(q[i] ^ q[j])
    return (bits <= distance) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)


def _candidates(distance: int, similarity: float, small: int = SMALL, slice_pairs: int = 1_000_000):
    """Task over rows (bucket, part, stored, id, n, p, q) sorted by these: a forest of close rows."""

    def many(ids, stored, n, p, q) -> list[tuple[int, int]]:
        """A large run by breadth: a row reached is not compared again from another side."""
        out, left, ahead = [], np.arange(len(ids)), []
        while len(left):
            if not ahead:
                if not stored[left].any():
                    break
                first = int(np.argmax(stored[left]))
                ahead, left = [left[first]], np.delete(left, first)
            i = ahead.pop()
            hit = _near(p, q, n, i, left, distance, similarity)
            if not stored[i]:
                hit &= stored[left]
            if hit.any():
                found = left[hit]
                out += [(int(ids[i]), x) for x in ids[found].tolist()]
                ahead += found.tolist()
                left = left[~hit]
        return out

    def compare(rows: pd.DataFrame) -> list[tuple[int, int]]:
        bucket, part = rows["bucket"].to_numpy(np.int64), rows["part"].to_numpy(np.int64)
        ids, stored = rows["id"].to_numpy(np.int64), rows["stored"].to_numpy(np.int64) == 0
        n, p, q = (rows[c].to_numpy(np.int64) for c in ("n", "p", "q"))
        p, q = p.view(np.uint64), q.view(np.uint64)
        edge = np.concatenate(([0], np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])) + 1, [len(ids)]))
        length = np.diff(edge)
        out = []
        for k in np.flatnonzero(length > small):
            s = slice(edge[k], edge[k + 1])
            out += many(ids[s], stored[s], n[s], p[s], q[s])
        after = np.repeat(edge[1:], length) - np.arange(len(ids)) - 1
        after[~stored | (np.repeat(length, length) > small)] = 0
        left_rows = np.flatnonzero(after)
        cum, at = np.cumsum(after[left_rows]), 0
        while at < len(left_rows):
            to = max(at + 1, int(np.searchsorted(cum, (cum[at - 1] if at else 0) + slice_pairs, "right")))
            i, m = left_rows[at:to], after[left_rows[at:to]]
            left = np.repeat(i, m)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m)
            ok = _near(p, q, n, left, right, distance, similarity)
            out += zip(ids[left[ok]].tolist(), ids[right[ok]].tolist(), strict=True)
            at = to
        return out

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        def forest(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            if len(parent) > 1_000_000:
                parent.clear()
            out = []
            for a, b in compare(rows):
                x, y = root(a), root(b)
                if x != y:
                    parent[y] = x
                    out.append((a, b))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            same = (rows["bucket"] == rows["bucket"].iloc[-1]) & (rows["part"] == rows["part"].iloc[-1])
            cut = len(rows) - int(same.sum())
            if cut:
                yield from forest(rows.iloc[:cut])
            held = rows.iloc[cut:].reset_index(drop=True)
            if len(held) > 64 * BLOCK:  # a long run: its stored rows stand first and stay, the others pass by
                yield from forest(held)
                held = held[held["stored"] == 0]
        if held is not None and len(held):
            yield from forest(held)

    return task


def _dealt(rows: DataFrame, key: str, block: int) -> DataFrame:
    """``rows`` with part and stored: each block of a key's rows is a part that meets all of them."""
    full = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > block)
    parts = F.when(F.col("__n").isNull(), F.lit(1)).otherwise(F.ceil(F.col("__n") / block)).cast("long")
    return (
        rows.join(full, key, "left")
        .withColumn("parts", parts)
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .withColumn("stored", F.when(F.pmod(F.xxhash64("id"), "parts") == F.col("part"), 0).otherwise(1))
        .drop("__n", "parts")
    )


def candidates(nodes: DataFrame, distance: int, similarity: float, block: int = BLOCK, small: int = SMALL) -> DataFrame:
    """(a, b): ids of ``nodes`` (id, n, f); their components hold every candidate pair."""
    keys = []
    for k in range(LONGS * 64 // BITS):
        low = F.shiftrightunsigned(F.col("f")[k * BITS // 64], k * BITS % 64).bitwiseAND(F.lit((1 << BITS) - 1))
        keys.append(low.bitwiseOR(F.lit(k << BITS)).cast("int"))
    rows = nodes.select("id", F.col("n").cast("int").alias("n"), F.col("f")[0].alias("p"), F.col("f")[1].alias("q"), F.explode(F.array(*keys)).alias("bucket"))
    dealt = _dealt(rows, "bucket", block).select("bucket", "part", "stored", "id", "n", "p", "q")
    return dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "stored", "id").mapInPandas(_candidates(distance, similarity, small), "a long, b long")


def _verify(size: int, distance: int, similarity: float):
    """Task over rows (cluster, part, stored, id, n, p, q, text) sorted by these: verified links."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = None
        for batch in batches:
            out = []
            for cluster, part, stored, i, n, p, q, text in batch[["cluster", "part", "stored", "id", "n", "p", "q", "text"]].itertuples(index=False, name=None):
                if (cluster, part) != key:
                    key, ids, sets, used = (cluster, part), [], [], 0
                    ps, qs, ns, label = np.zeros(16, np.uint64), np.zeros(16, np.uint64), np.zeros(16, np.int64), np.zeros(16, np.int64)
                mine, own = shingles(text, size), -1
                p, q = np.int64(p).view(np.uint64), np.int64(q).view(np.uint64)
                bits = np.bitwise_count(ps[:used] ^ p).astype(np.int64) + np.bitwise_count(qs[:used] ^ q)
                sizes = np.minimum(ns[:used], n) >= similarity * np.maximum(ns[:used], n) - 1e-9
                at = np.flatnonzero((bits <= distance) & sizes)
                while len(at):
                    k, at = at[0], at[1:]
                    both = len(np.intersect1d(sets[k], mine, assume_unique=True))
                    if both >= similarity * (len(sets[k]) + len(mine) - both) - 1e-9:
                        out.append((ids[k], i))
                        if own >= 0:
                            label[:used][label[:used] == label[k]] = own
                        own = label[k]
                        at = at[label[at] != own]
                if stored == 0:
                    if used == len(ps):
                        ps, qs, ns, label = (np.concatenate((x, np.zeros_like(x))) for x in (ps, qs, ns, label))
                    ps[used], qs[used], ns[used], label[used] = p, q, n, own if own >= 0 else used
                    ids.append(i)
                    sets.append(mine)
                    used += 1
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    return task


def _bring(path: str):
    """Task over texts (row, text): those that the side table asks for, with its columns."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        side = Beside(path)
        for batch in batches:
            table, at = side.at(batch["row"].to_numpy(np.int64))
            hit = np.flatnonzero(at >= 0)
            if len(hit):
                own = table.take(at[hit]).select(["cluster", "id", "n", "p", "q"]).to_pandas()
                yield own.assign(text=batch["text"].to_numpy()[hit])

    return task


def components(docs: DataFrame, size: int = 5, similarity: float = 0.8, distance: int = 36, block: int = BLOCK, cluster: int = CLUSTER, small: int = SMALL) -> DataFrame:
    """(id, first, component) of each distinct set of ``docs``; first has the row number of its first document."""
    texts = _plain(docs, row_number(docs).alias("row"))
    signed = written(signatures(texts, size), "signatures", batch=1000)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    nodes = written(signed.groupBy("id").agg(F.min(order).alias("first"), F.first("n").alias("n"), F.first("f").alias("f")), "nodes")
    remove(signed)
    near = connected(candidates(nodes, distance, similarity, block, small))
    suspects = nodes.join(near, nodes["id"] == near["node"]).select("first.row", F.col("root").alias("cluster"), "id", "n", F.col("f")[0].alias("p"), F.col("f")[1].alias("q"))
    wanted = beside(suspects, "suspects")
    brought = written(texts.select("row", "text").mapInPandas(_bring(wanted), "cluster long, id long, n long, p long, q long, text string"), "texts", "zstd", batch=1000)
    dealt = _dealt(brought, "cluster", cluster).select("cluster", "part", "stored", "id", "n", "p", "q", "text")
    links = dealt.repartition("cluster", "part").sortWithinPartitions("cluster", "part", "stored", "id").mapInPandas(_verify(size, distance, similarity), "a long, b long")
    linked = connected(written(links, "links", batch=1000))
    group = written(nodes.join(linked, nodes["id"] == linked["node"], "left").select("id", "first", F.coalesce("root", "id").alias("component")), "groups")
    for table in (nodes, near, brought, linked):
        remove(table)
    remove(wanted, docs.sparkSession)
    return group


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8, **options) -> DataFrame:
    """The rows of ``docs``, unchanged, with one of each component: that of the least doc_id.

    Among rows of equal doc_id the first in the table's order stays.
    """
    group = components(docs, size, similarity, **options)
    out = only(docs, group.groupBy("component").agg(F.min("first").alias("first")).select("first.row"))
    remove(group)
    return out
