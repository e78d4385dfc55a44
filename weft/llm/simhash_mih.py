"""Operator 8, SimHash near-duplicates by multi-index hashing.

A document's fingerprint: ASCII letters lower-cased, words between ASCII white space, ``size``-word
shingles with repeats (all words where there are fewer; zero without words), XXH64 with seed 42 of
each; a bit is set where it is in over half of the hashes.

Two fingerprints link at ``distance`` or fewer differing bits.  A fingerprint is cut into
segments with radii r so that the sum of (r + 1) exceeds the distance: then every linked pair is
within the radius in some segment.  Each distinct fingerprint is stored under its segments; for
a lookup it enumerates the Hamming ball of each segment's radius.  Of a pair one bit apart, just
one has a zero there, so balls of radius 1 flip zeros alone.  Matches are verified on the whole
fingerprint.

All links are found between distinct fingerprints; equal ones are one node from the start, so a
group of copies of any size costs one row.  Rows come to a task sorted by bucket and are compared
in vectorised slices.  A task emits a link only if it joins fingerprints that it has not joined
yet (a spanning forest): the components stay the same and the output is in proportion to the
rows, not to the square of a group.  A bucket that stores over ``block`` fingerprints is dealt
out: each block of stored ones is a bucket of its own that meets all rows of the whole.

Defined results: null or empty text has fingerprint zero and links like any other.  Repeated rows
each come back.  A null doc_id never serves as a component's smallest id unless all are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .common import id_text, longs, only, remove, row_number, written

#: (first bit, bits, radius): distances (2, 2, 1) or more in all would be five.
SEGMENTS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))


def fingerprint(text: str | None, size: int = 4) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(words) - k + 1
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, n)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(rows: DataFrame, size: int = 4) -> DataFrame:
    """The columns of ``rows`` but for text, and fp, the fingerprint as a signed long."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t, size) for t in batch["text"]], np.uint64).view(np.int64)
            yield batch.drop(columns="text").assign(doc_id=longs(batch["doc_id"]), fp=fp)

    fields = ", ".join(f"`{name}` long" for name in rows.columns if name != "text")
    return rows.mapInPandas(task, f"{fields}, fp long")


def _plain(docs: DataFrame, *more) -> DataFrame:
    return docs.select(id_text(), *more, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _runs(distance: int, forest_limit: int = 1_000_000, slice_pairs: int = 1_000_000):
    """Task over rows (bucket, part, stored, fp) sorted by these: verified links."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.get(top, top)) != top:
                top = up
            while x != top:
                parent[x], x = top, parent.get(x, x)
            return top

        def joins(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
            out = []
            for a, b in pairs:
                x, y = root(a), root(b)
                if x != y:
                    parent[y] = x
                    out.append((a, b))
            return out

        def compare(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            if len(parent) > forest_limit:
                parent.clear()
            fp = rows["fp"].to_numpy(np.int64)
            bucket, part = rows["bucket"].to_numpy(np.int64), rows["part"].to_numpy(np.int64)
            edge = np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])) + 1
            ends = np.repeat(np.append(edge, len(fp)), np.diff(np.concatenate(([0], edge, [len(fp)]))))
            stored = np.flatnonzero(rows["stored"].to_numpy(np.int64) == 0)
            after = ends[stored] - stored - 1
            stored, after = stored[after > 0], after[after > 0]
            cum = np.cumsum(after)
            at = 0
            while at < len(stored):
                to = max(at + 1, int(np.searchsorted(cum, (cum[at - 1] if at else 0) + slice_pairs, "right")))
                i, n = stored[at:to], after[at:to]
                left = np.repeat(i, n)
                right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
                near = np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64)) <= distance
                left, right = fp[left[near]], fp[right[near]]
                if found := joins(list(zip(left.tolist(), right.tolist(), strict=True))):
                    yield pd.DataFrame(found, columns=["a", "b"])
                at = to

        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = (rows["bucket"] != rows["bucket"].iloc[-1]) | (rows["part"] != rows["part"].iloc[-1])
            cut = len(rows) - int((~last).sum())
            if cut:
                yield from compare(rows.iloc[:cut])
            held = rows.iloc[cut:].reset_index(drop=True)
            if len(held) > 64 * BLOCK:  # a long run: its stored rows stand first and stay, the others pass by
                yield from compare(held)
                held = held[held["stored"] == 0]
        if held is not None and len(held):
            yield from compare(held)

    return task


#: Stored fingerprints of a bucket that one task compares with the bucket's rows.
BLOCK = 4096


def _ball(segment: Column, bits: int) -> Column:
    """The segment's neighbours with one zero of its lowest ``bits`` set."""
    zeros = F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.call_function("getbit", segment, i) == 0)
    one = F.lit(1).cast("long")
    return F.transform(zeros, lambda i: F.struct(segment.bitwiseOR(F.call_function("shiftleft", one, i)).alias("bucket"), F.lit(1).alias("stored")))


def links(nodes: DataFrame, distance: int = 4, segments=SEGMENTS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that span all components."""
    if sum(r + 1 for _, _, r in segments) <= distance or any(r > 1 for _, _, r in segments):
        raise ValueError("radii of 0 or 1 must add up, with one for each segment, to over the distance")
    keys = []
    for k, (low, bits, radius) in enumerate(segments):
        here = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.lit(k << 56))
        keys.append(F.array(F.struct(here.alias("bucket"), F.lit(0).alias("stored"))))
        if radius:
            keys.append(_ball(here, bits))
    rows = nodes.select("fp", F.explode(F.concat(*keys)).alias("k")).select("k.bucket", "k.stored", "fp")
    return spanning(rows, distance, block)


def spanning(rows: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """(a, b): close pairs among ``rows`` (bucket, stored, fp) that span all components.

    Of the rows of a bucket those with stored = 0 are compared with all others.
    """
    full = rows.where("stored = 0").groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > block)
    parts = F.when(F.col("n").isNull(), F.lit(1)).otherwise(F.ceil(F.col("n") / block)).cast("long")
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    dealt = (
        rows.join(full, "bucket", "left")
        .withColumn("parts", parts)
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select("bucket", "part", F.when((F.col("stored") == 0) & (F.col("part") == own), 0).otherwise(1).alias("stored"), "fp")
    )
    return (
        dealt.repartition("bucket", "part")
        .sortWithinPartitions("bucket", "part", "stored", "fp")
        .mapInPandas(_runs(distance), "a long, b long")
    )


def _grouped(fps: DataFrame, distance: int) -> DataFrame:
    """(fp, component): a root fingerprint for every distinct fingerprint."""
    nodes = fps.select("fp").distinct()
    found = connected(links(nodes, distance))
    return nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("component"))


def near_duplicates(docs: DataFrame, size: int = 4, distance: int = 4) -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id)."""
    fps = written(fingerprints(_plain(docs), size), "fingerprints")
    group = written(_grouped(fps, distance), "components")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(group, "fp")
    ids = least.groupBy("component").agg(F.min("least").alias("component_id"))
    return (
        fps.join(group.join(ids, "component").select("fp", "component_id"), "fp")
        .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    )


def keep_one(docs: DataFrame, size: int = 4, distance: int = 4) -> DataFrame:
    """The rows of ``docs``, unchanged, with one of each component: that of the least doc_id.

    Among rows of equal doc_id the first in the table's order stays.
    """
    fps = written(fingerprints(_plain(docs, row_number(docs).alias("row")), size), "fingerprints")
    group = _grouped(fps, distance)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = fps.groupBy("fp").agg(F.min(order).alias("first")).join(group, "fp").groupBy("component").agg(F.min("first").alias("first"))
    out = only(docs, first.select("first.row"))
    remove(fps)
    return out
