"""Operator 11, hard-negative mining: blocked dense products in float64.

Anchors are broadcast in blocks of at most ``BLOCK_BYTES``; every task holds its candidates against a
block by matrix products.  A first pass keeps the five best positives of each anchor for each task,
which merge by a ranked window.  A second pass goes over the candidates again with the positives'
scores in the block and keeps, for each anchor and positive, the best ``negatives`` of other labels
whose score lies in the positive's window; those merge in the same way.

Components are floor(256 * x) as doubles, so products and sums are whole numbers and exact below
2^53; a block whose bound on a score (largest components times width) reaches 2^53 is multiplied in
Python's integers instead, and scores beyond the range of a long count as the end of that range.

Defined results: rows with a null id, label or vector, or with a component that is null, NaN or
infinite, take no part.  Where vec_id is divisible by 7 the label is (label + 1) % 10 first.  A row
is "other" than an anchor if its vec_id differs; repeated rows are rows of their own, as anchors too,
and tie as any rows of one score and vec_id do.  Components that a shorter vector lacks count as zero;
an empty vector scores zero.  An anchor without positives, and a positive without negatives in its
window, give no row.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder, remove, row_number, written

EXACT, LONG = float(1 << 53), (1 << 63) - 1
#: Bytes of one broadcast block of anchors, in float64.
BLOCK_BYTES = 32 << 20
#: Anchors and candidates that are multiplied at once.
TILE, ROWS = 256, 4096


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, embedding) of the rows that take part, their labels moved."""
    whole = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return (
        vectors.select(row_number(vectors).alias("row"), F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
        .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
    )


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of floor(256 * x); shorter ones end in zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.diff(vectors.offsets.to_numpy())
    flat, width = np.floor(256.0 * vectors.flatten().to_numpy(zero_copy_only=False)), int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b``: float64 where exact, else Python integers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, width) < EXACT:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, -LONG - 1, LONG) if width else np.zeros((len(a), len(b)))


def merged(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best along the last axis: higher scores first, then smaller ids."""
    if scores.dtype == object:
        flat = list(zip(scores.reshape(-1, scores.shape[-1]), ids.reshape(-1, ids.shape[-1]), strict=True))
        order = np.array([sorted(range(len(s)), key=lambda j: (-s[j], i[j]))[:k] for s, i in flat]).reshape(*scores.shape[:-1], -1)  # noqa: B023
    else:
        order = np.lexsort((ids, -scores), axis=-1)[..., :k]
    return np.take_along_axis(scores, order, -1), np.take_along_axis(ids, order, -1)


def best(scores: np.ndarray, ids: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``scores`` the ``k`` best where ``wanted``; ``ids`` (of the columns) ascend."""
    nothing = -np.inf
    left = np.where(wanted, scores, nothing)
    out, who, rows = np.full((len(left), k), nothing, scores.dtype), np.zeros((len(left), k), np.int64), np.arange(len(left))
    for j in range(min(k, left.shape[1])):
        at = np.argmax(left, axis=1)  # the first of equal ones, which has the smallest id
        out[:, j], who[:, j] = left[rows, at], ids[at]
        left[rows, at] = nothing
    return out, who


class Block:
    """Anchors as a task sees them: rows, ids, labels, matrix and, in the second pass, positives."""

    def __init__(self, rows: pa.Table, positives: np.ndarray | None = None):
        self.row, self.ids, self.labels = (rows[c].to_numpy() for c in ("row", "vec_id", "label"))
        self.vectors, self.positives = matrix(rows["embedding"]), positives


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = pa.Table.from_batches([batch.slice(at, ROWS)]).sort_by("vec_id")
            yield part["vec_id"].to_numpy(), part["label"].to_numpy(), matrix(part["embedding"])


def _rows(block: Block, found: list, names: list[str]):
    """Arrow rows of what a task has found: (anchor's row, slot, vec_id, score)."""
    for at, (scores, ids) in enumerate(found):
        scores, ids = scores.reshape(len(scores), -1), ids.reshape(len(ids), -1)
        where, slot = np.nonzero(scores != -np.inf)
        if len(where):
            values = [block.row[at * TILE + where], slot, ids[where, slot], scores[where, slot].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], names)


def _positives(block, k: int):
    def task(batches):
        anchors, found = block.value, None
        tiles = [slice(t, t + TILE) for t in range(0, len(anchors.row), TILE)]
        for ids, labels, vectors in _slices(batches):
            for n, tile in enumerate(tiles):
                scores = products(anchors.vectors[tile], vectors)
                wanted = (anchors.labels[tile, None] == labels) & (anchors.ids[tile, None] != ids)
                now = best(scores, ids, wanted, k)
                if found is None:
                    found = [None] * len(tiles)
                found[n] = now if found[n] is None else merged(*(np.concatenate(x, -1) for x in zip(found[n], now, strict=True)), k)
        yield from _rows(anchors, found or [], ["row", "slot", "vec_id", "score"])

    return task


def _negatives(block, k: int, low: int, high: int):
    """``low`` and ``high``: hundredths of the positive's score between which a negative's lies."""

    def task(batches):
        anchors, found = block.value, None
        tiles = [slice(t, t + TILE) for t in range(0, len(anchors.row), TILE)]
        # Bounds as whole numbers; a missing positive has an empty window.
        bounds = [[None if p is None else (-(-low * p // 100), high * p // 100) for p in row] for row in anchors.positives]
        kind = object if any(b and max(map(abs, b)) >= EXACT for row in bounds for b in row) else np.float64
        least = np.array([[np.inf if b is None else b[0] for b in row] for row in bounds], kind)
        most = np.array([[-np.inf if b is None else b[1] for b in row] for row in bounds], kind)
        for ids, labels, vectors in _slices(batches):
            for n, tile in enumerate(tiles):
                scores = products(anchors.vectors[tile], vectors)
                other = anchors.labels[tile, None] != labels
                each = [best(scores, ids, other & (scores >= least[tile, j, None]) & (scores <= most[tile, j, None]), k) for j in range(least.shape[1])]
                now = tuple(np.stack(x, 1) for x in zip(*each, strict=True))
                if found is None:
                    found = [None] * len(tiles)
                found[n] = now if found[n] is None else merged(*(np.concatenate(x, -1) for x in zip(found[n], now, strict=True)), k)
        yield from _rows(anchors, found or [], ["row", "slot", "vec_id", "score"])

    return task


def _ranked(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The ``k`` best of each group; the window's limit is applied before the shuffle already."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def anchor_blocks(anchors: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """``anchors`` with a column ``block``, and the number of blocks, none above ``block_bytes``."""
    size = F.lit(32) + 8 * F.size("embedding")
    n = 2 * (anchors.agg(F.sum(size)).first()[0] or 0) // block_bytes + 1
    while True:
        dealt = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n)))
        rows, largest = dealt.groupBy("block").agg(F.count("*").alias("n"), F.sum(size).alias("b")).agg(F.max("n"), F.max("b")).first()
        if not rows or largest <= block_bytes or rows == 1:
            return dealt, n
        n *= 2


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Hard negatives of the rows where ``anchor`` (over vec_id, label) holds.

    (anchor_id, positive_id, rank, negative_id, positive_score, negative_score), ``rank`` from 1.
    A negative's score lies between ``low`` and ``high`` hundredths of the positive's.
    """
    spark = vectors.sparkSession
    candidates = usable(vectors)
    anchors, n = anchor_blocks(written(candidates.where(anchor), "anchors"), block_bytes)
    anchors = written(anchors.repartition(max(1, min(n, 64)), "block"), "blocks")
    folder, triples = new_folder(spark, "mined"), "row long, slot long, vec_id long, score long"
    pairs = candidates.select("vec_id", "label", "embedding")
    for k in range(n):
        rows = anchors.where(F.col("block") == k).select("row", "vec_id", "label", "embedding").toArrow().sort_by("row")  # at most block_bytes
        if not rows.num_rows:
            continue
        block = spark.sparkContext.broadcast(Block(rows))
        found = written(_ranked(pairs.mapInArrow(_positives(block, positives), triples).drop("slot"), ["row"], positives), "positives")
        block.unpersist()
        place = {r: i for i, r in enumerate(rows["row"].to_pylist())}
        scores = [[None] * positives for _ in place]
        for row, rank, score in zip(*(c.to_pylist() for c in found.select("row", "rank", "score").toArrow().columns), strict=True):  # ``positives`` for each anchor of the block
            scores[place[row]][rank - 1] = score
        block = spark.sparkContext.broadcast(Block(rows, scores))
        mined = pairs.mapInArrow(_negatives(block, negatives, low, high), triples).withColumn("slot", F.expr(f"cast(slot div {negatives} as int)"))
        best_of = _ranked(mined, ["row", "slot"], negatives)
        names = anchors.where(F.col("block") == k).select("row", F.col("vec_id").alias("anchor_id"))
        with_positive = found.select("row", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        out = best_of.select("row", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(with_positive, ["row", "slot"]).join(names, "row")
        out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score").write.mode("append").parquet(folder)
        block.unpersist()
        remove(found)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not anchors.take(1):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score FROM v AS a JOIN v AS b ON a.vec_id % 50 = 0 AND (a.label <> b.label OR a.vec_id <> b.vec_id)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id))::INTEGER AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
