"""Vector operators: centroids, nearest centroid, nearest rows, mean embeddings."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Zero where a norm is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def rms_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.size(a))


def centroids(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(grp, n, centroid): element-wise means, summed by (group, place) so that no group is gathered."""
    each = rows.select(F.col(group).alias("grp"), F.posexplode(vector).alias("k", "x"))
    means = each.groupBy("grp", "k").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return means.groupBy("grp").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", "m"))).alias("c")).select("grp", "n", F.transform("c", lambda x: x["m"]).alias("centroid"))


#: Rows of a block that is sent to every task.
SENT = 10_000


def _blocks(df: DataFrame, key: str) -> list[DataFrame]:
    """``df`` in blocks of about SENT rows by a hash of ``key``, each small enough to be sent."""
    n = max(1, -(-df.count() // SENT))
    return [F.broadcast(df.where(F.pmod(F.xxhash64(key), F.lit(n)) == k)) for k in range(n)]


def nearest_centroid(rows: DataFrame, key: str, vector: str, centres: DataFrame) -> DataFrame:
    """(id, grp, distance): the centroid least in rms distance / ln(1 + n); empty ones are skipped.

    More centroids than are sent at once are compared in blocks, each with all rows.
    """
    d = rms_distance(F.col(vector), F.col("centroid")) / F.log1p("n")
    own = rows.select(F.col(key).alias("id"), vector)
    best = [
        own.join(c, F.lit(True)).select("id", "grp", d.alias("distance")).groupBy("id").agg(F.min_by("grp", F.struct(F.round("distance", 9), "grp")).alias("grp"), F.min("distance").alias("distance"))
        for c in _blocks(centres.where("n > 0"), "grp")
    ]
    if len(best) == 1:
        return best[0]
    return reduce(DataFrame.union, best).groupBy("id").agg(F.min_by("grp", F.struct(F.round("distance", 9), "grp")).alias("grp"), F.min("distance").alias("distance"))


def nearest_rows(rows: DataFrame, key: str, vector: str, queries: DataFrame, k: int = 10, least: float = -1.0) -> DataFrame:
    """(query, id, score, rank): the k rows nearest by cosine to each query vector, itself left out.

    A stated set of queries against all rows, in blocks of ``SENT_BYTES`` of queries that are sent to
    every task.  A task holds its unit rows against a block by matrix products and keeps k rows of a
    query; these merge by a ranked window.
    """
    order = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "id")
    sized = queries.select(F.col(key).alias("query"), F.col(vector).cast("array<double>").alias("v")).where("query is not null and v is not null")
    total = sized.agg(F.coalesce(F.sum(F.size("v") * 8 + 16), F.lit(0))).first()[0]
    n = 2 * total // SENT_BYTES + 1
    own, found = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null"), []
    kind = dict(own.dtypes)["id"]
    for part in range(n):
        block = sized.where(F.pmod(F.xxhash64("query"), F.lit(n)) == part).toArrow()  # about half of SENT_BYTES
        if block.num_rows:
            sent = rows.sparkSession.sparkContext.broadcast((block["query"].to_numpy(), _unit(block["v"])))
            found.append(own.mapInArrow(_nearest(sent, k, least), f"query {kind}, id {kind}, score double"))
    if not found:
        return rows.sparkSession.createDataFrame([], f"query {kind}, id {kind}, score double, rank int")
    return reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Bytes of query vectors that are sent to every task at once.
SENT_BYTES = 32 << 20


def _unit(vectors) -> np.ndarray:
    """Rows scaled to length 1; null components and rows of length 0 are zeros."""
    lists = vectors.to_pylist()
    out = np.zeros((len(lists), max(map(len, lists), default=0)))
    for row, x in zip(out, lists, strict=True):
        row[: len(x)] = [0.0 if y is None else y for y in x]
    length = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def _nearest(sent, k: int, least: float, rows: int = 2048, tile: int = 512):
    def task(batches):
        queries, q = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids, v = part["id"].to_numpy(), _unit(part["v"])
                width = min(q.shape[1], v.shape[1])
                by_id = np.argsort(ids, kind="stable")
                ids, v = ids[by_id], v[by_id]
                for t in range(0, len(queries), tile):
                    score = q[t : t + tile, :width] @ v[:, :width].T
                    score[(queries[t : t + tile, None] == ids) | (score < least)] = -np.inf
                    near = np.argsort(-np.round(score, 9), axis=1, kind="stable")[:, :k]
                    kept = np.take_along_axis(score, near, 1)
                    row, col = np.nonzero(kept > -np.inf)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(queries[t + row]), pa.array(ids[near[row, col]]), pa.array(kept[row, col])], ["query", "id", "score"])

    return task


def walsh(values: Column, n: int) -> Column:
    """Walsh-Hadamard coefficients of an array of 2^n values, unnormalised, in n steps of sums and differences."""
    for bit in range(n):
        mask = 1 << bit
        partner = lambda v, j: F.get(v, j.bitwiseXOR(F.lit(mask)))  # noqa: B023, E731
        step = lambda v: F.transform(v, lambda x, j: F.when(j.bitwiseAND(F.lit(mask)) == 0, x + partner(v, j)).otherwise(partner(v, j) - x))  # noqa: B023, E731
        values = F.transform(F.array(values), step)[0]  # binds the array once
    return values


def signs(vector: Column) -> Column:
    """A long with bit k set where element k is positive, for up to 64 elements."""
    return F.aggregate(F.transform(F.slice(vector, 1, 64), lambda x, k: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
