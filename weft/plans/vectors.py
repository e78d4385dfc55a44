"""Vector queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vectors as v
from .registry import query

CENTRES = """
WITH e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings),
c AS (SELECT label AS grp, k, avg(x) AS m, count(*) AS n FROM e GROUP BY 1, 2)
"""


@query(CENTRES + "SELECT grp, k::INT AS k, n, round(m, 6) AS m FROM c")
def centroids(t):
    """Mean embedding of each class, one row per dimension."""
    c = v.centroids(t("embeddings"), "label", "embedding")
    return c.select("grp", F.posexplode("centroid").alias("k", "m"), "n").select("grp", (F.col("k") + 1).alias("k"), "n", "m")


@query(CENTRES + """, d AS (SELECT vec_id AS id, grp, sqrt(sum((x - m) * (x - m)) / count(*)) / ln(1 + any_value(n)) AS distance FROM e JOIN c USING (k) GROUP BY 1, 2)
SELECT id, arg_min(grp, (round(distance, 9), grp)) AS grp, round(min(distance), 6) AS distance FROM d GROUP BY 1""")
def nearest_centroids(t):
    e = t("embeddings")
    return v.nearest_centroid(e, "vec_id", "embedding", v.centroids(e, "label", "embedding"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY 1),
s AS (SELECT q.vec_id AS query, r.vec_id AS id, sum(q.x * r.x) / any_value(a.n * b.n) AS score FROM e q JOIN e r ON q.k = r.k AND q.vec_id <> r.vec_id JOIN n a ON a.vec_id = q.vec_id JOIN n b ON b.vec_id = r.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1, 2)
SELECT query, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id)::INT AS rank FROM s) WHERE rank <= 10""")
def nearest_rows(t):
    """The ten nearest rows of every vector whose id is divisible by 20."""
    e = t("embeddings")
    return v.nearest_rows(e, "vec_id", "embedding", e.where(F.col("vec_id") % 20 == 0), 10)


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def norms(t):
    return t("embeddings").select("vec_id", v.norm(F.col("embedding")).alias("norm"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS j FROM embeddings)
SELECT vec_id, k::INT AS k, round(sum(x * CASE WHEN bit_count((k & j)::BIGINT) % 2 = 1 THEN -1 ELSE 1 END), 6) AS c FROM e, range(0, 64) r(k) GROUP BY 1, 2""")
def walsh_spectrum(t):
    """Walsh-Hadamard coefficients of all dimensions."""
    w = v.walsh(F.transform("embedding", lambda x: x.cast("double")), 6)
    return t("embeddings").select("vec_id", F.posexplode(w).alias("k", "c"))


@query("""SELECT vec_id, sum(CASE WHEN x > 0 THEN CASE WHEN k = 64 THEN -9223372036854775808 ELSE 1::BIGINT << (k - 1) END ELSE 0 END)::BIGINT AS signs FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(1, 65)) AS k FROM embeddings) GROUP BY 1""")
def sign_sketches(t):
    return t("embeddings").select("vec_id", v.signs(F.col("embedding")).alias("signs"))
