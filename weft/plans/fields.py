"""Fields: parts of a supplier by quantity, and embeddings as eigenvectors of a graph for each class."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings as s
from ..operators import fields as f
from .registry import query
from .spectrum import VALUES, modes

FIELDS = "WITH f AS (SELECT l_suppkey AS key, l_partkey AS node, sum(l_quantity)::DOUBLE AS value FROM lineitem GROUP BY 1, 2)"
MODES = VALUES + ", m AS (SELECT label AS grp, grp AS mode, grp / 1000.0 AS value, mode AS node, x AS u FROM v)"


def fields(t):
    return t("lineitem").groupBy(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("node")).agg(F.sum("l_quantity").cast("double").alias("value"))


def next_suppliers(t):
    return t("supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b")).join(t("supplier").select(F.col("s_suppkey").alias("b")), "b", "left_semi")


@query(FIELDS + """, p AS (SELECT x.s_suppkey AS a, x.s_suppkey + 1 AS b FROM supplier x JOIN supplier y ON y.s_suppkey = x.s_suppkey + 1), n AS (SELECT key, sqrt(sum(value * value)) AS n FROM f GROUP BY 1),
d AS (SELECT a, b, sum(x.value * y.value) AS xy, sum(sqrt(x.value * y.value)) AS r FROM p JOIN f x ON x.key = a JOIN f y ON y.key = b AND y.node = x.node GROUP BY 1, 2)
SELECT p.a, p.b, round(coalesce(xy / (u.n * w.n), 0), 6) AS cosine, round(coalesce(r, 0), 6) AS overlap FROM p LEFT JOIN d ON d.a = p.a AND d.b = p.b LEFT JOIN n u ON u.key = p.a LEFT JOIN n w ON w.key = p.b WHERE u.n IS NOT NULL OR w.n IS NOT NULL""")
def field_similarity(t):
    """Neighbouring suppliers by what they sent."""
    return f.compare_fields(fields(t), next_suppliers(t))


@query("""WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS x FROM embeddings)
SELECT a.label AS grp, (SELECT count(*) FROM e WHERE e.label = a.label) AS fields, round(avg(list_cosine_similarity(a.x, b.x)), 6) AS coherence FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1""")
def class_coherence(t):
    rows = t("embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("key"), F.posexplode("embedding").alias("node", "value"))
    return f.coherence(rows.withColumn("value", F.col("value").cast("double")))


@query(FIELDS + """, c AS (SELECT p_partkey AS node, unnest(string_split(p_name, ' ')) AS token FROM part), k AS (SELECT node, token, count(*) AS n FROM c GROUP BY 1, 2)
SELECT key, token, round(sum(value * n / total), 6) AS expected FROM f JOIN (SELECT *, sum(n) OVER (PARTITION BY node) AS total FROM k) USING (node) GROUP BY 1, 2""")
def expected_names(t):
    tokens = t("part").select(F.col("p_partkey").alias("node"), F.explode(F.split("p_name", " ")).alias("token")).groupBy("node", "token").agg(F.count("*").alias("n"))
    return f.expected_tokens(fields(t), tokens)


@query("""WITH b AS (SELECT p_brand, sum(p_size * p_retailprice) AS value FROM part GROUP BY 1) SELECT p_partkey AS fine, round(p_size * value, 6) AS value FROM part JOIN b USING (p_brand)""", places=4)
def brand_levels(t):
    """Prices summed up to brands by size and handed down again; rounding is to the price's digits."""
    members = t("part").select(F.col("p_partkey").alias("fine"), F.col("p_brand").alias("coarse"), F.col("p_size").cast("double").alias("w"))
    up = f.restrict(members, t("part").select(F.col("p_partkey").alias("fine"), F.col("p_retailprice").alias("value")))
    return f.prolongate(members, up)


@query(MODES + """SELECT a.grp, a.node AS x, b.node AS y, round(sum((a.u - b.u) * (a.u - b.u) / a.value), 6) AS resistance FROM m a JOIN m b ON b.grp = a.grp AND b.mode = a.mode AND b.node > a.node WHERE a.value > 1e-9 AND a.node < 4 AND b.node < 4 GROUP BY 1, 2, 3""")
def node_resistance(t):
    """Between each two of the first four dimensions."""
    m = modes(t)
    few = m.where("node < 4").select("grp", "node").distinct()
    pairs = few.withColumnRenamed("node", "x").join(few.withColumnRenamed("node", "y"), "grp").where("x < y")
    return f.effective_resistance(m, pairs)


@query(MODES + """, p AS (SELECT grp, node % 3 AS set_id, mode, sum(u) AS p FROM m GROUP BY ALL), s AS (SELECT grp, set_id, sqrt(sum(p * p)) AS spread FROM p GROUP BY 1, 2),
d AS (SELECT x.grp, x.set_id, sqrt(sum((x.p - y.p) * (x.p - y.p))) AS distance FROM p x JOIN p y ON y.grp = x.grp AND y.mode = x.mode AND y.set_id = (x.set_id + 1) % 3 GROUP BY 1, 2)
SELECT grp, set_id::INT AS set_id, round(spread, 6) AS spread, round(distance, 6) AS distance FROM s JOIN d USING (grp, set_id)""")
def set_spectra(t):
    """Every third dimension is one set; its spread, and the distance to the next set."""
    m = modes(t)
    sets = m.select("node").distinct().withColumn("set_id", (F.col("node") % 3).cast("int"))
    p = f.set_projections(m, sets)
    pairs = sets.select(F.col("set_id").alias("a"), ((F.col("set_id") + 1) % 3).cast("int").alias("b")).distinct()
    return f.spectral_spread(p).join(f.set_distance(p, pairs).withColumnRenamed("a", "set_id").drop("b"), ["grp", "set_id"])


@query("""WITH e AS (SELECT label AS series, vec_id AS step, embedding::DOUBLE[] AS b FROM embeddings), w AS (SELECT series, step, b, lag(b) OVER o AS a, lead(b) OVER o AS c FROM e WINDOW o AS (PARTITION BY series ORDER BY step)),
x AS (SELECT series, step, list_cosine_similarity([b[i] - a[i] for i in range(1, len(b) + 1)], [c[i] - b[i] for i in range(1, len(b) + 1)]) AS cosine FROM w WHERE a IS NOT NULL AND c IS NOT NULL)
SELECT series, step, round(cosine, 6) AS cosine, round(acos(cosine), 6) AS angle FROM x""")
def trajectory_turns(t):
    return f.turning(t("embeddings").select(F.col("label").alias("series"), F.col("vec_id").alias("step"), F.col("embedding").cast("array<double>").alias("spectrum")))


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS query, l_suppkey AS item FROM lineitem WHERE l_linenumber < 4), h AS (SELECT l_orderkey AS query, l_suppkey AS item, count(DISTINCT l_linenumber) AS hits FROM lineitem GROUP BY 1, 2)
SELECT query, count(*) AS items, round(count(*) FILTER (hits >= 2) / count(*), 6) AS confidence FROM a JOIN h USING (query, item) GROUP BY 1""")
def sampled_consensus(t):
    """Suppliers of an order's first lines, with each line as a sample of three."""
    l = t("lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("sample"), F.col("l_suppkey").alias("item"))
    return f.consensus(l.where("sample < 4"), l, 3)


@query("""WITH c AS (SELECT p_partkey, len(p_name) AS n, [ord(x) & 63 for x in string_split(p_name, '')] AS c FROM part),
b AS (SELECT p_partkey, list_distinct(c) AS chars, list_distinct([(c[i] * 37 + c[i + 1]) & 63 for i in range(1, n)]) AS pairs FROM c)
SELECT p_partkey, list_sum([CASE k WHEN 63 THEN -9223372036854775808 ELSE (1::HUGEINT << k) END for k in chars])::BIGINT AS chars, list_sum([CASE k WHEN 63 THEN -9223372036854775808 ELSE (1::HUGEINT << k) END for k in pairs])::BIGINT AS pairs FROM b""")
def name_bitmaps(t):
    return t("part").select("p_partkey", s.char_bits(F.col("p_name")).alias("chars"), s.bigram_bits(F.col("p_name")).alias("pairs"))
