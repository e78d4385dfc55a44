"""Evidence, phase and lattice queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as e
from .registry import query


@query("""WITH x AS (SELECT p_brand AS grp, (p_size % 11) / 10.0 AS p, p_partkey % 7 AS n FROM part), w AS (SELECT *, abs(p - 0.5) * least(ln(1 + n), ln(4)) AS w FROM x),
s AS (SELECT grp, sum(w * sqrt(p)) AS a, sum(w * sqrt(1 - p)) AS b, count(*) AS axes FROM w GROUP BY 1)
SELECT grp, round(CASE WHEN a * a + b * b > 0 THEN a * a / (a * a + b * b) ELSE 0.5 END, 6) AS p, axes FROM s""")
def mixed_evidence(t):
    return e.mixed(t("part").select("p_brand", ((F.col("p_size") % 11) / 10.0).alias("p"), (F.col("p_partkey") % 7).alias("n")), "p_brand", "p", "n")


@query("""WITH x AS (SELECT event_type AS grp, value AS s, event_id % 628 / 100.0 AS a FROM events), s AS (SELECT grp, sum(s * cos(a)) AS x, sum(s * sin(a)) AS y, sum(abs(s)) AS t, avg(cos(a)) AS u, avg(sin(a)) AS v FROM x GROUP BY 1)
SELECT grp, round(sqrt(x * x + y * y) / t, 6) AS certainty, round(atan2(y, x), 5) AS phase, round(sqrt(u * u + v * v), 6) AS coherence FROM s""")
def phase_mix(t):
    return e.phase_mix(t("events").select("event_type", "value", (F.col("event_id") % 628 / 100.0).alias("a")), "event_type", "value", "a").withColumn("phase", F.round("phase", 5))


@query("""WITH x AS (SELECT vec_id, embedding[1]::DOUBLE / 10 AS ax, embedding[2]::DOUBLE / 10 AS ay, embedding[3]::DOUBLE / 10 AS bx, embedding[4]::DOUBLE / 10 AS b_y FROM embeddings)
SELECT vec_id, round(acosh(1 + 2 * ((ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y)) / ((1 - ax * ax - ay * ay) * (1 - bx * bx - b_y * b_y))), 6) AS distance FROM x""")
def hyperbolic_distance(t):
    x = [F.get("embedding", F.lit(k)).cast("double") / 10 for k in range(4)]
    return t("embeddings").select("vec_id", e.hyperbolic_distance(*x).alias("distance"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(pow(greatest(l_discount, 1e-12) * greatest(l_tax, 1e-12) * greatest(l_quantity, 1e-12), 1.0::DOUBLE / 3), 6) AS blend FROM lineitem")
def geometric_blend(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", e.geometric_blend(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")).alias("blend"))


@query("""SELECT l_orderkey AS grp, round(CASE WHEN count(*) > 1 THEN least(1, greatest(0, (pow(sum(l_quantity), 2) / sum(l_quantity * l_quantity) - 1) / (count(*) - 1))) ELSE 0 END, 6) AS reach FROM lineitem GROUP BY 1""")
def order_reach(t):
    return e.reach(t("lineitem"), "l_orderkey", "l_quantity")


@query("SELECT user_id AS grp, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS variance FROM events GROUP BY 1")
def running_stats(t):
    return e.running_stats(t("events"), "user_id", "value").withColumn("variance", F.round("variance", 4))


@query("""WITH p AS (SELECT event_type, count(*) AS c FROM events GROUP BY 1), t AS (SELECT sum(c + 1) AS t FROM p)
SELECT user_id AS grp, round(avg(-ln((c + 1) / t)), 6) AS surprise FROM events JOIN p USING (event_type), t GROUP BY 1""")
def user_surprise(t):
    return e.surprise(t("events"), "user_id", "event_type")


@query("""WITH c AS (SELECT p_size & 15 AS cell, count(*)::DOUBLE AS v FROM part GROUP BY 1) SELECT s.i::BIGINT AS cell, round(sum(v), 6) AS v FROM range(16) s(i) JOIN c ON (c.cell & s.i) = c.cell GROUP BY 1""")
def subset_sums(t):
    """Sums over the subsets of the lattice of the lowest four bits of a part's size."""
    return e.subset_sums(t("part").groupBy(F.col("p_size").bitwiseAND(F.lit(15)).alias("cell")).agg(F.count("*").alias("v")), 4)


@query("SELECT p_size & 15 AS cell, count(*)::DOUBLE AS v FROM part GROUP BY 1")
def subset_inverse(t):
    """Inversion of the subset sums gives the cells back."""
    cells = t("part").groupBy(F.col("p_size").bitwiseAND(F.lit(15)).alias("cell")).agg(F.count("*").alias("v"))
    return e.subset_sums(e.subset_sums(cells, 4), 4, invert=True).select(F.col("cell").cast("int").alias("cell"), "v").where("v <> 0")


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS j FROM embeddings),
w AS (SELECT vec_id, k, sum(x * CASE WHEN bit_count((k & j)::BIGINT) % 2 = 1 THEN -1 ELSE 1 END) AS c FROM e, range(0, 64) r(k) GROUP BY 1, 2)
SELECT vec_id AS grp, bit_count(k::BIGINT)::INT AS bits, round(sum(c * c), 5) AS energy FROM w GROUP BY 1, 2""", places=5)
def order_spectrum(t):
    from ..operators import vectors as v

    w = v.walsh(F.transform("embedding", lambda x: x.cast("double")), 6)
    return e.order_spectrum(t("embeddings").select(F.col("vec_id").alias("grp"), F.posexplode(w).alias("k", "c")))


@query("SELECT (l_partkey % 256) * 256 + l_suppkey % 256 AS cell, round(sum(l_quantity), 6) AS mass FROM lineitem GROUP BY 1")
def joint_histogram(t):
    return e.joint_histogram(t("lineitem"), F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_quantity"))


@query("""WITH m AS (SELECT unnest([1, 2, 4, 3, 7]) AS mask, unnest([0, 1, 2, 3, 4]) AS k)
SELECT l_orderkey AS grp, k::INT AS k, round(sum(l_quantity * (1 - 2 * (bit_count((l_partkey % 256) & mask) % 2))), 6) AS v FROM lineitem, m GROUP BY 1, 2""")
def parity_signature(t):
    return e.parity_signature(t("lineitem"), "l_orderkey", F.col("l_partkey") % 256, F.col("l_quantity"), [1, 2, 4, 3, 7])


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, greatest(500, least(15000, round(l_quantity * 200))) AS cost FROM lineitem),
r AS (SELECT *, row_number() OVER w AS n, sum(cost) OVER (w ROWS UNBOUNDED PRECEDING) AS run FROM c WINDOW w AS (PARTITION BY l_orderkey ORDER BY cost DESC, l_linenumber, l_partkey))
SELECT l_orderkey, l_linenumber, l_partkey, round(cost, 6) AS cost FROM r WHERE run <= 16000 OR n = 1""")
def budget_prefix(t):
    cost = F.greatest(F.lit(500.0), F.least(F.lit(15000.0), F.round(F.col("l_quantity") * 200)))
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", cost.alias("cost"))
    return e.budget_prefix(rows, "l_orderkey", [F.col("cost").desc(), F.col("l_linenumber"), F.col("l_partkey")], F.col("cost"), 16000.0)


@query()
def budget_fill(t):
    """Greedy packs of each order's lines under 60 units, largest first."""
    return e.budget_fill(t("lineitem"), "l_orderkey", "l_partkey", [-F.col("l_quantity"), F.col("l_linenumber")], F.col("l_quantity"), 60)


@query("""WITH o AS (SELECT o_custkey AS c, list_distinct(list(l_partkey) FILTER (o_orderdate < TIMESTAMP '1998-01-01')) AS a, list_distinct(list(l_partkey) FILTER (o_orderdate >= TIMESTAMP '1998-01-01')) AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
s AS (SELECT c, len(list_intersect(coalesce(a, []), coalesce(b, [])))::INT AS shared, len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) AS u FROM o)
SELECT c AS customer, shared, round(CASE WHEN u > 0 THEN shared / u ELSE 0 END, 6) AS jaccard, CASE WHEN shared = 0 THEN 'apart' WHEN shared / u >= 0.5 THEN 'aligned' ELSE 'touching' END AS label FROM s""")
def set_overlap(t):
    """How far a customer's parts before and from 1998 are the same."""
    cut = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    rows = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    sets = rows.groupBy(F.col("o_custkey").alias("customer")).agg(F.collect_set(F.when(cut, F.col("l_partkey"))).alias("a"), F.collect_set(F.when(~cut, F.col("l_partkey"))).alias("b"))
    return sets.select("customer", e.set_overlap(F.col("a"), F.col("b")).alias("x")).select("customer", "x.*")
