"""Coupling queries: a transaction is an order, an item a part, mass the quantity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import coupling as c
from .registry import query

BASE = """
WITH items AS (SELECT l_orderkey AS txn, l_partkey AS item, greatest(1.0, sum(l_quantity)) AS mass FROM lineitem GROUP BY 1, 2),
sized AS (SELECT *, count(*) OVER (PARTITION BY txn) AS n FROM items),
pairs AS (SELECT x.txn, x.item AS a, y.item AS b, x.mass AS ma, y.mass AS mb FROM sized x JOIN sized y ON x.txn = y.txn AND x.item < y.item WHERE x.n >= 2),
degree AS (SELECT item, count(*) AS n FROM items GROUP BY 1),
edges AS (SELECT a, b, p.t AS together, p.t / (da.n + db.n - p.t) AS score FROM (SELECT a, b, count(*) AS t FROM pairs GROUP BY 1, 2) p JOIN degree da ON da.item = a JOIN degree db ON db.item = b),
sym AS (SELECT a AS src, b AS dst, score AS w FROM edges UNION ALL SELECT b, a, score FROM edges),
ranks AS (SELECT o_orderkey AS txn, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS rank FROM orders)
"""
#: A shadow history: lines that were returned.
SHADOW = BASE + """,
sitems AS (SELECT l_suppkey AS txn, l_partkey AS item FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
ssized AS (SELECT *, count(*) OVER (PARTITION BY txn) AS n FROM sitems),
sdeg AS (SELECT item, count(*) AS n FROM sitems GROUP BY 1),
ritems AS (SELECT l_orderkey AS txn, l_partkey AS item FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
rsized AS (SELECT *, count(*) OVER (PARTITION BY txn) AS n FROM ritems),
rdeg AS (SELECT item, count(*) AS n FROM ritems GROUP BY 1),
shadow AS (SELECT a, b, t / (da.n + db.n - t) AS score FROM (SELECT x.item AS a, y.item AS b, count(*) AS t FROM rsized x JOIN rsized y ON x.txn = y.txn AND x.item < y.item WHERE x.n >= 2 GROUP BY 1, 2) JOIN rdeg da ON da.item = a JOIN rdeg db ON db.item = b),
litems AS (SELECT l_orderkey AS txn, l_partkey AS item FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2),
lsized AS (SELECT *, count(*) OVER (PARTITION BY txn) AS n FROM litems),
ldeg AS (SELECT item, count(*) AS n FROM litems GROUP BY 1),
live AS (SELECT a, b, t / (da.n + db.n - t) AS score FROM (SELECT x.item AS a, y.item AS b, count(*) AS t FROM lsized x JOIN lsized y ON x.txn = y.txn AND x.item < y.item WHERE x.n >= 2 GROUP BY 1, 2) JOIN ldeg da ON da.item = a JOIN ldeg db ON db.item = b)
"""


def items(t, where: str | None = None):
    rows = t("lineitem") if where is None else t("lineitem").where(where)
    return c.transaction_items(rows, "l_orderkey", "l_partkey", F.col("l_quantity"))


def edges(t, where: str | None = None):
    return c.jaccard_edges(items(t, where))


def ranks(t):
    """(txn, rank, age, meaning): newest first.  Ranks come from per-day counts, so that no single
    task orders all transactions."""
    orders = t("orders").select(F.col("o_orderkey").alias("txn"), F.col("o_orderdate").alias("at"))
    daily = orders.groupBy("at").agg(F.count("*").alias("n"))
    before = daily.select("at", F.coalesce(F.sum("n").over(Window.orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("at").orderBy(F.col("txn").desc())) - 1
    rank = F.col("before") + within
    return orders.join(before, "at").select("txn", rank.alias("rank"), rank.alias("age"), F.lit(1.0).alias("meaning"))


def seeds(t):
    return t("part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("seed"))


@query(BASE + "SELECT a, b, together, round(score, 6) AS score FROM edges")
def coupling_edges(t):
    """Unweighted co-occurrence Jaccard of parts that share an order."""
    return edges(t)


@query(BASE + """, size AS (SELECT txn, count(*) AS s FROM items GROUP BY 1),
w AS (SELECT txn, pow(2.0, -rank / 200.0) * least(1.0, 60.0 / s) AS w FROM size JOIN ranks USING (txn)),
tot AS (SELECT item, sum(w * mass) AS t FROM items JOIN w USING (txn) GROUP BY 1),
sh AS (SELECT a, b, sum(w * sqrt(ma * mb)) AS c FROM pairs JOIN w USING (txn) GROUP BY 1, 2)
SELECT a, b, round(c / (x.t + y.t - c), 6) AS score FROM sh JOIN tot x ON x.item = a JOIN tot y ON y.item = b WHERE x.t + y.t - c > 0""")
def coupling_decayed(t):
    """Mass-weighted Jaccard that halves every 200 orders."""
    return c.decayed_edges(items(t), ranks(t), 200.0)


@query(BASE + """, size AS (SELECT txn, count(*) AS s FROM items GROUP BY 1),
r AS (SELECT item, mass, rank, pow(2.0, -rank / 2000.0) AS w, least(1.0, 60.0 / s) AS k FROM items JOIN size USING (txn) JOIN ranks USING (txn))
SELECT least(x.item, y.item) AS a, greatest(x.item, y.item) AS b, round(sum(x.k * y.k * sqrt(x.w * y.w) / (1 + y.rank - x.rank) * sqrt(x.mass * y.mass)), 6) AS lag_score
FROM r x JOIN r y ON y.rank BETWEEN x.rank + 1 AND x.rank + 3 AND x.item <> y.item GROUP BY 1, 2""")
def coupling_lagged(t):
    """Parts in orders one to three ranks apart."""
    return c.lagged_edges(items(t), ranks(t), 2000.0)


@query(BASE + "SELECT src AS item, round(sum(w), 6) AS centrality, round(max(w), 6) AS max_neighbour, count(*) AS degree FROM sym GROUP BY 1")
def coupling_centrality(t):
    return c.centrality(edges(t))


@query(BASE + "SELECT src, dst, round(w, 6) AS w, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(w, 9) DESC, dst)::INT AS rank FROM sym) WHERE rank <= 5")
def coupling_top_neighbours(t):
    return c.top_neighbours(edges(t), 5)


@query(BASE + "SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(max(w), 6) AS w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(w, 9) DESC, dst) AS rank FROM sym) WHERE rank <= 3 GROUP BY 1, 2")
def coupling_symmetrised(t):
    return c.symmetrised(edges(t), 3)


SEEDS = ", seeds AS (SELECT p_partkey AS seed FROM part WHERE p_partkey % 20 = 0)"


@query(BASE + SEEDS + """
SELECT dst AS item, round(max(w), 6) AS score, arg_min(src, (-round(w, 9), src)) AS via FROM sym WHERE src IN (SELECT seed FROM seeds) AND dst NOT IN (SELECT seed FROM seeds)
GROUP BY 1 ORDER BY round(max(w), 9) DESC, 1 LIMIT 20""")
def blast_radius(t):
    """What the seed parts pull along: the twenty strongest neighbours (a top-k report)."""
    return c.blast_radius(edges(t), seeds(t))


@query(BASE + """, sets AS (SELECT DISTINCT l_orderkey AS set_id, l_partkey AS item FROM lineitem),
k AS (SELECT set_id, count(*) AS size FROM sets GROUP BY 1),
s AS (SELECT x.set_id, sum(score) AS s FROM edges JOIN sets x ON x.item = a JOIN sets y ON y.item = b AND x.set_id = y.set_id GROUP BY 1)
SELECT set_id, size, round(CASE WHEN size < 2 THEN 1.0 ELSE coalesce(s, 0) / (size * (size - 1) / 2) END, 6) AS coherence FROM k LEFT JOIN s USING (set_id)""")
def coupling_coherence(t):
    """Mean pairwise score of the parts of every order."""
    return c.coherence(edges(t), t("lineitem").select(F.col("l_orderkey").alias("set_id"), F.col("l_partkey").alias("item")))


@query(BASE + """, sets AS (SELECT DISTINCT l_orderkey AS set_id, l_partkey AS item FROM lineitem),
k AS (SELECT set_id, count(*) AS size FROM sets GROUP BY 1),
m AS (SELECT set_id, dst AS item, round(sum(w) / any_value(size), 9) AS score, arg_min(src, (-round(w, 9), src)) AS anchor FROM sets JOIN sym ON src = sets.item JOIN k USING (set_id)
 WHERE NOT EXISTS (FROM sets z WHERE z.set_id = sets.set_id AND z.item = dst) GROUP BY 1, 2 HAVING score >= 0.02)
SELECT set_id, item, round(score, 6) AS score, anchor FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY score DESC, item) AS r FROM m) WHERE r <= 5""")
def coupling_missing_peers(t):
    sets = t("lineitem").select(F.col("l_orderkey").alias("set_id"), F.col("l_partkey").alias("item"))
    return c.missing_peers(edges(t), sets, least=0.02)


LIVE, RETURNED = "l_returnflag <> 'R'", "l_returnflag = 'R'"


@query(SHADOW + "SELECT a, b, round(score, 6) AS score FROM shadow s WHERE score >= 0.05 AND NOT EXISTS (FROM live l WHERE l.a = s.a AND l.b = s.b) ORDER BY round(s.score, 9) DESC, a, b LIMIT 50")
def coupling_ghosts(t):
    """Pairs that only returned lines have."""
    return c.ghosts(edges(t, LIVE), edges(t, RETURNED))


@query(SHADOW + "SELECT count(*) AS pairs, count(*) FILTER (l.a IS NULL) AS ghosts, round(count(*) FILTER (l.a IS NULL) / count(*), 6) AS ratio FROM shadow s LEFT JOIN live l ON l.a = s.a AND l.b = s.b")
def coupling_deja_vu(t):
    return c.deja_vu(edges(t, LIVE), edges(t, RETURNED))


@query(SHADOW + "SELECT a, b, round(max(score), 6) AS score FROM (SELECT * FROM live UNION ALL SELECT a, b, score * 0.5 FROM shadow) GROUP BY 1, 2")
def coupling_blended(t):
    return c.blended(edges(t, LIVE), edges(t, RETURNED))


@query(BASE + """, x AS (SELECT src AS item, d.n AS touches, sum(w) AS pull FROM sym JOIN degree d ON d.item = src GROUP BY 1, 2),
y AS (SELECT *, pull / ln(1 + touches) AS keystone FROM x)
SELECT item, touches, round(pull, 6) AS pull, round(keystone, 6) AS keystone, row_number() OVER (ORDER BY round(keystone, 9) DESC, item) <= greatest(3, ceil(0.1 * count(*) OVER ())) AS is_keystone FROM y""")
def coupling_keystones(t):
    touched = items(t).groupBy("item").agg(F.count("*").alias("touches"))
    return c.keystones(edges(t), touched)


@query(BASE + """, g AS (SELECT p_partkey AS item, p_brand AS grp FROM part),
i AS (SELECT x.grp, count(*) AS inner_edges, avg(score) AS mean_inner FROM edges JOIN g x ON x.item = a JOIN g y ON y.item = b WHERE x.grp = y.grp GROUP BY 1),
s AS (SELECT grp, count(*) AS n_items, avg(n) AS mean_volatility, list_sort(list(item))[1:8] AS sample FROM g LEFT JOIN degree USING (item) GROUP BY 1 HAVING count(*) >= 2)
SELECT grp, n_items, coalesce(inner_edges, 0) AS inner_edges, round(coalesce(mean_inner, 0), 6) AS mean_inner, round(mean_volatility, 6) AS mean_volatility, array_to_string(sample, ',') AS sample FROM s LEFT JOIN i USING (grp)""")
def architecture(t):
    """Brands as directories: sizes, inner coupling and a sample of members."""
    groups = t("part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("grp"))
    volatility = items(t).groupBy("item").agg(F.count("*").cast("double").alias("volatility"))
    out = c.architecture(edges(t), groups, volatility)
    return out.withColumn("sample", F.array_join(F.col("sample").cast("array<string>"), ","))


@query(BASE + SEEDS + """, h AS (SELECT txn, item, n FROM sized WHERE n BETWEEN 3 AND 8),
m AS (SELECT txn, count(*) AS overlap FROM h WHERE item IN (SELECT seed FROM seeds) GROUP BY 1 HAVING count(*) >= 2)
SELECT item, count(*) AS hits, round(max(overlap / n), 6) AS best FROM h JOIN m USING (txn) WHERE item NOT IN (SELECT seed FROM seeds) GROUP BY 1""")
def hyperedge_lift(t):
    return c.hyperedge_lift(items(t), seeds(t))


@query(BASE + """, e AS (SELECT t1 AS a, t2 AS b, c / (x.n + y.n - c) * exp(-0.1 * abs(x.rank - y.rank)) AS score FROM
 (SELECT x.txn AS t1, y.txn AS t2, count(*) AS c FROM items x JOIN items y ON x.item = y.item AND x.txn < y.txn GROUP BY 1, 2)
 JOIN (SELECT txn, n, rank FROM sized JOIN ranks USING (txn) GROUP BY ALL) x ON x.txn = t1 JOIN (SELECT txn, n, rank FROM sized JOIN ranks USING (txn) GROUP BY ALL) y ON y.txn = t2),
s AS (SELECT a AS src, b AS dst, score AS w FROM e UNION ALL SELECT b, a, score FROM e)
SELECT src, dst, round(w, 6) AS w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(w, 9) DESC, dst) AS r FROM s) WHERE r <= 4""")
def transaction_graph(t):
    """Orders linked by shared parts and nearness in time, four links each."""
    return c.transaction_graph(items(t), ranks(t), k=4)
