"""Graph queries over the coupling graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coupling as c
from ..operators import diffusion as d
from ..operators import forest as f
from ..operators import graph as g
from ..operators.spread import first, mean
from .coupling import BASE, edges
from .registry import query

GRAPH = BASE + """, g AS (SELECT a, b, score AS w FROM edges), gs AS (SELECT a AS src, b AS dst, w FROM g UNION ALL SELECT b, a, w FROM g),
deg AS (SELECT src AS node, count(*) AS degree, sum(w) AS strength FROM gs GROUP BY 1)
"""
ARCS = """WITH l AS (SELECT l_orderkey, l_partkey AS p, l_linenumber AS n FROM lineitem),
arcs AS (SELECT x.p AS src, y.p AS dst, count(*)::DOUBLE AS w FROM l x JOIN l y ON x.l_orderkey = y.l_orderkey AND y.n = x.n + 1 WHERE x.p <> y.p GROUP BY 1, 2)
"""


def graph(t):
    return edges(t).select("a", "b", F.col("score").alias("w"))


def arcs(t):
    """A part, and the one on the next line of its order."""
    l = t("lineitem").select("l_orderkey", F.col("l_partkey").alias("src"), F.col("l_linenumber").alias("n"))
    n = t("lineitem").select("l_orderkey", F.col("l_partkey").alias("dst"), (F.col("l_linenumber") - 1).alias("n"))
    return l.join(n, ["l_orderkey", "n"]).where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


@query(GRAPH + "SELECT node, degree, round(strength, 6) AS strength FROM deg")
def node_strength(t):
    return g.degrees(g.clean(graph(t)))


@query(GRAPH + "SELECT src, dst, round(w / sqrt(x.strength * y.strength), 6) AS w FROM gs JOIN deg x ON x.node = src JOIN deg y ON y.node = dst")
def normalised_graph(t):
    return g.normalised(g.clean(graph(t)))


@query(GRAPH + "SELECT node, round(strength / sum(strength) OVER (), 9) AS p FROM deg", places=9)
def stationary(t):
    return g.stationary(g.clean(graph(t)))


@query(GRAPH + """, x AS (SELECT least(p.p_brand, q.p_brand) AS a, greatest(p.p_brand, q.p_brand) AS b, w FROM g JOIN part p ON p.p_partkey = a JOIN part q ON q.p_partkey = b WHERE p.p_brand <> q.p_brand)
SELECT a, b, round(sum(w), 6) AS w FROM x GROUP BY 1, 2""")
def coarse_graph(t):
    return g.coarsen(graph(t), t("part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("grp")))


@query(ARCS + """, s AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(CASE WHEN src < dst THEN w ELSE -w END) / 2 AS f FROM arcs GROUP BY 1, 2)
SELECT CASE WHEN f > 0 THEN a ELSE b END AS src, CASE WHEN f > 0 THEN b ELSE a END AS dst, abs(f) AS flow FROM s WHERE f <> 0""")
def transport(t):
    return g.transport(arcs(t))


@query(GRAPH + """, f AS (SELECT p_partkey AS node, p_retailprice AS v FROM part)
SELECT a, b, round(sqrt(w) * (y.v - x.v), 4) AS d FROM g JOIN f x ON x.node = a JOIN f y ON y.node = b""", places=4)
def edge_gradient(t):
    return g.gradient(graph(t), t("part").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("v")))


@query(GRAPH + """, f AS (SELECT p_partkey AS node, p_retailprice AS v FROM part), d AS (SELECT a, b, w * (y.v - x.v) AS x FROM g JOIN f x ON x.node = a JOIN f y ON y.node = b)
SELECT node, round(sum(x), 3) AS v FROM (SELECT b AS node, x FROM d UNION ALL SELECT a, -x FROM d) GROUP BY 1""", places=3)
def node_divergence(t):
    w = graph(t)
    return g.divergence(w, g.gradient(w, t("part").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("v"))))


@query(GRAPH + """, n AS (SELECT a.src, a.dst, a.w / sqrt(x.strength * y.strength) AS w FROM gs a JOIN deg x ON x.node = a.src JOIN deg y ON y.node = a.dst)
SELECT src AS node, round(sum(w * p_retailprice), 4) AS v FROM n JOIN part ON p_partkey = dst GROUP BY 1""", places=4)
def matrix_vector(t):
    return g.times(g.normalised(g.clean(graph(t))), t("part").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("v")))


#: Each part's three strongest links, from either end; the normalised matrix n; sources of mass 1.
NEAR = BASE + """, near AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(w) AS w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(w, 9) DESC, dst) AS r FROM sym) WHERE r <= 3 GROUP BY 1, 2),
ns AS (SELECT a AS src, b AS dst, w FROM near UNION ALL SELECT b, a, w FROM near), nd AS (SELECT src AS node, sum(w) AS s FROM ns GROUP BY 1),
n AS MATERIALIZED (SELECT src, dst, w / sqrt(x.s * y.s) AS w FROM ns JOIN nd x ON x.node = src JOIN nd y ON y.node = dst)
"""


def series(sources: str, terms: int = 16, steps: str = "u") -> str:
    """CTEs {steps}0 .. of N^k rho / k! for a table of (source, node, v), and all of them in {steps}."""
    out = [f"{steps}0 AS MATERIALIZED ({sources})"]
    out += [f"{steps}{k} AS MATERIALIZED (SELECT source, src AS node, sum(w * v) / {k} AS v FROM n JOIN {steps}{k - 1} ON node = dst GROUP BY 1, 2)" for k in range(1, terms)]
    return ", " + ", ".join([*out, f"{steps} AS (" + " UNION ALL ".join(f"SELECT source, node, v, {k} AS k FROM {steps}{k}" for k in range(terms)) + ")"])


OWN = "SELECT p_partkey AS source, p_partkey AS node, 1.0::DOUBLE AS v FROM part WHERE p_partkey % 20 = 0"


def near(t):
    return c.symmetrised(edges(t), 3)


def own_sources(t):
    return t("part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("source"), F.col("p_partkey").alias("node"), F.lit(1.0).alias("mass"))


@query(NEAR + series(OWN) + """, h AS (SELECT source, node, exp(-1.0) * sum(v) AS phi FROM u GROUP BY 1, 2)
SELECT source, node, round(phi, 6) AS phi, (row_number() OVER (PARTITION BY source ORDER BY round(phi, 6) DESC, node))::INT AS rank FROM h QUALIFY rank <= 10""")
def heat_kernel(t):
    """The ten parts most relevant to each part whose key is divisible by 20, by the heat kernel."""
    return d.heat_of(near(t), own_sources(t), [1.0], each=lambda heat: d.top_nodes(heat.withColumn("phi0", F.round("phi0", 6)), 10), best=(10, first))


@query(NEAR + series(OWN, 22) + """, h AS (SELECT source, node, exp(-0.5) * sum(v * pow(0.5, k)) AS x, exp(-1.0) * sum(v) AS y, exp(-2.0) * sum(v * pow(2.0, k)) AS z FROM u GROUP BY 1, 2),
m AS (SELECT source, node, round(pow((x + 1e-9) * (y + 1e-9) * (z + 1e-9), 1.0 / 3), 5) AS phi FROM h)
SELECT source, node, phi, (row_number() OVER (PARTITION BY source ORDER BY phi DESC, node))::INT AS rank FROM m QUALIFY rank <= 5""", places=5)
def heat_blend(t):
    """Relevance at three temperatures from one basis, blended by their geometric mean."""
    return d.heat_of(near(t), own_sources(t), [0.5, 1.0, 2.0], each=lambda heat: d.top_nodes(d.blended(heat, 1e-9).withColumn("phi", F.round("phi", 5)), 5, "phi"), best=(5, mean))


NOISE = "((node * 7919 + trial * 104729 + length(source)) % 1000) / 1000.0"


@query(NEAR + series(f"""SELECT source || ':' || trial AS source, node, m / sum(m) OVER (PARTITION BY source, trial) AS v FROM
(SELECT *, p_size * CASE WHEN trial = 0 THEN 1.0 ELSE 1 + ({NOISE} * 2 - 1) * 0.15 END AS m FROM (SELECT p_brand AS source, p_partkey AS node, p_size, trial FROM part, range(7) r(trial) WHERE p_partkey % 20 = 0))""") + """,
h AS (SELECT split_part(source, ':', 1) AS source, split_part(source, ':', 2)::INT AS trial, node, exp(-1.0) * sum(v) AS phi FROM u GROUP BY 1, 2, 3),
top AS (SELECT source, trial, node FROM h QUALIFY row_number() OVER (PARTITION BY source, trial ORDER BY round(phi, 9) DESC, node) <= 10),
j AS (SELECT x.source, x.trial, count(*) AS m, count(y.node) AS i, any_value(n) AS n FROM top x LEFT JOIN top y ON y.source = x.source AND y.node = x.node AND y.trial = 0 JOIN (SELECT source, count(*) AS n FROM top WHERE trial = 0 GROUP BY 1) s ON s.source = x.source WHERE x.trial > 0 GROUP BY 1, 2)
SELECT source, round(CASE WHEN max(n) <= 1 THEN 1.0 ELSE avg(i / (m + n - i)) END, 6) AS stability FROM j GROUP BY 1""")
def diffusion_stability(t):
    """How far the ten parts nearest to a brand's focus parts stay the same when their weights move by 15 %."""
    focus = t("part").where("p_partkey % 20 = 0").select(F.col("p_brand").alias("source"), F.col("p_partkey").alias("node"), F.col("p_size").cast("double").alias("mass"))
    noise = ((F.col("node") * 7919 + F.col("trial") * 104729 + F.length("source")) % 1000) / 1000.0
    return d.stability(near(t), focus, noise)


PAIRS = BASE + """, co AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(w) AS score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(w, 9) DESC, dst) AS r FROM sym) WHERE r <= 1 GROUP BY 1, 2),
follow AS (SELECT least(x.l_partkey, y.l_partkey) AS a, greatest(x.l_partkey, y.l_partkey) AS b, count(*) AS n FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 WHERE x.l_partkey <> y.l_partkey GROUP BY 1, 2),
t AS (SELECT greatest(0.01, least(0.5, coalesce(avg(score), 0.25))) AS t FROM co),
p AS (SELECT a, b, score, 'co_change' AS axis, 4 AS pr FROM co, t WHERE score >= t UNION ALL SELECT a, b, least(0.5, n / 20.0), 'transport', 2 FROM follow WHERE n >= 3 UNION ALL
 SELECT x.p_partkey, y.p_partkey, 0.1, 'symbol', 5 FROM part x JOIN part y ON x.p_name = y.p_name AND x.p_brand = y.p_brand AND x.p_type = y.p_type AND x.p_size = y.p_size AND x.p_partkey < y.p_partkey, t WHERE 0.1 >= t),
bound AS (SELECT a, b, max(score) AS w, arg_min(axis, (-round(score, 9), pr)) AS axis FROM p GROUP BY 1, 2 HAVING bool_or(pr <= 4) OR count(DISTINCT axis) >= 2),
s AS (SELECT a, b FROM bound UNION ALL SELECT b, a FROM bound)
"""


@query("WITH RECURSIVE " + PAIRS.strip().removeprefix("WITH") + """, r(node, root) AS (SELECT a, a FROM s UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.node WHERE r.root <= s.b),
roots AS (SELECT node, min(root) AS root FROM r GROUP BY 1), size AS (SELECT root, count(*) AS size FROM roots GROUP BY 1),
tight AS (SELECT x.root, sum(score) AS s FROM edges JOIN roots x ON x.node = a JOIN roots y ON y.node = b WHERE x.root = y.root GROUP BY 1),
votes AS (SELECT root, axis, sum(w) AS s FROM bound JOIN roots ON node = a GROUP BY 1, 2),
axes AS (SELECT root, arg_min(axis, (-round(s, 9), CASE axis WHEN 'transport' THEN 2 WHEN 'co_change' THEN 4 ELSE 5 END)) AS axis FROM votes GROUP BY 1),
k AS (SELECT root, size, coalesce(s, 0) / (size * (size - 1) / 2) AS tightness, axis FROM size LEFT JOIN tight USING (root) JOIN axes USING (root)),
o AS (SELECT *, row_number() OVER (ORDER BY round(round(tightness, 9) * 100) DESC, size DESC, root) - 1 AS cluster FROM k)
SELECT p_partkey AS item, coalesce(cluster, -1) AS cluster, coalesce(size, 1) AS size, round(coalesce(tightness, 0), 6) AS tightness, coalesce(axis, '') AS axis FROM part LEFT JOIN roots ON node = p_partkey LEFT JOIN o USING (root)""")
def item_clusters(t):
    """Single-link clusters of parts: strongest co-occurrence, parts that follow one another, and parts alike."""
    all_edges = g.cut(edges(t).select("a", "b", "score"))
    co = g.cut(c.symmetrised(all_edges, 1).withColumnRenamed("w", "score"))
    members = t("part").select(F.col("p_partkey").alias("item"))
    follow = arcs(t).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").alias("n")).where("n >= 3")
    alike = t("part").select(F.col("p_partkey").alias("item"), F.concat_ws("|", "p_name", "p_brand", "p_type", "p_size").alias("txn"), F.lit(1.0).alias("mass"))
    pairs = co.select("a", "b", "score", F.lit("co_change").alias("axis")).union(follow.select("a", "b", F.least(F.lit(0.5), F.col("n") / 20.0), F.lit("transport")))
    pairs = pairs.union(c.pairs(alike).select("a", "b", F.lit(0.1), F.lit("symbol")))
    return f.clusters(members, all_edges, pairs, f.adaptive_threshold(co, members, low=0.01))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000000 AS b FROM lineitem), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, root) USING KEY (node) AS (SELECT a, a FROM s GROUP BY 1 UNION SELECT s.b, min(r.root) FROM r JOIN s ON s.a = r.node JOIN recurring.r AS c ON c.node = s.b WHERE r.root < c.root GROUP BY s.b)
SELECT node, root FROM r""")
def linked_components(t):
    """Parts and suppliers connected by lines."""
    e = t("lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000000).alias("b")).distinct()
    return g.components(e)


def fragments(thresholds: str) -> str:
    return "WITH RECURSIVE " + GRAPH.strip().removeprefix("WITH") + f""", th AS (SELECT unnest({thresholds}) AS threshold), ge AS (SELECT threshold, a, b FROM g JOIN th ON w >= threshold),
s AS (SELECT threshold, a, b FROM ge UNION ALL SELECT threshold, b, a FROM ge), r(threshold, node, root) AS (SELECT threshold, a, a FROM s UNION SELECT s.threshold, s.b, r.root FROM r JOIN s ON s.a = r.node AND s.threshold = r.threshold WHERE r.root <= s.b),
z AS (SELECT threshold, root, count(*) AS n FROM (SELECT threshold, node, min(root) AS root FROM r GROUP BY 1, 2) GROUP BY 1, 2), y AS (SELECT threshold, count(*) AS c, sum(n) AS covered, max(n) AS largest FROM z GROUP BY 1),
m AS (SELECT threshold, count(*) AS m FROM ge GROUP BY 1), q AS (SELECT count(*) AS n FROM part),
x AS (SELECT threshold::DOUBLE AS threshold, (coalesce(c, 0) + n - coalesce(covered, 0))::BIGINT AS components, round(greatest(coalesce(largest, 0), 1) / n, 6) AS largest_share, (coalesce(m, 0) - n + coalesce(c, 0) + n - coalesce(covered, 0))::BIGINT AS cycle_rank FROM th CROSS JOIN q LEFT JOIN y USING (threshold) LEFT JOIN m USING (threshold))
"""


@query(fragments("[0.05::DOUBLE]") + "SELECT components, largest_share, cycle_rank FROM x")
def fragmentation(t):
    return g.fragmentation(graph(t), 0.05, t("part").count())


@query(fragments("[0.2::DOUBLE, 0.1, 0.05]") + "SELECT * FROM x")
def fragmentation_curve(t):
    return g.fragmentation_curve(graph(t), [0.2, 0.1, 0.05], t("part").count())


@query()
def borrowed_labels(t):
    """Brands spread from every third part to the rest."""
    labels = t("part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("label"))
    return g.propagate_labels(graph(t), labels, 2)
