"""Relations between parts, their paths (brand/type/name), orders and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.paths import path_affinity
from ..operators import coupling as c
from ..operators import graph as g
from ..operators import relations as r
from .coupling import BASE, SHADOW, edges, items, ranks, seeds
from .graph import ARCS, GRAPH, arcs, graph
from .registry import query

PATH = "p_brand || '/' || p_type || '/' || p_name || '_' || p_partkey || '.part'"
#: Affinity of the paths pa and pb in the rows of w.
AFFINITY = """parts AS (SELECT *, string_split(pa, '/') AS xa, string_split(pb, '/') AS xb FROM w),
stems AS (SELECT *, xa[1:len(xa) - 1] AS da, xb[1:len(xb) - 1] AS db, string_split(regexp_replace(xa[-1], '\\.[^.]*$', ''), '') AS sa, string_split(regexp_replace(xb[-1], '\\.[^.]*$', ''), '') AS sb FROM parts),
shared AS (SELECT *, list_position(list_append([coalesce(da[i] = db[i], false) for i in range(1, greatest(len(da), len(db)) + 1)], false), false) - 1 AS dirs,
 list_position(list_append([coalesce(sa[i] = sb[i], false) for i in range(1, greatest(len(sa), len(sb)) + 1)], false), false) - 1 AS letters FROM stems),
affinity AS (SELECT a, b, CASE WHEN pa = pb THEN 1 ELSE dirs / greatest(len(da), len(db)) * 2 * letters / (len(sa) + len(sb)) END AS aff FROM shared)
"""
NEXT = f"w AS (SELECT x.p_partkey AS a, y.p_partkey AS b, x.path AS pa, y.path AS pb FROM (SELECT p_partkey, {PATH} AS path FROM part) x JOIN (SELECT p_partkey, {PATH} AS path FROM part) y ON y.p_partkey = x.p_partkey + 1),\n"


def paths(t):
    path = F.concat(F.concat_ws("/", "p_brand", "p_type", "p_name"), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".part"))
    return t("part").select("p_partkey", "p_brand", path.alias("path"))


def next_parts(t):
    """(a, b, path_a, path_b): each part and the one with the next key."""
    p = paths(t)
    return p.select(F.col("p_partkey").alias("a"), F.col("path").alias("path_a"), (F.col("p_partkey") + 1).alias("b")).join(p.select(F.col("p_partkey").alias("b"), F.col("path").alias("path_b")), "b")


@query("WITH " + NEXT + AFFINITY + "SELECT a, b, round(aff, 6) AS affinity FROM affinity")
def path_affinities(t):
    return next_parts(t).select("a", "b", path_affinity(F.col("path_a"), F.col("path_b")).alias("affinity"))


@query(SHADOW + ", " + NEXT + AFFINITY + """, k AS (SELECT a AS item FROM shadow UNION SELECT b FROM shadow)
SELECT f.a, f.b, round(CASE WHEN s.score > 0 THEN s.score WHEN f.a IN (FROM k) AND f.b IN (FROM k) THEN 0 ELSE aff END, 6) AS score FROM affinity f LEFT JOIN shadow s ON s.a = f.a AND s.b = f.b""")
def combined_scores(t):
    """Score of neighbouring parts by returned lines, by path where one has no such history."""
    return r.combined_scores(edges(t, "l_returnflag = 'R'"), next_parts(t))


@query(SHADOW + """, e AS (SELECT a AS src, b AS dst, score FROM live UNION ALL SELECT b, a, score FROM live), s AS (SELECT a AS src, b AS dst, score FROM shadow UNION ALL SELECT b, a, score FROM shadow)
SELECT coalesce(e.src, s.src) AS src, coalesce(e.dst, s.dst) AS dst, round(coalesce(e.score, 0), 6) AS coupling, round(coalesce(s.score, 0), 6) AS symbol FROM e FULL JOIN s ON s.src = e.src AND s.dst = e.dst""")
def symbol_edges(t):
    """Edges of returned lines beside those of the others."""
    return r.with_symbol_edges(edges(t, "l_returnflag <> 'R'"), edges(t, "l_returnflag = 'R'"))


@query(SHADOW + """, o AS (SELECT s.* FROM shadow s ANTI JOIN live l ON l.a = s.a AND l.b = s.b),
i AS (SELECT x.p_brand AS set_id, o.a, o.b, o.score FROM o JOIN part x ON x.p_partkey = o.a JOIN part y ON y.p_partkey = o.b AND y.p_brand = x.p_brand)
SELECT set_id, a, b, round(score, 6) AS score, round(score * 0.5, 6) AS effective FROM i QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY round(score, 9) DESC, a, b) <= 10""")
def ghosts_within_brands(t):
    sets = t("part").select(F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("item"))
    return r.ghosts_within(edges(t, "l_returnflag <> 'R'"), edges(t, "l_returnflag = 'R'"), sets)


@query(BASE + """, m AS (SELECT dst AS item, arg_min(w, src) AS score, min(src) AS anchor FROM sym JOIN part ON p_partkey = dst WHERE src % 20 = 0 AND p_size > 40 GROUP BY 1)
SELECT item, round(score, 6) AS score, anchor FROM m ORDER BY round(m.score, 9) DESC, item LIMIT 15""")
def seed_tests(t):
    """Large parts stand for tests."""
    return r.test_map(edges(t), seeds(t), t("part").where("p_size > 40").select(F.col("p_partkey").alias("item")))


@query(BASE + """, n AS (SELECT src AS seed, dst AS item FROM sym WHERE w > 0.02 AND src % 20 = 0 QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(w, 9) DESC, dst) < 30),
around AS (FROM n UNION ALL SELECT p_partkey, p_partkey FROM part WHERE p_partkey % 20 = 0),
touched AS (SELECT DISTINCT seed, txn FROM around JOIN items USING (item))
SELECT seed, txn, row_number() OVER (PARTITION BY seed ORDER BY rank) AS nth FROM touched JOIN ranks USING (txn) QUALIFY nth <= 10""")
def recent_near_seeds(t):
    return r.recent_near(edges(t), seeds(t), items(t), ranks(t), 0.02)


@query(GRAPH + """, x AS (SELECT * FROM gs WHERE src % 20 <> 0 AND dst % 20 <> 0) SELECT src AS node, count(*) AS degree, round(sum(w), 6) AS strength FROM x GROUP BY 1""")
def degrees_without_nodes(t):
    return g.degrees(r.without_nodes(graph(t), seeds(t).select(F.col("seed").alias("node"))))


@query(GRAPH + """, l AS (SELECT -1 AS a, p_partkey AS b, 0.5 AS w FROM part WHERE p_size > 40), x AS (SELECT a, b, w FROM g UNION ALL FROM l)
SELECT node, count(*) AS degree, round(sum(w), 6) AS strength FROM (SELECT a AS node, w FROM x UNION ALL SELECT b, w FROM x) GROUP BY 1""")
def degrees_with_node(t):
    """A new node, -1, linked to the large parts."""
    links = t("part").where("p_size > 40").select(F.lit(-1).cast("long").alias("node"), F.col("p_partkey").alias("to"), F.lit(0.5).alias("w"))
    return g.degrees(r.with_nodes(graph(t), links))


@query(ARCS + """, s AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(CASE WHEN src < dst THEN w ELSE -w END) / 2 AS f FROM arcs GROUP BY 1, 2)
SELECT CASE WHEN f > 0 THEN a ELSE b END AS src, CASE WHEN f > 0 THEN b ELSE a END AS dst, abs(f) AS strength FROM s WHERE f <> 0 ORDER BY 3 DESC, 1, 2 LIMIT 100""")
def top_transport_arcs(t):
    return r.top_arcs(g.transport(arcs(t)), 100)


@query("SELECT l_partkey AS path, sum(l_quantity) AS added, sum(l_linenumber)::BIGINT AS deleted, bool_or(l_linestatus = 'F') AS binary FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1")
def change_weights(t):
    """Returned lines stand for staged changes, accepted ones for the others."""
    rows = t("lineitem").select(F.col("l_partkey").alias("path"), F.col("l_quantity").alias("added"), F.col("l_linenumber").cast("long").alias("deleted"), (F.col("l_linestatus") == "F").alias("binary"), "l_returnflag")
    return r.change_weights(rows.where("l_returnflag = 'R'").drop("l_returnflag"), rows.where("l_returnflag = 'A'").drop("l_returnflag"))


@query("""WITH base AS (SELECT DISTINCT l_partkey AS patch FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 48)
SELECT l_orderkey AS branch, count(*) AS commits, bool_and(b.patch IS NOT NULL) AS merged FROM lineitem LEFT JOIN base b ON b.patch = l_partkey WHERE l_returnflag = 'R' GROUP BY 1""")
def merged_branches(t):
    """Orders whose returned parts were all accepted elsewhere in number."""
    l = t("lineitem").select(F.col("l_orderkey").alias("branch"), F.col("l_partkey").alias("patch"), "l_returnflag", "l_quantity")
    return r.merged_branches(l.where("l_returnflag = 'R'").select("branch", "patch"), l.where("l_returnflag = 'A' and l_quantity > 48").select("patch"))


@query("""WITH RECURSIVE n AS (SELECT event_id AS old, lead(event_id) OVER w AS new, lead(event_type) OVER w AS kind FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS (SELECT old, new FROM n WHERE new IS NOT NULL AND kind <> 'purchase'), h(path, last, hops) AS (SELECT old, new, 1::BIGINT FROM e UNION ALL SELECT path, e.new, hops + 1 FROM h JOIN e ON e.old = h.last)
SELECT path, max_by(last, hops) AS last, max(hops) AS hops FROM h GROUP BY 1""")
def rename_history(t):
    """Each event is renamed to its user's next one, unless that is a purchase."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = t("events").select(F.col("event_id").alias("old"), F.lead("event_id").over(w).alias("new"), F.lead("event_type").over(w).alias("kind"))
    return r.last_names(n.where("new is not null and kind <> 'purchase'").select("old", "new"))


@query(f"""WITH p AS (SELECT l_orderkey, string_split({PATH}, '/')[1:2] AS d FROM lineitem JOIN part ON p_partkey = l_partkey), m AS (SELECT l_orderkey, count(*) AS paths, min(d) AS x, max(d) AS y FROM p GROUP BY 1)
SELECT l_orderkey, paths, CASE WHEN paths > 1 AND x[1] = y[1] THEN x[1] || '/' || CASE WHEN x[2] = y[2] THEN x[2] || '/' ELSE '' END END AS shared FROM m""")
def common_directories(t):
    """The directory that all parts of an order share."""
    rows = t("lineitem").select("l_orderkey", "l_partkey").join(paths(t).withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    return r.common_directory(rows, "l_orderkey", "path")


@query("""WITH c AS (SELECT l_suppkey, p_type, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
SELECT l_suppkey, p_type, n, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, p_type) AS rank FROM c""")
def modal_types(t):
    rows = t("lineitem").select("l_suppkey", F.col("l_partkey").alias("p_partkey")).join(t("part").select("p_partkey", "p_type"), "p_partkey")
    return r.modal_counts(rows, "l_suppkey", "p_type")


@query("""WITH a AS (SELECT o_custkey, date_diff('day', o_orderdate, max(o_orderdate) OVER (PARTITION BY o_custkey)) AS age FROM orders)
SELECT o_custkey, len(l) AS n, greatest(l[len(l) // 2 + 1], 1)::DOUBLE AS half_life FROM (SELECT o_custkey, list(age ORDER BY age) AS l FROM a GROUP BY 1)""")
def alive_half_lives(t):
    return r.alive_half_life(t("orders"), "o_custkey", "o_orderdate")


@query("""WITH d AS (SELECT event_type AS series, date_diff('day', DATE '2024-01-01', ts::DATE) + 1 AS day, count(*)::DOUBLE AS n, sum(value) AS total, max(value) AS top FROM events GROUP BY 1, 2),
s AS (UNPIVOT d ON n, total, top INTO NAME observable VALUE value), l AS (SELECT series, observable, day AS high, value, lag(day) OVER w AS low, lag(value) OVER w AS base FROM s WINDOW w AS (PARTITION BY series, observable ORDER BY day)),
j AS (SELECT *, CASE WHEN abs(base) < 1e-9 THEN abs(value - base) ELSE abs(value - base) / abs(base) END / ln(high / low) AS jump FROM l WHERE low IS NOT NULL),
k AS (SELECT * FROM j WHERE jump > 0 QUALIFY row_number() OVER (PARTITION BY series, observable ORDER BY round(jump, 9) DESC, high) <= 3)
SELECT series, low, high, count(*) AS observables, round(sum(jump), 6) AS magnitude FROM k GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def compound_events(t):
    """Days on which two or more measures of an event type jump."""
    day = (F.datediff("ts", F.lit("2024-01-01").cast("date")) + 1).cast("long").alias("window")
    daily = t("events").groupBy(F.col("event_type").alias("series"), day).agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("total"), F.max("value").alias("top"))
    return r.compound_events(daily.unpivot(["series", "window"], ["n", "total", "top"], "observable", "value"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was IS DISTINCT FROM event_type""")
def label_strata(t):
    return r.label_strata(t("events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type").drop("ts")


@query("""WITH v AS (SELECT vec_id AS grp, unnest(embedding)::DOUBLE AS value, (generate_subscripts(embedding, 1) - 1)::INT AS mode FROM embeddings),
e AS (SELECT *, bit_count(mode) AS k, value * value AS e FROM v), o AS (SELECT grp, k, avg(e) AS m, stddev_samp(e) AS d FROM e GROUP BY 1, 2)
SELECT grp, mode, round(value, 6) AS value, round((e - m) / d, 6) AS z FROM e JOIN o USING (grp, k) WHERE mode > 0 AND d >= 1e-15 AND (e - m) / d > 2""")
def anomalous_modes(t):
    modes = t("embeddings").select(F.col("vec_id").alias("grp"), F.posexplode("embedding").alias("mode", "value"))
    return r.anomalous_modes(modes.withColumn("value", F.col("value").cast("double")))
