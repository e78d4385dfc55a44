"""Activity queries: an actor is a customer, a touch a line of an order; events are telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import activity as a
from .registry import query

TOUCH = """
WITH touch AS (SELECT l_partkey AS item, o_custkey AS actor, o_orderdate AS tm, o_orderkey AS k, l_linenumber AS ln, l_quantity AS mass FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
now AS (SELECT max(o_orderdate) AS now FROM orders),
touched AS (SELECT item, count(*) AS touches, count(DISTINCT actor) AS actors, min(tm) AS first_at, max(tm) AS last_at, arg_max(actor, (tm, actor)) AS last_actor FROM touch GROUP BY 1),
alive AS (SELECT item, touches, touches * exp(-date_diff('day', last_at::DATE, now::DATE) / 90.0) AS alive FROM touched, now)
"""


def touch(t):
    return t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_partkey").alias("item"), F.col("o_custkey").alias("actor"), F.col("o_orderdate").alias("at"), F.struct("o_orderkey", "l_linenumber").alias("k"), F.col("l_quantity").alias("mass"), "o_orderkey"
    )


def with_micros(df, *names):
    """Times as microseconds since 1970."""
    return df.withColumns({n: F.unix_micros(F.col(n).cast("timestamp")) for n in names})


def now(t):
    """The newest order's date, as a literal: a time that every query of a session shares."""
    return F.lit(t("orders").agg(F.max("o_orderdate")).first()[0])


def alive(t):
    return a.alive_mass(a.touches(touch(t), "item", "actor", "at"), now(t), 90.0)


@query(TOUCH + "SELECT item, touches, actors, epoch_us(first_at) AS first_at, epoch_us(last_at) AS last_at, last_actor FROM touched")
def item_touches(t):
    return with_micros(a.touches(touch(t), "item", "actor", "at"), "first_at", "last_at")


@query(TOUCH + "SELECT item, touches, round(alive, 6) AS alive FROM alive")
def alive_mass(t):
    return alive(t)


@query(TOUCH + "SELECT item, round(sum(exp(-date_diff('day', tm::DATE, now::DATE) * ln(2) / 30.0)), 6) AS weight FROM touch, now WHERE date_diff('day', tm::DATE, now::DATE) <= 180 GROUP BY 1")
def recent_activity(t):
    return a.recent_weights(touch(t), "item", "at", now(t))


@query(TOUCH + """SELECT item, round(least(1.0, sum(exp(-date_diff('day', tm::DATE, now::DATE) / 14.0))), 6) AS heat FROM
(SELECT *, row_number() OVER (PARTITION BY item ORDER BY tm DESC, k DESC, ln DESC) AS n FROM touch, now WHERE date_diff('day', tm::DATE, now::DATE) <= 365) WHERE n <= 20 GROUP BY 1""")
def item_heat(t):
    return a.heat(touch(t), "item", "at", "k", now(t))


@query(TOUCH + """, q AS (SELECT list_sort(list(touches)) AS l, count(*) AS n FROM alive),
c AS (SELECT l[1 + least(n - 1, (0.90 * n)::BIGINT)] AS x, l[1 + least(n - 1, floor(0.90 * n)::BIGINT)] AS top, l[1 + least(n - 1, floor(0.70 * n)::BIGINT)] AS mid FROM q)
SELECT item, touches, round(alive, 6) AS alive, CASE WHEN touches >= top AND alive / touches >= 0.4 THEN 'keystone' WHEN alive / touches >= 0.7 THEN 'active'
 WHEN alive / touches >= 0.4 THEN CASE WHEN touches >= mid THEN 'stable' ELSE 'warm' END WHEN alive / touches >= 0.15 THEN 'cooling' ELSE 'dormant' END AS stage FROM alive, c""")
def lifecycles(t):
    return a.lifecycles(alive(t))


@query("SELECT event_type, ts::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY 1, 2")
def daily_events(t):
    return a.daily_counts(t("events"), "ts", "event_type").withColumn("day", F.col("day").cast("string"))


@query("""SELECT d::DATE::VARCHAR AS day, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE, INTERVAL 1 DAY)) AS d FROM orders)
LEFT JOIN (SELECT o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY 1) USING (d)""")
def gap_filled_orders(t):
    return a.gap_filled(a.daily_counts(t("orders"), "o_orderdate")).withColumn("day", F.col("day").cast("string"))


@query("SELECT o_orderdate::DATE::VARCHAR AS day, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def burst_days(t):
    """The three busiest days (a top-k report)."""
    return a.bursts(a.daily_counts(t("orders"), "o_orderdate")).withColumn("day", F.col("day").cast("string"))


@query("""SELECT customer, day::VARCHAR AS day, gap::INT AS gap_days FROM (SELECT customer, day, date_diff('day', lag(day) OVER (PARTITION BY customer ORDER BY day), day) AS gap FROM (SELECT DISTINCT o_custkey AS customer, o_orderdate::DATE AS day FROM orders))
WHERE gap > 1 QUALIFY row_number() OVER (PARTITION BY customer ORDER BY day) <= 2""")
def silent_days(t):
    """The first two pauses of each customer."""
    daily = a.daily_counts(t("orders").withColumn("customer", F.col("o_custkey")), "o_orderdate", "customer")
    return a.gaps(daily, 2, "customer").withColumn("day", F.col("day").cast("string"))


@query(TOUCH + """, c AS (SELECT item, actor, count(*) AS touches FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY tm DESC, k DESC, ln DESC) AS n FROM touch) WHERE n <= 50 GROUP BY 1, 2)
SELECT item, actor, touches, round(share, 6) AS share, rank FROM (SELECT *, touches / sum(touches) OVER (PARTITION BY item) AS share, row_number() OVER (PARTITION BY item ORDER BY touches DESC, actor)::INT AS rank FROM c) WHERE rank <= 5""")
def who_knows(t):
    return a.experts(touch(t), "item", "actor", "at", "k")


@query("SELECT l_orderkey AS txn, count(DISTINCT l_partkey) AS items, round(sum(l_quantity), 6) AS churn FROM lineitem GROUP BY 1 ORDER BY 2 DESC, sum(l_quantity) DESC, 1 LIMIT 6")
def pivot_transactions(t):
    """The six largest orders (a top-k report)."""
    return a.pivots(t("lineitem"), "l_orderkey", "l_partkey", "l_quantity")


@query(TOUCH + """SELECT item, round(sum(mass * (1 - pow(2, -1/90.0)) * pow(pow(2, -1/90.0), n - i)), 5) AS ewma FROM
(SELECT item, mass, row_number() OVER (PARTITION BY item ORDER BY tm, k, ln, mass) AS i, count(*) OVER (PARTITION BY item) AS n FROM touch) GROUP BY 1""", places=5)
def item_volatility(t):
    """Exponentially weighted churn, oldest to newest."""
    return a.ewma(touch(t), "item", "mass", ["at", "k"])


@query(TOUCH + "SELECT item, touches AS value, round((touches - (SELECT avg(touches) FROM touched)) / (SELECT stddev_samp(touches) FROM touched), 6) AS z FROM touched")
def touch_z_scores(t):
    return a.z_scores(a.touches(touch(t), "item", "actor", "at"), "item", "touches")


@query(TOUCH + """, tau AS (SELECT greatest(1, list_sort(list(touches))[1 + least(count(*) - 1, floor(0.25 * count(*))::BIGINT)]) AS tau FROM touched)
SELECT item, round(0.85 + (actors / touches - 0.85) * (1 - exp(-touches / tau::DOUBLE)), 6) AS integrity FROM touched, tau""")
def item_integrity(t):
    """The share of distinct actors, shrunk to the prior where touches are few."""
    cues = a.touches(touch(t), "item", "actor", "at").withColumn("cue", F.col("actors") / F.col("touches"))
    return a.integrity(cues, "item", "cue", "touches")


@query("""WITH p AS (SELECT string_split(regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/$', ''), '/') AS s, length(html) AS m FROM pages)
SELECT array_to_string(s[1:k], '/') AS prefix, k::INT AS depth, sum(m)::BIGINT AS mass FROM (SELECT s, m, unnest(range(0, len(s) + 1)) AS k FROM p) GROUP BY 1, 2""")
def path_rollup(t):
    """Page sizes rolled up to every ancestor path."""
    paths = t("pages").select(F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1), "/$", "").alias("p"), F.length("html").alias("m"))
    parts = F.split("p", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("prefix")))
    return paths.select(F.explode(prefixes).alias("x"), "m").groupBy("x.prefix", "x.depth").agg(F.sum("m").cast("long").alias("mass"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (value < 10) AS failures, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95,
round(arg_max(value, (ts, event_id)), 6) AS last_value, epoch_us(max(ts)) AS last_at FROM events GROUP BY 1""")
def telemetry_summary(t):
    """Counts, failures and nearest-rank percentiles by command."""
    return with_micros(a.telemetry(t("events"), ["event_type"], "value", F.col("value") < 10, "ts", "event_id"), "last_at")


@query("""SELECT grp, count(*) AS kinds, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END, 6) AS entropy FROM
(SELECT user_id AS grp, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY 1, 2) GROUP BY 1""")
def user_entropy(t):
    return a.entropy(t("events"), "user_id", "event_type")


@query("""SELECT source AS grp, count(*) FILTER (quality = 1) AS accepted, count(*) FILTER (quality = 0) AS rejected, round((count(*) FILTER (quality = 1) + 1) / (count(*) + 2), 6) AS rate
FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def source_acceptance(t):
    return a.smoothed_acceptance(t("labels").join(t("documents"), "doc_id"), "source", F.col("quality") == 1)


@query("SELECT p_brand AS bucket, count(p_retailprice) AS n, round((sum(p_retailprice) + 1000 * 20) / (count(p_retailprice) + 20), 4) AS mean FROM part GROUP BY 1", places=4)
def shrunk_prices(t):
    return a.shrunk_means(t("part"), "p_brand", "p_retailprice", 1000.0, 20.0)


@query("""SELECT event_id, event_type FROM (SELECT *, sum(value) OVER (PARTITION BY 1 ORDER BY ts::DATE DESC, ts DESC, value) AS run FROM events WHERE date_diff('day', ts::DATE, (SELECT max(ts)::DATE FROM events)) <= 30) WHERE run <= 20000""")
def retention(t):
    """The newest events of 30 days within a budget of the sum of their values."""
    newest = t("events").agg(F.max("ts")).first()[0]
    return a.retained(t("events").select("event_id", "event_type", "ts", "value"), "ts", "value", F.lit(newest), 30, 20000).select("event_id", "event_type")


@query("SELECT o_custkey AS actor, l_partkey AS item, count(*) AS touches FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def author_touches(t):
    return touch(t).groupBy("actor", "item").agg(F.count("*").alias("touches"))


@query(TOUCH + ", d AS (SELECT p_brand AS dir, sum(touches)::BIGINT AS touches FROM touched JOIN part ON p_partkey = item GROUP BY 1) SELECT dir, touches FROM d WHERE touches >= 0.02 * (SELECT max(touches) FROM d)")
def strata(t):
    """Directories with at least 2 % of the largest one's touches."""
    dirs = touch(t).join(t("part"), F.col("item") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("dir")).agg(F.count("*").alias("touches"))
    return dirs.crossJoin(F.broadcast(dirs.agg(F.max("touches").alias("m")))).where("touches >= 0.02 * m").select("dir", "touches")
