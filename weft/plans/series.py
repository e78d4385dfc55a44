"""Series queries: daily order counts by priority, events by user, dialogue turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as s
from .registry import query

#: A curve for each order priority: orders per month number.
CURVE = """
WITH c AS (SELECT o_orderpriority AS series, (year(o_orderdate) * 12 + month(o_orderdate))::DOUBLE - 23900 AS t, count(*)::DOUBLE AS y FROM orders GROUP BY 1, 2),
l AS (SELECT *, lag(y) OVER w AS y0, lead(y) OVER w AS y1, lag(t) OVER w AS t0, lead(t) OVER w AS t1, row_number() OVER w AS k, count(*) OVER (PARTITION BY series) AS n, avg(y) OVER (PARTITION BY series) AS m FROM c WINDOW w AS (PARTITION BY series ORDER BY t))
"""


def curve(t):
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("double") - 23900
    return t("orders").groupBy(F.col("o_orderpriority").alias("series"), month.alias("t")).agg(F.count("*").cast("double").alias("y"))


@query(CURVE + "SELECT series, t, y, y - y0 AS d1, y1 - 2 * y + y0 AS d2 FROM l")
def curve_derivatives(t):
    return s.derivative(curve(t))


@query(CURVE + "SELECT series, t, round(CASE WHEN coalesce(t1, t) > coalesce(t0, t) THEN (coalesce(y1, y) - coalesce(y0, y)) / (coalesce(t1, t) - coalesce(t0, t)) ELSE 0 END, 6) AS slope FROM l")
def curve_slopes(t):
    return s.central_slope(curve(t))


@query(CURVE + "SELECT series, round(coalesce(sum((y + y0) / 2 * (t - t0)), 0), 6) AS area FROM l GROUP BY 1")
def curve_integral(t):
    return s.integral(curve(t))


@query(CURVE + "SELECT series, arg_min(t, (-y, t)) AS peak_t, max(y) AS peak_y FROM c GROUP BY 1")
def curve_peak(t):
    return s.peak(curve(t))


@query(CURVE + """, p AS (SELECT series, arg_min(t, (-y, t)) AS pt, max(y) AS py FROM c GROUP BY 1),
f AS (SELECT series, arg_min(t0 + (y0 - py / 2) / (y0 - y) * (t - t0), t) AS half_t FROM l JOIN p USING (series) WHERE t > pt AND y <= py / 2 AND y0 > py / 2 GROUP BY 1)
SELECT series, round(half_t, 6) AS half_t FROM p LEFT JOIN f USING (series)""")
def curve_half_life(t):
    return s.half_life(curve(t))


@query(CURVE + "SELECT series, count(*) AS n, round(regr_slope(y, t), 6) AS slope, round(regr_r2(y, t), 6) AS r2 FROM c GROUP BY 1")
def curve_trend(t):
    return s.slope(curve(t))


@query(CURVE + "SELECT series, round(regr_slope(ln(y), ln(t)), 6) AS slope, round(regr_r2(ln(y), ln(t)), 6) AS r2 FROM c WHERE t > 0 AND y > 0 GROUP BY 1")
def curve_log_log(t):
    return s.log_log_fit(curve(t))


@query(CURVE + """, d AS (SELECT series, t, y - y0 AS d FROM l WHERE y0 IS NOT NULL),
z AS (SELECT series, t, d, avg(d) OVER w AS m, stddev_pop(d) OVER w AS s, count(d) OVER w AS n FROM d WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
SELECT series, t, round((d - m) / s, 6) AS z FROM z WHERE n = 8 AND s > 0 AND abs((d - m) / s) >= 2""")
def regime_changes(t):
    return s.regime_changes(curve(t))


@query(CURVE + """, x AS (SELECT series, y, y0 AS p, lag(y, 2) OVER (PARTITION BY series ORDER BY t) AS q FROM l),
m AS (SELECT series, count(*) AS n, sum(p*p) + 1e-9 AS pp, sum(p*q) AS pq, sum(q*q) + 1e-9 AS qq, sum(p*y) AS py, sum(q*y) AS qy FROM x WHERE q IS NOT NULL GROUP BY 1)
SELECT series, n, round((py * qq - qy * pq) / (pp * qq - pq * pq), 6) AS a1, round((qy * pp - py * pq) / (pp * qq - pq * pq), 6) AS a2 FROM m""")
def autoregression(t):
    return s.ar2(curve(t))


@query(CURVE + """, x AS (SELECT series, y, -row_number() OVER (PARTITION BY series ORDER BY t DESC) AS k FROM c)
SELECT series, round(regr_intercept(y, k), 6) AS forecast FROM x WHERE k >= -12 GROUP BY 1""")
def curve_forecast(t):
    return s.forecast(curve(t))


@query(CURVE + "SELECT series, t, round(avg(abs(y - y0)) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS speed FROM l")
def curve_speed(t):
    return s.path_speed(curve(t))


@query("""SELECT series, t, before, after FROM (SELECT conv_id AS series, turn AS t, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, role AS after FROM conversations) WHERE before <> after""")
def role_transitions(t):
    return s.transitions(t("conversations").select(F.col("conv_id").alias("series"), F.col("turn").alias("t"), F.col("role").alias("label")))


@query(CURVE + """, g AS (SELECT i AS lag FROM range(1, 33) r(i)),
r AS (SELECT x.series, lag, sum((x.y - x.m) * (z.y - z.m)) AS r FROM l x JOIN g ON lag <= x.n // 2 JOIN l z ON z.series = x.series AND z.k = x.k - lag GROUP BY 1, 2),
f AS (SELECT series, min(lag) AS f FROM r WHERE r <= 0 GROUP BY 1), b AS (SELECT series, max(n) AS n, sum((y - m) * (y - m)) AS v FROM l GROUP BY 1)
SELECT series, (CASE WHEN n < 4 OR v <= 0 THEN 4 ELSE greatest(2, coalesce(f, least(32, n // 2))) END)::BIGINT AS length FROM b LEFT JOIN f USING (series)""")
def autocorrelation_length(t):
    return s.autocorrelation_length(curve(t))


@query(CURVE + """, e AS (SELECT series, min(t) AS a, max(t) AS b, arg_min(y, t) AS p, arg_max(y, t) AS q FROM c GROUP BY 1),
g AS (SELECT series, t, abs((q - p) * (t - a) - (b - a) * (y - p)) / sqrt((q - p) * (q - p) + (b - a) * (b - a)) AS g FROM c JOIN e USING (series) WHERE b > a)
SELECT series, arg_min(t, (-g, t)) AS knee_t, round(max(g), 6) AS distance FROM g GROUP BY 1""")
def curve_knee(t):
    return s.knee(curve(t))


@query(CURVE + "SELECT series, arg_min(t, (-(y1 - y), t)) AS gap_t, max(y1 - y) AS gap FROM l WHERE y1 IS NOT NULL GROUP BY 1")
def curve_max_gap(t):
    return s.max_gap(curve(t))


@query(CURVE + """, pt AS (SELECT DISTINCT series, x::DOUBLE AS pos FROM c, (VALUES (1.5), (7.3), (20.25), (33.0), (500.0)) v(x)),
w AS (SELECT pt.series, pos, (SELECT max(t) FROM c WHERE c.series = pt.series AND t <= pos) AS lo, (SELECT min(t) FROM c WHERE c.series = pt.series AND t >= pos) AS hi FROM pt)
SELECT w.series, pos AS "at", round(CASE WHEN lo IS NULL THEN h.y WHEN hi IS NULL OR lo = hi OR lo = pos THEN g.y ELSE g.y + (h.y - g.y) * (ln(pos) - ln(lo)) / (ln(hi) - ln(lo)) END, 6) AS y
FROM w LEFT JOIN c g ON g.series = w.series AND g.t = lo LEFT JOIN c h ON h.series = w.series AND h.t = hi""")
def curve_samples(t):
    """An as-of join: values between months, linear in the logarithm of time."""
    c = curve(t)
    at = c.select("series").distinct().select("series", F.explode(F.array(*(F.lit(x) for x in (1.5, 7.3, 20.25, 33.0, 500.0)))).alias("at"))
    return s.sample_at(c, at)


@query(CURVE + "SELECT series, round(sum(abs(y) * t) / sum(abs(y)), 6) AS centre, round(sum(abs(y) * t * t) / sum(abs(y)) - pow(sum(abs(y) * t) / sum(abs(y)), 2), 5) AS spread FROM c GROUP BY 1")
def curve_moments(t):
    return s.moments(curve(t)).withColumn("spread", F.round("spread", 5))


@query(CURVE + """SELECT series, k, round(sqrt(pow(sum(y * cos(-2 * 3.141592653589793 * k * (l.k - 1) / n)), 2) + pow(sum(y * sin(-2 * 3.141592653589793 * k * (l.k - 1) / n)), 2)), 4) AS magnitude
FROM (SELECT series, y, k AS j, n FROM l) x, range(0, 1) GROUP BY 1, 2""".replace("(l.k - 1)", "(j - 1)").replace("range(0, 1)", "LATERAL (SELECT unnest(range(0, n // 2 + 1)) AS k)"), places=4)
def curve_spectrum(t):
    return s.spectrum(curve(t))


@query("""WITH d AS (SELECT o_orderpriority AS series, o_orderdate::DATE AS t, list_distinct(list(o_custkey)) AS m FROM orders GROUP BY 1, 2),
p AS (SELECT series, t, m, lag(m) OVER (PARTITION BY series ORDER BY t) AS p FROM d)
SELECT series, t::VARCHAR AS t, round(CASE WHEN len(list_distinct(m || p)) > 0 THEN len(list_intersect(m, p)) / len(list_distinct(m || p)) ELSE 0 END, 6) AS jaccard FROM p WHERE p IS NOT NULL""")
def consecutive_jaccard(t):
    """How much the customers of one day are those of the day before."""
    d = t("orders").groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("t")).agg(F.collect_set("o_custkey").alias("members"))
    return s.consecutive_jaccard(d).withColumn("t", F.col("t").cast("string"))


@query(CURVE + "SELECT series, n, round(slope, 6) AS slope, CASE WHEN n < 6 THEN 'unknown' WHEN slope < -0.015 THEN 'converging' WHEN slope > 0.015 THEN 'diverging' ELSE 'steady' END AS label FROM (SELECT series, count(*) AS n, regr_slope(y, t) AS slope FROM c GROUP BY 1)")
def orbits(t):
    return s.orbit(curve(t))


@query(CURVE + """, st AS (SELECT series, avg(y) AS m, stddev_pop(y) AS s, count(*) AS n FROM c GROUP BY 1),
ta AS (SELECT x.series, sum(sign(z.y - x.y)) AS s FROM c x JOIN c z ON x.series = z.series AND z.t > x.t GROUP BY 1),
r AS (SELECT st.series, st.s / abs(m) AS cv, ta.s / (n * (n - 1) / 2) AS tau FROM st JOIN ta USING (series))
SELECT series, round(cv, 6) AS cv, round(tau, 6) AS tau, CASE WHEN cv < 0.10 THEN 'invariant' WHEN abs(tau) >= 0.8 THEN 'running' ELSE 'artifact' END AS kind FROM r""")
def observable_kinds(t):
    return s.classify(curve(t))


@query("""SELECT user_id, session, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS n FROM
(SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1800 * 1000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM
 (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY 1, 2""")
def sessions(t):
    """Chains of a user's events less than half an hour apart."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    cut = t("events").select("user_id", "ts", "event_id", micros.alias("m"), F.when(gap.isNull() | (gap > 1800 * 1000000), 1).otherwise(0).alias("new"))
    return cut.withColumn("session", F.sum("new").over(w)).groupBy("user_id", "session").agg(F.min("m").alias("started"), F.max("m").alias("ended"), F.count("*").alias("n"))


@query("SELECT event_type, epoch_us(date_trunc('hour', ts)) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", places=4)
def hourly_events(t):
    """Tumbling windows of an hour, as the stream gives them."""
    return t("events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.unix_micros(F.col("w.start").cast("timestamp")).alias("hour"), "n", "total")
