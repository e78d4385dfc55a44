"""Roll-up queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollups as r
from .registry import query


@query("""SELECT event_id, user_id, round(value, 6) AS value FROM events JOIN (SELECT user_id AS u, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1) ON u = user_id WHERE abs(value - m) > 2 * s""")
def outlier_events(t):
    return r.sigma_gate(t("events").select("event_id", "user_id", "value"), "user_id", "value")


@query("""WITH s AS (SELECT p_brand AS grp, var_pop(p_size) AS a, covar_pop(p_retailprice, p_size) AS b, var_pop(p_retailprice) AS c FROM part GROUP BY 1)
SELECT grp, round(atan2(2 * b, a - c) / 2, 6) AS angle, round((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b), 3) AS spread FROM s""")
def principal_axis(t):
    return r.principal_axis(t("part"), "p_brand", "p_size", "p_retailprice").withColumn("spread", F.round("spread", 3))


@query("""SELECT l_orderkey AS txn, count(DISTINCT l_partkey) AS items, round(sum(l_quantity), 6) AS total, array_to_string(list_transform(list_sort(list(l_partkey)), lambda x: x::VARCHAR), ' ') AS members FROM lineitem GROUP BY 1""")
def transaction_details(t):
    d = r.details(t("lineitem"), "l_orderkey", "l_partkey", "l_quantity")
    return d.select("txn", "items", "total", F.array_join(F.transform("rows", lambda x: x["item"].cast("string")), " ").alias("members"))


@query("SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 4) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)", places=4)
def region_levels(t):
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return r.levels(rows, ["r_name", "n_name"], "c_acctbal")


@query("""WITH x AS (SELECT l_partkey, l_discount, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_discount) AS r, sum(l_quantity) OVER (PARTITION BY l_partkey) AS t FROM lineitem)
SELECT l_partkey AS grp, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean, round(sum(l_quantity) / any_value(t), 6) AS share FROM x WHERE r <= 5 GROUP BY 1""")
def top_weighted_means(t):
    return r.weighted_means(t("lineitem"), "l_partkey", "l_discount", "l_quantity", F.struct(-F.col("l_quantity"), "l_orderkey", "l_linenumber", "l_discount"), 5)


@query("SELECT p_partkey AS key, round(p_retailprice / 1000 * sqrt(1 + 0.5 * p_size) - 1, 6) AS relevance FROM part WHERE p_retailprice / 1000 * sqrt(1 + 0.5 * p_size) - 1 > 0")
def part_relevance(t):
    return r.relevance(t("part"), "p_partkey", F.col("p_retailprice") / 1000, F.lit(0.5), F.col("p_size"))


@query("SELECT band, count(*) AS n FROM (SELECT CASE WHEN value >= 55 THEN 'focused' WHEN value >= 20 THEN 'scoped' ELSE 'sweep' END AS band FROM events) GROUP BY 1")
def value_bands(t):
    return t("events").select(r.band(F.col("value"), [(55, "focused"), (20, "scoped")], "sweep").alias("band")).groupBy("band").agg(F.count("*").alias("n"))
