"""Conflict blocks, where a user's events stand for the lines of a file."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import conflicts as k
from .registry import query

LINES = """WITH l AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_id,
 CASE event_id % 5 WHEN 0 THEN '<<<<<<< ' WHEN 1 THEN '=======' WHEN 2 THEN '>>>>>>> ' WHEN 3 THEN '|||||||' ELSE '' END || event_id AS x FROM events),
a AS (SELECT *, count(*) FILTER (x LIKE '<<<<<<<%') OVER (PARTITION BY key ORDER BY n) AS try FROM l),
m AS (SELECT key, try, min(n) FILTER (x LIKE '=======%') AS mid, min(n) FILTER (x LIKE '<<<<<<<%') AS beg FROM a WHERE try > 0 GROUP BY 1, 2),
e AS (SELECT key, try, any_value(beg) AS beg, any_value(mid) AS mid, min(n) FILTER (x LIKE '|||||||%' AND n < mid) AS base, min(n) FILTER (x LIKE '>>>>>>>%' AND n > mid) AS fin FROM a JOIN m USING (key, try) GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY try) - 1 AS block FROM e WHERE fin IS NOT NULL)
"""


def lines(t):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    mark = F.element_at(F.array(*map(F.lit, ("<<<<<<< ", "=======", ">>>>>>> ", "|||||||", ""))), (F.col("event_id") % 5 + 1).cast("int"))
    return t("events").select(F.col("user_id").alias("key"), n.alias("line_no"), F.concat(mark, F.col("event_id").cast("string")).alias("text"))


@query(LINES + """SELECT b.key, block, coalesce(string_agg(x, chr(10) ORDER BY n) FILTER (n > beg AND n < coalesce(base, mid)), '') AS ours,
 string_agg(x, chr(10) ORDER BY n) FILTER (n > base AND n < mid) AS base, coalesce(string_agg(x, chr(10) ORDER BY n) FILTER (n > mid AND n < fin), '') AS theirs
FROM b JOIN a ON a.key = b.key AND a.try = b.try GROUP BY 1, 2""")
def conflict_blocks(t):
    return k.conflict_blocks(k.conflict_lines(lines(t)))


@query(LINES + """SELECT a.key, n AS line_no, x AS text FROM a LEFT JOIN b ON a.key = b.key AND a.try = b.try AND n <= fin
WHERE block IS NULL OR block % 3 = 2 OR (n > beg AND n < coalesce(base, mid)) AND block % 3 IN (0, 1) OR (n > mid AND n < fin AND block % 3 = 1)""")
def resolved_conflicts(t):
    """Of every three blocks, one takes our side, one both, and one stays as it is."""
    tagged = k.conflict_lines(lines(t))
    choices = tagged.where("block is not null and block % 3 < 2").select("key", "block").distinct().withColumn("take", F.when(F.col("block") % 3 == 0, "ours").otherwise("both"))
    return k.resolved(tagged, choices)
