"""Reviewers: the suppliers of taxed returned lines; and the words that hold lines of text together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reviewers as r
from ..operators import text as x
from .registry import query

RETURNED = "l_returnflag = 'R'"
SEEN = RETURNED + " AND l_tax >= 0.08"
REVIEWS = f"WITH v AS (SELECT l_partkey AS item, l_orderkey AS txn, l_suppkey AS actor, l_extendedprice AS weight FROM lineitem WHERE {SEEN}), o AS (SELECT DISTINCT actor, item FROM v)\n"


def reviews(t, where: str = SEEN):
    return t("lineitem").where(where).select(F.col("l_partkey").alias("item"), F.col("l_orderkey").alias("txn"), F.col("l_suppkey").alias("actor"), F.col("l_extendedprice").alias("weight"))


@query(REVIEWS + "SELECT actor, count(*) AS items, array_to_string(list(item ORDER BY item)[1:10], ',') AS first FROM o GROUP BY 1")
def reviewer_coverage(t):
    return r.coverage(reviews(t)).withColumn("first", F.array_join(F.col("first").cast("array<string>"), ","))


@query(REVIEWS + "SELECT DISTINCT l_partkey AS item FROM lineitem WHERE l_partkey NOT IN (SELECT item FROM o)")
def review_blind_spots(t):
    """Parts that are sold and that no reviewer has seen."""
    return r.blind_spots(reviews(t), t("lineitem").select(F.col("l_partkey").alias("item")))


@query(REVIEWS.replace(SEEN, RETURNED) + """, tp AS (SELECT item, txn FROM (SELECT item, txn, max(weight) AS w FROM v GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY item ORDER BY round(w, 9) DESC, txn) <= 3),
ac AS (SELECT DISTINCT item, actor FROM v JOIN tp USING (item, txn))
SELECT o.actor, p_brand AS "group", count(*) AS items FROM o JOIN part ON p_partkey = o.item LEFT JOIN ac ON ac.item = o.item AND ac.actor = o.actor GROUP BY 1, 2 HAVING count(*) >= 3 AND count(ac.item) = 0""")
def reviewer_departures(t):
    """Suppliers with returns in a brand who stand behind none of its parts' three dearest returns."""
    return r.departures(reviews(t, RETURNED), t("part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("group")))


@query(r"""WITH s AS (SELECT regexp_replace(trim(l), '^\w+(\([^)]*\))?\s*:\s*', '') AS s FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)),
w AS (SELECT s, regexp_extract_all(s, '\p{L}[\p{L}\p{N}_\-]{0,47}') AS w, lower(regexp_replace(s, '[^\p{L}]', '', 'g')) AS f FROM s),
c AS (SELECT row_number() OVER () AS k, w FROM w WHERE len(list_distinct(list_transform(w, lambda x: lower(x)))) > 1 AND NOT (length(f) >= 4 AND replace(f, f[1], '') = '') AND NOT regexp_matches(s, '(?i)^update\s+[\w\-./]{1,80}\.\w{1,8}$')),
u AS (SELECT k, unnest(w) AS raw, generate_subscripts(w, 1) AS i FROM c), n AS (SELECT count(*) AS total FROM c),
g AS (SELECT lower(raw) AS word, count(DISTINCT k) AS subjects, count(*) FILTER (i = 1) AS leads, count(*) AS n, count(*) FILTER (length(raw) >= 2 AND regexp_matches(raw, '\p{Lu}') AND NOT regexp_matches(raw, '\p{Ll}')) AS caps FROM u GROUP BY 1)
SELECT word, subjects, round(leads / subjects, 6) AS leading, round(caps / n, 6) AS shouted FROM g, n WHERE total >= 3 AND subjects >= greatest(2, floor(total * 0.1)) AND length(word) <= 4 AND leads / subjects <= 0.25 AND caps / n <= 0.35""")
def structural_words(t):
    """Short words that hold the lines of the documents together."""
    return x.structural_words(x.line_rows(t("documents"), "doc_id", "text"), "content")
