"""Searches over orders, conversations and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as s
from ..operators import text as x
from .registry import query
from .text import TOKENS, tokens


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'the thin')")
def search_messages(t):
    """Documents whose text holds a phrase, in any case."""
    return s.by_message(t("documents"), "text", "The Thin").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE regexp_matches(text, '(?i)the (thin|her)[a-z]+')")
def search_patterns(t):
    return s.by_message(t("documents"), "text", "the (thin|her)[a-z]+", regex=True).select("doc_id", "source")


@query("""WITH c AS (SELECT conv_id, turn, ((length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' the ', ''))) // 5)::BIGINT AS after FROM conversations),
b AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY conv_id ORDER BY turn), 0)::BIGINT AS before FROM c)
SELECT conv_id, turn, before, after FROM b WHERE before <> after""")
def search_contents(t):
    """Turns at which the number of occurrences of a word changes."""
    return s.by_contents(t("conversations"), "conv_id", "turn", "text", " the ")


@query("SELECT l_orderkey, count(*) AS touches FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#12' GROUP BY 1")
def search_paths(t):
    """Orders that touch a brand's directory of parts."""
    path = F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string"))
    touches = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey"), path.alias("path")), "l_partkey")
    return s.by_path(touches, "l_orderkey", "path", "Brand#12/")


@query(TOKENS + """, w AS (SELECT DISTINCT token FROM tok JOIN documents ON doc_id = doc WHERE doc % 20 = 0 AND length(token) >= 12 UNION SELECT 'absent')
SELECT token, count(doc) AS docs, coalesce(min(doc), -1) AS first FROM w LEFT JOIN tok USING (token) GROUP BY 1""")
def symbol_holders(t):
    """Which documents hold the long symbols of every twentieth document."""
    own = tokens(t)
    wanted = own.where((F.col("doc") % 20 == 0) & (F.length("token") >= 12)).select("token").distinct()
    spark = wanted.sparkSession
    return s.holders(own, wanted.union(spark.createDataFrame([("absent",)], "token string"))).withColumn("first", F.coalesce("first", F.lit(-1).cast("long")))
