"""Search over records by their message, by the change of their contents and by the paths they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_message(rows: DataFrame, message: str, query: str, regex: bool = False) -> DataFrame:
    """Rows whose message holds ``query`` in any case, as plain text or as a regular expression."""
    text = F.col(message)
    return rows.where(text.rlike("(?i)" + query) if regex else F.lower(text).contains(query.lower()))


def occurrences(text: Column, query: str) -> Column:
    """How often a text holds ``query``, not overlapping; 0 for null."""
    t = F.coalesce(text, F.lit(""))
    return F.floor((F.length(t) - F.length(F.replace(t, F.lit(query), F.lit("")))) / len(query)).cast("long")


def by_contents(versions: DataFrame, series: str, order: str, text: str, query: str) -> DataFrame:
    """Versions at which the number of occurrences of ``query`` changes: (series, order, before, after).

    Before the first version of a series there is none.
    """
    counted = versions.select(series, order, occurrences(F.col(text), query).alias("after"))
    before = F.coalesce(F.lag("after").over(Window.partitionBy(series).orderBy(order)), F.lit(0).cast("long"))
    return counted.withColumn("before", before).where("before <> after").select(series, order, "before", "after")


def by_path(touches: DataFrame, key: str, path: str, wanted: str) -> DataFrame:
    """Records (one row each) that touch the path ``wanted`` or, if it ends in ``/``, any path under it."""
    hit = F.col(path).startswith(wanted) if wanted.endswith("/") else F.col(path) == wanted
    return touches.where(hit).groupBy(key).agg(F.count("*").alias("touches"))


def holders(tokens: DataFrame, symbols: DataFrame) -> DataFrame:
    """(token, docs, first): for each wanted symbol how many documents hold it, and the least of them.

    ``symbols``: one column ``token``; those that nothing holds come back with 0.
    """
    found = tokens.join(symbols.distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("docs"), F.min("doc").alias("first"))
    return symbols.distinct().join(found, "token", "left").select("token", F.coalesce("docs", F.lit(0).cast("long")).alias("docs"), "first")
