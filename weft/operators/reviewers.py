"""Who looks at what: reach of reviewers, items that nobody looks at, and reviewers who have left a place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coverage(reviews: DataFrame, k: int = 10) -> DataFrame:
    """(actor, items, first): the number of items of each reviewer and the first k of them in order.

    ``reviews``: (item, txn, actor, weight).  Rows without an item or an actor count for nothing.
    """
    seen = reviews.where("item is not null and actor is not null").select("actor", "item").distinct()
    order = Window.partitionBy("actor").orderBy("item")
    head = seen.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("actor").agg(F.array_sort(F.collect_list("item")).alias("first"))
    return seen.groupBy("actor").agg(F.count("*").alias("items")).join(head, "actor")


def blind_spots(reviews: DataFrame, items: DataFrame) -> DataFrame:
    """(item): items that no reviewer has seen."""
    known = reviews.where("actor is not null").select("item")
    return items.where("item is not null").select("item").distinct().join(known, "item", "left_anti")


def departures(reviews: DataFrame, groups: DataFrame, least: int = 3, newest: int = 3) -> DataFrame:
    """(actor, group, items): reviewers of ``least`` or more items of a group who stand behind none of the
    ``newest`` weightiest transactions of any of these items.  ``groups``: (item, group).
    """
    known = reviews.where("item is not null and actor is not null")
    edges = known.groupBy("item", "txn").agg(F.max("weight").alias("weight"))
    order = Window.partitionBy("item").orderBy(F.round("weight", 9).desc(), "txn")
    top = edges.withColumn("r", F.row_number().over(order)).where(F.col("r") <= newest).select("item", "txn")
    active = known.join(top, ["item", "txn"]).select("item", "actor").distinct().withColumn("active", F.lit(1))
    held = known.select("item", "actor").distinct().join(groups.select("item", "group").distinct(), "item")
    out = held.join(active, ["item", "actor"], "left").groupBy("actor", "group").agg(F.count("*").alias("items"), F.count("active").alias("active"))
    return out.where((F.col("items") >= least) & (F.col("active") == 0)).select("actor", "group", "items")
