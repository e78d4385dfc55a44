"""Roll-ups, gates and projections over grouped rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sigma_gate(rows: DataFrame, group: str, value: str, width: float = 2.0) -> DataFrame:
    """Rows farther than ``width`` sample deviations from their group's mean."""
    stats = rows.groupBy(F.col(group).alias("__g")).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    far = F.abs(F.col(value) - F.col("__m")) > width * F.col("__s")
    return rows.join(stats, F.col(group) == F.col("__g")).where(far).select(*rows.columns)


def principal_axis(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(grp, angle, spread): direction and variance along the first axis of each 2-D cloud."""
    s = rows.groupBy(F.col(group).alias("grp")).agg(F.var_pop(x).alias("a"), F.covar_pop(x, y).alias("b"), F.var_pop(y).alias("c"))
    root = F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, 2) + F.col("b") * F.col("b"))
    return s.select("grp", (F.atan2(2 * F.col("b"), F.col("a") - F.col("c")) / 2).alias("angle"), ((F.col("a") + F.col("c")) / 2 + root).alias("spread"))


def details(rows: DataFrame, txn: str, item: str, mass: str) -> DataFrame:
    """(txn, items, total, rows): nested item statistics of each transaction."""
    nested = F.array_sort(F.collect_list(F.struct(F.col(item).alias("item"), F.col(mass).alias("mass"))))
    return rows.groupBy(F.col(txn).alias("txn")).agg(F.count_distinct(item).alias("items"), F.sum(mass).alias("total"), nested.alias("rows"))


def levels(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, total) at every level of a hierarchy of keys; null stands for all."""
    return rows.rollup(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def weighted_means(rows: DataFrame, group: str, value: str, weight: str, newest: Column, k: int) -> DataFrame:
    """(grp, mean, share): weighted mean over the k first rows of each group, and their share of all weight."""
    order = Window.partitionBy(group).orderBy(newest)
    total = F.sum(weight).over(Window.partitionBy(group))
    top = rows.withColumns({"__r": F.row_number().over(order), "__t": total}).where(F.col("__r") <= k)
    return top.groupBy(F.col(group).alias("grp")).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"), (F.sum(weight) / F.first("__t")).alias("share"))


def relevance(rows: DataFrame, key: str, score: Column, temperature: Column, activity: Column) -> DataFrame:
    """(key, relevance): score * sqrt(1 + temperature * activity) - 1, those above zero."""
    r = score * F.sqrt(1 + temperature * activity) - 1
    return rows.select(F.col(key).alias("key"), r.alias("relevance")).where("relevance > 0")


def band(value: Column, cuts: list[tuple[float, str]], rest: str) -> Column:
    """The label of the first cut that a value reaches; cuts descend."""
    out = F.when(value >= cuts[0][0], cuts[0][1])
    for low, label in cuts[1:]:
        out = out.when(value >= low, label)
    return out.otherwise(rest)
