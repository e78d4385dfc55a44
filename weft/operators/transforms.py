"""Operational transformation of concurrent edits as column algebra; the edits of :mod:`editlog`.

An edit is a struct (lamport, peer, kind, path_a, path_b, weight); its clock is (lamport, peer).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDIT = "struct<lamport:bigint,peer:string,kind:string,path_a:string,path_b:string,weight:double>"


def edit(df: DataFrame) -> Column:
    """The edit of a row of a log."""
    return F.struct(*(F.col(n).cast(t).alias(n) for n, t in (x.split(":") for x in EDIT[7:-1].split(","))))


def support(e: Column) -> Column:
    """The paths that an edit touches."""
    return F.when(e["kind"].isin("add", "remove"), F.array(e["path_a"])).when(e["kind"] == "set_edge", F.array(e["path_a"], e["path_b"])).otherwise(F.array().cast("array<string>"))


def same_edge(a: Column, b: Column) -> Column:
    straight = (a["path_a"] == b["path_a"]) & (a["path_b"] == b["path_b"])
    return (a["kind"] == "set_edge") & (b["kind"] == "set_edge") & (straight | ((a["path_a"] == b["path_b"]) & (a["path_b"] == b["path_a"])))


def commute(a: Column, b: Column) -> Column:
    """Whether two edits give one state in either order as they are.

    Edits without a path in common do, and an edit delivered twice; an add does with an add or an edge,
    as both make what is missing.  All else needs :func:`transformed`.
    """
    makes = (a["kind"] == "add") & b["kind"].isin("add", "set_edge") | (a["kind"] == "set_edge") & (b["kind"] == "add")
    return ~F.arrays_overlap(support(a), support(b)) | a.eqNullSafe(b) | makes


def transformed(local: Column, applied: Column) -> Column:
    """``local`` as it has to be applied after ``applied``: a removal swallows edits of its path, a removal
    itself stands, and of two writes of one edge the later clock stands."""
    clock = lambda e: F.struct(e["lamport"], e["peer"])
    nothing = F.struct(local["lamport"].alias("lamport"), local["peer"].alias("peer"), F.lit("noop").alias("kind"), F.lit(None).cast("string").alias("path_a"), F.lit(None).cast("string").alias("path_b"), F.lit(None).cast("double").alias("weight"))
    swallowed = (applied["kind"] == "remove") & F.array_contains(support(local), applied["path_a"])
    late = (local["kind"] != "remove") & same_edge(local, applied) & ~(clock(local) > clock(applied))
    return F.when(commute(local, applied), local).when(swallowed | late, nothing).otherwise(local)


def applied(state: Column, e: Column) -> Column:
    """``state`` after an edit: struct(nodes array<string>, edges array<struct(a, b, w)>), both sorted."""
    a, b = F.least(e["path_a"], e["path_b"]), F.greatest(e["path_a"], e["path_b"])
    without = F.filter(state["edges"], lambda x: ~((x["a"] == a) & (x["b"] == b)))
    wrote = F.array_append(without, F.struct(a.alias("a"), b.alias("b"), e["weight"].alias("w")))
    pack = lambda nodes, edges: F.struct(F.array_sort(nodes).alias("nodes"), F.array_sort(edges).alias("edges"))
    return (
        F.when(e["kind"] == "add", pack(F.array_union(state["nodes"], F.array(e["path_a"])), state["edges"]))
        .when(e["kind"] == "remove", pack(F.array_remove(state["nodes"], e["path_a"]), F.filter(state["edges"], lambda x: (x["a"] != e["path_a"]) & (x["b"] != e["path_a"]))))
        .when(e["kind"] == "set_edge", pack(F.array_union(state["nodes"], F.array(e["path_a"], e["path_b"])), wrote))
        .otherwise(pack(state["nodes"], state["edges"]))
    )


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def converges(state: Column, a: Column, b: Column) -> Column:
    """Whether both ways round the square meet: a then b as transformed, b then a as transformed."""
    way = lambda x, y: _bound(applied(state, x), lambda s: _bound(transformed(y, x), lambda e: applied(s, e)))
    return way(a, b) == way(b, a)


def rekey_points(log: DataFrame, key: str, order: list[str], interval: int = 128) -> DataFrame:
    """Edits of each key at which what is derived from it is to be rebuilt: every ``interval``-th."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return log.withColumn("n", n).where(F.col("n") % interval == 0)
