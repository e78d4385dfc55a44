"""Edge cases of relations and paths, by hand."""

from pyspark.sql import functions as F

from weft.functions.paths import path_affinity
from weft.operators import relations as r


def test_path_affinity(spark):
    rows = [("a/b/x.dart", "a/b/x.dart"), ("a/b/xy.c", "a\\b\\xz.c"), ("x", "xy"), ("a/.git", "a/.gip"), ("a/b/q.c", "a/c/r.c"), ("a/b/", "a/b/."), (None, "a")]
    got = [x[0] for x in spark.createDataFrame(rows, "a string, b string").select(path_affinity(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.5, 0.0, 0.75, 0.0, 0.0, None]


def test_last_names(spark):
    pairs = [(k, k + 1) for k in range(1, 20)] + [(30, 31), (31, 32), (32, 30), (33, 30), (40, 40)]
    got = {x.path: (x.last, x.hops) for x in r.last_names(spark.createDataFrame(pairs, "old long, new long"), steps=8).collect()}
    assert got == {k: (20, 20 - k) for k in range(1, 20)}
    assert r.last_names(spark.createDataFrame([], "old long, new long")).count() == 0


def test_merged_branches(spark):
    branches = spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "p"), ("y", "p"), ("z", None)], "branch string, patch string")
    got = {x.branch: (x.commits, x.merged) for x in r.merged_branches(branches, spark.createDataFrame([("p",), (None,)], "patch string")).collect()}
    assert got == {"x": (2, False), "y": (2, True), "z": (0, None)}


def test_common_directory(spark):
    rows = spark.createDataFrame([("x", "a/b/c"), ("x", "a/b/d/e"), ("y", "a/b"), ("z", "a/b"), ("z", "b/b"), ("w", "q"), ("w", "a/q"), ("x", None)], "g string, p string")
    assert {x.g: (x.paths, x.shared) for x in r.common_directory(rows, "g", "p").collect()} == {"x": (2, "a/b/"), "y": (1, None), "z": (2, None), "w": (2, None)}


def test_graph_edits(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0)], "a long, b long, w double")
    links = spark.createDataFrame([(4, 1, 0.5), (4, 1, 0.5), (4, 4, 9.0), (2, 1, 1.0), (4, 3, 0.0)], "node long, to long, w double")
    assert sorted(map(tuple, r.with_nodes(edges, links).collect())) == [(1, 2, 2.0), (1, 4, 1.0), (2, 3, 2.0)]
    assert r.without_nodes(edges, spark.createDataFrame([(3,), (9,)], "node long")).select("a", "b").collect() == [(1, 2)]


def test_strata_skip_empty(spark):
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(["", "a", "a", None, "", "a", "b", "a"])], "s long, k long, label string")
    assert sorted(x.k for x in r.label_strata(rows, "s", ["k"], "label").collect()) == [1, 6, 7]
