"""The forest against Kruskal, its cuts against plain components, clusters against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from weft.operators import forest as f
from weft.operators.ordering import numbered


def frame(spark, rows):
    return spark.createDataFrame(rows, "a long, b long, w double")


def find(p, x):
    while p.setdefault(x, x) != x:
        x = p[x]
    return x


def kruskal(rows):
    p, out = {}, []
    best = {}
    for a, b, w in rows:
        if a != b and w is not None and w == w:
            k = (min(a, b), max(a, b))
            best[k] = max(best.get(k, w), w)
    for (a, b), w in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        x, y = find(p, a), find(p, b)
        if x != y:
            p[max(x, y)] = min(x, y)
            out.append((a, b, w))
    return sorted(out)


@pytest.mark.parametrize("seed, nodes, links", [(1, 30, 40), (2, 60, 50), (3, 12, 60), (4, 5, 0)])
def test_forest_is_the_greedy_one(spark, seed, nodes, links):
    rng = random.Random(seed)
    rows = [(rng.randrange(nodes), rng.randrange(nodes), rng.choice([0.1, 0.5, 0.5, 0.9, rng.random()])) for _ in range(links)] + [(1, 1, 2.0), (1, 2, float("nan")), (3, 4, None)]
    assert sorted(tuple(r) for r in f.spanning_forest(frame(spark, rows)).collect()) == kruskal(rows)


def test_long_chains_of_equal_weight(spark):
    rows = [(i, i + 1, 1.0) for i in range(70)]
    assert sorted(tuple(r) for r in f.spanning_forest(frame(spark, rows)).collect()) == rows


def test_cuts_of_the_forest_are_the_components_of_the_graph(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(40), rng.randrange(40), round(rng.random(), 2)) for _ in range(70)]
    rows = [r for r in rows if r[0] != r[1]]
    thresholds = [0.3, 0.9, 0.6, 0.0]
    got = {r["threshold"]: r for r in f.sweep(frame(spark, rows), thresholds, 45).collect()}
    links = f.spanning_forest(frame(spark, rows)).cache()
    for t in thresholds:
        p = {}
        for a, b, w in rows:
            if w >= t:
                x, y = find(p, a), find(p, b)
                p[max(x, y)] = min(x, y)
        roots = {x: find(p, x) for x in list(p)}
        sizes = [list(roots.values()).count(r) for r in set(roots.values())]
        m = sum(w >= t for _, _, w in rows)
        want = len(sizes) + 45 - len(roots)
        assert (got[t]["components"], got[t]["cycle_rank"]) == (want, m - 45 + want)
        assert got[t]["largest_share"] == pytest.approx(max(sizes, default=1) / 45)
        assert {r["node"]: r["root"] for r in f.single_link(links, t).collect()} == roots


def test_clusters_need_a_binding_axis_or_two(spark):
    members = spark.createDataFrame([(i,) for i in range(1, 12)], "item long")
    rows = [(1, 2, 0.4, "co_change"), (2, 3, 0.1, "co_change"), (2, 3, 0.05, "transport"), (4, 5, 0.9, "symbol"), (6, 7, 0.3, "symbol"), (6, 7, 0.35, "path"), (8, 9, 0.5, "co_change"), (8, 99, 0.9, "co_change")]
    pairs = spark.createDataFrame(rows, "a long, b long, score double, axis string")
    edges = spark.createDataFrame([(1, 2, 0.4), (2, 3, 0.1), (8, 9, 0.5)], "a long, b long, score double")
    got = {r["item"]: (r["cluster"], r["size"], round(r["tightness"], 6), r["axis"]) for r in f.clusters(members, edges, pairs, 0.2).collect()}
    assert got[8] == got[9] == (0, 2, 0.5, "co_change")
    assert got[1] == got[2] == got[3] == (1, 3, round(0.5 / 3, 6), "co_change")
    assert got[6] == got[7] == (2, 2, 0.0, "path")
    assert all(got[i] == (-1, 1, 0.0, "") for i in (4, 5, 10, 11))


def test_threshold_is_the_mean_within_a_band(spark):
    members = spark.createDataFrame([(1,), (2,), (3,)], "item long")
    e = spark.createDataFrame([(1, 2, 0.2), (2, 3, 0.4), (3, 9, 1.0)], "a long, b long, score double")
    assert f.adaptive_threshold(e, members) == pytest.approx(0.3)
    assert f.adaptive_threshold(e, members, 0.35) == 0.35
    assert f.adaptive_threshold(e.where("a = 9"), members) == 0.25


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"))
    assert all(r["n"] == r["x"] for r in numbered(df, [F.col("x")], partitions=7).collect())
