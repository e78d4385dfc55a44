"""Steps whose disk and rows must not grow faster than their input."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from weft.operators import coupling as c
from weft.operators import curvature as k
from weft.operators import diffusion as d
from weft.operators import hops as h
from weft.operators import hunks
from weft.operators import relevance
from weft.operators import text as x
from weft.operators import graph as g
from weft.operators import transforms as t
from weft.operators.graph import cut, folder
from weft.plans import graph as graphs
from weft.plans import tags
from weft.sources import listings


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_cut_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    assert len(cut(spark.range(1000).groupBy((F.col("id") % 7).alias("x")).count()).collect()) == 7
    assert not shuffle_files(spark) - before


def test_heat_in_batches_is_the_same_and_its_steps_are_deleted(spark, monkeypatch):
    ring = spark.createDataFrame([(i, (i + 1) % 40, 1.0) for i in range(40)], "a long, b long, w double")
    sources = spark.range(40).select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(1.0).alias("mass"))
    at = lambda df: {(r["source"], r["node"]): round(r["phi0"], 12) for r in df.collect()}
    whole = at(d.heat_of(ring, sources, [1.0]))
    monkeypatch.setattr(d, "ROWS", 1)
    dropped = []
    monkeypatch.setattr(d, "drop", dropped.append)
    assert at(d.heat_of(ring, sources, [1.0])) == whole
    assert len(dropped) > 3 * 10  # three blocks of sources, each a batch with all its steps


@pytest.mark.parametrize("small", [1, 64])
def test_coherence_of_small_and_large_sets(spark, monkeypatch, small):
    monkeypatch.setattr(c, "SMALL", small)
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.25), (9, 1, 0.5)], "a long, b long, score double")
    sets = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), ("y", 1), ("y", 9), ("z", 7)], "set_id string, item long")
    got = {r["set_id"]: round(r["coherence"], 6) for r in c.coherence(edges, sets).collect()}
    assert got == {"x": 0.25, "y": 0.5, "z": 1.0}


def test_triangles_send_lists_and_no_pairs_of_edges(spark):
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in itertools.combinations(range(7), 2)], "a long, b long, w double")
    found = k.triangles(edges)
    assert found.count() == 35 and "array_intersect" in found._jdf.queryExecution().executedPlan().toString()


def test_hops_of_more_sources_than_a_row_has_bits(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 150, 1.0) for i in range(150)], "a long, b long, w double")
    got = h.hops(ring, spark.range(150).select(F.col("id").alias("source")))
    rows = {(r["source"], r["node"]): r["hops"] for r in got.collect()}
    assert rows == {(s, n): min((s - n) % 150, (n - s) % 150) for s in range(150) for n in range(150)}
    assert "bits" in got._jdf.queryExecution().optimizedPlan().toString()


def test_new_folders_differ(spark):
    assert folder(spark) != folder(spark)


def tangle(spark, n=60, parts=8):
    """Transactions 1 .. n of up to five of a few items, so that all of them meet."""
    rows = {(t, (t * j * j + j) % parts) for t in range(1, n + 1) for j in range(t % 5 + 1)}
    return rows, spark.createDataFrame(sorted(rows), "txn long, item long")


def test_transactions_of_a_common_item_are_not_all_paired(spark, monkeypatch):
    rows, items = tangle(spark)
    ranks = spark.range(1, 61).select(F.col("id").alias("txn"), (F.col("id") * 7 % 61 * 40).alias("rank"))
    whole = lambda: sorted((r["src"], r["dst"], round(r["w"], 12)) for r in c.transaction_graph(items, ranks, 3, 0.1).collect())
    of = {t: {i for u, i in rows if u == t} for t, _ in rows}
    rank = {t: t * 7 % 61 * 40 for t in of}
    score = lambda x, y: len(of[x] & of[y]) / len(of[x] | of[y]) * math.exp(-0.1 * abs(rank[x] - rank[y]))
    want = [(x, y, round(score(x, y), 12)) for x in of for y in sorted((y for y in of if y != x and of[x] & of[y]), key=lambda y: (-round(score(x, y), 9), y))[:3]]  # noqa: B023
    assert whole() == sorted(want)
    monkeypatch.setattr(c, "SMALL", 2)
    assert whole() == sorted(want)
    monkeypatch.setattr(c, "pairs", None)
    assert whole() == sorted(want)


@pytest.mark.parametrize("small", [2, 64])
def test_places_that_share_one_name_are_not_all_paired(spark, monkeypatch, small):
    rows, items = tangle(spark)
    monkeypatch.setattr(c, "SMALL", small)
    monkeypatch.setattr(hunks, "SMALL", small)
    own = spark.range(1, 61).select(F.col("id").alias("hunk"), (F.col("id") % 9).alias("file"), F.when(F.col("id") != 5, F.col("id") / 100).alias("balance"))
    got = {(r["a"], r["b"]): round(r["score"], 9) for r in hunks.named_pairs(own, items.toDF("hunk", "token"), 3).collect()}
    of = {t: {i for u, i in rows if u == t} for t, _ in rows}
    score = {(x, y): round(len(of[x] & of[y]) / len(of[x] | of[y]), 9) for x in of for y in of if x < y and of[x] & of[y]}
    assert got.items() <= score.items()
    if small == 64:
        assert len(got) < len(score)
    for x in of:
        best = sorted((pair for pair in score if x in pair), key=lambda p: (-score[p], sum(p)))[:3]
        assert set(best) <= set(got)
    assert all(pair in got for pair in score if len(of[pair[0]] & of[pair[1]]) > 1 or pair[0] % 9 == pair[1] % 9)


@pytest.mark.parametrize("tokens_of_a_block", [40, 1 << 20])
def test_pairs_of_token_sets_are_no_rows_before_they_count(spark, monkeypatch, tokens_of_a_block):
    monkeypatch.setattr(x, "BLOCK_TOKENS", tokens_of_a_block, raising=False)
    sets = {i: {"all", "even" if i % 2 else "odd", f"t{i * i % 11}", f"u{i % 13}", f"v{i}"} for i in range(60)} | {99: {"alone"}}
    tokens = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "doc long, token string")
    idf = {t: math.log(1 + len(sets) / (1 + sum(t in s for s in sets.values()))) for s in sets.values() for t in s}
    w = lambda s: sum(idf[t] for t in s)
    score = {(a, b): w(sets[a] & sets[b]) / w(sets[a] | sets[b]) for a, b in itertools.combinations(sets, 2)}
    found = x.idf_jaccard(tokens, x.document_frequency(tokens, len(sets)), 0.2)
    assert {(r["a"], r["b"]): round(r["score"], 9) for r in found.collect()} == {p: round(s, 9) for p, s in score.items() if s >= 0.2}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("listed", [3, 4096])
def test_missing_peers_are_scored_only_if_a_stretch_allows_it(spark, monkeypatch, listed):
    monkeypatch.setattr(c, "LISTED", listed, raising=False)
    w = {(a, b): ((a * 7 + b * 13) % 10 + 1) / 40 for a, b in itertools.combinations(range(24), 2) if (a * b + a) % 3}
    of = {s: sorted({(s * 5 + j * j * 7) % 24 for j in range(s % 6 + 1)}) for s in range(40)}
    edges = spark.createDataFrame([(a, b, s) for (a, b), s in w.items()], "a long, b long, score double")
    sets = spark.createDataFrame([(s, i) for s, x in of.items() for i in x] + [(7, None)], "set_id long, item long")
    near = lambda a, b: w.get((min(a, b), max(a, b)), 0.0)
    want, strong = set(), 0
    for s, items in of.items():
        strong += sum(any(near(i, d) >= 0.12 for i in items) for d in range(24) if d not in items)
        score = {d: round(sum(near(i, d) for i in items) / (len(items) + (s == 7)), 9) for d in range(24) if d not in items}
        best = sorted((-v, d) for d, v in score.items() if v >= 0.12)[:5]
        want |= {(s, d, -v) for v, d in best}
    tables, whole = [], c.cut
    monkeypatch.setattr(c, "cut", lambda df: tables.append(whole(df)) or tables[-1])
    assert {(r["set_id"], r["item"], r["score"]) for r in c.missing_peers(edges, sets, least=0.12).collect()} == want
    scored = [table.count() for table in tables if set(table.columns) == {"set_id", "size", "dst"}]
    assert len(scored) == 1 and scored[0] < strong * 0.8


def test_states_of_an_edit_are_written_once(spark):
    row = spark.range(1).select(F.expr(f"cast(null as {t.EDIT})").alias("e"), F.expr(f"cast(null as {t.EDIT})").alias("f"), F.expr("named_struct('nodes', array('x'), 'edges', array(named_struct('a', 'x', 'b', 'y', 'w', 1D)))").alias("s"))
    plan = row.select(t.converges(F.col("s"), F.col("e"), F.col("f")))._jdf.queryExecution().analyzed().toString()
    assert 0 < plan.count("array_union") <= 16


def test_partitions_of_pairs_follow_the_rows(spark, monkeypatch):
    rows, _ = tangle(spark)
    table = spark.createDataFrame([(t, i) for t, i in rows for _ in range(2)] + [(None, 1), (1, None)], "txn long, item long")
    edges = lambda: c.jaccard_edges(c.transaction_items(table, "txn", "item"))
    whole = {tuple(r) for r in edges().collect()}
    monkeypatch.setattr(c, "ROWS", 10, raising=False)
    spread = edges()
    assert {tuple(r) for r in spread.collect()} == whole and whole
    assert spread.rdd.getNumPartitions() == -(-len(rows) // 10)


def test_rows_are_dealt_where_the_session_has_more_partitions(spark, monkeypatch):
    monkeypatch.setattr(c, "ROWS", 100)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert c.partitions(spark.range(1000)) == 10 and c.partitions(spark.range(100)) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_blame_sorts_no_texts(spark):
    lines = spark.createDataFrame([("k", 1, "a" * 40 + " 1 1"), ("k", 2, "summary s"), ("k", 3, "\tone")], "key string, line_no int, text string")
    found = listings.blame(lines)
    assert found.count() == 1 and "text#" not in found._jdf.queryExecution().optimizedPlan().toString().rpartition("Window")[0]


def test_fragments_make_the_edges_once(spark):
    edges = spark.range(10).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (F.col("id") / 10).alias("w"))
    found = g.fragmentation(edges, 0.5, 11)
    assert found.first()[:3] == (6, 6 / 11, 0) and "Range" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_reach_ships_no_sketch_of_the_last_hop(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 20, 1.0) for i in range(20)], "a long, b long, w double")
    found = h.reach(ring, 3)
    assert {(r["hop"], r["reached"]) for r in found.collect()} == {(0, 1), (1, 3), (2, 5), (3, 7)}
    assert "hll_union_agg" in found._jdf.queryExecution().optimizedPlan().toString()  # counted where it is made


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def table(spark):
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


def test_orders_items_and_edges_of_tags_are_made_once(spark):
    for made in (tags.transactions, tags.items, tags.edges):
        assert not {"Join", "Aggregate"} & set(plan(made(table(spark))).replace("'", " ").split())


def test_edges_of_clusters_are_made_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(graphs.f, "clusters", lambda members, edges, pairs, threshold: seen.append(edges) or edges)
    graphs.item_clusters(spark, "/root/testdata/sf0.001")
    assert "Join" not in plan(seen[0])


def test_edges_of_relevance_are_made_once(spark, monkeypatch):
    seen, top = [], relevance.top_neighbours
    monkeypatch.setattr(relevance, "top_neighbours", lambda pairs, k: seen.append(pairs) or top(pairs, k))
    nodes = spark.range(4).select(F.col("id").alias("item"), F.lit("f").alias("folder"), F.array(F.lit("f"), F.col("id").cast("string")).alias("path"), F.lit(3).alias("touches"), F.lit(1.0).alias("mass"), F.lit(1.0).alias("volatility"), F.lit(1.0).alias("integrity"))
    edges = spark.range(3).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(0.5).alias("score"))
    assert relevance.build(nodes, edges, 10, least=0.0).count() == 6 and "Range" not in plan(seen[0])


@pytest.mark.parametrize("most", [None, 0, 2])
def test_hops_within_tasks_write_nothing_but_the_graph(spark, monkeypatch, most):
    from weft.operators import spread

    ways = [(i, (i + 1) % 90, 1.0) for i in range(90)] + [(i, i + 7, 1.0) for i in range(40)] + [(200, 201, 1.0)]
    edges = spark.createDataFrame(ways, "a long, b long, w double")
    sources = spark.createDataFrame([(i,) for i in [*range(80), 200, 333]], "source long")  # 333 has no edge
    key = lambda df: sorted(map(tuple, df.collect()))
    written = []
    monkeypatch.setattr(h, "cut", lambda df: written.append(df.columns) or cut(df))
    monkeypatch.setattr(spread, "PIECE", 7)
    got = key(h.hops(edges, sources, most))
    assert ["node", "block", "bits"] not in written
    monkeypatch.setattr(h, "NODES", 0)
    assert got == key(h.hops(edges, sources, most)) and ["node", "block", "bits"] in written


def test_triangles_of_lists_that_stream_past(spark, monkeypatch):
    import random

    rng = random.Random(3)
    ways = {tuple(sorted(rng.sample(range(-20, 60), 2))) for _ in range(700)} | {(10**12, x) for x in range(-20, 40)} | {(10**12, 2**62)}
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in ways], "a long, b long, w double")
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(k.triangles(edges))
    for size in ("SENT", "STREAMED", "MET"):
        monkeypatch.setattr(k, size, 5)
    found = k.triangles(edges)
    assert key(found) == want and len(want) > 500
    assert "array_intersect" not in found._jdf.queryExecution().executedPlan().toString()
    assert key(k.curvature(edges).select("a", "b", "triangles")) == sorted((a, b, sum(a in t and b in t for t in want)) for a, b in ({tuple(sorted(w)) for w in ways}))


@pytest.mark.parametrize("wide", [1, 4])
def test_transactions_near_in_rank_meet_over_the_ends_of_bins(spark, monkeypatch, wide):
    monkeypatch.setattr(c, "WIDE", wide)
    n = 1500  # seven bins of the least width
    items = spark.range(n).select(F.col("id").alias("txn"), (F.col("id") % 90).alias("item"), F.lit(1.0).alias("mass"))
    ranks = spark.range(n).select(F.col("id").alias("txn"), (n - 1 - F.col("id")).alias("rank"))
    got = {}
    for r in c.transaction_graph(items, ranks, 4, 0.1).collect():
        got.setdefault(r["src"], set()).add(r["dst"])
    for x in range(n):
        others = [y for y in range(x % 90, n, 90) if y != x]
        assert got[x] == set(sorted(others, key=lambda y: (-round(math.exp(-0.1 * abs(x - y)), 9), y))[:4])


def test_transactions_carry_their_rank_to_their_links(spark):
    ranks = spark.range(1, 61).select(F.col("id").alias("txn"), F.col("id").alias("rank"))
    plan = c.transaction_graph(tangle(spark)[1], ranks, 3, 0.1)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("Join Inner") <= 6  # sides of small and of large transactions, and what the latter look up


def test_one_source_of_a_large_graph_goes_by_shuffled_steps(spark, monkeypatch):
    ring = spark.createDataFrame([(i, (i + 1) % 40, 1.0) for i in range(40)], "a long, b long, w double")
    sources = lambda n: spark.range(n).select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(1.0).alias("mass"))
    steps = []
    monkeypatch.setattr(d, "basis", lambda *a, f=d.basis: steps.append(1) or f(*a))
    monkeypatch.setattr(d, "ROWS", 160)
    assert d.heat_of(ring, sources(5), [1.0]).count() and not steps
    assert d.heat_of(ring, sources(1), [1.0]).count() and steps


def test_links_of_places_are_scored_from_written_pairs(spark):
    rows, items = tangle(spark)
    own = spark.range(1, 61).select(F.col("id").alias("hunk"), (F.col("id") % 9).alias("file"), (F.col("id") % 30).alias("start"), F.col("id").alias("additions"), F.lit(1).alias("deletions"))
    plan = hunks.hunk_graph(own, items.select(F.col("txn").alias("hunk"), F.col("item").alias("token")), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "collect_set" not in plan
