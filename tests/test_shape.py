"""Curvature, hops, lattices, edit transforms and the stream of rebased edits, against plain Python."""

import itertools
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import curvature as k
from weft.operators import editlog
from weft.operators import hops as h
from weft.operators import lattice as l
from weft.operators import transforms as x
from weft.operators import vectors
from weft.streaming import rebase


def frame(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a long, b long, w double")


def around(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def test_curvature_of_every_edge(spark):
    rng = random.Random(6)
    pairs = sorted({tuple(sorted(rng.sample(range(14), 2))) for _ in range(40)})
    near = around(pairs)
    got = {(r["a"], r["b"]): r for r in k.curvature(frame(spark, pairs)).collect()}
    assert set(got) == set(pairs)
    for a, b in pairs:
        t, (d, e) = len(near[a] & near[b]), sorted((len(near[a]), len(near[b])))
        rest = 1 - 1 / d - 1 / e
        assert got[a, b]["triangles"] == t
        assert got[a, b]["curvature"] == pytest.approx(t / e - max(0, rest - t / d) - max(0, rest - t / e))
    found = {tuple(r) for r in k.triangles(frame(spark, pairs)).collect()}
    assert found == {c for c in itertools.combinations(range(14), 3) if all(y in near.get(z, ()) for y, z in itertools.combinations(c, 2))}


def test_known_shapes(spark):
    whole = list(itertools.combinations(range(5), 2))
    assert all(r["curvature"] == pytest.approx(3 / 4) for r in k.curvature(frame(spark, whole)).collect())
    bell = whole + [(a + 10, b + 10) for a, b in whole] + [(0, 10)]
    curved = k.curvature(frame(spark, bell))
    least = k.bridges(curved, 1).first()
    assert (least["a"], least["b"]) == (0, 10) and least["curvature"] < 0
    stepped = {(r["a"], r["b"]): r["w"] for r in k.flow_step(curved).collect()}
    assert stepped[0, 10] > 1 > stepped[1, 2]


def test_a_hub_makes_no_square_of_pairs(spark):
    n = 100_000
    star = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("w"))
    rim = spark.range(1, n).where("id % 2 = 1").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1.0).alias("w"))
    edges = star.union(rim)
    assert k._directed(edges).groupBy("x").count().agg(F.max("count")).first()[0] <= 2
    assert k.triangles(edges).count() == n // 2


def test_hops_are_breadth_first(spark):
    rng = random.Random(8)
    pairs = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(32)})
    near, want = around(pairs), {}
    for s in (0, 3, 29):
        seen, queue = {s: 0}, deque([s])
        while queue:
            u = queue.popleft()
            for v in near.get(u, ()):
                if v not in seen:
                    seen[v] = seen[u] + 1
                    queue.append(v)
        want |= {(s, v): d for v, d in seen.items()}
    sources = spark.createDataFrame([(0,), (3,), (29,), (3,)], "source long")
    assert {(r["source"], r["node"]): r["hops"] for r in h.hops(frame(spark, pairs), sources).collect()} == want
    assert {(r["source"], r["node"]) for r in h.hops(frame(spark, pairs), sources, 2).collect()} == {key for key, d in want.items() if d <= 2}


def test_reach_is_within_the_error_of_its_sketches(spark):
    rng = random.Random(9)
    pairs = sorted({tuple(sorted(rng.sample(range(3000), 2))) for _ in range(9000)})
    near = around(pairs)
    got = {(r["node"], r["hop"]): r["reached"] for r in h.reach(frame(spark, pairs), 3).collect()}
    errors = []
    for s in range(0, 3000, 100):
        seen = {s} if s in near else set()
        for hop in range(4):
            if seen:
                errors.append(abs(got[s, hop] / len(seen) - 1))
            seen |= {v for u in seen for v in near[u]}
    assert np.sqrt(np.mean(np.square(errors))) <= 1.04 / 64 and max(errors) <= 5 * 1.04 / 64


def test_lattices_merge_and_transform(spark):
    rng = np.random.default_rng(3)
    rows = [("g", int(c), float(v)) for c, v in zip(rng.integers(0, 40, 900), rng.random(900), strict=True)]
    df = spark.createDataFrame(rows, "grp string, at long, v double")
    see = lambda d: l.observed(d, "grp", F.col("at"), F.col("v"), 4)
    whole = {r["cell"]: (r["n"], r["mean"], r["m2"]) for r in see(df).collect()}
    parts = l.merged(see(df.where("v < 0.3")), see(df.where("v >= 0.3 and v < 0.31")), see(df.where("v >= 0.31")))
    for r in parts.collect():
        assert (r["n"], r["mean"], r["m2"]) == pytest.approx(whole[r["cell"]])
    f = np.array([whole.get(c, (0, 0, 0))[1] if whole.get(c, (0,))[0] >= l.WARM else l.COLD for c in range(16)])
    signs = np.array([[(-1) ** bin(i & j).count("1") for i in range(16)] for j in range(16)])
    read = lambda d: np.array([v for _, v in sorted((r["cell"], r["v"]) for r in d.collect())])
    cells = l.means(see(df), 4)
    assert np.allclose(read(l.walsh_rows(cells, 4)), signs @ f)
    assert np.allclose(read(l.walsh_rows(l.walsh_rows(cells, 4), 4, inverse=True)), f)
    assert np.allclose(read(l.walsh_rows(l.walsh_rows(cells, 2), 4, first=2)), signs @ f)
    damp = np.exp([-2 * 0.7 / 4 * bin(i).count("1") for i in range(16)])
    assert np.allclose(read(l.heat(cells, 4, 0.7)), signs @ (damp * (signs @ f)) / 16)
    top = [r["cell"] for r in l.dominant(l.walsh_rows(cells, 4), 2, 3).orderBy("rank").collect()]
    s = signs @ f
    assert top == sorted((i for i in range(16) if 1 <= bin(i).count("1") <= 2), key=lambda i: (-round(abs(s[i]), 9), i))[:3]


def test_walsh_of_arrays(spark):
    v = np.random.default_rng(1).random(32)
    signs = np.array([[(-1) ** bin(i & j).count("1") for i in range(32)] for j in range(32)])
    got = spark.createDataFrame([(v.tolist(),)], "v array<double>").select(vectors.walsh(F.col("v"), 5)).first()[0]
    assert np.allclose(got, signs @ v)


def test_the_square_closes_for_all_pairs_of_edits(spark):
    edits = [(kind, a, b if kind == "set_edge" else None, w if kind == "set_edge" else None) for kind in ("add", "remove", "set_edge", "noop") for a, b, w in (("p", "q", 0.5), ("q", "p", 0.7), ("q", "r", 0.1), ("r", "s", 0.2))]
    rows = [((i + 1, "x", *e), (j + 1, "y", *f)) for i, e in enumerate(edits) for j, f in enumerate(edits)]
    df = spark.createDataFrame(rows, f"e {x.EDIT}, f {x.EDIT}")
    start = F.struct(F.array(*map(F.lit, "pqrs")).alias("nodes"), F.array(F.struct(F.lit("p").alias("a"), F.lit("q").alias("b"), F.lit(1.0).alias("w"))).alias("edges"))
    got = df.select("e", "f", x.commute(F.col("e"), F.col("f")).alias("c"), x.transformed(F.col("e"), F.col("f"))["kind"].alias("t"), x.converges(start, F.col("e"), F.col("f")).alias("ok")).collect()
    assert len(got) == len(rows) and all(r["ok"] for r in got)
    name = lambda e: e["kind"] + (e["path_a"] or "") + (e["path_b"] or "")
    by = {(name(r["e"]), name(r["f"])): r for r in got}
    assert by["set_edgepq", "removeq"]["t"] == "noop" and by["removeq", "set_edgepq"]["t"] == "remove"
    assert by["addp", "set_edgepq"]["c"] and not by["removep", "set_edgepq"]["c"]
    assert {by["set_edgepq", "set_edgeqp"]["t"], by["set_edgeqp", "set_edgepq"]["t"]} == {"set_edge", "noop"}


@pytest.mark.parametrize("seed", [1, 2])
def test_rebased_stream_has_the_state_of_the_whole_log(spark, tmp_path, seed):
    rng = random.Random(4)
    log = []
    for i in range(120):
        kind = rng.choices(["add", "set_edge", "remove"], [4, 8, 1])[0]
        a, b = rng.sample("abcdefghij", 2)
        log.append((rng.choice(["g", "h"]), i // 2, "pq"[i % 2], kind, a, b if kind == "set_edge" else None, rng.random() if kind == "set_edge" else None))
    random.Random(seed).shuffle(log)
    schema = "graph string, lamport long, peer string, kind string, path_a string, path_b string, weight double"
    for n in range(3):
        spark.createDataFrame(log[n * 40 : n * 40 + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = []
    try:
        stream = rebase.rebased(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 16)
        q = stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, n: rows.extend((n, *r) for r in df.collect())).start()
        q.awaitTermination(180)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    last = {}
    for _, graph, item, other, live, weight, _, _, _ in sorted(rows, key=lambda r: r[0]):
        last[graph, item, other] = (live, weight)
    for graph in "gh":
        mine = spark.createDataFrame([r[1:] for r in log if r[0] == graph], schema.replace("graph string, ", ""))
        nodes = {r[0] for r in editlog.live_nodes(mine).collect()}
        edges = {(r["a"], r["b"]): r["weight"] for r in editlog.live_edges(mine).collect()}
        assert {item for (g, item, other), (live, _) in last.items() if g == graph and other is None and live} == nodes
        assert {(item, other): w for (g, item, other), (live, w) in last.items() if g == graph and other is not None and live} == edges
        assert max(r[7] for r in rows if r[1] == graph) == sum(r[0] == graph for r in log)
    assert any(r[8] for r in rows)
