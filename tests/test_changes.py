"""Diffs, edit units, fuzzy moves, hunk graphs and the cache against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weft.operators import edits as e
from weft.operators import hunks as h
from weft.sources.cache import ContentCache


def lines(spark, texts):
    return spark.createDataFrame([(d, i, x) for d, t in texts.items() for i, x in enumerate(t)], "doc long, line long, text string")


@pytest.fixture(scope="module")
def texts():
    rng, old, new = random.Random(5), {}, {}
    for d in range(14):
        a = [rng.choice("abcdefghijklmnopqrstuvwxyz{}") for _ in range(rng.randrange(0, 18))]
        b = [x for x in a if rng.random() < 0.8]
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("xyz{}"))
        if d % 3 == 0 and len(b) > 3:
            b = b[2:] + b[:2]
        old[d], new[d] = a, b
    return old, new


def test_a_diff_gives_both_texts_back(spark, texts):
    old, new = texts
    rows = {}
    for r in e.line_diff(lines(spark, old), lines(spark, new)).orderBy("doc", "pos").collect():
        rows.setdefault(r["doc"], []).append(r)
    for d in old:
        mine = rows.get(d, [])
        assert [r["pos"] for r in mine] == list(range(1, len(mine) + 1))
        assert [r["text"] for r in mine if r["kind"] != "add"] == old[d]
        assert [r["text"] for r in mine if r["kind"] != "del"] == new[d]
        assert [r["old_no"] for r in mine if r["kind"] != "add"] == list(range(len(old[d])))
        assert [r["new_no"] for r in mine if r["kind"] != "del"] == list(range(len(new[d])))
    kept = {(r["doc"], r["i"], r["j"]) for r in e.anchors(lines(spark, old), lines(spark, new)).collect()}
    context = {(d, r["old_no"], r["new_no"]) for d, mine in rows.items() for r in mine if r["kind"] == "context"}
    assert kept <= context and kept


def test_edit_units(spark):
    kinds = "context del del add add del context add del add".split()
    rows = [(1, i, k, None if k == "context" else sum(x == "context" for x in kinds[:i]), f"t{i}") for i, k in enumerate(kinds)]
    df = spark.createDataFrame(rows, "doc long, pos long, kind string, hunk long, text string")
    got = [(r["kind"], r["old_text"], r["new_text"]) for r in e.edit_units(df, ["doc"]).orderBy("unit").collect()]
    assert got == [("context", "t0", "t0"), ("delete", "t1", None), ("replace", "t2", "t3"), ("insert", None, "t4"), ("delete", "t5", None), ("context", "t6", "t6"), ("insert", None, "t7"), ("replace", "t8", "t9")]
    assert sorted((r["deleted"], r["added"]) for r in e.replacement_pairs(df, ["doc"]).collect()) == [(2, 3), (8, 9)]


def test_fuzzy_moves_are_the_greedy_ones(spark):
    rng = random.Random(3)
    rows, want = [], []
    for doc in range(6):
        base = [rng.getrandbits(63) for _ in range(3)]
        units = []
        for u in range(24):
            value = rng.choice(base)
            for _ in range(rng.randrange(6)):
                value ^= 1 << rng.randrange(63)
            units.append((u + 1, rng.choice(["delete", "insert"]), rng.choice([value, value, value, 0])))
        rows += [(doc, *u) for u in units]
        taken = set()
        for u, kind, x in units:
            if kind != "delete" or x == 0:
                continue
            near = [(bin(x ^ y).count("1"), v) for v, k, y in units if k == "insert" and y and v not in taken and abs(u - v) > 1 and bin(x ^ y).count("1") <= e.NEAR]
            if near:
                distance, v = min(near)
                taken.add(v)
                want.append((doc, u, v, distance))
    got = sorted(tuple(r) for r in e.fuzzy_moves(spark.createDataFrame(rows, "doc long, unit long, kind string, hash long"), ["doc"]).collect())
    assert got == sorted(want) and len(got) > 20


def test_many_equal_lines_move_in_one_pass(spark):
    rows = [(1, u, "delete" if u <= 40 else "insert", 77) for u in range(1, 81)]
    found = e.fuzzy_moves(spark.createDataFrame(rows, "doc long, unit long, kind string, hash long"), ["doc"])
    assert sorted((r["from_unit"], r["to_unit"]) for r in found.collect()) == [(u, 40 + u) for u in range(1, 41)]
    assert not found.inputFiles()  # no table of a round


def test_a_moved_line_with_a_bit_changed_in_every_byte(spark):
    rows = [(1, 1, "delete", 0x0123456789ABCDEF), (1, 9, "insert", 0x0123456789ABCDEF ^ 0x0101010101010101)]
    got = e.fuzzy_moves(spark.createDataFrame(rows, "doc long, unit long, kind string, hash long"), ["doc"]).collect()
    assert [tuple(r) for r in got] == [(1, 1, 9, 8)]


def test_a_diff_shuffles_lines_once(spark, texts):
    old, new = (lines(spark, x) for x in texts)
    plan = e.edit_units(e.hunks_of(e.line_diff(old, new)), ["doc"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_hunk_graph_is_that_of_all_pairs(spark):
    rng = random.Random(7)
    hunks = [(i, f"f{i % 3}", rng.randrange(0, 300), rng.randrange(1, 40) + rng.random(), rng.random() * 9) for i in range(60)]
    tokens = [(i, t) for i in range(60) for t in rng.sample("abcdefghijklmnop", rng.randrange(4))]
    k = 5
    named = {i: {t for x, t in tokens if x == i} for i in range(60)}
    sigma = {}
    for f in "012":
        starts = sorted(x[2] for x in hunks if x[1] == f"f{f}")
        gaps = sorted(b - a for a, b in zip(starts, starts[1:], strict=False) if b > a)
        sigma[f"f{f}"] = float(gaps[len(gaps) // 2]) if gaps else 1.0
    w = {}
    for i, fi, si, ai, di in hunks:
        for j, fj, sj, aj, dj in hunks:
            if i < j:
                union = named[i] | named[j]
                x = h.NAMES * len(named[i] & named[j]) / len(union) if union else 0
                if fi == fj:
                    d = abs(si - sj)
                    x += h.FILE + h.BALANCE * (1 - abs((ai - di) / (ai + di + 1) - (aj - dj) / (aj + dj + 1)) / 2)
                    x += h.NEAR * math.exp(-d / sigma[fi]) if d < sigma[fi] * h.HORIZON else 0
                if x > 0:
                    w[i, j] = x
    want = set()
    for i in range(60):
        mine = sorted((-round(x, 9), b if a == i else a, (a, b)) for (a, b), x in w.items() if i in (a, b))
        want |= {p for _, _, p in mine[:k]}
    got = {(r["a"], r["b"]): r["w"] for r in h.hunk_graph(spark.createDataFrame(hunks, "hunk long, file string, start long, additions double, deletions double"), spark.createDataFrame(tokens, "hunk long, token string"), k).collect()}
    assert set(got) == want
    assert all(got[p] == pytest.approx(w[p]) for p in want)


def test_cache_computes_what_changed_only(spark, tmp_path):
    cache = ContentCache(spark, f"file://{tmp_path}/cache")
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    seen = []

    def compute(new):
        seen.append(sorted(r["text"] or "" for r in new.collect()))
        return new.select("fingerprint", F.upper("text").alias("up"))

    read = lambda: sorted((r["key"], r["up"]) for r in cache.rows().collect())
    with pytest.raises(ValueError):
        cache.rows()
    assert cache.refresh(frame([(1, "a"), (2, "b"), (3, "a"), (4, None)]), "id", ["text"], compute) == 3
    assert read() == [(1, "A"), (2, "B"), (3, "A"), (4, None)]
    assert cache.refresh(frame([(1, "a"), (2, "c"), (5, "b")]), "id", ["text"], compute) == 1
    assert read() == [(1, "A"), (2, "C"), (5, "B")] and seen[1] == ["c"]
    assert cache.refresh(frame([(1, "a"), (2, "c"), (5, "b")]), "id", ["text"], compute) == 0
    cache.prune()
    assert read() == [(1, "A"), (2, "C"), (5, "B")]
    assert cache.refresh(frame([(4, None)]), "id", ["text"], compute) == 1 and read() == [(4, None)]
