"""Operator 11 against plain loops over Python integers."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import hard_negatives
from weft.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, row long, score double"


def brute(rows, every, positives=5, negatives=3):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in e], (l + 1) % 10 if i % 7 == 0 else l) for i, e, l in rows if i is not None and e is not None and l is not None and all(x is not None and math.isfinite(x) for x in e)]
    dot = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False))))
    out = []
    for i, e, l in kept:
        if i % every:
            continue
        scored = sorted((-dot(e, f), j, m) for j, f, m in kept)
        for p, j, _ in [x for x in scored if x[2] == l and x[1] != i][:positives]:
            window = [(s, n) for s, n, m in scored if m != l and 50 * -p <= 100 * -s <= 95 * -p][:negatives]
            out += [(i, j, k + 1, n, -p, -s) for k, (s, n) in enumerate(window)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, e, l, 7, 1.0) for i, e, l in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    made = [(i, [rng.uniform(-1, 1) + (i % 3 == 0) for _ in range(6)], rng.randrange(4)) for i in range(400)]
    made += [(500 + i, [0.5, 0.25, 0.5, 0.5, 0.5, 0.5], i % 2) for i in range(40)]  # ties
    made += [(600, None, 1), (601, [0.1, None, 0.2, 0.1, 0.1, 0.1], 1), (602, [float("nan")] * 6, 1), (603, [float("inf")] * 6, 2), (604, [0.9] * 6, None), (None, [0.9] * 6, 1)]
    made += [(605, [0.5, 0.5], 1), (606, [], 1), (607, [0.5] * 9, 2), (650, [0.5] * 6, 9)]
    return made


@pytest.mark.parametrize("block_bytes", [600, 32 << 20])
def test_equal_to_loops_in_one_block_and_many(spark, rows, block_bytes):
    got = found(hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 50 == 0, block_bytes=block_bytes))
    assert got and got == brute(rows, 50)


def test_repeated_rows_are_rows_of_their_own(spark, rows):
    twice = rows[:60] + rows[40:60] + rows[50:51]
    assert found(hard_negatives.mine(frame(spark, twice), F.col("vec_id") % 10 == 0)) == brute(twice, 10)


def test_scores_beyond_doubles_are_exact(spark):
    big = [(i, [float(2**20 + i), float(2**13), float(i % 5)], i % 3) for i in range(40)] + [(50 + i, [3e38, 1e30], i % 3) for i in range(4)]
    assert found(hard_negatives.mine(frame(spark, big), F.col("vec_id") % 5 == 0)) == brute(big, 5)


def test_no_rows_and_no_anchors(spark, rows):
    assert found(hard_negatives.mine(frame(spark, []), F.col("vec_id") % 50 == 0)) == []
    assert found(hard_negatives.mine(frame(spark, rows[1:40]), F.col("vec_id") % 50 == 0)) == []
    assert found(hard_negatives.mine(frame(spark, rows[:1]), F.col("vec_id") % 50 == 0)) == []


def test_blocks_are_bounded(spark, rows):
    dealt, n = hard_negatives.anchor_blocks(hard_negatives.usable(frame(spark, rows)), 2000)
    sizes = dealt.groupBy("block").agg(F.sum(32 + 8 * F.size("embedding")).alias("b")).collect()
    assert n > 10 and max(r.b for r in sizes) <= 2000


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.execute(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({ORACLES['op11_blocked_gemm']})").fetchall())
    got = found(QUERIES["op11_blocked_gemm"](spark, sf))
    assert got and got == want
