"""Fields and line bitmaps against plain Python, by hand."""

import math

import xxhash
from pyspark.sql import functions as F

from weft.functions import strings as s
from weft.operators import fields as f


def test_compare_fields(spark):
    rows = [("a", 1, 3.0), ("a", 2, 4.0), ("b", 2, 1.0), ("b", 3, -1.0), ("z", 1, 0.0)]
    pairs = [("a", "b"), ("a", "b"), ("a", "z"), ("a", "missing"), ("missing", "gone"), (None, "a")]
    out = {(r.a, r.b): (round(r.cosine, 9), r.overlap) for r in f.compare_fields(spark.createDataFrame(rows, "key string, node int, value double"), spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert out == {("a", "b"): (round(4 / (5 * math.sqrt(2)), 9), 2.0), ("a", "z"): (0.0, 0.0), ("a", "missing"): (0.0, 0.0), (None, "a"): (0.0, 0.0)}


def test_coherence(spark):
    rows = [("g", 1, 0, 2.0), ("g", 2, 0, 5.0), ("g", 3, 1, 1.0), ("g", 4, 1, 0.0), ("one", 1, 0, 1.0), ("none", 1, 0, 0.0)]
    out = {r.grp: (r.fields, round(r.coherence, 9)) for r in f.coherence(spark.createDataFrame(rows, "grp string, key int, node int, value double")).collect()}
    assert out == {"g": (3, round(1 / 3, 9)), "one": (1, 1.0), "none": (0, 1.0)}


def test_levels_are_adjoint(spark):
    members = spark.createDataFrame([(1, "x", 0.5), (2, "x", 2.0), (2, "y", 1.0), (3, "y", 1.0)], "fine int, coarse string, w double")
    up = f.restrict(members, spark.createDataFrame([(1, 4.0), (2, 1.0)], "fine int, value double"))
    assert dict(map(tuple, up.collect())) == {"x": 4.0, "y": 1.0}
    assert dict(map(tuple, f.prolongate(members, up).collect())) == {1: 2.0, 2: 9.0, 3: 1.0}


def test_turning(spark):
    rows = [("s", k, v) for k, v in enumerate([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0, 9.0], [1.0, 1.0], [1.0, 0.0], [1.0, 1.0]])]
    out = [r.cosine for r in f.turning(spark.createDataFrame(rows, "series string, step int, spectrum array<double>")).orderBy("step").collect()]
    assert out == [0.0, None, None, -1.0]


def test_consensus_rounds_up(spark):
    asked = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "c"), ("q", "a")], "query string, item string")
    samples = spark.createDataFrame([("q", 1, "a"), ("q", 2, "a"), ("q", 1, "b"), ("q", 1, "b"), ("p", 1, "c")], "query string, sample int, item string")
    assert list(map(tuple, f.consensus(asked, samples, 3).collect())) == [("q", 3, 1 / 3)]


def test_line_bitmaps(spark):
    texts = ["", "a", "ab", "abc", "a?\x7fé", "the quick brown fox " * 3, None]

    def simhash(x):
        h = [xxhash.xxh64(x[i : i + 3].encode(), seed=42).intdigest() for i in range(len(x) - 2)]
        out = sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in h) > len(h))
        return out - (1 << 64) if out >> 63 else out

    def bitmap(bits):
        out = sum(1 << k for k in set(bits))
        return out - (1 << 64) if out >> 63 else out

    df = spark.createDataFrame([(x,) for x in texts], "t string").select(s.char_bits(F.col("t")), s.bigram_bits(F.col("t")), s.trigram_simhash(F.col("t")))
    want = [None if x is None else (bitmap(ord(c) & 63 for c in x), bitmap((ord(a) & 63) * 37 + (ord(b) & 63) & 63 for a, b in zip(x, x[1:])), simhash(x)) for x in texts]
    assert [None if r[0] is None else tuple(r) for r in df.collect()] == want


def test_trigram_fingerprints_of_any_length(spark):
    import random

    from pyspark.sql import functions as F

    from weft.functions import strings as s

    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefgh .", k=n)) for n in (2, 3, 4, 17, 80, 129, 130, 400)] + ["a" * 129, "a" * 130, "ab" * 16400]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    grams = df.where(F.length("t") >= 3).select("i", "t", F.explode(F.sequence(F.lit(1), F.length("t") - 2)).alias("at")).select("i", F.xxhash64(F.substring("t", F.col("at"), F.lit(3))).alias("h"))
    of = {}
    for r in grams.collect():
        of.setdefault(r["i"], []).append(r["h"] & (1 << 64) - 1)
    got = df.select("i", s.trigram_simhash(F.col("t")).alias("f"))
    for r in got.collect():
        hashes = of.get(r["i"], [])
        assert r["f"] & (1 << 64) - 1 == sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
    assert "72340172838076673" in got._jdf.queryExecution().optimizedPlan().toString()  # lanes of eight bits
