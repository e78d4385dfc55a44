from pyspark.sql import functions as F

from weft.functions import strings as st
from weft.operators import activity, coupling, series, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_identifiers(spark):
    assert one(spark, st.split_identifier(F.lit("parseHTTPResponse2xx_ok"))) == ["parse", "http", "response", "2", "xx", "ok"]
    assert one(spark, st.path_tokens(F.lit("src/Lib/a/lib_x1.py"))) == ["src", "lib", "x1", "py"]
    assert one(spark, st.slug(F.lit("  Fix: the Thing!  "), 10)) == "fix-the-th"
    assert tuple(one(spark, st.subject_parts(F.lit("feat(ui): add x")))) == ("feat", "ui", "add x")
    assert tuple(one(spark, st.subject_parts(F.lit("plain words")))) == ("", "", "plain words")
    assert one(spark, st.without_trailers(F.lit("Body\n\nSigned-off-by: A\nCc: B"))) == "Body"


def test_natural_and_version_order(spark):
    names = spark.createDataFrame([("a10",), ("a2",), ("A1",)], "n string")
    assert [r["n"] for r in names.orderBy(st.natural_key(F.col("n"))).collect()] == ["A1", "a2", "a10"]
    versions = spark.createDataFrame([("1.10.0",), ("1.2.0",), ("1.2.0-rc.2",), ("1.2.0-rc.10",)], "v string")
    assert [r["v"] for r in versions.orderBy(st.version_key(F.col("v"))).collect()] == ["1.2.0-rc.2", "1.2.0-rc.10", "1.2.0", "1.10.0"]


def test_diff_parser(spark):
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -3,3 +3,4 @@ f\n ctx\n-old\n+new\n+more\n end"
    parsed = text.parse_diff(spark.createDataFrame([("d", diff)], "diff_id string, text string"))
    got = [(r["kind"], r["old_no"], r["new_no"]) for r in parsed.orderBy("line_no").collect()]
    assert got[3:] == [("hunk", None, None), ("context", 3, 3), ("del", 4, None), ("add", None, 4), ("add", None, 5), ("context", 5, 6)]
    counts = text.diff_counts(parsed).first()
    assert (counts["adds"], counts["dels"], counts["hunks"], counts["files"]) == (2, 1, 1, 1)
    assert [(r["path"], r["low"], r["high"]) for r in text.touched_ranges(parsed).collect()] == [("x", 4, 5)]


def test_moves_are_blocks(spark):
    removed = spark.createDataFrame([(1, i, f"l{i}") for i in range(5)], "doc int, line int, hash string")
    added = spark.createDataFrame([(1, i + 10, f"l{i}") for i in range(1, 4)], "doc int, line int, hash string")
    assert [tuple(r) for r in text.moves(removed, added).collect()] == [(1, 1, 11, 3)]


def test_coherence_and_confidence(spark):
    edges = spark.createDataFrame([(1, 2, 0.5)], "a int, b int, score double")
    sets = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), ("y", 9)], "set_id string, item int")
    got = {r["set_id"]: r["coherence"] for r in coupling.coherence(edges, sets).collect()}
    assert got["y"] == 1.0 and abs(got["x"] - 0.5 / 3) < 1e-12
    assert coupling.coupling_confidence(10, 1000) == 10 / 400


def test_peak_and_half_life(spark):
    rows = [("s", float(t), y) for t, y in enumerate([1.0, 8.0, 6.0, 2.0, 1.0])]
    df = spark.createDataFrame(rows, "series string, t double, y double")
    assert series.peak(df).first()["peak_t"] == 1.0
    assert series.half_life(df).first()["half_t"] == 2.5


def test_retention_budget(spark):
    rows = [(i, f"2024-01-{i:02d} 00:00:00", 10) for i in range(1, 11)]
    df = spark.createDataFrame(rows, "id int, at string, size int").withColumn("at", F.col("at").cast("timestamp"))
    kept = activity.retained(df, "at", "size", F.lit("2024-01-10").cast("timestamp"), 5, 35)
    assert sorted(r["id"] for r in kept.collect()) == [8, 9, 10]


def test_empty_inputs(spark):
    items = coupling.transaction_items(spark.createDataFrame([], "o long, p long"), "o", "p")
    edges = coupling.jaccard_edges(items)
    assert edges.count() == 0 and coupling.keystones(edges, items.groupBy("item").agg(F.count("*").alias("touches"))).count() == 0


def test_large_transactions_pair_fully_in_any_blocks(spark):
    """A transaction of 130 items has all its pairs, and its weight fades; nothing is cut."""
    from weft.operators import coupling as c

    rows = [(1, i) for i in range(130)] + [(2, 5), (2, 6), (3, 7)]
    items = c.transaction_items(spark.createDataFrame(rows, "txn long, item long"), "txn", "item")
    want = {(a, b) for a in range(130) for b in range(a + 1, 130)}
    for block in (7, 50, 1000):
        got = [(r["a"], r["b"]) for r in c.pairs(items, block).where("txn = 1").collect()]
        assert len(got) == len(want) and set(got) == want
    scores = {(r["a"], r["b"]): r["score"] for r in c.jaccard_edges(items).collect()}
    assert len(scores) == len(want) and scores[5, 6] == 1.0 and scores[5, 8] == 0.5
    ranks = spark.createDataFrame([(1, 0, 0, 1.0), (2, 1, 1, 1.0), (3, 2, 2, 1.0)], "txn long, rank long, age long, meaning double")
    lagged = {(r["a"], r["b"]): r["lag_score"] for r in c.lagged_edges(items, ranks, 10.0).collect()}
    assert abs(lagged[0, 5] - 60 / 130 * (2**-0.1) ** 0.5 / 2) < 1e-9


def test_similar_token_sets_are_all_found(spark):
    import itertools
    import math
    import random

    from weft.operators import text as x

    rng = random.Random(3)
    sets = [frozenset(rng.sample("abcdefghijklmnop", rng.randint(3, 9))) for _ in range(60)]
    sets += sets[:10]
    tokens = spark.createDataFrame([(i, t) for i, s in enumerate(sets) for t in s], "doc long, token string")
    freq = x.document_frequency(tokens, len(sets))
    idf = {t: math.log(1 + len(sets) / (1 + sum(t in s for s in sets))) for t in "abcdefghijklmnop"}
    first = {s: i for i, s in reversed(list(enumerate(sets)))}
    w = lambda s: sum(idf[t] for t in s)
    for least in (0.3, 0.6):
        want = {tuple(sorted((first[a], first[b]))) for a, b in itertools.combinations(first, 2) if w(a & b) / w(a | b) >= least}
        assert {(r["a"], r["b"]) for r in x.idf_jaccard(tokens, freq, least).collect()} == want and want
    assert {(r["doc"], r["cls"]) for r in x.token_classes(tokens).collect()} == {(i, first[s]) for i, s in enumerate(sets)}


def test_vectors_in_blocks(spark, monkeypatch):
    from weft.operators import vectors as v

    e = spark.createDataFrame([(i, i % 4, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id long, label long, embedding array<double>")
    whole = sorted(map(tuple, v.nearest_rows(e, "vec_id", "embedding", e, 3).collect()))
    c = v.centroids(e, "label", "embedding")
    near = sorted(map(tuple, v.nearest_centroid(e, "vec_id", "embedding", c).collect()))
    monkeypatch.setattr(v, "SENT", 2)
    assert sorted(map(tuple, v.nearest_centroid(e, "vec_id", "embedding", c).collect())) == near
    monkeypatch.setattr(v, "SENT", 15)
    assert sorted(map(tuple, v.nearest_rows(e, "vec_id", "embedding", e, 3).collect())) == whole


def test_searches(spark):
    from weft.operators import search as s

    rows = spark.createDataFrame([("c", 1, "x aa"), ("c", 2, "aa aaa"), ("c", 3, None), ("d", 1, "b")], "series string, at int, text string")
    got = {(r["series"], r["at"]): (r["before"], r["after"]) for r in s.by_contents(rows, "series", "at", "text", "aa").collect()}
    assert got == {("c", 1): (0, 1), ("c", 2): (1, 2), ("c", 3): (2, 0)}
    assert s.by_message(rows, "text", "X A").count() == 1 and s.by_message(rows, "text", "^a+ ", regex=True).count() == 1
