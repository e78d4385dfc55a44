"""Reviewers, words that hold subjects together, and files as rows, by hand."""

from weft.operators import activity as a
from weft.operators import reviewers as r
from weft.operators import text as x
from weft.sources import blobs as b


def test_reviewers(spark):
    rows = [("p", 1, "ann", 9.0), ("p", 1, "bob", 9.0), ("p", 2, "cy", 8.0), ("p", 3, "ann", 7.0), ("p", 4, "dee", 1.0), ("q", 5, "dee", 0.5), ("q", 6, "ann", 1.0), ("q", 7, "ann", 2.0), ("q", 8, "bob", 3.0),
            ("p", 1, "ann", 9.0), (None, 9, "ann", 1.0), ("z", 9, None, 1.0)]
    reviews = spark.createDataFrame(rows, "item string, txn long, actor string, weight double")
    assert {(c.actor, c.items, tuple(c.first)) for c in r.coverage(reviews, 1).collect()} == {("ann", 2, ("p",)), ("bob", 2, ("p",)), ("cy", 1, ("p",)), ("dee", 2, ("p",))}
    items = spark.createDataFrame([("p",), ("z",), ("y",), ("y",), (None,)], "item string")
    assert sorted(c.item for c in r.blind_spots(reviews, items).collect()) == ["y", "z"]
    groups = spark.createDataFrame([("p", "g"), ("q", "g"), ("q", "g")], "item string, group string")
    # dee is behind the fourth transaction of either item only
    assert [tuple(c) for c in r.departures(reviews, groups, least=2).collect()] == [("dee", "g", 2)]
    assert r.departures(reviews, groups, least=3).count() == 0
    assert r.coverage(reviews.limit(0)).count() == 0


def test_structural_words(spark):
    subjects = ["fix: Add the door to a house", "the window", "Open UI to the garden", "Shut UI", "aaaaa aa", "update src/main.py", "word", "same Same", None, "", "feat(x): paint the wall by UI"]
    df = spark.createDataFrame([(s,) for s in subjects], "s string")
    got = {w.word: (w.subjects, w.leading, w.shouted) for w in x.structural_words(df, "s").collect()}
    assert got == {"the": (4, 0.25, 0.0), "to": (2, 0.0, 0.0)}
    assert x.structural_words(df.limit(2), "s").count() == 0
    assert x.structural_words(df.limit(0), "s").count() == 0


def test_gaps_by_key(spark):
    days = spark.createDataFrame([("x", "2024-01-01"), ("x", "2024-01-02"), ("x", "2024-01-05"), ("x", "2024-01-09"), ("x", "2024-02-09"), ("y", "2024-01-03"), (None, "2024-01-01"), (None, "2024-01-04")], "k string, day string").selectExpr("k", "to_date(day) AS day")
    assert {(g.k, str(g.day), g.gap_days) for g in a.gaps(days, 2, "k").collect()} == {("x", "2024-01-05", 3), ("x", "2024-01-09", 4), (None, "2024-01-04", 3)}
    assert {(str(g.day), g.gap_days) for g in a.gaps(days.where("k = 'x'").drop("k"), 1).collect()} == {("2024-01-05", 3)}


def test_blobs(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, content in (("a/one.txt", "é\nx".encode()), ("two.bin", b"ab\x00cd"), ("bad.txt", b"ok \xff end"), ("empty", b""), ("large.txt", b"z" * 100), ("late", b"t" * 20 + b"\x00")):
        (tmp_path / name).write_bytes(content)
    wanted = spark.createDataFrame([("a/one.txt",), ("two.bin",), ("gone.txt",), ("large.txt",), ("bad.txt",), ("empty",), ("empty",)], "path string")
    loaded = b.blobs(spark, str(tmp_path), wanted, cap=50)
    assert {(f.path, f.state, f.length) for f in loaded.collect()} == {("a/one.txt", "loaded", 4), ("two.bin", "loaded", 5), ("gone.txt", "failed", None), ("large.txt", "too_large", 100), ("bad.txt", "loaded", 8), ("empty", "failed", None)}
    assert {tuple(f) for f in b.texts(loaded).collect()} == {("a/one.txt", "é\nx", 2), ("bad.txt", "ok � end", 1)}
    assert tuple(b.harvest(loaded).first()) == (6, 2, 1, 2, 1)
    assert b.blobs(spark, str(tmp_path)).count() == 5
