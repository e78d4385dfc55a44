"""Edge cases of listings, forge records, paths, contents and diffs, by hand."""

from pyspark.sql import functions as F

from weft.functions import contents, paths
from weft.operators import diffs as d
from weft.sources import forges, listings


def lines(spark, *values):
    return spark.createDataFrame([(x,) for x in values], "value string")


def numbered(spark, text):
    return spark.createDataFrame([("k", i, x) for i, x in enumerate(text.split("\n"))], "key string, line_no int, text string")


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_short_and_blank_lines(spark):
    odd = lines(spark, None, "", "  ", "main", "gone\t*\t\t[gone", "x\t \tup\t[ahead 2]\tnever")
    assert got(listings.branches(odd)) == [("gone", True, None, 0, 0, False, None), ("main", False, None, 0, 0, False, None), ("x", False, "up", 2, 0, False, None)]
    assert got(listings.tags(lines(spark, None, "v1", "v2\ttag\tabc"))) == [("v1", "lightweight", None, None, None, None), ("v2", "tag", "abc", None, None, None)]
    assert listings.reflog(odd).count() == 0 and listings.stashes(odd).count() == 0
    assert got(listings.tree_sizes(lines(spark, None, "\tx", "1 b h 5\ta\\b\tc", "1 c h -\tsub", "5\tx"))) == [("a/b\tc", 5)]
    assert got(listings.shortlog(lines(spark, " 3\tA B ", "x 3", None, "3"))) == [("A B", 3)]


def test_blame_carries_headers(spark):
    a, b = "a" * 40, "b" * 40
    text = f"\tlost\n{a} 1 1 2\nauthor X\nauthor-time 7\n\tone\n{a} 2 2\n\tauthor Y\n{b} 1 3\n\t\n{a} 9 4\n\tlast"
    rows = got(listings.blame(numbered(spark, text)).select("line_number", "commit_hash", "author_name", "authored_at", "content"))
    assert rows == [(1, a, "X", "7", "one"), (2, a, "X", "7", "author Y"), (3, b, "", "", ""), (4, a, "X", "7", "last")]


def test_worktrees(spark):
    text = "\nHEAD 0\n\nworktree /a b\nHEAD 1\nbranch refs/heads/x/y\n\nworktree /c\ndetached\nlocked"
    assert got(listings.worktrees(numbered(spark, text))) == [("k", "/a b", "1", "x/y", True, False, False), ("k", "/c", "", None, False, True, True)]


def test_forges_drop_malformed(spark):
    rows = lines(spark, None, "", "{", '{"title": "x"}', '{"iid": 3, "state": "opened", "labels": null}').withColumn("number", F.lit(9))
    row = forges.gitlab(rows).collect()
    assert [(r.number, r.state, r.title, r.draft, r.author, r.comments, r.updated_at, r.labels) for r in row] == [(3, "OPEN", "", False, "", 0, None, [])]
    assert [r.comments for r in forges.github(lines(spark, '{"number": 1}', '{"number": 2, "comments": []}')).collect()] == [0, 0]


def test_paths_and_contents(spark):
    p = spark.createDataFrame([("Cargo.lock",), ("lockfile",), ("gen/x",), ("a/gen/x",), (None,), ("",)], "p string")
    assert [r[0] for r in p.select(paths.ritual_path(F.col("p"))).collect()] == [True, False, False, True, None, False]
    texts = spark.createDataFrame([('path="" file = " a.c " v1/2.3 www.x/y.z http/a.b',), (None,)], "t string")
    assert [r[0] for r in texts.select(paths.cited_paths(F.col("t"))).collect()] == [["a.c", "v1/2.3"], None]
    raw = spark.createDataFrame([(b"",), (None,), (b"RIFF0000????",), (b"BM",), (b"\x00\x01\x00\x00",), (b"x" * 4096 + b"\x00",)], "c binary")
    assert [tuple(r) for r in raw.select(contents.content_class(F.col("c"))["format"], contents.looks_binary(F.col("c"))).collect()] == [("Unknown", False), ("Unknown", None), ("Unknown", False), ("BMP", False), ("TTF", True), ("Unknown", False)]


def test_diffs(spark):
    diff = 'note\ndiff --git a/x b/x\n+one\ndiff --git a/y b/y z\n\ndiff --git a/x b/x\n+two\n diff --git a/no b/no\ndiff --git "a/q \\\\" "b/q \\\\"\ndiff --git odd\n+end\n'
    df = spark.createDataFrame([(1, diff), (2, ""), (3, None)], "id int, diff string")
    sections = {r.path: r.text for r in d.diff_sections(df, "id", "diff").collect()}
    assert sections == {"x": "diff --git a/x b/x\n+two\n diff --git a/no b/no", "y z": "diff --git a/y b/y z\n", "q \\\\": 'diff --git "a/q \\\\" "b/q \\\\"'}
    assert [sorted(r[0] or []) for r in df.select(d.diff_paths(F.col("diff"))).collect()] == [["q \\\\", "x", "y z"], [], []]
    symbols = spark.createDataFrame([("+aaa bbbb aa\n ccccc\n-aaa zzz 9abc",), (None,), ("",)], "t string").select(d.diff_symbols(F.col("t"), skip=("zzz",)), d.diff_symbols(F.col("t"), 1))
    assert [tuple(r) for r in symbols.collect()] == [(["bbbb", "aaa"], ["bbbb"]), (None, None), ([], [])]


def test_subject_verbs(spark):
    subjects = ["fix(auth): Tighten x", "  !! add y", "x: 12 z", "a b", "deadbeef fix", "deadbeefz fix", "", None, "decade"]
    rows = spark.createDataFrame([(s,) for s in subjects], "s string").select(d.subject_verb(F.col("s"))).collect()
    assert [r[0] for r in rows] == ["tighten", "add", None, None, None, None, None, None, "decade"]


def test_prefix_label(spark):
    rows = [("one", "a/b/c"), ("top", "a/c"), ("two", "a/b/c"), ("two", "a\\b\\d/e"), ("flat", "a/x"), ("flat", "a/y"), ("same", "a/b"), ("same", "a/b"), ("none", ""), ("none", None)]
    out = dict(map(tuple, d.prefix_label(spark.createDataFrame(rows, "g string, p string"), "g", "p").collect()))
    assert out == {"one": "b", "top": None, "two": "b", "flat": None, "same": "b"}
