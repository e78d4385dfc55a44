"""Conflict blocks by hand."""

from weft.operators import conflicts as k


def test_blocks(spark):
    texts = {
        "a": "x\n<<<<<<< us\no1\no2\n||||||| b\nb1\n=======\nt1\n=======\n>>>>>>> them\ny\n<<<<<<<\n=======\n>>>>>>>",
        "b": "<<<<<<< lost\no\n<<<<<<< us\no\n>>>>>>> no\n=======\nt\n|||||||\n>>>>>>> e",
        "c": "=======\n>>>>>>>\nplain",
        "d": "<<<<<<<\nq\n=======\nr",
        "e": "",
    }
    rows = [(key, n, x) for key, text in texts.items() for n, x in enumerate(text.split("\n"))] + [("f", 0, None)]
    tagged = k.conflict_lines(spark.createDataFrame(rows, "key string, line_no long, text string"))
    got = sorted(map(tuple, k.conflict_blocks(tagged).collect()))
    assert got == [("a", 0, "o1\no2", "b1", "t1\n======="), ("a", 1, "", None, ""), ("b", 0, "o\n>>>>>>> no", None, "t\n|||||||")]
    sides = {(x.key, x.line_no): x.side for x in tagged.collect()}
    assert sides["b", 0] == sides["d", 3] == "open" and sides["c", 0] == sides["a", 10] == sides["f", 0] == "clean"
    choices = spark.createDataFrame([("a", 0, "both"), ("b", 0, "theirs")], "key string, block long, take string")
    kept = {}
    for x in sorted(k.resolved(tagged, choices).collect(), key=lambda x: (x.key, x.line_no)):
        kept.setdefault(x.key, []).append(x.text)
    assert kept["a"] == ["x", "o1", "o2", "t1", "=======", "y", "<<<<<<<", "=======", ">>>>>>>"]
    assert kept["b"] == ["<<<<<<< lost", "o", "t", "|||||||"] and kept["f"] == [None]
