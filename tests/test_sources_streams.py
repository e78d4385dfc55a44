import json
import random

from pyspark.sql import functions as F

from weft.operators import editlog as e
from weft.sources import readers
from weft.streaming import ordered

RECORD = "\n".join(["{h}", "{h}", "{p}", "HEAD -> main, tag: v1", "feat: x", "A", "a@b.c", "2024-01-02T03:04:05+00:00"])


def test_commit_log(spark, tmp_path):
    text = "\x1e\n".join([RECORD.format(h="c2", p="c1 c0"), RECORD.format(h="c1", p=""), "broken"])
    (tmp_path / "log").write_text(text)
    rows = readers.commit_log(spark, str(tmp_path / "log")).collect()
    assert [(r["commit_hash"], r["parents"], r["is_merge"]) for r in rows] == [("c2", ["c1", "c0"], True), ("c1", [], False)]


def test_numstat_and_status(spark, tmp_path):
    (tmp_path / "n").write_text("c1\n3\t1\tsrc/{a => b}/x.py\n-\t-\timg.png\x1ec2\n1\t0\told => new\n")
    rows = {(r["commit_hash"], r["path"]): (r["additions"], r["binary"]) for r in readers.numstat(spark, str(tmp_path / "n")).collect()}
    assert rows == {("c1", "src/b/x.py"): (3, False), ("c1", "img.png"): (0, True), ("c2", "new"): (1, False)}
    (tmp_path / "s").write_text("# branch.head main\n1 .M N... 100644 100644 100644 aa bb src/a b.py\n? new.txt\n2 R. N... 100644 100644 100644 aa bb R100 new\told\n")
    assert [tuple(r) for r in readers.status(spark, str(tmp_path / "s")).collect()] == [(".M", "src/a b.py"), ("?", "new.txt"), ("R.", "new")]


def test_telemetry_drops_bad_lines(spark, tmp_path):
    (tmp_path / "t").write_text(json.dumps({"id": "1", "command": "x", "ok": True, "duration_ms": 5}) + "\n{broken\n")
    assert [(r["id"], r["duration_ms"]) for r in readers.telemetry(spark, str(tmp_path / "t")).collect()] == [("1", 5)]


def test_ancestors(spark):
    parents = spark.createDataFrame([("d", "c"), ("c", "b"), ("c", "a"), ("x", "y")], "child string, parent string")
    got = readers.ancestors(spark, parents, spark.createDataFrame([("d",)], "commit_hash string"))
    assert sorted(r[0] for r in got.collect()) == ["a", "b", "c", "d"]


def test_apply_in_order():
    revision, waiting, out = ordered.apply_in_order(0, {}, [(2, "b"), (1, "a"), (1, "a"), (5, "e"), (4, "d"), (3, "c")])
    assert revision == 5 and not waiting
    assert [s for s, _, o in out if o == "applied"] == [1, 2, 3, 4, 5] and sum(o == "dropped" for *_, o in out) == 1
    _, waiting, out = ordered.apply_in_order(0, {}, [(k, "") for k in range(10, 14)], ahead=3)
    assert sorted(waiting) == [11, 12, 13] and out == [(10, "", "evicted")]


def test_counters():
    assert ordered.decay(8.0, 60.0, 30.0) == 2.0
    assert ordered.evaporated(256, 64) == (128, 32) and ordered.evaporated(100, 5) == (100, 5)
    emitted, cited = ordered.evaporated(1024, 512)
    assert emitted == 512 and cited / emitted == 0.5


def test_windowed_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ordered.windowed(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in")), "ts", ["event_type"], "value")
    q = stream.writeStream.format("memory").queryName("weft_windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["event_type"], r["start"]): r["n"] for r in spark.table("weft_windows").collect()}
    want = {(r["event_type"], r["w"]["start"]): r["n"] for r in events.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).collect()}
    assert got == want


LOG = [(1, "p", "add", "a", None, None), (2, "p", "set_edge", "a", "b", 0.5), (3, "q", "set_edge", "b", "a", 0.7), (4, "p", "remove", "c", None, None), (5, "q", "add", "c", None, None), (5, "p", "set_edge", "c", "d", 0.9), (6, "p", "add", "e", None, None)]
COLUMNS = "lamport long, peer string, kind string, path_a string, path_b string, weight double"


def state(log):
    return sorted(r[0] for r in e.live_nodes(log).collect()), sorted(map(tuple, e.live_edges(log).collect()))


def test_edit_log_converges_and_compacts(spark):
    want = (["a", "b", "e"], [("a", "b", 0.7)])
    for seed in range(3):
        rows = LOG + LOG[:3]
        random.Random(seed).shuffle(rows)
        log = e.merged(spark.createDataFrame(rows, COLUMNS))
        assert state(log) == want
    short = e.compacted(log)
    assert short.count() == 3 and state(short) == want


def test_version_vectors(spark):
    log = spark.createDataFrame(LOG, COLUMNS)
    seen = spark.createDataFrame([("p", 4)], "peer string, lamport long")
    assert sorted((r["lamport"], r["peer"]) for r in e.delta(log, seen).collect()) == [(3, "q"), (5, "p"), (5, "q"), (6, "p")]
    full = e.version_vector(log)
    assert e.dominates(full, seen).first()[0] and not e.dominates(seen, full).first()[0]
    assert {tuple(r) for r in e.merged_vectors(full, seen).collect()} == {("p", 6), ("q", 5)}
