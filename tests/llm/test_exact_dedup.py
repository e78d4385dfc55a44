"""Operator 12 against plain Python, and the index across sessions' handles, batches and repeats."""

import hashlib
import re

import duckdb
import pytest

from weft.llm import exact_dedup
from weft.llm.common import new_folder
from weft.llm.queries import ORACLES, QUERIES


def sha(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(sha(t), []).append(i)
    out = []
    for h, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), k == 0, h) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


@pytest.mark.parametrize("batches", [1, 3])
def test_equal_to_plain_python(docs, corpus, batches):
    assert found(exact_dedup.deduplicated(docs, batches)) == expected(corpus)


def test_odd_rows(spark):
    rows = [(None, "a"), (3, "a"), (3, "a"), (None, None), (None, ""), (5, " \n\t"), (4, " "), (9, " a"), (8, "x" * 2_000_000), (7, "x" * 2_000_000)]
    assert found(exact_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows)


def test_empty(empty):
    assert found(exact_dedup.deduplicated(empty)) == []


def test_hot_group(spark):
    hot = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same  text', concat('t', id)) as text", "1 as digest", "2 as batch")
    rows = [(r.doc_id, r.text) for r in hot.select("doc_id", "text").collect()]
    assert found(exact_dedup.deduplicated(hot)) == expected(rows)


def test_an_index_is_opened_again(spark):
    path = new_folder(spark, "index")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    old, new = exact_dedup.digests(frame([(10, "a"), (11, "b"), (12, "a")])), exact_dedup.digests(frame([(1, "a"), (2, "c"), (3, "c")]))
    first = exact_dedup.DigestIndex(spark, path, 3)
    first.add(old, "monday")
    first.close()
    index = exact_dedup.DigestIndex(spark, path)
    assert index.buckets == 3
    assert index.unknown(new.groupBy("digest").count()).count() == 1
    for _ in range(2):  # a batch that is added again changes nothing
        index.add(new, "tuesday")
        got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in index.decide(new, "tuesday").collect())
        assert got == [(1, 10, 3, False), (2, 2, 2, True), (3, 2, 2, False)]
        assert sorted((r.keep_id, r.n) for r in index.groups().collect()) == [(2, 2), (10, 3), (11, 1)]


def test_the_index_is_not_shuffled(spark, docs):
    index = exact_dedup.DigestIndex(spark, new_folder(spark, "index"), 5)
    hashed = exact_dedup.digests(docs)
    index.add(hashed, "a")
    plan = index.unknown(hashed)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and plan.count("Exchange hashpartitioning") == 1
    assert "Exchange" not in index.groups()._jdf.queryExecution().executedPlan().toString()


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(map(tuple, con.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({ORACLES['op12_digest_index']})").fetchall()), key=str)
    assert found(QUERIES["op12_digest_index"](spark, sf)) == want
