from __future__ import annotations

from ledgerloom.streaming import queue

STATE = "key string, content string, signature string, attempts int, done boolean"


def test_only_changed_items_are_pending(spark):
    items = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "key string, content string")
    state = spark.createDataFrame([("a", "1", "v1", 1, True), ("b", "1", "v1", 1, True), ("c", "3", "v1", 3, False)], STATE)
    assert [r["key"] for r in queue.pending(items, state, "v1", 10).collect()] == ["d", "b", "c"]
    assert {r["key"] for r in queue.pending(items, state, "v2").collect()} == {"a", "b", "c", "d"}
    done = queue.pending(items, state, "v1").select("key", "content").selectExpr("key", "content", "true AS done")
    after = queue.merged(state, done, "v1")
    assert queue.pending(items, after, "v1").count() == 0 and after.count() == 4


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a", "1"), ("b", "2")], "key string, content string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("key string, content string").parquet(str(tmp_path / "in"))
    q = queue.follow(source, lambda df: df.selectExpr("key", "length(content) AS n"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
