"""Readers, writers, snapshots and the stream."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from newsloom.sources import tables
from newsloom.streaming import worker


def test_cache_is_filled_once(spark, tmp_path):
    src, cache = str(tmp_path / "src"), str(tmp_path / "cache")
    spark.range(5).write.parquet(src)
    assert tables.read_dataset(spark, src, cache).count() == 5
    spark.range(9).write.mode("overwrite").parquet(src)
    assert tables.read_dataset(spark, src, cache).count() == 5


def test_object_and_line_files(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for i in ("b", "a"):
        (tmp_path / "docs" / f"{i}.json").write_text(json.dumps({"id": i, "title": "t", "content": "c\nd", "category": "x", "length": 3}, indent=1))
    assert [r.id for r in tables.read_objects(spark, str(tmp_path / "docs"), tables.DOCUMENT).collect()] == ["a", "b"]
    (tmp_path / "n.jsonl").write_text('{"query_id":"q","doc_id":"d","relevance":2}\n\n{"query_id":"q","doc_id":"e","relevance":0}\n')
    assert tables.read_lines(spark, str(tmp_path / "n.jsonl"), tables.ANNOTATION).count() == 2


def test_modes_and_ddl(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_parquet(spark.range(3), path)
    tables.write_parquet(spark.range(2), path, if_exists="append")
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(ValueError):
        tables.write_parquet(spark.range(1), path, if_exists="fail")
    assert tables.create_table("news", spark.createDataFrame([], "unique_id string, n int, tags array<string>").schema) == "CREATE TABLE IF NOT EXISTS news (unique_id TEXT PRIMARY KEY, n INTEGER, tags TEXT[])"


def test_snapshots(spark, tmp_path):
    state = tables.Snapshots(spark, f"file://{tmp_path}/state")
    assert state.read() is None
    assert state.write(spark.range(2)) == 1 and state.write(spark.range(3)) == 2
    (tmp_path / "state" / "v=3").mkdir()  # a writer that was lost half way
    assert state.read().count() == 3


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    say = lambda uid: json.dumps({"message": {"data": base64.b64encode(json.dumps({"unique_id": uid}).encode()).decode(), "messageId": uid}})
    articles = spark.createDataFrame([("a", 1), ("b", 2)], "unique_id string, n int")
    (src / "1.txt").write_text("\n".join([say("a"), "not json", say("a")]))
    worker.run_once(spark, str(src), articles, str(tmp_path / "out"), str(tmp_path / "cp"), lambda r: r)
    (src / "2.txt").write_text("\n".join([say("a"), say("b"), say("zz")]))
    worker.run_once(spark, str(src), articles, str(tmp_path / "out"), str(tmp_path / "cp"), lambda r: r)
    done = spark.read.parquet(str(tmp_path / "out/enriched"))
    assert sorted((r.unique_id, r.status) for r in done.collect()) == [("a", "enriched"), ("b", "enriched"), ("zz", "not_found")]
    assert spark.read.parquet(str(tmp_path / "out/malformed")).count() == 1
    batch = worker.pending(worker.decode(spark.read.text(str(src)).select("value")), articles, None)
    assert {(r.unique_id, r.status) for r in batch.collect()} == {(r.unique_id, r.status) for r in done.select("unique_id", "status").collect()}
    assert worker.events_of(done.withColumns({"enriched_at": F.lit("t"), "most_specific_theme_code": F.lit("01"), "has_summary": F.lit(True)})).count() == 2
