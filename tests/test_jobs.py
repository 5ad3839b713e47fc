"""Jobs end to end over a small state folder."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from newsloom import jobs
from newsloom.functions import vectors
from newsloom.operators import corpus, retrieval


def test_window():
    now = datetime(2024, 3, 1)
    assert jobs.window(None, None, now) == (datetime(2024, 1, 31), now)
    assert jobs.window("2024-02-01", "2024-02-02T10:00:00", now) == (datetime(2024, 2, 1), datetime(2024, 2, 2, 10))


def test_canonicalise_twice(spark, tmp_path):
    news = spark.createDataFrame([("u1", datetime(2024, 1, 5)), ("u2", datetime(2024, 1, 6)), ("u3", datetime(2023, 1, 1))], "unique_id string, published_at timestamp")
    features = spark.sql(
        "select * from values ('u1', array(named_struct('text','FINEP','type','ORG','forma_canonica','Finep','canonical_id',cast(null as string)), named_struct('text','Ana','type','PER','forma_canonica','Ana','canonical_id',cast(null as string)))),"
        " ('u2', array(named_struct('text','Banco Novo','type','ORG','forma_canonica','Banco Novo','canonical_id',cast(null as string)))), ('u3', array(named_struct('text','Antigo','type','ORG','forma_canonica','Antigo','canonical_id',cast(null as string)))) as t(unique_id, entities)"
    )
    replies = spark.createDataFrame([("finep", "ORG", '{"canonical_name":"Finep","type":"ORG","confidence":0.95}', None, None), ("banco novo", "ORG", '{"canonical_name":"Banco Novo","type":"ORG","confidence":0.9}', None, None)], "surface_norm string, type string, raw string, chosen string, chosen_confidence double")
    base = spark.createDataFrame([("Q7", "Finep", 1)], "qid string, name string, place int")
    run = lambda **o: jobs.canonicalise(spark, news=news, features=features, state_path=f"file://{tmp_path}/state", replies=replies, base=base, since=datetime(2024, 1, 1), until=datetime(2024, 2, 1), **o)
    dry = run(dry_run=True)
    assert dry["forms"] == 3 and not (tmp_path / "state").exists()
    first = run()
    assert first["resolved"] == 2 and first["needs_review"] == 1 and first["changed"] == 2
    reg = spark.read.parquet(f"{tmp_path}/state/registry/v=1")
    assert {r.entity_id for r in reg.collect()} == {"Q7", "dgb_banco-novo"}
    assert run()["forms"] == 0


def test_enrich(spark):
    df = spark.createDataFrame([(1, "texto"), (2, "outro"), (3, "feito")], "id int, body string")
    make = lambda: lambda p: '{"category":"c","tags":["a","b"]}' if "texto" in p else 1 / 0
    out = {r.id: r for r in jobs.enrich(df, text_col="body", key="id", kind="categorization", make=make, done=df.filter("id = 3")).collect()}
    assert out[1].tags == ["a", "b"] and out[1].error is None and out[2].category is None and "division" in out[2].error and 3 not in out
    with pytest.raises(ValueError):
        jobs.enrich(df, text_col="body", key="id", kind="none", make=make)


def test_index_reaches_the_exact_answer(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = e.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    exact = {(r.query_id, r.id) for r in retrieval.vector_topk(q, e, k=10).collect()}
    found = {(r.query_id, r.id) for r in retrieval.ivf_search(q, retrieval.ivf_index(e, lists=10), k=10, probes=10).collect()}
    assert found == exact


@pytest.mark.parametrize(("lists", "probes"), [(20, 10), (100, 10), (30, 1)])
def test_index_finds_all_with_few_probes(spark, lists, probes):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = e.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    exact = {(r.query_id, r.id) for r in retrieval.vector_topk(q, e, k=10).collect()}
    found = {(r.query_id, r.id) for r in retrieval.ivf_search(q, retrieval.ivf_index(e, lists=lists), k=10, probes=probes).collect()}
    assert len(found & exact) / len(exact) == 1.0 and len(found) == len(exact)


def test_required_and_aligned(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "id int, title string")
    good, bad = corpus.required(df, ["title"])
    assert [r.id for r in good.collect()] == [1] and {r.id: r.lacks for r in bad.collect()} == {2: ["title"], 3: ["title"]}
    with pytest.raises(ValueError):
        corpus.required(df, ["content"])
    assert corpus.aligned(df, {"id": "long", "summary": "string"}).dtypes == [("id", "bigint"), ("summary", "string")]
    assert round(corpus.break_even(521, 0.0119)) == 61


def test_index_searches_in_blocks(spark):
    """no pair of a query and an item is a row; copies in several blocks, zero vectors and vectors that are not finite keep their ranks."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[200:300] = x[5]
    x[310], x[311] = 0, np.nan
    x[320] = 4 * x[7]
    e = spark.createDataFrame([(i, [float(f) for f in r]) for i, r in enumerate(x)], "id long, v array<float>")
    q = e.filter("id % 20 = 0 or id in (5, 310)").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    every = q.crossJoin(e).withColumn("score", vectors.cosine(F.col("v"), F.col("q")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    want = {(r.query_id, r.id, r.rank, str(r.score)) for r in every.withColumn("rank", F.row_number().over(best)).filter("rank <= 10").collect()}
    found = retrieval.ivf_search(q, retrieval.ivf_index(e, lists=6), k=10, probes=2, item_block=32, query_block=8)
    assert {(r.query_id, r.id, r.rank, str(r.score)) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "aggregate(zip_with" not in plan
