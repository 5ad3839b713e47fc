"""Queries of retrieval and evaluation over embeddings, documents, labels and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import text as t
from newsloom.functions import vectors as v
from newsloom.operators import metrics, retrieval

from .catalogue import register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The stated queries, every row whose id is divisible by 20, and all items."""
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    stated = e.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.col("label").alias("q_label"))
    return stated, e


_SCORED = """
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, q.label = e.label AS same, q.vec_id <> e.vec_id AS other,
                  list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score
           FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0)
"""


@register(_SCORED + "SELECT query_id, id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10")
def vector_topk(spark, sf_dir):
    q, e = _vectors(spark, sf_dir)
    top = retrieval.vector_topk(q.select("query_id", "q"), e.select("id", "v"), k=10)
    return top.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@register(
    """
    SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS l2, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine_distance,
           round(-list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS negative_product
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
    """
)
def vector_distances(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    a, b = e.select("vec_id", F.col("embedding").alias("x")), e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    rows = a.join(b, "vec_id")
    x, y = F.col("x"), F.col("y")
    return rows.select("vec_id", F.round(v.euclidean(x, y), 6).alias("l2"), F.round(1 - v.cosine(x, y), 6).alias("cosine_distance"), F.round(-v.inner_product(x, y), 6).alias("negative_product"))


@register(
    _SCORED
    + "SELECT query_id, round(avg(score) FILTER (same AND other), 6) AS intra, round(avg(score) FILTER (NOT same), 6) AS inter, round(avg(score) FILTER (same AND other) - avg(score) FILTER (NOT same), 6) AS gap FROM s GROUP BY 1"
)
def intra_inter_similarity(spark, sf_dir):
    q, e = _vectors(spark, sf_dir)
    s = retrieval.class_similarity(q.withColumnRenamed("q_label", "label"), e.select("v", "label"))
    return s.select("query_id", F.round("intra", 6).alias("intra"), F.round("inter", 6).alias("inter"), F.round(F.col("intra") - F.col("inter"), 6).alias("gap"))


@register(
    _SCORED
    + """, n AS (SELECT max(vec_id) AS top FROM embeddings), p AS (SELECT query_id, id, score FROM s, n QUALIFY row_number() OVER (PARTITION BY query_id, top - id <= 90 ORDER BY score DESC, id) <= 20)
    SELECT query_id, id, round(score, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20"""
)
def dual_index_union(spark, sf_dir):
    """An index of the items of the last 90 days (ids stand for days) and one of the older ones, searched apart."""
    q, e = _vectors(spark, sf_dir)
    ages = e.join(F.broadcast(e.agg(F.max("id").alias("top")))).withColumn("age", F.col("top") - F.col("id"))  # one row
    old, recent = retrieval.by_age(ages, F.col("age"))
    top = lambda d: retrieval.vector_topk(q.select("query_id", "q"), d.select("id", "v"), k=20)
    return retrieval.dual_index(top(old), top(recent), k=20, by=["query_id"]).select("query_id", "id", F.round("score", 6).alias("score"))


_FT = r"""
WITH w AS (SELECT doc_id AS id, regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') AS words FROM documents),
f AS (SELECT id, len(list_filter(words, lambda x: x = 'the')) AS a, len(list_filter(words, lambda x: x = 'and')) AS b, len(list_filter(words, lambda x: x <> '')) AS n FROM w)
"""


@register(_FT + "SELECT id, (a + b)::BIGINT AS hits, round((a + b) / (1 + ln(n)), 6) AS rank_score FROM f WHERE a > 0 AND b > 0")
def fulltext_match(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.fulltext_match(docs, ["the", "and"]).withColumn("rank_score", F.round("rank_score", 6))


@register(
    _FT
    + """, x AS (SELECT id, row_number() OVER (ORDER BY (a + b) / (1 + ln(n)) DESC, id) AS rank FROM f WHERE a > 0 AND b > 0 QUALIFY rank <= 50),
    y AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50)
    SELECT coalesce(x.id, y.id) AS id, round(coalesce(1.0::DOUBLE / (60 + x.rank), 0) + coalesce(1.0::DOUBLE / (60 + y.rank), 0), 9) AS rrf_score FROM x FULL JOIN y ON x.id = y.id"""
)
def rrf_fusion(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "n_chars")
    a = retrieval.ranked(retrieval.fulltext_match(docs.select("id", "text"), ["the", "and"]), "rank_score", k=50)
    b = retrieval.ranked(docs.select("id", "n_chars"), "n_chars", k=50)
    return retrieval.rrf(a.select("id", "rank"), b.select("id", "rank")).select("id", F.round("rrf_score", 9).alias("rrf_score"))


@register("SELECT * FROM (VALUES ('A', 1), ('C', 2), ('B', 3)) AS t(id, place)")
def rrf_example(spark, sf_dir):
    a = spark.createDataFrame([("A", 1), ("B", 2), ("C", 5)], "id string, rank int")
    b = spark.createDataFrame([("C", 1), ("A", 3)], "id string, rank int")
    return retrieval.ranked(retrieval.rrf(a, b).select("id", "rrf_score"), "rrf_score", k=10).select("id", F.col("rank").alias("place"))


@register(
    """
    WITH c AS (SELECT event_id % 97 AS document_id, event_id AS chunk_index, round(value, 3) AS score FROM events)
    SELECT document_id, chunk_index, score FROM c QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY score DESC, chunk_index) = 1
    """
)
def best_chunk_per_doc(spark, sf_dir):
    c = _t(spark, sf_dir, "events").select((F.col("event_id") % 97).alias("document_id"), F.col("event_id").alias("chunk_index"), F.round("value", 3).alias("score"))
    return retrieval.best_chunk(c)


@register(
    """
    SELECT source, doc_id, used::BIGINT AS used FROM (SELECT source, doc_id, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 32000
    """
)
def context_pack(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").cast("long").alias("n"))
    return retrieval.pack_context(docs, budget=32000, by=["source"], order=["doc_id"], size=F.col("n")).select("source", "doc_id", "used")


@register(
    """
    SELECT o_orderkey, round(0.7 * sim + 0.3 * rec, 9)::DOUBLE AS final_score FROM (
      SELECT o_orderkey, (o_orderkey % 100) / 100.0::DOUBLE AS sim, 1.0::DOUBLE / (1 + greatest(0, date_diff('day', o_orderdate::DATE, DATE '1998-12-31')) / 30.0::DOUBLE) AS rec FROM orders)
    """
)
def recency_score(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") % 100) / F.lit(100.0)).alias("similarity"), F.col("o_orderdate").alias("published_at"))
    return retrieval.with_recency(rows, now="1998-12-31").select("o_orderkey", F.round("final_score", 9).alias("final_score"))


@register("SELECT * FROM (VALUES ('notícias mais recentes', true), ('qual a história', false), ('ÚLTIMA decisão', true)) AS t(q, temporal)")
def temporal_terms(spark, sf_dir):
    return spark.createDataFrame([("notícias mais recentes",), ("qual a história",), ("ÚLTIMA decisão",)], "q string").withColumn("temporal", t.has_temporal_term("q"))


_RANKED = """
, r AS (SELECT query_id, id, CASE WHEN same THEN 1 + id % 3 ELSE 0 END AS relevance, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE other QUALIFY rank <= 50)
"""


def _lists(spark, sf_dir, k: int) -> DataFrame:
    q, e = _vectors(spark, sf_dir)
    top = retrieval.vector_topk(q.select("query_id", "q"), e.select("id", "v"), k=k + 1).filter("id <> query_id")
    again = top.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("rank") <= k)
    joined = again.join(e.select("id", "label"), "id").join(q.select("query_id", "q_label"), "query_id")
    return joined.withColumn("relevance", F.when(F.col("label") == F.col("q_label"), F.lit(1) + F.col("id") % 3).otherwise(0))


@register(
    _SCORED + _RANKED
    + """, i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, rank) AS best, sum((relevance > 0)::INT) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM r)
    SELECT query_id, round(coalesce(sum(CASE WHEN rank <= 10 THEN relevance / log2(rank + 1) ELSE 0 END) / nullif(sum(CASE WHEN best <= 10 THEN relevance / log2(best + 1) ELSE 0 END), 0), 0), 9) AS ndcg,
           round(coalesce(sum(CASE WHEN relevance > 0 THEN hits / rank ELSE 0 END) / nullif(sum((relevance > 0)::INT), 0), 0), 9)::DOUBLE AS ap, round(coalesce(1.0 / min(rank) FILTER (relevance > 0), 0), 9)::DOUBLE AS rr
    FROM i GROUP BY 1"""
)
def ndcg_map_mrr(spark, sf_dir):
    m = metrics.ranking_metrics(_lists(spark, sf_dir, 50), k=10)
    return m.select("query_id", *[F.round(c, 9).alias(c) for c in ("ndcg", "ap", "rr")])


@register(_SCORED + _RANKED + ", n AS (SELECT query_id, count(*) FILTER (same AND other) AS n FROM s GROUP BY 1) SELECT query_id, round(count(*) FILTER (rank <= 10 AND relevance > 0)::DOUBLE / any_value(n), 9) AS recall FROM r JOIN n USING (query_id) GROUP BY 1")
def recall_at_k(spark, sf_dir):
    q, e = _vectors(spark, sf_dir)
    sizes = e.groupBy(F.col("label").alias("q_label")).agg((F.count(F.lit(1)) - 1).alias("n_relevant"))
    totals = q.join(sizes, "q_label").filter("n_relevant > 0").select("query_id", "n_relevant")
    return metrics.recall_at_k(_lists(spark, sf_dir, 50), totals, k=10).withColumn("recall", F.round("recall", 9))


@register(_SCORED + _RANKED + ", f AS (SELECT query_id, min(rank) FILTER (relevance > 0) AS p FROM r GROUP BY 1) SELECT avg((coalesce(p, 999) <= 1)::INT) AS top1, avg((coalesce(p, 999) <= 3)::INT) AS top3, avg((coalesce(p, 999) <= 5)::INT) AS top5, avg((coalesce(p, 999) <= 10)::INT) AS top10, round(avg(coalesce(1.0 / p, 0)), 9)::DOUBLE AS mrr, round(avg(p), 9) AS mean_position FROM f")
def anchor_topk(spark, sf_dir):
    first = _lists(spark, sf_dir, 50).groupBy("query_id").agg(F.min(F.when(F.col("relevance") > 0, F.col("rank"))).alias("p"))
    hit = lambda k: F.avg(F.coalesce((F.col("p") <= k).cast("int"), F.lit(0))).alias(f"top{k}")
    return first.agg(hit(1), hit(3), hit(5), hit(10), F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("p"), F.lit(0.0))), 9).alias("mrr"), F.round(F.avg("p"), 9).alias("mean_position"))


@register("SELECT relevance, count(*) AS n FROM (SELECT (vec_id + label) % 4 AS relevance FROM embeddings) GROUP BY 1")
def relevance_distribution(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select(((F.col("vec_id") + F.col("label")) % 4).alias("relevance")).groupBy("relevance").agg(F.count(F.lit(1)).alias("n"))


_PRED = """
WITH p AS (SELECT l.quality::INTEGER AS truth, CASE WHEN length(d.text) - length(replace(replace(d.text, '*', ''), '!', '')) > 20 OR d.n_chars < 300 THEN 0 ELSE 1 END::INTEGER AS pred, l.toxic, d.lang FROM labels l JOIN documents d USING (doc_id))
"""


def _predictions(spark, sf_dir) -> DataFrame:
    marks = F.length("text") - F.length(F.translate("text", "*!", ""))
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", F.when((marks > 20) | (F.col("n_chars") < 300), 0).otherwise(1).alias("pred"))
    return _t(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("quality").cast("int").alias("truth"), "pred", "toxic", "lang")


@register(
    _PRED
    + """, s AS (SELECT label, sum((truth = label AND pred = label)::INT) AS tp, sum((pred = label)::INT) AS n_pred, sum((truth = label)::INT) AS support FROM p, (SELECT unnest([0, 1])::INTEGER AS label) GROUP BY 1)
    SELECT label, round(coalesce(tp / nullif(n_pred, 0), 0), 9)::DOUBLE AS precision, round(coalesce(tp / nullif(support, 0), 0), 9)::DOUBLE AS recall, round(coalesce(2 * tp / nullif(n_pred + support, 0), 0), 9)::DOUBLE AS f1, support::BIGINT AS support FROM s"""
)
def accuracy_f1(spark, sf_dir):
    f = metrics.f1_by_label(_predictions(spark, sf_dir))
    return f.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@register(_PRED + "SELECT truth, pred, count(*) AS n FROM p GROUP BY 1, 2")
def confusion(spark, sf_dir):
    return metrics.confusion(_predictions(spark, sf_dir))


@register(_PRED + "SELECT lang, round(avg((truth = pred)::INT), 9) AS accuracy, count(*) AS n FROM p GROUP BY 1")
def accuracy_by_lang(spark, sf_dir):
    return _predictions(spark, sf_dir).groupBy("lang").agg(F.round(F.avg((F.col("truth") == F.col("pred")).cast("int")), 9).alias("accuracy"), F.count(F.lit(1)).alias("n"))


_VOTES = "(event_id % 3)::INTEGER AS a, (user_id % 3)::INTEGER AS b, (floor(value)::BIGINT % 3)::INTEGER AS c"


def _votes(spark, sf_dir) -> DataFrame:
    c = lambda x, n: (x % 3).cast("int").alias(n)
    return _t(spark, sf_dir, "events").select("event_id", c(F.col("event_id"), "a"), c(F.col("user_id"), "b"), c(F.floor("value"), "c"))


@register(f"SELECT CASE len(list_distinct([a, b, c])) WHEN 1 THEN 'total' WHEN 2 THEN 'partial' ELSE 'none' END AS agreement, count(*) AS n FROM (SELECT {_VOTES} FROM events) GROUP BY 1")
def agreement(spark, sf_dir):
    return _votes(spark, sf_dir).groupBy(metrics.agreement(F.col("a"), F.col("b"), F.col("c")).alias("agreement")).agg(F.count(F.lit(1)).alias("n"))


@register(f"SELECT event_id, CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE a END AS label FROM (SELECT event_id, {_VOTES} FROM events)")
def majority_vote(spark, sf_dir):
    return _votes(spark, sf_dir).select("event_id", metrics.majority(F.col("a"), F.col("b"), F.col("c")).alias("label"))


@register(
    "WITH RECURSIVE "
    + _PRED.strip().removeprefix("WITH ")
    + """, a AS (SELECT count(*) AS n, sum((truth = pred)::INT) AS k FROM p),
    e AS (SELECT n, k AS c, 0.025::DOUBLE AS goal, 'low' AS side FROM a UNION ALL SELECT n, k + 1, 0.975::DOUBLE, 'high' FROM a),
    b AS (SELECT e.*, 0::INTEGER AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM e UNION ALL
      SELECT n, c, goal, side, step + 1, CASE WHEN below THEN (lo + hi) / 2 ELSE lo END, CASE WHEN below THEN hi ELSE (lo + hi) / 2 END
      FROM (SELECT *, list_sum(list_transform(range(c::BIGINT, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((lo + hi) / 2) + (n - i) * ln(1 - (lo + hi) / 2)))) < goal AS below FROM b WHERE step < 45))
    SELECT round(max(CASE WHEN side = 'low' THEN (lo + hi) / 2 END), 7) AS low, round(max(CASE WHEN side = 'high' THEN (lo + hi) / 2 END), 7) AS high FROM b WHERE step = 45"""
)
def accuracy_interval(spark, sf_dir):
    """The exact binomial interval of the accuracy."""
    a = _predictions(spark, sf_dir).agg(F.sum((F.col("truth") == F.col("pred")).cast("long")).alias("ok"), F.count(F.lit(1)).alias("n"))
    w = a.select(metrics.binomial_interval("ok", "n").alias("w"))
    return w.select(F.round("w.low", 7).alias("low"), F.round("w.high", 7).alias("high"))


_TURNS = r"""
WITH t AS (SELECT u.conv_id, u.turn, regexp_split_to_array(lower(u.text), '[^\p{L}\p{N}]+') AS c, regexp_split_to_array(lower(a.text), '[^\p{L}\p{N}]+') AS r FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user'),
w AS (SELECT conv_id, turn, list_filter(c, lambda x: x <> '') AS c, list_filter(r, lambda x: x <> '') AS r FROM t)
"""


def _turn_pairs(spark, sf_dir) -> DataFrame:
    c = _t(spark, sf_dir, "conversations")
    u = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("candidate"))
    a = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    return u.join(a, ["conv_id", "turn"]).withColumn("id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))


@register(
    _TURNS
    + """, g AS (SELECT conv_id, turn, g, sum(x) AS x, sum(y) AS y FROM (SELECT conv_id, turn, unnest(c) AS g, 1 AS x, 0 AS y FROM w UNION ALL SELECT conv_id, turn, unnest(r), 0, 1 FROM w) GROUP BY 1, 2, 3)
    SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS id, round(coalesce(2 * sum(least(x, y)) / nullif(sum(x) + sum(y), 0), 0), 9)::DOUBLE AS rouge_1 FROM g GROUP BY conv_id, turn"""
)
def rouge_1(spark, sf_dir):
    return metrics.rouge_n(_turn_pairs(spark, sf_dir), n=1).withColumn("rouge_1", F.round("rouge_1", 9))


@register(
    _TURNS
    + """, b AS (SELECT conv_id, turn, list_transform(range(1, len(c)), lambda i: c[i] || ' ' || c[i + 1]) AS c, list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1]) AS r FROM w),
    g AS (SELECT conv_id, turn, g, sum(x) AS x, sum(y) AS y FROM (SELECT conv_id, turn, unnest(c) AS g, 1 AS x, 0 AS y FROM b UNION ALL SELECT conv_id, turn, unnest(r), 0, 1 FROM b) GROUP BY 1, 2, 3)
    SELECT b.conv_id::VARCHAR || ':' || b.turn::VARCHAR AS id, round(coalesce(2 * sum(least(x, y)) / nullif(sum(x) + sum(y), 0), 0), 9)::DOUBLE AS rouge_2 FROM b LEFT JOIN g USING (conv_id, turn) GROUP BY b.conv_id, b.turn"""
)
def rouge_2(spark, sf_dir):
    return metrics.rouge_n(_turn_pairs(spark, sf_dir), n=2).withColumn("rouge_2", F.round("rouge_2", 9))


@register()
def rouge_l(spark, sf_dir):
    """ROUGE-L between each user turn and the answer to it."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = _turn_pairs(spark, sf_dir).select("id", words(F.col("candidate")).alias("c"), words(F.col("reference")).alias("r"))
    return rows.select("id", F.round(metrics.rouge_l_long("c", "r"), 9).alias("rouge_l"))


_MODELS = "('m1',0.95D,0.80D,0.85D,0.90D,120.0D,300.0D,0.70D),('m2',0.60D,0.70D,0.95D,0.75D,40.0D,100.0D,0.90D),('m3',0.80D,0.90D,0.70D,0.99D,200.0D,600.0D,0.60D)"
_PARTS = "model, ndcg_general, ndcg_jargon, map, mrr, throughput, latency_p99, ndcg_long"


def _clip(x: str) -> str:
    return f"greatest(0, least(1, {x}))"


@register(
    f"""
    WITH s AS (SELECT model, round({_clip('(ndcg_general - 0.70) / 0.20')} * 25 + {_clip('(ndcg_jargon - 0.70) / 0.20')} * 25 + {_clip('(map - 0.70) / 0.20')} * 10 + {_clip('(mrr - 0.75) / 0.20')} * 5
      + {_clip('(throughput - 50) / 100')} * 15 + {_clip('(latency_p99 - 100) / 400')} * 10 + {_clip('(ndcg_long - 0.60) / 0.25')} * 10, 1)::DOUBLE AS score
      FROM (SELECT * FROM (VALUES {_MODELS.replace('D,', '::DOUBLE,').replace('D)', '::DOUBLE)')}) AS t({_PARTS})))
    SELECT model, score, row_number() OVER (ORDER BY score DESC, model)::INTEGER AS place FROM s
    """
)
def weighted_score(spark, sf_dir):
    rows = spark.sql(f"SELECT * FROM VALUES {_MODELS} AS t({_PARTS})").select("model", metrics.weighted_score().alias("score"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "model")))


@register("SELECT * FROM (VALUES (1, true), (2, true), (3, false)) AS t(id, rerank)")
def adaptive_rerank(spark, sf_dir):
    rows = spark.createDataFrame([(1, "um dois três quatro cinco seis", [0.9, 0.5, 0.1]), (2, "curta", [0.0325, 0.0324, 0.0323]), (3, "curta", [0.9, 0.5, 0.1])], "id int, q string, scores array<double>")
    return rows.select("id", v.should_rerank(F.col("q"), F.col("scores")).alias("rerank"))


@register("SELECT CASE WHEN x >= 0.55 THEN 'high' WHEN x >= 0.45 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM (SELECT (event_id % 100) / 100.0::DOUBLE AS x FROM events) GROUP BY 1")
def rouge_bands(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy(metrics.rouge_band((F.col("event_id") % 100) / F.lit(100.0)).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT * FROM (VALUES ('a', true), ('b', false), ('c', false)) AS t(model, worth_it)")
def reranker_choice(spark, sf_dir):
    rows = spark.createDataFrame([("a", 0.30, 0.2, 0.001), ("b", 0.30, 2.4, 0.001), ("c", 0.02, 0.1, 0.0)], "model string, gain double, latency double, cost double")
    return rows.select("model", metrics.choose_reranker(F.col("gain"), F.col("latency"), F.col("cost")).alias("worth_it"))


@register("SELECT doc_id, sha256('[Fonte ' || (doc_id % 9 + 1)::VARCHAR || ': ' || source || '] (05/03/2024)' || chr(10) || text[:300]) AS block FROM documents")
def context_blocks(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    block = retrieval.context_block(F.col("doc_id") % 9 + 1, F.col("source"), F.lit("2024-03-05").cast("date"), t.preview("text", 300))
    return docs.select("doc_id", F.sha2(block, 256).alias("block"))


@register(_SCORED + "SELECT query_id, rank::INTEGER AS rank, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10")
def ivf_search(spark, sf_dir):
    """The inverted-file index finds the exact top 10."""
    q, e = _vectors(spark, sf_dir)
    q = q.select("query_id", "q")
    return retrieval.ivf_search(q, retrieval.ivf_index(e.select("id", "v"), lists=20), k=10, probes=10).select("query_id", "rank", "id")


@register("SELECT * FROM (VALUES ('vector','A',1),('vector','B',2),('vector','C',5),('fulltext','C',1),('fulltext','A',3),('hybrid','A',1),('hybrid','C',2),('hybrid','B',3)) AS t(mode, id, rank)")
def compare_modes(spark, sf_dir):
    a = spark.createDataFrame([("A", 1), ("B", 2), ("C", 5)], "id string, rank int")
    b = spark.createDataFrame([("C", 1), ("A", 3)], "id string, rank int")
    return retrieval.compare_modes(a, b)


@register("SELECT 2::BIGINT AS n_sources, 'Use somente os fatos do contexto.' || chr(10) || '[Fonte 1: B] (02/01/2024)' || chr(10) || 'bbb' || chr(10) || chr(10) || '[Fonte 2: A] (01/01/2024)' || chr(10) || 'aa2' || chr(10) || chr(10) || 'Pergunta: o que?' || chr(10) || 'Fatos:' AS prompt")
def answer_context(spark, sf_dir):
    rows = [(1, 0, "A", "2024-01-01", "aa1", 0.5), (1, 1, "A", "2024-01-01", "aa2", 0.7), (2, 0, "B", "2024-01-02", "bbb", 0.9), (3, 0, "C", "2024-01-03", "c" * 99, 0.4), (4, 0, "D", "2024-01-04", "low", 0.1)]
    chunks = spark.createDataFrame(rows, "document_id int, chunk_index int, title string, published_at string, content string, score double").withColumn("published_at", F.col("published_at").cast("date"))
    return retrieval.answer_context(chunks, question="o que?", budget_chars=20, least_score=0.3, kind="factual")


@register("SELECT * FROM (VALUES (1,'new'),(2,NULL),(3,NULL)) AS t(key, answer)")
def answer_cache(spark, sf_dir):
    cache = spark.createDataFrame([(1, "old", "2024-01-01 09:10:00"), (1, "new", "2024-01-01 09:30:00"), (2, "late", "2024-01-01 08:00:00")], "key int, answer string, stored_at string")
    return retrieval.cached_answers(spark.createDataFrame([(1,), (2,), (3,)], "key int"), cache, now="2024-01-01 10:00:00")


@register("SELECT id, batch_ok::INTEGER AS ok, CASE WHEN batch_ok = 5 THEN 'success' WHEN batch_ok = 0 THEN 'failed' ELSE 'partial' END AS outcome FROM (SELECT event_id // 5 AS id, count(*) FILTER (event_type <> 'error') AS batch_ok FROM events GROUP BY 1)")
def batch_outcomes(spark, sf_dir):
    from newsloom.operators import corpus

    by = _t(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 5).cast("long").alias("id")).agg(F.count_if(F.col("event_type") != "error").cast("int").alias("ok"))
    return by.select("id", "ok", corpus.batch_outcome(F.col("ok"), F.lit(5)).alias("outcome"))


@register("SELECT * FROM (VALUES ('documents', 250), ('queries', 60), ('annotations', 75)) AS t(part, n)")
def synthetic_corpus(spark, sf_dir):
    from newsloom.operators import corpus

    parts = zip(("documents", "queries", "annotations"), corpus.synthetic_corpus(spark), strict=True)
    counts = [d.agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit(name).alias("part"), "n") for name, d in parts]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])
