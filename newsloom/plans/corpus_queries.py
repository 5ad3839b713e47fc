"""Queries over documents, events and the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import text as t
from newsloom.functions import vectors as v
from newsloom.operators import corpus, ledger, ranks, retrieval, taxonomy
from newsloom.sources import tables

from .catalogue import register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register(
    """
    SELECT count(*) AS n, round(avg(n_chars), 6) AS mean, quantile_cont(n_chars, 0.5)::DOUBLE AS median, round(stddev_samp(n_chars), 6) AS stddev,
           min(n_chars) AS least, max(n_chars) AS most, quantile_cont(n_chars, 0.95)::DOUBLE AS p95 FROM documents
    """
)
def corpus_stats_global(spark, sf_dir):
    s = corpus.length_stats(_t(spark, sf_dir, "documents"), "n_chars")
    return s.withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


@register(
    """
    SELECT CASE WHEN n_chars <= 3000 THEN 'short' WHEN n_chars <= 5500 THEN 'medium' ELSE 'long' END AS profile, count(*) AS n
    FROM documents GROUP BY 1
    """
)
def length_profiles(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy(corpus.length_profile(F.col("n_chars")).alias("profile")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 15")
def top_sources(spark, sf_dir):
    return corpus.top_values(_t(spark, sf_dir, "documents"), "source", k=15)


@register("SELECT count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_langs FROM documents")
def distinct_sources(spark, sf_dir):
    return _t(spark, sf_dir, "documents").agg(F.countDistinct("source").alias("n_sources"), F.countDistinct("lang").alias("n_langs"))


@register(
    r"""
    SELECT lang, count(*) AS n_docs, sum(len(regexp_extract_all(lower(text), '\b(?:the|der|de|und|and)\b')))::BIGINT AS n_terms,
           round(avg(1000.0 * len(regexp_extract_all(lower(text), '\b(?:the|der|de|und|and)\b')) / greatest(1, length(text))), 6)::DOUBLE AS density
    FROM (SELECT lang, regexp_replace(text, '[^\x00-\x7F]', '_', 'g') AS text FROM documents) GROUP BY lang
    """
)
def keyword_density(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("lang", F.regexp_replace("text", r"[^\x00-\x7F]", "_").alias("text"))
    n = F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"\b(?:the|der|de|und|and)\b"), F.lit(0)))
    return docs.withColumn("n", n).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_terms"), F.round(F.avg(F.lit(1000.0) * F.col("n") / F.greatest(F.lit(1), F.length("text"))), 6).alias("density")
    )


@register("SELECT date_trunc('month', ts)::TIMESTAMP AS month, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def events_per_month(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy(F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@register("SELECT date_trunc('week', ts)::TIMESTAMP AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_per_week(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy(F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT doc_id, text AS preview_of, n FROM (SELECT doc_id, text[:80] AS text, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS n FROM documents)".replace("\\\\", "\\"))
def word_counts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", t.preview("text", 80).alias("preview_of"), t.word_count("text").cast("long").alias("n"))


@register("SELECT d.doc_id, d.n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY d.doc_id DESC LIMIT 50")
def backlog_newest(spark, sf_dir):
    """The newest documents without a label: anti join, then top 50 without a full sort."""
    docs, done = _t(spark, sf_dir, "documents").select("doc_id", "n_chars"), _t(spark, sf_dir, "labels").select("doc_id")
    return docs.join(done, "doc_id", "left_anti").orderBy(F.col("doc_id").desc_nulls_first()).limit(50)


@register(
    """
    SELECT o_orderkey, o_custkey FROM orders o
    WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')
    """
)
def backlog_anti_join(spark, sf_dir):
    done = _t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(done, "o_orderkey", "left_anti")


@register("SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT min(ts) FROM events) + INTERVAL 10 DAY AND ts < (SELECT min(ts) FROM events) + INTERVAL 40 DAY GROUP BY 1")
def window_half_open(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    start = ev.agg(F.min("ts")).first()[0]
    at = lambda n: F.lit(start).cast("timestamp_ntz") + F.expr(f"INTERVAL {n} DAYS")
    return ev.filter((F.col("ts") >= at(10)) & (F.col("ts") < at(40))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1995-12-31' AND o_totalprice >= 1000 GROUP BY 1")
def window_inclusive(spark, sf_dir):
    d = F.col("o_orderdate")
    rows = _t(spark, sf_dir, "orders").filter(d.between(F.lit("1994-01-01").cast("timestamp_ntz"), F.lit("1995-12-31").cast("timestamp_ntz")) & (F.col("o_totalprice") >= 1000))
    return rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@register(
    """
    SELECT r.r_name, n.n_name, count(c.c_custkey) AS n_customers, round(sum(c.c_acctbal), 2) AS balance
    FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2
    """
)
def theme_rollup(spark, sf_dir):
    """A three-level rollup: facts to the second level before the dimension joins."""
    by = _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("c_custkey").alias("n_customers"), F.sum("c_acctbal").alias("b"))
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    return by.join(n, by["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("r_name", "n_name", "n_customers", F.round("b", 2).alias("balance"))


def _nodes(spark, sf_dir) -> DataFrame:
    pad = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    r = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), pad("r_regionkey").alias("code"), F.col("r_name").alias("label"), F.lit(1).alias("level"), F.lit(None).cast("string").alias("parent_code"))
    n = _t(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).alias("id"), F.concat(pad("n_regionkey"), F.lit("."), pad("n_nationkey")).alias("code"), F.col("n_name").alias("label"), F.lit(2).alias("level"), pad("n_regionkey").alias("parent_code"))
    s = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    two = F.concat(pad("n_regionkey"), F.lit("."), pad("n_nationkey"))
    s = s.select((F.col("s_suppkey").cast("int") + 1000).alias("id"), F.concat(two, F.lit("."), F.col("s_suppkey").cast("string")).alias("code"), F.col("s_name").alias("label"), F.lit(3).alias("level"), two.alias("parent_code"))
    return r.unionByName(n).unionByName(s)


_NODES = """
WITH nodes AS (
  SELECT r_regionkey AS id, lpad(r_regionkey::VARCHAR, 2, '0') AS code, r_name AS label, 1 AS level, NULL AS parent_code FROM region
  UNION ALL SELECT n_nationkey + 100, lpad(n_regionkey::VARCHAR, 2, '0') || '.' || lpad(n_nationkey::VARCHAR, 2, '0'), n_name, 2, lpad(n_regionkey::VARCHAR, 2, '0') FROM nation
  UNION ALL SELECT s_suppkey::INT + 1000, lpad(n_regionkey::VARCHAR, 2, '0') || '.' || lpad(n_nationkey::VARCHAR, 2, '0') || '.' || s_suppkey::VARCHAR, s_name, 3,
    lpad(n_regionkey::VARCHAR, 2, '0') || '.' || lpad(n_nationkey::VARCHAR, 2, '0') FROM supplier JOIN nation ON s_nationkey = n_nationkey
)
"""


@register(_NODES + "SELECT level::INTEGER AS level, count(*) AS n_nodes FROM nodes GROUP BY 1")
def taxonomy_size(spark, sf_dir):
    return taxonomy.sizes(_nodes(spark, sf_dir))


@register(_NODES + "SELECT c.code AS l3_code, c.label AS l3_label, b.code AS l2_code, b.label AS l2_label, a.code AS l1_code, a.label AS l1_label FROM nodes c JOIN nodes b ON b.level = 2 AND c.parent_code = b.code JOIN nodes a ON a.level = 1 AND b.parent_code = a.code WHERE c.level = 3")
def taxonomy_hierarchy(spark, sf_dir):
    return taxonomy.hierarchy(_nodes(spark, sf_dir))


@register(
    _NODES
    + """
    , coded AS (SELECT c_custkey, CASE WHEN c_custkey % 5 < 4 THEN lpad(n_regionkey::VARCHAR, 2, '0') END AS l1,
         CASE WHEN c_custkey % 3 = 0 THEN lpad(n_regionkey::VARCHAR, 2, '0') || '.' || lpad(n_nationkey::VARCHAR, 2, '0') END AS l2
         FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, coalesce(b.id, a.id)::INTEGER AS most_specific_theme_id FROM coded LEFT JOIN nodes a ON a.code = l1 LEFT JOIN nodes b ON b.code = l2 WHERE coalesce(b.id, a.id) IS NOT NULL
    """
)
def theme_ids(spark, sf_dir):
    pad = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    rows = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    coded = rows.select("c_custkey", F.when(F.col("c_custkey") % 5 < 4, pad("n_regionkey")).alias("l1"), F.when(F.col("c_custkey") % 3 == 0, F.concat(pad("n_regionkey"), F.lit("."), pad("n_nationkey"))).alias("l2"), F.lit(None).cast("string").alias("l3"))
    return taxonomy.attach_ids(coded, _nodes(spark, sf_dir)).select("c_custkey", "most_specific_theme_id")


def _usage(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("model_id"), F.floor("value").cast("long").alias("input_tokens"), (F.col("user_id") % 100).cast("long").alias("output_tokens"), "event_id")


_LEDGER = "WITH ledger AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS model_id, sum(floor(value))::BIGINT AS input_tokens, sum(user_id % 100)::BIGINT AS output_tokens FROM events GROUP BY 1, 2) "


@register(_LEDGER + "SELECT * FROM ledger")
def ledger_daily(spark, sf_dir):
    return ledger.daily_usage(_usage(spark, sf_dir))


@register(_LEDGER + "SELECT day, model_id, input_tokens + output_tokens AS used, coalesce(input_tokens + output_tokens >= 0.8 * CASE model_id WHEN 'click' THEN 3000 WHEN 'view' THEN 5000 END, false) AS exhausted FROM ledger")
def budget_flag(spark, sf_dir):
    return ledger.exhausted(ledger.daily_usage(_usage(spark, sf_dir)), {"click": 3000, "view": 5000}).select("day", "model_id", "used", "exhausted")


@register(
    """
    WITH q AS (SELECT event_id, event_type, (user_id % 100)::BIGINT AS tokens, ((row_number() OVER w - 1) // 5)::BIGINT AS block,
                      coalesce(sum(user_id % 100) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent
               FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id))
    SELECT event_id, block, spent, min(spent) OVER (PARTITION BY event_type, block) < 20000 AS runs FROM q
    """
)
def budget_cutoff(spark, sf_dir):
    work = _t(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 100).cast("long").alias("tokens"))
    return ledger.cut_off(work, budget=20000, by=["event_type"], order=["event_id"]).select("event_id", "block", "spent", "runs")


@register(
    """
    SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY secs RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS recent
    FROM (SELECT event_id, event_type, floor(epoch(ts))::BIGINT AS secs FROM events)
    """
)
def rate_window(spark, sf_dir):
    return ledger.request_rate(_t(spark, sf_dir, "events").select("event_id", "event_type", "ts"), by="event_type", ts="ts").select("event_id", "recent")


@register("SELECT count(*) FILTER (o.o_orderkey IS NULL) AS orphans, count(*) AS checked FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey")
def orphans_check(spark, sf_dir):
    items, orders = _t(spark, sf_dir, "lineitem").select("l_orderkey"), _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    lost = items.join(orders, "l_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    return lost.join(F.broadcast(items.agg(F.count(F.lit(1)).alias("checked"))))


@register(
    """
    SELECT 'orders' AS run, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 2
    UNION ALL SELECT 'lines', l_linestatus, count(*) FROM lineitem GROUP BY 2
    """
)
def union_runs(spark, sf_dir):
    tally = lambda d, c, name: d.groupBy(F.col(c).alias("status")).agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.lit(name))
    return tally(_t(spark, sf_dir, "orders"), "o_orderstatus", "orders").unionByName(tally(_t(spark, sf_dir, "lineitem"), "l_linestatus", "lines"))


@register(
    """
    SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p,
           round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 6)::DOUBLE AS rate, round(avg(o_totalprice), 4) AS mean_price
    FROM orders GROUP BY 1
    """
)
def status_tally(spark, sf_dir):
    s = F.col("o_orderstatus")
    return _t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count_if(s == "F").alias("f"), F.count_if(s == "O").alias("o"), F.count_if(s == "P").alias("p"),
        F.round(F.coalesce(F.try_divide(F.lit(100.0) * F.count_if(s == "F"), F.count(F.lit(1))), F.lit(0.0)), 6).alias("rate"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"),
    )


@register("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    p = ranks.percentiles(_t(spark, sf_dir, "events"), by=["event_type"], value="value", shares={"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return p.select("event_type", *[F.round(n, 6).alias(n) for n in ("p50", "p95", "p99")])


@register(_LEDGER + "SELECT model_id, round(sum(input_tokens / 1e6 * 0.25 + output_tokens / 1e6 * 1.25), 9)::DOUBLE AS cost, round(30 * sum(input_tokens / 1e6 * 0.25 + output_tokens / 1e6 * 1.25) / count(DISTINCT day), 9)::DOUBLE AS monthly FROM ledger GROUP BY 1")
def cost_projection(spark, sf_dir):
    use = ledger.daily_usage(_usage(spark, sf_dir)).withColumn("cost", v.token_cost(F.col("input_tokens"), F.col("output_tokens"), 0.25, 1.25))
    return use.groupBy("model_id").agg(F.round(F.sum("cost"), 9).alias("cost"), F.round(F.lit(30) * F.sum("cost") / F.countDistinct("day"), 9).alias("monthly"))


@register("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id) AS r FROM documents) WHERE r <= 10")
def stratified_sample(spark, sf_dir):
    return corpus.stratified_sample(_t(spark, sf_dir, "documents").select("doc_id", "source"), by="source", key="doc_id", n=10)


@register(
    """
    WITH p AS (SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id) - 1) / (count(*) OVER (PARTITION BY lang))::DOUBLE AS place FROM documents)
    SELECT doc_id, lang, CASE WHEN place < 0.7 THEN 'train' WHEN place < 0.7::DOUBLE + 0.1::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM p
    """
)
def stratified_split(spark, sf_dir):
    return corpus.stratified_split(_t(spark, sf_dir, "documents").select("doc_id", "lang"), by="lang", key="doc_id")


@register("SELECT doc_id, source FROM documents ORDER BY md5(doc_id::VARCHAR || ':7'), doc_id LIMIT 10")
def random_sample(spark, sf_dir):
    return tables.sample(_t(spark, sf_dir, "documents").select("doc_id", "source"), key="doc_id", n=10, seed=7)


@register(
    """
    WITH a AS (SELECT vec_id, label, (label + vec_id) % 4 AS relevance FROM embeddings),
    n AS (SELECT label, count(*) FILTER (relevance >= 2) AS p, count(*) FILTER (relevance = 0) AS z FROM a GROUP BY 1)
    SELECT label AS query_id, p * z AS n_triplets FROM n WHERE p > 0 AND z > 0
    """
)
def triplets(spark, sf_dir):
    notes = _t(spark, sf_dir, "embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("doc_id"), ((F.col("label") + F.col("vec_id")) % 4).alias("relevance"))
    return corpus.triplets(notes).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_triplets"))


@register(
    r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10) || chr(10)) AS p, string_split(coalesce(text, ''), ' ') AS w FROM documents)
    SELECT doc_id, 'whole' AS variant, sha256(text) AS sha FROM d
    UNION ALL SELECT doc_id, 'first', sha256(p[1]) FROM d
    UNION ALL SELECT doc_id, 'middle', sha256(p[len(p) // 2 + 1]) FROM d
    UNION ALL SELECT doc_id, 'half', sha256(array_to_string(w[1:greatest(1, len(w) // 2)], ' ')) FROM d
    """
)
def augment_truncation(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.explode(t.truncation_variants("text")).alias("x"))
    return rows.select("doc_id", "x.variant", F.sha2("x.text", 256).alias("sha"))


@register(
    r"""
    SELECT doc_id, count(*) AS n_sentences, sum(length(s))::BIGINT AS n_chars FROM (
      SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)))) AS s FROM documents) WHERE length(s) > 30 GROUP BY 1
    """
)
def sentences(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.explode(t.sentences("text")).alias("s"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.length("s")).alias("n_chars"))


_CLEAN = r"""regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"""
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _CLEAN = f"replace({_CLEAN}, '{_a}', '{_b}')"


@register(rf"SELECT page_id, length(c) AS n_chars, sha256(c) AS sha FROM (SELECT page_id, trim(regexp_replace({_CLEAN}, '[ \t\n\r\f\x0b]+', ' ', 'g')) AS c FROM pages)")
def html_clean(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select("page_id", t.clean_html("html").alias("c"))
    return pages.select("page_id", F.length("c").cast("long").alias("n_chars"), F.sha2("c", 256).alias("sha"))


@register("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def roundtrip_csv_jsonl(spark, sf_dir):
    """Out as bulk text and JSON lines, and back again."""
    from newsloom.sources.scratch import scratch_path

    nation = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    a, b = scratch_path(spark, "bulk"), scratch_path(spark, "lines")
    tables.write_bulk(nation, a)
    tables.write_lines(tables.read_bulk(spark, a, nation.schema), b)
    return tables.read_lines(spark, b, nation.schema)


@register(
    """
    SELECT * FROM (VALUES ('n_nationkey', 'INTEGER'), ('n_name', 'TEXT'), ('n_regionkey', 'INTEGER'), ('tags', 'TEXT[]'), ('score', 'DOUBLE PRECISION'), ('at', 'TIMESTAMP'), ('extra', 'TEXT')) AS t(name, sql_type)
    """
)
def ddl_map(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey", F.lit(None).cast("array<string>").alias("tags"), F.lit(0.0).alias("score"), F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("binary").alias("extra"))
    return spark.createDataFrame([(f.name, tables.sql_type(f.dataType)) for f in nation.schema.fields], "name string, sql_type string")


@register(
    """
    SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents
    """
)
def snapshot_update(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    new = docs.filter("doc_id % 3 = 0").select("doc_id", (F.col("n_chars") + 1).alias("n_chars"))
    return tables.apply_updates(docs, new, key="doc_id", columns=["n_chars"])


@register("SELECT count(*) AS n_rows, 5 AS n_columns FROM documents")
def dataset_info(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return docs.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(docs.columns)))


@register(
    r"""
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INTEGER AS chunk_index, s::INTEGER AS char_start, (s + length(substring(text, s + 1, 1000)))::INTEGER AS char_end, md5(substring(text, s + 1, 1000)) AS digest
    FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 800)) AS s FROM documents WHERE length(text) > 0)
    """
)
def chunk_fixed(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.chunk_fixed(docs).select(F.col("id").alias("doc_id"), "chunk_index", "char_start", "char_end", F.md5(F.col("content").cast("binary")).alias("digest"))


@register(
    """
    SELECT doc_id, count(*) AS n_chunks, sum(length(p))::BIGINT AS n_chars FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS p FROM documents) WHERE p <> '' GROUP BY 1
    """
)
def chunk_paragraph(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.chunk_paragraph(docs).groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("content")).alias("n_chars"))


@register(
    """
    WITH c AS (SELECT doc_id, length(substring(text, s + 1, 1000)) AS n FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 800)) AS s FROM documents WHERE length(text) > 0)),
    d AS (SELECT doc_id, count(*) AS k FROM c GROUP BY 1)
    SELECT (SELECT round(avg(n), 6) FROM c) AS mean_length, (SELECT quantile_cont(n, 0.5)::DOUBLE FROM c) AS median_length, (SELECT min(n) FROM c) AS min_length, (SELECT max(n) FROM c) AS max_length, min(k) AS min_chunks, max(k) AS max_chunks, round(avg(k), 6) AS mean_chunks, round(stddev_samp(k), 6) AS std_chunks FROM d
    """
)
def chunk_stats(spark, sf_dir):
    chunks = retrieval.chunk_fixed(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    sizes = chunks.agg(F.round(F.avg(F.length("content")), 6).alias("mean_length"), F.percentile(F.length("content"), 0.5).alias("median_length"), F.min(F.length("content").cast("long")).alias("min_length"), F.max(F.length("content").cast("long")).alias("max_length"))
    per = chunks.groupBy("id").count().agg(F.min("count").alias("min_chunks"), F.max("count").alias("max_chunks"), F.round(F.avg("count"), 6).alias("mean_chunks"), F.round(F.stddev_samp("count"), 6).alias("std_chunks"))
    return sizes.join(F.broadcast(per))


@register()
def chunk_recursive(spark, sf_dir):
    return retrieval.chunk_recursive(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")).select("id", "chunk_index", "char_start", "char_end")


@register()
def chunk_semantic(spark, sf_dir):
    return retrieval.chunk_semantic(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")).select("id", "chunk_index", "char_start", "char_end")


@register()
def textrank(spark, sf_dir):
    return corpus.textrank(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@register("SELECT source, count(*) AS n, count(*) FILTER (n_chars > 20000) AS n_long FROM documents GROUP BY 1")
def tail_outliers(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 20000).alias("n_long"))


@register(
    """
    SELECT label, round(least(1, greatest(0, (avg_value - 0.70) / (0.90 - 0.70))), 9)::DOUBLE AS scaled
    FROM (SELECT label, avg(abs(embedding[1]::DOUBLE)) * 5 AS avg_value FROM embeddings GROUP BY 1)
    """
)
def scaled_score(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").groupBy("label").agg((F.avg(F.abs(F.col("embedding")[0].cast("double"))) * 5).alias("x"))
    return rows.select("label", F.round(v.scaled(F.col("x"), 0.70, 0.90), 9).alias("scaled"))


@register("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def line_summary(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n_lines"))


@register("SELECT event_type, user_id % 10 AS bucket, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY event_type), 6)::DOUBLE AS share FROM events GROUP BY 1, 2")
def share_by_group(spark, sf_dir):
    by = _t(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("share", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("event_type")), 6))
