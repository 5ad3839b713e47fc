"""Queries of state tables, reports and model plumbing, over the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as t
from newsloom.operators import corpus, entities, knowledge, ledger, metrics, models, retrieval
from newsloom.sources import tables

from .catalogue import register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(c: str):
    return F.col(c).cast("string")


# JSON and mentions

_FEATURE = """CASE event_id % 4 WHEN 0 THEN '{"entities":null,"n":' || event_id || '}' WHEN 1 THEN '{"n":' || event_id || '}' WHEN 2 THEN '{"entities":[1,2],"has_image":true}' END"""


def _feature():
    k, i = F.col("event_id") % 4, _s("event_id")
    return F.when(k == 0, F.concat(F.lit('{"entities":null,"n":'), i, F.lit("}"))).when(k == 1, F.concat(F.lit('{"n":'), i, F.lit("}"))).when(k == 2, F.lit('{"entities":[1,2],"has_image":true}'))


@register(f"SELECT event_id FROM (SELECT event_id, {_FEATURE} AS f FROM events) WHERE f IS NOT NULL AND list_contains(json_keys(f), 'entities')")
def features_with_entities(spark, sf_dir):
    """Rows whose JSON object has the key, also with a null value; a null object has none."""
    return entities.with_entities(_t(spark, sf_dir, "events").select("event_id", _feature().alias("features"))).select("event_id")


@register(
    f"""
    WITH f AS (SELECT event_id, {_FEATURE} AS old, '{{"n":0,"extra":"' || event_type || '"}}' AS new FROM events), m AS (SELECT event_id, json_merge_patch(coalesce(old, '{{}}'), new) AS m, old FROM f)
    SELECT event_id, (m->>'n')::BIGINT AS n, m->>'extra' AS extra, json_array_length(m->'entities')::INTEGER AS n_entities, coalesce((m->>'has_image')::BOOLEAN, false) AS has_image FROM m
    """
)
def features_merged(spark, sf_dir):
    """A shallow merge in which keys of the new object win and others stay."""
    rows = _t(spark, sf_dir, "events").select("event_id", _feature().alias("old"), F.concat(F.lit('{"n":0,"extra":"'), "event_type", F.lit('"}')).alias("new"))
    m = rows.select("event_id", F.from_json(entities.merge_features(F.col("old"), F.col("new")), "n long, extra string, entities array<int>, has_image boolean").alias("m"))
    size = F.coalesce(F.when(F.col("m.entities").isNotNull(), F.size("m.entities")), F.when((F.col("event_id") % 4) == 0, F.lit(0)))
    return m.select("event_id", "m.n", "m.extra", size.alias("n_entities"), F.coalesce("m.has_image", F.lit(False)).alias("has_image"))


def _mentions(spark, sf_dir) -> DataFrame:
    """Orders as articles, their suppliers as mentioned entities; orders divisible by 10 mention nothing, by 32 hold null."""
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    supplier = F.concat(F.lit("e"), _s("l_suppkey"))
    entity = F.struct(supplier.alias("text"), F.lit("ORG").alias("type"), F.lit(None).cast("string").alias("forma_canonica"), F.when(F.col("l_linenumber") < 4, supplier).alias("canonical_id"))
    found = lines.groupBy(F.col("l_orderkey").alias("unique_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", entity.alias("e")))), lambda x: x["e"]).alias("entities"))
    own = F.when(F.col("unique_id") % 32 == 0, F.lit(None)).when(F.col("unique_id") % 10 == 0, F.slice("entities", 1, 0)).otherwise(F.col("entities"))
    return found.withColumn("entities", own)


_MENTIONS = "m AS (SELECT l_orderkey AS unique_id, l_linenumber AS k, 'e' || l_suppkey AS name, CASE WHEN l_linenumber < 4 THEN 'e' || l_suppkey END AS id FROM lineitem WHERE l_orderkey % 32 <> 0 AND l_orderkey % 10 <> 0)"


@register(f"WITH {_MENTIONS} SELECT DISTINCT unique_id FROM m JOIN supplier ON id = 'e' || s_suppkey WHERE s_nationkey < 5")
def mentions_of_entities(spark, sf_dir):
    ids = _t(spark, sf_dir, "supplier").filter("s_nationkey < 5").select(F.concat(F.lit("e"), _s("s_suppkey")).alias("entity_id"))
    return entities.mentions_of(_mentions(spark, sf_dir), ids).select("unique_id")


@register(f"WITH {_MENTIONS} SELECT unique_id, id AS entity_id, count(*) AS n FROM m WHERE id IS NOT NULL AND id NOT IN (SELECT 'e' || s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0) GROUP BY 1, 2")
def orphan_mentions(spark, sf_dir):
    """Mentions of entities that the registry does not know."""
    registry = _t(spark, sf_dir, "supplier").filter("s_suppkey % 3 <> 0").select(F.concat(F.lit("e"), _s("s_suppkey")).alias("entity_id"))
    return entities.orphans(_mentions(spark, sf_dir), registry).groupBy("unique_id", "entity_id").agg(F.count(F.lit(1)).alias("n"))


@register(
    f"""
    WITH {_MENTIONS}, a AS (SELECT 'e' || s_suppkey AS alias_norm, 'Q' || s_suppkey AS entity_id FROM supplier WHERE s_suppkey % 2 = 0),
    l AS (SELECT unique_id, k, name, coalesce(a.entity_id, id) AS now, a.entity_id IS NOT NULL AS linked, coalesce(a.entity_id, id) IS DISTINCT FROM id AS differs FROM m LEFT JOIN a ON name = alias_norm)
    SELECT o.l_orderkey AS unique_id, coalesce(bool_or(differs), false) AS changed, count(*) FILTER (linked) AS n_linked,
      CASE WHEN o.l_orderkey % 32 <> 0 THEN coalesce(string_agg(coalesce(now, '-'), '|' ORDER BY k, name) FILTER (l.unique_id IS NOT NULL), '') END AS ids
    FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN l ON l.unique_id = o.l_orderkey GROUP BY 1
    """
)
def backfill_all(spark, sf_dir):
    """Back-fill over a table of documents: those without mentions come out too, null and empty as they were."""
    aliases = _t(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.concat(F.lit("e"), _s("s_suppkey")).alias("alias_norm"), F.lit("ORG").alias("type"), F.concat(F.lit("Q"), _s("s_suppkey")).alias("entity_id"))
    out = entities.backfill(_mentions(spark, sf_dir), aliases)
    return out.select("unique_id", "changed", "n_linked", F.array_join("entities.canonical_id", "|", "-").alias("ids"))


_MAP = "map AS (SELECT 'e' || s_suppkey AS source, 'e' || (s_suppkey - s_suppkey % 4) AS target FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey > 4)"


def _merges(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    return _t(spark, sf_dir, "supplier").filter((k % 4 != 0) & (k > 4)).select(F.concat(F.lit("e"), _s("s_suppkey")).alias("source"), F.concat(F.lit("e"), (k - k % 4).cast("string")).alias("target"))


@register(f"WITH {_MENTIONS}, {_MAP} SELECT unique_id, string_agg(coalesce(target, id, '-'), '|' ORDER BY k, name) AS ids, coalesce(bool_or(target IS NOT NULL), false) AS changed FROM m LEFT JOIN map ON id = source GROUP BY 1")
def merged_mentions(spark, sf_dir):
    out = entities.rewrite_mentions(_mentions(spark, sf_dir), _merges(spark, sf_dir)).filter("size(entities) > 0")
    return out.select("unique_id", F.array_join("entities.canonical_id", "|", "-").alias("ids"), "changed")


_ALIASES = "al AS (SELECT DISTINCT 'p' || l_partkey % 40 AS alias_norm, l_returnflag AS type, 'e' || l_suppkey AS entity_id FROM lineitem WHERE l_orderkey % 3 = 0)"


def _aliases(spark, sf_dir) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").filter("l_orderkey % 3 = 0")
    return rows.select(F.concat(F.lit("p"), (F.col("l_partkey") % 40).cast("string")).alias("alias_norm"), F.col("l_returnflag").alias("type"), F.concat(F.lit("e"), _s("l_suppkey")).alias("entity_id")).distinct()


@register(f"WITH {_ALIASES}, {_MAP} SELECT DISTINCT alias_norm, type, target AS entity_id FROM al JOIN map ON entity_id = source WHERE NOT EXISTS (SELECT 1 FROM al b WHERE b.alias_norm = al.alias_norm AND b.type = al.type AND b.entity_id = target)")
def alias_moves(spark, sf_dir):
    """Aliases of merged entities that their target does not hold yet."""
    return entities.rename_aliases(_aliases(spark, sf_dir), _merges(spark, sf_dir))


@register(f"WITH {_ALIASES}, {_MAP} SELECT DISTINCT alias_norm, type, coalesce(target, entity_id) AS entity_id FROM al LEFT JOIN map ON entity_id = source")
def aliases_redirected(spark, sf_dir):
    return entities.merge_aliases(_aliases(spark, sf_dir), _merges(spark, sf_dir))


@register(f"WITH {_ALIASES} SELECT entity_id, count(*) AS n_aliases FROM al GROUP BY 1")
def alias_counts(spark, sf_dir):
    return entities.alias_counts(_aliases(spark, sf_dir))


@register(
    f"""
    WITH {_MAP}, r AS (SELECT 'e' || s_suppkey AS entity_id, s_name AS canonical_name, CASE WHEN s_suppkey % 3 = 0 THEN 'Q' || s_suppkey END AS wikidata_id, CASE WHEN s_suppkey % 5 = 0 THEN 'nation ' || s_nationkey END AS description FROM supplier),
    h AS (SELECT r.*, coalesce(target, entity_id) AS home FROM r LEFT JOIN map ON entity_id = source)
    SELECT home AS entity_id, arg_min(canonical_name, (entity_id <> home, entity_id)) AS canonical_name, arg_min(wikidata_id, (entity_id <> home, entity_id)) FILTER (wikidata_id IS NOT NULL) AS wikidata_id,
      arg_min(description, (entity_id <> home, entity_id)) FILTER (description IS NOT NULL) AS description, string_agg(canonical_name, '|' ORDER BY canonical_name) AS aliases FROM h GROUP BY 1
    """
)
def registry_merged(spark, sf_dir):
    """Merges over a registry of suppliers, each with its name as its alias."""
    k = F.col("s_suppkey")
    rows = _t(spark, sf_dir, "supplier").select(
        F.concat(F.lit("e"), _s("s_suppkey")).alias("entity_id"), F.col("s_name").alias("canonical_name"), F.array("s_name").alias("aliases"),
        F.when(k % 3 == 0, F.concat(F.lit("Q"), _s("s_suppkey"))).alias("wikidata_id"), F.when(k % 5 == 0, F.concat(F.lit("nation "), _s("s_nationkey"))).alias("description"),
    )
    return entities.merge_registry(rows, _merges(spark, sf_dir)).withColumn("aliases", F.array_join("aliases", "|"))


@register(
    f"""
    WITH {_ALIASES}, n AS (SELECT alias_norm, type, CASE WHEN l.k % 7 = 0 THEN 'Q' ELSE 'e' END || k AS entity_id FROM (SELECT DISTINCT 'p' || l_partkey % 40 AS alias_norm, l_returnflag AS type, l_suppkey AS k FROM lineitem WHERE l_orderkey % 3 = 1) l),
    b AS (SELECT *, true AS old FROM al UNION ALL SELECT *, false FROM n), w AS (SELECT *, regexp_matches(entity_id, '^Q[0-9]+$') AS q FROM b),
    o AS (SELECT alias_norm, type, arg_min(entity_id, (NOT q, NOT old, entity_id)) AS entity_id, max(entity_id) FILTER (old) AS was, count(DISTINCT entity_id) - 1 AS contenders FROM w GROUP BY 1, 2)
    SELECT alias_norm, type, entity_id, coalesce(was <> entity_id, false) AS promoted, contenders FROM o
    """
)
def alias_owners(spark, sf_dir):
    """One owner for each alias of a table of aliases, old and new."""
    rows = _t(spark, sf_dir, "lineitem").filter("l_orderkey % 3 = 1").select(F.concat(F.lit("p"), (F.col("l_partkey") % 40).cast("string")).alias("alias_norm"), F.col("l_returnflag").alias("type"), F.col("l_suppkey").alias("k")).distinct()
    new = rows.select("alias_norm", "type", F.concat(F.when(F.col("k") % 7 == 0, "Q").otherwise("e"), _s("k")).alias("entity_id"))
    return entities.alias_add(_aliases(spark, sf_dir), new)


@register(
    f"""
    WITH {_ALIASES}, q AS (SELECT alias_norm, type, 'Q' || min(entity_id)[2:] AS target FROM al GROUP BY 1, 2) SELECT DISTINCT entity_id AS source, target FROM al JOIN q USING (alias_norm, type)
    """
)
def alias_promotions(spark, sf_dir):
    """Entities that lose an alias to an id of the public base go into it."""
    old = _aliases(spark, sf_dir)
    new = old.groupBy("alias_norm", "type").agg(F.concat(F.lit("Q"), F.substr(F.min("entity_id"), F.lit(2))).alias("entity_id"))
    return entities.promotions(old, entities.alias_add(old, new))


@register("SELECT CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'new' END AS said, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'old' ELSE 'new' END AS kept FROM orders")
def earlier_entities_kept(spark, sf_dir):
    """An empty extraction keeps what was there."""
    said = F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("new")))
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", said.alias("a"), F.array(F.lit("old")).alias("b"))
    return rows.select(F.array_join("a", "").alias("said"), "o_orderkey", F.array_join(entities.keep_earlier_entities(F.col("b"), F.col("a")), "").alias("kept"))


@register(
    """
    WITH c AS (SELECT o_orderkey AS id, 'Q' || (o_orderkey % 5) AS chosen, o_custkey % 3 AS n_home FROM orders)
    SELECT id, CASE WHEN id % 5 < 3 THEN chosen END AS qid, CASE WHEN n_home = 1 THEN 'Q0' END AS home FROM c
    """
)
def homonyms_chosen(spark, sf_dir):
    """A chosen id counts only among those offered (Q0 to Q2); the only candidate of the home country is linked."""
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Q"), (F.col("o_orderkey") % 5).cast("string")).alias("chosen"), (F.col("o_custkey") % 3).alias("n_home"))
    offered = F.array(F.lit("Q0"), F.lit("Q1"), F.lit("Q2"))
    listed = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct(F.concat(F.lit("Q"), k.cast("string")).alias("qid"), (k < F.col("n_home")).alias("is_br")))
    return rows.select("id", knowledge.homonym_choice(F.col("chosen"), F.lit(0.9), offered)["qid"].alias("qid"), knowledge.single_home_candidate(listed).alias("home"))


@register("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def articles_without_reply(spark, sf_dir):
    """Documents without a logged reply for a task and prompt version."""
    log = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("unique_id"), F.lit("ner").alias("task"), F.when(F.col("quality") == 1, "v1").otherwise("v0").alias("prompt_version"))
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("unique_id"))
    return entities.without_raw(docs, log, task="ner", version="v1").select(F.col("unique_id").alias("doc_id"))


# prompts, replies, texts

@register(
    """
    WITH p AS (SELECT doc_id, 'Extraia as entidades.' || chr(10) || 'Título: ' || coalesce(source, '') || chr(10) || 'Conteúdo: ' || coalesce(text[:3000], '') AS prompt FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN sha256(prompt) END AS response FROM p
    """
)
def replies_replayed(spark, sf_dir):
    """Logged replies by prompt hash; every second document's prompt is in the log."""
    prompts = _t(spark, sf_dir, "documents").select("doc_id", models.ner_prompt(F.col("source"), F.col("text")).alias("prompt"))
    own = prompts.filter("doc_id % 2 = 0").select(t.prompt_hash("prompt").alias("prompt_hash"), t.prompt_hash("prompt").alias("raw_response"), F.lit("ner").alias("task"))
    return models.replayed(prompts, own, task="ner").select("doc_id", "response")


_LEVELS = """CASE doc_id % 4 WHEN 0 THEN 'Nível 1: 01 - ' || source || chr(10) || 'Nível 2: 01.0' || doc_id % 10 || ' - Dois - mais' || chr(10) || 'Nível 3: 01.02.03 - Três' WHEN 1 THEN 'nada' || chr(10) || 'Nível 1: 2 - Só um ' WHEN 2 THEN 'Nível 2: x - y' END"""


@register(
    """
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '01' WHEN 1 THEN '2' END AS l1, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN 'Só um' END AS label1, CASE WHEN doc_id % 4 = 0 THEN '01.0' || doc_id % 10 END AS l2,
      CASE doc_id % 4 WHEN 0 THEN '01.02.03' WHEN 1 THEN '2' END AS deepest, CASE doc_id % 4 WHEN 0 THEN 'Três' WHEN 1 THEN 'Só um' END AS deepest_label FROM documents
    """
)
def levels_parsed(spark, sf_dir):
    """Replies of lines "Nível n: code - label"; what does not match is null."""
    k, i = F.col("doc_id") % 4, F.col("doc_id")
    full = F.concat(F.lit("Nível 1: 01 - "), "source", F.lit("\nNível 2: 01.0"), (i % 10).cast("string"), F.lit(" - Dois - mais\nNível 3: 01.02.03 - Três"))
    said = F.when(k == 0, full).when(k == 1, F.lit("nada\nNível 1: 2 - Só um ")).when(k == 2, F.lit("Nível 2: x - y"))
    p = _t(spark, sf_dir, "documents").select("doc_id", models.parse_levels(said).alias("p"))
    return p.select("doc_id", F.col("p.theme_1_level_1_code").alias("l1"), F.col("p.theme_1_level_1").alias("label1"), F.col("p.theme_1_level_2_code").alias("l2"), F.col("p.most_specific_theme_code").alias("deepest"), F.col("p.most_specific_theme_label").alias("deepest_label"))


@register(
    r"""
    WITH r AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Tema 0' || event_id % 9 || '.02 aqui' WHEN 1 THEN ' 03.04x' WHEN 2 THEN 'a05.06.07b' WHEN 3 THEN 'sem' WHEN 4 THEN '0 3 - 0 ' || event_id % 10 END AS s FROM events),
    d AS (SELECT *, coalesce(s, '') AS t, regexp_replace(coalesce(s, ''), '[^0-9]', '', 'g') AS g FROM r)
    SELECT event_id, coalesce(nullif(regexp_extract(t, '\b(\d{2}\.\d{2})\b', 1), ''), nullif(regexp_extract(t, '^\s*(\d{2}\.\d{2})', 1), ''), nullif(regexp_extract(t, '(\d{2}\.\d{2})', 1), ''), CASE WHEN length(g) >= 4 THEN g[1:2] || '.' || g[3:4] END, '20.01') AS l2,
      coalesce(nullif(regexp_extract(t, '(\d{2}\.\d{2}\.\d{2})', 1), ''), CASE WHEN length(g) >= 6 THEN g[1:2] || '.' || g[3:4] || '.' || g[5:6] END) AS l3 FROM d
    """
)
def codes_of_levels(spark, sf_dir):
    """Codes of levels 2 and 3 in free replies, with all fallbacks."""
    i, k = F.col("event_id"), F.col("event_id") % 6
    a, b = F.concat(F.lit("Tema 0"), (i % 9).cast("string"), F.lit(".02 aqui")), F.concat(F.lit("0 3 - 0 "), (i % 10).cast("string"))
    said = F.when(k == 0, a).when(k == 1, F.lit(" 03.04x")).when(k == 2, F.lit("a05.06.07b")).when(k == 3, F.lit("sem")).when(k == 4, b)
    return _t(spark, sf_dir, "events").select("event_id", t.level_code(said, 2, "20.01").alias("l2"), t.level_code(said, 3).alias("l3"))


@register("SELECT event_id FROM events WHERE event_id % 5 <> 0 AND event_id NOT IN (SELECT doc_id FROM labels) ORDER BY ts DESC, event_id LIMIT 50")
def dated_backlog(spark, sf_dir):
    """The most recent rows that have a date and are not done."""
    rows = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("at"))
    done = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("event_id"))
    return corpus.recent(rows.join(done, "event_id", "left_anti"), "at", key="event_id", n=50).select("event_id")


@register("SELECT doc_id, 'v2' AS source, NULL::VARCHAR AS summary, NULL::VARCHAR AS most_specific_theme_code FROM documents")
def fallback_rows(spark, sf_dir):
    """Rows of a failed enrichment: what was merged into them stays, the enriched fields are null."""
    rows = models.row_merge(_t(spark, sf_dir, "documents").select("doc_id", "source"), {"source": F.lit("v2"), "summary": F.lit("old")})
    return models.fallback(rows).select("doc_id", "source", "summary", "most_specific_theme_code")


@register("SELECT doc_id, sha256(coalesce(source, '') || chr(10) || chr(10) || coalesce(text, '')) AS sha, sha256('Contexto: ' || source || chr(10) || chr(10) || text) AS contextual FROM documents")
def document_texts(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(corpus.document_text(F.col("source"), F.col("text")), 256).alias("sha"), F.sha2(retrieval.enrich_chunk(F.col("text"), F.col("source")), 256).alias("contextual"))


@register("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders")
def iso_dates(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", corpus.iso(F.col("o_orderdate")).alias("iso"))


@register(
    r"""
    WITH w AS (SELECT doc_id, length(text) AS n, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS k FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, n >= 50 AND k >= 3 AS enough, n > 100 AS over_100, k > 20 AS over_20 FROM w
    """
)
def long_enough_texts(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").filter("text is not null")
    return rows.select("doc_id", t.long_enough("text").alias("enough"), t.long_enough("text", 101, 0).alias("over_100"), t.long_enough("text", 0, 21).alias("over_20"))


@register("SELECT doc_id, source FROM documents WHERE n_chars <= 20000")
def without_outliers(spark, sf_dir):
    """Documents without the tail of long ones."""
    return corpus.without_tail(_t(spark, sf_dir, "documents"), F.col("n_chars"), most=20_000).select("doc_id", "source")


@register("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = 7")
def point_lookup(spark, sf_dir):
    return tables.lookup(_t(spark, sf_dir, "documents"), "doc_id", 7).select("doc_id", "lang", "n_chars")


# retrieval

@register("SELECT event_id, lang FROM events JOIN documents ON doc_id = event_id % 97 WHERE lang IN ('en', 'de')")
def chunks_of_documents(spark, sf_dir):
    """Chunks with their document's language, filtered by it; filters that are not given do nothing."""
    chunks = _t(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 97).alias("document_id"))
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return retrieval.grouped_documents(chunks, docs, filters={"lang": ["en", "de"], "source": None}).select("event_id", "lang")


@register(
    """
    WITH a AS (SELECT event_id AS id, value AS score FROM events WHERE event_id % 2 = 0), b AS (SELECT event_id AS id, value / 2 AS score FROM events WHERE event_id % 3 = 0)
    SELECT coalesce(a.id, b.id) AS id, round(0.75 * coalesce(a.score, 0) + 0.25 * coalesce(b.score, 0), 6) AS score FROM a FULL JOIN b ON a.id = b.id
    """
)
def linear_fusion(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("value").alias("score"))
    out = retrieval.linear_fusion(e.filter("id % 2 = 0"), e.filter("id % 3 = 0").withColumn("score", F.col("score") / 2), alpha=0.75)
    return out.select("id", F.round("score", 6).alias("score"))


@register(
    r"""
    WITH w AS (SELECT doc_id AS id, n_chars AS score, list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS words FROM documents)
    SELECT id, len(list_filter(['the', 'and', 'of'], lambda x: list_contains(words, x)))::DOUBLE / 3 AS rerank_score FROM w ORDER BY rerank_score DESC, score DESC, id LIMIT 50
    """
)
def lexical_rerank(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("n_chars").alias("score"))
    return retrieval.rerank(docs, "the of and", k=50).select("id", "rerank_score")


@register("SELECT event_id, greatest(0, 0.2 + (value / 200) - (user_id % 10) / 10.0::DOUBLE) AS loss FROM events")
def triplet_losses(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", corpus.triplet_loss((F.col("user_id") % 10) / F.lit(10.0), F.col("value") / 200).alias("loss"))
    return rows


@register("SELECT event_id % 8 AS attempt, 0.5 * power(2, event_id % 8)::DOUBLE AS seconds, count(*) AS n FROM events GROUP BY 1, 2")
def back_off_seconds(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select((F.col("event_id") % 8).alias("attempt"))
    return rows.withColumn("seconds", ledger.back_off(F.col("attempt"), base=0.5)).groupBy("attempt", "seconds").agg(F.count(F.lit(1)).alias("n"))


@register(
    """
    WITH w AS (SELECT event_id, event_type, coalesce(sum(user_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events)
    SELECT event_id, before + 3000 < 0.8 * 50000 AS runs FROM w
    """
)
def quota_back_pressure(spark, sf_dir):
    """Rows of each queue that still fit the model's day, 3000 tokens of whose 50000 are spent."""
    spent = spark.createDataFrame([("d1", "m", 1000, 2000), ("d0", "m", 9, 9)], "day string, model_id string, input_tokens long, output_tokens long")
    work = _t(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").alias("tokens"))
    return ledger.governed(work, spent, {"m": 50_000}, day="d1", model="m", by="event_type", order=["event_id"]).select("event_id", "runs")


@register("SELECT CAST(ts AS DATE)::VARCHAR AS day, event_type AS model_id, sum(user_id)::BIGINT AS input_tokens, sum(user_id % 7)::BIGINT AS output_tokens FROM events GROUP BY 1, 2")
def ledger_recorded(spark, sf_dir):
    """Usage added to a ledger that holds the even events' usage already."""
    rows = _t(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("model_id"), F.col("user_id").cast("long").alias("input_tokens"), (F.col("user_id") % 7).cast("long").alias("output_tokens"))
    return ledger.record_usage(ledger.daily_usage(rows.filter("event_id % 2 = 0")), rows.filter("event_id % 2 = 1"))


@register("SELECT date_trunc('year', ts)::TIMESTAMP AS year, count(*) AS n FROM events GROUP BY 1")
def events_per_year(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy(F.date_trunc("year", "ts").cast("timestamp_ntz").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@register(
    r"""
    WITH d AS (SELECT lang, n_chars, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS w, len(regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '_', 'g')), '\b(?:the|and)\b')) AS k FROM documents)
    SELECT lang, count(*) AS n_docs, sum(w)::BIGINT AS n_words, round(avg(w), 6) AS mean_words, round(avg(1000.0 * k / greatest(1, n_chars)), 6)::DOUBLE AS mean_density FROM d GROUP BY 1
    """
)
def corpus_words(spark, sf_dir):
    """Documents of each type with their words and the mean density of key words."""
    docs = _t(spark, sf_dir, "documents").select("lang", "n_chars", t.word_count("text").alias("w"), corpus.term_count(F.col("text"), ["the", "and"]).alias("k"))
    density = F.lit(1000.0) * F.col("k") / F.greatest(F.lit(1), F.col("n_chars"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("w").alias("n_words"), F.round(F.avg("w"), 6).alias("mean_words"), F.round(F.avg(density), 6).alias("mean_density"))


@register("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) + event_id % 5 AS input_tokens, user_id::BIGINT AS output_tokens FROM events")
def usage_of_two_calls(spark, sf_dir):
    """Token counts of an article's two calls together; a count that is missing or no number is 0."""
    ev = _t(spark, sf_dir, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").alias("k"))
    call = lambda a, b: F.struct(a.cast("string").alias("input_tokens"), b.cast("string").alias("output_tokens"))
    both = models.total_usage(call(F.col("k"), F.lit("x")), call(F.col("event_id") % 5, F.col("user_id")))
    return ev.select("event_id", both["input_tokens"].alias("input_tokens"), both["output_tokens"].alias("output_tokens"))


# evaluation

@register(
    """
    WITH n AS (SELECT vec_id AS doc_id, label AS query_id, vec_id % 3 AS relevance FROM embeddings WHERE vec_id % 2 = 0), r AS (SELECT label AS query_id, vec_id AS doc_id FROM embeddings)
    SELECT r.query_id, r.doc_id, coalesce(relevance, 0)::INTEGER AS relevance FROM r LEFT JOIN n ON n.query_id = r.query_id AND n.doc_id = r.doc_id
    """
)
def judged_pool(spark, sf_dir):
    """Ranked documents that nobody judged are not relevant."""
    e = _t(spark, sf_dir, "embeddings")
    notes = e.filter("vec_id % 2 = 0").select(F.col("label").alias("query_id"), F.col("vec_id").alias("doc_id"), (F.col("vec_id") % 3).cast("int").alias("relevance"))
    return metrics.judged(e.select(F.col("label").alias("query_id"), F.col("vec_id").alias("doc_id")), notes).select("query_id", "doc_id", "relevance")


@register("SELECT label AS query_id, vec_id AS doc_id, vec_id % 3 AS relevance FROM embeddings")
def annotations_nested(spark, sf_dir):
    """Annotations as a map of maps by query, and back."""
    notes = _t(spark, sf_dir, "embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("doc_id"), (F.col("vec_id") % 3).alias("relevance"))
    return corpus.flat_annotations(corpus.nested_annotations(notes))


_KINDS = "CASE WHEN label % 3 = 0 THEN 'jargon' ELSE 'general' END"


@register(
    f"""
    WITH q AS (SELECT vec_id AS query_id, {_KINDS} AS query_type, (vec_id % 10) / 10.0::DOUBLE AS ndcg, CASE WHEN vec_id % 4 > 0 THEN (vec_id % 7) / 7.0::DOUBLE END AS rr FROM embeddings)
    SELECT query_type, round(avg(ndcg), 9) AS ndcg, round(avg(coalesce(rr, 0)), 9) AS rr, count(*) AS n_queries FROM q GROUP BY 1
    """
)
def means_by_query_type(spark, sf_dir):
    """Means over queries, apart by type; a query without a measure counts as 0."""
    i = F.col("vec_id")
    rows = _t(spark, sf_dir, "embeddings").select(F.when(F.col("label") % 3 == 0, "jargon").otherwise("general").alias("query_type"), ((i % 10) / F.lit(10.0)).alias("ndcg"), F.when(i % 4 > 0, (i % 7) / F.lit(7.0)).alias("rr"))
    out = metrics.mean_over_queries(rows, ["ndcg", "rr"], by=["query_type"])
    return out.select("query_type", F.round("ndcg", 9).alias("ndcg"), F.round("rr", 9).alias("rr"), "n_queries")


@register(
    """
    WITH r AS (SELECT user_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, value AS score, event_type AS category FROM events WHERE user_id % 3 <> 0),
    b AS (SELECT query_id, count(*) AS n, max(score) AS top, arg_min(category, rank) AS category FROM r GROUP BY 1), q AS (SELECT DISTINCT user_id AS query_id FROM events)
    SELECT round(avg(coalesce((category = 'click')::INT, 0)), 9) AS match_rate, round(avg(coalesce(top, 0)), 6) AS mean_top_score, round(avg(coalesce(n, 0)), 6) AS mean_results FROM q LEFT JOIN b USING (query_id)
    """
)
def search_report(spark, sf_dir):
    from pyspark.sql import Window

    ev = _t(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    found = ev.filter("user_id % 3 <> 0").select(F.col("user_id").alias("query_id"), F.row_number().over(order).alias("rank"), F.col("value").alias("score"), F.col("event_type").alias("category"))
    out = metrics.search_report(found, ev.select(F.col("user_id").alias("query_id"), F.lit("click").alias("expected")).distinct())
    return out.select(F.round("match_rate", 9).alias("match_rate"), F.round("mean_top_score", 6).alias("mean_top_score"), F.round("mean_results", 6).alias("mean_results"))


@register(
    """
    WITH l AS (SELECT doc_id, quality, toxic FROM labels), e AS (
      SELECT 'l1' AS level, quality::VARCHAR AS truth, (doc_id % 2)::VARCHAR AS pred FROM l UNION ALL SELECT 'l2', toxic::INT::VARCHAR, CASE WHEN doc_id % 5 > 0 THEN '0' END FROM l UNION ALL SELECT 'l3', CASE WHEN doc_id % 2 = 0 THEN (doc_id % 3)::VARCHAR END, '0' FROM l)
    SELECT level, round(avg(coalesce((truth = pred)::INT, 0)), 9) AS accuracy, count(*) AS n FROM e WHERE truth IS NOT NULL GROUP BY 1
    """
)
def accuracy_by_level(spark, sf_dir):
    i = F.col("doc_id")
    rows = _t(spark, sf_dir, "labels").select(
        F.col("quality").cast("int").alias("a"), (i % 2).alias("p"), F.col("toxic").cast("int").alias("b"), F.when(i % 5 > 0, "0").alias("q"), F.when(i % 2 == 0, i % 3).alias("c"), F.lit("0").alias("r")
    )
    out = metrics.accuracy_by_level(rows, {"l1": ("a", "p"), "l2": ("b", "q"), "l3": ("c", "r")})
    return out.select("level", F.round("accuracy", 9).alias("accuracy"), "n")


@register(
    """
    WITH p AS (SELECT event_type AS truth, CASE WHEN event_id % 4 = 0 THEN 'click' ELSE event_type END AS pred FROM events), l AS (SELECT DISTINCT truth AS label FROM p),
    s AS (SELECT label, sum((truth = label AND pred = label)::INT) AS tp, sum((pred = label)::INT) AS np, sum((truth = label)::INT) AS support FROM p, l GROUP BY 1),
    m AS (SELECT support, coalesce(tp / nullif(np, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(np + support, 0), 0) AS f1 FROM s)
    SELECT round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1, round(sum(precision * support) / sum(support), 9) AS weighted_precision,
      round(sum(recall * support) / sum(support), 9) AS weighted_recall, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM m
    """
)
def averaged_f1(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(F.col("event_type").alias("truth"), F.when(F.col("event_id") % 4 == 0, "click").otherwise(F.col("event_type")).alias("pred"))
    out = metrics.averages(metrics.f1_by_label(rows))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@register(
    """
    WITH p AS (SELECT a.label, a.vec_id AS id_a, b.vec_id AS id_b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT label, count(*) AS n, round(avg(score), 6) AS mean, min(score) AS least, max(score) AS most, arg_min(id_a, (score, id_a, id_b)) AS least_a, arg_min(id_a, (-score, id_a, id_b)) AS most_a FROM p GROUP BY 1
    """
)
def score_distribution(spark, sf_dir):
    from newsloom.functions import vectors as v

    e = _t(spark, sf_dir, "embeddings")
    a, b = e.select("label", F.col("vec_id").alias("id_a"), F.col("embedding").alias("x")), e.select((F.col("vec_id") - 1).alias("id_a"), F.col("vec_id").alias("id_b"), F.col("embedding").alias("y"))
    pairs = a.join(b, "id_a").select("label", "id_a", "id_b", F.round(v.cosine(F.col("x"), F.col("y")), 6).alias("score"))
    out = corpus.score_distribution(pairs, by=["label"])
    return out.select("label", "n", F.round("mean", 6).alias("mean"), "least", "most", "least_a", "most_a")


@register(
    """
    WITH b AS (SELECT doc_id, doc_id % 50 AS base, ('0x' || md5((doc_id % 50)::VARCHAR || ':42')[:8])::BIGINT / 4294967296.0::DOUBLE AS place FROM documents)
    SELECT doc_id, base, CASE WHEN place < 0.7 THEN 'train' WHEN place < 0.7::DOUBLE + 0.1::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM b
    """
)
def split_by_base(spark, sf_dir):
    """Variants of one base query fall into one part."""
    return corpus.split_by_base(_t(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 50).alias("base")), base="base")


@register()
def lexrank(spark, sf_dir):
    return corpus.lexrank(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@register()
def stemmed_match(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.stemmed_match(docs, "the and").withColumn("rank_score", F.round("rank_score", 6))
