"""Queries of entity resolution: literal rows shared by both engines, and names of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import text as t
from newsloom.operators import entities, models

from .catalogue import register


def _rows(spark, values: str, columns: str):
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def _q(values: str, columns: str) -> str:
    return f"(SELECT * FROM (VALUES {values}) AS t({columns}))"


_NORM = r"trim(regexp_replace(lower(regexp_replace(strip_accents(coalesce({0}, '')), '[^\x00-\x7F]', '', 'g')), '[\s\x1c-\x1f]+', ' ', 'g'))"


def _norm(x: str) -> str:
    return _NORM.format(x)


@register(f"SELECT doc_id, sha256({_norm('text')}) AS sha FROM documents")
def normalize_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(t.normalize("text"), 256).alias("sha"))


_SLUG = f"trim(regexp_replace({_norm('name')}, '[^a-z0-9]+', '-', 'g'), '-')"


@register(
    f"""
    WITH n AS (SELECT p_partkey::BIGINT AS id, p_name AS name FROM part UNION ALL SELECT -item_id - 1, text FROM benchmark), s AS (SELECT id, name, {_SLUG} AS slug FROM n)
    SELECT id, slug, CASE WHEN length('dgb_' || slug) <= 64 THEN 'dgb_' || slug ELSE 'dgb_' || rtrim(slug[:52], '-') || '_' || sha1(name)[:6] END AS entity_id FROM s
    """
)
def slug_mint(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("name"))
    long_names = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select((-F.col("item_id") - 1).alias("id"), F.col("text").alias("name"))
    return part.unionByName(long_names).select("id", t.slugify("name").alias("slug"), t.mint_id("name").alias("entity_id"))


_YEARS = "('Feira 2011','Feira 2012'),('Museu do Vento','Museu do Vento (MV)'),('Lote 20110','Lote 20110'),('Ato 3.001/2011','Ato 3.001/2012'),('Ciclo 2011-2014','Ciclo 2014-2011'),('Mostra 1987','Mostra')"


@register(
    rf"""
    SELECT a, b, list_sort(list_distinct(regexp_extract_all(a, '\b((?:19|20)\d{{2}})\b', 1))) <> list_sort(list_distinct(regexp_extract_all(b, '\b((?:19|20)\d{{2}})\b', 1))) AS differs
    FROM {_q(_YEARS, 'a, b')}
    """
)
def year_guard(spark, sf_dir):
    return _rows(spark, _YEARS, "a, b").withColumn("differs", t.differs_by_year("a", "b"))


_NAMES = (
    "('Museu do Vento Sul','Museu do Vento Sul (MVS)'),('Oficina de Barcos e Redes (Obar)','Oficina de Barcos e Redes'),"
    "('Museu do Vento Sul e Norte','MVS'),('Coros Unidos da Serra','Coro Urbano Serrano (CUS)'),"
    "('Casa de Tintas Abertas (CTA)','Casa de Trigo e Aveia (CTA)'),('Liga das Flores (Serra)','Liga das Flores (Litoral)'),"
    "('Liga das Flores','Liga das Flores (Litoral)'),('Escola Livre (Norte)','Escola Livre (Sul)'),"
    "('Coro (Manhã)','Coro (Noite)'),('Clube Novo das Águas','Clube das Águas'),('','Museu do Vento Sul')"
)


def _base(x: str) -> str:
    stripped = rf"regexp_replace({x}, '\([^()]*\)', ' ', 'g')"
    return _norm(stripped)


@register(
    rf"""
    WITH n AS (SELECT a, b, {_base('a')} AS base_a, {_base('b')} AS base_b, list_concat(regexp_extract_all(a, '\(([^()]*)\)', 1), regexp_extract_all(b, '\(([^()]*)\)', 1)) AS groups FROM {_q(_NAMES, 'a, b')}),
    i AS (SELECT *, list_filter(list_transform(groups, lambda g: regexp_replace({_norm('g')}, '[^a-z]', '', 'g')), lambda g: g <> '') AS inside, regexp_replace(base_a, '[^a-z]', '', 'g') AS letters FROM n)
    SELECT a, b, base_a <> '' AND base_a = base_b AND len(inside) > 0
      AND len(list_filter(inside, lambda g: NOT regexp_matches(letters, array_to_string(string_split(g, ''), '.*')))) = 0 AS variant FROM i
    """
)
def acronym_variant(spark, sf_dir):
    return _rows(spark, _NAMES, "a, b").withColumn("variant", t.acronym_variant("a", "b"))


_SUBS = "('finep','financiadoradeestudoseprojetos'),('libano','ministeriodasaude'),('mec','ministeriodaeducacao'),('','abc'),('abc','')"


@register(f"SELECT needle, hay, needle <> '' AND regexp_matches(hay, array_to_string(string_split(needle, ''), '.*')) AS holds FROM {_q(_SUBS, 'needle, hay')}")
def subsequence(spark, sf_dir):
    return _rows(spark, _SUBS, "needle, hay").withColumn("holds", t.is_subsequence(F.col("needle"), F.col("hay")))


_KINDS = "('PROGRAMA'),('program'),('Decreto'),('award'),('BANANA'),('MISC'),(' org '),('PRÊMIO'),('PER')"


@register(
    f"""
    SELECT label, CASE WHEN k IN ('PROGRAM','PROGRAMA','DECRETO','DECREE') THEN 'POLICY' WHEN k IN ('AWARD','PREMIO','PRÊMIO') THEN 'EVENT'
      WHEN k IN ('ORG','PER','LOC','EVENT','POLICY','LAW','WORK','PRODUCT') THEN k END AS kind FROM (SELECT label, upper(trim(label)) AS k FROM {_q(_KINDS, 'label')})
    """
)
def sanctioned_types(spark, sf_dir):
    return _rows(spark, _KINDS, "label").withColumn("kind", t.sanctioned_type("label"))


_TOK = f"list_distinct(list_filter(string_split({_norm('p_name')}, ' '), lambda x: x <> ''))"


@register(
    f"""
    WITH r AS (SELECT p_partkey::VARCHAR AS id, CASE WHEN p_size % 2 = 0 THEN 'LAW' ELSE 'ORG' END AS kind, {_TOK} AS tok FROM part),
    pairs AS (SELECT a.kind AS type, a.id AS id_a, b.id AS id_b, len(list_intersect(a.tok, b.tok))::DOUBLE / len(list_distinct(list_concat(a.tok, b.tok))) AS similarity
              FROM r a JOIN r b ON a.kind = b.kind AND a.id < b.id AND list_has_any(a.tok, b.tok))
    SELECT type, id_a, id_b, round(similarity, 9) AS similarity FROM pairs WHERE similarity >= CASE type WHEN 'LAW' THEN 0.75 ELSE 0.85 END
    """
)
def jaccard_pairs(spark, sf_dir):
    """Near-duplicate names of parts by type, through prefix-filtered tokens."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    reg = part.select(F.col("p_partkey").cast("string").alias("entity_id"), F.col("p_name").alias("canonical_name"), F.when(F.col("p_size") % 2 == 0, "LAW").otherwise("ORG").alias("type"))
    found, members = entities.duplicate_classes(reg)
    found = found.filter(~F.col("by_acronym")).select("type", "class_a", "class_b", F.round("similarity", 9).alias("similarity"))
    return entities.class_members(found, members)


_REG = (
    "('Q1','Ministério da Educação','ORG',1),('dgb_mec','Ministério da Educação (MEC)','ORG',3),('dgb_bc','Banco Central do Brasil','ORG',1),('dgb_bb','Banco do Brasil','ORG',2),"
    "('dgb_enem25','Enem 2025','EVENT',1),('dgb_enem26','Enem 2026','EVENT',1),('dgb_x','Lei nº 14.967 de Segurança','LAW',1),('dgb_y','Lei nº 14.967 da Segurança de','LAW',4)"
)


@register("SELECT * FROM (VALUES ('ORG', 'Q1', 'dgb_mec', 'dgb_mec', 'Q1', true), ('LAW', 'dgb_x', 'dgb_y', 'dgb_x', 'dgb_y', false)) AS t(type, id_a, id_b, source, target, by_acronym)")
def dedup_candidates(spark, sf_dir):
    reg = _rows(spark, _REG, "entity_id, canonical_name, type, n_aliases")
    pairs = entities.duplicate_candidates(reg)
    pairs = pairs.select("type", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "by_acronym")
    return entities.merge_targets(pairs, reg.select("entity_id", "n_aliases")).select("type", "id_a", "id_b", "source", "target", "by_acronym")


_MERGES = "('dgb_b','dgb_a'),('dgb_a','Q9'),('dgb_d','dgb_c'),('dgb_z','dgb_y')"


@register("SELECT * FROM (VALUES ('dgb_b','Q9'),('dgb_a','Q9'),('dgb_d','dgb_c'),('dgb_z','dgb_y')) AS t(source, target)")
def merge_targets(spark, sf_dir):
    return entities.merge_map(_rows(spark, _MERGES, "source, target"))


_MENTIONS = "('u1','FINEP','ORG'),('u2','finep','ORG'),('u3','Finep','ORG'),('u4','Copa do  Mundo','EVENT'),('u5','CAIXA econômica','ORG'),('u6','Lula','PER'),('u7','','ORG'),('u8','X',NULL)"
_TERMINAL, _ALIAS = "('lula','PER')", "('caixa economica','ORG','Q7')"


@register(
    f"""
    WITH m AS (SELECT {_norm('surface')} AS surface_norm, type, sample FROM {_q(_MENTIONS, 'sample, surface, type')} WHERE surface <> '' AND type IS NOT NULL)
    SELECT surface_norm, type, min(sample) AS sample_unique_id, 'pending' AS status FROM m
    WHERE (surface_norm, type) NOT IN (('lula','PER'),('caixa economica','ORG')) GROUP BY 1, 2
    """
)
def gather_forms(spark, sf_dir):
    return entities.gather_forms(_rows(spark, _MENTIONS, "sample, surface, type"), _rows(spark, _TERMINAL, "surface_norm, type"), _rows(spark, _ALIAS, "alias_norm, type, entity_id"))


@register(
    """
    SELECT word, role, count(*) AS n FROM (SELECT role, unnest(string_split(text, ' ')) AS word FROM conversations) WHERE word <> '' GROUP BY 1, 2 HAVING count(*) >= 5
    """
)
def gather_words(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("role", F.explode(F.split("text", " ")).alias("word")).filter("word <> ''")
    return rows.groupBy("word", "role").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")


_GATES = (
    "(1,true,0.99D,'ORG','A',array('Q1'),NULL,NULL),(2,false,0.9D,'ORG','B',array('Q1'),NULL,NULL),(3,false,0.9D,'ORG','Banco Novo',array(),NULL,NULL),(4,false,0.6D,'ORG','D',array('Q1','Q2'),'Q2',0.8D),"
    "(5,false,0.6D,'ORG','E',array('Q1','Q2'),'Q3',0.9D),(6,false,0.9D,'PER','F',array('Q1'),'Q1',0.7D),(7,false,0.95D,'PER','G',array(),NULL,NULL),(8,false,0.5D,'LAW','H',array(),NULL,NULL),(9,false,0.9D,'ORG','I',array('Q1','Q2'),'Q1',0.69D)"
)
_GATES_DUCK = _GATES.replace("array(", "list_value(").replace("D,", "::DOUBLE,").replace("D)", "::DOUBLE)")


@register(
    f"""
    WITH g AS (SELECT *, len(c) AS n, len(c) > 1 OR conf < 0.85 OR type = 'PER' AS hard, coalesce(list_contains(c, chosen) AND cc >= 0.70, false) AS picked FROM {_q(_GATES_DUCK, 'id, bad, conf, type, form, c, chosen, cc')}),
    a AS (SELECT *, CASE WHEN bad THEN 'drop' WHEN NOT hard AND n = 1 THEN 'link' WHEN NOT hard AND n = 0 THEN 'internal' WHEN n >= 1 AND picked THEN 'link' ELSE 'needs_review' END AS action FROM g)
    SELECT id, action, CASE WHEN action = 'needs_review' THEN action ELSE 'resolved' END AS status,
      CASE action WHEN 'link' THEN CASE WHEN hard THEN chosen ELSE c[1] END WHEN 'internal' THEN 'dgb_banco-novo' END AS entity_id,
      CASE action WHEN 'link' THEN 'wikidata' WHEN 'internal' THEN 'llm' END AS provenance FROM a
    """
)
def gates_truth_table(spark, sf_dir):
    rows = _rows(spark, _GATES, "id, not_an_entity, confidence, type, form, candidates, chosen, chosen_confidence")
    rows = rows.withColumn("candidates", F.col("candidates").cast("array<string>"))
    return entities.gates(rows).select("id", "action", "status", "entity_id", "provenance")


_OLD = "('e1','Finep','ORG',NULL,'old text',0.8D),('e2','MEC','ORG','Q2',NULL,0.9D),('e3','Inep','ORG',NULL,NULL,NULL)"
_NEW = "('e1','FINEP','LAW','Q1',NULL,0.9D),('e2','Mec','ORG','Q9','new text',0.1D),('e4','Copa','EVENT',NULL,'cup',NULL)"
_COLS = "entity_id, canonical_name, type, wikidata_id, description, confidence"
_D = lambda s: s.replace("D)", "::DOUBLE)")


@register(
    f"""
    SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, coalesce(a.canonical_name, b.canonical_name) AS canonical_name, coalesce(a.type, b.type) AS type, coalesce(a.wikidata_id, b.wikidata_id) AS wikidata_id,
      coalesce(b.description, a.description) AS description,
      CASE WHEN a.entity_id IS NOT NULL AND b.entity_id IS NOT NULL THEN greatest(coalesce(a.confidence, 0), coalesce(b.confidence, 0)) ELSE coalesce(a.confidence, b.confidence) END AS confidence
    FROM {_q(_D(_OLD), _COLS)} a FULL JOIN {_q(_D(_NEW), _COLS)} b ON a.entity_id = b.entity_id
    """
)
def registry_upsert(spark, sf_dir):
    return entities.registry_upsert(_rows(spark, _OLD, _COLS), _rows(spark, _NEW, _COLS))


_AL_OLD, _AL_NEW = "('mec','ORG','dgb_mec'),('caixa','ORG','Q7'),('bb','ORG','dgb_bb')", "('mec','ORG','Q1'),('caixa','ORG','Q8'),('bb','ORG','dgb_aa'),('inep','ORG','dgb_inep'),('bb','ORG','dgb_bb')"


@register("SELECT * FROM (VALUES ('mec','ORG','Q1',true,1::BIGINT),('caixa','ORG','Q7',false,1),('bb','ORG','dgb_bb',false,1),('inep','ORG','dgb_inep',false,0)) AS t(alias_norm, type, entity_id, promoted, contenders)")
def alias_add(spark, sf_dir):
    c = "alias_norm, type, entity_id"
    return entities.alias_add(_rows(spark, _AL_OLD, c), _rows(spark, _AL_NEW, c))


_FEAT = "('a1','Finep','ORG','','dgb_b'),('a1','Copa','EVENT','Copa do Mundo',NULL),('a2','MEC','ORG','','dgb_d'),('a2','X','ORG','X','Q5'),('a3','Sem tema','ORG','',NULL)"


def _features(spark):
    rows = _rows(spark, _FEAT, "unique_id, text, type, forma_canonica, canonical_id")
    return rows.groupBy("unique_id").agg(F.array_sort(F.collect_list(F.struct("text", "type", "forma_canonica", "canonical_id"))).alias("entities"))


@register("SELECT * FROM (VALUES ('a1','Finep','Q9',true),('a1','Copa',NULL,true),('a2','MEC','dgb_c',true),('a2','X','Q5',true),('a3','Sem tema',NULL,false)) AS t(unique_id, text, canonical_id, changed)")
def merge_map_apply(spark, sf_dir):
    out = entities.rewrite_mentions(_features(spark), entities.merge_map(_rows(spark, _MERGES, "source, target")))
    return out.select("unique_id", "changed", F.explode("entities").alias("e")).select("unique_id", "e.text", "e.canonical_id", "changed")


@register("SELECT * FROM (VALUES ('a1','Finep','Q_FINEP',true,2::BIGINT),('a1','Copa','Q_COPA',true,2),('a2','MEC','dgb_d',false,0),('a2','X','Q5',false,0),('a3','Sem tema',NULL,false,0)) AS t(unique_id, text, canonical_id, changed, n_linked)")
def gazetteer_backfill(spark, sf_dir):
    aliases = _rows(spark, "('finep','ORG','Q_FINEP'),('copa do mundo','EVENT','Q_COPA'),('mec','EVENT','Q_NO')", "alias_norm, type, entity_id")
    out = entities.backfill(_features(spark), aliases)
    return out.select("unique_id", "changed", "n_linked", F.explode("entities").alias("e")).select("unique_id", "e.text", "e.canonical_id", "changed", "n_linked")


@register("SELECT * FROM (VALUES ('a','needs_review'),('b','model'),('c','model')) AS t(surface_norm, path)")
def person_fast_path(spark, sf_dir):
    forms = _rows(spark, "('a','PER'),('b','PER'),('c','ORG')", "surface_norm, type")
    return entities.person_fast_path(forms, _rows(spark, "('b','Q1')", "surface_norm, qid")).select("surface_norm", "path")


@register("SELECT * FROM (VALUES ('Ministério da Educação (MEC)','ORG','e1'),('Copa do Mundo Feminina','EVENT','e3')) AS t(name, type, entity_id)")
def reuse_by_name(spark, sf_dir):
    reg = _rows(spark, "('e1','Ministério da Educação','ORG'),('e2','Banco Central do Brasil','ORG'),('e3','Copa do Mundo Feminina','EVENT'),('e4','Copa do Mundo 2026','EVENT')", "entity_id, canonical_name, type")
    probes = _rows(spark, "('Ministério da Educação (MEC)','ORG'),('Banco do Brasil','ORG'),('Copa do Mundo Feminina','EVENT'),('Copa do Mundo 2022','EVENT')", "name, type")
    return entities.reuse_by_name(probes, reg).select("name", "type", "entity_id")


_LEVELS = "('01','01.02','01.02.03'),('01','02.01',NULL),('02',NULL,NULL),(NULL,'01.01',NULL),('03','03.01','03.02.01'),('01',NULL,'01.01.01')"


@register("SELECT * FROM (VALUES ('01','01.02','01.02.03',true),('01','02.01',NULL,false),('02',NULL,NULL,true),(NULL,'01.01',NULL,false),('03','03.01','03.02.01',false),('01',NULL,'01.01.01',false)) AS t(l1, l2, l3, holds)")
def code_hierarchy_check(spark, sf_dir):
    return _rows(spark, _LEVELS, "l1, l2, l3").withColumn("holds", t.hierarchy_holds("l1", "l2", "l3"))


@register("SELECT * FROM (VALUES ('Resposta: 03 - Saúde','03'),('12a','12'),('nada',NULL),('x99y','99')) AS t(reply, code)")
def level1_codes(spark, sf_dir):
    return _rows(spark, "('Resposta: 03 - Saúde'),('12a'),('nada'),('x99y')", "reply").withColumn("code", t.level1_code("reply"))


@register(
    """SELECT * FROM (VALUES (1,'01','01.01','01.01.01','sum','positive',0.9::DOUBLE),(2,'02',NULL,NULL,NULL,NULL,NULL),(3,NULL,NULL,NULL,NULL,NULL,NULL),(4,NULL,NULL,NULL,NULL,NULL,NULL)) AS t(id, l1, l2, l3, summary, label, score)"""
)
def parse_theme_json(spark, sf_dir):
    full = '{"theme_1_level_1_code":"01","theme_1_level_2_code":"01.01","theme_1_level_3_code":"01.01.01","summary":"sum","sentiment":{"label":"positive","score":0.9}}'
    rows = spark.createDataFrame([(1, f"Claro!\n```json\n{full}\n```"), (2, '{"theme_1_level_1_code":"02"}'), (3, "sem json"), (4, "{broken")], "id int, raw string")
    p = rows.select("id", models.parse_theme(F.col("raw")).alias("p"))
    return p.select("id", F.col("p.theme_1_level_1_code").alias("l1"), F.col("p.theme_1_level_2_code").alias("l2"), F.col("p.theme_1_level_3_code").alias("l3"), "p.summary", "p.sentiment.label", "p.sentiment.score")


@register(
    """SELECT * FROM (VALUES (1,'Finep','ORG',2,'Finep',1.0::DOUBLE),(1,'Plano','POLICY',1,'Plano Safra',NULL),(2,'Ana','PER',1,'Ana',NULL)) AS t(id, text, type, count, forma_canonica, salience)"""
)
def parse_entities_json(spark, sf_dir):
    rows = spark.createDataFrame(
        [
            (1, 'ok {"entities":[{"text":"Finep","type":"org","count":"2","salience":"3.5"},{"text":"Plano","type":"Programa","forma_canonica":"Plano Safra","count":"-4","salience":"x"},{"text":"b","type":"BANANA"}]}'),
            (2, '[{"text":"Ana","type":"PER"}]'), (3, "nada"), (4, '{"entities": 5}'),
        ],
        "id int, raw string",
    )
    return rows.select("id", F.explode(models.parse_mentions(F.col("raw"))).alias("m")).select("id", "m.*")


@register("""SELECT * FROM (VALUES (1,'{"a":1}'),(2,'{"raw_text":"prosa livre"}')) AS t(id, stored)""")
def json_fallback(spark, sf_dir):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, "prosa livre")], "id int, raw string")
    return rows.select("id", models.raw_object(F.col("raw")).alias("stored"))


@register(
    """SELECT * FROM (VALUES (1,'Ministério','ORG',1.0::DOUBLE,2,false),(2,'forma',NULL,0.0::DOUBLE,1,false),(3,'forma',NULL,0.0::DOUBLE,1,true)) AS t(id, canonical_name, type, confidence, n_aliases, not_an_entity)"""
)
def parse_canon_json(spark, sf_dir):
    rows = spark.createDataFrame([(1, '{"canonical_name":"Ministério","type":"org","aliases":["MEC"," "],"confidence":"2.0"}'), (2, "???"), (3, '{"type":"BANANA","confidence":"-5","not_an_entity":true}')], "id int, raw string")
    return rows.select("id", models.parse_canon(F.col("raw"), F.lit("forma")).alias("c")).select("id", "c.canonical_name", "c.type", "c.confidence", F.size("c.aliases").alias("n_aliases"), "c.not_an_entity")


@register("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS n FROM events")
def usage_from_json(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return ev.withColumn("n", models.usage(F.col("k")))


@register("SELECT doc_id, sha256('Extraia as entidades.' || chr(10) || 'Título: ' || source || chr(10) || 'Conteúdo: ' || text[:3000]) AS prompt_hash FROM documents")
def prompt_hashes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", t.prompt_hash(models.ner_prompt(F.col("source"), F.col("text"))).alias("prompt_hash"))


@register("SELECT * FROM (VALUES ('Q1','e1'),('Q2','Q2')) AS t(qid, entity_id)")
def public_id_lookup(spark, sf_dir):
    reg = _rows(spark, "('e1','Q1'),('Q2','Q2'),('e3',NULL),('e9','Q2')", "entity_id, wikidata_id")
    return entities.find_by_public_id(_rows(spark, "('Q1'),('Q2'),('Q7')", "qid"), reg)


@register("SELECT * FROM (VALUES ('Q9','A','a|b|c|d','Q9','from b'),('dgb_c','C','c1|d1',NULL,NULL),('dgb_y','Y','','Q4','why'),('dgb_n','N','n',NULL,NULL)) AS t(entity_id, canonical_name, aliases, wikidata_id, description)")
def registry_merge(spark, sf_dir):
    reg = _rows(
        spark,
        "('Q9','A',array('a','b'),'Q9',NULL),('dgb_a','A1',array('c'),NULL,NULL),('dgb_b','B',array('d','a'),NULL,'from b'),('dgb_c','C',array('c1'),NULL,NULL),('dgb_d','D',array('d1'),NULL,NULL),"
        "('dgb_y','Y',NULL,NULL,'why'),('dgb_z','Z',array(),'Q4','zed'),('dgb_n','N',array('n'),NULL,NULL)",
        "entity_id, canonical_name, aliases, wikidata_id, description",
    )
    out = entities.merge_registry(reg, entities.merge_map(_rows(spark, _MERGES, "source, target")))
    return out.withColumn("aliases", F.array_join("aliases", "|"))


@register("SELECT * FROM (VALUES ('a','ORG','Q9'),('b','ORG','Q9'),('n','ORG','dgb_n')) AS t(alias_norm, type, entity_id)")
def alias_redirect(spark, sf_dir):
    al = _rows(spark, "('a','ORG','dgb_a'),('a','ORG','Q9'),('b','ORG','dgb_b'),('n','ORG','dgb_n')", "alias_norm, type, entity_id")
    return entities.merge_aliases(al, entities.merge_map(_rows(spark, _MERGES, "source, target")))


@register("SELECT * FROM (VALUES ('c',1),('a',2),('n',3)) AS t(surface_norm, place)")
def work_queue(spark, sf_dir):
    state = _rows(spark, "('a','pending',1,'2024-01-02'),('b','resolved',0,'2024-01-01'),('c','pending',0,'2024-01-01'),('d','pending',9,'2023-01-01'),('n','pending',0,NULL)", "surface_norm, status, attempts, first_seen_at")
    rows = entities.queue(state, limit=10).select("surface_norm", F.col("first_seen_at").alias("s"))
    from pyspark.sql import Window

    return rows.select("surface_norm", F.row_number().over(Window.orderBy(F.col("s").asc_nulls_last(), "surface_norm")).alias("place"))


@register("SELECT * FROM (VALUES ('a','resolved','Q1',0,NULL),('b','pending',NULL,2,'boom'),('c','pending',NULL,0,NULL)) AS t(surface_norm, status, entity_id, attempts, last_error)")
def queue_outcomes(spark, sf_dir):
    state = _rows(spark, "('a','ORG','pending',NULL,0,NULL,'2024'),('b','ORG','pending',NULL,1,'old','2024'),('c','ORG','pending',NULL,0,NULL,'2024')", "surface_norm, type, status, entity_id, attempts, last_error, first_seen_at")
    state = state.withColumn("entity_id", F.col("entity_id").cast("string")).withColumn("last_error", F.col("last_error").cast("string"))
    out = _rows(spark, "('a','ORG','resolved','Q1',NULL),('b','ORG','resolved',NULL,'boom')", "surface_norm, type, status, entity_id, error")
    return entities.record_outcomes(state, out).select("surface_norm", "status", "entity_id", "attempts", "last_error")


@register("SELECT * FROM (VALUES ('Q10','Finep','Q155',true,'Q1|Q2'),('Q11','Other',NULL,false,''),('Q12','Autre','Q30',false,'Q5')) AS t(qid, label, country, country_is_br, instance_of)")
def claims(spark, sf_dir):
    say = lambda *q: "[" + ",".join('{"mainsnak":{"datavalue":{"value":{"id":"%s"}}}}' % i for i in q) + "]"
    rows = [("Q10", {"en": "x", "pt": "Finep"}, '{"P17":%s,"P31":%s}' % (say("Q155", "Q30"), say("Q1", "Q2"))), ("Q11", {"en": "Other"}, "{}"), ("Q12", {"fr": "Autre"}, '{"P17":%s,"P31":%s}' % (say("Q30"), say("Q5")))]
    from newsloom.operators import knowledge

    out = knowledge.with_claims(spark.createDataFrame(rows, "qid string, labels map<string,string>, claims string"))
    return out.withColumn("instance_of", F.array_join("instance_of", "|"))


@register("SELECT * FROM (VALUES ('finep','ORG','Q2|Q1'),('lula','PER','')) AS t(surface_norm, type, candidates)")
def search_candidates(spark, sf_dir):
    from newsloom.operators import knowledge

    out = knowledge.candidates(_rows(spark, "('finep','ORG'),('lula','PER')", "surface_norm, type"), _rows(spark, "('Q1','FINEP',2),('Q2','Finep',1),('Q3','Outra',1)", "qid, name, place"))
    return out.select("surface_norm", "type", F.array_join("candidates", "|").alias("candidates"))


_TOPICS = "('01.01.01','Política Fiscal','Economia'),('01.01.02','Juros','Economia'),('03.01.01','Vacinas','Saúde')"


@register("SELECT * FROM (VALUES ('01.01.02','01.01.02'),('03.01.01 - Vacinas','03.01.01'),('politica fiscal','01.01.01'),('economia','01.01.01'),('???','20.01.01')) AS t(said, code)")
def category_cascade(spark, sf_dir):
    from newsloom.operators import taxonomy

    rows = _rows(spark, "('01.01.02'),('03.01.01 - Vacinas'),('politica fiscal'),('economia'),('???')", "said")
    return taxonomy.categorised(rows, _rows(spark, _TOPICS, "code, name, area"), said="said", default="20.01.01")


@register(
    f"""
    WITH t AS (SELECT n_nationkey::VARCHAR AS code, lower(n_name) AS name, lower(r_name) AS area FROM nation JOIN region ON n_regionkey = r_regionkey),
    k AS (SELECT code, 0 AS way, code AS said FROM t UNION ALL SELECT code, 1, code || ' - ' || name FROM t UNION ALL SELECT code, 2, name FROM t UNION ALL SELECT code, 3, area FROM t),
    b AS (SELECT said, arg_min(code, (way, code)) AS code FROM k GROUP BY 1),
    p AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN n_nationkey::VARCHAR WHEN 1 THEN n_nationkey || ' -  ' || n_name WHEN 2 THEN n_name WHEN 3 THEN r_name ELSE 'nowhere' END AS said
          FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT c_custkey, coalesce(code, 'none') AS code FROM p LEFT JOIN b ON b.said = {_norm('p.said')}
    """
)
def categories_of_customers(spark, sf_dir):
    """The cascade over a table: nations as topics, regions as their areas."""
    from newsloom.operators import taxonomy

    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    places = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    topics = places.select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"), F.col("r_name").alias("area"))
    rows = read("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    k, code = F.col("c_custkey") % 5, F.col("n_nationkey").cast("string")
    said = F.when(k == 0, code).when(k == 1, F.concat(code, F.lit(" -  "), "n_name")).when(k == 2, F.col("n_name")).when(k == 3, F.col("r_name")).otherwise("nowhere")
    return taxonomy.categorised(rows.select("c_custkey", said.alias("said")), topics, said="said", default="none").select("c_custkey", "code")


@register("SELECT * FROM (VALUES ('As eleições municipais do Brasil','eleicao|municipal|brasil'),('de a o',''),('Papéis e leis','papel|leis')) AS t(q, terms)")
def search_terms(spark, sf_dir):
    rows = _rows(spark, "('As eleições municipais do Brasil'),('de a o'),('Papéis e leis')", "q")
    return rows.select("q", F.array_join(t.search_terms("q"), "|").alias("terms"))
