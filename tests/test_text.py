"""Vectors for names, ids and parsers."""

import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as t
from newsloom.functions import vectors as v
from newsloom.operators import corpus, entities, ledger, metrics, models, retrieval, taxonomy


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(x, (str, type(None))) else 'double'}" for k, x in values.items())) if values else spark.range(1)
    return frame.select(column.alias("out")).first().out


@pytest.mark.parametrize(
    "raw, want",
    [("Órgão Único de Água", "orgao unico de agua"), ("\t ZÉ  ", "ze"), ("duas   palavras", "duas palavras"), ("guarda-chuva", "guarda-chuva"), ("", ""), (None, ""), ("nº 5 ½ ﬁm", "no 5 12 fim"), ("a \x1cb", "a b")],
)
def test_normalize(spark, raw, want):
    assert one(spark, t.normalize("x"), x=raw) == want
    assert one(spark, t.normalize_exact("x"), x=raw) == want


def test_normalize_by_hand(spark):
    rng = np.random.default_rng(4)
    letters = list("aZéÃçÑ ü-_.9\t\n") + ["  ", "ª", "²"]
    rows = ["".join(rng.choice(letters, rng.integers(0, 20))) for _ in range(200)]
    by_hand = lambda s: " ".join(unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower().split())
    got = spark.createDataFrame([(k, s) for k, s in enumerate(rows)], "k int, s string").select("k", t.normalize("s").alias("a"), t.normalize_exact("s").alias("b")).collect()
    assert all(r.a == r.b == by_hand(rows[r.k]) for r in got)


def test_mint(spark):
    assert one(spark, t.mint_id("x"), x="Rio  Ímpar & Cia.") == "dgb_rio-impar-cia"
    ids = [one(spark, t.mint_id("x"), x="a" * n) for n in (0, 1, 50, 52, 53, 60, 61, 100, 500)]
    assert all(len(i) <= 64 for i in ids) and len(set(ids)) == len(ids)


def test_acronym_is_symmetric(spark):
    pairs = [("Museu do Vento Sul", "Museu do Vento Sul (MVS)", True), ("Museu do Vento Sul", "Museu do Vento", False), ("Coro (Manhã)", "Coro (Noite)", False), ("Museu do Vento Sul (XYZ)", "Museu do Vento Sul", False)]
    for a, b, want in pairs:
        assert one(spark, t.acronym_variant("a", "b"), a=a, b=b) is want
        assert one(spark, t.acronym_variant("b", "a"), a=a, b=b) is want


def test_jaccard_thresholds(spark):
    names = [("b1", "Clube Novo das Águas", "ORG"), ("b2", "Clube das Águas", "ORG")]
    reg = spark.createDataFrame(names, "entity_id string, canonical_name string, type string")
    assert entities.duplicate_candidates(reg).count() == 0
    assert [r.similarity for r in entities.duplicate_candidates(reg, limit=0.70).collect()] == [0.75]


def test_prefix_join_equals_all_pairs(spark):
    names = [f"{a} {b} {c}" for a in ("alfa", "beta", "gama") for b in ("um", "dois") for c in ("x y z", "x y w", "q")]
    reg = spark.createDataFrame([(f"e{k:02}", n, "EVENT") for k, n in enumerate(names)], "entity_id string, canonical_name string, type string")
    got = {(r.id_a, r.id_b) for r in entities.duplicate_candidates(reg, limit=0.5).collect()}
    sets = [set(n.split()) for n in names]
    want = {(f"e{i:02}", f"e{j:02}") for i in range(len(names)) for j in range(i + 1, len(names)) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.5}
    assert got == want


def test_merge_leaves_no_orphans(spark):
    pairs = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("y", "Q1"), ("z", "y")], "source string, target string")
    assert {(r.source, r.target) for r in entities.merge_map(pairs).collect()} == {("b", "a"), ("c", "a"), ("d", "a"), ("y", "Q1"), ("z", "Q1")}


def test_backfill_is_idempotent(spark):
    rows = spark.sql("select 'u' unique_id, array(named_struct('text','Finep','type','ORG','forma_canonica','','canonical_id',cast(null as string))) entities")
    aliases = spark.createDataFrame([("finep", "ORG", "Q1")], "alias_norm string, type string, entity_id string")
    once = entities.backfill(rows, aliases)
    assert once.first().changed and not entities.backfill(once.select("unique_id", "entities"), aliases).first().changed


def test_quota(spark):
    assert ledger.parse_quota('{"m": "1000", "x": "?"}') == {"m": 1000} and ledger.parse_quota("nope") == {} and ledger.parse_quota(None) == {}
    rows = spark.createDataFrame([("d1", "m", 700, 0), ("d2", "m", 800, 0), ("d3", "n", 9000, 0)], "day string, model_id string, input_tokens long, output_tokens long")
    assert [r.exhausted for r in ledger.exhausted(rows, {"m": 1000}).orderBy("day").collect()] == [False, True, False]
    assert not any(r.exhausted for r in ledger.exhausted(rows, {}).collect())


def test_ranking_vector(spark):
    rng = np.random.default_rng(7)
    lists = {f"q{k}": rng.integers(0, 4, rng.integers(1, 25)).tolist() for k in range(30)}
    rows = [(q, i + 1, int(r)) for q, rel in lists.items() for i, r in enumerate(rel)]
    for m in metrics.ranking_metrics(spark.createDataFrame(rows, "query_id string, rank int, relevance int")).collect():
        rel = lists[m.query_id]
        gain = lambda x: sum(r / np.log2(i + 2) for i, r in enumerate(x[:10]))
        hits = [i for i, r in enumerate(rel) if r]
        want = (gain(rel) / gain(sorted(rel, reverse=True)), sum((k + 1) / (i + 1) for k, i in enumerate(hits)) / len(hits), 1 / (hits[0] + 1)) if hits else (0, 0, 0)
        assert np.allclose((m.ndcg, m.ap, m.rr), want)
    empty = metrics.ranking_metrics(spark.createDataFrame([("q", 1, 0)], "query_id string, rank int, relevance int")).first()
    assert (empty.ndcg, empty.ap, empty.rr) == (0, 0, 0)


def test_lcs(spark):
    rows = spark.createDataFrame([(list("abcd"), list("acd")), ([], list("x")), (list("aaa"), list("bab"))], "a array<string>, b array<string>")
    assert [r.n for r in rows.select(metrics.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()] == [3, 0, 1]
    both = rows.select(metrics.rouge_l(F.col("a"), F.col("b")).alias("x"), metrics.rouge_l_long("a", "b").alias("y")).collect()
    assert all(abs(r.x - r.y) < 1e-12 for r in both)


def test_taxonomy_outline(spark):
    text = "01 - Economia:\n  - 01.01 - Política - Fiscal:\n    - 01.01.01 - Tributos\n03 - Saúde:\n"
    assert taxonomy.parse_outline(text) == [("01", "Economia", 1, None), ("01.01", "Política - Fiscal", 2, "01"), ("01.01.01", "Tributos", 3, "01.01"), ("03", "Saúde", 1, None)]
    assert [r.l3_code for r in taxonomy.hierarchy(taxonomy.themes(spark, text)).collect()] == ["01.01.01"]


def test_chunkers_cover():
    text = "Uma frase curta. " * 300
    spans = retrieval.recursive_pieces(text, 1000)
    assert all(b - a <= 1000 for a, b in spans) and "".join(text[a:b] for a, b in spans) == text
    spans = retrieval.semantic_pieces(text, 0.8, 200, 2000)
    assert all(b - a <= 2000 for a, b in spans)
    assert retrieval.recursive_pieces("", 10) == [] and retrieval.semantic_pieces("", 0.8, 1, 9) == []


def test_textrank():
    text = "O ministério anunciou o novo programa de crédito. O programa de crédito atende pequenas empresas. Chove hoje em Brasília sem parar. O crédito do programa vem do ministério e das empresas."
    assert 1 <= len(corpus.textrank_sentences(text, 2)) <= 2
    assert corpus.textrank_sentences("", 3) == []


def test_provider_isolates_failures(spark):
    calls = lambda: lambda p: 1 / 0 if p == "bad" else p.upper()
    rows = {r.prompt: (r.response, bool(r.error)) for r in models.provided(spark.createDataFrame([("ok",), ("bad",)], "prompt string"), calls).collect()}
    assert rows == {"ok": ("OK", False), "bad": (None, True)}
    rows = models.provided(spark.createDataFrame([("bad",)], "prompt string"), calls, fallbacks=(lambda: lambda p: "spare",)).first()
    assert rows.response == "spare" and rows.error is None


def test_clamp(spark):
    rows = spark.createDataFrame([("2.0",), ("-5",), ("x",), (None,), ("0.5",)], "x string")
    assert [r.y for r in rows.select(v.clamp01(F.col("x")).alias("y")).collect()] == [1.0, 0.0, 0.0, 0.0, 0.5]


def textrank_by_hand(text, n):
    sentences = text.split("\n")
    bags = [set(s.lower().split()) for s in sentences]
    m = len(bags)
    like = np.array([[0.0 if i == j else len(a & b) / (np.log(len(a) + 1) + np.log(len(b) + 1)) for j, b in enumerate(bags)] for i, a in enumerate(bags)])
    walk, rank = like / like.sum(axis=1, keepdims=True), np.full(m, 1 / m)
    for _ in range(50):
        rank = 0.15 / m + 0.85 * walk.T @ rank
    kept = []
    for i in np.argsort(-rank * (1 + 0.2 * (1 - np.arange(m) / m)), kind="stable"):
        if len(kept) < n and all(len(bags[i] & bags[j]) < 0.7 * min(len(bags[i]), len(bags[j])) for j in kept):
            kept.append(i)
    return [sentences[i] for i in sorted(kept)]


def test_textrank_ranks_long_texts_whole(spark):
    rng = np.random.default_rng(0)
    text = "\n".join(" ".join(f"word{x}" for x in {0, *(rng.zipf(1.3, 12) % 400).tolist()}) for _ in range(700))
    text = "\n".join(s for s in text.split("\n") if len(s) >= 20)
    want = textrank_by_hand(text, 3)
    got = corpus.textrank(spark.createDataFrame([(1, text)], "id long, text string")).first()
    assert got.summary == " ".join(want)
    assert corpus.textrank_sentences(text, 3) == want == corpus.textrank_sentences(text, 3, block=64, held=0)


def test_copies_pair_as_classes(spark, monkeypatch):
    """names that are compared alike are one class; only classes meet, and every pair of members comes out once."""
    monkeypatch.setattr(entities, "BLOCK", 4)
    made = ["Banco do Brasil", "do brasil  BANCO", "Banco do Brasil (BB)", "Banco do Brasil (XY)", "Feira 2011", "feira 2011", "Feira 2012", "a b c d", "a b c e", "a b c d e", "", None, "Único", "(BB)"]
    rows = [(f"{n:02d}{i}", name, "LAW") for i, name in enumerate(made) for n in range(7 if i in (0, 1, 7) else 2)] + [("o1", "a b c d", "ORG"), ("o2", "a b c d", "ORG"), ("n1", "a b c d", None), ("n2", "a b c d", None), (None, "a b c d", "ORG")]
    rows.append(rows[0])
    reg = spark.createDataFrame(rows, "entity_id string, canonical_name string, type string")
    a, b = reg.distinct().select([F.col(c).alias(f"{c}_a") for c in reg.columns]), reg.distinct().select([F.col(c).alias(f"{c}_b") for c in reg.columns])
    every = a.join(b, (F.col("type_a") == F.col("type_b")) & (F.col("entity_id_a") < F.col("entity_id_b")))
    names = ("canonical_name_a", "canonical_name_b")
    every = every.withColumns({"s": t.jaccard(t.name_tokens(names[0]), t.name_tokens(names[1])), "v": t.acronym_variant(*names)}).filter(~t.differs_by_year(*names))
    every = every.filter((F.col("s") >= entities.threshold(F.col("type_a"))) | F.col("v"))
    want = sorted((r.type_a, r.entity_id_a, r.entity_id_b, r.s, r.v) for r in every.collect())
    got = sorted((r.type, r.id_a, r.id_b, r.similarity, r.by_acronym) for r in entities.duplicate_candidates(reg).collect())
    assert got == want and len(want) > 150
    pairs, members = entities.duplicate_classes(reg)
    assert pairs.count() < 20 and max(len(r.ids) for r in members.collect()) <= 14
    assert sorted(i for r in members.collect() for i in r.ids) == sorted(r[0] for r in set(rows) if r[0])
