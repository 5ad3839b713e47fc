"""State tables, jobs, providers and reports: small rows, values asserted."""

import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom import jobs
from newsloom.operators import components, corpus, entities, ledger, metrics, models, ranks, retrieval
from newsloom.sources import scratch, tables
from newsloom.streaming import worker

ENTITY = "array<struct<text:string,type:string,forma_canonica:string,canonical_id:string>>"


def features_of(spark, rows):
    full = [(u, None if e is None else [(x[0], x[1], None, x[2]) for x in e]) for u, e in rows]
    return spark.createDataFrame(full, f"unique_id string, entities {ENTITY}")


def test_chains_of_any_length_come_to_one_root(spark):
    links = spark.createDataFrame([(f"n{k:03}", f"n{k + 1:03}") for k in range(70)] + [("z", "z"), ("y", None)], "a string, b string")
    assert {r.v: r.root for r in components.connected_components(links).collect()} == {f"n{k:03}": "n000" for k in range(1, 71)}


def test_merge_map_takes_public_ids_then_more_aliases(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("m", "Q9"), ("m", "Q10"), ("x", "y")], "source string, target string")
    counts = spark.createDataFrame([("c", 5), ("a", 2), ("m", 99), ("y", 1)], "entity_id string, n_aliases long")
    assert {r.source: r.target for r in entities.merge_map(pairs, counts).collect()} == {"a": "c", "b": "c", "m": "Q10", "Q9": "Q10", "x": "y"}
    assert {r.source: r.target for r in entities.merge_map(pairs).collect()}["c"] == "a"


def test_running_sums_and_ranks_of_a_hot_key(spark):
    rng = np.random.default_rng(0)
    rows = [("hot" if k % 3 else None, int(rng.integers(1000)), k) for k in range(3000)] + [("cold", 5, 9999)]
    df = spark.createDataFrame(rows, "g string, x int, id int").repartition(7)
    got = {r.id: (r.place, r.before) for r in ranks.running(df, by=["g"], order=["x", "id"], value=F.col("x")).collect()}
    for g in ("hot", None, "cold"):
        before = 0
        for place, (_, x, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])):
            assert got[i] == (place, before)
            before += x
    p = {r.g: (r.a, r.b) for r in ranks.percentiles(df, by=["g"], value="x", shares={"a": 0.5, "b": 0.99}).collect()}
    for g in ("hot", None):
        own = [r[1] for r in rows if r[0] == g]
        assert np.allclose(p[g], np.percentile(own, [50, 99]))
    assert ranks.running(df.limit(0), by=["g"], order=["x"]).count() == 0


def test_request_rate_over_bucket_borders(spark):
    rng = np.random.default_rng(1)
    rows = [("a" if k % 4 else "b", int(t)) for k, t in enumerate(rng.integers(0, 700, 400))]
    df = spark.createDataFrame([(g, datetime.fromtimestamp(t), k) for k, (g, t) in enumerate(rows)], "g string, ts timestamp, id int")
    got = {r.id: r.recent for r in ledger.request_rate(df, by="g", ts="ts", seconds=60).collect()}
    assert got == {k: sum(h == g and t - 60 < u <= t for h, u in rows) for k, (g, t) in enumerate(rows)}


def test_backfill_keeps_documents_without_mentions(spark):
    feats = features_of(spark, [("a", [("Casa Azul", "ORG", None), ("Rua", "LOC", "keep")]), ("b", []), ("c", None)])
    aliases = spark.createDataFrame([("casa azul", "ORG", "Q5")], "alias_norm string, type string, entity_id string")
    got = {r.unique_id: (None if r.entities is None else [e.canonical_id for e in r.entities], r.changed, r.n_linked) for r in entities.backfill(feats, aliases).collect()}
    assert got == {"a": (["Q5", "keep"], True, 1), "b": ([], False, 0), "c": (None, False, 0)}


def test_shortlist_is_the_best_by_trigrams(spark):
    from newsloom.functions import text as t

    names = [f"{a} {b} {c}" for a in ("grupo", "casa", "porto") for b in ("verde", "verdes", "azul", "norte") for c in ("um", "dois", "tres")]
    reg = spark.createDataFrame([(f"e{k:02}", n, "ORG") for k, n in enumerate(names)] + [("zz", "grupo verde um", "LAW")], "entity_id string, canonical_name string, type string")
    probes = spark.createDataFrame([("grupo verde umm", "ORG"), ("portos azuis", "ORG"), ("nada disso", "PER")], "name string, type string")
    every = probes.join(reg, "type").withColumn("s", t.trigram_similarity("name", "canonical_name")).filter("s >= 0.3").collect()
    got = entities.shortlist(probes, reg, k=5).collect()
    for name in ("grupo verde umm", "portos azuis", "nada disso"):
        want = sorted((-r.s, r.entity_id) for r in every if r.name == name)[:5]
        assert sorted((-r.similarity, r.entity_id) for r in got if r.name == name) == want


def state(spark, path, name):
    return tables.Snapshots(spark, f"{path}/{name}").read()


@pytest.fixture
def registry(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    rows = [("dgb_a", "Fundo do Mar Azul", "ORG", None), ("dgb_b", "Fundo do Mar Azul (FMA)", "ORG", None), ("Q3", "Fundo do mar azul", "ORG", "Q3"), ("dgb_v1", "Prova 2025", "EVENT", None), ("dgb_v2", "Prova 2026", "EVENT", None), ("dgb_l", "Plano Geral de Obras", "POLICY", None), ("dgb_m", "Plano Geral das Obras de", "POLICY", None)]
    tables.Snapshots(spark, f"{path}/registry").write(spark.createDataFrame([(i, n, k, w, None, 0.9) for i, n, k, w in rows], "entity_id string, canonical_name string, type string, wikidata_id string, description string, confidence double"))
    tables.Snapshots(spark, f"{path}/aliases").write(spark.createDataFrame([(n.lower(), k, i) for i, n, k, _ in rows] + [("plano", "POLICY", "dgb_m")], "alias_norm string, type string, entity_id string"))
    feats = features_of(spark, [("u1", [("x", "ORG", "dgb_a"), ("y", "ORG", "dgb_b")]), ("u2", [("p", "EVENT", "dgb_v1")]), ("u3", [("o", "POLICY", "dgb_l")]), ("u4", None)])
    return path, feats


def test_dedup_job_merges_everywhere_and_once(spark, registry):
    path, feats = registry
    assert jobs.dedup(spark, features=feats, state_path=path, dry_run=True)["candidates"] == 4
    one = jobs.dedup(spark, features=feats, state_path=path, kind="POLICY")
    assert one == {"candidates": 1, "merged": 1, "rewritten": 1}
    done = jobs.dedup(spark, features=feats, state_path=path)
    assert done == {"candidates": 3, "merged": 2, "rewritten": 1}
    assert {r.entity_id for r in state(spark, path, "registry").collect()} == {"Q3", "dgb_v1", "dgb_v2", "dgb_m"}
    assert {r.entity_id for r in state(spark, path, "aliases").collect()} == {"Q3", "dgb_v1", "dgb_v2", "dgb_m"}
    now = {r.unique_id: None if r.entities is None else [e.canonical_id for e in r.entities] for r in jobs.current(feats, state(spark, path, "mentions")).collect()}
    assert now == {"u1": ["Q3", "Q3"], "u2": ["dgb_v1"], "u3": ["dgb_m"], "u4": None}
    assert jobs.dedup(spark, features=feats, state_path=path) == {"candidates": 0, "merged": 0, "rewritten": 0}
    assert jobs.dedup(spark, features=feats, state_path=path + "-none")["candidates"] == 0


def test_canonicalise_writes_mentions_and_merges_promoted(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    schema = "entity_id string, canonical_name string, type string, wikidata_id string, description string, confidence double"
    tables.Snapshots(spark, f"{path}/registry").write(spark.createDataFrame([("dgb_casa-azul", "Casa Azul", "ORG", None, "minted", 0.9)], schema))
    tables.Snapshots(spark, f"{path}/aliases").write(spark.createDataFrame([("casa azul", "ORG", "dgb_casa-azul")], "alias_norm string, type string, entity_id string"))
    news = spark.createDataFrame([("u1", datetime(2024, 1, 5)), ("u2", datetime(2024, 1, 6))], "unique_id string, published_at timestamp")
    feats = features_of(spark, [("u1", [("Casa Azul S.A.", "ORG", None)]), ("u2", [("Casa Azul", "ORG", "dgb_casa-azul"), ("Novo Polo", "ORG", None), ("Falha", "ORG", None)])])
    told = [("casa azul s.a.", "ORG", '{"canonical_name":"Casa Azul","type":"ORG","confidence":0.95}', None, None, None), ("novo polo", "ORG", '{"canonical_name":"Novo Polo","type":"ORG","confidence":0.9}', None, None, None), ("falha", "ORG", None, None, None, "boom")]
    replies = spark.createDataFrame(told, "surface_norm string, type string, raw string, chosen string, chosen_confidence double, error string")
    base = spark.createDataFrame([("Q8", "Casa Azul S.A.", 1)], "qid string, name string, place int")
    run = lambda **o: jobs.canonicalise(spark, news=news, features=feats, state_path=path, replies=replies, base=base, since=datetime(2024, 1, 1), until=datetime(2024, 2, 1), **o)
    assert run(dry_run=True)["forms"] == 3 and state(spark, path, "state") is None
    first = run()
    assert (first["errors"], first["resolved"], first["changed"]) == (1, 2, 2)
    now = {r.unique_id: [e.canonical_id for e in r.entities] for r in jobs.current(feats, state(spark, path, "mentions")).collect()}
    assert now == {"u1": ["Q8"], "u2": ["dgb_casa-azul", "dgb_novo-polo", None]}
    queue = {r.surface_norm: (r.status, r.attempts, r.last_error) for r in state(spark, path, "state").collect()}
    assert queue == {"casa azul s.a.": ("resolved", 0, None), "novo polo": ("resolved", 0, None), "falha": ("pending", 1, "boom")}
    # the public id now also claims the minted entity's alias: the minted one goes into it
    later = features_of(spark, [("u1", [("Casa Azul S.A.", "ORG", None)]), ("u2", [("Casa Azul", "ORG", "dgb_casa-azul")]), ("u3", [("Casa  Azul", "ORG", "dgb_casa-azul")])])
    lost = entities.promotions(state(spark, path, "aliases"), entities.alias_add(state(spark, path, "aliases"), spark.createDataFrame([("casa azul", "ORG", "Q8")], "alias_norm string, type string, entity_id string")))
    assert [(r.source, r.target) for r in lost.collect()] == [("dgb_casa-azul", "Q8")]
    assert jobs._merge(spark, later, path, lost)["merged"] == 1
    assert {r.entity_id for r in state(spark, path, "registry").collect()} == {"Q8", "dgb_novo-polo"}
    merged = [r for r in state(spark, path, "registry").collect() if r.entity_id == "Q8"][0]
    assert merged.description == "minted"
    for attempt in range(2, 6):
        assert run()["errors"] == 1 and {r.attempts for r in state(spark, path, "state").collect() if r.surface_norm == "falha"} == {attempt}
    assert run()["forms"] == 0


def test_queue_takes_the_oldest(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    news = spark.createDataFrame([(f"u{k}", datetime(2024, 1, 5)) for k in range(4)], "unique_id string, published_at timestamp")
    feats = features_of(spark, [(f"u{k}", [(f"Nome {k}", "LAW", None)]) for k in range(4)])
    make = lambda: lambda p: json.dumps({"canonical_name": p.split("\n")[0][7:].title(), "type": "LAW", "confidence": 0.99})
    base = spark.createDataFrame([], "qid string, name string, place int")
    run = lambda **o: jobs.canonicalise(spark, news=news, features=feats, state_path=path, make=make, base=base, since=datetime(2024, 1, 1), until=datetime(2024, 2, 1), workers=2, **o)
    assert run(limit=3)["forms"] == 3
    assert {r.surface_norm: r.status for r in state(spark, path, "state").collect()} == {"nome 0": "resolved", "nome 1": "resolved", "nome 2": "resolved", "nome 3": "pending"}
    assert run(limit=3)["forms"] == 1 and run()["forms"] == 0


def test_command_line(spark, registry, tmp_path):
    path, feats = registry
    feats.write.parquet(str(tmp_path / "feats"))
    assert jobs.main(["--features", str(tmp_path / "feats"), "--state", path, "--dedup-type", "EVENT", "--dry-run"]) == {"candidates": 0}
    with pytest.raises(SystemExit):
        jobs.main(["--features", "f", "--state", "s"])


def test_extraction_goes_on_where_it_stopped(spark, tmp_path):
    news = spark.createDataFrame([(f"u{k}", "t", f"c{k}", datetime(2024, 1, 1 + k)) for k in range(6)], "unique_id string, title string, content string, published_at timestamp")
    feats = features_of(spark, [("u0", [("old", "ORG", "Q1")]), ("u1", [("old", "ORG", "Q1")])])
    raw, out = str(tmp_path / "raw"), f"file://{tmp_path}/mentions"

    def make():
        def say(prompt):
            if "c5" in prompt:
                raise RuntimeError("throttled")
            return '{"entities":[]}' if "c1" in prompt else '{"entities":[{"text":"Novo","type":"ORG"}]}'

        return say

    run = lambda **o: jobs.extract_mentions(news, feats, raw_path=raw, out=out, make=make, version="v1", waits=models.Waits(), **o)
    assert run(limit=2) == {"articles": 2, "replies": 1, "with_mentions": 1, "replaced": 0}
    assert run(chunk_rows=2) == {"articles": 5, "replies": 4, "with_mentions": 3, "replaced": 1}
    assert run() == {"articles": 1, "replies": 0, "with_mentions": 0, "replaced": 0}
    now = {r.unique_id: [e.text for e in r.entities] for r in jobs.current(feats, tables.Snapshots(spark, out).read()).collect()}
    assert now == {"u0": ["Novo"], "u1": ["old"]}
    assert run(again=True, since=datetime(2024, 1, 2))["articles"] == 1


def test_classify_one_and_many(spark):
    say = '{"theme_1_level_1_code":"01","theme_1_level_1_label":"A","summary":"s","sentiment":{"label":"neutral","score":0.0}}'
    make = lambda: lambda p: say if "01 - A" in p and "bom" in p else 1 / 0
    rows = spark.createDataFrame([("a", "t", "bom"), ("b", "t", "mau"), ("c", None, "bom")], "unique_id string, title string, content string")
    got = {r.unique_id: (r.theme_1_level_1_code, r.summary) for r in jobs.classify(rows, outline="01 - A", make=make, waits=models.Waits()).collect()}
    assert got == {"a": ("01", "s"), "b": (None, None), "c": (None, None)}
    one = jobs.classify_one(spark, {"title": "t", "content": "bom"}, outline="01 - A", make=make, return_format="dict")
    assert one["theme_1_level_1_label"] == "A" and one["sentiment"] == {"label": "neutral", "score": 0.0} and "unique_id" not in one
    assert json.loads(jobs.classify_one(spark, {"title": "t", "content": "bom", "unique_id": "u"}, outline="01 - A", make=make))["unique_id"] == "u"
    for news, form in (({"title": "t"}, "dict"), ({"title": "t", "content": "c"}, "xml")):
        with pytest.raises(ValueError):
            jobs.classify_one(spark, news, outline="", make=make, return_format=form)


def test_providers_wait_and_stream(spark):
    waited = []
    assert models.THROTTLED.after(3, 0.5) == 8.25 and models.FAILED.after(2, 0.9) == 0.8
    calls = spark.createDataFrame([(1, "a")], "id int, prompt string")

    def make():
        return lambda p: 1 / 0

    out = models.provided(calls, make, attempts=2, waits=models.Waits(0.01, 0.0, 0.01), workers=1).first()
    assert out.response is None and "division" in out.error and not waited
    e = models.Echo()
    assert e("x\nlast one") == "last one" and "".join(e.stream("q\na b  c ")) == "a b  c " and e.count_tokens("12345") == 2
    assert models.chosen_models("offline") == ["hashed-64", "hashed-256"] and models.chosen_models(names=["hashed-64-long", "?"]) == ["hashed-64-long"]
    assert models.embedder("hashed-256")(["um dois"]).shape == (1, 256)
    ticks = iter([0.0, 0.5, 1.0, 1.5, 2.0, 2.5])
    assert models.timed(len, ["a", "b"], iterations=3, clock=lambda: next(ticks)) == {"throughput": 4.0, "latencies_ms": [500.0] * 3}


def test_prompts_hold_what_they_are_given(spark):
    row = spark.createDataFrame([("T", "c" * 5000, "f", "PER", [("Q1", "um"), ("Q2", None)])], "title string, content string, form string, kind string, offered array<struct<qid:string,label:string>>")
    c = F.col
    made = row.select(
        models.classify_prompt(c("title"), c("content"), "01 - A").alias("a"), models.organic_prompt(c("title"), c("content")).alias("b"), models.compact_prompt(c("title"), c("content"), "01").alias("c"),
        models.local_prompt(c("title"), c("content"), "01").alias("d"), models.levels_prompt(c("title"), c("content"), "01", examples="ex").alias("e"), models.homonym_prompt(c("form"), c("offered"), c("content")).alias("f"),
        models.canon_prompt(c("form"), c("kind"), c("content")).alias("g"), models.ner_prompt(c("title"), F.lit(None)).alias("h"),
    ).first()
    assert [made[k].count("c" * 100) >= 10 for k in "abcdefg"] == [True] * 7
    assert "- Q2: " in made.f and "Exemplos:\nex\n" in made.e and made.d.endswith("Código:") and made.h.endswith("Conteúdo: ")


def test_exact_interval():
    low, high = metrics.exact_interval(0, 10)
    assert low == 0.0 and abs(high - (1 - 0.025 ** (1 / 10))) < 1e-9
    low, high = metrics.exact_interval(10, 10)
    assert high == 1.0 and abs(low - 0.025 ** (1 / 10)) < 1e-9
    low, high = metrics.exact_interval(7, 20)
    from math import comb

    tail = lambda k, p: sum(comb(20, i) * p**i * (1 - p) ** (20 - i) for i in range(k, 21))
    assert abs(tail(7, low) - 0.025) < 1e-9 and abs(1 - tail(8, high) - 0.025) < 1e-9


def test_rouge_l_is_the_longest_common_subsequence(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [str(x) for x in rng.integers(0, 6, rng.integers(0, 40))], [str(x) for x in rng.integers(0, 6, rng.integers(0, 40))]) for k in range(60)]

    def by_hand(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return 2.0 * best[-1][-1] / (len(a) + len(b)) if a or b else 0.0

    got = {r.k: (r.long, r.native) for r in spark.createDataFrame(rows, "k int, a array<string>, b array<string>").select("k", metrics.rouge_l_long("a", "b").alias("long"), metrics.rouge_l(F.col("a"), F.col("b")).alias("native")).collect()}
    for k, a, b in rows:
        assert abs(got[k][0] - by_hand(a, b)) < 1e-12 and abs(got[k][1] - by_hand(a, b)) < 1e-12


def test_rouge_n_counts_repeats_once_each(spark):
    rows = [(1, "a a b", "a b b"), (2, "", ""), (3, "x", None), (4, "A, a!", "a")]
    got = {r.id: round(r.rouge_1, 9) for r in metrics.rouge_n(spark.createDataFrame(rows, "id int, candidate string, reference string"), n=1).collect()}
    assert got == {1: round(4 / 6, 9), 2: 0.0, 3: 0.0, 4: round(2 / 3, 9)}
    two = {r.id: round(r.rouge_2, 9) for r in metrics.rouge_n(spark.createDataFrame(rows, "id int, candidate string, reference string"), n=2).collect()}
    assert two == {1: 0.5, 2: 0.0, 3: 0.0, 4: 0.0}


def textrank_by_hand(text, n):
    import re

    s = [x.strip() for x in re.split(r"(?<=[.!?])\s+|\n+", text) if len(x.strip()) >= 20]
    if not s:
        return []
    bags = [set(re.findall(r"\w+", x.lower())) for x in s]
    m = len(s)
    like = np.zeros((m, m))
    for i in range(m):
        for j in range(m):
            if i != j and bags[i] & bags[j]:
                like[i, j] = len(bags[i] & bags[j]) / (np.log(len(bags[i]) + 1) + np.log(len(bags[j]) + 1))
    sums = like.sum(axis=1, keepdims=True)
    like, rank = like / np.where(sums == 0, 1, sums), np.full(m, 1 / m)
    for _ in range(50):
        rank = 0.15 / m + 0.85 * like.T @ rank
    rank = rank * (1 + 0.2 * (1 - np.arange(m) / m))
    kept = []
    for i in np.argsort(-rank, kind="stable"):
        if len(kept) < n and all(len(bags[i] & bags[j]) < 0.7 * max(1, min(len(bags[i]), len(bags[j]))) for j in kept):
            kept.append(int(i))
    return [s[i] for i in sorted(kept)]


def lexrank_by_hand(text, n):
    import re

    s = [x.strip() for x in re.split(r"(?<=[.!?])\s+|\n+", text) if len(x.strip()) >= 20]
    if len(s) <= n:
        return s
    words = [re.findall(r"\w+", x.lower()) for x in s]
    vocab = sorted({w for x in words for w in x})
    m, idf = len(s), np.log(len(s) / np.array([sum(w in x for x in words) for w in vocab]))
    x = np.array([[own.count(w) for w in vocab] for own in words]) * idf
    norms = np.linalg.norm(x, axis=1)
    link = np.eye(m, dtype=bool)
    for i in range(m):
        for j in range(m):
            link[i, j] |= bool(norms[i] and norms[j] and x[i] @ x[j] >= 0.1 * norms[i] * norms[j] - 1e-12)
    walk, rank = link / link.sum(axis=1, keepdims=True), np.full(m, 1 / m)
    for _ in range(100):
        rank = 0.15 / m + 0.85 * walk.T @ rank
    return [s[i] for i in sorted(np.lexsort((np.arange(m), -np.round(rank, 12)))[:n])]


@pytest.mark.parametrize("sentences", [0, 2, 9, 340])
def test_summaries_against_the_plain_form(sentences):
    rng = np.random.default_rng(sentences)
    text = " ".join(" ".join(f"palavra{w}" for w in rng.integers(0, 60, 6)) + "." for _ in range(sentences))
    assert corpus.textrank_sentences(text, 3, block=64, held=1000) == textrank_by_hand(text, 3)
    assert corpus.lexrank_sentences(text, 3) == lexrank_by_hand(text, 3)


def test_chunks_cover_the_text():
    rng = np.random.default_rng(5)
    for k in range(40):
        text = "".join(rng.choice(list("ab .!?\n"), rng.integers(0, 400)))
        spans = retrieval.recursive_pieces(text, 50)
        assert all(0 < b - a <= 50 and text[a:b].strip() for a, b in spans)
        left = "".join(text[a:b] for a, b in zip([0, *[b for _, b in spans]], [a for a, _ in spans] + [len(text)], strict=True))
        assert not left.strip()
        parts = retrieval.semantic_pieces(text, 0.8, 20, 80)
        assert "".join(text[a:b] for a, b in parts).split() == text.split()
        vectors = [retrieval.hashed_embedding([text[a:b]])[0] for a, b in parts]
        assert len(vectors) == len(parts)


def semantic_by_hand(text, threshold, least, most):
    import re

    spans, at = [], 0
    for m in [*re.finditer(r"[.!?]\s+|\n+", text), None]:
        end = m.end() if m else len(text)
        if text[at:end].strip():
            spans.append((at, end))
        at = end
    out = []
    for k, (a, b) in enumerate(spans):
        if out:
            one, two = (retrieval.hashed_embedding([text[x:y]])[0] for x, y in (spans[k - 1], spans[k]))
            if (one @ two > threshold or out[-1][1] - out[-1][0] < least) and b - out[-1][0] <= most:
                out[-1] = (out[-1][0], b)
                continue
        out.append((a, b))
    return out


def test_semantic_chunks_by_hand():
    rng = np.random.default_rng(6)
    for _ in range(20):
        text = " ".join(" ".join(f"w{x}" for x in rng.integers(0, 5, 4)) + rng.choice([".", "!", "\n", ","]) for _ in range(30))
        assert retrieval.semantic_pieces(text, 0.3, 40, 200) == semantic_by_hand(text, 0.3, 40, 200)


def test_vector_topk_in_blocks(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 6))
    x[3], x[7] = x[5], 0
    items = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [1.0, 2.0])], "id long, v array<double>")
    q = items.filter("id % 20 = 0 or id = 5").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    for blocks in ({}, {"item_block": 64, "query_block": 7}):
        got = retrieval.vector_topk(q, items, k=4, **blocks).collect()
        for query in sorted({r.query_id for r in got} - {900}):
            ok = [k for k in range(500) if k != 7]
            s = {k: float(x[k] @ x[query] / np.linalg.norm(x[k]) / np.linalg.norm(x[query])) for k in ok}
            want = sorted(ok, key=lambda k: (-round(s[k], 12), k))[:4]
            assert [r.id for r in sorted((r for r in got if r.query_id == query), key=lambda r: r["rank"])] == want
        assert {r.query_id for r in got} == {*range(0, 500, 20), 5}


def test_answers_come_from_the_cache(spark):
    chunks = spark.createDataFrame([(1, 0, "A", "2024-01-01", "um", 0.9), (2, 0, "B", "2024-01-02", "dois", 0.8), (3, 0, "C", "2024-01-02", "", 1.0)], "document_id int, chunk_index int, title string, published_at string, content string, score double").withColumn("published_at", F.col("published_at").cast("date"))
    asked, ticks = [], iter([0.0, 0.25, 1.0])
    said = retrieval.answer("q?", chunks, lambda p: asked.append(p) or "sim", now="2024-01-01 10:00:00", clock=lambda: next(ticks), prices=(1e6, 0.0))
    assert said["answer"] == "sim" and [s["id"] for s in said["sources"]] == [1, 2] and not said["cached"] and "[Fonte 2: B] (02/01/2024)\ndois" in asked[0]
    assert said["latency_ms"] == {"retrieval_ms": 250.0, "generation_ms": 750.0, "total_ms": 1000.0} and said["cost_usd"] == len(asked[0]) and said["tokens_output"] == 3
    cache = spark.createDataFrame([(said["key"], "antes", "2024-01-01 09:30:00")], "key long, answer string, stored_at string")
    assert retrieval.answer("q?", chunks, lambda p: 1 / 0, cache=cache, now="2024-01-01 10:00:00")["answer"] == "antes"
    assert retrieval.answer("q?", chunks, lambda p: "novo", cache=cache, now="2024-01-01 11:00:00")["cached"] is False
    assert retrieval.answer("q?", chunks, lambda p: 1 / 0, now="2024-01-01 10:00:00", least_score=2.0)["answer"] is None
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "id int, category string")
    only = retrieval.answer("dois", chunks, lambda p: p, documents=docs, filters={"category": "y", "agency": None}, now="2024-01-01 10:00:00", use_reranking=True, top_k=1)
    assert [(s["id"], s["score"]) for s in only["sources"]] == [(2, 1.0)] and only["retrieval_config"] == {"num_results": 1, "reranking": True}


def test_taxonomy_nests(spark):
    from newsloom.operators import taxonomy

    nodes = taxonomy.themes(spark, "01 - A\n01.01 - B\n01.01.02 - D\n01.01.01 - C\n01.02 - E\n02 - F\n")
    got = {r.code: None if r.children is None else [(c.code, [x.code for x in c.children]) for c in r.children] for r in taxonomy.nested(nodes).collect()}
    assert got == {"01": [("01.01", ["01.01.01", "01.01.02"]), ("01.02", [])], "02": None}
    assert jobs.workers_for(100, 8) == 1 and jobs.workers_for(101, 8) == 8


def test_stems_match(spark):
    docs = spark.createDataFrame([(1, "As eleições do município"), (2, "eleição municipal"), (3, "eleicoes"), (4, None), (5, "Municípios, municípios e ELEIÇÃO")], "id long, text string")
    assert sorted(r.id for r in retrieval.stemmed_match(docs, "eleição").collect()) == [1, 2, 3, 5]
    got = {r.id: r.hits for r in retrieval.stemmed_match(docs, "município da eleição").collect()}
    assert got == {1: 2, 5: 3}
    assert retrieval.stemmed_match(docs, "de a o").count() == 0


def test_second_stream_adds_to_the_first(spark, tmp_path):
    import base64

    say = lambda uid: json.dumps({"message": {"data": base64.b64encode(json.dumps({"unique_id": uid}).encode()).decode(), "messageId": uid}})
    articles = spark.createDataFrame([("a", 1), ("b", 2)], "unique_id string, n int")
    out = str(tmp_path / "out")
    for k, lines in enumerate(([say("a"), "bad"], [say("b"), say("a"), "worse"])):
        src = tmp_path / f"in{k}"
        src.mkdir()
        (src / "1.txt").write_text("\n".join(lines))
        worker.run_once(spark, str(src), articles, out, str(tmp_path / f"cp{k}"), lambda r: r)
    assert sorted(r.unique_id for r in spark.read.parquet(f"{out}/enriched").collect()) == ["a", "b"]
    assert spark.read.parquet(f"{out}/malformed").count() == 2
    events = spark.read.parquet(f"{out}/enriched").withColumns({"enriched_at": F.lit("t"), "most_specific_theme_code": F.lit("01"), "has_summary": F.lit(True)})
    assert worker.publish(events, str(tmp_path / "topic")) and not worker.publish(events, None)
    assert {json.loads(r.value)["unique_id"] for r in spark.read.text(str(tmp_path / "topic")).collect()} == {"a", "b"}


def test_index_is_whole_or_not_there(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    docs, chunks = spark.createDataFrame([(1, "a"), (2, "b")], "id int, title string"), spark.createDataFrame([(1, 0, "x"), (2, 0, "y")], "document_id int, chunk_index int, content string")
    assert tables.read_index(spark, path) is None
    assert tables.write_index(docs, chunks, path) == 1
    with pytest.raises(ValueError):
        tables.write_index(docs.filter("id = 1"), chunks, path)
    (tmp_path / "index" / "v=2" / "documents").mkdir(parents=True)
    d, c = tables.read_index(spark, path)
    assert d.count() == 2 and c.count() == 2 and tables.write_index(docs, chunks.limit(1), path) == 2


def test_reports_and_sheets(spark, tmp_path):
    rows = spark.createDataFrame([("m1", 0.5), ("m2", 0.7)], "model string, score double")
    tables.write_report(rows, str(tmp_path / "report"), title="Modelos", order=["model"])
    assert [r.value for r in spark.read.text(str(tmp_path / "report/txt")).collect()][2:] == ["model: m1 | score: 0.5", "model: m2 | score: 0.7"]
    assert spark.read.json(str(tmp_path / "report/json")).count() == 2
    sheet = tables.read_sheet(spark, str(tmp_path / "report/csv"), "model string, score double")
    assert sheet.agg(F.sum("score")).first()[0] == 1.2
    tables.write_benchmark([rows, rows.withColumn("more", F.lit(1))], str(tmp_path / "bench"), columns=["model"], about={"runs": 2})
    assert spark.read.parquet(str(tmp_path / "bench/runs")).count() == 4
    assert json.loads(spark.read.text(str(tmp_path / "bench/about")).first().value) == {"runs": 2}
    assert tables.read_stated(spark, str(tmp_path / "bench/runs"), cap=3).count() == 3
    assert tables.create_indexes("news", {"unique_id": "btree", "tags": "gin", "v": "vector"})[1:] == ["CREATE INDEX IF NOT EXISTS news_tags_gin ON news USING gin (tags)", "CREATE INDEX IF NOT EXISTS news_v_vector ON news USING ivfflat (v vector_cosine_ops)"]
    assert tables.credentials("aws://us%2Fer:p%40ss@/?region_name=sa-east-1") == ("us/er", "p@ss", "sa-east-1") and tables.credentials("aws://") == (None, None, "us-east-1")


def test_raw_log_is_never_fatal(spark, tmp_path):
    rows = spark.createDataFrame([("u", "ner", "v1")], "unique_id string, task string, prompt_version string")
    tables.append_raw_replies(rows, str(tmp_path / "log"))
    assert tables.read_log(spark, str(tmp_path / "log")).first().unique_id == "u" and tables.read_log(spark, str(tmp_path / "no")).count() == 0
    with pytest.warns(UserWarning):
        tables.append_raw_replies(rows.drop("task"), str(tmp_path / "log"))


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        scratch.scratch_dir(Session())


def test_alias_of_many_ids_is_summed(spark):
    """owners come from aggregates that combine before the shuffle; no row carries the ids of its alias."""
    c = "alias_norm string, type string, entity_id string"
    old = spark.range(3000).select(F.lit("a").alias("alias_norm"), F.lit("ORG").alias("type"), F.concat(F.lit("dgb_"), F.col("id").cast("string")).alias("entity_id"))
    old = old.unionByName(spark.createDataFrame([("b", None, "Q2"), ("b", None, "Q2"), (None, "ORG", "x"), ("c", "ORG", None)], c))
    new = old.limit(100).unionByName(spark.createDataFrame([("a", "ORG", "Q9"), ("a", "ORG", "Q10"), ("b", None, "Q1"), ("b", None, "Q2"), ("d", "ORG", "y"), ("d", "ORG", "x")], c))
    owners = entities.alias_add(old, new)
    got = {(r.alias_norm, r.type): (r.entity_id, r.promoted, r.contenders) for r in owners.collect()}
    assert got == {
        ("a", "ORG"): ("Q10", True, 3001), ("b", None): ("Q2", False, 1), (None, "ORG"): ("x", False, 0), ("c", "ORG"): (None, False, -1), ("d", "ORG"): ("x", False, 1),
    }
    plan = owners._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "collect_set" not in plan
