"""Batch jobs: enrichment of any frame, canonicalisation of a window, and their command line."""

from __future__ import annotations

import argparse
import json
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as t
from newsloom.operators import corpus, entities, knowledge, models
from newsloom.sources import tables
from newsloom.sources.scratch import materialise
from newsloom.sources.tables import Snapshots

QUEUE = "surface_norm string, type string, status string, entity_id string, attempts int, last_error string, first_seen_at string"

KINDS = {
    "summary": "short_summary string, long_summary string, key_points array<string>",
    "categorization": "category string, secondary array<string>, tags array<string>",
    "full": "short_summary string, long_summary string, key_points array<string>, category string, secondary array<string>, tags array<string>, entities array<string>, sentiment string, relevance double",
}


def enrich(
    df: DataFrame, *, text_col: str, key: str, kind: str, make, done: DataFrame | None = None, most_chars: int | None = None,
    workers: int | None = None, waits: models.Waits = models.Waits(),
) -> DataFrame:
    """Enrich any frame through a provider: one reply for each row that is not done, parsed to the kind's columns.

    Whole texts go into the prompts, or their first most_chars characters where the model's context
    asks for it. workers and waits as in models.provided().
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {sorted(KINDS)}")
    todo = df if done is None else df.join(done.select(key), key, "left_anti")
    text = F.coalesce(text_col, F.lit(""))
    prompts = todo.select(F.col(key), F.concat(F.lit(f"[{kind}]\n"), text if most_chars is None else F.substring(text, 1, most_chars)).alias("prompt"))
    said = materialise(models.provided(prompts, make, workers=workers, waits=waits), "replies")
    parsed = said.select(key, F.from_json("response", KINDS[kind]).alias("p"), "error")
    return todo.join(parsed.select(key, "p.*", "error"), key, "left")


def classify(articles: DataFrame, *, outline: str, make, workers: int | None = None, waits: models.Waits = models.FAILED) -> DataFrame:
    """Articles (unique_id, title, content) with the theme fields of their reply, null where there was none."""
    kept, bad = corpus.required(articles, ["title", "content"])
    prompts = kept.select("unique_id", models.classify_prompt(F.col("title"), F.col("content"), outline).alias("prompt"))
    said = materialise(models.provided(prompts, make, workers=workers, waits=waits), "replies")
    return models.enriched(articles, said.select("unique_id", "response"))


def classify_one(spark: SparkSession, news: dict, *, outline: str, make, return_format: str = "json") -> dict | str:
    """The classification of one article (title and content needed), as JSON text or as a dict."""
    if return_format not in ("json", "dict"):
        raise ValueError("return_format must be json or dict")
    if lack := [c for c in ("title", "content") if not news.get(c)]:
        raise ValueError(f"missing fields: {lack}")
    row = spark.createDataFrame([(str(news.get("unique_id") or "0"), news["title"], news["content"])], "unique_id string, title string, content string")
    found = classify(row, outline=outline, make=make).drop("title", "content").first().asDict(recursive=True)
    if "unique_id" not in news:
        found.pop("unique_id")
    return found if return_format == "dict" else json.dumps(found, ensure_ascii=False)


def extract_mentions(
    articles: DataFrame, features: DataFrame, *, raw_path: str, out: str, make, version: str, since=None, until=None, again: bool = False,
    limit: int | None = None, workers: int | None = None, chunk_rows: int | None = None, waits: models.Waits = models.MENTIONS,
) -> dict:
    """Back-fill mentions over the corpus: articles (unique_id, title, content, published_at) without a logged reply for this prompt version.

    since, until: only a half-open window; again: also those with a reply whose features hold entities,
    to renew a window. Replies are appended to the log before anything else is done with them, chunk
    by chunk of about chunk_rows, so a run that stops goes on where it was. Mentions go to out (a
    snapshot folder); an empty extraction never replaces earlier ones.
    """
    spark = articles.sparkSession
    if since is not None:
        articles = articles.filter(F.col("published_at") >= F.lit(since))
    if until is not None:
        articles = articles.filter(F.col("published_at") < F.lit(until))
    log = tables.read_log(spark, raw_path)
    todo = articles if again else entities.without_raw(articles, log, task="ner", version=version)
    if again:
        todo = todo.join(features.filter("entities is not null").select("unique_id"), "unique_id", "left_semi")
    todo = todo if limit is None else todo.orderBy(F.desc("published_at"), "unique_id").limit(limit)
    todo = materialise(todo, "to-extract")
    n = todo.count()
    chunks = 1 if chunk_rows is None else max(1, -(-n // chunk_rows))
    run = log.agg(F.max("run").alias("r")).first().r or 0
    for k in range(chunks):
        part = todo.filter(F.pmod(F.xxhash64("unique_id"), F.lit(chunks)) == k) if chunks > 1 else todo
        prompts = part.select("unique_id", models.ner_prompt(F.col("title"), F.col("content")).alias("prompt"))
        said = materialise(models.provided(prompts, make, workers=workers_for(n, workers), waits=waits), "replies").filter("error is null")
        tables.append_raw_replies(
            said.select(
                "unique_id", F.sha2("prompt", 256).alias("prompt_hash"), F.col("response").alias("raw_response"), F.lit(run + 1 + k).alias("run"),
                F.lit("ner").alias("task"), F.lit(version).alias("prompt_version"),
            ),
            raw_path,
        )
    replies = tables.read_log(spark, raw_path).filter((F.col("task") == "ner") & (F.col("prompt_version") == version) & (F.col("run") > run))
    last = replies.groupBy("unique_id").agg(F.max_by("raw_response", "run").alias("raw_response"))
    new = last.select("unique_id", models.parse_mentions(F.col("raw_response")).alias("_new")).filter("size(_new) > 0")
    found = new.join(features.select("unique_id", F.col("entities").alias("_old")), "unique_id", "left")
    shape = Snapshots(spark, out)
    held = new.select(
        "unique_id",
        F.transform(
            "_new",
            lambda e: F.struct(e["text"].alias("text"), e["type"].alias("type"), e["forma_canonica"].alias("forma_canonica"), F.lit(None).cast("string").alias("canonical_id")),
        ).alias("entities"),
    )
    before = shape.read()
    merged = held if before is None else before.join(held.select("unique_id"), "unique_id", "left_anti").unionByName(held)
    stats = {"articles": n, "replies": last.count(), "with_mentions": found.count(), "replaced": found.filter("size(_old) > 0").count()}
    shape.write(merged)
    return stats


def workers_for(rows: int, workers: int | None, *, least: int = 100) -> int | None:
    """Model clients for a number of rows: one up to `least` rows, as told beyond."""
    return 1 if rows <= least else workers


def current(features: DataFrame, mentions: DataFrame | None) -> DataFrame:
    """Features with the entities of the mentions snapshot (unique_id, entities) in the place of their own."""
    if mentions is None:
        return features
    new = mentions.select("unique_id", F.col("entities").alias("_new"), F.lit(True).alias("_known"))
    return features.join(new, "unique_id", "left").withColumn(
        "entities", F.when(F.col("_known"), F.col("_new")).otherwise(F.col("entities")),
    ).drop("_new", "_known")


def _keep(mentions: Snapshots, changed: DataFrame) -> None:
    """A new snapshot of all mentions that were ever changed; changed: unique_id, entities."""
    before = mentions.read()
    mentions.write(changed if before is None else before.join(changed.select("unique_id"), "unique_id", "left_anti").unionByName(changed))


def _merge(spark: SparkSession, features: DataFrame, state_path: str, pairs: DataFrame) -> dict:
    """Merge (source, target) entities everywhere: registry, aliases, mentions. Pairs of entities that are no more do nothing."""
    registry, aliases, mentions = (Snapshots(spark, f"{state_path}/{n}") for n in ("registry", "aliases", "mentions"))
    known = registry.read()
    pairs = pairs.join(known.select(F.col("entity_id").alias("source")), "source", "left_semi")
    mapping = materialise(entities.merge_map(pairs, entities.alias_counts(aliases.read())), "merges")
    n = mapping.count()
    if not n:
        return {"merged": 0, "rewritten": 0}
    moved = entities.rewrite_mentions(current(features, mentions.read()), mapping).filter("changed").select("unique_id", "entities")
    moved = materialise(moved, "rewritten")
    _keep(mentions, moved)
    aliases.write(entities.merge_aliases(aliases.read(), mapping))
    registry.write(entities.merge_registry(known, mapping))
    return {"merged": n, "rewritten": moved.count()}


def dedup(spark: SparkSession, *, features: DataFrame, state_path: str, kind: str | None = None, dry_run: bool = False) -> dict:
    """Merge near-duplicate entities of the registry (of one type, if given): candidates, targets, then registry, aliases and mentions.

    A second run finds nothing to merge. dry_run only counts candidates.
    """
    registry, aliases = Snapshots(spark, f"{state_path}/registry").read(), Snapshots(spark, f"{state_path}/aliases").read()
    if registry is None or aliases is None:
        return {"candidates": 0, "merged": 0, "rewritten": 0}
    own = registry if kind is None else registry.filter(F.col("type") == kind)
    pairs = materialise(entities.merge_targets(entities.duplicate_candidates(own), entities.alias_counts(aliases)).select("source", "target"), "duplicates")
    stats = {"candidates": pairs.count()}
    return stats if dry_run else stats | _merge(spark, features, state_path, pairs)


def window(since: str | None, until: str | None, now: datetime) -> tuple[datetime, datetime]:
    """Half-open [since, until): until now, since 30 days before, unless given."""
    end = datetime.fromisoformat(until) if until else now
    return (datetime.fromisoformat(since) if since else end - timedelta(days=30)), end


def canonicalise(
    spark: SparkSession, *, news: DataFrame, features: DataFrame, state_path: str, base: DataFrame, since: datetime, until: datetime,
    replies: DataFrame | None = None, make=None, dry_run: bool = False, limit: int | None = None, workers: int | None = None,
    waits: models.Waits = models.Waits(),
) -> dict:
    """Gather forms of a window, decide each once, keep registry, aliases, queue and mentions as snapshots.

    replies: surface_norm, type, raw (the model's reply), chosen, chosen_confidence; or make: a
    provider that is asked for each form. base: qid, name, place. Forms wait in the queue (state) with
    their attempts and last error; a form without a reply stays pending, five attempts at most; limit
    takes the oldest. Where an id of the public base takes an alias over, the minted entity goes into
    it. Mentions of the window are linked and written. A second run over the same window changes
    nothing.
    """
    registry, aliases, state, mentions = (Snapshots(spark, f"{state_path}/{n}") for n in ("registry", "aliases", "state", "mentions"))
    shape = lambda s, ddl: s.read() if s.read() is not None else spark.createDataFrame([], ddl)
    old_aliases = shape(aliases, "alias_norm string, type string, entity_id string")
    old_registry = shape(registry, "entity_id string, canonical_name string, type string, wikidata_id string, description string, confidence double")
    old_state = shape(state, QUEUE)
    features = current(features, mentions.read())
    inside = news.filter((F.col("published_at") >= F.lit(since)) & (F.col("published_at") < F.lit(until))).select("unique_id")
    own = features.join(inside, "unique_id")
    mentioned = own.select("unique_id", F.explode("entities").alias("e")).select(
        F.coalesce(F.nullif("e.forma_canonica", F.lit("")), "e.text").alias("surface"), F.col("e.type").alias("type"),
        F.col("unique_id").alias("sample"),
    )
    fresh = entities.gather_forms(mentioned, old_state.select("surface_norm", "type"), old_aliases)
    fresh = fresh.select(
        "surface_norm", "type", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("entity_id"), F.lit(0).alias("attempts"),
        F.lit(None).cast("string").alias("last_error"), F.lit(until.isoformat()).alias("first_seen_at"),
    )
    whole = materialise(old_state.unionByName(fresh), "queue")
    forms = materialise(entities.queue(whole, limit=limit), "forms")

    asked = knowledge.candidates(forms.select("surface_norm", "type"), base)
    if replies is None:
        prompts = asked.select("surface_norm", "type", models.canon_prompt(F.col("surface_norm"), F.col("type"), F.lit("")).alias("prompt"))
        said = materialise(models.provided(prompts, make, workers=workers, waits=waits), "replies")
        replies = said.select(
            "surface_norm", "type", F.col("response").alias("raw"), F.lit(None).cast("string").alias("chosen"),
            F.lit(None).cast("double").alias("chosen_confidence"), "error",
        )
    elif "error" not in replies.columns:
        replies = replies.withColumn("error", F.lit(None).cast("string"))
    told = entities.person_fast_path(asked.join(replies, ["surface_norm", "type"], "left"), asked.filter("size(candidates) > 0").select("surface_norm"))
    canon = told.withColumn("c", models.parse_canon(F.coalesce("raw", F.lit("")), F.col("surface_norm")))
    chosen = knowledge.homonym_choice(F.col("chosen"), F.col("chosen_confidence"), F.col("candidates"))
    rows = canon.select(
        "surface_norm", F.coalesce("c.type", "type").alias("type"), F.col("type").alias("asked_type"), F.col("c.canonical_name").alias("form"),
        "c.confidence", "c.not_an_entity", "candidates", chosen["qid"].alias("chosen"), chosen["confidence"].alias("chosen_confidence"), "error",
    )
    failed = rows.filter("error is not null").select(
        "surface_norm", F.col("asked_type").alias("type"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("entity_id"), "error",
    )
    decided = materialise(entities.persist_decisions(entities.gates(rows.filter("error is null").drop("error")), old_registry), "decisions")
    stats = {r["status"]: r["n"] for r in decided.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()} | {"forms": forms.count(), "errors": failed.count()}
    if dry_run:
        return stats
    kept = decided.filter("action in ('link', 'internal')")
    new = kept.groupBy(F.col("final_id").alias("entity_id")).agg(
        F.min("form").alias("canonical_name"), F.min("type").alias("type"),
        F.min(F.when(F.col("action") == "link", F.col("entity_id"))).alias("wikidata_id"), F.lit(None).cast("string").alias("description"),
        F.max("confidence").alias("confidence"),
    )
    registry.write(entities.registry_upsert(old_registry, new))
    added = kept.select(F.col("surface_norm").alias("alias_norm"), "type", F.col("final_id").alias("entity_id"))
    owners = materialise(entities.alias_add(old_aliases, added), "owners")
    # who lost an alias to an id of the public base is merged into it
    lost = entities.promotions(old_aliases.unionByName(added), owners.withColumn("promoted", t.is_qid("entity_id") & (F.col("contenders") > 0)))
    lost = materialise(lost, "promoted")
    aliases.write(owners.select("alias_norm", "type", "entity_id"))
    outcomes = decided.select(
        "surface_norm", F.col("asked_type").alias("type"), "status", F.col("final_id").alias("entity_id"), F.lit(None).cast("string").alias("error"),
    ).unionByName(failed)
    state.write(entities.record_outcomes(whole, outcomes))
    merged = _merge(spark, features, state_path, lost) if lost.limit(1).count() else {"merged": 0, "rewritten": 0}
    linked = entities.backfill(current(own, mentions.read()), aliases.read()).filter("changed").select("unique_id", "entities")
    linked = materialise(linked, "linked")
    n = linked.count()
    if n:
        _keep(mentions, linked)
    return stats | merged | {"changed": n}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Canonicalise the entities of a window of news, or merge duplicates of the registry.")
    p.add_argument("--news")
    p.add_argument("--features", required=True)
    p.add_argument("--replies")
    p.add_argument("--base")
    p.add_argument("--state", required=True)
    p.add_argument("--since")
    p.add_argument("--until")
    p.add_argument("--limit", type=int, help="forms of this run at most, the oldest first")
    p.add_argument("--workers", type=int, help="model clients at a time")
    p.add_argument("--dedup", action="store_true", help="merge near-duplicate entities instead")
    p.add_argument("--dedup-type", help="only entities of this type")
    p.add_argument("--dry-run", action="store_true")
    return p


def main(args: list[str] | None = None) -> dict:
    options = parser()
    a = options.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    read = spark.read.parquet
    if a.dedup or a.dedup_type:
        return dedup(spark, features=read(a.features), state_path=a.state, kind=a.dedup_type, dry_run=a.dry_run)
    if not (a.news and a.replies and a.base):
        options.error("--news, --replies and --base are needed unless --dedup is given")
    since, until = window(a.since, a.until, datetime.now())
    return canonicalise(
        spark, news=read(a.news), features=read(a.features), state_path=a.state, replies=read(a.replies), base=read(a.base), since=since, until=until,
        dry_run=a.dry_run, limit=a.limit, workers=a.workers,
    )


if __name__ == "__main__":
    print(main())
