"""Model providers, prompts and tolerant parsers."""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import text as t
from newsloom.functions.vectors import clamp01

THEME_FIELDS = [*(f"theme_1_level_{n}_{k}" for n in (1, 2, 3) for k in ("code", "label")), "most_specific_theme_code", "most_specific_theme_label", "summary"]
THEME_SCHEMA = ", ".join(f"{f} string" for f in THEME_FIELDS) + ", sentiment struct<label:string,score:double>"
MENTION_SCHEMA = "array<struct<text:string,type:string,count:string,forma_canonica:string,salience:string>>"


def parse_theme(raw: Column) -> Column:
    """Struct of the theme fields from the first object in a reply; anything missing is null."""
    return F.from_json(F.nullif(t.first_object(raw), F.lit("")), THEME_SCHEMA)


def parse_mentions(raw: Column) -> Column:
    """Mentions (text, type, count, forma_canonica, salience) from {"entities": [...]} or a bare list; invalid ones drop out."""
    bare, whole = F.regexp_extract(raw, r"(?s)(\[.*\])", 1), t.first_object(raw)
    inner = F.from_json(whole, f"entities {MENTION_SCHEMA}")["entities"]
    first = F.when(
        (F.instr(raw, "[") > 0) & ((F.instr(raw, "{") == 0) | (F.instr(raw, "[") < F.instr(raw, "{"))),
        F.coalesce(F.from_json(bare, MENTION_SCHEMA), inner),
    )
    found = F.coalesce(first, inner, F.expr(f"cast(array() as {MENTION_SCHEMA})"))
    good = F.filter(found, lambda e: e["text"].isNotNull() & (e["text"] != "") & t.sanctioned_type(e["type"]).isNotNull())
    return F.transform(
        good,
        lambda e: F.struct(
            e["text"].alias("text"),
            t.sanctioned_type(e["type"]).alias("type"),
            F.greatest(F.lit(1), F.coalesce(e["count"].try_cast("int"), F.lit(1))).alias("count"),
            F.coalesce(F.nullif(e["forma_canonica"], F.lit("")), e["text"]).alias("forma_canonica"),
            F.when(e["salience"].try_cast("double").isNotNull(), clamp01(e["salience"])).alias("salience"),
        ),
    )


def parse_canon(raw: Column, form: Column) -> Column:
    """A canonicalisation reply with safe defaults: the form as its name and among its aliases, confidence within 0..1."""
    schema = "canonical_name string, type string, aliases array<string>, wikidata_query string, is_br_gov_org boolean, confidence string, not_an_entity boolean"
    r = F.from_json(F.nullif(t.first_object(raw), F.lit("")), schema)
    aliases = F.filter(F.transform(F.coalesce(r["aliases"], F.array().cast("array<string>")), lambda s: F.trim(s)), lambda a: a != "")
    return F.struct(
        F.coalesce(F.nullif(F.trim(r["canonical_name"]), F.lit("")), form).alias("canonical_name"),
        t.sanctioned_type(r["type"]).alias("type"),
        F.array_distinct(F.concat(aliases, F.array(form))).alias("aliases"),
        clamp01(r["confidence"]).alias("confidence"),
        F.coalesce(r["not_an_entity"], F.lit(False)).alias("not_an_entity"),
    )


def raw_object(raw: Column) -> Column:
    """A reply as a JSON object: itself if it parses, else {"raw_text": ...}."""
    return F.coalesce(F.to_json(F.try_parse_json(raw)), F.to_json(F.struct(raw.alias("raw_text"))))


def usage(value: Column) -> Column:
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))


def total_usage(*calls: Column) -> Column:
    """Summed token counts of several calls (structs input_tokens, output_tokens)."""
    total = lambda c: sum((usage(call[c]) for call in calls[1:]), usage(calls[0][c])).alias(c)
    return F.struct(total("input_tokens"), total("output_tokens"))


def classify_prompt(title: Column, content: Column, outline: str) -> Column:
    return F.concat(
        F.lit("Classifique a notícia na taxonomia.\n"), F.lit(outline), F.lit("\nTítulo: "), F.coalesce(title, F.lit("")), F.lit("\nConteúdo: "),
        F.coalesce(t.preview(content, 2000), F.lit("")),
    )


def ner_prompt(title: Column, content: Column) -> Column:
    return F.concat(
        F.lit("Extraia as entidades.\nTítulo: "), F.coalesce(title, F.lit("")), F.lit("\nConteúdo: "), F.coalesce(t.preview(content, 3000), F.lit("")),
    )


def canon_prompt(form: Column, kind: Column, context: Column) -> Column:
    return F.concat(F.lit("Forma: "), form, F.lit("\nTipo: "), kind, F.lit("\nContexto: "), F.coalesce(t.preview(context, 1500), F.lit("")))


def homonym_prompt(form: Column, offered: Column, context: Column) -> Column:
    """offered: array of structs (qid, label)."""
    lines = F.array_join(F.transform(offered, lambda c: F.concat(F.lit("- "), c["qid"], F.lit(": "), F.coalesce(c["label"], F.lit("")))), "\n")
    return F.concat(
        F.lit("Qual candidato é a entidade? Responda só com o id.\nForma: "), form, F.lit("\nCandidatos:\n"), lines, F.lit("\nContexto: "),
        F.coalesce(t.preview(context, 1500), F.lit("")),
    )


def organic_prompt(title: Column, content: Column) -> Column:
    """Classification without a given taxonomy: the model makes the tree."""
    return F.concat(
        F.lit("Crie uma árvore temática de três níveis para a notícia, com códigos 01, 01.01 e 01.01.01.\nTítulo: "), F.coalesce(title, F.lit("")),
        F.lit("\nConteúdo: "), F.coalesce(t.preview(content, 2000), F.lit("")),
    )


def compact_prompt(title: Column, content: Column, outline: str) -> Column:
    """The classification prompt in few tokens: short outline and 1000 characters of content."""
    return F.concat(
        F.lit("Classifique (JSON): "), F.lit(outline), F.lit("\n"), F.coalesce(title, F.lit("")), F.lit("\n"),
        F.coalesce(t.preview(content, 1000), F.lit("")),
    )


def local_prompt(title: Column, content: Column, outline: str) -> Column:
    """For small local models: one instruction and one field a line."""
    return F.concat(
        F.lit("Responda apenas com o código do tema.\nTemas:\n"), F.lit(outline), F.lit("\nTítulo: "), F.coalesce(title, F.lit("")),
        F.lit("\nTexto: "), F.coalesce(t.preview(content, 1500), F.lit("")), F.lit("\nCódigo:"),
    )


def levels_prompt(title: Column, content: Column, outline: str, *, examples: str = "") -> Column:
    """For comparisons of prompts: lines "Nível n: code - label", with or without examples."""
    shots = F.lit(f"Exemplos:\n{examples}\n" if examples else "")
    return F.concat(
        F.lit("Classifique em três níveis.\n"), F.lit(outline), F.lit("\n"), shots, F.lit("Título: "), F.coalesce(title, F.lit("")),
        F.lit("\nConteúdo: "), F.coalesce(t.preview(content, 2000), F.lit("")), F.lit("\nNível 1: "),
    )


def replayed(prompts: DataFrame, raw_log: DataFrame, *, task: str) -> DataFrame:
    """Offline provider: the logged reply of each prompt, by its hash."""
    log = raw_log.filter(F.col("task") == task).groupBy("prompt_hash").agg(F.min("raw_response").alias("response"))
    return prompts.withColumn("prompt_hash", t.prompt_hash("prompt")).join(log, "prompt_hash", "left")


@dataclass(frozen=True)
class Waits:
    """Seconds a client waits: base * 2^n after failure n + 1, with a random part on top, and pause between calls."""

    base: float = 0.0
    jitter: float = 0.0
    pause: float = 0.0

    def after(self, attempt: int, draw: float) -> float:
        return self.base * 2.0**attempt + self.jitter * draw


#: Waits after throttled calls, after other failures, and of the mention extractor.
THROTTLED, FAILED, MENTIONS = Waits(1.0, 0.5), Waits(0.2), Waits(0.5, 0.5)


class Provider:
    """What a model client offers; subclasses give generate()."""

    name = "offline"

    def generate(self, prompt: str) -> str:
        raise NotImplementedError

    def __call__(self, prompt: str) -> str:
        return self.generate(prompt)

    def count_tokens(self, text: str) -> int:
        """Four characters a token, rounded up, where the model has no tokenizer at hand."""
        return -(-len(text) // 4)

    def stream(self, prompt: str) -> Iterator[str]:
        """The reply word by word; joined, the parts are the reply."""
        yield from re.findall(r"\s*\S+|\s+$", self.generate(prompt))


class Echo(Provider):
    """Offline provider: the last line of the prompt."""

    def generate(self, prompt: str) -> str:
        return prompt.rsplit("\n", 1)[-1]


#: Embedding models by name: category, dimension, and what makes the function from texts to a matrix.
EMBEDDERS = {
    "hashed-64": {"category": "offline", "dim": 64},
    "hashed-256": {"category": "offline", "dim": 256},
    "hashed-64-long": {"category": "long", "dim": 64},
}


def chosen_models(category: str = "all", names: list[str] | None = None) -> list[str]:
    """Names of the catalogue's models of a category ("all": any) and, where given, among names."""
    return [n for n, m in EMBEDDERS.items() if category in ("all", m["category"]) and (not names or n in names)]


def embedder(name: str) -> Callable[[list[str]], np.ndarray]:
    from newsloom.operators.retrieval import hashed_embedding

    dim = EMBEDDERS[name]["dim"]
    return lambda texts: hashed_embedding(texts, dim)


def timed(run: Callable[[list[str]], object], texts: list[str], *, iterations: int = 3, clock: Callable[[], float] = time.perf_counter) -> dict:
    """Texts a second over the mean of the iterations, and each iteration's milliseconds."""
    latencies = []
    for _ in range(iterations):
        began = clock()
        run(texts)
        latencies.append((clock() - began) * 1000)
    mean = sum(latencies) / len(latencies) / 1000
    return {"throughput": len(texts) / mean if mean > 0 else 0.0, "latencies_ms": latencies}


def provided(
    rows: DataFrame, make: Callable[[], Callable[[str], str]], *, attempts: int = 3, fallbacks: tuple = (), workers: int | None = None,
    waits: Waits = Waits(), sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Call a provider for each prompt, a client for each task; failures become error text, never a failed task.

    workers: tasks, and so clients, at a time at most (else one for each input partition). Between
    attempts and calls the client waits as told. The result should be written before it is used
    twice, so that no call is made again.
    """
    names = [*rows.columns, "response", "error"]
    rows = rows if workers is None else rows.repartition(workers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clients, draws = [f() for f in (make, *fallbacks)], random.Random()
        for b in batches:
            said, errors = [], []
            for prompt in b["prompt"]:
                answer, error = None, None
                for client in clients:
                    for k in range(attempts):
                        try:
                            answer, error = client(prompt), None
                            break
                        except Exception as e:  # noqa: BLE001
                            error = str(e)[:500]
                            if k < attempts - 1 and (wait := waits.after(k, draws.random())):
                                sleep(wait)
                    if answer is not None:
                        break
                said.append(answer)
                errors.append(error)
                if waits.pause:
                    sleep(waits.pause)
            yield b.assign(response=said, error=errors)[names]

    schema = T.StructType([*rows.schema.fields, T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])
    return rows.mapInPandas(run, schema)


def parse_levels(reply: Column) -> Column:
    """The theme fields of a reply in lines "Nível n: code - label"; the most specific is the deepest found."""
    said = F.coalesce(reply, F.lit(""))
    part = lambda n, k: F.nullif(F.trim(F.regexp_extract(said, rf"Nível {n}:\s*({'[0-9]+' if n == 1 else '[0-9.]+'})\s*-\s*(.+)", k)), F.lit(""))
    fields = {f"theme_1_level_{n}_{c}": part(n, k) for n in (1, 2, 3) for k, c in ((1, "code"), (2, "label"))}
    deepest = {f"most_specific_theme_{c}": F.coalesce(*[fields[f"theme_1_level_{n}_{c}"] for n in (3, 2, 1)]) for c in ("code", "label")}
    return F.struct(part(1, 2).alias("theme_1_level_1"), *[v.alias(k) for k, v in (fields | deepest).items()])


#: The columns that a failed enrichment leaves null.
FALLBACK = {f: "string" for f in (
    "theme_1_level_1", *[f"theme_1_level_{n}_{c}" for n in (1, 2, 3) for c in ("code", "label")], "most_specific_theme_code",
    "most_specific_theme_label", "summary",
)} | {"sentiment": "struct<label:string,score:double>"}


def fallback(rows: DataFrame) -> DataFrame:
    """Rows whose enrichment failed: their own columns, and the eleven enriched ones as null."""
    kept = [c for c in rows.columns if c not in FALLBACK]
    return rows.select(*kept, *[F.lit(None).cast(kind).alias(c) for c, kind in FALLBACK.items()])


def row_merge(rows: DataFrame, more: dict[str, Column]) -> DataFrame:
    """Rows with further columns; of a name that both have, the further one stays."""
    taken = {c.lower() for c in more}
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c.lower() not in taken], *[v.alias(c) for c, v in more.items()])


def mock_classification(articles: DataFrame, nodes: DataFrame) -> DataFrame:
    """Deterministic offline classifier: the first level-1 code for all."""
    first = nodes.filter("level = 1").agg(F.min_by(F.struct("code", "label"), "code").alias("n"))
    return articles.join(F.broadcast(first)).select(
        *articles.columns, F.col("n.code").alias("theme_1_level_1_code"), F.col("n.label").alias("theme_1_level_1_label")
    )


def enriched(articles: DataFrame, replies: DataFrame) -> DataFrame:
    """Articles with the parsed theme fields of their reply (null where there is none), right side winning."""
    parsed = replies.select("unique_id", parse_theme(F.col("response")).alias("p"))
    kept = [c for c in articles.columns if c not in {*THEME_FIELDS, "sentiment"}]
    return articles.select(*kept).join(parsed, "unique_id", "left").select(
        *kept, *[F.col(f"p.{f}").alias(f) for f in THEME_FIELDS], F.col("p.sentiment").alias("sentiment")
    )
