"""Three-level taxonomies."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as t

_NODE = re.compile(r"(\d\d(?:\.\d\d){0,2}) - (.+?):?\s*$")


def parse_outline(text: str) -> list[tuple[str, str, int, str | None]]:
    """(code, label, level, parent_code) of an outline of "code - label" lines; labels may hold " - "."""
    out = []
    for line in text.splitlines():
        if m := _NODE.search(line.strip().lstrip("-").strip().strip("'\"")):
            code = m[1]
            out.append((code, m[2].strip("'\""), code.count(".") + 1, code.rpartition(".")[0] or None))
    return out


def themes(spark: SparkSession, outline: str) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(parse_outline(outline), 1)]
    return spark.createDataFrame(rows, "id int, code string, label string, level int, parent_code string")


def hierarchy(nodes: DataFrame) -> DataFrame:
    """Level-3 rows with their parents (two equi-joins); rows whose parent is missing drop out."""
    level = lambda n, s: nodes.filter(F.col("level") == n).select(
        F.col("code").alias(f"l{n}_code"), F.col("label").alias(f"l{n}_label"), *([F.col("parent_code").alias(s)] if s else []),
    )
    return level(3, "l2_code").join(level(2, "l1_code"), "l2_code").join(level(1, None), "l1_code")


def nested(nodes: DataFrame) -> DataFrame:
    """One row a level-1 code: code, label, children (array of code, label, children of level 3), all in order of code."""
    third = nodes.filter("level = 3").groupBy("parent_code").agg(F.array_sort(F.collect_list(F.struct("code", "label"))).alias("children"))
    second = nodes.filter("level = 2").select("code", "label", F.col("parent_code").alias("up")).join(
        third.withColumnRenamed("parent_code", "code"), "code", "left",
    )
    empty = F.expr("cast(array() as array<struct<code:string,label:string>>)")
    second = second.groupBy("up").agg(F.array_sort(F.collect_list(F.struct(
        "code", "label", F.coalesce("children", empty).alias("children"),
    ))).alias("children"))
    return nodes.filter("level = 1").select("code", "label").join(second.withColumnRenamed("up", "code"), "code", "left")


def sizes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("level").agg(F.count(F.lit(1)).alias("n_nodes"))


def attach_ids(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ids for l1, l2 and l3 codes; the most specific is the deepest found; rows without any drop out."""
    out = rows
    for n in (1, 2, 3):
        ids = nodes.select(F.col("code").alias(f"l{n}"), F.col("id").alias(f"theme_l{n}_id"))
        out = out.join(ids, f"l{n}", "left")
    return out.withColumn("most_specific_theme_id", F.coalesce("theme_l3_id", "theme_l2_id", "theme_l1_id")).filter("most_specific_theme_id is not null")


def categorised(rows: DataFrame, topics: DataFrame, *, said: str, default: str) -> DataFrame:
    """rows with code: a topic from a free prediction, by its code, "code - name", its name, or its area's first topic; else the default.

    topics: code, name, area. What can be said of a topic is normalised once for each topic, a
    prediction once for each row; they meet in one equi-join.
    """
    ways = [F.col("code"), F.concat("code", F.lit(" - "), "name"), F.col("name"), F.col("area")]
    known = topics.select("code", F.posexplode(F.array(*[t.normalize(w) for w in ways])).alias("way", "_said"))
    best = known.groupBy("_said").agg(F.min(F.struct("way", "code"))["code"].alias("code"))
    out = rows.withColumn("_said", t.normalize(said)).join(best, "_said", "left")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce("code", F.lit(default)).alias("code"))
