"""Chat formatting: reply trees become conversations in a template with reversible escapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Control strings of the template. Texts can hold none of them after escape().
BEGIN, MIDDLE, END = "<|turn|>", "<|says|>", "<|over|>"


def escape(x: Column) -> Column:
    """A backslash after each backslash and each "<": no text can then hold "<|"."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"[\\<]", r"$0\\")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"([\\<])\\", "$1")


def chains(turns: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply trees: each row answers the one before it, all score 0.

    Rows with equal turns go by role and text; a null turn is first.
    """
    order = Window.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def format_trees(messages: DataFrame, *, best: int = 1) -> DataFrame:
    """Enumerate root-to-leaf paths of reply trees, rank them by score and format the best of each.

    messages: conv_id, node, parent (null or absent in the conversation: a root), role, text, score.
    Ancestor links double in length with each self-join, so paths of depth d take log2(d) joins;
    the same joins add up each leaf's depth and score. Leaves of a conversation rank by the sum of
    the scores on their path, longer paths first among equals, then smaller node. Walking the stored
    links back from the chosen leaves gives each chosen path's nodes with their place. A formatted
    conversation is one string, so one conversation is at most the 2 GB that Spark's strings hold.

    Returns a row for each chosen path: conv_id, branch (int, from 1), score, n_turns (long),
    formatted (string) and loss (array of start, length: spans of formatted that hold the
    assistant's escaped texts; code points, from 0).

    Null roles, texts and scores are empty or 0. Of rows that repeat (conv_id, node) the one of
    smallest role and text stays; rows without a node take no part. Rows whose ancestors form a cycle
    hang on no root and take no part. Extra columns are ignored. Rows of null conv_id are one
    conversation. No rows in, no rows out.
    """
    first = Window.partitionBy("conv_id", "node").orderBy(F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = messages.select("conv_id", "node", "parent", "role", "text", F.coalesce(F.col("score"), F.lit(0.0)).cast("double").alias("score"))
    rows = rows.filter("node is not null").withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")
    rows = materialise(rows.withColumn("c", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))), "chat-rows")
    deepest = max(1, rows.count()).bit_length() + 1

    there = rows.select("c", F.col("node").alias("parent"), F.lit(True).alias("known"))
    links = rows.join(there, ["c", "parent"], "left").select(
        "c", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.col("score").alias("gain"), F.lit(1).cast("long").alias("steps"),
    )
    levels = [materialise(links, "chat-links")]
    while len(levels) <= deepest and levels[-1].filter("up is not null").limit(1).count():
        # only rows whose link has not come to a root yet are joined again
        ahead = levels[-1]
        for done in levels[:-1]:
            ahead = ahead.unionByName(done.filter("up is null"))
        ahead = ahead.select("c", F.col("node").alias("up"), F.col("up").alias("far"), F.col("gain").alias("more"), F.col("steps").alias("on"))
        step = levels[-1].filter("up is not null").join(ahead, ["c", "up"])
        levels.append(materialise(
            step.select("c", "node", F.col("far").alias("up"), (F.col("gain") + F.col("more")).alias("gain"), (F.col("steps") + F.col("on")).alias("steps")),
            "chat-links",
        ))

    totals = levels[0].filter("up is null")
    for links in levels[1:]:
        totals = totals.unionByName(links.filter("up is null"))
    inner = rows.select("c", F.col("parent").alias("node")).filter("node is not null").distinct()
    rank = Window.partitionBy("c").orderBy(F.desc("gain"), F.desc("steps"), "node")
    leaves = totals.join(inner, ["c", "node"], "left_anti").withColumn("branch", F.row_number().over(rank)).filter(F.col("branch") <= best)
    on_path = leaves.select("c", "branch", F.col("gain").alias("path_score"), "node", F.col("steps").alias("n_turns"))
    for links in reversed(levels[:-1]):
        jump = links.filter("up is not null").select("c", "node", "up")
        on_path = on_path.join(jump, ["c", "node"], "left").select(
            "c", "branch", "path_score", "n_turns", F.explode(F.array_compact(F.array("node", "up"))).alias("node"),
        )

    place = totals.select("c", "node", F.col("steps").alias("at"))
    said = on_path.join(place, ["c", "node"]).join(rows.select("c", "node", "conv_id", "role", "text"), ["c", "node"])
    said = said.withColumns({"piece_role": escape(F.col("role")), "piece_text": escape(F.col("text")), "learn": F.coalesce("role", F.lit("")) == "assistant"})
    said = said.withColumn("piece", F.concat(F.lit(BEGIN), "piece_role", F.lit(MIDDLE), "piece_text", F.lit(END)))
    before = Window.partitionBy("c", "branch").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    said = said.withColumn(
        "start", F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)) + F.length("piece_role") + F.lit(len(BEGIN) + len(MIDDLE)),
    )
    span = F.when(F.col("learn"), F.struct(F.col("start").cast("long").alias("start"), F.length("piece_text").cast("long").alias("length")))
    paths = said.groupBy("c", "branch").agg(
        F.first("conv_id").alias("conv_id"), F.first("path_score").alias("score"), F.first("n_turns").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"), F.array_sort(F.collect_list(span)).alias("loss"),
    )
    return paths.select(
        "conv_id", F.col("branch").cast("int").alias("branch"), "score", F.col("n_turns").cast("long").alias("n_turns"),
        F.array_join("pieces.piece", "").alias("formatted"), "loss",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations: conv_id, branch, turns (array of role, text), learned (the texts under the loss mask), formatted_chars."""
    parts = F.split(F.col("formatted"), r"\Q" + END + r"\E", -1)
    pieces = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    role = lambda p: F.substring_index(p, MIDDLE, 1)
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substr(role(p), F.lit(len(BEGIN) + 1))).alias("role"),
            unescape(F.substr(p, F.length(role(p)) + F.lit(len(MIDDLE) + 1))).alias("text"),
        ),
    )
    learned = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", "branch", turns.alias("turns"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
