"""Line dedup: lines that many documents share are kept in one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, LOWER, UPPER, without


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Drop lines whose key occurs in at least min_docs documents, but for the largest id holding it.

    Lines are cut at \\n; a key is the line without white space (space, \\t to \\r) at both ends and
    with A-Z in lower case; keys of under min_chars code points are never dropped. Keys travel as two
    independently seeded 64-bit hashes, once for each document, and are counted with map-side
    combining, so a line found everywhere costs a row for each map task. Only the occurrences to be
    dropped go back to the documents, as positions, and each text is reassembled from the positions
    that are left.

    Returns the columns of docs with the text replaced, and n_lines and n_dropped (both long).

    Null or empty texts are one empty line. Each row counts as a document; rows with the same id all
    keep the line if that id is the largest, and a null id is smaller than any other. Input columns
    called n_lines or n_dropped are replaced. No rows in, no rows out.
    """
    line = lambda x: F.translate(F.btrim(x, F.lit(ASCII_SPACE)), UPPER, LOWER)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.split(text, "\n", -1)
    mark = F.xxhash64(text, F.length(text))

    each = docs.select(F.col(f"`{id_col}`").alias("id"), mark.alias("mark"), F.posexplode(lines).alias("pos", "raw"))
    each = each.withColumn("key", line(F.col("raw"))).filter(F.length("key") >= min_chars)
    each = each.select("id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))

    once = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.explode(F.array_distinct(F.transform(
            F.filter(F.transform(lines, line), lambda k: F.length(k) >= min_chars),
            lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2")),
        ))).alias("k"),
    ).select("id", "k.h1", "k.h2")
    common = once.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= min_docs).select("h1", "h2", "keeper")

    gone = each.join(common, ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("keeper")))
    gone = gone.groupBy("id", "mark").agg(F.collect_set("pos").alias("gone"))

    whole = docs.select(*without(docs, ["n_lines", "n_dropped"])).select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"), mark.alias("mark"))
    n = F.size(F.col("lines"))
    kept = F.when(F.col("gone").isNull(), F.col("whole_text")).otherwise(
        F.array_join(F.transform(F.sort_array(F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone"))), lambda i: F.get(F.col("lines"), i)), "\n")
    )
    rest = F.col("row")[text_col]
    out = whole.join(
        gone, whole["id"].eqNullSafe(gone["id"]) & (whole["mark"] == gone["mark"]), "left",
    ).select("row", "gone", F.coalesce(rest, F.lit("")).alias("whole_text"))
    out = out.withColumn("lines", F.split("whole_text", "\n", -1))
    names = whole.schema["row"].dataType.names
    return out.select(
        *[kept.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names],
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
