"""Corpus statistics, samples, splits, triplets, extractive summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators import ranks


def length_stats(docs: DataFrame, size: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, median, sample deviation, min, max and P95 (linear interpolation)."""
    return docs.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg(size).alias("mean"), F.percentile(size, 0.5).alias("median"), F.stddev_samp(size).alias("stddev"),
        F.min(size).alias("least"), F.max(size).alias("most"), F.percentile(size, 0.95).alias("p95"),
    )


def length_profile(size: Column) -> Column:
    return F.when(size <= 3000, "short").when(size <= 5500, "medium").otherwise("long")


def term_count(text: Column, terms: list[str]) -> Column:
    """How often any of the terms (ASCII words) stands alone in a text, in any case."""
    plain = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x00-\x7F]", "_"))
    return F.size(F.regexp_extract_all(plain, F.lit(rf"\b(?:{'|'.join(terms)})\b"), F.lit(0)))


def top_values(df: DataFrame, column: str, *, k: int) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def draw(key: Column, seed: int) -> Column:
    """A reproducible random order: the MD5 of key and seed."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary"))


def stratified_sample(df: DataFrame, *, by: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each stratum; the limit applies in each partition before the shuffle."""
    order = Window.partitionBy(by).orderBy(draw(F.col(key), seed), key)
    return df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def stratified_split(df: DataFrame, *, by: str, key: str, shares: tuple[float, float] = (0.7, 0.1), seed: int = 42) -> DataFrame:
    """train / validation / test within each stratum, in drawn order; a stratum may hold any share of all rows."""
    placed = ranks.running(df.withColumn("_draw", draw(F.col(key), seed)), by=[by], order=["_draw", key])
    sizes = df.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_n"))
    place = F.col("place") / F.col("_n")
    out = placed.join(sizes, F.col(by).eqNullSafe(F.col("_by"))).withColumn(
        "split", F.when(place < shares[0], "train").when(place < sum(shares), "validation").otherwise("test"),
    )
    return out.select(*df.columns, "split")


def split_by_base(rows: DataFrame, *, base: str, shares: tuple[float, float] = (0.7, 0.1), seed: int = 42) -> DataFrame:
    """train / validation / test of variants by the query they come from: all variants of a base fall into one part.

    The part is read off the base's draw, row by row, so shares hold on average.
    """
    place = F.conv(F.substring(draw(F.col(base), seed), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return rows.withColumn("split", F.when(place < shares[0], "train").when(place < sum(shares), "validation").otherwise("test"))


def score_distribution(pairs: DataFrame, *, score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Count, mean, least and most of a score, and the ids of the pair of the lowest and of the highest (id_a, id_b; ties to the smaller)."""
    pair = F.struct("id_a", "id_b")
    low = F.min(F.struct(F.col(score).alias("s"), pair.alias("pair")))
    high = F.min(F.struct((-F.col(score)).alias("s"), pair.alias("pair")))
    rows = pairs.filter(F.col(score).isNotNull()).groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), low.alias("low"), high.alias("high"),
    )
    return rows.select(
        *(by or []), "n", "mean", F.col("low.s").alias("least"), (-F.col("high.s")).alias("most"), F.col("low.pair.id_a").alias("least_a"),
        F.col("low.pair.id_b").alias("least_b"), F.col("high.pair.id_a").alias("most_a"), F.col("high.pair.id_b").alias("most_b"),
    )


def triplets(annotations: DataFrame, *, positive: int = 2) -> DataFrame:
    """All (positive, negative) pairs of each query: relevance of at least `positive` against 0. Queries lacking either give none."""
    pos = annotations.filter(F.col("relevance") >= positive).select("query_id", F.col("doc_id").alias("positive"))
    neg = annotations.filter(F.col("relevance") == 0).select("query_id", F.col("doc_id").alias("negative"))
    return pos.join(neg, "query_id")


def textrank_sentences(
    text: str, n: int, *, damping: float = 0.85, redundancy: float = 0.7, rounds: int = 50, block: int = 1024, held: int = 1 << 24,
) -> list[str]:
    """The n best sentences in their order: power iteration over word overlap, early ones boosted, near repeats skipped.

    Similarities are computed in blocks of rows and kept up to `held` of them; those of longer texts
    are computed again in each round.
    """
    import re

    sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", text) if len(s.strip()) >= 20]
    if not sentences:
        return []
    bags = [set(re.findall(r"\w+", s.lower())) for s in sentences]
    m = len(bags)
    postings: dict[str, list[int]] = {}
    for i, bag in enumerate(bags):
        for w in bag:
            postings.setdefault(w, []).append(i)
    places = {w: np.array(p) for w, p in postings.items()}
    logs = np.log(np.array([len(bag) for bag in bags]) + 1.0)

    def walk_rows(at: int) -> np.ndarray:
        like = np.zeros((min(block, m - at), m))
        for r in range(len(like)):
            if bags[at + r]:
                shared = np.bincount(np.concatenate([places[w] for w in bags[at + r]]), minlength=m)
                shared[at + r] = 0
                np.divide(shared, logs[at + r] + logs, out=like[r], where=shared > 0)
        sums = like.sum(axis=1, keepdims=True)
        return like / np.where(sums == 0, 1, sums)

    starts, rank = range(0, m, block), np.full(m, 1 / m)
    kept_rows = {at: walk_rows(at) for at in starts} if m * m <= held else {}
    for _ in range(rounds):
        flow = np.zeros(m)
        for at in starts:
            rows = kept_rows[at] if kept_rows else walk_rows(at)
            flow += rows.T @ rank[at : at + len(rows)]
        rank = (1 - damping) / m + damping * flow
    rank = rank * (1 + 0.2 * (1 - np.arange(m) / m))
    kept: list[int] = []
    for i in np.argsort(-rank, kind="stable"):
        if len(kept) == n:
            break
        if all(len(bags[i] & bags[j]) < redundancy * max(1, min(len(bags[i]), len(bags[j]))) for j in kept):
            kept.append(int(i))
    return [sentences[i] for i in sorted(kept)]


def textrank(docs: DataFrame, *, n: int = 3) -> DataFrame:
    """id, summary. All sentences of a text are ranked together, whatever its length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "summary": [" ".join(textrank_sentences(s, n)) for s in b["text"].fillna("")]})

    return docs.select("id", "text").mapInPandas(run, "id long, summary string")


def synthetic_corpus(spark, *, documents: int = 250, queries: int = 60, notes: int = 75) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A generated corpus for trials: documents, queries, annotations; the same at each call."""
    kinds = F.array(*[F.lit(c) for c in ("economia", "saude", "educacao", "cultura", "seguranca")])
    kind = lambda k: F.get(kinds, (F.col("id") % 5).cast("int")).alias(k)
    text = F.concat_ws(
        " ", F.lit("Documento"), F.col("id").cast("string"), F.get(kinds, (F.col("id") % 5).cast("int")),
        F.repeat(F.lit("texto "), (F.col("id") % 40 + 1).cast("int")),
    )
    docs = spark.range(documents).select(
        F.format_string("doc_%04d", "id").alias("id"), F.concat(F.lit("Título "), F.col("id").cast("string")).alias("title"), text.alias("content"),
        kind("category"), F.length(text).alias("length"),
    )
    asks = spark.range(queries).select(
        F.format_string("q_%03d", "id").alias("id"), F.concat_ws(" ", F.lit("sobre"), F.get(kinds, (F.col("id") % 5).cast("int"))).alias("text"),
        F.when(F.col("id") % 3 == 0, "jargon").otherwise("general").alias("query_type"), kind("expected_category"),
    )
    marks = spark.range(notes).select(
        F.format_string("q_%03d", F.col("id") % queries).alias("query_id"),
        F.format_string("doc_%04d", (F.col("id") * 7) % documents).alias("doc_id"), (F.col("id") % 4).cast("int").alias("relevance"),
        F.lit(None).cast("string").alias("notes"),
    )
    return docs, asks, marks


def lexrank_sentences(text: str, n: int, *, threshold: float = 0.1, damping: float = 0.85, rounds: int = 100) -> list[str]:
    """The n best sentences in their order: power iteration over links between sentences of TF-IDF cosine `threshold` or more.

    Document frequencies are those of the text's own sentences. Links are found by shared words, a
    sentence at a time, so a long text costs its links and no square matrix.
    """
    import re

    sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", text) if len(s.strip()) >= 20]
    m = len(sentences)
    if m <= n:
        return sentences
    counts = [dict(zip(*np.unique(re.findall(r"\w+", s.lower()) or [""], return_counts=True), strict=True)) for s in sentences]
    postings: dict[str, list[int]] = {}
    for i, bag in enumerate(counts):
        for w in bag:
            postings.setdefault(w, []).append(i)
    idf = {w: np.log(m / len(p)) for w, p in postings.items()}
    weights = [{w: k * idf[w] for w, k in bag.items()} for bag in counts]
    norms = np.sqrt([sum(x * x for x in bag.values()) for bag in weights])
    out: list[np.ndarray] = []
    for i, bag in enumerate(weights):
        dots = np.zeros(m)
        for w, x in bag.items():
            if idf[w]:
                for j in postings[w]:
                    dots[j] += x * weights[j][w]
        near = dots >= threshold * norms[i] * norms - 1e-12 if norms[i] else np.zeros(m, bool)
        near &= norms > 0
        near[i] = True
        out.append(np.flatnonzero(near))
    degree = np.array([len(o) for o in out])
    source, target = np.repeat(np.arange(m), degree), np.concatenate(out)
    rank = np.full(m, 1 / m)
    for _ in range(rounds):
        rank = (1 - damping) / m + damping * np.bincount(target, rank[source] / degree[source], minlength=m)
    best = np.lexsort((np.arange(m), -np.round(rank, 12)))[:n]
    return [sentences[i] for i in sorted(best)]


def lexrank(docs: DataFrame, *, n: int = 3) -> DataFrame:
    """id, summary. All sentences of a text are ranked together, whatever its length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "summary": [" ".join(lexrank_sentences(s, n)) for s in b["text"].fillna("")]})

    return docs.select("id", "text").mapInPandas(run, "id long, summary string")


def document_text(title: Column, content: Column) -> Column:
    """Title, a blank line, content; a missing part is empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(content, F.lit("")))


def iso(at: Column) -> Column:
    """ISO 8601 without fractions."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def without_tail(rows: DataFrame, size: Column, *, most: int) -> DataFrame:
    """Rows of at most a size; rows without one stay out."""
    return rows.filter(size <= most)


def recent(rows: DataFrame, date: str, *, key: str, n: int) -> DataFrame:
    """The n most recent rows that have a date; ties go to the smaller key. A limit below the sort, no full one."""
    return rows.filter(F.col(date).isNotNull()).orderBy(F.desc(date), key).limit(n)


def nested_annotations(notes: DataFrame) -> DataFrame:
    """One row a query: a map from document to relevance. A query's judged documents are few, as people judge them."""
    return notes.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("doc_id", "relevance"))).alias("judged"))


def flat_annotations(nested: DataFrame) -> DataFrame:
    return nested.select("query_id", F.explode("judged").alias("doc_id", "relevance"))


def batch_outcome(ok: Column, n: Column) -> Column:
    return F.when(ok == n, "success").when(ok == 0, "failed").otherwise("partial")


def break_even(fixed_month: float, per_query: float) -> float:
    """Queries an hour from which a fixed monthly price is the cheaper one."""
    return fixed_month / per_query / (30 * 24)


def triplet_loss(positive: Column, negative: Column, margin: float = 0.2) -> Column:
    return F.greatest(F.lit(0.0), F.lit(margin) + negative - positive)


def aligned(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Exactly these fields (name: type), those that are missing as null."""
    return df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in fields.items()])


def required(df: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that have all required fields, and the others with the names of what they lack."""
    missing = [c for c in fields if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    lack = F.filter(F.array(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    rows = df.withColumn("lacks", lack)
    return rows.filter(F.size("lacks") == 0).drop("lacks"), rows.filter(F.size("lacks") > 0)
