"""Evaluation: ranking, classification, summary and agreement measures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import vectors as v


def ranking_metrics(lists: DataFrame, *, k: int = 10, by: str = "query_id", relevant: int = 1) -> DataFrame:
    """NDCG@k, average precision and reciprocal rank of each list (by, rank, relevance).

    The ideal order is that of the list itself; average precision divides by the relevant rows
    retrieved. Lists without relevant rows score 0.
    """
    order, ideal = Window.partitionBy(by).orderBy("rank"), Window.partitionBy(by).orderBy(F.desc("relevance"), "rank")
    hit = (F.col("relevance") >= relevant).cast("int")
    rows = lists.withColumns({"hit": hit, "best": F.row_number().over(ideal)}).withColumn(
        "hits", F.sum("hit").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    )
    gain = lambda place: F.sum(F.when(F.col(place) <= k, F.col("relevance") / F.log2(F.col(place) + F.lit(1.0))).otherwise(0.0))
    out = rows.groupBy(by).agg(
        gain("rank").alias("dcg"), gain("best").alias("idcg"),
        F.try_divide(F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank")).otherwise(0.0)), F.sum("hit").cast("double")).alias("ap"),
        F.try_divide(F.lit(1.0), F.min(F.when(F.col("hit") == 1, F.col("rank"))).cast("double")).alias("rr"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(by, zero(F.try_divide("dcg", "idcg")).alias("ndcg"), zero(F.col("ap")).alias("ap"), zero(F.col("rr")).alias("rr"))


def recall_at_k(lists: DataFrame, totals: DataFrame, *, k: int, by: str = "query_id") -> DataFrame:
    """Relevant rows within k over all relevant ones (totals: by, n_relevant)."""
    found = lists.filter((F.col("rank") <= k) & (F.col("relevance") > 0)).groupBy(by).agg(F.count(F.lit(1)).alias("found"))
    return totals.join(found, by, "left").select(
        by, F.coalesce(F.try_divide(F.coalesce("found", F.lit(0)).cast("double"), F.col("n_relevant").cast("double")), F.lit(0.0)).alias("recall"),
    )


def judged(rankings: DataFrame, annotations: DataFrame) -> DataFrame:
    """Relevance of ranked documents; what nobody judged is 0."""
    return rankings.join(annotations, ["query_id", "doc_id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0)))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))


def f1_by_label(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each label of (truth, pred)."""
    sides = rows.select(
        F.explode(F.array(
            F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")),
            F.struct(F.col("pred").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")),
        )).alias("s"),
        (F.col("truth") == F.col("pred")).cast("int").alias("ok"),
    )
    by = sides.groupBy("s.label").agg(F.sum(F.col("ok") * F.col("s.t")).alias("tp"), F.sum("s.p").alias("n_pred"), F.sum("s.t").alias("support"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    out = by.withColumns({"precision": ratio("tp", "n_pred"), "recall": ratio("tp", "support")})
    return out.withColumn("f1", F.coalesce(F.try_divide(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def averages(by_label: DataFrame) -> DataFrame:
    """One row from f1_by_label(): macro and support-weighted precision, recall and F1."""
    total = F.sum("support").cast("double")
    out = [F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    out += [F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), total), F.lit(0.0)).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]
    return by_label.agg(*out)


def accuracy_by_level(rows: DataFrame, levels: dict[str, tuple[str, str]]) -> DataFrame:
    """level, accuracy, n for each (truth, prediction) pair of columns; rows without a true label do not count, one without a prediction is wrong."""
    sides = [F.struct(F.lit(k).alias("level"), F.col(a).cast("string").alias("truth"), F.col(b).cast("string").alias("pred")) for k, (a, b) in levels.items()]
    each = rows.select(F.explode(F.array(*sides)).alias("s")).select("s.*").filter("truth is not null")
    return each.groupBy("level").agg(
        F.avg(F.coalesce((F.col("truth") == F.col("pred")).cast("double"), F.lit(0.0))).alias("accuracy"), F.count(F.lit(1)).alias("n"),
    )


def mean_over_queries(per_query: DataFrame, measures: list[str], by: list[str] | None = None) -> DataFrame:
    """Means of measures by query; null measures count as 0."""
    return per_query.groupBy(*(by or [])).agg(*[F.avg(F.coalesce(c, F.lit(0.0))).alias(c) for c in measures], F.count(F.lit(1)).alias("n_queries"))


def search_report(results: DataFrame, queries: DataFrame) -> DataFrame:
    """One row over all queries (query_id, expected): share whose best result has the expected category, mean best score, mean number of results.

    results: query_id, rank, score, category. Queries without results count with score and number 0.
    """
    own = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"), F.min_by("category", "rank").alias("category"))
    rows = queries.select("query_id", "expected").join(own, "query_id", "left")
    match = F.coalesce((F.col("category") == F.col("expected")).cast("double"), F.lit(0.0))
    return rows.agg(
        F.avg(match).alias("match_rate"), F.avg(F.coalesce("top", F.lit(0.0))).alias("mean_top_score"),
        F.avg(F.coalesce("n", F.lit(0))).alias("mean_results"),
    )


def agreement(a: Column, b: Column, c: Column) -> Column:
    n = F.size(F.array_distinct(F.array(a, b, c)))
    return F.when(n == 1, "total").when(n == 2, "partial").otherwise("none")


def majority(a: Column, b: Column, c: Column) -> Column:
    """The label of two or three; the first where all differ."""
    return F.when(a == b, a).when(a == c, a).when(b == c, b).otherwise(a)


def wilson(ok: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """Wilson's interval for a share, as struct low, high."""
    p = ok / n
    mid, span = p + F.lit(z * z) / (2 * n), F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n))
    return F.struct(((mid - span) / (1 + F.lit(z * z) / n)).alias("low"), ((mid + span) / (1 + F.lit(z * z) / n)).alias("high"))


def _upper_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial."""
    from math import exp, lgamma, log

    if p <= 0 or p >= 1:
        return float(k <= 0 or p >= 1)
    logs = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p) for i in range(k, n + 1)]
    top = max(logs, default=0.0)
    return exp(top) * sum(exp(x - top) for x in logs)


def exact_interval(ok: int, n: int, *, confidence: float = 0.95, steps: int = 60) -> tuple[float, float]:
    """Exact binomial (Clopper and Pearson) interval for ok of n, by bisection on the binomial tails."""
    half = (1 - confidence) / 2

    def root(k: int, target: float) -> float:
        low, high = 0.0, 1.0
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if _upper_tail(k, n, mid) < target else (low, mid)
        return (low + high) / 2

    return (0.0 if ok == 0 else root(ok, half)), (1.0 if ok == n else root(ok + 1, 1 - half))


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def binomial_interval(ok: pd.Series, n: pd.Series) -> pd.DataFrame:
    """exact_interval() of counts that are aggregated already: a row for each group."""
    return pd.DataFrame([exact_interval(int(a), int(b)) if b else (0.0, 1.0) for a, b in zip(ok, n, strict=True)], columns=["low", "high"])


def grams(tokens: Column, n: int) -> Column:
    size = F.size(tokens)
    return F.when(
        size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " ")),
    ).otherwise(F.array().cast("array<string>"))


def rouge_n(pairs: DataFrame, *, n: int, key: str = "id") -> DataFrame:
    """ROUGE-n F1 of (key, candidate, reference), from multisets of n-grams; 0 without any."""
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    side = lambda c, a, b: F.struct(words(c).alias("words"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    # one pass over the texts: words are cut before the sides are exploded, grams after
    sides = pairs.select(key, F.explode(F.array(side("candidate", 1, 0), side("reference", 0, 1))).alias("s"))
    each = sides.select(key, "s.a", "s.b", F.explode_outer(grams(F.col("s.words"), n) if n > 1 else F.col("s.words")).alias("g"))
    counts = each.groupBy(key, "g").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("real", F.col("g").isNotNull().cast("int"))
    sums = counts.groupBy(key).agg(F.sum(F.least("a", "b") * F.col("real")).alias("hit"), F.sum((F.col("a") + F.col("b")) * F.col("real")).alias("all"))
    return sums.select(key, F.coalesce(F.try_divide(F.lit(2.0) * F.col("hit"), F.col("all").cast("double")), F.lit(0.0)).alias(f"rouge_{n}"))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two token arrays: one row of the table at a time."""
    zero = F.transform(b, lambda _: F.lit(0))

    def step(row: Column, x: Column) -> Column:
        diagonal = F.concat(F.array(F.lit(0)), F.slice(row, 1, F.greatest(F.size(row) - 1, F.lit(0))))
        options = F.zip_with(F.zip_with(b, diagonal, lambda y, d: F.when(x == y, d + 1).otherwise(0)), row, lambda p, q: F.greatest(p, q))
        start = F.expr("cast(array() as array<int>)")
        return F.aggregate(options, start, lambda acc, o: F.concat(acc, F.array(F.greatest(o, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))))))

    last = F.aggregate(a, zero, step)
    return F.coalesce(F.try_element_at(last, F.lit(-1)), F.lit(0))


def _lcs(a: list[str], b: list[str]) -> int:
    """Bit-parallel over the shorter side: one pass over the longer."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for k, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << k
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def rouge_l_long(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    """rouge_l() for texts of any length, in Arrow batches."""
    return pd.Series([2.0 * _lcs(list(a), list(b)) / (len(a) + len(b)) if len(a) + len(b) else 0.0 for a, b in zip(candidate, reference, strict=True)])


def rouge_l(candidate: Column, reference: Column) -> Column:
    """ROUGE-L F1 of two token arrays."""
    return F.coalesce(F.try_divide(F.lit(2.0) * lcs_length(candidate, reference), (F.size(candidate) + F.size(reference)).cast("double")), F.lit(0.0))


def rouge_band(x: Column) -> Column:
    return F.when(x >= 0.55, "high").when(x >= 0.45, "medium").otherwise("low")


#: Measure, low, high, points, whether less is better.
SCORE_PARTS = (
    ("ndcg_general", 0.70, 0.90, 25, False), ("ndcg_jargon", 0.70, 0.90, 25, False), ("map", 0.70, 0.90, 10, False), ("mrr", 0.75, 0.95, 5, False),
    ("throughput", 50, 150, 15, False), ("latency_p99", 500, 100, 10, True), ("ndcg_long", 0.60, 0.85, 10, False),
)


def weighted_score(compat: bool = True) -> Column:
    """100-point score of a model. compat keeps the rule by which a high latency earns points."""
    total = F.lit(0.0)
    for name, low, high, points, reverse in SCORE_PARTS:
        lo, hi = (min(low, high), max(low, high)) if reverse else (low, high)
        total = total + v.scaled(F.col(name), low if reverse and compat else lo, high if reverse and compat else hi, reverse, compat) * points
    return F.round(total, 1)


def choose_reranker(gain: Column, latency_ratio: Column, cost_per_1k: Column) -> Column:
    """Worth it at over 5 % gain, under 50 % more latency and under 0.01 a thousand."""
    return (gain > 0.05) & (latency_ratio < 0.5) & (cost_per_1k < 0.01)
