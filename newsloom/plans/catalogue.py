"""The catalogue of registered queries, with the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    """Add the decorated function under its name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@register(
    """
    SELECT source, count(*) AS n_docs, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share_pct,
           round(avg(n_chars), 6) AS mean_chars, min(n_chars) AS min_chars, max(n_chars) AS max_chars,
           quantile_cont(n_chars, 0.5)::DOUBLE AS median_chars, quantile_cont(n_chars, 0.95)::DOUBLE AS p95_chars
    FROM documents GROUP BY source
    """
)
def corpus_stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "n_chars")
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    by = docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"),
        F.percentile("n_chars", 0.5).alias("median_chars"), F.percentile("n_chars", 0.95).alias("p95_chars"),
    )
    by = by.join(F.broadcast(total))  # one row
    return by.select("source", "n_docs", F.round(F.lit(100.0) * F.col("n_docs") / F.col("total"), 6).alias("share_pct"), "mean_chars", "min_chars", "max_chars", "median_chars", "p95_chars")


def _load() -> None:
    from . import corpus_queries, entity_queries, retrieval_queries, state_queries, stream_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
