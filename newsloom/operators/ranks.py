"""Ranks and running sums within groups of any size: no group has to fit a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.sources.scratch import materialise


def running(df: DataFrame, *, by: list[str], order: list[Column | str], value: Column | None = None) -> DataFrame:
    """df with place (rank within by, from 0) and before (sum of value over the rows ranked before).

    Rows are dealt by range of (by, order), so a group that holds a third of all rows spans many
    partitions. Windows run inside a partition; what came before it in the group is added from the
    groups' counts by partition, a row for each group in each partition. Order has to be total, or
    ties take their places in any order.
    """
    value = F.lit(0) if value is None else value
    dealt = df.withColumn("_value", value).repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    dealt = materialise(dealt, "ranges")
    own = Window.partitionBy(*by, "_part").orderBy(*order)
    local = dealt.withColumns({
        "_place": F.row_number().over(own) - 1, "_before": F.coalesce(F.sum("_value").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.sum("_value").alias("_sum"))
    parts = parts.select(
        *by, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carried"),
    )
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "_part"]]
    out = local.alias("l").join(parts.alias("r"), same)
    return out.select(
        *[F.col(f"l.`{c}`") for c in df.columns], (F.col("l._place") + F.col("r._first")).alias("place"),
        (F.col("l._before") + F.col("r._carried")).alias("before"),
    )


def percentiles(df: DataFrame, *, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, a column for each of shares; nulls do not count.

    Only the rows at the two ranks around each percentile reach the aggregation.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_x")).filter("_x is not null")
    placed = running(rows, by=by, order=["_x"])
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
    joined = placed.alias("p").join(sizes.alias("s"), same).select(*[F.col(f"p.{c}") for c in by], "_x", "place", "_n")
    out = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("_n") - 1)
        low, high = F.floor(at), F.ceil(at)
        a, b = F.max(F.when(F.col("place") == low, F.col("_x"))), F.max(F.when(F.col("place") == high, F.col("_x")))
        out.append((a + (b - a) * F.max(at - low)).alias(name))
    return joined.groupBy(*by).agg(*out)
