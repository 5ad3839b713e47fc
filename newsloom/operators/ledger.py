"""Token-budget ledger: usage by day and model, cut-offs, request rates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators import ranks


def daily_usage(usage: DataFrame) -> DataFrame:
    """Additive upsert: (day, model_id) with summed input and output tokens; missing counts are 0."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    return usage.groupBy("day", "model_id").agg(total("input_tokens"), total("output_tokens"))


def record_usage(ledger: DataFrame, usage: DataFrame) -> DataFrame:
    columns = ["day", "model_id", "input_tokens", "output_tokens"]
    return daily_usage(ledger.select(columns).unionByName(usage.select(columns)))


def parse_quota(raw: str | None) -> dict[str, int]:
    """{model: tokens a day} from JSON; anything else is no quota."""
    try:
        found = json.loads(raw or "")
    except ValueError:
        return {}
    out = {}
    for k, v in found.items() if isinstance(found, dict) else ():
        try:
            out[str(k)] = int(v)
        except (TypeError, ValueError):
            continue
    return out


def exhausted(ledger: DataFrame, quota: dict[str, int], *, fraction: float = 0.8, extra: int = 0) -> DataFrame:
    """Whether a model's day has used fraction of its quota; never without a quota."""
    limits = F.create_map(*[F.lit(x) for kv in quota.items() for x in kv]) if quota else F.expr("cast(map() as map<string,int>)")
    limit = F.element_at(limits, F.col("model_id"))
    used = F.col("input_tokens") + F.col("output_tokens") + extra
    return ledger.withColumns({"used": used, "exhausted": F.coalesce((limit > 0) & (used >= fraction * limit), F.lit(False))})


def cut_off(work: DataFrame, *, budget: int, every: int = 5, by: list[str], order: list) -> DataFrame:
    """Queue rows with the block they are checked in; rows of a block run if what came before it is under the budget."""
    rows = ranks.running(work, by=by, order=order, value=F.coalesce("tokens", F.lit(0)))
    rows = rows.withColumn("block", F.floor(F.col("place") / every).cast("long")).withColumnRenamed("before", "spent").drop("place")
    first = Window.partitionBy(*by, "block")
    return rows.withColumn("runs", F.min("spent").over(first) < budget)


def request_rate(events: DataFrame, *, by: str, ts: str, seconds: int = 60) -> DataFrame:
    """Requests within the last `seconds` seconds, this one included.

    Windows are over a key's rows of two spans of `seconds`: each row is counted in its own span and,
    carried over, in the next, so a key of any number of rows is spread by time.
    """
    rows = events.withColumn("at", F.unix_timestamp(F.col(ts).cast("timestamp"))).withColumn("_own", F.floor(F.col("at") / seconds))
    both = rows.withColumn("_span", F.explode(F.when(F.col("_own").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array("_own", F.col("_own") + 1))))
    w = Window.partitionBy(by, "_span").orderBy(F.col("at")).rangeBetween(-(seconds - 1), 0)
    return both.withColumn("recent", F.count(F.lit(1)).over(w)).filter(F.col("_span").eqNullSafe(F.col("_own"))).drop("_span", "_own")


def back_off(attempt: Column, *, base: float = 1.0, jitter: Column | None = None) -> Column:
    """Seconds to wait before attempt n + 1: base * 2^n and, where given, a jitter on top."""
    wait = F.lit(base) * F.pow(F.lit(2.0), attempt.cast("double"))
    return wait if jitter is None else wait + jitter


def governed(work: DataFrame, ledger: DataFrame, quota: dict[str, int], *, day: str, model: str, by: str, order: list, fraction: float = 0.8) -> DataFrame:
    """Queue rows (tokens) that still fit the model's day: those whose tokens and all before them stay under what is left of the quota.

    Without a quota all rows run.
    """
    limit = quota.get(model)
    if not limit:
        return work.withColumn("runs", F.lit(True))
    spent = ledger.filter((F.col("day") == day) & (F.col("model_id") == model)).agg(F.coalesce(
        F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0),
    )).first()[0]
    rows = ranks.running(work, by=[by], order=order, value=F.coalesce("tokens", F.lit(0)))
    return rows.withColumn("runs", F.col("before") + F.lit(int(spent)) < F.lit(fraction * limit)).drop("place", "before")
