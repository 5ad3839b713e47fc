"""The enrichment stream over events as push messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.sources.scratch import scratch_path
from newsloom.streaming import worker

from .catalogue import register


@register(
    """
    SELECT CASE WHEN event_id % 11 = 0 THEN 'not_found' ELSE 'enriched' END AS status, CASE WHEN event_id % 11 = 0 THEN 2 ELSE 1 END * count(*) AS n FROM events WHERE event_id % 13 <> 0 GROUP BY event_id % 11 = 0
    """
)
def stream_enrich_once(spark, sf_dir):
    """Each event a message, those of ids divisible by 13 malformed, by 11 unknown; all messages come again to a second stream of its own checkpoint, which reports the unknown ones again."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    uid = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    data = F.base64(F.to_json(F.struct(uid.alias("unique_id"))).cast("binary"))
    body = F.to_json(F.struct(F.struct(F.when(F.col("event_id") % 13 == 0, F.lit("?")).otherwise(data).alias("data"), F.col("event_id").cast("string").alias("messageId")).alias("message")))
    source, out = scratch_path(spark, "messages"), scratch_path(spark, "stream")
    articles = events.filter("event_id % 11 <> 0").select(uid.alias("unique_id"), "event_type")
    for _ in range(2):
        events.select(body.alias("value")).write.mode("append").text(source)
        worker.run_once(spark, source, articles, out, scratch_path(spark, "stream-checkpoint"), lambda rows: rows, files_per_trigger=100_000)
    done = spark.read.schema("unique_id string, event_type string, status string, query string, batch long").parquet(f"{out}/enriched")
    return done.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
