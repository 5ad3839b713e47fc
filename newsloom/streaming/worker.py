"""The enrichment worker as a stream: decode messages, skip what is done, enrich, write once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = "message struct<data:string,attributes:map<string,string>,messageId:string>"


def decode(messages: DataFrame) -> DataFrame:
    """unique_id and message id of push envelopes (column value: JSON text); malformed ones keep unique_id null."""
    m = F.from_json("value", ENVELOPE)["message"]
    data = F.expr("try_to_binary(m.data, 'base64')")
    body = F.from_json(F.decode(data, "UTF-8"), "unique_id string")
    return messages.select("value", m.alias("m")).select("value", F.col("m.messageId").alias("message_id"), body["unique_id"].alias("unique_id"))


def malformed(decoded: DataFrame) -> DataFrame:
    return decoded.filter("unique_id is null or unique_id = ''")


def pending(decoded: DataFrame, articles: DataFrame, done: DataFrame | None) -> DataFrame:
    """Articles of the messages, each once, without those that are done; an unknown id is not_found."""
    ids = decoded.filter("unique_id is not null and unique_id <> ''").select("unique_id").distinct()
    if done is not None:
        ids = ids.join(done.select("unique_id"), "unique_id", "left_anti")
    return ids.join(articles.withColumn("_known", F.lit(True)), "unique_id", "left").withColumn(
        "status", F.when(F.col("_known"), "enriched").otherwise("not_found"),
    ).drop("_known")


def finished(spark: SparkSession, out: str, query: str, number: int) -> DataFrame | None:
    """Ids enriched under out by all batches but this one; None where nothing has been written yet."""
    try:
        rows = spark.read.schema("unique_id string, status string, query string, batch long").parquet(f"{out}/enriched")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.filter("status = 'enriched'").filter((F.col("query") != query) | (F.col("batch") != number)).select("unique_id")


def publish(enriched: DataFrame, topic: str | None) -> bool:
    """Append the events of enriched articles to a topic folder; without a topic nothing happens."""
    if not topic:
        return False
    events_of(enriched).write.mode("append").text(topic)
    return True


def run_once(
    spark: SparkSession, source: str, articles: DataFrame, out: str, checkpoint: str, enrich: Callable[[DataFrame], DataFrame], *,
    files_per_trigger: int = 100, at_least_seconds: int | None = None,
):
    """Process all messages that have come and stop.

    Each micro-batch writes its own folder, by query id (kept in the checkpoint) and batch id: a batch
    that is run again after a failure replaces what it wrote, and a stream with a checkpoint of its
    own writes beside what others wrote. Articles that are enriched anywhere under out are not
    enriched again; an unknown id is reported again each time a later batch holds it. Malformed
    messages go to a folder of their own. files_per_trigger bounds a batch; at_least_seconds, if
    given, runs on and starts a batch at that pace instead of stopping (the caller then stops it).
    """
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger).text(source)

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        query = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        own = f"query={query}/batch={number}"
        decoded = decode(batch)
        malformed(decoded).select("value").write.mode("overwrite").parquet(f"{out}/malformed/{own}")
        enrich(pending(decoded, articles, finished(session, out, query, number))).write.mode("overwrite").parquet(f"{out}/enriched/{own}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if at_least_seconds is not None:
        return writer.trigger(processingTime=f"{at_least_seconds} seconds").start()
    writer.trigger(availableNow=True).start().awaitTermination()


def events_of(enriched: DataFrame) -> DataFrame:
    """Output events of enriched articles as JSON."""
    rows = enriched.filter("status = 'enriched'")
    return rows.select(F.to_json(F.struct("unique_id", "enriched_at", "most_specific_theme_code", "has_summary")).alias("value"))
