"""Sharding: a two-pass external shuffle into shards whose row counts differ by one at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, without

ADDED = ("shard", "slot")
#: Shuffle partitions of the scatter at most; each then holds several buckets, sorted apart on disk.
MOST_PARTITIONS = 10_000
#: Copies that one row is multiplied into in one task.
COPIES = 1 << 16


def _told_apart(docs: DataFrame, seed: int) -> DataFrame:
    """row (struct) and h (long: its place in the scatter), the same whatever files the rows lie in.

    h is a seeded hash of the whole row. Rows that are equal in all columns are interchangeable: one
    of them, chosen with map-side combining, is multiplied by their number and each copy's number is
    hashed too, so that a row repeated without end spreads like different rows.
    """
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in docs.columns]).alias("h"))
    often = materialise(rows.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "repeated-rows")
    if not often.limit(1).count():
        return rows
    one = rows.join(often, "h").groupBy("h", "m").agg(F.first("row").alias("row"))
    blocks = one.select("h", "m", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / COPIES))).alias("b")).repartition("h", "b")
    copies = F.explode(F.sequence(F.col("b") * COPIES, F.least(F.col("m"), (F.col("b") + 1) * COPIES) - 1))
    more = blocks.select("row", "h", copies.alias("copy")).select("row", F.xxhash64("h", "copy").alias("h"))
    return rows.join(often, "h", "left_anti").select("row", "h").unionByName(more)


def shard_records(docs: DataFrame, *, text_col: str = "text", shards: int = 16, seed: int = 42, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Deal all records into shards 0 to shards - 1 in a uniformly random order, the same for the same rows and seed.

    Pass one scatters the records into buckets of about bucket_bytes each, by a seeded hash of the
    whole row, so that equal texts, a hot source or equal ids spread like any other rows; equal rows
    spread by their number. Buckets are addressed by number: each shuffle partition holds as many as
    any other, give or take one. Pass two permutes each bucket with Spark's shuffle(array, seed), a
    Fisher-Yates shuffle, and writes it to the shared folder. A bucket's records start where the
    records of the buckets before it end; only the list of bucket sizes is gathered for that. The
    record at place p of this order goes to shard p mod shards, slot p div shards: counts differ by
    one at most ("rows" law) and the slots of a shard have no gaps.

    Returns the columns of docs with shard (int) and slot (long).

    Null and empty texts, null ids and repeated rows are records like any other. Input columns
    called shard or slot are replaced; maps cannot be hashed and are refused. No rows in, no rows out.
    """
    docs = docs.select(*without(docs, ADDED))
    weight = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)) + F.lit(64)
    total = docs.agg(F.sum(weight.cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    partitions = min(buckets, MOST_PARTITIONS)

    scattered = _told_apart(docs, seed).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    scattered = scattered.withColumn("home", F.expr(f"bucket * {partitions}L div {buckets}L").cast("int"))
    dealt = scattered.repartitionById(partitions, F.col("home"))
    groups = dealt.groupBy("home", "bucket").agg(F.sort_array(F.collect_list(F.struct("h", "row"))).alias("rows"))
    mixed = groups.select("bucket", F.posexplode(F.shuffle("rows.row", F.lit(seed))).alias("at", "row"))
    written = materialise(mixed, "shard-buckets")

    sizes = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("bucket", F.coalesce(before, F.lit(0)).alias("start"))
    # one row for each bucket of bucket_bytes: under a megabyte for a terabyte of text; a join of two exchanges beyond
    if buckets <= 1 << 16:
        starts = F.broadcast(starts)
    p = F.col("start") + F.col("at")
    return written.join(starts, "bucket").select(
        "row.*", F.pmod(p, F.lit(shards)).cast("int").alias("shard"), F.floor(p / F.lit(shards)).cast("long").alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, its rows by slot."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
