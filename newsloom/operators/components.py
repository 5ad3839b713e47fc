"""Connected components by alternating large-star and small-star steps over shuffled edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.sources.scratch import discard, materialise


def _nearest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b of one type that has an order) to (v, root): root is the smallest vertex that v reaches, for all v that is not its own root.

    Steps after Kiveris et al. (2014): large-star hangs the larger neighbours of each vertex on its
    smallest, small-star the smaller ones; both pre-aggregate the smallest neighbour before the
    shuffle and join it back, so a vertex of many links is a skewed join that Spark can split. Each
    round is written to the shared folder, the round before it deleted. Self-links, repeated links
    and links with a null end do no harm.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = materialise(now, "links"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(1), "v", "u"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("v"), F.col("v").alias("root"))
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.filter("v > u").join(
            _nearest(both).select("u", F.least("u", "m").alias("m")), "u",
        ).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = large.unionByName(_nearest(now).withColumnRenamed("m", "v")).distinct()
        near = _nearest(large)
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(near, "u").select(F.explode(ends).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        last, now = now, materialise(small, "links")
        discard(last)
