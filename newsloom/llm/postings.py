"""Inverted index of positional bytes: posting lists as buckets of fingerprints, and the pairs inside them that are near."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, trimmed


def tally(x: np.ndarray) -> np.ndarray:
    """Of differences x (.., words of 64 bits): how many positional bytes are shared."""
    return (np.ascontiguousarray(x).view(np.uint8) == 0).sum(axis=-1)


def near(x: np.ndarray, least: int, bits: int) -> np.ndarray:
    """Which differences x (.., words) pass: those that share `least` positional bytes are verified to differ in at most `bits` bits."""
    out = tally(x) >= least
    out[out] = np.bitwise_count(x[out]).sum(axis=-1) <= bits
    return out


Accept = Callable[[np.ndarray], np.ndarray]


def bucket_links(names: np.ndarray, prints: np.ndarray, accept: Accept) -> list[tuple[int, int]]:
    """Links that connect what is connected in one bucket: a tree for each component.

    Each fingerprint reached is compared with those not reached yet, so a dense bucket costs little
    more than its size and never yields more links than members.
    """
    rest, found = np.arange(len(names)), []
    while len(rest):
        todo, root, rest = [rest[0]], names[rest[0]], rest[1:]
        while todo and len(rest):
            hit = accept(prints[rest] ^ prints[todo.pop()])
            if hit.any():
                found += [(root, v) for v in names[rest[hit]]]
                todo += list(rest[hit])
                rest = rest[~hit]
    return found


def run_links(keys: np.ndarray, names: np.ndarray, prints: np.ndarray, accept: Accept, small: int = 16) -> np.ndarray:
    """Links within runs of equal keys: pairs at a short distance at once, long runs one by one. Members of one name are linked already."""
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    sizes = np.diff(edges)
    short = np.repeat(sizes <= small, sizes)
    pairs = []
    for d in range(1, min(small, int(sizes.max(initial=0)))):
        at = np.flatnonzero((keys[d:] == keys[:-d]) & short[d:])
        if not len(at):
            break
        at = at[accept(prints[at] ^ prints[at + d])]
        pairs.append(np.stack([names[at], names[at + d]], axis=1))
    for k in np.flatnonzero(sizes > small):
        a, b = edges[k], edges[k + 1]
        if own := bucket_links(names[a:b], prints[a:b], accept):
            pairs.append(np.array(own, np.int64))
    found = np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)
    return np.unique(found[found[:, 0] != found[:, 1]], axis=0)


def by_key(batches: Iterator[pa.RecordBatch], most: int = 1 << 16) -> Iterator[pa.Table]:
    """Whole runs of the first column, which is sorted: at least `most` rows at a time where there are as many."""
    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        if held.num_rows < most:
            continue
        keys = held.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))  # the last run may go on
        if cut:
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def links(index: DataFrame, words: list[str], accept: Accept, *, hot: int = 50_000) -> DataFrame:
    """Links (a, b: long) within the posting lists of index (key, v: long; and fingerprint words: long).

    All lists together name every pair that `accept` passes and that shares a key, but for pairs that
    other links connect. A list of over `hot` members is cut into blocks, every two of which meet in
    a task of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches):
            keys, names = t.column(0).to_numpy(), t.column(1).to_numpy()
            prints = np.stack([t.column(2 + k).to_numpy() for k in range(len(words))], axis=1).view(np.uint64)
            found = run_links(keys, names, prints, accept)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in (0, 1)], names=["a", "b"])

    columns = ["key", "v", *words]
    large = materialise(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot), "hot-postings")
    if large.limit(1).count():
        n_blocks = F.ceil(F.col("n") / F.lit(hot)).cast("int")
        hot_rows = index.join(large, "key").select(*columns, n_blocks.alias("m")).withColumn("mine", F.pmod(F.xxhash64("v"), F.col("m")).cast("int"))
        meet = hot_rows.select("key", "v", *words, "mine", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other"))
        meet = meet.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "v", *words)
        index = index.join(large.select("key"), "key", "left_anti").select(*columns).unionByName(meet)
    else:
        discard(large)
    return index.select(*columns).repartition("key").sortWithinPartitions("key", "v").mapInArrow(trimmed(run), "a long, b long")
