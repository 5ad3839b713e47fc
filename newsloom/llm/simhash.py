"""SimHash near-dedup: fingerprints of word shingles, linked through an inverted index of positional bytes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import postings
from .common import materialise, trimmed
from .components import connected_components

BYTES = 8


def covering_triples() -> list[tuple[int, int, int]]:
    """20 triples of the 8 byte positions such that any 4 positions hold one of them (Turan's system for 8, 4, 3)."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    inside = [g for g in groups if len(g) == 3]
    across = [(*two, one) for k, g in enumerate(groups) for two in combinations(g, 2) for one in groups[(k + 1) % 3]]
    return [tuple(sorted(t)) for t in [*inside, *across]]


TRIPLES = covering_triples()


def fingerprint(text: str | None, *, shingle: int = 4, seed: int = 42, step: int = 1 << 16) -> int:
    """The SimHash of a whole text: a bit is 1 if over half of the shingles' XXH64 have it; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), step):
        a, b = starts[at : at + step].tolist(), ends[at : at + step].tolist()
        hashes = np.array([digest(joined[i:j], seed) for i, j in zip(a, b, strict=True)], np.uint64)
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """id and fp (long: the 64 bits as a signed number) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), shingle=shingle, seed=seed) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["id", "fp"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(trimmed(run), "id long, fp long")


def links(distinct: DataFrame, *, bits: int = 4, hot: int = 50_000) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) within `bits` bits (4 at most).

    Two such fingerprints differ in at most `bits` bytes, so they share 8 - bits positional bytes at
    least. A posting list holds the fingerprints that are equal in three positional bytes (postings
    of single bytes, intersected; one byte alone leaves a 256th of all fingerprints in a list): 20
    triples of positions, one of which lies in any four. In a list the positional bytes that a pair
    shares are tallied; only pairs that reach the guaranteed minimum have their bits counted. No pair
    leaves its list but as a link. Lists of over `hot` members are split into blocks.
    """
    if not 0 <= bits <= 4:
        raise ValueError("the index guarantees links of up to 4 bits")
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = [F.lit(k << 24).cast("long") + F.shiftleft(byte(a), 16) + F.shiftleft(byte(b), 8) + byte(c) for k, (a, b, c) in enumerate(TRIPLES)]
    index = distinct.select(F.explode(F.array(*keys)).alias("key"), F.col("fp").alias("v"), F.col("fp").alias("w"))
    least = BYTES - bits
    return postings.links(index, ["w"], lambda x: postings.near(x, least, bits), hot=hot)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, bits: int = 4) -> DataFrame:
    """id, fp (long) and component (long): the smallest id reachable by links of at most `bits` differing bits.

    Fingerprints are of whole texts (null as empty; A-Z in lower case, words between ASCII white
    space, fewer words than a shingle are one shingle, no words give 0, which links like any other).
    Only distinct fingerprints are indexed, so exact copies cost no pairs. A row comes out for each
    row in, repeated rows too; a null id never names a component of rows with ids. Extra columns
    are ignored. No rows in, no rows out.
    """
    each = materialise(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed), "fingerprints")
    distinct = each.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(links(distinct.select("fp"), bits=bits)).withColumnRenamed("v", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component")
    return each.join(named, "fp").select("id", "fp", "component")
