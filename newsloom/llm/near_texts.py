"""SimHash near-dedup of texts at a Jaccard similarity: wide fingerprints of word shingles, an inverted index of positional bytes, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import postings
from .common import discard, materialise, trimmed
from .components import connected_components

#: Posting lists a text is in: one for each of as many pairs of positional bytes of its fingerprint.
TABLES = 80
#: Lists that are gone through first.
FIRST = 8
#: Words of 64 bits that travel with a posting: the positional bytes that are tallied in its list.
CARRIED = 4
#: Positional bytes that a pair must share of those 8 * CARRIED, and bits of them that it may differ in.
LEAST, BITS = 2, 60
#: Bytes of text in a block of a group of candidates; blocks of a group meet two by two.
BLOCK_BYTES = 4 << 20


def shingle_set(text: str | None, *, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles of a text; words as in simhash.fingerprint()."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array(
        [digest(joined[i:j], seed) for i, j in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64
    ))


def wide_fingerprint(found: np.ndarray, width: int = 2 * TABLES, step: int = 255) -> np.ndarray:
    """SimHash of a set of 64-bit hashes in `width` bytes: a bit is 1 if over half of the hashes, mixed for its word, have it."""
    counts = np.zeros(8 * width, np.int64)
    salts = np.arange(1, width // 8 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(found), step):  # up to 255 ones fit a byte
        x = found[at : at + step, None] + salts
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(found))


def _fingerprints(texts: DataFrame, shingle: int, seed: int) -> DataFrame:
    """v, keys (array of int: a posting list for each table) and the carried words of each text."""
    words = [f"w{k}" for k in range(CARRIED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [wide_fingerprint(shingle_set(x.as_py(), shingle=shingle, seed=seed)) for x in batch.column(1)]
            if not prints:
                continue
            prints = np.stack(prints)
            keys = (np.arange(TABLES, dtype=np.int32) << 16) + prints.view("<u2").astype(np.int32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), TABLES).cast(pa.list_(pa.int32()))
            carried = np.ascontiguousarray(prints[:, : 8 * CARRIED]).view("<i8")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists, *[pa.array(np.ascontiguousarray(carried[:, k])) for k in range(CARRIED)]], names=["v", "keys", *words]
            )

    return texts.select("v", "text").mapInArrow(trimmed(run), "v long, keys array<int>, " + ", ".join(f"{w} long" for w in words))


def similar_links(names: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that connect texts whose shingle sets have a Jaccard similarity of `least`: a tree for each component.

    Postings by shingle give the sizes of a set's intersections with all others at once. Each text
    reached is compared with those not reached yet.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    all_, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(all_, kind="stable")
    heads = np.flatnonzero(np.r_[True, all_[order][1:] != all_[order][:-1]]) if len(all_) else np.empty(0, np.int64)
    place = np.empty(len(all_), np.int64)
    place[order] = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(all_)]))
    holders, ends = owner[order], np.r_[heads, len(all_)]
    begins = np.cumsum(sizes) - sizes
    rest, found = np.ones(len(sets), bool), []
    for root in range(len(sets)):
        if not rest[root]:
            continue
        rest[root] = False
        todo = [root]
        while todo and rest.any():
            i = todo.pop()
            own = place[begins[i] : begins[i] + sizes[i]]
            a, b = ends[own], ends[own + 1]
            lengths = b - a
            at = np.repeat(a - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
            shared = np.bincount(holders[at], minlength=len(sets))
            union = sizes + sizes[i] - shared
            hit = np.flatnonzero(rest & (shared >= least * union))  # two empty sets are alike
            rest[hit] = False
            found += [(int(names[root]), int(names[j])) for j in hit]
            todo += hit.tolist()
    return found


def _verified(members: DataFrame, shingle: int, seed: int, least: float) -> DataFrame:
    """Links (a, b) between similar texts of each group; members: key (long), v, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in postings.by_key(batches, 1):
            keys, names = table.column(0).to_numpy(), table.column(1).to_numpy()
            edges, found = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]), []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                texts = table.column(2).slice(a, b - a)
                found += similar_links(names[a:b], [shingle_set(t.as_py(), shingle=shingle, seed=seed) for t in texts], least)
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["a", "b"])

    return members.select("key", "v", "text").repartition("key").sortWithinPartitions("key", "v").mapInArrow(trimmed(run), "a long, b long")


def similar_roots(texts: DataFrame, *, shingle: int = 5, seed: int = 42, least: float = 0.8) -> DataFrame:
    """(v, root) of the components of similar texts (v: long, text; equal v have equal texts), for all v that is not its own root.

    Pairs of one posting list that share LEAST of the carried positional bytes and differ in BITS of
    their bits at most are candidates; candidates that hang together are a group. In a group all texts
    are compared by their whole shingle sets, so only a pair that is in no group together is missed. A
    group of over BLOCK_BYTES of text is cut into blocks that meet two by two, in tasks of their own;
    what leaves a task is a tree of links.
    """
    prints = materialise(_fingerprints(texts, shingle, seed).dropDuplicates(["v"]), "wide-fingerprints")
    words = [f"w{k}" for k in range(CARRIED)]

    def near(rows: DataFrame, first: int, tables: int) -> DataFrame:
        keys = F.explode(F.slice(F.col("keys").cast("array<long>"), first + 1, tables)).alias("key")
        found = postings.links(rows.select(keys, "v", *words), words, lambda x: postings.near(x, LEAST, BITS))
        return connected_components(found)

    # a few lists connect most of a large group; in the others its texts go by the group's name, so links inside it are none
    some = near(prints, 0, FIRST)
    named = prints.join(some, "v", "left").withColumn("name", F.coalesce("root", "v")).drop("root")
    named = materialise(named, "named-fingerprints")
    more = near(named.drop("v").withColumnRenamed("name", "v"), FIRST, TABLES - FIRST)
    groups = named.select("v", "name").join(more.select(F.col("v").alias("name"), "root"), "name", "left").select("v", F.coalesce("root", "name").alias("root"))
    groups = materialise(groups.filter("v <> root"), "groups")
    discard(prints)
    discard(named)
    members = materialise(groups.unionByName(groups.select(F.col("root").alias("v"), "root").distinct()), "candidates")
    held = texts.select("v", "text").join(members, "v").groupBy("v").agg(F.first("root").alias("root"), F.first("text").alias("text"))
    held = materialise(held, "candidate-texts")
    sizes = held.groupBy("root").agg(F.ceil(F.sum(F.octet_length("text") + F.lit(64)) / F.lit(BLOCK_BYTES)).cast("int").alias("m"))
    dealt = held.join(sizes, "root").withColumn("mine", F.pmod(F.xxhash64("v"), F.col("m")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).filter("m = 1 or other <> mine")
    met = met.select(F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "v", "text")
    return connected_components(_verified(met, shingle, seed, least))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, seed: int = 42, least: float = 0.8) -> DataFrame:
    """id, v (long: text_hash()), root (long: the smallest v of the component) and component (long): the smallest id reachable by links of similar texts.

    Texts are similar if the Jaccard similarity of their sets of word shingles is `least` or more
    (null as empty; A-Z in lower case, words between ASCII white space, fewer words than a shingle
    are one shingle, texts without words are alike). Every link is verified on the whole sets. The
    constants above are chosen for least = 0.8: a bit of two fingerprints differs with probability
    arccos(2 s / (1 + s)) / pi at similarity s (0.15 at 0.8), so two positional bytes are equal with
    0.072, and a pair misses all TABLES lists with 0.25 % at 0.8, 0.009 % at 0.85 and less above; the
    tally and the bits lose 0.08 % more at 0.8. A row comes out for each row in, repeated rows
    too; a null id never names a component of rows with ids. No rows in, no rows out.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    ).withColumn("v", text_hash(F.col("text")))
    roots = similar_roots(rows, shingle=shingle, seed=seed, least=least)
    each = rows.select("id", "v").join(roots, "v", "left").select("id", "v", F.coalesce("root", "v").alias("root"))
    return each.join(each.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "v", "root", "component")
