"""Token files: ids under a canonical length-limited Huffman code, in blocks that decode by themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, scratch_path, trimmed, worker_free
from .tokens import crc32, encode_documents, id_width, tokenizer_json

#: Symbols between two bit offsets of a block.
EVERY = 128
BLOCK = 1 << 18


def code_lengths(counts: np.ndarray, limit: int = 16) -> np.ndarray:
    """Code lengths of at most `limit` bits that minimise the coded size (package-merge); 0 where the count is 0."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    rows, level = [], weights
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.r_[weights, packages]
        rank = np.argsort(both, kind="stable")
        rows.append(rank < len(weights))
        level = both[rank]
    take = 2 * len(order) - 2
    for leaf in reversed(rows):
        own = int(leaf[:take].sum())
        lengths[order[:own]] += 1
        take = 2 * (take - own)
    lengths[order[:take]] += 1
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, symbol)."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    top = int(lengths.max(initial=0))
    spans = np.int64(1) << (top - lengths[order])
    codes = np.zeros(len(lengths), np.int64)
    codes[order] = (np.cumsum(spans) - spans) >> (top - lengths[order])
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and length for each value of the next `top` bits."""
    top = max(1, int(lengths.max(initial=0)))
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (top - lengths[order])
    symbols, sizes = np.zeros(1 << top, np.uint32), np.ones(1 << top, np.int64)
    total = int(spans.sum())
    symbols[:total], sizes[:total] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return symbols, sizes, top


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """The bits of ids and the bit offset of every EVERY-th id (little-endian unsigned 32-bit)."""
    sizes = lengths[ids]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n_bytes = (int(ends[-1]) + 7) // 8 if len(ids) else 0
    at, shift = starts >> 3, 40 - (starts & 7) - sizes
    bits = codes[ids].astype(np.int64) << shift
    packed = np.zeros(n_bytes + 5, np.float64)
    for k in range(5):  # codes of up to 32 bits lie in 5 bytes; each bit is set once, so sums are the bytes
        packed += np.bincount(at + k, weights=(bits >> (32 - 8 * k)) & 255, minlength=n_bytes + 5)
    return packed[:n_bytes].astype(np.uint8).tobytes(), starts[::EVERY].astype("<u4").tobytes()


def decode_block(data: bytes, checkpoints: bytes, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """All ids of a block: every checkpoint is a lane, all lanes step together through the table."""
    symbols, sizes, top = table
    if not n:
        return np.empty(0, np.uint32)
    raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.int64)
    at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
    out = np.zeros((len(at), EVERY), np.uint32)
    limit = len(data) * 8
    for k in range(min(EVERY, n)):
        p = np.minimum(at, limit)
        b = p >> 3
        window = (raw[b] << 32) | (raw[b + 1] << 24) | (raw[b + 2] << 16) | (raw[b + 3] << 8) | raw[b + 4]
        value = (window >> (40 - (p & 7) - top)) & ((1 << top) - 1)
        out[:, k] = symbols[value]
        at = at + sizes[value]
    return out.reshape(-1)[:n]


_FILE = "shard int, block int, first_token long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, checkpoints binary, bits binary"


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = 1, limit: int = 16, block: int = BLOCK, id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode documents and write their ids in ascending order of id under path.

    path/blocks holds rows of independent blocks of whole documents (about `block` ids, more for a
    longer document): its shard (a range of ids, ascending), its place there, the ids' bits and bit
    offsets. path/code holds the code lengths, path/shards each shard's number of ids. The code is
    built from the counts of all ids, at most one count for each entry of the vocabulary.

    Null texts are empty; a null id comes first; rows of equal ids are in the order of a hash of
    their ids. No rows in: files without blocks.
    """
    spark = docs.sparkSession
    width = id_width(tokenizer_json(tokenizer_path))
    plain = materialise(encode_documents(docs, tokenizer_path, end_id=end_id, id_col=id_col, text_col=text_col), "token-ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_free()
        total = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                now = np.bincount(np.frombuffer(b"".join(batch.column(0).slice(at, 256).to_pylist()), width))
                if len(now) > len(total):
                    now[: len(total)] += total
                    total = now
                else:
                    total[: len(now)] += now
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["symbol", "n"])

    counts = plain.select("ids").mapInArrow(trimmed(count), "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).toArrow()
    top = max(counts.column("symbol").to_pylist(), default=0) + 1
    dense = np.zeros(top, np.int64)
    dense[counts.column("symbol").to_numpy()] = counts.column("n").to_numpy()
    lengths = code_lengths(dense, limit)
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(s), int(lengths[s])) for s in used], "symbol int, bits int").coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast((codes, lengths))  # vocabulary-sized

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, lengths = shared.value
        shard, k, first, keys, parts, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def flush():
            ids = np.concatenate(parts)
            bits, points = encode_block(ids, codes, lengths)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([k], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()),
                    pa.array([keys], pa.list_(pa.int64())), pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
                    pa.array([points], pa.binary()), pa.array([bits], pa.binary()),
                ],
                names=["shard", "block", "first_token", "n_tokens", "doc_ids", "doc_tokens", "checkpoints", "bits"],
            )

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(key)
                parts.append(np.frombuffer(ids.as_py(), width))
                size += len(parts[-1])
                if size >= block:
                    yield flush()
                    k, first, keys, parts, size = k + 1, first + size, [], [], 0
        if parts:
            yield flush()

    # ranges are found from samples of the keys: a hash stands for the ids there
    keyed = plain.select("id", "ids", F.xxhash64("ids").alias("h")).repartitionByRange(F.col("id").asc_nulls_first(), "h")
    ordered = keyed.sortWithinPartitions(F.col("id").asc_nulls_first(), "h", "ids").select("id", "ids")
    ordered.mapInArrow(trimmed(write), _FILE).write.parquet(f"{path}/blocks")
    spark.read.schema(_FILE).parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens")).coalesce(1).write.parquet(f"{path}/shards")


def read_token_files(spark: SparkSession, path: str, *, digest: bool = False) -> DataFrame:
    """Documents back from the files: id, start (ids of all documents before it), n_tokens, ids (binary: little-endian unsigned 32-bit).

    digest: ids_crc32 (long) of those bytes in the place of ids.
    """
    code = spark.read.schema("symbol int, bits int").parquet(f"{path}/code").toArrow()  # vocabulary-sized
    lengths = np.zeros(max(code.column("symbol").to_pylist(), default=0) + 1, np.int64)
    lengths[code.column("symbol").to_numpy()] = code.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(decode_table(lengths))
    last = "ids_crc32" if digest else "ids"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n, keys, sizes, points, bits in zip(*(batch.column(k) for k in range(6)), strict=True):
                ids = decode_block(bits.as_py(), points.as_py(), n.as_py(), shared.value)
                sizes = np.array(sizes.as_py(), np.int64)
                ends = np.cumsum(sizes)
                each = [ids[a:b] for a, b in zip(ends - sizes, ends, strict=True)]
                out = pa.array([crc32(x) for x in each], pa.int64()) if digest else pa.array([x.astype("<u4").tobytes() for x in each], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.as_py(), pa.int64()), pa.array(ends - sizes + start.as_py()), pa.array(sizes), out],
                    names=["id", "start", "n_tokens", last],
                )

    shards = spark.read.schema("shard int, n_tokens long").parquet(f"{path}/shards")
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = shards.select("shard", before.alias("before"))  # a row for each written file
    blocks = spark.read.schema(_FILE).parquet(f"{path}/blocks").join(F.broadcast(starts), "shard")
    return blocks.select(
        (F.col("before") + F.col("first_token")).alias("start"), "n_tokens", "doc_ids", "doc_tokens", "checkpoints", "bits",
    ).mapInArrow(trimmed(decode), f"id long, start long, n_tokens long, {last} {'long' if digest else 'binary'}")


def round_trip(docs: DataFrame, tokenizer_path: str, *, digest: bool = False, **options) -> DataFrame:
    """Write token files to the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer_path, **options)
    return read_token_files(docs.sparkSession, path, digest=digest)
