"""Best-fit packing: dominance reduction on the lengths' histogram, then best fit decreasing on what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, trimmed, worker_free
from .tokens import crc32, parts_of, shared_definition, worker_encoder


class _Lengths:
    """How many pieces of each length are left, with the next ones found by bisection."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for size, k in counts.items():
            self.n[size] = k

    def largest(self, most: int) -> int:
        """The largest length left of at most `most`, 0 if there is none."""
        found = np.flatnonzero(self.n[1 : max(0, most) + 1])
        return int(found[-1]) + 1 if len(found) else 0

    def smallest(self, k: int) -> list[int]:
        """The k smallest pieces left."""
        out: list[int] = []
        for size in np.flatnonzero(self.n)[:k]:
            out += [int(size)] * min(k, int(self.n[size]))
        return out[:k]


def reduce_by_dominance(left: _Lengths, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Fix sets that dominate all others with the largest piece (Martello and Toth's reduction): (bins, [(length, in each)]).

    From the largest length down: alone if nothing fits with it; with the largest that fits if only
    one more can, or if they fill the bin; with that one too if no two that fit are longer together;
    with two if only two more can, the longer is that one and the shorter the longest that can be second.
    """
    fixed: list[tuple[int, list[tuple[int, int]]]] = []
    size = left.largest(capacity)
    while size:
        while left.n[size]:
            left.n[size] -= 1  # the piece itself is not its own partner
            room = capacity - size
            small = left.smallest(3)
            one = left.largest(room)
            fits = [s for k, s in enumerate(small) if sum(small[: k + 1]) <= room]
            best: list[int] | None = None
            if not one:
                best = []
            elif len(fits) == 1 or one == room:
                best = [one]
            elif len(fits) == 2:
                a, b = _best_pair(left, room)
                if one >= a + b:
                    best = [one]
                elif a == one and b >= _longest_second(left, room):
                    best = [a, b]
            left.n[size] += 1
            if best is None:
                break
            need: dict[int, int] = {}
            for s in [size, *best]:
                need[s] = need.get(s, 0) + 1
            times = min(int(left.n[s]) // k for s, k in need.items())
            if len(best) == 2:  # the same set again while two pieces of each of its lengths are left
                times = max(1, min((int(left.n[s]) - 2) // k for s, k in need.items()))
            for s, k in need.items():
                left.n[s] -= times * k
            fixed.append((times, sorted(need.items(), reverse=True)))
        size = left.largest(size - 1)
    return fixed


def _best_pair(left: _Lengths, room: int) -> tuple[int, int]:
    """Lengths a >= b of two pieces that fit together and are longest in sum."""
    best = (0, 0)
    sizes = np.flatnonzero(left.n[: room + 1])
    for a in sizes[::-1]:
        a = int(a)
        if 2 * a < sum(best):
            break
        b = left.largest(min(a if left.n[a] > 1 else a - 1, room - a))
        if b and a + b > sum(best):
            best = (a, b)
    return best


def _longest_second(left: _Lengths, room: int) -> int:
    """The longest length that can be the shorter of two pieces that fit together."""
    for b in np.flatnonzero(left.n[: room // 2 + 1])[::-1]:
        longer = np.flatnonzero(left.n[int(b) + 1 : room - int(b) + 1])
        if left.n[b] > 1 or len(longer):
            return int(b)
    return 0


def best_fit(left: _Lengths, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit decreasing, for all pieces of a length at a time: groups of like bins (bins, [(length, in each)])."""
    open_bins: dict[int, list[tuple[int, tuple]]] = {}
    for size in map(int, np.flatnonzero(left.n)[::-1]):
        todo = int(left.n[size])
        while todo:
            room = min((r for r in open_bins if r >= size), default=capacity)
            q = room // size
            if room in open_bins and open_bins[room]:
                bins, held = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
            else:
                bins, held = -(-todo // q), ()
            full = min(bins, todo // q)
            rest = todo - full * q if full < bins else 0
            for n, k in ((full, q), (1 if rest else 0, rest), (bins - full - (1 if rest else 0), 0)):
                if n:
                    now = room - k * size
                    open_bins.setdefault(now, []).append((n, (*held, (size, k)) if k else held))
            todo -= full * q + rest
        left.n[size] = 0
    return [(n, list(held)) for groups in open_bins.values() for n, held in groups]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """All bins, as groups of like ones. Work and result depend on the number of lengths, not of pieces."""
    left = _Lengths(counts, capacity)
    return reduce_by_dominance(left, capacity) + best_fit(left, capacity)


def pieces(
    docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Token pieces of all documents: id, piece, start, length, ids_crc32 (and ids: little-endian unsigned 32-bit)."""
    shared = shared_definition(docs.sparkSession, tokenizer_path)
    names = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value)
        for batch in batches:
            for part in parts_of(batch, 1):
                rows = []
                for key, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), strict=True):
                    ids = np.r_[ids, np.uint32(end_id)]
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        rows.append((key, k, start, len(own), crc32(own), own.astype("<u4").tobytes() if with_ids else None))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(zip(*rows, strict=True), kinds, strict=True))[: len(names)]], names=names)

    schema = "id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(trimmed(run), schema)


def pack(
    docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pack all documents into few sequences of at most `capacity` tokens.

    Documents are encoded with their end id; only longer ones are cut, into pieces of `capacity`
    tokens. The histogram of lengths, at most `capacity` rows, is all that the driver gathers: sets
    that dominate are fixed there, the rest goes by best fit, both for all pieces of a length at a
    time. Each piece then takes the place of its rank among the pieces of its length; ranks come
    from counts by length and input partition, so no length's pieces meet in one task.

    Returns id, piece (int), start, length, ids_crc32, sequence_id and offset (long), and ids if
    asked for. Null and empty texts are the end id alone; null ids and repeated rows are packed like
    any other row. Extra columns are ignored. No rows in, no rows out.
    """
    cut = materialise(
        pieces(
            docs, tokenizer_path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col, with_ids=with_ids,
        ).withColumn("part", F.spark_partition_id()),
        "token-pieces",
    )
    by_part = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {int(r["length"]): int(r["n"]) for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}

    slots: dict[int, list[tuple[int, int, int, int, int]]] = {}
    taken: dict[int, int] = dict.fromkeys(histogram, 0)
    sequence = 0
    for bins, held in plan(histogram, capacity):
        offset = 0
        for size, k in held:
            slots.setdefault(size, []).append((taken[size], sequence, bins, offset, k))
            taken[size] += bins * k
            offset += size * k
        sequence += bins
    table = {size: np.array(x, np.int64).T for size, x in slots.items()}
    shared = docs.sparkSession.sparkContext.broadcast(table)  # at most a row for each length in each group of bins

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("local", local).join(offsets, ["length", "part"])
    columns = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    ranked = ranked.select(*columns, (F.col("before") + F.col("local")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_free()
        table = shared.value
        for batch in batches:
            size, rank = batch.column(3).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                first, sequence, bins, offset, k = table[int(s)]
                row = np.searchsorted(first, rank[at], side="right") - 1
                within = rank[at] - first[row]
                seq[at] = sequence[row] + within // k[row]
                off[at] = offset[row] + within % k[row] * s
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(seq), pa.array(off)], names=[*columns, "sequence_id", "offset"])

    schema = "id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    return ranked.mapInArrow(trimmed(place), schema)
