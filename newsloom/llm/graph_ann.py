"""Approximate nearest neighbours: vectors dealt to shards by coarse centres, a robust-pruned directed graph for each shard, searched by beam."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, trimmed


def _squares(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of x (b, m, d) to q (b, d)."""
    return np.einsum("bmd,bmd->bm", x, x) - 2 * np.einsum("bmd,bd->bm", x, q) + np.einsum("bd,bd->b", q, q)[:, None]


def beam_search(
    x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int, expand: int = 4,
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Greedy search for all queries at once: nearest found and their squared distances, and all vertices expanded (-1: none)."""
    b, n = len(queries), len(x)
    near = np.full((b, beam), -1, np.int64)
    dist = np.full((b, beam), np.inf, np.float32)
    near[:, 0], dist[:, 0] = start, _squares(x[np.full((b, 1), start)], queries)[:, 0]
    seen = np.zeros((b, n + 1), bool)
    seen[:, start] = seen[:, n] = True
    open_ = near >= 0
    steps: list[np.ndarray] = []
    while True:
        order = np.argsort(~open_, axis=1, kind="stable")[:, :expand]  # open entries first, nearest first
        picked = np.where(np.take_along_axis(open_, order, 1), np.take_along_axis(near, order, 1), -1)
        live = np.flatnonzero((picked >= 0).any(axis=1))
        if not len(live):
            return near, dist, steps
        steps.append(picked)
        np.put_along_axis(open_, order, False, 1)
        out = np.where(picked[live, :, None] >= 0, graph[picked[live]], -1).reshape(len(live), -1)
        out = np.sort(np.where(out < 0, n, out), axis=1)
        out[:, 1:][out[:, 1:] == out[:, :-1]] = n
        out[seen[live[:, None], out]] = n
        seen[live[:, None], out] = True
        d = np.where(out < n, _squares(x[np.minimum(out, n - 1)], queries[live]), np.inf).astype(np.float32)
        both, all_d = np.concatenate([near[live], out], axis=1), np.concatenate([dist[live], d], axis=1)
        flags = np.concatenate([open_[live], out < n], axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        near[live], dist[live], open_[live] = (np.take_along_axis(v, best, 1) for v in (both, all_d, flags))
        near[live] = np.where(np.isfinite(dist[live]), near[live], -1)


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Out-neighbours (-1: none) of each point: the nearest candidate stays and removes those that it is alpha times nearer to."""
    n = len(x)
    c = np.sort(np.where((candidates < 0) | (candidates == points[:, None]), n, candidates), axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = n
    d = np.where(c < n, _squares(x[np.minimum(c, n - 1)], x[points]), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
    width = max(1, int((c < n).sum(axis=1).max(initial=0)))
    c, d = c[:, :width], d[:, :width]
    v = x[np.minimum(c, n - 1)]
    norms = np.einsum("bmd,bmd->bm", v, v)
    between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    alive = c < n
    kept = np.full((len(points), degree), -1, np.int64)
    rows = np.arange(len(points))
    for k in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        kept[:, k] = np.where(some, c[rows, first], -1)
        alive &= ~((alpha * alpha * between[rows, first] <= d) & some[:, None])
        alive[rows, first] = False
    return kept


def build_graph(x: np.ndarray, *, degree: int = 32, beam: int = 64, alpha: float = 1.2, seed: int = 42, batch: int = 256) -> tuple[np.ndarray, int]:
    """Insert all points in seeded random order, in batches of at most half of what is there; (out-neighbours, start)."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int64)
    start = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = order[order != start]
    done = 0
    while done < len(order):
        now = order[done : done + max(1, min(batch, (done + 1) // 2))]
        done += len(now)
        near, _, steps = beam_search(x, graph, start, x[now], beam)
        graph[now] = robust_prune(x, now, np.concatenate([near, *steps], axis=1), degree, alpha)
        to = graph[now].reshape(-1)
        by = np.repeat(now, degree)[to >= 0]
        to = to[to >= 0]
        if not len(to):
            continue
        gap = ((x[to] - x[by]) ** 2).sum(axis=1)
        rank = np.lexsort((gap, to))
        to, by = to[rank], by[rank]
        ends = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        place = np.arange(len(to)) - np.repeat(ends, np.diff(np.r_[ends, len(to)]))
        to, by, place = (v[place < 2 * degree] for v in (to, by, place))
        targets, row = np.unique(to, return_inverse=True)
        more = np.full((len(targets), int(place.max()) + 1), -1, np.int64)
        more[row, place] = by
        both = np.concatenate([graph[targets], more], axis=1)
        full = (both >= 0).sum(axis=1) > degree
        if (~full).any():
            packed = np.take_along_axis(both[~full], np.argsort(both[~full] < 0, axis=1, kind="stable"), 1)[:, :degree]
            graph[targets[~full]] = packed
        for at in range(0, int(full.sum()), batch):
            part = np.flatnonzero(full)[at : at + batch]
            graph[targets[part]] = robust_prune(x, targets[part], both[part], degree, alpha)
    return graph, start


def _matrix(column: pa.ChunkedArray, dim: int, kind) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), kind).reshape(-1, dim)


def usable(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, v (array of double) of rows with an id whose vector is neither null, empty nor zero and holds only finite numbers."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null and size(v) > 0")
    return rows.filter(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0))


def coarse_centres(x: np.ndarray, k: int, *, seed: int = 42, rounds: int = 10) -> np.ndarray:
    """k-means centres of the rows of x; a centre that loses all its rows stays where it was."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest_centres(x, centres, 1)[:, 0]
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def nearest_centres(x: np.ndarray, centres: np.ndarray, k: int, step: int = 4096) -> np.ndarray:
    """The k nearest centres of each row, nearest first."""
    parts = [np.argsort((centres * centres).sum(axis=1) - 2 * x[at : at + step] @ centres.T, axis=1, kind="stable")[:, :k] for at in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.empty((0, min(k, len(centres))), np.int64)


def _routed(rows: DataFrame, shared, name: str, wide) -> DataFrame:
    """rows (dim, v and more) with an array of the shards of the wide(number of shards of the dimension) nearest centres."""
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])
    dim, v = rows.columns.index("dim"), rows.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(dim).to_numpy()
            out: list = [None] * batch.num_rows
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                centres = shared.value.get(int(d), np.zeros((1, int(d))))
                x = np.asarray(batch.column(v).take(pa.array(at)).flatten(), np.float64).reshape(-1, int(d))
                for i, found in zip(at.tolist(), nearest_centres(x, centres, wide(len(centres))).tolist(), strict=True):
                    out[i] = found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=schema.names)

    return rows.mapInArrow(trimmed(run), schema)


def nearest(
    vectors: DataFrame, is_query, *, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", shard_size: int = 4096, homes: int = 3,
    probes: float = 2.0, sample: int = 20_000, degree: int = 32, beam: int = 64, search_beam: int = 128, alpha: float = 1.2, block: int = 4096,
    seed: int = 42,
) -> DataFrame:
    """For each query row its k nearest other rows: query_id, rank (int, from 1), vec_id, score (Euclidean distance, double).

    is_query: a condition on the column id. Equal vectors are one vertex that carries its k + 1
    smallest ids, all that any answer can name, so a vector shared by a third of all rows is one
    vertex. Distinct vectors are dealt to shards by coarse centres: one for each shard_size vectors of a
    dimension, by k-means over a sample of at most `sample` vectors; each vector goes to the shards of
    its `homes` nearest centres, and a shard of over twice the expected size is split by hash. Each
    shard's graph is built by batch insertion: a beam search proposes neighbours, robust pruning with
    factor alpha keeps diverse ones, reversed edges are pruned alike. A query beam-searches the shards
    of the probes * sqrt(number of shards) nearest centres, so work grows less than with the square of
    the table; the best of them are merged. Distances of what is found are computed in double
    precision from the original vectors; ties go to the smaller id.

    Rows without id and vectors that are null, empty, zero or hold null or non-finite numbers take
    no part; only vectors of the query's length are candidates; rows that repeat id and vector count
    once. No rows in, no rows out.
    """
    spark = vectors.sparkSession
    rows = materialise(usable(vectors, id_col=id_col, vec_col=vec_col).withColumn("v", F.transform("v", lambda e: e + F.lit(0.0))), "ann-vectors")
    first = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("r", F.dense_rank().over(first)).filter(F.col("r") <= k + 1)
    distinct = materialise(few.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("dim", F.size("v")), "ann-distinct")
    # bounded: a count for each length of a vector, and the sample
    counts = {r["dim"]: r["n"] for r in distinct.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = distinct.orderBy(F.xxhash64(F.lit(seed), "v")).limit(sample).select("dim", "v").collect()
    centres = {}
    for dim, n in counts.items():
        x = np.array([r["v"] for r in drawn if r["dim"] == dim], np.float64).reshape(-1, dim)
        centres[dim] = coarse_centres(x, max(1, -(-n // shard_size)), seed=seed) if len(x) else np.zeros((1, dim))
    shared = spark.sparkContext.broadcast(centres)

    homed = _routed(distinct, shared, "homes", lambda s: min(homes, s)).select("ids", "v", "dim", F.explode("homes").alias("shard"))
    homed = materialise(homed, "ann-homes")
    room = 2 * shard_size * homes
    sizes = homed.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(room)).cast("int").alias("parts"))  # a row for each shard
    sizes = materialise(sizes, "ann-shards")
    dealt = homed.join(sizes, ["dim", "shard"]).withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "v"), F.col("parts")).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        x = _matrix(table.column("v"), dim, np.float64)
        rank = np.lexsort(x.T[::-1])
        x = np.ascontiguousarray(x[rank])
        ids = [table.column("ids")[int(i)].as_py() for i in rank]
        graph, start = build_graph(x.astype(np.float32), degree=degree, beam=beam, alpha=alpha, seed=seed)
        one = {c: pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("dim", "shard", "part")}
        return pa.table({
            **one, "start": pa.array([start], pa.int32()), "ids": pa.array([ids], pa.list_(pa.list_(pa.int64()))),
            "x": pa.array([x.tobytes()], pa.binary()), "graph": pa.array([graph.astype("<i4").tobytes()], pa.binary()),
        })

    index = dealt.select("dim", "shard", "part", "ids", "v").groupBy("dim", "shard", "part").applyInArrow(
        build, "dim int, shard int, part int, start int, ids array<array<bigint>>, x binary, graph binary",
    )
    index = materialise(index, "ann-index")

    asked = rows.filter(is_query).select("id", "v").distinct()
    heads = asked.groupBy("v").agg(F.min("id").alias("head")).withColumn("dim", F.size("v"))
    heads = materialise(_routed(heads, shared, "shards", lambda s: min(s, int(np.ceil(probes * np.sqrt(s))))), "ann-queries")
    visits = heads.select("dim", "v", "head", F.explode("shards").alias("shard"))
    most = visits.groupBy("dim", "shard").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = max(1, -(-most // block))
    visits = visits.join(sizes, ["dim", "shard"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = visits.select("dim", "shard", "part", "v", "head", F.pmod(F.xxhash64("head"), F.lit(blocks)).cast("int").alias("block"))
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(own: pa.Table, queries: pa.Table) -> pa.Table:
        heads, lists = [], []
        if own.num_rows and queries.num_rows:
            dim = own.column("dim")[0].as_py()
            x = np.frombuffer(own.column("x")[0].as_py(), np.float64).reshape(-1, dim)
            graph = np.frombuffer(own.column("graph")[0].as_py(), "<i4").reshape(len(x), -1).astype(np.int64)
            start, ids = own.column("start")[0].as_py(), own.column("ids")[0].as_py()
            low = x.astype(np.float32)
            q, names = _matrix(queries.column("v"), dim, np.float64), queries.column("head").to_pylist()
            for at in range(0, len(q), 256):
                near, _, _ = beam_search(low, graph, start, q[at : at + 256].astype(np.float32), max(search_beam, k + 1))
                for j, found in enumerate(near):
                    found = found[found >= 0]
                    exact = np.sqrt(((x[found] - q[at + j]) ** 2).sum(axis=1))
                    best = sorted((float(d), i) for d, f in sorted(zip(exact.tolist(), found.tolist(), strict=True))[: 2 * k + 2] for i in ids[f])[: k + 1]
                    heads.append(names[at + j])
                    lists.append([{"score": d, "vec_id": i} for d, i in best])
        return pa.table({"head": pa.array(heads, pa.int64()), "found": pa.array(lists, pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())])))})

    keys = ["dim", "shard", "part", "block"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "head long, found array<struct<score:double,vec_id:bigint>>")
    # a vector of several homes is found more than once
    merged = parts.select("head", F.explode("found").alias("f")).select("head", "f.score", "f.vec_id").distinct()
    merged = merged.withColumn("r", F.row_number().over(Window.partitionBy("head").orderBy("score", "vec_id"))).filter(F.col("r") <= k + 1)
    merged = merged.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    answers = asked.join(heads.select("v", "head"), "v").select("id", "head").join(merged, "head")
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("id")), 1, k)
    out = answers.select(F.col("id").alias("query_id"), F.posexplode(others).alias("p", "f"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))
