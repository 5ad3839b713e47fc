"""Retrieval: chunks, vector and full-text rankings, fusion, context."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as t
from newsloom.functions import vectors as v


@dataclass(frozen=True)
class RetrieverConfig:
    vector_k: int = 50
    fulltext_k: int = 50
    rrf_k: int = 60
    final_k: int = 10
    rerank_k: int = 10


CHUNK = "id long, chunk_index int, content string, chunk_type string, char_start int, char_end int"


def chunk_fixed(docs: DataFrame, *, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Pieces of `size` characters that overlap; native. docs: id, text. Empty texts give no chunk."""
    step = size - overlap
    text = F.coalesce("text", F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - 1), F.lit(step))
    rows = docs.filter(F.length(text) > 0).select("id", F.posexplode(starts).alias("chunk_index", "char_start"), text.alias("text"))
    content = F.substr("text", F.col("char_start") + 1, F.lit(size))
    return rows.select(
        "id", "chunk_index", content.alias("content"), F.lit("fixed").alias("chunk_type"), "char_start",
        (F.col("char_start") + F.length(content)).alias("char_end"),
    )


def chunk_paragraph(docs: DataFrame, *, separator: str = "\n") -> DataFrame:
    """Non-empty paragraphs in order."""
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), separator, -1), lambda s: F.trim(s)), lambda p: p != "")
    return docs.select("id", F.posexplode(parts).alias("chunk_index", "content"), F.lit("paragraph").alias("chunk_type"))


def recursive_pieces(text: str, size: int, separators: tuple[str, ...] = ("\n\n", "\n", ". ", "! ", "? ", " ")) -> list[tuple[int, int]]:
    """Spans of at most `size` characters, cut at the coarsest separator that can."""
    out, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= size:
            if text[a:b].strip():
                out.append((a, b))
            continue
        for sep in separators:
            cut = text.rfind(sep, a + 1, a + size)
            if cut > a:
                todo += [(cut + len(sep), b), (a, cut + len(sep))]
                break
        else:
            todo += [(a + size, b), (a, a + size)]
    return sorted(out)


def hashed_embedding(texts: list[str], dim: int = 64) -> np.ndarray:
    """Offline stand-in for a sentence model: signed hashed words, unit length."""
    import zlib

    out = np.zeros((len(texts), dim))
    for k, s in enumerate(texts):
        for w in s.lower().split():
            h = zlib.crc32(w.encode())
            out[k, h % dim] += 1.0 if h >> 16 & 1 else -1.0
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1, norms)


def semantic_pieces(text: str, threshold: float, least: int, most: int) -> list[tuple[int, int]]:
    """Adjacent sentences together while alike or too short, up to `most` characters."""
    ends = [m.end() for m in re.finditer(r"[.!?]\s+|\n+", text)] + [len(text)]
    spans = [(a, b) for a, b in zip([0, *ends[:-1]], ends, strict=True) if text[a:b].strip()]
    if not spans:
        return []
    vectors = hashed_embedding([text[a:b] for a, b in spans])
    out = [spans[0]]
    for k, (a, b) in enumerate(spans[1:], 1):
        start, end = out[-1]
        alike = float(vectors[k] @ vectors[k - 1]) > threshold
        if (alike or end - start < least) and b - start <= most:
            out[-1] = (start, b)
        else:
            out.append((a, b))
    return out


def _chunk_with(docs: DataFrame, cut, kind: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, s[a:b], kind, a, b) for i, s in zip(batch["id"], batch["text"].fillna(""), strict=True) for k, (a, b) in enumerate(cut(s))]
            yield pd.DataFrame(rows, columns=["id", "chunk_index", "content", "chunk_type", "char_start", "char_end"])

    return docs.select("id", "text").mapInPandas(run, CHUNK)


def chunk_recursive(docs: DataFrame, *, size: int = 1000) -> DataFrame:
    return _chunk_with(docs, lambda s: recursive_pieces(s, size), "recursive")


def chunk_semantic(docs: DataFrame, *, threshold: float = 0.8, least: int = 200, most: int = 2000) -> DataFrame:
    return _chunk_with(docs, lambda s: semantic_pieces(s, threshold, least, most), "semantic")


CHUNKERS = {"fixed": chunk_fixed, "paragraph": chunk_paragraph, "recursive": chunk_recursive, "semantic": chunk_semantic}


def enrich_chunk(content: Column, context: Column) -> Column:
    return F.concat(F.lit("Contexto: "), context, F.lit("\n\n"), content)


def vector_topk(queries: DataFrame, items: DataFrame, *, k: int = 10, item_block: int = 16_384, query_block: int = 1024) -> DataFrame:
    """Exact top k items by cosine similarity for each of a stated set of queries (query_id, q); items: id, v.

    Items and queries are dealt by hash into blocks whose number follows from the row counts; each
    pair of blocks is one matrix product that gives k rows a query, so no pair of rows is ever a row.
    Vectors of another length, null or zero vectors take no part; null numbers in one count as 0.
    Ties go to the smaller id.
    """
    n_items, n_queries = items.count(), queries.count()
    columns, rows = max(1, -(-n_items // item_block)), max(1, -(-n_queries // query_block))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    number = lambda c: F.coalesce(c.cast("array<double>"), F.array().cast("array<double>"))
    dealt = items.select(
        "id", number(F.col("v")).alias("v"), F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(columns)).cast("int").alias("x"),
    ).withColumn("y", spread(rows))
    asked = queries.select(
        "query_id", number(F.col("q")).alias("q"), F.size("q").alias("dim"), F.pmod(F.xxhash64("query_id"), F.lit(rows)).cast("int").alias("y"),
    ).withColumn("x", spread(columns))

    def unit(column: pa.ChunkedArray, dim: int) -> np.ndarray:
        x = np.nan_to_num(np.asarray(column.combine_chunks().flatten(), np.float64).reshape(-1, dim), nan=0.0)
        norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.divide(x, norms, out=np.full_like(x, np.nan), where=norms > 0)

    def best(own: pa.Table, stated: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if own.num_rows and stated.num_rows and (own.column("dim")[0].as_py() or 0) > 0:
            dim = own.column("dim")[0].as_py()
            ids, x = own.column("id").to_numpy(), unit(own.column("v"), dim)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            ids, x = ids[~np.isnan(x[:, 0])], x[~np.isnan(x[:, 0])]
            names, q = stated.column("query_id").to_numpy(), unit(stated.column("q"), dim)
            names, q = names[~np.isnan(q[:, 0])], q[~np.isnan(q[:, 0])]
            for at in range(0, len(q) if len(x) else 0, 64):
                scores = q[at : at + 64] @ x.T
                top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                out.append((np.repeat(names[at : at + 64], top.shape[1]), ids[top].reshape(-1), np.take_along_axis(scores, top, 1).reshape(-1)))
        parts = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"query_id": pa.array(parts[0], pa.int64()), "id": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.float64())})

    keys = ["dim", "x", "y"]
    found = dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(best, "query_id long, id long, score double")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def class_similarity(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Mean cosine similarity of each query (query_id, q, label) to its class (itself left out) and to all else: query_id, intra, inter.

    The mean over a class is the product with the class's mean unit vector, so classes are summed
    once, by place in the vector, and no query meets an item. items: v, label. Zero and null vectors
    take no part.
    """
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    units = lambda d, c: d.withColumn("_u", F.col(c).cast("array<double>")).withColumn("_n", norm(F.col("_u"))).filter("_n > 0").withColumn("_u", F.transform("_u", lambda x: x / F.col("_n")))
    each = units(items, "v").select("label", F.size("_u").alias("dim"), F.posexplode("_u").alias("p", "x"))
    sums = each.groupBy("label", "dim", "p").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    vector = lambda d, by, n, s: d.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda e: e["x"]).alias(s), F.max("n").alias(n),
    )
    own = vector(sums, ["label", "dim"], "n_own", "own")
    whole = vector(sums.groupBy("dim", "p").agg(F.sum("x").alias("x"), F.sum("n").alias("n")), ["dim"], "n_all", "all")
    q = units(queries, "q").select("query_id", "label", F.col("_u").alias("u"), F.size("_u").alias("dim"))
    rows = q.join(whole, "dim").join(own, ["label", "dim"], "left")
    to_own = F.coalesce(v.inner_product(F.col("u"), F.col("own")), F.lit(0.0))
    n_own = F.coalesce("n_own", F.lit(0))
    intra = F.try_divide(to_own - 1, (n_own - 1).cast("double"))
    inter = F.try_divide(v.inner_product(F.col("u"), F.col("all")) - to_own, (F.col("n_all") - n_own).cast("double"))
    return rows.select("query_id", intra.alias("intra"), inter.alias("inter"))


def grouped_documents(chunks: DataFrame, documents: DataFrame, *, filters: dict[str, object] | None = None) -> DataFrame:
    """Chunks with their document's columns, an equi-join on document_id; filters that are None do not filter.

    chunks: document_id and more; documents: id and more.
    """
    return chunks.join(filtered(documents, filters).withColumnRenamed("id", "document_id"), "document_id")


def filtered(documents: DataFrame, filters: dict[str, object] | None) -> DataFrame:
    """Documents whose columns have these values, or one of them where a list is given; None does not filter."""
    for column, value in (filters or {}).items():
        if value is not None:
            documents = documents.filter(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == F.lit(value))
    return documents


def linear_fusion(first: DataFrame, second: DataFrame, *, alpha: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """alpha * first score + (1 - alpha) * second score of (id, score); a score that is missing is 0."""
    keys = [*(by or []), "id"]
    a, b = first.select(*keys, F.col("score").alias("_a")), second.select(*keys, F.col("score").alias("_b"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return a.join(b, keys, "full_outer").select(*keys, (F.lit(alpha) * zero("_a") + F.lit(1 - alpha) * zero("_b")).alias("score"))


def _is(term: str):
    return lambda w: w == F.lit(term)


def stemmed_match(docs: DataFrame, question: str) -> DataFrame:
    """fulltext_match() at language level: the question's and the texts' words are normalised, without stop words and stemmed.

    A question of stop words only matches nothing.
    """
    terms = sorted(set(docs.sparkSession.range(1).select(t.search_terms(F.lit(question)).alias("x")).first().x))
    words = docs.select("id", t.search_terms("text").alias("words"))
    marks = F.array(*[F.lit(x) for x in terms]).cast("array<string>")
    # the words are cut and stemmed before they are counted: a generator keeps the two projections apart
    each = words.select("id", F.explode("words").alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
    rows = each.groupBy("id").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.array_contains(marks, F.col("word")), F.col("n")).otherwise(0)).alias("hits"),
        F.count_if(F.array_contains(marks, F.col("word"))).alias("present"),
    )
    return rows.filter((F.col("present") == len(terms)) & F.lit(bool(terms))).select(
        "id", "hits", (F.col("hits") / (F.lit(1.0) + F.log(F.col("n").cast("double")))).alias("rank_score"),
    )


def fulltext_match(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Documents (id, text) that hold all terms, ranked by how often: id, hits, rank_score (hits over 1 + ln of words)."""
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+")
    rows = docs.select("id", words.alias("words"))
    for k, term in enumerate(terms):
        rows = rows.withColumn(f"_{k}", F.size(F.filter("words", _is(term))))
    present = [F.col(f"_{k}") for k in range(len(terms))]
    found = rows
    for p in present:
        found = found.filter(p > 0)
    hits = sum(present[1:], present[0])
    n = F.size(F.filter("words", lambda w: w != ""))
    return found.select("id", hits.cast("long").alias("hits"), (hits / (F.lit(1.0) + F.log(n.cast("double")))).alias("rank_score"))


def ranked(df: DataFrame, score: str, *, k: int) -> DataFrame:
    """The k best rows by score, then id, numbered from 1: limited before the numbering, so the one-partition window has k rows."""
    top = df.orderBy(F.desc(score), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "id")))


def rrf(first: DataFrame, second: DataFrame, *, k: int = 60, by: list[str] | None = None) -> DataFrame:
    """Reciprocal-rank fusion of two rankings (id, rank): full outer join, sum of 1 / (k + rank)."""
    keys = [*(by or []), "id"]
    a, b = first.select(*keys, F.col("rank").alias("rank_a")), second.select(*keys, F.col("rank").alias("rank_b"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    return a.join(b, keys, "full_outer").withColumn("rrf_score", part("rank_a") + part("rank_b"))


def best_chunk(chunks: DataFrame, *, score: str = "score") -> DataFrame:
    """The best chunk of each document; ties go to the earlier chunk."""
    best = Window.partitionBy("document_id").orderBy(F.desc(score), "chunk_index")
    return chunks.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def pack_context(results: DataFrame, *, budget: int, by: list[str], order: list, size: Column) -> DataFrame:
    """Results in order until the first that goes over the budget."""
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return results.withColumn("used", F.sum(size).over(run)).filter(F.col("used") <= budget)


def context_block(rank: Column, title: Column, published: Column, content: Column) -> Column:
    return F.format_string("[Fonte %d: %s] (%s)\n%s", rank, title, F.date_format(published, "dd/MM/yyyy"), content)


def with_recency(rows: DataFrame, *, now: str, weight: float | None = None, query: Column | None = None) -> DataFrame:
    """final = (1 - w) * similarity + w * 1 / (1 + days / 30); w is 0.3, or .5 / .1 as the query asks for what is recent. Later days count as today."""
    days = F.greatest(F.lit(0), F.date_diff(F.to_date(F.lit(now)), F.to_date("published_at")))
    w = F.lit(0.3 if weight is None else weight) if query is None else F.when(t.has_temporal_term(query), 0.5).otherwise(0.1)
    return rows.withColumn("recency", v.recency(days)).withColumn("final_score", (F.lit(1.0) - w) * F.col("similarity") + w * F.col("recency"))


def by_age(items: DataFrame, days: Column, *, recent: int = 90) -> tuple[DataFrame, DataFrame]:
    """Items for the index of old ones and for that of recent ones; items without an age are old."""
    return items.filter(F.coalesce(days > recent, F.lit(True))), items.filter(days <= recent)


def dual_index(old: DataFrame, recent: DataFrame, *, k: int, by: list[str] | None = None) -> DataFrame:
    """Top k of each index, then of both, for each of by (all rows are one query without it)."""
    if not by:
        top = lambda d: d.orderBy(F.desc("score"), "id").limit(k)
        return top(top(old).unionByName(top(recent)))
    rank = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    best = lambda d: d.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    return best(best(old).unionByName(best(recent)))


def rerank(candidates: DataFrame, query: str, *, k: int = 10) -> DataFrame:
    """Lexical stand-in for a cross-encoder: share of the query's tokens in the content, then the former score."""
    q = F.array(*[F.lit(w) for w in sorted(set(query.lower().split()))])
    share = F.size(F.array_intersect(q, F.split(F.lower("content"), r"[^\p{L}\p{N}]+"))) / F.size(q)
    return candidates.withColumn("rerank_score", share).orderBy(F.desc("rerank_score"), F.desc("score"), "id").limit(k)


def hybrid_search(vector_ranking: DataFrame, text_ranking: DataFrame, config: RetrieverConfig = RetrieverConfig()) -> DataFrame:
    fused = rrf(vector_ranking, text_ranking, k=config.rrf_k)
    return ranked(fused.drop("rank"), "rrf_score", k=config.final_k)


#: Prompt templates of the answer stage.
TEMPLATES = {
    "default": "Contexto:\n{context}\n\nPergunta: {question}\nResposta:",
    "factual": "Use somente os fatos do contexto.\n{context}\n\nPergunta: {question}\nFatos:",
    "summary": "Resuma o contexto em relação à pergunta.\n{context}\n\nPergunta: {question}\nResumo:",
    "comparison": "Compare as fontes do contexto.\n{context}\n\nPergunta: {question}\nComparação:",
}


def answer_prompt(context: Column, question: Column, kind: str = "default") -> Column:
    out = F.lit(TEMPLATES[kind])
    return F.replace(F.replace(out, F.lit("{context}"), context), F.lit("{question}"), question)


def ivf_index(items: DataFrame, *, lists: int = 100, sample: int = 20_000, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """Cells of an inverted-file index: items (id, v) with the cell of the nearest of `lists` centres and their angle to it.

    Centres come from k-means over at most `sample` items in hash order, all vectors at unit length;
    every item is indexed. A zero vector and one that is not finite have the angle pi. Cells are written once and read by each step of a search.
    """
    from newsloom.operators.corpus import draw
    from newsloom.sources.scratch import materialise

    rows = _unit([r.v for r in items.orderBy(draw(F.col("id"), seed), "id").limit(sample).select("v").collect()])
    rows = rows[np.isfinite(rows).all(axis=-1)]
    rng = np.random.default_rng(seed)
    centres = rows[rng.permutation(len(rows))[: min(lists, len(rows))]].copy()
    for _ in range(10):
        near = _nearest_centre(rows, centres)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = rows[near == c].mean(axis=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _unit(b["v"].tolist())
                cell = _nearest_centre(x, centres)
                angle = np.where(x.any(axis=1) & np.isfinite(x).all(axis=1), _angles(x, centres)[np.arange(len(x)), cell], np.pi)
                yield b.assign(cell=cell, angle=angle)

    return materialise(items.select("id", "v").mapInPandas(run, "id long, v array<float>, cell long, angle double"), "ivf-cells"), centres


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    norms = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(norms == 0, 1, norms)


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ _unit(centres).T, -1, 1))


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None] - 2 * x @ centres.T).argmin(axis=1)


def ivf_search(
    queries: DataFrame, index: tuple[DataFrame, np.ndarray], *, k: int = 10, probes: int = 10, item_block: int = 16_384, query_block: int = 16_384,
) -> DataFrame:
    """Exact top k: the probed cells of each query, then every other cell that can hold a better item.

    The `probes` nearest cells are searched first. By the triangle inequality of angles no item of a
    cell is nearer to a query than its centre's angle less the cell's widest one, so cells beyond the
    k-th angle found are left out without loss; the driver sees one widest angle and one count a cell.
    Cells and the queries that probe them are dealt by hash into blocks whose number follows from
    their counts; a pair of blocks is one matrix product that gives k rows a query. The product only
    picks what can be among the k; those are scored again as cosine() does, which decides.
    """
    from newsloom.sources.scratch import materialise

    cells, centres = index
    widest, columns = np.full(len(centres), -1.0), [1] * len(centres)  # no items
    for r in cells.groupBy("cell").agg(F.max("angle").alias("a"), F.count(F.lit(1)).alias("n")).collect():
        widest[r.cell], columns[r.cell] = r.a, -(-r.n // item_block)
    rows = max(1, -(-queries.count() // query_block))

    def probe(first: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                q = _unit(b["q"].tolist())
                order = np.argsort((centres**2).sum(axis=1)[None] - 2 * q @ centres.T, axis=1, kind="stable")
                if first:
                    yield b[["query_id", "q"]].assign(cells=order[:, :probes].tolist())
                    continue
                reach = np.arccos(np.clip(np.nan_to_num(b["kth"].to_numpy(np.float64), nan=-1.0), -1, 1)) + 1e-6
                can = (_angles(q, centres) - widest <= reach[:, None]) & (widest >= 0)
                yield b[["query_id", "q"]].assign(cells=[[int(c) for c in o[probes:] if ok[c]] for o, ok in zip(order, can, strict=True)])

        return run

    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")

    def best(pairs: DataFrame) -> DataFrame:
        return pairs.select("query_id", "id", "score").withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)

    n_columns = F.element_at(F.array(*[F.lit(n) for n in columns]), (F.col("cell") + 1).cast("int")) if columns else F.lit(1)
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt = cells.select("id", "v", "cell", F.pmod(F.xxhash64("id"), n_columns).cast("int").alias("x")).withColumn("y", upto(F.lit(rows)))
    block = _best_of_block(k)

    def search(asked: DataFrame, first: bool) -> DataFrame:
        probed = asked.mapInPandas(probe(first), "query_id long, q array<float>, cells array<long>").select("query_id", "q", F.explode("cells").alias("cell"))
        stated = probed.select("query_id", "q", "cell", F.pmod(F.xxhash64("query_id"), F.lit(rows)).cast("int").alias("y")).withColumn("x", upto(n_columns))
        keys = ["cell", "x", "y"]
        return best(dealt.groupBy(*keys).cogroup(stated.groupBy(*keys)).applyInArrow(block, "query_id long, id long, score double"))

    near = materialise(search(queries.select("query_id", "q"), True), "ivf-near")
    kth = near.groupBy("query_id").agg(F.when(F.count("score") == k, F.min("score")).alias("kth"))
    rest = search(queries.select("query_id", "q").join(kth, "query_id", "left"), False)
    return best(near.drop("rank").unionByName(rest.drop("rank")))


def _best_of_block(k: int):
    """A function of a block of items (id, v) and one of queries (query_id, q): the k best items of each query, nulls last, NaN first, ties to the smaller id."""

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks()
        return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(flat), -1)

    def squares(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for p in range(x.shape[1]):  # in the order of cosine(), so that equal vectors get equal scores
            out += x[:, p] * x[:, p]
        return np.sqrt(out)

    def kth(rough: np.ndarray) -> np.ndarray:
        """For each row a number that at least k of its entries reach: the k-th largest of the maxima of groups of 64, or of all if those are few."""
        if (whole := rough.shape[1] // 64) >= k:
            rough = rough[:, : whole * 64].reshape(len(rough), whole, 64).max(axis=2)
        n = rough.shape[1]
        return np.partition(rough, n - k, axis=1)[:, n - k] if n > k else np.full(len(rough), -3, np.float32)

    def best(own: pa.Table, stated: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if own.num_rows and stated.num_rows:
            ids, names, x, q = own.column("id").to_numpy(), stated.column("query_id").to_numpy(), matrix(own.column("v")), matrix(stated.column("q"))
            with np.errstate(all="ignore"):
                norms, q_norms = squares(x), squares(q)
                unit = lambda m, n: np.where(n[:, None] == 0, 0.0, m / n[:, None]).astype(np.float32)
                units, q_units, zero = unit(x, norms), unit(q, q_norms), np.flatnonzero(norms == 0)
                slack = np.float32((x.shape[1] + 8) * 2.0**-23)  # twice what a product in single precision can be off
                for at in range(0, len(q), 64):
                    some, own_norms = q[at : at + 64], q_norms[at : at + 64]
                    rough = q_units[at : at + 64] @ units.T
                    np.nan_to_num(rough, copy=False, nan=2.0)
                    rough[:, zero] = -2
                    i, j = np.nonzero(rough >= (kth(rough) - slack)[:, None])
                    dot = np.zeros(len(i))
                    for p in range(x.shape[1]):
                        dot += some[i, p] * x[j, p]
                    below = own_norms[i] * norms[j]
                    score = dot / below
                    none = below == 0
                    order = np.lexsort((ids[j], np.where(none, np.inf, np.where(np.isnan(score), -np.inf, -score)), i))
                    i, j, score, none = i[order], j[order], score[order], none[order]
                    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                    out.append((names[at + i[keep]], ids[j[keep]], score[keep], none[keep]))
        parts = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool)]
        return pa.table({"query_id": pa.array(parts[0], pa.int64()), "id": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.float64(), mask=parts[3])})

    return best


def compare_modes(vector_ranking: DataFrame, text_ranking: DataFrame, config: RetrieverConfig = RetrieverConfig()) -> DataFrame:
    """Vector only, full text only and hybrid, side by side: mode, id, rank."""
    one = lambda d, mode: d.filter(F.col("rank") <= config.final_k).select(F.lit(mode).alias("mode"), "id", "rank")
    return one(vector_ranking, "vector").unionByName(one(text_ranking, "fulltext")).unionByName(one(
        hybrid_search(vector_ranking, text_ranking, config), "hybrid",
    ))


def answer(
    question: str, chunks: DataFrame, model, *, documents: DataFrame | None = None, filters: dict[str, object] | None = None, cache: DataFrame | None = None, now: str, seconds: int = 3600,
    top_k: int | None = None, use_reranking: bool = False, budget_chars: int = 32_000, least_score: float = 0.0, kind: str = "default", prices: tuple[float, float] = (0.0, 0.0), clock=time.perf_counter,
) -> dict:
    """The query endpoint as a function: question and scored chunks in, the endpoint's response out.

    model(prompt) answers; a model with count_tokens() gives the token counts, prices (a million tokens
    in, out) their cost. documents and filters: chunks of documents whose columns have these values
    (None does not filter). top_k: that many sources at most; use_reranking: by shared words with the
    question. An answer in the cache (key, answer, stored_at) that is younger than `seconds` and was
    drawn from the same documents is given again; key is what to store the answer under. What comes to
    the driver is one prompt and its sources, both within the budget.
    """
    began = clock()
    if documents is not None:
        chunks = chunks.join(filtered(documents, filters).select(F.col("id").alias("document_id")), "document_id", "left_semi")
    best = best_chunk(chunks.filter((F.col("score") >= least_score) & (F.length("content") > 0)))
    most = budget_chars if top_k is None else min(top_k, budget_chars)
    if use_reranking:
        best = rerank(
            best.withColumnRenamed("document_id", "id"), question, k=most,
        ).withColumnRenamed("id", "document_id").withColumn("score", F.col("rerank_score")).drop("rerank_score")
    top = ranked(best.withColumnRenamed("document_id", "id"), "score", k=most).withColumn("one", F.lit(1))
    packed = pack_context(top, budget=budget_chars, by=["one"], order=["rank"], size=F.length("content"))
    rows = packed.select(
        "rank", "id", "title", "score", "content",
        context_block(F.col("rank"), F.col("title"), F.col("published_at"), F.col("content")).alias("block"),
    ).orderBy("rank").collect()
    sources = [{"index": r["rank"], "id": r.id, "title": r.title, "score": r.score, "chunk_text": r.content} for r in rows]
    spark = chunks.sparkSession
    key = spark.range(1).select(answer_key(F.lit(question), F.array(*[F.lit(r.id) for r in rows]).cast("array<string>")).alias("k")).first().k
    found = clock()
    said, prompt, cached = None, "", False
    if rows and cache is not None:
        said = cached_answers(spark.createDataFrame([(key,)], "key long"), cache.filter(F.col("key") == key), now=now, seconds=seconds).first().answer
        cached = said is not None
    if rows and not cached:
        prompt = spark.range(1).select(answer_prompt(F.lit("\n\n".join(r.block for r in rows)), F.lit(question), kind).alias("p")).first().p
        said = model(prompt)
    done, count = clock(), getattr(model, "count_tokens", len)
    tokens = (0, 0) if cached or not rows else (count(prompt), count(said))
    return {
        "answer": said, "sources": sources, "query": question, "cached": cached, "key": key,
        "latency_ms": {"retrieval_ms": (found - began) * 1000, "generation_ms": (done - found) * 1000, "total_ms": (done - began) * 1000},
        "tokens_input": tokens[0], "tokens_output": tokens[1], "cost_usd": tokens[0] / 1e6 * prices[0] + tokens[1] / 1e6 * prices[1],
        "llm_model": getattr(model, "name", None), "retrieval_config": {"num_results": len(sources), "reranking": use_reranking},
    }


def answer_key(query: Column, ids: Column) -> Column:
    """Cache key of an answer: the question and the documents it was drawn from."""
    return F.xxhash64(query, F.array_join(ids.cast("array<string>"), ","))


def cached_answers(asked: DataFrame, cache: DataFrame, *, now: str, seconds: int = 3600) -> DataFrame:
    """Questions (key) with the cached answer that is younger than the time to live; others without."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("stored_at").cast("timestamp"))
    fresh = cache.filter((age >= 0) & (age < seconds)).groupBy("key").agg(F.max_by("answer", "stored_at").alias("answer"))
    return asked.join(fresh, "key", "left")


def answer_context(chunks: DataFrame, *, question: str, budget_chars: int = 32_000, least_score: float = 0.0, kind: str = "default") -> DataFrame:
    """From scored chunks (document_id, chunk_index, title, published_at, content, score) to one prompt.

    Low scores and empty contents drop out, the best chunk of each document stays, sources are
    numbered by score and packed up to the budget; the prompt is one row. A source holds a character
    at least, so no more than budget_chars of them can fit.
    """
    best = best_chunk(chunks.filter((F.col("score") >= least_score) & (F.length("content") > 0)))
    top = ranked(best.withColumnRenamed("document_id", "id"), "score", k=budget_chars).withColumn("one", F.lit(1))
    packed = pack_context(top, budget=budget_chars, by=["one"], order=["rank"], size=F.length("content"))
    block = context_block(F.col("rank"), F.col("title"), F.col("published_at"), F.col("content"))
    joined = packed.groupBy("one").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda x: x["block"]), "\n\n").alias("context"),
        F.count(F.lit(1)).alias("n_sources"),
    )
    return joined.select("n_sources", answer_prompt(F.col("context"), F.lit(question), kind).alias("prompt"))
