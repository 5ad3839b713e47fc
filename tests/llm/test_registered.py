"""The registered queries' own columns over whole tables, against brute force."""

import json
import zlib
from collections import Counter

import numpy as np
import pytest

from newsloom.llm import queries

from test_operators import components_by_hand, fingerprint_by_hand, ids_by_hand

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def word_ids(documents):
    return sorted(ids_by_hand(queries.word_tokenizer(), documents))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op2(spark, word_ids):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op2_token_files(spark, SF).collect()}
    at, want = 0, {}
    for i, ids in word_ids:
        want[i] = (at, len(ids), crc(ids))
        at += len(ids)
    assert got == want


def test_op4(spark, documents):
    out = queries.op4_sharding(spark, SF)
    assert out.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    rows = out.collect()
    raw = {i: (x or "").encode() for i, x in documents}
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.grown_shard) for r in rows} == {i: (len(x) + 1, zlib.crc32(x), "rows", None) for i, x in raw.items()}
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    assert sorted((r.shard, r.slot) for r in rows) == sorted((s, k) for s, n in counts.items() for k in range(n))


def test_op5(spark, documents):
    sentencepiece, public = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    library = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    import hashlib

    want = {i: (len(ids), crc(ids), hashlib.sha256((x or "").encode()).hexdigest()) for i, x in documents for ids in [library.encode(x or "")]}
    assert {r.doc_id: (r.n_tokens, r.ids_crc32, r.decoded_sha256) for r in queries.op5_sentence_pieces(spark, SF).collect()} == want


def test_op8(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    got, hit, total = queries.op8_graph_ann(spark, SF).collect(), 0, 0
    assert {r.query_id for r in got} == {int(i) for i in ids if i % 100 == 0}
    for q in {r.query_id for r in got}:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and [m[2] for m in mine] == sorted(m[2] for m in mine)
        assert all(abs(s - d[ids == i][0]) < 1e-12 for _, i, s in mine)
        hit += len({m[1] for m in mine} & set(ids[np.lexsort((ids, d))[:10]].tolist()))
        total += 10
    assert hit / total >= 0.9


def test_op9(spark, word_ids):
    got = queries.op9_best_fit_packing(spark, SF).collect()
    want = {(i, k): (s, len(ids[s : s + 4096]), crc(ids[s : s + 4096])) for i, ids in word_ids for k, s in enumerate(range(0, len(ids), 4096))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(held)]).tolist()]
        assert [o for o, _ in sorted(held)] == ends[:-1] and ends[-1] <= 4096
    assert len(bins) <= 1.02 * -(-sum(len(ids) for _, ids in word_ids) // 4096) + 1


def test_op10(spark, documents):
    prints = {i: fingerprint_by_hand(x) for i, x in documents}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", c) for i, c in components_by_hand(prints.items()).items()}


def test_op3_ablations(spark):
    """The policy's ablations over the whole table, from the ledger's bits alone."""
    rows = queries.op3_quality_rules(spark, SF).collect()
    got = {r.rule: (r.n_failed, r.n_only, r.n_rejected_without) for r in queries.quality_ablations(spark, SF).collect()}
    from newsloom.llm import quality_rules

    for k, (rule, _) in enumerate(quality_rules.RULES):
        bit = 1 << k
        assert got[rule] == (sum(bool(r.failures & bit) for r in rows), sum(r.failures == bit for r in rows), sum(bool(r.failures & ~bit) for r in rows))


def test_names():
    found = queries.queries()
    assert [sum(n.startswith(f"op{k}_") for n in found) for k in range(1, 11)] == [1] * 10
    assert json.dumps(sorted(queries.oracle_sql())) and set(queries.oracle_sql()) <= set(found)
