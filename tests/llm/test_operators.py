"""The training-data operators against brute force on small rows: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import hashlib
import json
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from newsloom.llm import chat_format, common, graph_ann, line_dedup, near_texts, packing, postings, quality_rules, sharding, simhash, substring_dedup, token_files, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A = "the quick brown fox jumps over the lazy dog and runs far away from here today"
B = " ".join(f"w{k}" for k in range(60))
ROWS = [
    (1, f"{A}\n{B}\nshort"), (2, f"  {A.upper()}  \nother {B}"), (3, f"{A}\n{A}\n\n"), (4, f"{A}\t\nx"), (5, A), (6, None), (7, ""), (8, " \n\t\u000b"), (9, f"{B} tail"),
    (10, f"{B} tail"), (11, "é" * 50 + " a | b & c <d> #*$%"), (12, "a b a b a b a b a b " * 10), (13, " ".join(f"x{k % 977}" for k in range(20_000))), (14, "  odd space\u0085 end \u001c x"),
    (15, "one two three"), (16, B.replace("w30", "changed")),
]
TWICE = [*ROWS, (1, ROWS[0][1]), (1, f"different {B}"), (None, B), (None, B), (None, None)]
SCHEMA = "doc_id long, text string, n_words string, shard string, failures string, n_lines string, h1 int, `od.d` int, bucket int, key int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "keep", "s", "f", "l", 1, 2, 3, 4) for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def twice(spark, docs):
    """Rows that repeat, in whole and in id only, and rows without id."""
    return docs.select("doc_id", "text").unionByName(spark.createDataFrame(TWICE[len(ROWS) :], "doc_id long, text string"))


def lines_by_hand(rows, least=40, many=5):
    key = lambda s: s.strip(" \t\n\u000b\f\r").translate(str.maketrans(common.UPPER, common.LOWER))
    held = {}
    for i, text in rows:
        for k in {key(s) for s in (text or "").split("\n")}:
            held.setdefault(k, []).append(-1 if i is None else i)  # a null id is smaller than any other
    out = []
    for i, text in rows:
        all_ = (text or "").split("\n")
        kept = [s for s in all_ if len(key(s)) < least or len(held[key(s)]) < many or (-1 if i is None else i) == max(held[key(s)])]
        out.append((i, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(docs, none, twice):
    out = line_dedup.line_dedup(docs)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()) == Counter(lines_by_hand(ROWS))
    assert "od.d" in out.columns and out.columns.count("n_lines") == 1
    assert line_dedup.line_dedup(none).count() == 0
    for many in (5, 2):
        got = line_dedup.line_dedup(twice, min_docs=many).collect()
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == Counter(lines_by_hand(TWICE, many=many))
    assert max(r.n_dropped for r in out.collect()) == 2


def test_native_plans_hold_no_python(docs):
    for frame in (line_dedup.line_dedup(docs), sharding.shard_records(docs), chat_format.read_back(chat_format.format_trees(chat_format.chains(docs.sparkSession.createDataFrame([(1, 1, "user", "x")], "conv_id int, turn int, role string, text string"))))):
        assert not re.search("Python|Pandas|Arrow", frame._jdf.queryExecution().toString())


def quality_by_hand(text):
    w = WORD.findall(text or "")
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    seen, dup = set(), 0
    for s in (text or "").split("\n"):
        if WORD.search(s):
            dup += s in seen
            seen.add(s)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


def test_quality_rules(docs, none, twice):
    both = quality_rules.quality_ledger(twice).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in both) == Counter((i, *quality_by_hand(t)) for i, t in TWICE)
    ledger = quality_rules.quality_ledger(docs)
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in ledger.collect()} == {i: quality_by_hand(t) for i, t in ROWS}
    assert "od.d" in ledger.columns and ledger.columns.count("failures") == 1
    assert quality_rules.quality_ledger(none).count() == 0
    policy = quality_rules.POLICIES["v1"]
    bits = [r.failures & policy.mask for r in ledger.collect()]
    for r in quality_rules.ablations(ledger, policy).collect():
        bit = 1 << [n for n, _ in quality_rules.RULES].index(r.rule)
        assert (r.n_failed, r.n_only, r.n_rejected_without) == (sum(bool(b & bit) for b in bits), sum(b == bit for b in bits), sum(bool(b & ~bit) for b in bits))
    assert ledger.filter(quality_rules.verdict(policy)).count() == sum(b == 0 for b in bits)


def test_sharding(spark, docs, none, twice):
    out = sharding.shard_records(docs, shards=4, bucket_bytes=4096)
    rows = out.collect()
    assert sorted((r.doc_id, r.text) for r in rows) == sorted(ROWS)
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.slot, r.shard))] != sorted(r.doc_id for r in rows)
    assert sharding.shard_records(none).count() == 0
    assert Counter((r.doc_id, r.text) for r in sharding.shard_records(twice).collect()) == Counter(TWICE)
    same = spark.createDataFrame([(None, "same")] * 3000, "doc_id long, text string")
    spread = Counter(r.shard for r in sharding.shard_records(same, bucket_bytes=1024).collect())
    assert len(spread) == 16 and max(spread.values()) - min(spread.values()) <= 1


def test_shards_do_not_depend_on_the_layout(spark, twice):
    rows = spark.createDataFrame([(k % 40 if k % 3 else None, "t" * (k % 7)) for k in range(600)], "doc_id long, text string").unionByName(twice)
    found = [sorted((r.doc_id or -1, r.text or "", r.shard, r.slot) for r in sharding.shard_records(d, shards=4, bucket_bytes=4096).collect()) for d in (rows, rows.repartition(7))]
    assert found[0] == found[1]
    assert Counter(x[:2] for x in found[0]) == Counter((r.doc_id or -1, r.text or "") for r in rows.collect())


def test_repeated_rows_are_multiplied_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    same = spark.createDataFrame([(1, "same")] * 50 + [(2, "x")], "doc_id long, text string")
    assert Counter(r.doc_id for r in sharding.shard_records(same).collect()) == {1: 50, 2: 1}


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(sharding.shard_records(docs, shards=4), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(ROWS)


def test_covering_triples():
    from itertools import combinations

    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(four) for t in simhash.TRIPLES) for four in combinations(range(8), 4))


def fingerprint_by_hand(text):
    w = WORD.findall((text or "").translate(str.maketrans(common.UPPER, common.LOWER)))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(points, bits=4):
    names = dict(points)
    left, out = set(names), {}
    while left:
        todo, group = [left.pop()], set()
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (names[x] ^ names[y]).bit_count() <= bits}
            left -= near
            todo += near
        out |= {x: min(group) for x in group}
    return out


def test_simhash(docs, none, twice):
    got = simhash.near_duplicates(docs).collect()
    prints = {i: fingerprint_by_hand(t) for i, t in ROWS}
    assert {r.id: r.fp % (1 << 64) for r in got} == prints
    assert {r.id: r.component for r in got} == components_by_hand(prints.items())
    assert simhash.near_duplicates(none).count() == 0
    points = [fingerprint_by_hand(t) for _, t in TWICE]
    groups = components_by_hand(list(enumerate(points)))
    least = {g: min([TWICE[k][0] for k in groups if groups[k] == g and TWICE[k][0] is not None], default=None) for g in groups.values()}
    assert Counter((r.id, r.fp % (1 << 64), r.component) for r in simhash.near_duplicates(twice).collect()) == Counter((i, points[k], least[groups[k]]) for k, (i, _) in enumerate(TWICE))


@pytest.mark.parametrize("hot", [50_000, 7])
def test_links_lose_nothing(spark, hot):
    rng = np.random.default_rng(5)
    points = []
    for base in rng.integers(0, 1 << 63, 12, dtype=np.int64).tolist():
        points += [base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(40)]
    points = sorted({p % (1 << 64) for p in points})
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long")
    from newsloom.llm.components import connected_components

    root = {r.v % (1 << 64): r.root % (1 << 64) for r in connected_components(simhash.links(frame, hot=hot)).collect()}
    groups, want = {}, {}
    for p in points:
        groups.setdefault(root.get(p, p), set()).add(p)
    for p, least in components_by_hand([(p, p) for p in points]).items():
        want.setdefault(least, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_chain(spark):
    from newsloom.llm.components import connected_components

    edges = [(k, k + 1) for k in range(100)] + [(200, 201), (300, 300), (201, 200)]
    got = {r.v: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 101)}, 201: 200}


def substrings_by_hand(rows, window=20):
    first, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in first:
                gone[k : k + window] = [True] * window
            first.add(key)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("records", [10_000, 3])
def test_substring_dedup(spark, docs, none, twice, records):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        out = substring_dedup.substring_dedup(docs, chunk_bytes=1 << 22 if records > 9 else 400)
        assert {r.doc_id: (int(r.n_words), r.n_removed, r.text) for r in out.collect()} == substrings_by_hand(ROWS)
        rng = np.random.default_rng(records)
        passages = [[f"p{j}" for j in rng.integers(0, 30, 30)] for _ in range(4)]
        texts = [" ".join(sum(([f"u{rng.integers(9999)}"] * int(rng.integers(0, 5)) + passages[rng.integers(4)][int(rng.integers(0, 9)) :] for _ in range(3)), [])) for _ in range(40)]
        rows = list(enumerate(texts))
        got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), window=12, core=4, chunk_bytes=700)
        assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got.collect()} == substrings_by_hand(rows, 12)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert substring_dedup.substring_dedup(none).count() == 0
    # rows of one id by the CRC-32 of their texts; equal rows are one place
    places = sorted(set(TWICE), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), r[1] is not None))
    by_place = substrings_by_hand(list(enumerate(t for _, t in places)))
    want = Counter((places[k][0], *by_place[k]) for k in by_place for _ in range(TWICE.count(places[k])))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in substring_dedup.substring_dedup(twice).collect()) == want


def test_long_texts_are_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SEGMENT", 64)
    rows = [(0, " ".join(f"a{k % 150}" for k in range(700))), (1, " ".join(f"a{k}" for k in range(140)))]
    out = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in out.collect()} == substrings_by_hand(rows)


def test_words_at_the_first_place_decide(spark, monkeypatch):
    """With hashes that tell words apart by their first letter only, all paths look alike; none of their words goes."""
    rows = [(1, " ".join(f"a{k}" for k in range(40))), (2, " ".join(f"a{k}" for k in range(50, 90))), (3, " ".join(f"b{k}" for k in range(30)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")

    def first_letters(self, words):
        codes = np.array([w[0] for w in words], np.uint64)
        return codes, codes + np.uint64(1)

    monkeypatch.setattr(substring_dedup._Words, "hashes", first_letters)
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(frame).collect()} == {1: (40, 0), 2: (40, 0), 3: (30, 0)}
    monkeypatch.setattr(substring_dedup, "_digest", lambda *_: b"")
    assert sum(r.n_removed for r in substring_dedup.substring_dedup(frame).collect()) > 40


def test_paths_are_compacted_by_joins(spark):
    spans = [(2, 0, p, 1, 1, 0, p + 3) for p in range(5)] + [(2, 0, 5, 4, 1, 0, 8), (2, 0, 9, 1, 7, 0, 12), (2, 0, 12, 2, 1, 0, 15), (2, 0, 12, 2, 1, 0, 15), (3, 0, 0, 1, 1, 0, 3)]
    frame = spark.createDataFrame(spans, "key long, mark int, pos int, n int, fkey long, fmark int, fpos int")
    got = sorted(tuple(r) for r in substring_dedup.compacted(frame).collect())
    assert got == [(2, 0, 0, 9, 1, 0, 3), (2, 0, 9, 1, 7, 0, 12), (2, 0, 12, 2, 1, 0, 15), (3, 0, 0, 1, 1, 0, 3)]


def test_layout_is_kept(spark):
    rows = [(1, f"x {B}"), (2, f"start\n\n{B}  end\n")]
    out = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), layout="text")
    assert {r.doc_id: r.text for r in out.collect()} == {1: f"x {B}", 2: "start  end"}


# conversations


def conversations_by_hand(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        out[c] = [((r[2] or ""), (r[3] or "")) for r in own]
    return out


def test_chat_round_trip(spark):
    odd = [chat_format.BEGIN, chat_format.END + chat_format.MIDDLE, "\\", "<\\", "\\<\\|", "</s>[INST]", "", None, "a\nb", "é\U0001f600<|", "<" * 5]
    rows = [(c, k, "assistant" if k % 2 else "user", odd[(c + k) % len(odd)]) for c in range(12) for k in range(1 + c * 3)] + [(99, 0, None, "x"), (99, 5, "<|says|>", None), (99, 7, "assistant", "only")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, branch int")
    want = conversations_by_hand(rows)
    back = chat_format.read_back(chat_format.format_trees(chat_format.chains(frame))).collect()
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in back} == want
    assert {r.conv_id: list(r.learned) for r in back} == {c: [t for role, t in turns if role == "assistant"] for c, turns in want.items()}
    assert chat_format.format_trees(chat_format.chains(frame.limit(0))).count() == 0


def test_null_conversation_is_its_own(spark):
    rows = [(None, 1, "user", "a"), ("null conv", 1, "user", "b"), ("", 1, "user", "c"), (None, 2, "assistant", "d"), (None, 2, "assistant", "d")]
    back = chat_format.read_back(chat_format.format_trees(chat_format.chains(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")))).collect()
    assert {r.conv_id: [t.text for t in r.turns] for r in back} == {None: ["a", "d", "d"], "null conv": ["b"], "": ["c"]}


def test_repeated_nodes_of_null_conversations(spark):
    rows = [(None, 1, None, "user", "q", 0.0), (None, 2, 1, "assistant", "b", 1.0), (None, 2, 1, "assistant", "a", 5.0), (7, 1, None, None, None, None), (7, 2, 99, "user", "other root", None)]
    frame = spark.createDataFrame(rows, "conv_id int, node int, parent int, role string, text string, score double")
    back = {(r.conv_id, r.branch): [t.text for t in r.turns] for r in chat_format.read_back(chat_format.format_trees(frame, best=3)).collect()}
    assert back == {(None, 1): ["q", "a"], (7, 1): [""], (7, 2): ["other root"]}


def test_trees_are_ranked(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", None), (1, 5, 4, "assistant", "end", 0.5), (1, 6, 7, "user", "loop", 1.0), (1, 7, 6, "user", "loop", 1.0), (1, None, None, "x", "y", 9.0), (1, 3, 1, "zz", "repeat", 0.9)]
    frame = spark.createDataFrame(rows, "conv_id int, node int, parent int, role string, text string, score double")
    got = sorted(chat_format.read_back(chat_format.format_trees(frame, best=2)).collect(), key=lambda r: r.branch)
    assert [[t.text for t in r.turns] for r in got] == [["q", "good", "more", "end"], ["q", "bad"]]
    assert [list(r.learned) for r in got] == [["good", "end"], ["bad"]]


# tokens

TINY = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path(TINY)


def ids_by_hand(path, rows, end=1):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [(i, [*t.encode(x or "", add_special_tokens=False).ids, end]) for i, x in rows]


ODD_TEXTS = ["<|endoftext|>", "a<|startoftext|> b", "x\u000by", "x\u001cy z\u0085w v", "é ΑΣ Σ I'LL don't 12a3", "́ lead", "İstanbul ſ", "a" * 500, "日本語 テキスト", "﻿bom", "tab\tnew\nline\r\f"]


def test_words_encode_like_whole_texts(path):
    encoder = tokens.Encoder(tokens.tokenizer_json(path), most=3)
    assert encoder.by_word
    texts = [*ODD_TEXTS, "(word) word's Straße! Öde... e\u0301= a=\u0338 <|x|> mix'd,", None, *(t for _, t in ROWS)]
    want = [i[:-1] for _, i in ids_by_hand(path, enumerate(texts))]
    assert [x.tolist() for x in encoder.encode(texts)] == want


def test_other_tokenizers_encode_whole_texts(path):
    P = pytest.importorskip("public_tokenizers")
    other = P.path("byte_bpe_50k.json")
    encoder = tokens.Encoder(tokens.tokenizer_json(other))
    assert not encoder.by_word
    assert [x.tolist() for x in encoder.encode([A])] == [ids_by_hand(other, [(0, A)])[0][1][:-1]]


def test_case_is_kept_without_a_lowercase_step(path):
    from tokenizers import Tokenizer

    definition = json.loads(tokens.tokenizer_json(path))
    definition["normalizer"]["normalizers"] = [n for n in definition["normalizer"]["normalizers"] if n["type"] != "Lowercase"]
    cased = json.dumps(definition)
    encoder, library = tokens.Encoder(cased), Tokenizer.from_str(cased)
    texts = ["Hello World FOO bar", "hello world foo BAR, Öl", A.upper()]
    assert encoder.by_word
    assert [x.tolist() for x in encoder.encode(texts)] == [library.encode(x, add_special_tokens=False).ids for x in texts]


def test_token_files(spark, docs, none, twice, path):
    rows = sorted(ids_by_hand(path, ROWS))
    got = sorted(token_files.round_trip(docs, path, block=1000).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, ids) in zip(got, rows, strict=True):
        assert (r.id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (i, at, len(ids), ids)
        at += len(ids)
    assert token_files.round_trip(none, path).count() == 0
    both = sorted(token_files.round_trip(twice, path).collect(), key=lambda r: r.start)
    assert [r.id for r in both] == sorted((i for i, _ in TWICE), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in both] == [0, *np.cumsum([r.n_tokens for r in both]).tolist()[:-1]]
    assert Counter((r.id, r.ids) for r in both) == Counter((i, np.array(ids, "<u4").tobytes()) for i, ids in ids_by_hand(path, TWICE))
    assert [r.ids_crc32 for r in token_files.round_trip(docs.filter("doc_id = 1"), path, digest=True).collect()] == [zlib.crc32(np.array(rows[0][1], "<u4").tobytes())]


def test_codes():
    rng = np.random.default_rng(3)
    for n, limit in ((1, 16), (2, 16), (300, 9), (5000, 16), (49408, 16)):
        counts = rng.zipf(1.3, n).astype(np.int64)
        counts[rng.integers(0, n)] += 1
        lengths = token_files.code_lengths(counts, limit)
        assert lengths.max() <= max(limit, (n - 1).bit_length()) and sum(2.0 ** -lengths) <= 1
        ids = rng.integers(0, n, 3001).astype(np.uint32)
        bits, points = token_files.encode_block(ids, token_files.canonical_codes(lengths), lengths)
        assert (token_files.decode_block(bits, points, len(ids), token_files.decode_table(lengths)) == ids).all()
    import heapq

    counts = rng.integers(1, 1000, 200)
    heap = [(int(c), k, 0) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], a[1], 0))
    assert int((counts * token_files.code_lengths(counts, 32)).sum()) == cost


def test_packing(docs, none, twice, path):
    for frame, rows in ((docs, ROWS), (twice, TWICE)):
        got = packing.pack(frame, path, capacity=256, with_ids=True).collect()
        bins = {}
        for r in got:
            assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for held in bins.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= 256
        want = Counter((i, k, s, np.array(ids[s : s + 256], "<u4").tobytes()) for i, ids in ids_by_hand(path, rows) for k, s in enumerate(range(0, len(ids), 256)))
        assert Counter((r.id, r.piece, r.start, r.ids) for r in got) == want
    assert packing.pack(none, path).count() == 0


def test_plans_hold_all_and_are_near_the_bound():
    rng = np.random.default_rng(9)
    for sizes in (rng.integers(1, 101, 4000), rng.integers(34, 60, 999), np.full(500, 100), rng.integers(20, 50, 300), np.array([1] * 50 + [99] * 50)):
        counts = {int(k): int(v) for k, v in Counter(sizes.tolist()).items()}
        found = packing.plan(counts, 100)
        held = Counter()
        for n, items in found:
            assert n > 0 and sum(s * k for s, k in items) <= 100
            for s, k in items:
                held[s] += n * k
        assert held == counts
        bins = sum(n for n, _ in found)
        assert bins <= 11 / 9 * -(-int(sizes.sum()) // 100) + 350 * (sizes.min() >= 34)
    assert sum(n for n, _ in packing.plan({99: 50, 1: 50}, 100)) == 50


def test_reduction_is_optimal_for_small_sets():
    from functools import lru_cache

    rng = np.random.default_rng(4)

    @lru_cache(None)
    def least(items):
        if not items:
            return 0
        first, rest = items[-1], items[:-1]
        best, seen = len(items), set()

        def fill(room, k, taken):
            nonlocal best
            key = tuple(x for j, x in enumerate(rest) if j not in taken)
            if key not in seen:
                seen.add(key)
                best = min(best, 1 + least(key))
            for j in range(k, len(rest)):
                if rest[j] <= room:
                    fill(room - rest[j], j + 1, taken | {j})

        fill(20 - first, 0, frozenset())
        return best

    for _ in range(150):
        items = sorted(rng.integers(2, 20, 8).tolist())
        left = packing._Lengths(dict(Counter(items)), 20)
        fixed = packing.reduce_by_dominance(left, 20)
        rest = [s for s in range(21) for _ in range(int(left.n[s]))]
        assert sum(n for n, _ in fixed) + least(tuple(rest)) == least(tuple(items))


# vectors


def test_crowded_shards_are_split(spark):
    """A third of all vectors around one point: its shard comes in parts, and every part is searched."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(800, 8)), 5 + 0.01 * rng.normal(size=(400, 8))])
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = graph_ann.nearest(frame, F.col("id") % 40 == 0, shard_size=40, homes=2).collect()
    hit = 0
    for q in range(0, 1200, 40):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.9 * 300 and len(got) == 300


@pytest.mark.parametrize("shard_size", [1200, 250])
def test_graph_search(spark, shard_size):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    rows = [(k, v.tolist(), "s") for k, v in enumerate(x)] + [(5000 + k, x[7].tolist(), "s") for k in range(900)]
    bad = [(9000, None, "s"), (9100, [0.0] * 16, "s"), (9200, [float("nan")] * 16, "s"), (9300, [float("inf")] + [1.0] * 15, "s"), (None, x[1].tolist(), "s"), (9400, [], "s"), (5000, x[7].tolist(), "s")]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, shard string")
    got = graph_ann.nearest(frame, F.col("id") % 100 == 0, shard_size=shard_size).collect()
    ids = np.array([r[0] for r in rows])
    v = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    hit = total = 0
    for q in sorted({r.query_id for r in got}):
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        want = np.lexsort((ids, d))[:10]
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(abs(s - d[ids == i][0]) < 1e-12 for _, i, s in mine)
        hit += len({m[1] for m in mine} & set(ids[want].tolist()))
        total += 10
        if q >= 5000:
            assert [m[1] for m in mine] == ids[want].tolist()
    assert {r.query_id for r in got} == {int(i) for i in ids if i % 100 == 0}
    assert hit / total >= 0.95
    assert graph_ann.nearest(frame.limit(0), F.col("id") % 100 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in graph_ann.nearest(few, F.col("id") == 0).collect()] == [(0, 1, 1)]


# pipeline


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as p

    base = spark.createDataFrame(
        [(k, "\n".join([A + " and some more words here", " ".join(f"d{k}w{j}" for j in range(80)), B if k % 3 else "none"]), "en", "src", 0) for k in range(12)]
        + [(50 + k, "\n".join(f"c{j} d{j} e{j} f{j}" for j in range(40)), "en", "src", 0) for k in range(4)] + [(90, "*** | " * 100, "en", "src", 0), (91, None, "en", "src", 0), (None, " ".join(f"n{j}" for j in range(70)), "en", "src", 0)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    now = base
    kept = []
    for name, stage in p.STAGES[:-1]:
        now = common.materialise(stage(spark, now, ""), "stage")
        assert now.columns == base.columns, name
        kept.append(now.collect())
    assert {r.doc_id for r in kept[0]} == {*range(12), *range(50, 54), None}
    by_line = lines_by_hand([(r.doc_id, r.text) for r in kept[0]])
    assert {r.doc_id: r.text for r in kept[1]} == {i: t for i, _, _, t in by_line}
    assert all(r.n_chars == len(r.text) for r in kept[1])
    assert {r.doc_id for r in kept[2]} == {*range(12), 50, None}
    want = substrings_by_hand([(-1 if r.doc_id is None else r.doc_id, r.text) for r in kept[2]])
    assert {-1 if r.doc_id is None else r.doc_id: " ".join(r.text.split()) for r in kept[3]} == {i: t for i, (_, _, t) in want.items()}
    last = p.STAGES[-1][1](spark, now, "").collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in kept[3]}


def near_by_hand(rows, least=0.8):
    """Component of each row by all pairs of five-word shingle sets."""
    sets = []
    for _, text in rows:
        w = (text or "").translate(str.maketrans(common.UPPER, common.LOWER))
        w = WORD.findall(w)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    alike = lambda a, b: not (a | b) or len(a & b) >= least * len(a | b)
    left, out = set(range(len(rows))), {}
    while left:
        todo, group = [left.pop()], []
        while todo:
            x = todo.pop()
            group.append(x)
            found = {y for y in left if alike(sets[x], sets[y])}
            left -= found
            todo += found
        ids = [rows[x][0] for x in group if rows[x][0] is not None]
        out |= {x: min(ids, default=None) for x in group}
    return out


@pytest.mark.parametrize("block", [4 << 20, 3000])
def test_near_texts(spark, docs, none, twice, monkeypatch, block):
    """Copies at similarities about 0.8 against all pairs; chains, repeated rows and ids included; groups in one block and in many."""
    monkeypatch.setattr(near_texts, "BLOCK_BYTES", block)
    rng = np.random.default_rng(1)
    rows, base = [(100 + i, t) for i, t in ROWS], [[f"b{g}x{j}" for j in range(200)] for g in range(6)]
    for g, words in enumerate(base):
        for c in range(12):
            copy = list(words)
            for at in rng.choice(200, c // 2, replace=False):
                copy[at] = f"new{g}x{c}x{at}"
            rows.append((1000 + 100 * g + c, " ".join(copy)))
    rows += [(1, B), (1, A), (None, B), (None, None), (7, f"{B} one more")]
    want = Counter((rows[k][0], near_texts_hash, c) for k, c in near_by_hand(rows).items() for near_texts_hash in [rows[k][1] or ""])
    assert len({c for (_, _, c), _ in want.items()}) < len(rows) - 50
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    names = {r.v: r.text for r in frame.select(near_texts.text_hash(F.col("text")).alias("v"), F.coalesce("text", F.lit("")).alias("text")).collect()}
    assert Counter((r.id, names[r.v], r.component) for r in near_texts.near_duplicates(frame).collect()) == want
    assert near_texts.near_duplicates(none).count() == 0


def test_no_count_or_verification_no_exactness(spark):
    """Without the tally, or without the bits, more pairs of a posting list go on; the links that are right do not change."""
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
    flips = lambda n: sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    prints = np.unique(np.concatenate([centre ^ np.array([flips(n)], np.uint64) for n in rng.integers(0, 9, 400)]))
    x = (prints[:, None] ^ prints[None, :])[..., None]
    tallied, bits = postings.tally(x) >= 4, np.bitwise_count(x).sum(axis=-1) <= 4
    assert (postings.near(x, 4, 4) == bits).all() and (bits <= tallied).all()
    assert bits.sum() < tallied.sum() < x.size


def test_pipeline_drops_near_copies(spark):
    import corpus_pipeline as p

    words = [f"w{j}" for j in range(200)]
    rows = [(k, " ".join(words[: 50 * k] + [f"new{k}"] + words[50 * k + 1 :])) for k in range(4)] + [(9, " ".join(words[:100]))]
    got = p.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert {r.doc_id for r in got} == {0, 9}


def test_pipeline_keeps_rows_of_one_id_with_other_texts(spark):
    import corpus_pipeline as p

    a, b, c = (" ".join(f"{x}{j}" for j in range(60)) for x in "abc")
    rows = [(1, a, "de"), (1, b, "en"), (2, a, "en"), (2, c, "en"), (3, b, "en"), (1, a, "en"), (None, a, "en"), (None, a, "en")]
    got = p.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), "").collect()
    assert sorted((r.doc_id or 0, r.text, r.lang) for r in got) == [(0, a, "en"), (0, a, "en"), (1, a, "de"), (1, b, "en"), (2, c, "en")]


def test_pipeline_on_odd_rows(spark):
    """No rows; columns called like those that stages compute; ids that repeat or are null."""
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words int, n_lines string, failures int, v long, root long, id long, key int, `od.d` int"
    whole = lambda n: " ".join(f"{n}{j}" for j in range(70))
    more = ("en", "s", 0, 1, "l", 2, 3, 4, 5, 6, 7)
    rows = [(1, whole("a"), *more), (1, whole("b"), *more), (1, whole("a"), *more), (2, whole("b"), *more), (None, whole("c"), *more), (None, whole("c"), *more), (3, None, *more), (4, "", *more)]
    for now, want in ((spark.createDataFrame([], schema), Counter()), (spark.createDataFrame(rows, schema).repartition(3), Counter({(1, "a"): 1, (1, "b"): 1, (None, "c"): 2}))):
        columns = now.columns
        for name, stage in p.STAGES[:-1]:
            now = common.materialise(stage(spark, now, ""), "stage")
            assert now.columns == columns, name
        assert Counter((r.doc_id, (r.text or "-")[0]) for r in now.collect()) == want
        assert all((r.n_chars, r.n_words, r.n_lines, r.failures, r.v, r.root, r.id, r.key, r["od.d"]) == (len(r.text), 1, "l", 2, 3, 4, 5, 6, 7) for r in now.collect())
        last = p.STAGES[-1][1](spark, now, "").collect()
        assert Counter(r.doc_id for r in last) == Counter({i: sum(n for (j, _), n in want.items() if j == i) for i, _ in want})
    assert len({(r.sequence_id, r.offset) for r in last}) == len(last)


def test_oracles_match(spark):
    import os

    import duckdb

    from newsloom.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        path = f"{sf}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, sf).toPandas()
        want = con.execute(sql).df()
        key = got.columns[0]
        order = sorted(got.columns)
        assert order == sorted(want.columns)
        pairs = [json.dumps(f[order].sort_values(key).astype(str).values.tolist()) for f in (got, want)]
        assert hashlib.sha256(pairs[0].encode()).digest() == hashlib.sha256(pairs[1].encode()).digest(), name


def test_sentence_pieces(spark, docs, none, twice):
    public = pytest.importorskip("public_tokenizers")
    sentencepiece = pytest.importorskip("sentencepiece")
    from newsloom.llm import sentence_pieces

    model = public.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    odd = [*ODD_TEXTS, " ", "  a  b ", "\n\n", "x▁y ▁▁z", "<s> <0x0A> <unk>", " " * 50 + "x", "a" * 99, "=" * 77, "😀é\u0301", "\x00"]
    encoder = sentence_pieces.PieceEncoder(sentence_pieces.load_pieces(model), most=20)
    for texts in (odd, odd[::-1]):
        got = encoder.encode(texts)
        assert [g.tolist() for g in got] == [library.encode(x) for x in texts]
        assert [encoder.decode(g) for g in got] == [x.replace("▁", " ") for x in texts]
    back = {r.id: r for r in sentence_pieces.decode(sentence_pieces.encode(docs, model), model).collect()}
    for i, text in ROWS:
        ids = library.encode(text or "")
        assert (back[i].text, back[i].n_tokens, back[i].ids_crc32) == (text or "", len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert sentence_pieces.encode(none, model).count() == 0
    both = sentence_pieces.decode(sentence_pieces.encode(twice, model), model).collect()
    assert Counter((r.id, r.text, r.n_tokens) for r in both) == Counter((i, t or "", len(library.encode(t or ""))) for i, t in TWICE)


def test_suffix_array_ranges():
    from newsloom.llm import sentence_pieces

    rng = np.random.default_rng(2)
    text = "".join("abc"[k] for k in rng.integers(0, 3, 400))
    codes = np.array([ord(c) for c in text], np.int64)
    order = sentence_pieces.suffix_array(codes, 8)
    words = ["a", "ab", "abc", "cba", "ccc", "bbbbbbbb", "z"]
    patterns = np.array([[*map(ord, w), *[0] * (8 - len(w))] for w in words])
    low, high = sentence_pieces.occurrence_ranges(codes, order, patterns, np.array(list(map(len, words))))
    for w, a, b in zip(words, low, high, strict=True):
        assert sorted(order[a:b].tolist()) == [k for k in range(len(text)) if text.startswith(w, k)]


def test_sentence_pieces_where_workers_lack_the_package(tmp_path):
    """A driver that has the package on its path alone, started from another folder."""
    import os
    import subprocess
    import sys

    public = pytest.importorskip("public_tokenizers")
    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))!r})
from pyspark.sql import SparkSession
from newsloom.llm import sentence_pieces
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
docs = spark.createDataFrame([(1, "a few words"), (2, None)], "doc_id long, text string")
model = {public.path("piece_bpe_32k.model")!r}
print("GOT", sorted((r.id, r.text) for r in sentence_pieces.decode(sentence_pieces.encode(docs, model), model).collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "GOT [(1, 'a few words'), (2, '')]" in done.stdout, done.stderr[-2000:]
