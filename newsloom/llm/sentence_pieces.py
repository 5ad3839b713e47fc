"""SentencePiece encoding and decoding by suffix-array matching, for BPE models with byte fallback."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import trimmed, worker_held
from .tokens import crc32, parts_of

SPACE = "▁"
#: Set between cuts while a batch is split; texts that hold it are split in another way.
CUT = "\x01"
#: Symbols of single characters that are no piece start here; ids of pieces lie below.
LONE = 1 << 24


@dataclass(frozen=True)
class Pieces:
    """What encoding and decoding need of a model: a bounded table, sent to the executors once."""

    name: str
    pieces: tuple[str, ...]
    scores: dict[str, float]
    usable: np.ndarray
    byte_ids: np.ndarray
    surfaces: tuple[bytes, ...]
    prefix: bool
    splits: bool


def merged(text: str, scores: dict[str, float]) -> list[str]:
    """The model's own merging: the best-scored adjacent pair first, the leftmost among equals."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for k in range(len(parts) - 1):
            score = scores.get(parts[k] + parts[k + 1])
            if score is not None and (best is None or score > best):
                best, at = score, k
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def load_pieces(path: str) -> Pieces:
    """Read a BPE model with byte fallback and identity normalisation; others raise ValueError."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        raw = f.read()
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(raw)
    n, t = model.normalizer_spec, model.trainer_spec
    if t.model_type != 2 or not t.byte_fallback or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or any(p.type in (4, 5) for p in model.pieces):
        raise ValueError("only BPE models with byte fallback, identity normalisation and plain pieces are matched")
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    names = tuple(p.piece for p in model.pieces)
    plain = [p.type == 1 for p in model.pieces]
    scores = {p.piece: p.score for p in model.pieces if p.type == 1}
    usable = np.array([k for k, p in enumerate(names) if plain[k] and merged(p, scores) == [p]], np.int64)
    byte_ids = np.array([library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
    back = {int(i): bytes([b]) for b, i in enumerate(byte_ids)}
    surfaces = tuple(back.get(k, p.replace(SPACE, " ").encode() if plain[k] else b"") for k, p in enumerate(names))
    splits = all(re.fullmatch(f"{SPACE}*[^{SPACE}\n]*", p) for p in scores)
    return Pieces(hashlib.sha256(raw).hexdigest(), names, scores, usable, byte_ids, surfaces, n.add_dummy_prefix, splits)


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` codes (prefix doubling), those equal so far in any order; codes are positive."""
    n, rank, width = len(codes), codes.astype(np.int64), 1
    while True:
        ahead = np.zeros(n, np.int64)
        if width < depth and width < n:
            ahead[: n - width] = rank[width:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + ahead if width < depth else rank
        order = np.argsort(key)
        if width >= depth:
            return order
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, sorted_key[1:] != sorted_key[:-1]])
        width *= 2


def occurrence_ranges(codes: np.ndarray, order: np.ndarray, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of all patterns at once: the range of suffixes that begin with each."""
    n, width = len(codes), patterns.shape[1]
    padded = np.concatenate([codes, np.zeros(width, codes.dtype)])
    mask = np.arange(width) < sizes[:, None]

    def bound(after: bool) -> np.ndarray:
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), n, np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            gap = np.where(mask[open_], padded[order[mid][:, None] + np.arange(width)] - patterns[open_], 0)
            first = (gap != 0).argmax(axis=1)
            sign = gap[np.arange(len(open_)), first]
            right = sign <= 0 if after else sign < 0
            low[open_] = np.where(right, mid + 1, low[open_])
            high[open_] = np.where(right, high[open_], mid)
        return low

    return bound(False), bound(True)


class PieceEncoder:
    """Encodes texts chunk by chunk; chunks met before come from a table of bounded size."""

    def __init__(self, model: Pieces, most: int = 400_000):
        self.model, self.most = model, most
        self.depth = max(len(model.pieces[int(k)]) for k in model.usable)
        self.sizes_of = np.array([len(model.pieces[int(k)]) for k in model.usable], np.int64)
        self.patterns = np.zeros((len(model.usable), self.depth), np.int64)
        for row, k in enumerate(model.usable):
            self.patterns[row, : self.sizes_of[row]] = [ord(c) + 1 for c in model.pieces[int(k)]]
        ends = np.take_along_axis(self.patterns, np.maximum(self.sizes_of[:, None] - 2 + np.arange(2), 0), 1)
        pairs = [(p[:, 0] << 21) | p[:, 1] for p in (self.patterns, ends)]
        triples = (pairs[0] << 21) | self.patterns[:, 2 % self.depth]
        self.heads = {2: [np.where(self.sizes_of >= 2, x, -1) for x in pairs], 3: [np.where(self.sizes_of >= 3, triples, -1)]}
        self.single = {model.pieces[int(k)] for k in model.usable if len(model.pieces[int(k)]) == 1}
        self.known, self.fits = np.empty(0, np.int64), np.empty(0, bool)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {"": 0}
        self.ids = np.empty(0, np.uint32)
        self.starts = self.sizes = np.zeros(1, np.int64)

    def _surface(self, symbol: int) -> str:
        return chr(symbol - LONE) if symbol >= LONE else self.model.pieces[symbol]

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two symbols side by side stay two; each pair is merged by hand once."""
        keys = (left.astype(np.int64) << 26) | right
        pairs, back = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.known, pairs)
        new = pairs[(at >= len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != pairs)] if len(self.known) else pairs
        if len(new):
            if len(self.known) > 4_000_000:
                self.known, self.fits, new = np.empty(0, np.int64), np.empty(0, bool), pairs
            names = [(self._surface(int(k >> 26)), self._surface(int(k & ((1 << 26) - 1)))) for k in new]
            ok = np.array([merged(a + b, self.model.scores) == [a, b] for a, b in names], bool)
            where = np.searchsorted(self.known, new)
            self.known, self.fits = np.insert(self.known, where, new), np.insert(self.fits, where, ok)
            at = np.searchsorted(self.known, pairs)
        return self.fits[at][back]

    def _can_occur(self, codes: np.ndarray) -> np.ndarray:
        """Pieces whose first three (or fewer) and last two characters stand side by side in the text: the others need no search."""
        able = np.ones(len(self.patterns), bool)
        for width, heads in self.heads.items():
            there = np.zeros(max(0, len(codes) - width + 1), np.int64)
            for k in range(width):
                there = (there << 21) | codes[k : len(codes) - width + 1 + k]
            there = np.unique(there)
            for own in heads:
                able &= (own < 0) | (there[np.minimum(np.searchsorted(there, own), len(there) - 1)] == own if len(there) else own < 0)
        return np.flatnonzero(able)

    def learn(self, chunks: list[str]) -> None:
        """Match all pieces in the chunks' joined text, sort the edges by where they end, and relax them.

        The encoding of a prefix is the prefix of an encoding, so each place has one last symbol: that
        edge to it which is compatible with the last symbol of the place it starts from.
        """
        if not chunks:
            return
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        begin = np.cumsum(lengths + 1) - lengths - 1
        codes = np.frombuffer("\0".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
        codes[(begin + lengths)[:-1]] = 0
        order = suffix_array(codes, self.depth)
        able = self._can_occur(codes)
        low, high = occurrence_ranges(codes, order, self.patterns[able], self.sizes_of[able])
        count = high - low
        total = int(count.sum())
        at = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        small = np.int32  # edges are many: places, sizes and symbols of a batch fit
        start = order[at].astype(small)
        del at, order
        size, symbol = np.repeat(self.sizes_of[able].astype(small), count), np.repeat(self.model.usable[able].astype(small), count)
        lone = np.flatnonzero(~np.isin(codes, [0, *(ord(c) + 1 for c in self.single)]))
        start, size, symbol = np.r_[start, lone.astype(small)], np.r_[size, np.ones(len(lone), small)], np.r_[symbol, (LONE + codes[lone] - 1).astype(small)]

        chunk = np.repeat(np.arange(len(chunks)), lengths + 1)[: len(codes)]
        end = start + size
        offset = end - begin.astype(small)[chunk[start]]
        rank = np.argsort(offset.astype(np.uint16) if offset.max(initial=0) < 1 << 16 else offset, kind="stable")
        start, end, symbol, offset = start[rank], end[rank], symbol[rank], offset[rank]
        del rank, size
        last, back = np.full(len(codes) + 1, -1, np.int64), np.zeros(len(codes) + 1, np.int64)
        first = np.zeros(len(codes) + 1, bool)
        first[begin] = True
        steps = np.flatnonzero(np.r_[True, offset[1:] != offset[:-1], True])
        # last[p] belongs to the chunk that ends or goes on at p; a chunk's own beginning has none
        for a, b in zip(steps[:-1], steps[1:], strict=True):
            s, e, y = start[a:b], end[a:b], symbol[a:b]
            good = first[s].copy()
            rest = np.flatnonzero(~good)
            if len(rest):
                good[rest] = self._compatible(last[s[rest]], y[rest])
            last[e[good]], back[e[good]] = y[good], s[good]

        spans, now, own = [], begin + lengths, np.arange(len(chunks))
        while len(own):
            spans.append((own, now, last[now]))
            now = back[now]
            more = now > begin[own]
            own, now = own[more], now[more]
        own, place, symbol = (np.concatenate(x) for x in zip(*spans, strict=True))
        rank = np.lexsort((place, own))
        own, symbol = own[rank], symbol[rank]
        lone = np.flatnonzero(symbol >= LONE)
        out, owner = symbol, own
        if len(lone):
            raw = [chr(int(c) - LONE).encode("utf-8", "surrogatepass") for c in symbol[lone]]
            width = np.ones(len(symbol), np.int64)
            width[lone] = [len(r) for r in raw]
            out, owner = np.repeat(symbol, width), np.repeat(own, width)
            spread = np.repeat(np.isin(np.arange(len(symbol)), lone), width)
            out[spread] = self.model.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        sizes = np.bincount(owner, minlength=len(chunks))
        self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(sizes) - sizes]
        self.sizes = np.r_[self.sizes, sizes]
        self.ids = np.r_[self.ids, out.astype(np.uint32)]
        self.places.update(zip(chunks, range(len(self.places), len(self.places) + len(chunks)), strict=True))

    def _cuts(self, texts: pa.Array) -> pa.ListArray:
        """Each text cut before runs of white space and around line ends; some cuts may be empty."""
        texts = pc.replace_substring(texts, " ", SPACE)
        if self.model.prefix:
            texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(SPACE, texts, ""))
        if not self.model.splits:
            return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32)), texts)
        if pc.any(pc.match_substring(texts, CUT)).as_py():
            return pa.array([self.cut.findall(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        marked = pc.replace_substring(pc.replace_substring_regex(texts, f"({SPACE}+)", f"{CUT}\\1"), "\n", f"{CUT}\n{CUT}")
        return pc.split_pattern(marked, CUT)

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """The ids of each text; null and empty texts have none."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(texts):
            return []
        cut = self._cuts(texts)
        words = cut.flatten().dictionary_encode()
        names = words.dictionary.to_pylist()
        if len(self.places) > self.most:
            self.clear()
        self.learn([c for c in names if c not in self.places])
        at = np.fromiter(map(self.places.__getitem__, names), np.int64, len(names))[words.indices.to_numpy()]
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(total)]
        edges = np.r_[0, ends][cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and bytes joined, without the space put before the text."""
        data = b"".join(map(self.model.surfaces.__getitem__, ids.tolist()))
        if self.model.prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


def _shared(spark: SparkSession, model_path: str):
    """A model's fields, broadcast as plain values: executors have no copy of this package to find a class in."""
    model = load_pieces(model_path)
    return spark.sparkContext.broadcast(tuple(getattr(model, f.name) for f in fields(model)))  # the vocabulary


def _encoder(values: tuple) -> PieceEncoder:
    """One encoder for each worker process and model: its tables outlive tasks and only save time."""
    return worker_held(f"pieces {values[0]}", lambda: PieceEncoder(Pieces(*values)))


def encode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", part: int = 2 << 20) -> DataFrame:
    """id (long), n_tokens (long), ids (binary: little-endian unsigned 32-bit) of each whole text.

    Texts are cut where no piece reaches over (before white space, around line ends). The distinct
    cuts of a batch that a worker has not met yet (a table of bounded size holds the others' ids) are
    joined and indexed by a suffix array; every piece's occurrences are a range
    of it, found by binary search. The occurrences are the edges of a lattice, sorted by where they
    end and relaxed in that order. The lattice's paths are checked with the model's merge order
    instead of summed scores: a BPE model defines its encoding by merges, and the library's ids are
    what comes out.

    Null and empty texts give no ids. Rows are encoded one by one: repeated rows and null ids come
    through; extra columns are ignored. No rows in, no rows out.
    """
    shared = _shared(docs.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            for own in parts_of(batch, 1, part):
                ids = encoder.encode(own.column(1))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())],
                    names=["id", "n_tokens", "ids"],
                )

    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"),
    ).mapInArrow(trimmed(run), "id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """id, n_tokens, ids_crc32 (long) and text of encoded rows."""
    shared = _shared(encoded.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            ids = [np.frombuffer(x.as_py(), "<u4") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([crc32(x) for x in ids], pa.int64()), pa.array([encoder.decode(x) for x in ids], pa.string())],
                names=["id", "n_tokens", "ids_crc32", "text"],
            )

    return encoded.select("id", "n_tokens", "ids").mapInArrow(trimmed(run), "id long, n_tokens long, ids_crc32 long, text string")
