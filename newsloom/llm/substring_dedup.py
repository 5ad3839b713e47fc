"""Substring dedup: repeated windows of words are removed after their first place in the corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialise, trimmed, without

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Words of a segment at most; longer texts are cut into segments that overlap by a window less a word.
SEGMENT = 1 << 20
PLACE_BITS = 21


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """128 hash bits of each word seen, as a place in an array that doubles as it fills."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most, self.codes, self.fresh = most, np.empty((1 << 16, 2), np.uint64), []

    def __missing__(self, word: bytes) -> int:
        self.fresh.append(xxhash.xxh3_128_digest(word))
        self[word] = at = len(self)
        return at

    def hashes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > self.most:
            self.clear()
        old = len(self)
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            while len(self) > len(self.codes):
                self.codes = np.concatenate([self.codes, np.empty_like(self.codes)])
            self.codes[old : len(self)] = np.frombuffer(b"".join(self.fresh), np.uint64).reshape(-1, 2)
            self.fresh = []
        return self.codes[at, 0], self.codes[at, 1]


class Spans:
    """Hashes of any span of a run of words: sums of word hash times odd power, scaled back to the span's start."""

    powers = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * 2

    def __init__(self, hashes: tuple[np.ndarray, np.ndarray]):
        n = len(hashes[0])
        if len(Spans.powers[0][0]) <= n:
            up = lambda b, m: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m, b, np.uint64))])
            Spans.powers = [(up(b, n + 1000), up(pow(b, -1, 1 << 64), n + 1000)) for b in _ODD]
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p[0][:n])]) for h, p in zip(hashes, Spans.powers, strict=True)]

    def hash(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        s = self.sums[which]
        return _mix((s[end] - s[start]) * Spans.powers[which][1][start])


def pieces(words: Spans, owner: np.ndarray, window: int, core: int) -> tuple[np.ndarray, ...]:
    """Super-k-mers: maximal runs of consecutive windows whose smallest core (a shorter k-mer) is at one place.

    owner: the segment of each word, in runs. Returns start word, number of windows, hash of the core
    and hash of the covered words. Which core is smallest depends on a window's words alone, so equal
    windows fall into pieces of equal core; within a piece no window occurs twice.
    """
    n = len(owner)
    if n < window:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    at = np.arange(n - core + 1)
    cores = words.hash(0, at, at + core)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least, width, span = (cores & ~low) | at.astype(np.uint64), 1, window - core + 1
    while width < span:
        step = min(width, span - width)
        least, width = np.minimum(least[: len(least) - step], least[step:]), width + step
    place = (least & low).astype(np.int64)
    inside = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
    if not len(inside):
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    p = place[inside]
    heads = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (inside[1:] != inside[:-1] + 1)])
    start, size = inside[heads], np.diff(np.r_[heads, len(inside)])
    return start, size, cores[p[heads]], words.hash(1, start, start + size + window - 1)


def _chunks(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[tuple[list[int], list[int], list[str | None], list]]:
    """Rows of (key, mark, text, any more column) in chunks of about most_bytes of text."""
    for batch in batches:
        held, size = [], 0
        more = batch.column(3) if batch.num_columns > 3 else [None] * batch.num_rows
        for k, m, t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), more, strict=True):
            text = (t.as_py() or "").encode("utf-8", "surrogatepass")
            held.append((k, m, text, x))
            size += len(text)
            if size >= most_bytes:
                yield held
                held, size = [], 0
        if held:
            yield held


#: A row that is gone holds the key of its first place in body, and that place's mark and word in first.
_PIECES = "core long, kind byte, body long, key long, mark int, pos int, n int, first long"
_SPANS = "kind byte, key long, mark int, pos int, n int, fkey long, fmark int, fpos int"
_COLUMNS = {schema: [part.split() for part in schema.split(", ")] for schema in (_PIECES, _SPANS)}
PIECE, GONE, BRANCH = 0, 1, 2


def _fold(mark: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A place's mark and word as one number."""
    return (mark.astype(np.int64) << 32) | pos.astype(np.int64)


def _batch(schema: str, size: int, **cols: np.ndarray) -> pa.RecordBatch:
    """Rows of a schema; columns that are not given hold zeros, single numbers are repeated."""
    kinds = {"long": np.int64, "int": np.int32, "byte": np.int8}
    out = []
    for name, kind in _COLUMNS[schema]:
        x = cols.get(name, 0)
        x = x.view(np.int64) if isinstance(x, np.ndarray) and x.dtype == np.uint64 else x
        out.append(pa.array(np.broadcast_to(x, size).astype(kinds[kind])))
    return pa.RecordBatch.from_arrays(out, names=[name for name, _ in _COLUMNS[schema]])


def _cut(window: int, core: int, chunk_bytes: int):
    """Texts to pieces; of pieces that are equal within a chunk only the first goes on, the others are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for chunk in _chunks(batches, chunk_bytes):
            found = []
            words, owner, keys, marks, base = [], [], [], [], []

            def flush():
                if words:
                    own = np.repeat(np.arange(len(owner)), owner)
                    start, size, cores, body = pieces(Spans(known.hashes(words)), own, window, core)
                    who = own[start]
                    begin = np.cumsum([0, *owner[:-1]])
                    found.append((
                        cores, body, np.array(keys, np.int64)[who], np.array(marks, np.int32)[who],
                        start - begin[who] + np.array(base, np.int64)[who], size,
                    ))
                for x in (words, owner, keys, marks, base):
                    x.clear()

            for key, mark, text, _ in chunk:
                own = text.split()
                for at in range(0, max(0, len(own) - window + 1), SEGMENT - window + 1):
                    part = own[at : at + SEGMENT]
                    if len(words) + len(part) > SEGMENT:
                        flush()
                    words += part
                    owner.append(len(part))
                    keys.append(key), marks.append(mark), base.append(at)
            flush()
            if not found:
                continue
            cores, body, key, mark, pos, n = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((pos, mark, key, body, cores))
            cores, body, key, mark, pos, n = (x[order] for x in (cores, body, key, mark, pos, n))
            same = np.r_[False, (cores[1:] == cores[:-1]) & (body[1:] == body[:-1])]
            heads = np.flatnonzero(~same)[np.cumsum(~same) - 1]
            later = same & ((key != key[heads]) | (mark != mark[heads]) | (pos != pos[heads]))
            stay = ~same
            yield _batch(_PIECES, int(stay.sum()), core=cores[stay], body=body[stay], key=key[stay], mark=mark[stay], pos=pos[stay], n=n[stay])
            if later.any():
                fkey, fmark, fpos = (x[heads][later] for x in (key, mark, pos))
                key, mark, pos, n = (x[later] for x in (key, mark, pos, n))
                order = np.lexsort((pos, mark, key))
                key, mark, pos, n, fkey, fmark, fpos = (x[order] for x in (key, mark, pos, n, fkey, fmark, fpos))
                goes_on = (key[1:] == key[:-1]) & (mark[1:] == mark[:-1]) & (pos[1:] == pos[:-1] + n[:-1])
                goes_on &= (fkey[1:] == fkey[:-1]) & (fmark[1:] == fmark[:-1]) & (fpos[1:] == fpos[:-1] + n[:-1])
                heads = np.flatnonzero(np.r_[True, ~goes_on])
                n = np.add.reduceat(n, heads)
                key, mark, pos, fkey, fmark, fpos = (x[heads] for x in (key, mark, pos, fkey, fmark, fpos))
                spread = _mix(key.astype(np.uint64) * np.uint64(_ODD[0]) + pos.astype(np.uint64))
                yield _batch(_PIECES, len(n), core=spread, kind=GONE, body=fkey, key=key, mark=mark, pos=pos, n=n, first=_fold(fmark, fpos))

    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by core, kind, body and place: repeats are gone; firsts go on if their core has several bodies.

    What is held between batches is one row: the last body's first place, and a core's first piece
    for as long as no second body of that core has come.
    """
    last = None  # core, body, key, mark, pos of the last body's first piece
    waiting = None  # the first piece of the last core, not sent yet
    for batch in batches:
        core, kind, body, key, mark, pos, n, place = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        done = kind == GONE
        if done.any():
            at = place[done]
            yield _batch(
                _SPANS, len(at), kind=GONE, key=key[done], mark=mark[done], pos=pos[done], n=n[done], fkey=body[done], fmark=at >> 32,
                fpos=at & 0xFFFFFFFF,
            )
        core, body, key, mark, pos, n = (x[~done] for x in (core, body, key, mark, pos, n))
        if not len(core):
            continue
        if last is not None:
            core, body, key, mark, pos, n = (np.r_[np.array([v], x.dtype), x] for v, x in zip((*last, 0), (core, body, key, mark, pos, n), strict=True))
        same_core = np.r_[False, core[1:] == core[:-1]]
        same_body = same_core & np.r_[False, body[1:] == body[:-1]]
        heads = np.flatnonzero(~same_body)[np.cumsum(~same_body) - 1]
        gone = same_body & ((key != key[heads]) | (mark != mark[heads]) | (pos != pos[heads]))
        firsts = np.flatnonzero(~same_body)
        branch = np.zeros(len(core), bool)
        more = same_core[firsts]  # another body of the same core came just before
        branch[firsts[more]] = True
        branch[firsts[:-1][more[1:] & ~more[:-1]]] = True
        send = []
        if last is not None:
            if waiting is not None and branch[0]:
                send.append(waiting)
            if branch[0] or (len(firsts) > 1 and not more[1]):
                waiting = None
            branch[0] = False
        end = firsts[-1]
        if not same_core[end] and end + (last is None) > 0:
            waiting = (key[end], mark[end], pos[end], n[end])
        elif same_core[end]:
            waiting = None
        out = np.flatnonzero(branch)
        if send:
            yield _batch(_SPANS, 1, kind=BRANCH, **dict(zip(("key", "mark", "pos", "n"), send[0], strict=True)))
        if len(out):
            yield _batch(_SPANS, len(out), kind=BRANCH, key=key[out], mark=mark[out], pos=pos[out], n=n[out])
        if gone.any():
            first = heads[gone]
            yield _batch(
                _SPANS, len(first), kind=GONE, key=key[gone], mark=mark[gone], pos=pos[gone], n=n[gone], fkey=key[first], fmark=mark[first],
                fpos=pos[first],
            )
        last = (core[end], body[end], key[end], mark[end], pos[end])


_EDGES = "h1 long, h2 long, key long, mark int, pos int"


def _edges(window: int):
    """The windows of branching pieces, by 128 hash bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for chunk in _chunks(batches, 1 << 21):
            words, starts, keys, marks, places = [], [], [], [], []
            for key, mark, text, spans in chunk:
                own = text.split()
                at = np.unique(np.concatenate([np.arange(s["pos"], s["pos"] + s["n"]) for s in spans.as_py()]))
                at = at[at + window <= len(own)]
                starts.append(at + len(words))
                keys.append(np.full(len(at), key, np.int64))
                marks.append(np.full(len(at), mark, np.int32))
                places.append(at.astype(np.int32))
                words += own
            sums, at = Spans(known.hashes(words)), np.concatenate(starts)
            h1, h2 = (sums.hash(k, at, at + window).view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1), pa.array(h2), *(pa.array(np.concatenate(x)) for x in (keys, marks, places))], names=["h1", "h2", "key", "mark", "pos"]
            )

    return run


def compacted(spans: DataFrame) -> DataFrame:
    """Repeated paths that go on in both places become one: spans (key, mark, pos, n, fkey, fmark, fpos) of rising length.

    A span is followed by another if that begins where it ends, here and at the first place. Joins
    find the spans that follow none and those that none follows; on one pair of texts at one distance
    the k-th beginning belongs to the k-th end.
    """
    line = ["key", "mark", "fkey", "fmark", "far"]
    each = spans.select("key", "mark", "fkey", "fmark", (F.col("fpos") - F.col("pos")).alias("far"), "pos", (F.col("pos") + F.col("n")).alias("end"))
    each = materialise(each, "repeated-spans")
    order = lambda c: F.row_number().over(Window.partitionBy(*line).orderBy(c)).alias("k")
    # distinct on the join's own keys: spans of repeated rows meet there without another shuffle
    starts = each.select(*line, "pos").join(
        each.select(*line, F.col("end").alias("pos")), [*line, "pos"], "left_anti",
    ).distinct().select(*line, "pos", order("pos"))
    ends = each.select(*line, "end").join(
        each.select(*line, F.col("pos").alias("end")), [*line, "end"], "left_anti",
    ).distinct().select(*line, "end", order("end"))
    whole = starts.join(ends, [*line, "k"])
    return whole.select("key", "mark", "pos", (F.col("end") - F.col("pos")).alias("n"), "fkey", "fmark", (F.col("far") + F.col("pos")).alias("fpos"))


def _digest(words: list[bytes], pos: int, n: int, window: int) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words[pos : pos + n + window - 1]))


def _first_words(window: int):
    """The words at first places: a digest of each span asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, marks, places, sizes, found = [], [], [], [], []
            for key, mark, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                for s in spans.as_py():
                    keys.append(key), marks.append(mark), places.append(s["pos"]), sizes.append(s["n"])
                    found.append(_digest(words, s["pos"], s["n"], window))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()), *(pa.array(x, pa.int32()) for x in (marks, places, sizes)), pa.array(found, pa.binary())
                ], names=["fkey", "fmark", "fpos", "n", "words"]
            )

    return run


def _keep(text: bytes, spans: list[dict], window: int, layout: str) -> tuple[str, int, int]:
    """A text without the words of its spans, its number of words, and of words removed; spans whose words are not those of their first place stay."""
    words = text.split()
    change = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        if _digest(words, s["pos"], s["n"], window) == s["words"]:
            change[s["pos"]] += 1
            change[s["pos"] + s["n"] + window - 1] -= 1
    gone = np.cumsum(change[:-1]) > 0
    if layout == "words":
        kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
    elif not gone.any():
        kept = text
    else:
        ends = [0, *(m.end() for m in _WORD.finditer(text))]
        kept = b"".join([text[a:b] for a, b, g in zip(ends[:-1], ends[1:], gone.tolist(), strict=True) if not g])
    return kept.decode("utf-8", "surrogatepass"), len(words), int(gone.sum())


def substring_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20, core: int = 8, layout: str = "words",
    chunk_bytes: int = 2 << 20,
) -> DataFrame:
    """Remove each word covered by a window of words that also starts earlier in the corpus.

    Windows are the edges of a De Bruijn graph over the words of all texts. Each text is cut into
    super-k-mers, runs of windows around one smallest shorter k-mer (the core): nonbranching paths,
    known by hash. One shuffle by core finds equal paths, of which all but the first place are gone
    as a whole, and paths that share a core but differ, where the graph may branch. Only the first
    places of those are taken apart into single edges, whose first places a second aggregation and
    join give. Repeated paths and edges that go on in both places are compacted by joins into spans
    of source coordinates. The words at each span's first place are looked up there; a span goes only
    if its own words are the same (128 bits of their digest, computed from the words at the
    coordinates and independent of the hashes that found the span). Equal paths of a chunk of text
    are merged before the shuffle, and a core of any number of paths is resolved as a sorted stream
    that holds one row. A collision of hashes can hide a repeat; it cannot remove a word.

    Judged is the input, not what is left of it.

    Returns the columns of docs with the text replaced, and n_words and n_removed (long). layout
    "words" joins the kept words by one space; "text" cuts removed words and the space before them.

    Words lie between ASCII white space (space, \\t to \\r); null texts have none. Ids are whole
    numbers; a null id comes before all. Rows of one id and different texts are ordered by the
    text's CRC-32; rows equal in id and text are one place, so neither removes the other. Input
    columns called n_words or n_removed are replaced. No rows in, no rows out.
    """
    if not 0 < core <= window < SEGMENT:
        raise ValueError("core must be at most window")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63)))
    mark = (F.crc32(text.cast("binary")) - (1 << 31)).cast("int")
    lean = docs.select(key.alias("key"), mark.alias("mark"), text.alias("text"))

    cut = lean.mapInArrow(trimmed(_cut(window, core, chunk_bytes)), _PIECES)
    order = ["core", "kind", "body", "key", "mark", "pos"]
    spans = materialise(cut.repartition("core").sortWithinPartitions(*order).mapInArrow(trimmed(_resolve), _SPANS), "repeated-paths")

    fork = spans.filter(F.col("kind") == BRANCH).groupBy("key", "mark").agg(F.collect_list(F.struct("pos", "n")).alias("spans"))
    edges = materialise(
        lean.join(fork, ["key", "mark"]).select("key", "mark", "text", "spans").mapInArrow(trimmed(_edges(window)), _EDGES).distinct(),
        "branching-edges",
    )
    first = edges.groupBy("h1", "h2").agg(F.min(F.struct("key", "mark", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    first = materialise(first, "first-edges")  # a join of two plain exchanges, which Spark can split where an edge is frequent
    again = edges.join(first, ["h1", "h2"]).filter(F.struct("key", "mark", "pos") != F.col("first"))
    again = again.select(
        "key", "mark", "pos", F.lit(1).alias("n"), F.col("first.key").alias("fkey"), F.col("first.mark").alias("fmark"),
        F.col("first.pos").alias("fpos"),
    )

    paths = spans.filter(F.col("kind") == GONE).select(*again.columns)
    gone = materialise(compacted(paths.unionByName(again)), "repeated-spans")
    asked = gone.select(
        "fkey", "fmark", F.struct(F.col("fpos").alias("pos"), "n").alias("s"),
    ).distinct().groupBy("fkey", "fmark").agg(F.collect_list("s").alias("spans"))
    at_first = lean.join(asked.withColumnsRenamed({"fkey": "key", "fmark": "mark"}), ["key", "mark"]).select("key", "mark", "text", "spans")
    words = at_first.mapInArrow(trimmed(_first_words(window)), "fkey long, fmark int, fpos int, n int, words binary")
    words = materialise(words.dropDuplicates(["fkey", "fmark", "fpos", "n"]), "first-words")
    gone = gone.join(words, ["fkey", "fmark", "fpos", "n"])
    gone = gone.groupBy("key", "mark").agg(F.collect_list(F.struct("pos", "n", "words")).alias("\u0001spans")).withColumnsRenamed({"key": "key\u0002", "mark": "mark\u0002"})
    rows = docs.select(*without(docs, ["n_words", "n_removed"]), key.alias("key\u0001"), mark.alias("mark\u0001"))
    names = rows.columns[:-2]
    rows = rows.join(
        gone, (rows["key\u0001"] == gone["key\u0002"]) & (rows["mark\u0001"] == gone["mark\u0002"]), "left",
    ).select(*[F.col(f"`{c}`") for c in names], "\u0001spans")
    place = names.index(text_col)
    schema = T.StructType([
        *[T.StructField(text_col, T.StringType()) if f.name == text_col else f for f in rows.schema.fields[:-1]],
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                _keep((t.as_py() or "").encode("utf-8", "surrogatepass"), s.as_py() or [], window, layout) for t,
                s in zip(batch.column(place), batch.column(batch.num_columns - 1), strict=True)
            ]
            columns = list(batch.columns[:-1])
            columns[place] = pa.array([x[0] for x in out], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())],
                names=[f"c{k}" for k in range(len(schema))]
            )

    return map_arrow(rows, run, schema)
