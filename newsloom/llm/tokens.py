"""Whole texts to token ids, as the tokenizers library encodes them."""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import trimmed, worker_held


def tokenizer_json(path: str) -> str:
    """The tokenizer file's contents: read once on the driver, then sent to the executors."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _splits_at_space(definition: str) -> bool:
    """Whether no token of this tokenizer reaches over ASCII white space, so that words can be encoded by themselves.

    True where white space becomes a space and a removing split keeps only matches that hold none.
    """
    d = json.loads(definition)
    normalizers = (d.get("normalizer") or {}).get("normalizers", [])
    splits = (d.get("pre_tokenizer") or {}).get("pretokenizers", [])
    own = {"NFC", "Replace", "Lowercase"}
    return (
        bool(normalizers)
        and {n["type"] for n in normalizers} <= own
        and any(n.get("pattern") == {"Regex": "\\s+"} and n.get("content") == " " for n in normalizers)
        and bool(splits)
        and splits[0].get("behavior") == "Removed"
        and splits[0].get("invert") is True
        and "[^\\s" in splits[0]["pattern"].get("Regex", "")
        and not any(any(c.isspace() for c in t["content"]) for t in d.get("added_tokens", []))
    )


#: A word of Latin letters, each of them one code point in any normal form.
_LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
#: Marks that may close such a word: none of them begins or ends a special token or a contraction.
_MARKS = "-!\"#$%&()*+,./:;=?@[\\]^_`{}~|"


class _Table:
    """Ids by key, as places in shared arrays."""

    def __init__(self):
        self.places: dict = {}
        self.ids = np.empty(0, np.uint32)
        self.sizes = self.starts = np.empty(0, np.int64)

    def add(self, keys: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(sizes) - sizes]
        self.sizes, self.ids = np.r_[self.sizes, sizes], np.r_[self.ids, ids]
        self.places.update(zip(keys, range(len(self.places), len(self.places) + len(keys)), strict=True))

    def at(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.places.__getitem__, keys), np.int64, len(keys))

    def gather(self, at: np.ndarray) -> np.ndarray:
        """The ids at all these places, one after another."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(total)]


class Encoder:
    """Encodes texts; letter words and runs of marks met before come from a table of bounded size.

    The distinct words between white space of a batch are encoded once. One of plain letters and
    closing marks is the ids of its letters (in lower case, which many words share, if the tokenizer
    lower-cases) and those of its marks; new letter words are encoded as one text and told apart by the model's end-of-word tokens.
    """

    def __init__(self, definition: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.by_word = _splits_at_space(definition)
        self.most = most
        self.folds = any(n["type"] == "Lowercase" for n in (json.loads(definition).get("normalizer") or {}).get("normalizers", []))
        model = json.loads(definition)["model"]
        suffix = model.get("end_of_word_suffix")
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool) if suffix and not model.get("unk_token") else None
        if self.ends is not None:
            self.ends[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
        self.parts = _Table()

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [], []
        for k in range(0, len(words), 32):  # the library's results are large: few of them at a time
            found = [e.ids for e in self.tokenizer.encode_batch(words[k : k + 32], add_special_tokens=False)]
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32))
            sizes += map(len, found)
        return np.concatenate(ids), np.array(sizes, np.int64)

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = [" ".join(words[k : k + 128]) for k in range(0, len(words), 128)]
        ids, _ = self._whole(joined)
        if ids.max(initial=0) < len(self.ends):
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(words) and last[-1] == len(ids) - 1:
                return ids, np.diff(np.r_[-1, last])
        return self._whole(words)

    def _places(self, words: pa.Array) -> np.ndarray:
        """Two places in the table for each word: its letters (or all of it) and its closing marks."""
        if len(self.parts.places) > self.most:
            self.parts = _Table()
        known = self.parts.places
        heads = pc.ascii_rtrim(words, characters=_MARKS)
        plain = pc.match_substring_regex(heads, _LETTERS) if self.ends is not None else pa.array(np.zeros(len(words), bool))
        shared = pc.if_else(plain, pc.utf8_lower(heads) if self.folds else heads, words).dictionary_encode()
        names, index = shared.dictionary.to_pylist(), shared.indices.to_numpy()
        letters = np.zeros(len(names), bool)
        plain = plain.to_numpy(zero_copy_only=False)
        letters[index[plain]] = True
        cut = pc.binary_length(words).to_numpy() - pc.binary_length(heads).to_numpy()
        ended = np.flatnonzero(plain & (cut > 0))
        tails = [w[-k:] for w, k in zip(words.take(pa.array(ended)).to_pylist(), cut[ended].tolist(), strict=True)]
        places = list(map(known.get, names))
        missing = [k for k, place in enumerate(places) if place is None]
        if new := [names[k] for k in missing if letters[k]]:
            self.parts.add(new, *self._letters(new))
        others = list({"", *tails, *(names[k] for k in missing if not letters[k])}.difference(known))
        if others:
            self.parts.add(others, *self._whole(others))
        for k in missing:
            places[k] = known[names[k]]
        at = np.full(2 * len(words), known[""], np.int64)
        at[::2] = np.array(places, np.int64)[index]
        at[1::2][ended] = self.parts.at(tails)
        return at

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """The ids of each text, without special tokens added."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not self.by_word:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
        cut = pc.ascii_split_whitespace(texts)
        words = cut.flatten().dictionary_encode()
        at = self._places(words.dictionary)
        own = self.parts.sizes[at]
        table = _Table()
        table.ids, table.sizes = self.parts.gather(at), own[::2] + own[1::2]
        table.starts = np.cumsum(table.sizes) - table.sizes
        index = words.indices.to_numpy().astype(np.int64)
        ids = table.gather(index)
        ends = np.r_[0, np.cumsum(table.sizes[index])]
        offsets = cut.offsets.to_numpy()
        edges = ends[offsets - offsets[0]]
        return [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def parts_of(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `most` bytes of text each, and a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // most
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(sizes) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def worker_encoder(definition: str) -> Encoder:
    """One encoder for each worker process and tokenizer: its tables outlive tasks and only save time."""
    return worker_held(f"tokens {hashlib.sha256(definition.encode()).hexdigest()}", lambda: Encoder(definition))


def crc32(ids: np.ndarray) -> int:
    """Of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def shared_definition(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(tokenizer_json(path))  # a vocabulary file: megabytes, whatever the corpus


def encode_documents(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (long), n_tokens (long) and ids (binary: little-endian, 16 bits if the vocabulary allows it, else 32), the end id last.

    A null text is encoded as an empty one. Rows are encoded one by one: repeated rows and null ids
    come through. Whole texts are encoded; a text is the least that a task holds.
    """
    shared = shared_definition(docs.sparkSession, tokenizer_path)
    width = id_width(shared.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value)
        for batch in batches:
            for part in parts_of(batch, 1):
                ids = [np.r_[x, np.uint32(end_id)].astype(width) for x in encoder.encode(part.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                    names=["id", "n_tokens", "ids"],
                )

    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"),
    ).mapInArrow(trimmed(run), "id long, n_tokens long, ids binary")


def id_width(definition: str) -> str:
    d = json.loads(definition)
    top = max([*d["model"]["vocab"].values(), *(t["id"] for t in d.get("added_tokens", []))])
    return "<u2" if top < 1 << 16 else "<u4"
