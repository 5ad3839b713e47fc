"""Quality rules: every rule is judged once, its failures kept as bits; policies come afterwards."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, without

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_exclaims")

#: Name and failing condition over the measures; a rule's place is its bit. Only append to this list.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "5 * n_dup_lines > 2 * n_lines"),
    ("shouting", "n_upper > 2 * n_lower and n_upper > 100"),
    ("exclaims", "2 * n_exclaims > n_words"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A document is rejected if it fails one of the rules named."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [n for n, _ in RULES]
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = {p.version: p for p in (BASE, Policy("v1", tuple(n for n, _ in RULES)))}

_SPACE = np.array([0x20, *range(0x09, 0x0E)])
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of one text, in the order of MEASURES; a null text measures as an empty one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at ASCII white space only
    n = len(words)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    repeats = 0
    if n > 2:
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        if len(windows) < n - 2:
            at = np.fromiter((windows[w] > 1 for w in zip(words, words[1:], words[2:], strict=False)), bool, n - 2)
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= at
            repeats = int(covered.sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        n, int(len(data) - seen[0x80:0xC0].sum() - seen[_SPACE].sum()), int(seen[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeats,
        len(lines), int(seen[65:91].sum()), int(seen[97:123].sum()), int(seen[33]),
    )


def quality_ledger(docs: DataFrame, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ledger: the carried columns (all by default), the measures (long) and failures (long, a bit for each of RULES).

    Whole texts are measured, batch by batch, without a shuffle. Null and empty texts have no words.
    Carried columns that are called like a measure or "failures" are replaced. Rows are judged one by
    one: repeated rows and null ids need no rule. No rows in, no rows out.
    """
    carry = docs.columns if carry is None else carry
    kept = without(docs.select(*[F.col(f"`{c}`") for c in carry]), [*MEASURES, "failures"])
    packed = docs.select(*kept, F.col(f"`{text_col}`").alias("\u0001text"))
    schema = T.StructType([*packed.schema.fields[:-1], *[T.StructField(m, T.LongType()) for m in MEASURES]])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([measure(x.as_py()) for x in batch.column(batch.num_columns - 1)], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *[pa.array(found[:, k]) for k in range(len(MEASURES))]], names=[f"c{k}" for k in range(len(schema))]
            )

    ledger = map_arrow(packed, judge, schema)
    bits = [F.expr(f"if({rule}, {1 << k}L, 0L)") for k, (_, rule) in enumerate(RULES)]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return ledger.withColumn("failures", failures)


def verdict(policy: Policy):
    """True where a ledger's row passes the policy."""
    return F.col("failures").bitwiseAND(F.lit(policy.mask)) == 0


def ablations(ledger: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: rows that fail it, rows that only it rejects, rows rejected without it.

    Counts come from one aggregation by the masked bits (2 to the number of rules rows at most).
    """
    masks = ledger.groupBy(F.col("failures").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    names = [n for n, _ in RULES]
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in policy.rules]))
    each = masks.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    part = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).alias
    return each.groupBy("rule").agg(
        part(F.col("bits").bitwiseAND(F.col("bit")) != 0)("n_failed"),
        part(F.col("bits") == F.col("bit"))("n_only"),
        part(F.col("bits").bitwiseAND(F.bitwise_not("bit")) != 0)("n_rejected_without"),
    )
