"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.sources.scratch import discard, materialise, scratch_path

__all__ = ["ASCII_SPACE", "LOWER", "UPPER", "discard", "map_arrow", "materialise", "read_table", "scratch_path", "trimmed", "without", "worker_free", "worker_held"]

ASCII_SPACE = " \t\n\u000b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def without(df: DataFrame, names) -> list[Column]:
    """The columns of df but those whose names (in any case) are about to be computed."""
    taken = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """mapInArrow for columns of any name: run sees and yields columns called c0, c1, ..."""
    numbered = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(schema.fields)])
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(trimmed(run), numbered).toDF(*schema.names)


def worker_held(name: str, make):
    """make()'s result, kept for later tasks of the same worker process.

    Functions of this package reach the workers by value, each time with globals of their own, so what
    is to outlive a task lies in a module that is registered in the process itself.
    """
    held = sys.modules.setdefault("_worker_held", types.ModuleType("_worker_held")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def worker_free() -> None:
    """Drop what worker_held() keeps in this process: for steps that come after those that need it."""
    sys.modules.pop("_worker_held", None)


def trimmed(run):
    """run for mapInArrow, after which the worker hands free memory back: workers wait for their next task beside others that work."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return each
