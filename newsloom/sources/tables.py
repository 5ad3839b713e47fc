"""Readers, writers, snapshots and the type map."""

from __future__ import annotations

import json
import re
import warnings
from urllib.parse import parse_qs, unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

DOCUMENT = "id string, title string, content string, category string, length int"
QUERY = "id string, text string, query_type string, expected_category string"
ANNOTATION = "query_id string, doc_id string, relevance int, notes string"
MODES = {"append": "append", "replace": "overwrite"}


def read_dataset(spark: SparkSession, source: str, cache: str | None = None) -> DataFrame:
    """Parquet from source; with a cache path, copied there once and read from there."""
    if cache is None:
        return spark.read.parquet(source)
    try:
        return spark.read.parquet(cache)
    except AnalysisException:
        spark.read.parquet(source).write.parquet(cache)
        return spark.read.parquet(cache)


def dataset_info(df: DataFrame) -> dict:
    return {"rows": df.count(), "columns": df.columns}


def sample(df: DataFrame, *, key: str, n: int = 10, seed: int = 0) -> DataFrame:
    """Exactly n rows, the same for the same seed."""
    from newsloom.operators.corpus import draw

    return df.orderBy(draw(F.col(key), seed), key).limit(n)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def read_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of one-object JSON files, by id."""
    return spark.read.schema(schema).option("multiLine", True).json(path).orderBy("id")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: str, *, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)


def read_jdbc(spark: SparkSession, url: str, query: str, *, column: str | None = None, bounds: tuple[int, int] = (0, 0), partitions: int = 8) -> DataFrame:
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q")
    if column:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def write_parquet(df: DataFrame, path: str, *, if_exists: str = "replace", by: list[str] | None = None) -> None:
    if if_exists not in MODES:
        raise ValueError(f"if_exists must be one of {sorted(MODES)}")
    df.write.mode(MODES[if_exists]).partitionBy(*(by or [])).parquet(path)


def write_bulk(df: DataFrame, path: str) -> None:
    """Tab-separated with \\N for null, as bulk loaders take it."""
    df.write.mode("overwrite").option("sep", "\t").option("nullValue", "\\N").option("emptyValue", "").csv(path)


def read_bulk(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("nullValue", "\\N").csv(path)


def write_lines(df: DataFrame, path: str, *, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def append_raw_replies(df: DataFrame, path: str) -> None:
    """Append-only log of raw replies; a failure is a warning, never the job's."""
    try:
        df.write.mode("append").partitionBy("task", "prompt_version").parquet(path)
    except Exception as e:  # noqa: BLE001
        warnings.warn(f"raw replies not logged: {e}", stacklevel=2)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log of raw replies; empty where none was written yet."""
    schema = "unique_id string, prompt_hash string, raw_response string, run int, task string, prompt_version string"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_stated(spark: SparkSession, path: str, *, cap: int | None = None) -> DataFrame:
    """A training set kept as Parquet; cap: its first rows only, as many as a streamed build asked for."""
    rows = spark.read.parquet(path)
    return rows if cap is None else rows.limit(cap)


def read_sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A curated sheet: CSV by Spark, a workbook by pandas on the driver (sheets are typed by hand and small)."""
    if path.lower().endswith((".xlsx", ".xls")):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path), schema)
    return read_csv(spark, path, schema)


def write_frames(frames: dict[str, DataFrame], path: str) -> None:
    """Each frame as CSV with a header, in a folder of its name."""
    for name, df in frames.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def write_report(rows: DataFrame, path: str, *, title: str, order: list) -> None:
    """A report's rows as CSV and JSON lines, and a text of them; rows are one for each model and fit the driver."""
    write_frames({"csv": rows}, path)
    write_lines(rows, f"{path}/json")
    lines = [title, "=" * len(title), *[" | ".join(f"{c}: {r[c]}" for c in rows.columns) for r in rows.orderBy(*order).limit(1000).collect()]]
    rows.sparkSession.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/txt")


def write_benchmark(runs: list[DataFrame], path: str, *, columns: list[str], about: dict) -> None:
    """All runs as one Parquet table (missing columns null), selected columns as CSV, and what the runs were as JSON."""
    whole = runs[0]
    for r in runs[1:]:
        whole = whole.unionByName(r, allowMissingColumns=True)
    whole.write.mode("overwrite").parquet(f"{path}/runs")
    write_frames({"selected": whole.select(*columns)}, path)
    spark = whole.sparkSession
    spark.createDataFrame([(json.dumps(about, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def create_indexes(name: str, columns: dict[str, str]) -> list[str]:
    """Index statements for a table's columns; kinds: btree, gin, trgm, vector."""
    how = {"btree": "{0}", "gin": "USING gin ({0})", "trgm": "USING gin ({0} gin_trgm_ops)", "vector": "USING ivfflat ({0} vector_cosine_ops)"}
    if not all(re.fullmatch(r"\w+", c) for c in (name, *columns)):
        raise ValueError("names have letters, digits and underscores")
    body = lambda c, k: f"({c})" if k == "btree" else how[k].format(c)
    return [f"CREATE INDEX IF NOT EXISTS {name}_{c}_{k} ON {name} {body(c, k)}" for c, k in columns.items()]


def write_index(documents: DataFrame, chunks: DataFrame, path: str) -> int:
    """Documents with their chunks as one version: readers see both or neither.

    Chunks without a document are refused. The version counts once its marker is there.
    """
    lost = chunks.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti")
    if lost.limit(1).count():
        raise ValueError("chunks without a document")
    state = Snapshots(documents.sparkSession, path)
    version = (state.versions() or [0])[-1] + 1
    documents.write.mode("overwrite").parquet(f"{path}/v={version}/documents")
    chunks.write.mode("overwrite").parquet(f"{path}/v={version}/chunks")
    fs, _ = state._fs()
    fs.create(documents.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/v={version}/_SUCCESS"), True).close()
    return version


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """Documents and chunks of the last whole version."""
    found = Snapshots(spark, path).versions()
    return None if not found else (spark.read.parquet(f"{path}/v={found[-1]}/documents"), spark.read.parquet(f"{path}/v={found[-1]}/chunks"))


def credentials(uri: str, *, region: str = "us-east-1") -> tuple[str | None, str | None, str]:
    """User, password and region of a connection URI like scheme://user:password@/?region_name=x; percent escapes are read."""
    parsed = urlparse(uri)
    part = lambda x: unquote(x) if x else None
    return part(parsed.username), part(parsed.password), parse_qs(parsed.query).get("region_name", [region])[0]


def sql_type(kind: T.DataType) -> str:
    """Column type of the relational export; unknown kinds are text."""
    table = {
        T.StringType: "TEXT", T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.DoubleType: "DOUBLE PRECISION", T.FloatType: "REAL",
        T.BooleanType: "BOOLEAN", T.DateType: "DATE", T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP",
    }
    if isinstance(kind, T.ArrayType):
        return "TEXT[]"
    return table.get(type(kind), "TEXT")


def create_table(name: str, schema: T.StructType, *, key: str = "unique_id") -> str:
    if not re.fullmatch(r"\w+", name):
        raise ValueError("a table name has letters, digits and underscores")
    columns = [f"{f.name} {sql_type(f.dataType)}" + (" PRIMARY KEY" if f.name == key else "") for f in schema.fields]
    return f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(columns)})"


def apply_updates(base: DataFrame, updates: DataFrame, *, key: str, columns: list[str]) -> DataFrame:
    """A new snapshot with the columns of updates where they are not null."""
    new = updates.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    joined = base.join(new, key, "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


class Snapshots:
    """Versions of a state table under one folder; readers see the last that was written whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs()
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        whole = [n for n in names if n.startswith("v=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[2:]) for n in whole)

    def read(self) -> DataFrame | None:
        found = self.versions()
        return self.spark.read.parquet(f"{self.path}/v={found[-1]}") if found else None

    def write(self, df: DataFrame) -> int:
        version = (self.versions() or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        return version
