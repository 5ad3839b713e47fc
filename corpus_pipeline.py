"""The corpus pipeline: quality rules, line dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents; n_chars follows
the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm import line_dedup, near_texts, packing, quality_rules, substring_dedup
from newsloom.llm.common import discard, materialise
from newsloom.llm.queries import word_tokenizer

#: SQL cannot express fingerprints, tokens or packing; the tests hold each stage against brute force.
ORACLE_SQL = None


#: All other columns of a row in one, so that no name of theirs can clash with what a stage computes.
REST = "\u0001rest"


def _packed(docs: DataFrame) -> DataFrame:
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias(REST)).alias(REST))


def _same(rows: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """Packed rows with the columns of docs again, but for those changed."""
    column = {c: F.col(REST)[c] for c in docs.columns} | {"doc_id": F.col("doc_id"), "text": F.col("text")} | changed
    return rows.select(*[column[c].alias(c) for c in docs.columns])


def _measured(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """_same() where n_chars, if there is one, follows the text."""
    return _same(rows, docs, n_chars=F.length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules of policy v1; null texts have no words and fail."""
    ledger = quality_rules.quality_ledger(_packed(docs), carry=["doc_id", "text", REST])
    return _same(ledger.filter(quality_rules.verdict(quality_rules.POLICIES["v1"])), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 code points found in 5 documents stay in one of them; null texts become empty."""
    return _measured(line_dedup.line_dedup(_packed(docs), min_chars=40, min_docs=5), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked by 0.8 of their five-word shingles; rows without id stay.

    It is the row of the smallest id; of several with that id in the group, that of the smallest text
    hash, then of the smallest other columns. Rows of one id whose texts are in different groups stay
    apart.
    """
    found = near_texts.near_duplicates(docs.select("doc_id", "text"), shingle=5, least=0.8).filter("id is not null")
    kept = found.groupBy("root").agg(F.min(F.struct("id", "v")).alias("s")).select(F.col("s.id").alias("doc_id"), F.col("s.v").alias("v"))
    rows = _packed(docs).withColumn("v", near_texts.text_hash(F.col("text")))
    order = Window.partitionBy("doc_id", "v").orderBy(REST)
    first = rows.filter("doc_id is not null").join(kept, ["doc_id", "v"], "left_semi").withColumn("r", F.row_number().over(order)).filter("r = 1")
    return _same(first.select("doc_id", "text", REST).unionByName(rows.filter("doc_id is null").select("doc_id", "text", REST)), docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 20-word windows that start earlier in the corpus go; the rest of the layout stays. Null ids come first; null texts become empty."""
    return _measured(substring_dedup.substring_dedup(_packed(docs), window=20, layout="text"), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 4096 tokens; every row is packed, whatever its id."""
    return packing.pack(docs, word_tokenizer(), capacity=4096, end_id=1).withColumnRenamed("id", "doc_id")


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near_copies), ("substring dedup", passages), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written to the shared folder and read again; what a stage has read goes once its result is there."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{k}")
            if last is not None:
                discard(last)
            last = docs
    return docs
