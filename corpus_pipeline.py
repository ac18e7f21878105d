"""The corpus pipeline: STAGES in order, each over what its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

1. toxicity: documents that score at or above the threshold go; the model learns from labels.
2. exact dedup: of equal texts (white space aside) the longest original stays.
3. near dedup: shingles of five words, similarity of 0.8 or more; the smallest id of a group stays.
4. decontamination: documents that hold a benchmark item go.
5. packing: what remains, in sequences of 2048 tokens.

Null texts count as empty; empty tables pass through. Of copies one row stays, whatever the ids: where ids are
missing or repeated, rows are numbered in the order of their ids (missing ones last), then texts.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontamination, exact_dedup, minhash, packing, toxicity
from textloom.llm.common import keep, read
from textloom.llm.encoding import tokenizer_path


def _one_of_each(docs: DataFrame, judge: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """docs less the rows that a judgement (doc_id, kept), made by row number, drops."""
    row = "row"
    while row in docs.columns:
        row += "_"
    unclear = docs.groupBy("doc_id").agg(F.count("*").alias("rows_of_id")).filter("rows_of_id > 1 OR doc_id IS NULL")
    if unclear.limit(1).count():
        numbered = keep(docs.orderBy(F.asc_nulls_last("doc_id"), "text").withColumn(row, F.monotonically_increasing_id()), "numbered")
    else:
        numbered = docs.withColumn(row, F.col("doc_id"))
    dropped = judge(numbered, row).filter("NOT kept").select(F.col("doc_id").alias(row))
    return numbered.join(dropped, row, "left_anti").select(docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _one_of_each(docs, lambda rows, row: exact_dedup.exact_groups(rows, id_col=row))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _one_of_each(docs, lambda rows, row: minhash.near_groups(rows, size=5, id_col=row))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", toxic), ("exact dedup", exact), ("near dedup", near), ("decontamination", leaks), ("packing", pack)]
#: Learnt scores and tokenizer ids have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
