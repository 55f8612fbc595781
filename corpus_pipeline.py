"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept
and returns the columns of documents, but for the last, which returns pieces of
packed sequences. ``docs`` has to be a stored table, so what a stage returns is
written before the next one reads it.

In every stage a null text counts as empty; empty and null texts are equal to each other, have no shingles
and no benchmark words, and pack as the end id alone. A null doc_id counts as the largest; ties go to the
row scanned first; repeated rows are judged each, as copies of each other. Very long texts are read whole.
Empty tables give no rows. Further columns go along, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, exact_dedup, jaccard_join, packing, quality
from corpusloom.llm.queries import table, tokenizer_path
from corpusloom.operators.components import shared_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; without labels none does."""
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the smallest doc_id. Texts without words are classes of their own."""
    return jaccard_join.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; an empty benchmark leaves all."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenized and packed."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("best-fit packing", pack),
]

#: A fitted classifier and a tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
