"""Written documents are one file each, read once."""

import os

from pyspark.sql import functions as F

from corpusloom.sources import documents


def test_one_file_each_and_nothing_else(spark, tmp_path):
    """Before, each document had a folder and a checksum file beside its file, made by a process each."""
    rows = [(i, f"text {i} " * 40) for i in range(50)] + [(7, "the same number " * 30), (-3, "ü" * 300), (90, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for _ in range(2):  # a task that runs again writes the same files
        documents.write_documents(docs.coalesce(1).sortWithinPartitions("doc_id", "text"), f"file:{tmp_path}/in")
    files = [f for _, _, fs in os.walk(tmp_path / "in") for f in fs]
    assert len(files) == len(rows) and all(f.endswith(".txt") for f in files) and len(os.listdir(tmp_path / "in")) <= documents.FOLDERS
    judged = documents.judged_documents(spark, f"file:{tmp_path}/in", glob="*.txt")
    assert judged.rdd.getNumPartitions() <= 2 * documents.TASKS_A_CORE * spark.sparkContext.defaultParallelism
    number = F.regexp_extract("path", r"/doc_id=(-?\d+)[./]", 1).cast("long")
    got = sorted((r[0], r[1] or "") for r in judged.select(number, F.coalesce("text", F.lit(""))).collect())
    assert got == sorted((n, (t or "") + "\n") for n, t in rows)
    assert [r.reason for r in judged.where("reason IS NOT NULL").collect()] == ["too_little_text"]
    good, bad = documents.read_documents(spark, f"file:{tmp_path}/in", glob="*.txt")
    assert (good.count(), bad.count()) == (52, 1)


def test_other_stores_are_written_by_spark(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * 40) for i in range(4)], "doc_id bigint, text string")
    documents.write_documents(docs, str(tmp_path / "in"))
    assert sorted(os.listdir(tmp_path / "in"))[-4:] == [f"doc_id={i}" for i in range(4)]
    assert documents.judged_documents(spark, str(tmp_path / "in"), glob="*.txt").where("reason IS NULL").count() == 4
