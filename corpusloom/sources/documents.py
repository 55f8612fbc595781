"""Document files with bounds, and landed feeds with a quarantine for what can't be read."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import feeds
from .feeds import text_gate

#: Bytes that a file may have, and characters of its text.
MOST_BYTES, LEAST_CHARS, MOST_CHARS = 20 << 20, 200, 250_000


#: Folders that written documents are dealt to.
FOLDERS = 256


def write_documents(docs: DataFrame, folder: str) -> None:
    """Each row of (doc_id, text) as a file below ``folder``, with a line end after the text; its path has ``/doc_id=`` and the number.

    Spark's writer makes a folder, a checksum file and a file for each document, and on a local file system starts a process for each of them to set
    permissions. So where the shared folder is one that tasks can open (``file:``), they write the files themselves, under names of their rows: a task that
    runs again writes the same ones again. In any other store Spark's writer does it, and tasks move their files as they end.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if not folder.startswith("file:"):
        rows.write.partitionBy("doc_id").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder)
        return
    top = re.sub("^file:/*", "/", folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, made = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            for number, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = f"{top}/{hash(number) % FOLDERS:03d}"
                if at not in made:
                    os.makedirs(at, exist_ok=True)
                    made.add(at)
                name = f"{at}/doc_id={number}.{part}-{n}"
                with open(f"{name}.part", "wb") as f:
                    f.write(text.encode() + b"\n")
                os.replace(f"{name}.part", f"{name}.txt")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    os.makedirs(top, exist_ok=True)
    rows.mapInArrow(run, "n bigint").agg(F.sum("n")).first()


#: Tasks that small files are gathered to, for each core: a scan alone makes one for a few of them, as each counts as megabytes.
TASKS_A_CORE = 16


def judged_documents(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES, least: int = LEAST_CHARS, most: int = MOST_CHARS, glob: str | None = None) -> DataFrame:
    """Text files (path, modified_at, n_bytes, text, n_text, content_sha256, reason); the reason is null for documents, a file that is none has one.

    The bound of bytes is a filter on the file's length that reaches the scan: larger files are never opened. Bytes that aren't
    UTF-8, and texts that ``text_gate`` refuses, are reasons too. Decoding stays in the JVM.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    null = lambda kind, c: F.lit(None).cast(kind).alias(c)
    at = F.col("modificationTime").alias("modified_at"), F.col("length").alias("n_bytes")
    large = files.where(F.col("length") > most_bytes).select("path", *at, null("string", "text"), null("int", "n_text"), null("string", "content_sha256"), F.lit("too_large").alias("reason"))
    opened = files.where(F.col("length") <= most_bytes).select("path", *at, F.col("content").cast("string").alias("text"))
    valid = F.is_valid_utf8("text")
    gated = text_gate(opened.withColumn("valid", valid).withColumn("text", F.when(F.col("valid"), F.col("text"))), least=least, most=most)
    reason = F.when(~F.col("valid"), "not_utf8").otherwise(F.col("reject_reason"))
    tasks = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    return gated.withColumn("reason", reason).select("path", "modified_at", "n_bytes", "text", "n_text", "content_sha256", "reason").coalesce(tasks).unionByName(large.coalesce(tasks))


def read_documents(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES, least: int = LEAST_CHARS, most: int = MOST_CHARS, glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Text files as documents (path, modified_at, text, n_text, content_sha256), and a row with the reason for each file that is none (path, n_bytes, reason).

    As ``judged_documents``, which opens each file once for both.
    """
    judged = judged_documents(spark, path, most_bytes, least, most, glob)
    return judged.where("reason IS NULL").select("path", "modified_at", "text", "n_text", "content_sha256"), judged.where("reason IS NOT NULL").select("path", "n_bytes", "reason")


def _checked(records: DataFrame, source: str, needed: dict[str, Column], convert: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Papers of the records that have what is needed, and (source, file, reason) of the others."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"no {name}")) for name, ok in needed.items()])
    judged = records.withColumn("__reason", reason)
    return convert(judged.where("__reason IS NULL").drop("__reason", "__file")), judged.where("__reason IS NOT NULL").select(F.lit(source).alias("source"), F.col("__file").alias("file"), F.col("__reason").alias("reason"))


def _json_feed(spark: SparkSession, path: str, source: str, field: str, ddl: str, needed: dict[str, Column], convert: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """A feed of JSON objects, one a line; a line that can't be parsed is one rejected record."""
    schema = f"{field} array<struct<{feeds._struct(ddl)}>>, broken string"
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file")).where(F.trim("value") != "")
    pages = lines.select("__file", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("p"))
    bad = pages.where(F.col("p.broken").isNotNull()).select(F.lit(source).alias("source"), F.col("__file").alias("file"), F.lit("not parsed").alias("reason"))
    papers, rejects = _checked(pages.where(F.col("p.broken").isNull()).select("__file", F.inline(f"p.{field}")), source, needed, convert)
    return papers, bad.unionByName(rejects)


def quarantine_openalex(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """As ``feeds.read_openalex``, with what it leaves out and why."""
    needed = {"id": F.trim("id") != "", "title": F.trim("title") != ""}
    return _json_feed(spark, path, "openalex", "results", feeds._WORK, needed, feeds.openalex_papers)


def quarantine_semantic_scholar(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    needed = {"id": F.trim("paperId") != "", "title": F.trim("title") != ""}
    return _json_feed(spark, path, "semantic_scholar", "data", feeds._S2, needed, feeds.semantic_scholar_papers)


def quarantine_arxiv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """As ``feeds.read_arxiv``; entries that aren't well formed, error entries and those without id or title are rejected.

    The files are cut after each entry and every entry is parsed for itself, so that a broken one takes no other with it.
    """
    pieces = spark.read.option("lineSep", "</entry>").text(path).select(F.col("_metadata.file_path").alias("__file"), F.regexp_extract("value", "(?s)(<entry[ >].*)$", 1).alias("raw")).where("raw <> ''")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}
    entries = pieces.select("__file", F.from_xml(F.concat("raw", F.lit("</entry>")), feeds._ENTRY + ", broken string", options).alias("e")).select("__file", "e.*")
    bad = entries.where(F.col("broken").isNotNull()).select(F.lit("arxiv").alias("source"), F.col("__file").alias("file"), F.lit("not parsed").alias("reason"))
    needed = {"id": F.trim("id") != "", "title": F.trim("title") != "", "entry but an error": F.trim("title") != "Error"}
    papers, rejects = _checked(entries.where(F.col("broken").isNull()).drop("broken"), "arxiv", needed, feeds.arxiv_papers)
    return papers, bad.unionByName(rejects)


def feed_report(landed: dict[str, tuple[DataFrame, DataFrame] | None]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All papers; all rejects; and for each expected feed its papers, its rejected records and a warning if it is missing or lost some."""
    papers, report = feeds.union_feeds({k: v[0] if v else None for k, v in landed.items()})
    rejects = None
    for found in landed.values():
        if found:
            rejects = found[1] if rejects is None else rejects.unionByName(found[1])
    counts = rejects.groupBy("source").agg(F.count("*").alias("rejected"))
    lost = F.concat(F.col("rejected").cast("string"), F.lit(" records of "), "source", F.lit(" could not be used."))
    joined = report.join(counts, "source", "left").withColumn("rejected", F.when(F.col("papers").isNotNull(), F.coalesce("rejected", F.lit(0))))
    return papers, rejects, joined.select("source", "papers", "rejected", F.coalesce("warning", F.when(F.col("rejected") > 0, lost)).alias("warning"))
