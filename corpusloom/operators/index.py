"""A stored token index for lexical search, kept up by new and changed papers only."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from . import scoring
from .components import cut_lineage
from .search import _best, best_found, card_text

#: Folders that tokens are dealt to by a hash; a search reads those of its tokens.
BUCKETS = 64


def bucket(token: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.crc32(F.encode(token, "UTF-8")), F.lit(buckets)).cast("int")


def _dealt(rows: DataFrame, weights: tuple[int, int], buckets: int) -> DataFrame:
    """(paper_id, bucket, words, weights): a paper's distinct words by bucket, in one string, and a byte with the weight of each.

    ``rows`` has paper_id, a folded title and a text; the words of both have the two weights, summed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["paper_id", "words", "weights", "bucket"]
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int32()]
        made = lambda out: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        out: list[tuple] = []
        for batch in batches:
            for paper, title, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = dict.fromkeys(scoring.words(text), weights[1])
                for w in scoring.title_words(title):
                    held[w] = held.get(w, 0) + weights[0]
                own: dict[int, list[str]] = {}
                for w in held:
                    own.setdefault(zlib.crc32(w.encode()) % buckets, []).append(w)
                out += [(paper, " ".join(ws), bytes(held[w] for w in ws), b) for b, ws in own.items()]
                if len(out) >= 20_000:
                    yield made(out)
                    out = []
        if out:
            yield made(out)

    return rows.mapInArrow(run, "paper_id string, words string, weights binary, bucket int")


def add_to_index(path: str, version: int, papers: DataFrame, cards: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Adds the tokens of new or changed papers to the index at ``path``, as of ``version``, which has to grow from call to call.

    Nothing that is stored is read or written again: a paper's older rows lose their say as its version is no longer the latest.
    A call that is repeated after it stopped replaces what it wrote. Each task writes the words of the papers that it reads; nothing is shuffled.
    """
    said = papers.select(F.col("id").cast("string").alias("paper_id"), *scoring.about(papers), F.col("abstract").cast("string").alias("abstract")).where("paper_id IS NOT NULL")
    rows = _dealt(said.select("paper_id", "n_title", "abstract"), (scoring.TITLE, scoring.ABSTRACT), buckets)
    if cards is not None:
        known = cards.join(papers.select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
        rows = rows.unionByName(_dealt(known.select(F.col("paper_id").cast("string").alias("paper_id"), F.lit(None).cast("string").alias("n_title"), card_text().alias("text")), (0, scoring.CARD), buckets))
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/tokens/version={version}")
    known = said.select("paper_id", F.col("year").cast("int").alias("publication_year"), F.col("cites").cast("int").alias("citation_count"), "n_title")
    known.write.mode("overwrite").parquet(f"{path}/papers/version={version}")


def stored_words(spark: SparkSession, path: str) -> DataFrame:
    """The index as it is stored."""
    return spark.read.schema("paper_id string, words string, weights binary, version int, bucket int").parquet(f"{path}/tokens")


def stored_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, token, weight, version, bucket): the index with a row for each token."""
    rows = stored_words(spark, path).select("paper_id", "version", "bucket", "weights", F.posexplode(F.split("words", " ")).alias("i", "token"))
    weight = F.conv(F.hex(F.substring("weights", F.col("i") + 1, F.lit(1))), 16, 10).cast("long")
    return rows.select("paper_id", "token", weight.alias("weight"), "version", "bucket")


def _stored_papers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("paper_id string, publication_year int, citation_count int, n_title string, version int").parquet(f"{path}/papers")


def current_papers(spark: SparkSession, path: str) -> DataFrame:
    """Each paper as of its latest version."""
    rows = _stored_papers(spark, path)
    return rows.groupBy("paper_id").agg(F.max("version").alias("version"), F.max_by(F.struct("publication_year", "citation_count", "n_title"), "version").alias("p")).select("paper_id", "version", "p.*")


def _of_stored(row: dict) -> list[tuple[Iterable[str], int]]:
    """Words by weight: 1, 2, 3 or 5."""
    out: dict[int, list[str]] = {}
    for w, n in zip(row["words"].split(" "), row["weights"], strict=True):
        out.setdefault(n, []).append(w)
    return [(ws, n) for n, ws in out.items()]


def search_index(queries: DataFrame, spark: SparkSession, path: str, k: int = 20, buckets: int = BUCKETS) -> DataFrame:
    """(query_id, rank, paper_id, score): as ``search.lexical_search`` over the indexed papers; no text is folded again.

    The queries' words are counted in bytes. While they are few they go to the index, of which only their buckets are read, and what
    they meet is shuffled by paper, not by pair; else both meet by token. Outdated versions have no say.
    """
    if (held := scoring.numbered(queries)) is None:
        return _search_many(queries, spark, path, k, buckets)
    asked, sets = held
    own = sorted({zlib.crc32(w.encode()) % buckets for s in sets for w in s})
    null = F.lit(None).cast("struct<year:bigint,cites:bigint,n_title:string>").alias("about")
    words = stored_words(spark, path).where(F.col("bucket").isin(own)).select("paper_id", "version", null, "words", "weights")
    met = scoring.asked_words(words, sets, _of_stored).where(F.octet_length("packed") > 0)
    about = F.struct(F.coalesce("publication_year", F.lit(0)).cast("long").alias("year"), F.coalesce("citation_count", F.lit(0)).cast("long").alias("cites"), "n_title")
    papers = _stored_papers(spark, path).select("paper_id", "version", about.alias("about"), F.lit(b"").alias("packed"))
    return asked.join(best_found(scoring.best_of_rows(met.unionByName(papers), sets, k), k), "set").select("query_id", "rank", "paper_id", "score")


def _search_many(queries: DataFrame, spark: SparkSession, path: str, k: int, buckets: int) -> DataFrame:
    wanted = cut_lineage(queries.select("query_id", F.explode(T.stored_tokens(F.col("query"))).alias("token")))
    own = [r[0] for r in wanted.select(bucket(F.col("token"), buckets)).distinct().collect()]  # a number for each bucket at most
    met = stored_tokens(spark, path).where(F.col("bucket").isin(own)).join(wanted, "token")
    scored = met.groupBy("query_id", "paper_id", "version").agg(F.sum("weight").alias("score"))
    papers = current_papers(spark, path)
    latest = scored.join(papers.select("paper_id", "version"), ["paper_id", "version"], "left_semi").drop("version")
    named = papers.select(F.col("paper_id").alias("id"), F.col("n_title").alias("title"), "publication_year", "citation_count")
    return _best(latest, named, k).select("query_id", "rank", "paper_id", "score")
