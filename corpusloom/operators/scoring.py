"""Lexical scores of many queries where a paper is read: each task keeps the best of its papers for each query, so that no pair is shuffled."""

from __future__ import annotations

import re
import unicodedata
from bisect import insort
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from .components import BROADCAST_BYTES, cut_lineage

#: What is asked for of a paper's or a card's words; cards say nothing ``about`` a paper.
WORDS = "paper_id string, version int, about struct<year:bigint,cites:bigint,n_title:string>, packed binary"
#: What a task gives back; a row without a paper_id has the number of papers with a hit as its score.
FOUND = "set int, feed string, paper_id string, score bigint, year bigint, cites bigint, n_title string, has_card boolean"
TITLE, ABSTRACT, CARD = 3, 2, 1
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def words(text: str | None) -> set[str]:
    """As ``text.stored_tokens``."""
    if not text:
        return set()
    folded = text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()
    if "\x1c" in folded or "\x1d" in folded or "\x1e" in folded or "\x1f" in folded:  # white space to str.split only
        return set(_SPACE.split(folded)) - {""}
    return set(folded.split())


def title_words(n_title: str | None) -> set[str]:
    """As ``text.stored_title_tokens`` of the title whose ``norm_title_stored`` is given."""
    return set(n_title.split(" ")) - {""} if n_title else set()


class Asked:
    """The words of numbered sets: their ids, and by id which sets have them."""

    def __init__(self, sets: list[list[str]]) -> None:
        self.n, self.ids = len(sets), {}
        of = [[] for _ in range(len({w for s in sets for w in s}))]
        for i, s in enumerate(sets):
            for w in s:
                of[self.ids.setdefault(w, len(self.ids))].append(i)
        self.start = np.concatenate([[0], np.cumsum([len(x) for x in of])]).astype(np.int64)
        self.sets = np.array([i for x in of for i in x], np.int64)

    def packed(self, found: list[tuple[Iterable[str], int]]) -> bytes:
        """What is asked for of words that count as a weight of 7 at most, 4 bytes each."""
        return np.array([i << 3 | weight for words, weight in found for i in map(self.ids.get, words) if i is not None], np.uint32).tobytes()

    def scores(self, packed: bytes) -> np.ndarray:
        x = np.frombuffer(packed, np.uint32).astype(np.int64)
        start, n = self.start[x >> 3], self.start[(x >> 3) + 1] - self.start[x >> 3]
        if not (total := int(n.sum())):
            return np.zeros(self.n, np.int64)
        at = np.arange(total) + np.repeat(start - np.cumsum(n) + n, n)
        return np.bincount(self.sets[at], np.repeat(x & 7, n), self.n).astype(np.int64)


class Best:
    """The best k papers of each set, in the order of score and what follows it in a paper's key; and how many had a hit."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k, self.hits, self.feeds = n, k, np.zeros(n, np.int64), {}

    def add(self, feed: str | None, scores: np.ndarray, key: tuple) -> None:
        if feed not in self.feeds:
            self.feeds[feed] = np.ones(self.n, np.int64), [[] for _ in range(self.n)]
        least, lists = self.feeds[feed]
        self.hits += scores > 0
        for q in np.flatnonzero(scores >= least):
            held, row = lists[q], (-int(scores[q]), *key)
            if len(held) == self.k:
                if row >= held[-1]:
                    continue
                held.pop()
            insort(held, row)
            if len(held) == self.k:
                least[q] = -held[-1][0]

    def batches(self, told: Callable[[tuple], tuple]) -> Iterator[pa.RecordBatch]:
        """``told`` turns a key into paper_id, year, cites, n_title and has_card."""
        schema = pa.schema([("set", pa.int32()), ("feed", pa.string()), ("paper_id", pa.string()), ("score", pa.int64()), ("year", pa.int64()), ("cites", pa.int64()), ("n_title", pa.string()), ("has_card", pa.bool_())])
        rows = [(int(q), None, None, int(self.hits[q]), None, None, None, None) for q in np.flatnonzero(self.hits)]
        for feed, (_, lists) in self.feeds.items():
            for q, held in enumerate(lists):
                for score, *key in held:
                    paper, year, cites, title, card = told(key)
                    rows.append((q, feed, paper, -score, year, cites, title, card))
                if len(rows) >= 10_000:
                    yield _batch(rows, schema)
                    rows = []
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _keyed(by_feed: bool) -> tuple[Callable, Callable]:
    """What orders papers of one score: year, citations, title (null first) and id; by feed the id only. And the way back."""
    if by_feed:
        return lambda paper, year, cites, title, card: (paper, card), lambda key: (key[0], None, None, None, key[1])
    return lambda paper, year, cites, title, card: (-year, -cites, title is not None, title or "", paper, card), lambda key: (key[4], -key[0], -key[1], key[3] if key[2] else None, key[5])


def numbered(queries: DataFrame, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, list[list[str]]] | None:
    """(query_id, set) and the distinct sets of words that ``queries`` (query_id, query) ask for; nothing if their bytes, which are counted first, are too many."""
    rows = cut_lineage(queries.select("query_id", F.array_sort(T.stored_tokens(F.col("query"))).alias("terms")).where(F.size("terms") > 0))
    terms = rows.select("terms").distinct()
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w) + 24)
    if terms.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()["bytes"] > limit:
        return None
    sets = sorted(r["terms"] for r in terms.collect())
    numbers = rows.sparkSession.createDataFrame(list(enumerate(sets)), "set int, terms array<string>")
    return rows.join(F.broadcast(numbers), "terms").select("query_id", "set"), sets


def about(papers: DataFrame) -> list[Column]:
    """year, cites and n_title: what papers of one score are ordered by."""
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return [number("publication_year").alias("year"), number("citation_count").alias("cites"), T.norm_title_stored(F.col("title")).alias("n_title")]


def best_of_papers(papers: DataFrame, sets: list[list[str]], k: int, by_feed: bool = False) -> DataFrame:
    """FOUND: for each task that reads papers its best k of each set (by feed: of each feed too); nothing is shuffled."""
    held = papers.sparkSession.sparkContext.broadcast(Asked(sets))
    keyed, told = _keyed(by_feed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held.value
        best = Best(asked.n, k)
        for batch in batches:
            for paper, feed, year, cites, title, abstract in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if packed := asked.packed([(title_words(title), TITLE), (words(abstract), ABSTRACT)]):
                    best.add(feed if by_feed else None, asked.scores(packed), keyed(paper, year, cites, title, False))
        yield from best.batches(told)

    feed = F.col("source").cast("string") if by_feed else F.lit(None).cast("string")
    rows = papers.where(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("paper_id"), feed.alias("feed"), *about(papers), F.col("abstract").cast("string").alias("abstract"))
    return rows.mapInArrow(run, FOUND)


def asked_words(rows: DataFrame, sets: list[list[str]], found: Callable[[dict], list[tuple[Iterable[str], int]]]) -> DataFrame:
    """WORDS: of each row (paper_id, version, about and others) the words that are asked for, as ``found`` tells them of its other columns."""
    held = rows.sparkSession.sparkContext.broadcast(Asked(sets))
    names = ["paper_id", "version", "about"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held.value
        for batch in batches:
            rest = {c: batch.column(c).to_pylist() for c in batch.schema.names if c not in names}
            packed = [asked.packed(found(dict(zip(rest, row, strict=True)))) for row in zip(*rest.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(packed, pa.binary())], [*names, "packed"])

    return rows.mapInArrow(run, WORDS)


def of_papers(row: dict) -> list[tuple[Iterable[str], int]]:
    return [(title_words(row["n_title"]), TITLE), (words(row["abstract"]), ABSTRACT)]


def of_cards(row: dict) -> list[tuple[Iterable[str], int]]:
    return [(words(row["text"]), CARD)]


def best_of_rows(rows: DataFrame, sets: list[list[str]], k: int) -> DataFrame:
    """FOUND of rows as WORDS, several for a paper: they meet by paper, and those of its latest version count.

    Only numbers of words that are asked for are shuffled. Rows of no paper are left out.
    """
    held = rows.sparkSession.sparkContext.broadcast(Asked(sets))
    keyed, told = _keyed(False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held.value
        best = Best(asked.n, k)

        def end(own: list[tuple]) -> None:
            if papers := [x for x in own if x[2] is not None]:
                paper, version, x, _ = max(papers, key=lambda x: x[1])
                if packed := b"".join(x[3] for x in own if x[1] == version):
                    best.add(None, asked.scores(packed), keyed(paper, x["year"], x["cites"], x["n_title"], len(own) > len(papers)))

        own: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own and own[0][0] != row[0]:
                    end(own)
                    own = []
                own.append(row)
        end(own)
        yield from best.batches(told)

    return rows.where("paper_id IS NOT NULL").repartition("paper_id").sortWithinPartitions("paper_id").mapInArrow(run, FOUND)
