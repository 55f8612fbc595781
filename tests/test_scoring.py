"""Scores where papers are read: what leaves a task is bounded by what is asked for."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import gaps, index, scoring, search
from corpusloom.plans import views as V

PAPER = "id string, title string, abstract string, publication_year int, citation_count int, source string, ord int"
TEXTS = ["Deep  nets", "deep\x1cnets", "deep nets", "Straße ﬁne", "STRASSE fine", "a b", "x.y, z", "", None, "İx é"]


def papers(spark, n=120):
    rnd = random.Random(7)
    said = lambda k: " ".join(rnd.choice(["net", "Net,", "deep", "é", "ship", "the", "x-ray", "of"]) for _ in range(k))
    rows = [(f"p{i}", said(3), said(9) if i % 5 else None, 2000 + i % 3 if i % 4 else None, i % 2, "abc"[i % 3], i) for i in range(n)]
    return spark.createDataFrame(rows, PAPER).repartition(3)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("text", TEXTS)
def test_words_are_those_of_the_columns(spark, text):
    row = spark.createDataFrame([(text,)], "x string").select(T.stored_tokens(F.col("x")).alias("w"), T.stored_title_tokens(F.col("x")).alias("t"), T.norm_title_stored(F.col("x")).alias("n")).first()
    assert scoring.words(text) == set(row["w"]) and scoring.title_words(row["n"]) == set(row["t"])


def test_each_task_gives_its_best_only(spark):
    """Before, every pair of a query and a paper with a hit was shuffled."""
    rows = papers(spark)
    found = scoring.best_of_papers(rows, [["deep", "net"], ["é"]], 4).collect()
    tasks = rows.rdd.getNumPartitions()
    assert 0 < sum(r.paper_id is not None for r in found) <= tasks * 2 * 4
    hits = {s: sum(r.score for r in found if r.paper_id is None and r.set == s) for s in (0, 1)}
    scored = search.lexical_scores(spark.createDataFrame([(0, "deep net"), (1, "é")], "query_id int, query string"), rows)
    assert hits == {r.query_id: r["count"] for r in scored.groupBy("query_id").count().collect()}


def test_same_as_pairs_by_join(spark, monkeypatch):
    rows = papers(spark)
    queries = spark.createDataFrame([(1, "deep NET"), (2, "net deep"), (3, "the x-ray of é"), (4, "none"), (5, " ")], "query_id int, query string")
    null = F.lit(None).cast("string")
    cards = rows.where("ord % 3 = 0").select(F.col("id").alias("paper_id"), null.alias("problem"), null.alias("motivation"), *[(F.array("title") if c == "limitations" else F.array()).cast(k).alias(c) for c, k in V.ARRAYS.items()])
    cards = cards.unionByName(cards.limit(1).withColumn("paper_id", F.lit("unknown")))
    asked = {
        "alone": lambda: search.lexical_search(queries, rows, None, 7), "cards": lambda: search.lexical_search(queries, rows, cards, 7), "scope": lambda: search.scoped_corpus(queries, rows, cards, 9),
    }
    local = {k: rows_of(f()) for k, f in asked.items()}
    monkeypatch.setattr(scoring, "numbered", lambda queries: None)
    assert local == {k: rows_of(f()) for k, f in asked.items()}
    assert len({r[0] for r in local["alone"]}) == 3 and any(r[4] for r in local["scope"])


def test_index_without_shuffle(spark, tmp_path, monkeypatch):
    """Before, each token of each paper was a row, shuffled twice."""
    rows, path = papers(spark), str(tmp_path / "index")
    index.add_to_index(path, 0, rows, buckets=2)
    queries = spark.createDataFrame([(1, "deep NET"), (2, "the x-ray of é")], "query_id int, query string")
    want = rows_of(search.lexical_search(queries, rows, None, 6))
    assert rows_of(index.search_index(queries, spark, path, 6, buckets=2)) == want
    assert index.stored_words(spark, path).count() < index.stored_tokens(spark, path).count()
    met = index.stored_tokens(spark, path).groupBy("paper_id", "token").agg(F.sum("weight").alias("weight"))
    assert rows_of(met) == rows_of(search.stored_token_index(rows).groupBy("paper_id", "token").agg(F.sum("weight").alias("weight")))
    monkeypatch.setattr(scoring, "numbered", lambda queries: None)
    assert rows_of(index.search_index(queries, spark, path, 6, buckets=2)) == want


def test_a_claim_of_many_topics_is_looked_at_once(spark, monkeypatch):
    """Before, a claim's words were taken apart for each topic and each use."""
    null = F.lit(None).cast("string")
    said = F.when(F.col("n") == 0, "segmentation ships improves nothing").otherwise("segmentation ships degrades a lot")
    cards = spark.range(20).join(spark.range(2).withColumnRenamed("id", "n")).select(
        F.col("id").cast("string").alias("topic"), F.concat(F.lit("p"), F.col("n").cast("string")).alias("paper_id"), F.col("n").alias("paper_ord"), null.alias("problem"), null.alias("motivation"),
        *[(F.array(F.struct(said.alias("claim"), null.alias("s"), null.alias("t"))) if c == "main_claims" else F.array()).cast(k).alias(c) for c, k in V.ARRAYS.items()],
    )
    cut, seen = gaps.cut_lineage, []

    def counted(df):
        out = cut(df)
        if "tokens" in out.columns:
            seen.append(out.count())
        return out

    monkeypatch.setattr(gaps, "cut_lineage", counted)
    got = gaps.contradictions(cards, gaps.build_facets(cards)).collect()
    assert seen == [2] and {(r.topic, r.paper_a, r.paper_b, r.concept, r.claim_a[-7:], r.claim_b[-5:]) for r in got} == {(str(i), "p0", "p1", "segmentation ships", "nothing", "a lot") for i in range(20)}
