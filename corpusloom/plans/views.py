"""The driver's tables as the memory's tables: what each operator's registered query reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.components import cut_lineage, few

JUDGED = "array<struct<value:string,status:string,source_section:string,supporting_text:string>>"
CLAIMS = "array<struct<claim:string,source_section:string,supporting_text:string>>"
STRINGS = "array<string>"
ARRAYS = {c: STRINGS for c in ("contributions", "methods", "datasets", "metrics", "limitations", "future_work", "failure_cases")} | {
    "tasks": JUDGED, "modalities": JUDGED, "evaluation_conditions": JUDGED, "main_claims": CLAIMS,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_line() -> F.Column:
    return F.split_part(F.col("text"), F.lit("\n"), F.lit(1))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers: the first line is the title, the whole text the abstract; copies share a doi, if the id is even."""
    feed = F.element_at(F.array(F.lit("openalex"), F.lit("semantic_scholar"), F.lit("arxiv")), (F.col("doc_id") % 3 + 1).cast("int"))
    number = F.col("doc_id").cast("string")
    doi = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("10.5555/"), F.substring(F.md5(F.col("text").cast("binary")), 1, 12)))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"), F.concat(F.lit("d"), number).alias("id"), first_line().alias("title"), F.col("text").alias("abstract"), F.array("source", "lang").alias("authors"),
        (2000 + F.col("doc_id") % 25).cast("int").alias("publication_year"), F.col("source").alias("venue"), doi.alias("doi"), F.concat(F.lit("https://papers.example/"), number).alias("url"),
        (F.col("n_chars") % 1000).cast("int").alias("citation_count"), feed.alias("source"), F.create_map(feed, number).alias("external_ids"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as search queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _card(**given) -> list[F.Column]:
    out = [given.get(c, F.lit(None).cast("string")).alias(c) for c in ("problem", "motivation")]
    return out + [(given[c] if c in given else F.array()).cast(kind).alias(c) for c, kind in ARRAYS.items()]


def document_cards(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Labelled documents as cards: the whole text is a limitation, and a claim that improves or degrades by quality. Those of some papers (``of``: doc_id) only, if given."""
    docs = table(spark, sf_dir, "documents")
    docs = (docs if of is None else docs.join(few(of.distinct()), "doc_id", "left_semi")).join(few(table(spark, sf_dir, "labels").select("doc_id", "quality")), "doc_id")
    said = F.concat("text", F.when(F.col("quality") == 1, F.lit(" improves")).otherwise(F.lit(" degrades")))
    null = F.lit(None).cast("string")
    return docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("paper_id"), F.col("doc_id").alias("paper_ord"),
        *_card(
            methods=F.array("source"), datasets=F.array("lang"), limitations=F.array("text"), main_claims=F.array(F.struct(said.alias("claim"), null.alias("source_section"), null.alias("supporting_text"))),
        ),
    )


def scoped_cards(spark: SparkSession, sf_dir: str, limit: int = 50, corpus: DataFrame | None = None) -> DataFrame:
    """The cards of each query's scoped corpus (``corpus``, if it is there already), with topic and order."""
    from ..operators.search import scoped_corpus

    if corpus is None:
        corpus = scoped_corpus(queries(spark, sf_dir), papers(spark, sf_dir), document_cards(spark, sf_dir), limit)
    scope = corpus.where("has_card").select(F.col("query_id").cast("string").alias("topic"), "paper_id", "paper_ord")
    scope = cut_lineage(scope.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # many topics have the same papers: each card is written once, not once for each topic
    cards = cut_lineage(document_cards(spark, sf_dir, scope.select(F.substring("paper_id", 2, 20).cast("long").alias("doc_id"))).drop("paper_ord"))
    size = F.octet_length(F.concat_ws("", "limitations", F.transform("main_claims", lambda c: c["claim"])))
    return scope.join(few(cards, size), "paper_id")


CONDITION_WORDS = ["Domain shift study", "scanner shift", "noise", "calibration error", "out-of-distribution robustness", "cross-dataset", "latency only", "shift"]


def evaluated_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cards with one condition: observed or explicitly absent by quality, unknown without a label. The topic is the language."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    word = F.element_at(F.array(*map(F.lit, CONDITION_WORDS)), (F.col("n_chars") % len(CONDITION_WORDS) + 1).cast("int"))
    status = F.when(F.col("quality") == 1, "observed").when(F.col("quality") == 0, "explicitly_absent").otherwise("unknown")
    null = F.lit(None).cast("string")
    return docs.select(
        F.col("lang").alias("topic"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("paper_id"), F.col("doc_id").alias("paper_ord"),
        *_card(methods=F.array("source"), evaluation_conditions=F.array(F.struct(word.alias("value"), status.alias("status"), null.alias("source_section"), null.alias("supporting_text")))),
    )


def claiming_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cards of their language; one in ten claims that its source improves under its condition."""
    word = F.element_at(F.array(*map(F.lit, CONDITION_WORDS)), (F.col("n_chars") % len(CONDITION_WORDS) + 1).cast("int"))
    null = F.lit(None).cast("string")
    claim = F.struct(F.concat("source", F.lit(" improves under "), word).alias("claim"), null.alias("source_section"), null.alias("supporting_text"))
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("topic"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("paper_id"), F.col("doc_id").alias("paper_ord"),
        *_card(main_claims=F.when(F.col("doc_id") % 10 == 0, F.array(claim)).otherwise(F.array().cast(CLAIMS))),
    )


#: Ends of texts that claim too much, or don't.
CLAIM_TAILS = [" No  one has studied it.", " This is THE first of them.", " no research exists; nobody has ever looked", " The first paper to do so.", " This was the first."]
#: A method of each class, and one of none.
METHOD_NAMES = ["YOLO head", "Dropout", "SimCLR pretraining", "U-Net", "Focal loss", "Curriculum", "Plain averaging"]


def method_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cards of their language: a method by length, the source as data, and one of five modalities."""
    null = F.lit(None).cast("string")
    modality = F.struct(F.concat(F.lit("Modality "), (F.col("n_chars") % 5).cast("string")).alias("value"), F.lit("observed").alias("status"), null.alias("source_section"), null.alias("supporting_text"))
    method = F.element_at(F.array(*map(F.lit, METHOD_NAMES)), (F.col("n_chars") % len(METHOD_NAMES) + 1).cast("int"))
    # the even lengths know no modality 4: it is there to move to
    return table(spark, sf_dir, "documents").where("n_chars % 10 <> 4").select(
        F.col("lang").alias("topic"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("paper_id"), F.col("doc_id").alias("paper_ord"),
        *_card(methods=F.array(method), datasets=F.array("source"), modalities=F.array(modality)),
    )


def method_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers that say at their end which method they use, and on what."""
    method = F.element_at(F.array(*map(F.lit, METHOD_NAMES)), (F.col("n_chars") % len(METHOD_NAMES) + 1).cast("int"))
    used = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit(" This uses "), method, F.lit(" evaluated on dataset "), "source").alias("used"))
    rows = papers(spark, sf_dir)
    return rows.join(used, "id").withColumn("abstract", F.concat("abstract", "used")).select(*rows.columns)


def varied_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cards that have a contribution, a claim, a method or a limitation, or nothing, in turn."""
    turn = F.col("doc_id") % 5
    none = F.array().cast(STRINGS)
    claim = F.struct(F.col("text").alias("claim"), F.lit("Results").alias("source_section"), F.lit(None).cast("string").alias("supporting_text"))
    some = lambda k: F.when((turn == k) | (turn == 3), F.array("text")).otherwise(none)
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("paper_id"),
        *_card(contributions=some(0), main_claims=F.when(turn == 1, F.array(claim)).otherwise(F.array().cast(CLAIMS)), methods=F.when(turn == 2, F.array("source")).otherwise(none), limitations=F.when(turn == 2, F.array("lang")).otherwise(none)),
    )


def document_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as gaps: title, text, and a question of title and source."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return docs.select(
        F.concat(F.lit("g"), F.col("doc_id").cast("string")).alias("id"), first_line().alias("title"), F.col("text").alias("description"), F.concat_ws(" ", first_line(), "source").alias("research_question"),
        F.timestamp_seconds(F.col("n_chars")).alias("created_at"), F.lit("explicit").alias("gap_type"), F.lit("pending").alias("review_status"), F.when(F.col("doc_id") % 2 == 0, 0.5).alias("confidence"),
    )


def gap_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reviews of every second document's gap."""
    decision = F.element_at(F.array(F.lit("preserved"), F.lit("downgraded")), F.col("review_version"))
    rows = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").withColumn("review_version", F.explode(F.array(F.lit(1), F.lit(2))))
    return rows.select(F.concat(F.lit("g"), F.col("doc_id").cast("string")).alias("candidate_id"), "review_version", decision.alias("decision"), first_line().alias("rationale"), F.array("source", "lang").alias("caveats"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three projects that share the labelled documents."""
    none = F.array().cast(STRINGS)
    rows = table(spark, sf_dir, "labels").select(F.concat(F.lit("p"), (F.col("doc_id") % 3).cast("string")).alias("id")).distinct()
    return rows.select(
        "id", F.concat(F.lit("Project "), "id").alias("name"), F.when(F.col("id") != "p0", F.concat(F.lit("Goal of "), "id")).alias("goal"), F.array(F.lit("key"), F.col("id")).alias("keywords"),
        none.alias("hypotheses"), F.array(F.lit("few papers")).alias("constraints"), F.when(F.col("id") == "p1", F.array(F.lit("an old idea"))).otherwise(none).alias("rejected_ideas"),
    )


def order_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cards: parts by brand and size are methods, the suppliers' nations datasets."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("method"))
    nations = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("nation"))
    rows = lines.join(few(nations, F.length("nation")), "l_suppkey").join(few(parts, F.length("method")), "l_partkey")
    # dealt by the id of the card, so that what is asked of each card needs no other shuffle
    rows = rows.groupBy(F.col("l_orderkey").cast("string").alias("paper_id")).agg(F.min("l_orderkey").alias("paper_ord"), F.collect_set("method").alias("m"), F.collect_set("nation").alias("d"))
    return rows.select(F.lit("orders").alias("topic"), "paper_id", "paper_ord", *_card(methods=F.col("m"), datasets=F.col("d")))


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sightings of users by event type."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("watch_topic_id"), F.col("user_id").cast("string").alias("paper_id"), (F.col("value") / 500).alias("rank_score"), F.col("ts").alias("seen_at"))


HEADINGS = ["Abstract", "1. Introduction", "II. Methodology", "3 Results:", "Findings", "Conclusion - final remarks", "References"]


def sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with headings set before their lines in turn."""
    heading = F.array(*map(F.lit, HEADINGS))
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.concat(F.element_at(heading, ((i + F.col("doc_id")) % len(HEADINGS) + 1).cast("int")), F.lit("\n"), line))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))
