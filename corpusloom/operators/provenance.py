"""What candidates rest on: the papers that support them, pieces of evidence, and what reviews add, as keyed rows and as nested columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import gaps
from .components import few

#: Pieces of evidence of one side of a pairing, and of an evaluation gap.
OF_EACH, OF_ABSENCE = 2, 3
REF = "struct<paper_id:string,paper_title:string,evidence_kind:string,claim_or_field:string,source_section:string,supporting_text:string,source_url:string>"
LOG = "struct<query:string,query_purpose:string,sources_searched:array<string>,successful_sources:array<string>,failed_sources:array<string>,retrieved_at:timestamp,retrieved_paper_ids:array<string>,result_count:int>"
FIELD = {"task": "tasks", "modality": "modalities", "dataset": "datasets", "metric": "metrics", "evaluation_condition": "evaluation_conditions"}


def _keyed(mined: DataFrame, kind: str, *more: str) -> DataFrame:
    return mined.select(gaps.gap_key(kind).alias("gap_key"), *dict.fromkeys([*gaps.KEYS[kind], *more]))


def _observed(facets: DataFrame) -> DataFrame:
    """(topic, dimension, paper_id, value): what papers are seen with, as transfers take it."""
    return gaps.transfer_facets(facets).select("topic", "dimension", "paper_id", "value").distinct()


def supports(
    facets: DataFrame, grouped: DataFrame | None = None, explicit: DataFrame | None = None, coverage: DataFrame | None = None, evaluation: DataFrame | None = None, contradiction: DataFrame | None = None,
    transfer: DataFrame | None = None,
) -> DataFrame:
    """(gap_key, paper_id, side): every paper that a mined row rests on, ``supporting`` or ``conflicting``; no cut.

    All papers of a limitation's group; of a method and of a value for coverage; of the method for evaluation; of source and
    target context for transfers; one on either side of a contradiction. ``facets`` are those that were mined and ``grouped`` the statements.
    """
    methods = gaps.methods_of(facets)
    parts = []
    if explicit is not None:
        parts.append(_keyed(explicit, "explicit").join(grouped.select("topic", "group", "paper_id"), ["topic", "group"]))
    if coverage is not None:
        rows = _keyed(coverage, "coverage")
        parts += [rows.join(methods, ["topic", "method"]), rows.join(gaps.coverage_values(facets), ["topic", "dimension", "value"])]
    if evaluation is not None:
        parts.append(_keyed(evaluation, "evaluation").join(methods, ["topic", "method"]))
    if transfer is not None:
        rows, seen = _keyed(transfer, "method_transfer"), _observed(facets)
        used = methods.join(seen, ["topic", "paper_id"]).withColumnRenamed("value", "source")
        parts += [rows.join(used, ["topic", "method", "dimension", "source"]), rows.join(seen.withColumnRenamed("value", "target"), ["topic", "dimension", "target"])]
    named = [p.select("gap_key", F.col("paper_id").cast("string").alias("paper_id"), F.lit("supporting").alias("side")) for p in parts]
    if contradiction is not None:
        rows = _keyed(contradiction, "contradiction")
        named += [rows.select("gap_key", F.col(c).cast("string").alias("paper_id"), F.lit(side).alias("side")) for c, side in (("paper_a", "supporting"), ("paper_b", "conflicting"))]
    if not named:
        raise ValueError("no mined rows were given")
    out = named[0]
    for p in named[1:]:
        out = out.unionByName(p)
    return out.distinct()


def first_papers(rows: DataFrame, keys: list[str], n: int, *order: str) -> DataFrame:
    """The first ``n`` rows of each key, with their place ``nth``; Spark keeps no more than n of a key before the shuffle."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= n)


def evidence(
    facets: DataFrame, grouped: DataFrame | None = None, explicit: DataFrame | None = None, coverage: DataFrame | None = None, evaluation: DataFrame | None = None, contradiction: DataFrame | None = None,
    transfer: DataFrame | None = None,
) -> DataFrame:
    """(gap_key, side, pos, paper_id, claim_or_field, source_section, supporting_text): the pieces of evidence of each mined row, in order from 1.

    A limitation has each statement of its group. Coverage has the first two papers of the method and of the value. Evaluation has up to three papers
    that say they left the condition out, filled up to three from other papers of the method. A contradiction has its two claims. A transfer has two
    papers of the source context, without a quote, and the first two entries of the target context.
    """
    none = F.lit(None).cast("string")
    methods = gaps.methods_of(facets)
    parts = []

    def add(rows: DataFrame, pos: Column, field: Column, section: Column = none, text: Column = none, side: str = "supporting") -> None:
        parts.append(rows.select("gap_key", F.lit(side).alias("side"), pos.cast("int").alias("pos"), F.col("paper_id").cast("string").alias("paper_id"), field.alias("claim_or_field"), section.alias("source_section"), text.alias("supporting_text")))

    if explicit is not None:
        held = _keyed(explicit, "explicit").join(grouped.select("topic", "group", "paper_id", "field", "statement", "nth"), ["topic", "group"])
        held = held.withColumn("pos", F.row_number().over(W.partitionBy("gap_key").orderBy("nth")))
        add(held, F.col("pos"), F.col("field"), F.regexp_extract("field", r"^([^\[]*)", 1), F.col("statement"))
    if coverage is not None:
        rows = _keyed(coverage, "coverage")
        uses = lambda what: F.concat(F.lit("uses "), F.col(what))
        with_method = rows.join(first_papers(methods, ["topic", "method"], OF_EACH, "paper_id"), ["topic", "method"])
        with_value = rows.join(first_papers(gaps.coverage_values(facets), ["topic", "dimension", "value"], OF_EACH, "paper_id"), ["topic", "dimension", "value"])
        add(with_method, F.col("nth"), F.lit("methods"), text=uses("method"))
        add(with_value, F.col("nth") + OF_EACH, F.replace("dimension", F.lit("_"), F.lit(" ")), text=uses("value"))
    if evaluation is not None:
        rows = _keyed(evaluation, "evaluation", "evidence").withColumn("found", F.size("evidence"))
        absent = rows.select("gap_key", F.posexplode("evidence").alias("i", "e")).select("gap_key", "i", "e.*")
        add(absent, F.col("i") + 1, F.lit("evaluation_conditions"), F.col("source_section"), F.col("supporting_text"))
        ids = F.transform("evidence", lambda e: e["paper_id"])
        # three of the first six papers at least aren't among the three
        others = rows.join(first_papers(methods, ["topic", "method"], 2 * OF_ABSENCE, "paper_id"), ["topic", "method"]).where(~F.array_contains(ids, F.col("paper_id")))
        others = others.withColumn("i", F.row_number().over(W.partitionBy("gap_key").orderBy("paper_id"))).where(F.col("i") <= OF_ABSENCE - F.col("found"))
        add(others, F.col("i") + F.col("found"), F.lit("methods"), text=F.concat(F.lit("uses "), F.col("method")))
    if contradiction is not None:
        for p, side in (("a", "supporting"), ("b", "conflicting")):
            rows = _keyed(contradiction, "contradiction", f"claim_{p}", f"section_{p}", f"quote_{p}").withColumn("paper_id", F.col(f"paper_{p}"))
            add(rows, F.lit(1), F.lit("main_claims"), F.col(f"section_{p}"), F.coalesce(F.nullif(f"quote_{p}", F.lit("")), f"claim_{p}"), side)
    if transfer is not None:
        rows, seen = _keyed(transfer, "method_transfer"), _observed(facets)
        used = methods.join(seen, ["topic", "paper_id"]).withColumnRenamed("value", "source")
        source = first_papers(used, ["topic", "method", "dimension", "source"], OF_EACH, "paper_id")
        add(rows.join(source, ["topic", "method", "dimension", "source"]), F.col("nth"), F.lit("methods"))
        entries = gaps.transfer_facets(facets).select("topic", "dimension", F.col("value").alias("target"), "paper_id", "paper_ord", "pos", "source_section", "supporting_text")
        target = first_papers(entries, ["topic", "dimension", "target"], OF_EACH, "paper_ord", "paper_id", "pos").drop("pos")
        plural = F.try_element_at(F.create_map(*[F.lit(x) for kv in FIELD.items() for x in kv]), F.col("dimension"))
        held = rows.join(target, ["topic", "dimension", "target"])
        quote = F.when(~F.col("dimension").isin("dataset"), F.col("supporting_text"))
        add(held, F.col("nth") + OF_EACH, F.coalesce(plural, "dimension"), F.when(~F.col("dimension").isin("dataset"), F.col("source_section")), quote)
    if not parts:
        raise ValueError("no mined rows were given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _titles(papers: DataFrame, of: DataFrame) -> DataFrame:
    """Title and address of the papers that ``of`` names; the others are not shuffled."""
    ids = of.select("paper_id").distinct()
    rows = papers.select(F.col("id").alias("paper_id"), F.col("title").alias("paper_title"), F.col("url").alias("source_url"))
    return rows.join(few(ids, F.length("paper_id")), "paper_id", "left_semi")


def with_provenance(candidates: DataFrame, support: DataFrame, pieces: DataFrame, papers: DataFrame, corpus: DataFrame, now: Column) -> DataFrame:
    """Candidates as rows of the memory's table: papers and evidence of both sides, counts, scope, caveats and provenance without retrievals yet.

    ``candidates`` are those of ``as_candidates``, ``support`` and ``pieces`` those of the functions above, ``papers`` has id, title and
    url, ``corpus`` has topic and paper_id: the cards that were mined. Arrays are as long as a topic's corpus,
    which ``scoped_corpus`` bounds; the pieces of evidence of other than explicit gaps are four at most.
    """
    ids = lambda side: F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col("paper_id"))))
    cited = support.groupBy("gap_key").agg(ids("supporting").alias("supporting_papers"), ids("conflicting").alias("conflicting_papers"))
    titled = pieces.join(_titles(papers, pieces), "paper_id", "left")
    ref = F.struct("paper_id", F.coalesce("paper_title", F.concat(F.lit("Paper "), "paper_id")).alias("paper_title"), F.col("side").alias("evidence_kind"), "claim_or_field", "source_section", "supporting_text", "source_url").cast(REF)
    refs = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("pos", ref.alias("ref"))))), lambda x: x["ref"])
    gathered = titled.groupBy("gap_key").agg(refs("supporting").alias("for"), refs("conflicting").alias("against"))
    scope = corpus.groupBy(F.col("topic").cast("string").alias("topic")).agg(F.array_sort(F.collect_set(F.col("paper_id").cast("string"))).alias("corpus_paper_ids"))
    rows = candidates.join(cited, "gap_key", "left").join(gathered, "gap_key", "left").join(scope, "topic", "left")
    strings, none = F.array().cast("array<string>"), F.array().cast(f"array<{REF}>")
    size = F.coalesce(F.size("corpus_paper_ids"), F.lit(0)).cast("string")
    kind = F.replace("gap_type", F.lit("_"), F.lit(" "))
    caveats = F.array(
        F.lit("A question to look into, not a proof that it is new."), F.concat(F.lit("Only the "), size, F.lit(" stored papers of this topic were looked at.")),
        F.when(F.col("gap_type").isin("coverage", "method_transfer"), "That nothing was found in them does not mean that nothing exists."),
        F.when(F.col("conditioned"), "The two claims were made for other data or conditions."),
    )
    provenance = F.struct(
        F.array().cast(f"array<{LOG}>").alias("retrievals"), F.coalesce("corpus_paper_ids", strings).alias("corpus_paper_ids"), F.concat(kind, F.lit(" analysis of "), "topic", F.lit(" over "), size, F.lit(" cards")).alias("corpus_description"),
        F.coalesce("for", none).alias("supporting_evidence"), F.coalesce("against", none).alias("conflicting_evidence"),
    )
    null = F.lit(None).cast("double")
    return rows.select(
        "topic", "gap_key", "id", "title", "description", "gap_type", "research_question", F.coalesce("supporting_papers", strings).alias("supporting_papers"), F.coalesce("conflicting_papers", strings).alias("conflicting_papers"),
        (F.when(F.col("gap_type") == "contradiction", F.coalesce(F.size("for"), F.lit(0)) + F.coalesce(F.size("against"), F.lit(0))).otherwise(F.coalesce(F.size("for"), F.lit(0)))).cast("int").alias("evidence_count"),
        null.alias("novelty_score"), "evidence_score", null.alias("importance_score"), F.col("feasibility").cast("double").alias("feasibility_score"), "confidence",
        F.concat(size, F.lit(" stored cards of "), "topic").alias("search_scope"), F.array_compact(caveats).alias("caveats"), provenance.alias("provenance"),
        F.lit("candidate").alias("review_status"), now.alias("created_at"), now.alias("updated_at"),
    )


def after_review(candidates: DataFrame, decided: DataFrame, log: DataFrame, invalid: DataFrame, papers: DataFrame) -> DataFrame:
    """Candidates after a review: status, confidence and caveats of ``critic.decide``; retrievals and the resolving card are appended to their provenance.

    ``candidates`` have the columns of the memory's table. ``log`` is ``critic.retrieval_log`` (id, pos and what each query brought), ``invalid`` is
    ``critic.memory_invalidation``. What was there stays, in front of what is new; a candidate that wasn't reviewed stays as it is.
    """
    record = F.struct("query", "query_purpose", "sources_searched", "successful_sources", "failed_sources", "retrieved_at", "retrieved_paper_ids", "result_count").cast(LOG)
    asked = log.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", record.alias("record")))), lambda x: x["record"]).alias("__asked"))  # four queries at most
    named = invalid.join(_titles(papers, invalid), "paper_id", "left")
    ref = F.struct("paper_id", F.coalesce("paper_title", F.concat(F.lit("Paper "), "paper_id")).alias("paper_title"), F.lit("conflicting").alias("evidence_kind"), F.col("field").alias("claim_or_field"), F.lit(None).cast("string").alias("source_section"), "supporting_text", "source_url").cast(REF)
    resolved = named.groupBy("id").agg(F.min(ref).alias("__ref"))
    result = decided.select("id", F.col("decision").alias("__decision"), F.col("new_confidence").alias("__confidence"), F.col("caveats").alias("__caveats"))
    rows = candidates.join(result, "id", "left").join(asked, "id", "left").join(resolved, "id", "left")
    old = F.col("provenance")
    provenance = F.struct(
        F.concat(old["retrievals"], F.coalesce("__asked", F.array().cast(f"array<{LOG}>"))).alias("retrievals"), old["corpus_paper_ids"].alias("corpus_paper_ids"), old["corpus_description"].alias("corpus_description"),
        old["supporting_evidence"].alias("supporting_evidence"), F.concat(old["conflicting_evidence"], F.array_compact(F.array("__ref"))).alias("conflicting_evidence"),
    )
    updates = {"review_status": F.coalesce("__decision", "review_status"), "confidence": F.coalesce("__confidence", "confidence"), "caveats": F.coalesce("__caveats", "caveats"), "provenance": provenance}
    return rows.select(*(updates[c].alias(c) if c in updates else F.col(c) for c in candidates.columns))
