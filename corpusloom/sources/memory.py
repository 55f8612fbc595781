"""The memory tables: schemas, and snapshots as Parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_JUDGED = "array<struct<value:string,status:string,source_section:string,supporting_text:string>>"
_REF = "array<struct<paper_id:string,paper_title:string,evidence_kind:string,claim_or_field:string,source_section:string,supporting_text:string,source_url:string>>"
_LOG = "array<struct<query:string,query_purpose:string,sources_searched:array<string>,successful_sources:array<string>,failed_sources:array<string>,retrieved_at:timestamp,retrieved_paper_ids:array<string>,result_count:int>>"

TABLES = {
    "papers": "id string, canonical_key string, title string, normalized_title string, abstract string, authors array<string>, publication_year int, venue string, doi string, url string, citation_count int, primary_source string, first_discovered_at timestamp, created_at timestamp, updated_at timestamp",
    "paper_sources": "paper_id string, provider string, external_id string, source_url string, retrieved_at timestamp",
    "watch_topics": "id string, name string, normalized_name string, query string, enabled boolean, created_at timestamp, last_scan_at timestamp, last_error string",
    "watch_papers": "watch_topic_id string, paper_id string, first_seen_at timestamp, last_seen_at timestamp, rank_score double, notified_at timestamp",
    "paper_cards": f"paper_id string, problem string, motivation string, contributions array<string>, methods array<string>, datasets array<string>, metrics array<string>, tasks {_JUDGED}, modalities {_JUDGED}, evaluation_conditions {_JUDGED}, main_claims array<struct<claim:string,source_section:string,supporting_text:string>>, limitations array<string>, future_work array<string>, failure_cases array<string>, source_url string, document_sha256 string, selected_sections array<string>, llm_provider string, llm_model string, created_at timestamp, updated_at timestamp",
    "digest_runs": "period_start timestamp, period_end timestamp, status string, paper_count int, created_at timestamp, sent_at timestamp, safe_error string",
    "gap_candidates": f"id string, title string, description string, gap_type string, research_question string, supporting_papers array<string>, conflicting_papers array<string>, evidence_count int, novelty_score double, evidence_score double, importance_score double, feasibility_score double, confidence double, search_scope string, caveats array<string>, provenance struct<retrievals:{_LOG},corpus_paper_ids:array<string>,corpus_description:string,supporting_evidence:{_REF},conflicting_evidence:{_REF}>, review_status string, created_at timestamp, updated_at timestamp",
    "gap_reviews": f"candidate_id string, review_version int, queries_used array<string>, retrieval_records {_LOG}, new_paper_ids array<string>, overlapping_paper_ids array<string>, decision string, rationale string, caveats array<string>, created_at timestamp",
    "projects": "id string, name string, description string, goal string, keywords array<string>, constraints array<string>, hypotheses array<string>, rejected_ideas array<string>, created_at timestamp, updated_at timestamp",
    "project_papers": "project_id string, paper_id string, relation string, note string, created_at timestamp",
    "project_gaps": "project_id string, candidate_id string, status string, created_at timestamp",
}
PARTITIONS = {"gap_candidates": ["gap_type"]}


def write_snapshot(df: DataFrame, folder: str, table: str, version: int) -> str:
    """Writes the next version beside the others; readers of an older one are not disturbed."""
    path = f"{folder}/{table}/v={version}"
    df.write.partitionBy(*PARTITIONS.get(table, [])).parquet(path)
    return path


def read_snapshot(spark: SparkSession, folder: str, table: str, version: int) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(f"{folder}/{table}/v={version}")


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])
