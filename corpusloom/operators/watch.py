"""Watched topics: sightings, notifications and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T
from .components import cut_lineage, few
from .upsert import check_parents


def valid_sightings(sightings: DataFrame, topics: DataFrame | None = None, papers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sightings with a finite rank of known topics and papers, and the others with the reason."""
    finite = F.col("rank_score").isNotNull() & ~F.isnan("rank_score") & (F.abs("rank_score") != float("inf"))
    good, bad = sightings.where(finite), sightings.where(~finite).withColumn("reason", F.lit("rank_score must be finite"))
    parents = ({"watch_topic_id": (topics, "id")} if topics is not None else {}) | ({"paper_id": (papers, "id")} if papers is not None else {})
    if not parents:
        return good, bad
    known, unknown = check_parents(good, parents)
    return known, bad.unionByName(unknown)


def first_and_last(sightings: DataFrame) -> DataFrame:
    """(topic, paper): first and last seen, highest rank. Works on a stream, in update or complete mode; late rows are taken in."""
    return sightings.groupBy("watch_topic_id", "paper_id").agg(F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"), F.max("rank_score").alias("rank_score"))


def track_discoveries(discoveries: DataFrame | None, sightings: DataFrame) -> DataFrame:
    """The next snapshot of discoveries; is_new marks keys that weren't there. Order of arrival doesn't matter."""
    seen = first_and_last(sightings)
    if discoveries is None:
        return seen.withColumns({"notified_at": F.lit(None).cast("timestamp"), "is_new": F.lit(True)})
    old = discoveries.select("watch_topic_id", "paper_id", F.struct("first_seen_at", "last_seen_at", "rank_score", "notified_at").alias("o"))
    return old.join(seen, ["watch_topic_id", "paper_id"], "full_outer").select(
        "watch_topic_id", "paper_id", F.least("o.first_seen_at", "first_seen_at").alias("first_seen_at"), F.greatest("o.last_seen_at", "last_seen_at").alias("last_seen_at"),
        F.greatest("o.rank_score", "rank_score").alias("rank_score"), F.col("o.notified_at").alias("notified_at"), F.col("o").isNull().alias("is_new"),
    )


def pending_notifications(discoveries: DataFrame, cap: int = 3, least: float | None = 0.35) -> DataFrame:
    """The best ``cap`` discoveries of each topic that nobody was told of."""
    rows = discoveries.where("notified_at IS NULL")
    rows = rows if least is None else rows.where(F.col("rank_score") >= least)
    order = W.partitionBy("watch_topic_id").orderBy(F.desc("rank_score"), "first_seen_at", "paper_id")
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= cap).select("watch_topic_id", "nth", "paper_id", "rank_score", "first_seen_at", "last_seen_at")


def mark_notified(discoveries: DataFrame, delivered: DataFrame, now: Column) -> DataFrame:
    """Discoveries with notified_at set on delivered ones that had none; ``marked`` says which."""
    keys = delivered.select("watch_topic_id", "paper_id").distinct().withColumn("__sent", F.lit(True))
    rows = discoveries.join(keys, ["watch_topic_id", "paper_id"], "left")
    marked = F.col("notified_at").isNull() & F.col("__sent").isNotNull()
    return rows.withColumn("marked", marked).withColumn("notified_at", F.when(F.col("marked"), now).otherwise(F.col("notified_at"))).drop("__sent")


def scan_state(topics: DataFrame, scans: DataFrame) -> DataFrame:
    """Topics after a log of scans: a success sets last_scan_at and clears the error, a failure only sets the error (1000 characters)."""
    last = scans.groupBy(F.col("watch_topic_id").alias("id")).agg(F.max(F.when(F.col("error").isNull(), F.col("scanned_at"))).alias("ok_at"), F.max_by(F.struct("error"), "scanned_at").alias("last"))
    error = F.coalesce(F.nullif(F.substring(T.collapse(F.col("last.error")), 1, 1000), F.lit("")), F.lit("Unknown storage operation failure."))
    return topics.join(last, "id", "left").withColumns(
        {"last_scan_at": F.greatest("last_scan_at", "ok_at"), "last_error": F.when(F.col("last").isNull(), F.col("last_error")).when(F.col("last.error").isNotNull(), error)}
    ).drop("ok_at", "last")


def scan_topics(topics: DataFrame, papers: DataFrame, discoveries: DataFrame | None, current_year: int, now: Column, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Next discoveries and counters (topic: retrieved, new) of a search of all enabled topics in one job."""
    from .search import search

    asked = topics.where("enabled").select(F.col("id").alias("query_id"), "query")
    found = search(asked, papers, current_year, k).select(F.col("query_id").alias("watch_topic_id"), F.col("id").alias("paper_id"), F.col("score").alias("rank_score"), now.alias("seen_at"))
    after = track_discoveries(discoveries, found)
    fresh = after.where("is_new").groupBy("watch_topic_id").agg(F.count("*").alias("new"))
    counters = asked.select(F.col("query_id").alias("watch_topic_id")).join(found.groupBy("watch_topic_id").agg(F.count("*").alias("retrieved")), "watch_topic_id", "left").join(fresh, "watch_topic_id", "left").na.fill(0)
    return after, counters


def scan_status(
    topics: DataFrame, papers: DataFrame, discoveries: DataFrame | None, current_year: int, now: Column, failures: DataFrame | None = None, k: int = 10, cap: int = 3, least: float = 0.35
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Next discoveries, delivered notifications, and a status row for each enabled topic: scanned_at, error, retrieved, persisted, new, delivered.

    A topic that can't be searched (no query, or one of ``failures``: watch_topic_id and error) is a row with its error and no counts; all
    others are scanned in one job. Of a scanned topic the pending discoveries are delivered and marked. The rows are what ``scan_state`` takes.
    """
    enabled = topics.where("enabled").select(F.col("id").alias("watch_topic_id"), "query")
    empty = F.when(F.coalesce(T.collapse(F.col("query")), F.lit("")) == "", F.lit("the query is empty"))
    if failures is None:
        judged = enabled.withColumn("error", empty)
    else:
        told = failures.groupBy("watch_topic_id").agg(F.min(F.coalesce("error", F.lit("unknown failure"))).alias("told"))
        judged = enabled.join(told, "watch_topic_id", "left").withColumn("error", F.coalesce("told", empty)).drop("told")
    judged = cut_lineage(judged)
    asked = judged.where("error IS NULL").select(F.col("watch_topic_id").alias("id"), "query", F.lit(True).alias("enabled"))
    after, counters = scan_topics(asked, papers, discoveries, current_year, now, k)
    after = cut_lineage(after)
    due = cut_lineage(pending_notifications(after.join(asked.select(F.col("id").alias("watch_topic_id")), "watch_topic_id", "left_semi"), cap, least))
    delivered = due.groupBy("watch_topic_id").agg(F.count("*").alias("delivered"))
    marked = mark_notified(after, due, now).drop("marked")
    counts = counters.withColumn("persisted", F.col("retrieved")).join(delivered, "watch_topic_id", "left").na.fill(0)
    status = judged.select("watch_topic_id", now.alias("scanned_at"), "error").join(counts, "watch_topic_id", "left").na.fill(0, ["retrieved", "persisted", "new", "delivered"])
    return marked, due, status


# -- digests -----------------------------------------------------------------------------


def pick_insight(cards: DataFrame) -> DataFrame:
    """(paper_id, kind, text, source_section): the first contribution, claim, method or limitation that a card has."""
    first = lambda c: F.try_element_at(F.col(c), F.lit(1))
    none = F.lit(None).cast("string")
    row = lambda kind, text, section=none: F.when(text.isNotNull(), F.struct(F.lit(kind).alias("kind"), text.alias("text"), section.alias("source_section")))
    claim = first("main_claims")
    best = F.coalesce(row("Contribution", first("contributions")), row("Stored claim", claim["claim"], claim["source_section"]), row("Method", first("methods")), row("Limitation", first("limitations")))
    return cards.select("paper_id", best.alias("b")).where("b IS NOT NULL").select("paper_id", "b.kind", "b.text", "b.source_section")


def digest_candidates(papers: DataFrame, discoveries: DataFrame, topics: DataFrame, periods: DataFrame) -> DataFrame:
    """(period_start, rank, paper_id, topic_names, highest_rank): papers first discovered, or first seen by a topic, in each period [start, end).

    Order: highest rank (none and 0 count as -1), latest discovery, title. ``periods`` has period_start and period_end.
    """
    # a period is met by its days, then exactly
    day = F.explode(F.sequence(F.date_trunc("day", "period_start"), F.date_trunc("day", "period_end"), F.expr("INTERVAL 1 day")))
    days = few(periods.where("period_start <= period_end").select("period_start", "period_end", day.alias("day")))
    within = lambda df, c: df.withColumn("day", F.date_trunc("day", c)).join(days, "day").where((F.col(c) >= F.col("period_start")) & (F.col(c) < F.col("period_end")))
    by_paper = within(papers.select(F.col("id").alias("paper_id"), "first_discovered_at"), "first_discovered_at").select("period_start", "paper_id")
    named = discoveries.join(topics.select(F.col("id").alias("watch_topic_id"), F.col("name").alias("topic")), "watch_topic_id")
    seen = within(named, "first_seen_at").groupBy("period_start", "paper_id").agg(F.array_sort(F.collect_set("topic")).alias("topic_names"), F.max("rank_score").alias("highest_rank"))
    rows = by_paper.union(seen.select("period_start", "paper_id")).distinct().join(seen, ["period_start", "paper_id"], "left")
    rows = rows.join(papers.select(F.col("id").alias("paper_id"), "title", "first_discovered_at"), "paper_id")
    rank = F.coalesce(F.nullif("highest_rank", F.lit(0.0)), F.lit(-1.0))
    order = W.partitionBy("period_start").orderBy(F.desc(rank), F.desc("first_discovered_at"), F.lower("title"), "paper_id")
    return rows.withColumn("rank", F.row_number().over(order)).select("period_start", "rank", "paper_id", F.coalesce("topic_names", F.array().cast("array<string>")).alias("topic_names"), "highest_rank")


def build_digest(candidates: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of papers, the top papers and the activity of topics (most first, then by name), for each period."""
    counts = candidates.groupBy("period_start").agg(F.count("*").alias("paper_count"))
    active = candidates.select("period_start", F.explode("topic_names").alias("topic")).groupBy("period_start", "topic").agg(F.count("*").alias("papers"))
    order = W.partitionBy("period_start").orderBy(F.desc("papers"), F.lower("topic"))
    return counts, candidates.where(F.col("rank") <= min(top, 10)), active.withColumn("nth", F.row_number().over(order))


def daily_digests(discoveries: DataFrame, window: str = "1 day") -> DataFrame:
    """(period_start, topic, items, highest_rank): discoveries by the window of their first sighting."""
    rows = discoveries.groupBy(F.window("first_seen_at", window).alias("w"), "watch_topic_id").agg(F.count("*").alias("items"), F.max("rank_score").alias("highest_rank"))
    return rows.select(F.col("w.start").alias("period_start"), "watch_topic_id", "items", "highest_rank")


def digest_periods(runs: DataFrame, end: Column, window: str = "1 day") -> DataFrame:
    """(period_start, period_end): the period to send next, none if it wouldn't advance or is running or sent already.

    It goes on from the end of the last period sent. A failed period is tried again as it was.
    """
    done = F.col("status").isin("sent", "success")
    last = runs.agg(F.max(F.when(done, F.col("period_end"))).alias("cursor"))
    due = last.select(F.coalesce("cursor", end - F.expr(f"INTERVAL {window}")).alias("period_start"), end.alias("period_end")).where("period_end > period_start")
    failed = runs.where("status = 'failed'").select("period_start", "period_end").distinct()
    claimed = runs.where(done | (F.col("status") == "running")).select("period_start", "period_end").distinct()
    again = failed.join(claimed, ["period_start", "period_end"], "left_anti").join(F.broadcast(last)).where("cursor IS NULL OR period_end > cursor").select("period_start", "period_end")
    return due.union(again).distinct().join(claimed, ["period_start", "period_end"], "left_anti")
