"""Provenance, first-fit grouping, delivery, chained streams, the stored index, partitions, files and scans."""

import os
import random
from datetime import timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import critic, gaps, index, provenance, search, upsert, watch
from corpusloom.operators.components import cut_lineage, in_order
from corpusloom.sources import documents, memory
from corpusloom.streaming import delivery, first_seen
from corpusloom.streaming.watch import SIGHTING

from .test_memory import NOW, cards, judged, paper


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# -- provenance --------------------------------------------------------------------------


def mined_of(spark):
    """Five cards of one topic that give a candidate of each kind."""
    claim = lambda text: [(text, "Results", None)]
    rows = cards(
        spark,
        {"methods": ["U-Net"], "datasets": ["AA"], "modalities": judged("MRI"), "evaluation_conditions": [("domain shift", "explicitly_absent", "Limits", "not tested")], "limitations": ["Performance degrades under scanner domain shift."], "main_claims": claim("The encoder improves reconstruction")},
        {"methods": ["U-Net"], "datasets": ["AA"], "modalities": judged("MRI"), "limitations": ["Scanner domain shift remains an issue."], "main_claims": claim("The encoder degrades reconstruction")},
        {"methods": ["U-Net"], "datasets": ["AA"], "modalities": judged("MRI")},
        {"methods": ["Dropout"], "datasets": ["BB"], "modalities": judged("CT")},
        {"methods": ["Dropout"], "datasets": ["BB"], "modalities": judged("CT")},
    )
    facets = cut_lineage(gaps.build_facets(rows))
    grouped = cut_lineage(gaps.group_statements(gaps.limitation_statements(facets), mode="first_fit"))
    found = {
        "grouped": grouped, "explicit": gaps.explicit_gaps(grouped), "coverage": gaps.coverage_gaps(rows, facets), "evaluation": gaps.evaluation_gaps(rows, facets), "contradiction": gaps.contradictions(rows, facets),
        "transfer": gaps.method_transfers(rows, facets),
    }
    return rows, facets, {k: cut_lineage(v) for k, v in found.items()}


def test_all_kinds_rest_on_all_their_papers(spark):
    rows, facets, found = mined_of(spark)
    candidates = cut_lineage(gaps.as_candidates(**{k: v for k, v in found.items() if k != "grouped"}))
    support = cut_lineage(provenance.supports(facets, **found))
    named = {}
    for r in candidates.join(support, "gap_key").collect():
        named.setdefault((r.gap_type, r.title), {}).setdefault(r.side, set()).add(r.paper_id)
    assert named[("explicit", "Repeated limitation in t: scanner domain shift")] == {"supporting": {"p1", "p2"}}
    assert named[("coverage", "Unobserved coverage combination: U-Net × BB")] == {"supporting": {"p1", "p2", "p3", "p4", "p5"}}
    assert named[("evaluation", "Underrepresented evaluation condition in t: domain shift for U-Net")] == {"supporting": {"p1", "p2", "p3"}}
    assert named[("method_transfer", "Potential method transfer: Dropout → mri")] == {"supporting": {"p1", "p2", "p3", "p4", "p5"}}
    assert {k[0] for k in named} == {"explicit", "coverage", "evaluation", "contradiction", "method_transfer"}
    assert [v for k, v in named.items() if k[0] == "contradiction"][0] == {"supporting": {"p1"}, "conflicting": {"p2"}}
    # no candidate is without support, and its own papers never count as newly found
    assert candidates.join(support, "gap_key", "left_anti").count() == 0
    papers = paper(spark, *({"id": f"p{i}", "title": "U-Net Dropout scanner domain shift mri reconstruction encoder potential method transfer"} for i in range(1, 7)))
    ids = candidates.withColumn("id", F.col("gap_key"))
    fresh = ids.select("id").crossJoin(papers.select(F.col("id").alias("paper_id")))
    over = critic.overlap_check(ids, fresh, papers, support.withColumnRenamed("gap_key", "id"))
    cited = {(r.gap_key, r.paper_id) for r in support.collect()}
    assert over.count() > 0 and not any((r.id, r.paper_id) in cited for r in over.collect())


def test_evidence_and_table_rows(spark):
    rows, facets, found = mined_of(spark)
    candidates = cut_lineage(gaps.as_candidates(**{k: v for k, v in found.items() if k != "grouped"}))
    support, pieces = cut_lineage(provenance.supports(facets, **found)), cut_lineage(provenance.evidence(facets, **found))
    papers = paper(spark, *({"id": f"p{i}", "title": f"Title {i}", "url": f"u{i}"} for i in range(1, 5)))
    full = provenance.with_provenance(candidates, support, pieces, papers, rows.select("topic", "paper_id"), F.lit(NOW))
    full = cut_lineage(full)
    assert [c for c in full.columns if c not in ("topic", "gap_key")] == [f.name for f in memory.empty(spark, "gap_candidates").schema]
    by = {r.title: r for r in full.collect()}
    r = by["Underrepresented evaluation condition in t: domain shift for U-Net"]
    assert [(e.paper_id, e.claim_or_field, e.source_section, e.supporting_text) for e in r.provenance.supporting_evidence] == [("p1", "evaluation_conditions", "Limits", "not tested"), ("p2", "methods", None, "uses U-Net"), ("p3", "methods", None, "uses U-Net")]
    assert (r.evidence_count, r.provenance.corpus_paper_ids, r.review_status, r.provenance.supporting_evidence[0].paper_title, r.provenance.supporting_evidence[0].source_url) == (3, ["p1", "p2", "p3", "p4", "p5"], "candidate", "Title 1", "u1")
    r = by["Unobserved coverage combination: U-Net × BB"]
    assert [(e.paper_id, e.claim_or_field, e.supporting_text) for e in r.provenance.supporting_evidence] == [("p1", "methods", "uses U-Net"), ("p2", "methods", "uses U-Net"), ("p4", "dataset", "uses BB"), ("p5", "dataset", "uses BB")]
    assert r.provenance.supporting_evidence[3].paper_title == "Paper p5"
    r = by["Potential method transfer: Dropout → mri"]
    assert [(e.paper_id, e.claim_or_field) for e in r.provenance.supporting_evidence] == [("p4", "methods"), ("p5", "methods"), ("p1", "modalities"), ("p2", "modalities")]
    assert r.feasibility_score == 0.8
    r = by["Repeated limitation in t: scanner domain shift"]
    assert [(e.paper_id, e.claim_or_field, e.source_section) for e in r.provenance.supporting_evidence] == [("p1", "limitations[0]", "limitations"), ("p2", "limitations[0]", "limitations")]
    r = next(v for v in by.values() if v.gap_type == "contradiction")
    assert [(e.paper_id, e.source_section, e.supporting_text) for e in r.provenance.supporting_evidence + r.provenance.conflicting_evidence] == [("p1", "Results", "The encoder improves reconstruction"), ("p2", "Results", "The encoder degrades reconstruction")]
    # a review adds to what is there, and only where there was one
    reviewed = full.where("gap_type = 'evaluation'").withColumn("id", F.col("gap_key"))
    everyone = full.withColumn("id", F.col("gap_key"))
    fresh = reviewed.select("id", F.lit(1).alias("pos"), F.lit(1).alias("rank"), F.lit("f").alias("paper_id"))
    feeds = spark.createDataFrame([("openalex", None), ("arxiv", "out of reach")], "source string, warning string")
    log = critic.retrieval_log(critic.derive_queries(reviewed), fresh, feeds, F.lit(NOW))
    invalid = reviewed.select("id", F.lit("p4").alias("paper_id"), F.lit("main_claims").alias("field"), F.lit("it is solved").alias("supporting_text"))
    overlaps = spark.createDataFrame([], "id string, paper_id string, shared bigint")
    decided = critic.decide(reviewed, invalid, overlaps, feeds)
    log, decided = cut_lineage(log), cut_lineage(decided)
    after = cut_lineage(provenance.after_review(everyone, decided, log, invalid, papers))
    again = provenance.after_review(after, decided, log, invalid, papers)
    for df, times in ((after, 1), (again, 2)):
        got = {r.gap_type: r for r in df.collect()}
        r = got["evaluation"]
        assert (r.review_status, r.confidence, len(r.provenance.retrievals), len(r.provenance.conflicting_evidence)) == ("rejected", 0.0, 4 * times, times)
        assert r.provenance.retrievals[0].retrieved_paper_ids == ["f"] and r.provenance.retrievals[0].failed_sources == ["arxiv"]
        assert (r.provenance.conflicting_evidence[0].paper_title, r.provenance.conflicting_evidence[0].evidence_kind, r.provenance.conflicting_evidence[0].supporting_text) == ("Title 4", "conflicting", "it is solved")
        assert (got["coverage"].review_status, len(got["coverage"].provenance.retrievals)) == ("candidate", 0)


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_crossing_is_the_same_dealt_or_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(gaps, "BROADCAST_BYTES", limit)
    a = spark.createDataFrame([("t", f"m{i}") for i in range(30)] + [("u", "x")], "topic string, m string")
    b = spark.createDataFrame([("t", f"v{i}") for i in range(20)], "topic string, v string")
    assert rows_of(gaps._crossed(a, b, ["topic"]).select("m", "v")) == sorted(((f"m{i}", f"v{j}") for i in range(30) for j in range(20)), key=repr)


# -- grouping ------------------------------------------------------------------------------


def plain_first_fit(sets, shared=2, jaccard=0.35):
    groups, out = [], []
    for own in sets:
        at = next((i for i, g in enumerate(groups) if len(own & g) >= shared or len(own & g) / len(own | g) >= jaccard), len(groups))
        if at == len(groups):
            groups.append(set())
        groups[at] |= own
        out.append(at + 1)
    return out


def test_first_fit_as_one_by_one(spark):
    rnd = random.Random(31)
    given, want = [], {}
    for t in range(12):
        vocabulary = [f"w{i}" for i in range([6, 15, 40][t % 3])]
        sets = [set(rnd.sample(vocabulary, rnd.choice([1, 1, 2, 2, 3, 5]))) for _ in range([1, 6, 14, 22][t % 4])]
        for i, (s, g) in enumerate(zip(sets, plain_first_fit(sets), strict=True)):
            given.append((f"t{t}", i + 1, sorted(s)))
            want[(f"t{t}", i + 1)] = g
    rnd.shuffle(given)
    got = gaps.first_fit(spark.createDataFrame(given, "topic string, nth int, tokens array<string>")).collect()
    assert {(r.topic, r.nth): r.group for r in got} == want


def test_order_of_many_rows(spark):
    rnd = random.Random(32)
    values = [rnd.randrange(50) for _ in range(300)]
    got = in_order(spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(7), F.asc("v"), F.asc("i")).collect()
    assert [(r.v, r.i) for r in sorted(got, key=lambda r: r.nth)] == sorted((v, i) for i, v in enumerate(values)) and sorted(r.nth for r in got) == list(range(300))


# -- streams -------------------------------------------------------------------------------


def sightings(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, SIGHTING).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SIGHTING).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize(("fails_at", "before_write"), [(None, True), (0, False), (1, True)])
def test_delivery_is_once_whenever_it_stops(spark, tmp_path, fails_at, before_write):
    rnd = random.Random(33)
    batches = [[(rnd.choice("ab"), f"p{rnd.randrange(12)}", round(rnd.random(), 3), NOW + timedelta(hours=24 * b + rnd.randrange(24))) for _ in range(10)] for b in range(3)]
    folder, now = str(tmp_path / "out"), F.lit(NOW + timedelta(99))
    sink, failed = delivery.to_log(folder), []

    def deliver(rows, batch):
        if batch == fails_at and not failed:
            failed.append(batch)
            if not before_write:
                sink(rows, batch)
            raise RuntimeError("stopped")
        sink(rows, batch)

    stream = sightings(spark, str(tmp_path / "in"), batches)
    if fails_at is not None:
        with pytest.raises(StreamingQueryException):
            delivery.run_delivery(stream, folder, now, deliver)
        assert delivery.committed(spark, folder) == fails_at - 1
    delivery.run_delivery(stream, folder, now, deliver)
    delivery.run_delivery(stream, folder, now, deliver)  # nothing new
    state, told = None, set()
    for rows in batches:  # the same as batch jobs
        state = watch.track_discoveries(state, spark.createDataFrame(rows, SIGHTING)).drop("is_new")
        due = watch.pending_notifications(state).checkpoint()
        told |= {(r.watch_topic_id, r.paper_id) for r in due.collect()}
        state = watch.mark_notified(state, due, now).drop("marked").checkpoint()
    got = spark.read.parquet(f"{folder}/delivered").collect()
    assert sorted((r.watch_topic_id, r.paper_id) for r in got) == sorted(told) and len({r.delivery_id for r in got}) == len(got)
    assert rows_of(delivery.discoveries(spark, folder).select("watch_topic_id", "paper_id", "first_seen_at", "rank_score", "notified_at")) == rows_of(state.select("watch_topic_id", "paper_id", "first_seen_at", "rank_score", "notified_at"))


@pytest.mark.parametrize("seed", [1])
def test_chained_streams_for_any_split(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice("ab"), f"p{rnd.randrange(15)}", round(rnd.random(), 3), NOW + timedelta(hours=rnd.randrange(24 * 8))) for _ in range(90)]
    batches = [[] for _ in range(5)]
    for r in rows:  # up to a day late
        batches[min(4, ((r[3] - NOW).days + rnd.randrange(2)) // 2)].append(r)
    end = NOW + timedelta(60)
    stream = sightings(spark, str(tmp_path / "in"), [b for b in batches if b] + [[("", "", 0.0, end)]])
    got = first_seen.run_daily(stream, str(tmp_path / "out"), "2 days", str(end + timedelta(30)))
    first, want = {}, {}
    for topic, p, rank, at in rows:
        a, r = first.get((topic, p), (at, rank))
        first[(topic, p)] = (at, rank) if at < a else (a, max(r, rank) if at == a else r)
    for (topic, _), (at, rank) in first.items():
        key = (at.replace(hour=0, minute=0, second=0, microsecond=0), topic)
        n, best = want.get(key, (0, 0.0))
        want[key] = (n + 1, max(best, rank))
    assert {(r.period_start, r.watch_topic_id): (r["items"], r.highest_rank) for r in got.collect()} == want


# -- index, partitions, files, scans ------------------------------------------------------------


def test_index_is_kept_up(spark, tmp_path):
    rnd = random.Random(34)
    words = [a + b for a in "bcdfg" for b in ("al", "em", "in")]
    said = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    papers = [{"id": f"p{i}", "title": said(4), "abstract": said(20), "publication_year": 2000 + i % 9} for i in range(40)]
    path = str(tmp_path / "index")
    index.add_to_index(path, 0, paper(spark, *papers[:30]))
    before = {d: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs}
    papers[3] |= {"title": said(4)}
    papers[7] |= {"abstract": None}
    for _ in range(2):  # a repeated call changes nothing
        index.add_to_index(path, 1, paper(spark, papers[3], papers[7], *papers[30:]))
    assert all(os.stat(d) for d in before) and {d for d in before if "version=0" in d}
    queries = spark.createDataFrame([(i, said(3)) for i in range(6)] + [(9, "nothing")], "query_id int, query string")
    want = search.lexical_search(queries, paper(spark, *papers), None, 10)
    assert rows_of(index.search_index(queries, spark, path, 10)) == rows_of(want)
    plan = index.stored_tokens(spark, path).where(F.col("bucket").isin([1, 2]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan


def test_only_touched_partitions_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, f"n{i}", i % 4) for i in range(40)], "id int, name string, kind int").write.partitionBy("kind").parquet(path)
    files = lambda: {k: sorted(os.listdir(f"{path}/kind={k}")) for k in range(4)}
    before = files()
    new = spark.createDataFrame([(1, "x", 1, 1), (1, "y", 1, 2), (99, "z", 1, 1), (7, None, 3, 1)], "id int, name string, kind int, ord int")
    touched = upsert.upsert_partitions(path, new, ["id"], ["kind"])
    after = files()
    assert sorted(r.kind for r in touched.collect()) == [1, 3] and {k for k in range(4) if before[k] != after[k]} == {1, 3}
    want = {(i, f"n{i}", i % 4) for i in range(40)} - {(1, "n1", 1)} | {(1, "y", 1), (99, "z", 1)}
    assert {(r.id, r.name, r.kind) for r in spark.read.parquet(path).collect()} == want


def test_document_files(spark, tmp_path):
    texts = {"good.txt": ("word " * 60).encode(), "short.txt": b"few", "bad.txt": b"\xff\xfe" * 200, "large.txt": b"x" * 2_000, "ünïcode.txt": ("é" * 300).encode()}
    for name, raw in texts.items():
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "other.pdf").write_bytes(b"x" * 500)
    good, bad = documents.read_documents(spark, str(tmp_path), most_bytes=1_000, glob="*.txt")
    assert sorted((os.path.basename(r.path).rpartition(".")[0][-4:], r.n_text) for r in good.collect()) == [("code", 300), ("good", 300)]
    assert sorted((os.path.basename(r.path), r.reason) for r in bad.collect()) == [("bad.txt", "not_utf8"), ("large.txt", "too_large"), ("short.txt", "too_little_text")]
    plan = good._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,1000)" in plan


def test_quarantine(spark, tmp_path):
    (tmp_path / "o").mkdir()
    (tmp_path / "o/a.json").write_text('{"results":[{"id":"https://x.org/W1","title":"T"},{"id":"https://x.org/W2"},{"title":"no id"}]}\n{"results":[{"id"\n\n{"results":[]}\n')
    good, bad = documents.quarantine_openalex(spark, str(tmp_path / "o"))
    assert [r.id for r in good.collect()] == ["openalex:W1"] and sorted(r.reason for r in bad.collect()) == ["no id", "no title", "not parsed"]
    (tmp_path / "a.xml").write_text("<feed><entry><id>http://arxiv.org/abs/2401.1</id><title>A</title></entry><entry><id>x</id><title>Error</title></entry><entry><id>2</id><title>B</titel></entry><entry><id>3</id></entry></feed>")
    good, bad = documents.quarantine_arxiv(spark, str(tmp_path / "a.xml"))
    assert [r.title for r in good.collect()] == ["A"] and sorted(r.reason for r in bad.collect()) == ["no entry but an error", "no title", "not parsed"]
    papers, rejects, report = documents.feed_report({"openalex": documents.quarantine_openalex(spark, str(tmp_path / "o")), "arxiv": None})
    got = {r.source: (r.papers, r.rejected, r.warning) for r in report.collect()}
    assert got == {"openalex": (1, 3, "3 records of openalex could not be used."), "arxiv": (None, None, "arxiv was unavailable; results may be partial.")}


def test_a_bad_topic_is_a_row(spark):
    topics = spark.createDataFrame([("a", "mri enhancement", True), ("b", "  ", True), ("c", "mri", True), ("d", None, True), ("e", "mri", False)], "id string, query string, enabled boolean")
    papers = paper(spark, *({"id": f"p{i}", "title": f"MRI enhancement study {i}", "publication_year": 2025} for i in range(5)))
    failures = spark.createDataFrame([("c", "timed out")], "watch_topic_id string, error string")
    after, due, status = watch.scan_status(topics, papers, None, 2026, F.lit(NOW), failures, cap=2)
    got = {r.watch_topic_id: (r.error, r.retrieved, r.persisted, r.new, r.delivered) for r in status.collect()}
    assert got == {"a": (None, 5, 5, 5, 2), "b": ("the query is empty", 0, 0, 0, 0), "c": ("timed out", 0, 0, 0, 0), "d": ("the query is empty", 0, 0, 0, 0)}
    assert after.where("notified_at IS NOT NULL").count() == 2 == due.count()
    state = watch.scan_state(topics.withColumns({"last_scan_at": F.lit(None).cast("timestamp"), "last_error": F.lit(None).cast("string")}), status)
    assert {r.id: (r.last_scan_at, r.last_error) for r in state.collect()} == {"a": (NOW, None), "b": (None, "the query is empty"), "c": (None, "timed out"), "d": (None, "the query is empty"), "e": (None, None)}
    # the next scan goes on from there: nothing is new, the others are told
    _, due, status = watch.scan_status(topics, papers, after.drop("is_new"), 2026, F.lit(NOW + timedelta(1)), failures, cap=2)
    assert {r.watch_topic_id: (r.new, r.delivered) for r in status.where("error IS NULL").collect()} == {"a": (0, 2)}


def test_folding_beyond_ascii(spark):
    given = ["Plain ASCII ß".replace(" ß", ""), "ＦＵＬＬ width", "Straße", None, "", "İ"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string")
    import unicodedata

    got = {r.i: (r.a, r.b, r.c) for r in df.select("i", T.nfkc_casefold(F.col("x")).alias("a"), T.nfkc(F.col("x")).alias("b"), T.nfkd_lower(F.col("x")).alias("c")).collect()}
    for i, x in enumerate(given):
        want = (None,) * 3 if x is None else (unicodedata.normalize("NFKC", x).casefold(), unicodedata.normalize("NFKC", x), unicodedata.normalize("NFKD", x).lower())
        assert got[i] == want
