"""The research memory's operators on hand-made rows."""

import os
import random
import shutil
import subprocess
import sys
from collections import defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import critic, gaps, resolve, search, sections, upsert, watch
from corpusloom.operators.components import connected_components
from corpusloom.plans.views import ARRAYS
from corpusloom.sources import feeds, memory

PAPER = "ord bigint, " + feeds.PAPER
CARD = "topic string, paper_id string, paper_ord bigint, problem string, motivation string, " + ", ".join(f"{c} {k}" for c, k in ARRAYS.items())


def paper(spark, *rows):
    base = dict(id=None, title="A title of some length", abstract=None, authors=[], publication_year=None, venue=None, doi=None, url=None, citation_count=None, source="openalex", external_ids={})
    out = [tuple({**base, **r, "id": r.get("id", f"p{i}")}[k] for k in base) for i, r in enumerate(rows)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(out)], PAPER)


def judged(*values, status="observed"):
    return [(v, status, None, None) for v in values]


def cards(spark, *rows):
    base = dict(topic="t", paper_id=None, paper_ord=None, problem=None, motivation=None, **{c: [] for c in ARRAYS})
    return spark.createDataFrame([tuple({**base, "paper_id": f"p{i + 1}", "paper_ord": i, **r}[k] for k in base) for i, r in enumerate(rows)], CARD)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("function", "given", "want"),
    [
        (T.norm_title, " A—Paper:  MRI! ", "a paper mri"), (T.norm_title, "snake_case ²", "snake_case 2"), (T.norm_title_stored, "snake_case + $x", "snake case + $x"),
        (T.norm_doi, "https://doi.org/10.1/X.", "10.1/x"), (T.norm_doi, "doi: 10.1/Y/", "10.1/y"), (T.norm_doi, " ", None), (T.norm_arxiv, "arXiv:2401.01234v2", "2401.01234"),
        (T.norm_arxiv, "http://arxiv.org/pdf/2401.01234v1.pdf", "2401.01234"), (T.norm_arxiv, "https://arxiv.org/abs/hep-th/9901001v3", "hep-th/9901001"), (T.norm_provider, "Open Alex", "openalex"), (T.norm_provider, "!!", "unknown"),
        (T.without_absolute_claims, "No one has seen it", "limited evidence was found for seen it"), (T.miner_tokens, "The Café of 3 groß xy", ["cafe", "xy"]), (T.critic_tokens, "Can the été be new?", ["can", "the", "new"]),
        (T.ranker_tokens, "a_b, c-d a_b", ["a_b", "c", "d"]), (T.stored_tokens, "Deep, deep  Deep, net", ["deep,", "deep", "net"]),
    ],
)
def test_text(spark, function, given, want):
    assert one(spark, function, given) == want


def test_rewritten_answers(spark):
    out = one(spark, T.rewrite_claims, "This is the first study; nobody has ever tried.")
    assert "first" not in out and "ever" not in out


def test_components_match_union_find(spark):
    rnd = random.Random(0)
    edges = [(i, i + 1) for i in range(60)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(60)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    root = list(range(200))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {a: find(a) for e in edges if None not in e and e[0] != e[1] for a in e}
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def groups_of(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.component].append(r.ord)
    return sorted(sorted(v) for v in out.values())


def test_same_doi_is_one_paper(spark):
    rows = paper(
        spark, {"title": "First words here", "doi": "https://doi.org/10.1/X", "citation_count": 2, "authors": ["A"], "external_ids": {"arxiv": "2401.1v1"}},
        {"title": "Other words there", "doi": "10.1/x", "citation_count": 7, "authors": ["A", "B"], "abstract": "said", "source": "semantic_scholar"},
    )
    merged = resolve.merge_duplicates(rows, resolve.resolve_duplicates(rows)).collect()
    assert len(merged) == 1
    m = merged[0]
    assert (m.doi, m.abstract, len(m.authors), m.citation_count, m.external_ids["arxiv"], m.external_ids["doi"]) == ("10.1/x", "said", 2, 7, "2401.1v1", "10.1/x")


def test_titles_join_unless_ids_conflict(spark):
    same = {"title": "One and the same title"}
    rows = paper(spark, same | {"doi": "10.1/a"}, same | {"doi": "10.1/b"}, same | {"external_ids": {"arxiv": "2401.00001"}}, {"title": "AI"}, {"title": "AI"})
    assert groups_of(resolve.resolve_duplicates(rows)) == [[0, 2], [1], [3], [4]]


def test_duplicates_match_brute_force(spark):
    rnd = random.Random(2)
    names = ["openalex", "semantic_scholar", "arxiv"]
    rows = [
        {"title": f"Some title number {rnd.randrange(12)}", "doi": f"10.1/{rnd.randrange(25)}" if rnd.random() < 0.5 else None, "external_ids": {"pmid": str(rnd.randrange(40))} if rnd.random() < 0.4 else {}, "source": rnd.choice(names)}
        for _ in range(60)
    ]
    root = list(range(60))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    keys = [[k for k in (r["doi"] and f"doi:{r['doi']}", r["external_ids"].get("pmid") and f"pmid:{r['external_ids']['pmid']}") if k] for r in rows]
    seen = {}
    for i, ks in enumerate(keys):
        for k in ks:
            a, b = find(i), find(seen.setdefault(k, i))
            root[max(a, b)] = min(a, b)
    base = [find(i) for i in range(60)]
    titles = defaultdict(list)
    for i, r in enumerate(rows):
        if base[i] not in titles[r["title"]]:
            titles[r["title"]].append(base[i])
    values = defaultdict(lambda: defaultdict(set))
    for i, ks in enumerate(keys):
        for k in ks:
            values[base[i]][k.split(":")[0]].add(k)
    for parts in titles.values():
        taken = defaultdict(set, {k: set(v) for k, v in values[parts[0]].items()})
        for c in parts[1:]:
            if not any(k in taken and not taken[k] & v for k, v in values[c].items()):
                for k, v in values[c].items():
                    taken[k] |= v
                a, b = find(parts[0]), find(c)
                root[max(a, b)] = min(a, b)
    want = defaultdict(list)
    for i in range(60):
        want[find(i)].append(i)
    assert groups_of(resolve.resolve_duplicates(paper(spark, *rows))) == sorted(want.values())


NOW = datetime(2026, 1, 1)


def stored(spark, *rows):
    base = dict(id="m1", canonical_key="k1", title="Stored title of this", normalized_title="stored title of this", abstract=None, authors=[], publication_year=None, venue=None, doi=None, url=None, citation_count=None, primary_source="arxiv", first_discovered_at=NOW, created_at=NOW, updated_at=NOW)
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], memory.TABLES["papers"])


def test_upsert_bridges_and_keeps_the_oldest(spark):
    old = stored(spark, {"id": "m1", "canonical_key": "doi:10.1/a", "doi": "10.1/a", "title": "Stored under doi"}, {"id": "m2", "canonical_key": "arxiv:2401.1", "title": "Stored under number", "created_at": NOW + timedelta(1)}, {"id": "m3", "canonical_key": "x", "title": "Alone and apart"})
    sources = spark.createDataFrame([("m2", "arxiv", "2401.1")], "paper_id string, provider string, external_id string")
    new = paper(spark, {"id": "arxiv:2401.1v2", "title": "Bridge between the two", "doi": "10.1/A", "source": "arxiv", "external_ids": {"arxiv": "2401.1"}, "citation_count": 5}, {"id": "openalex:W9", "title": "Entirely new work"})
    got = {r.id: r for r in resolve.upsert_papers(old, sources, new, F.lit("2026-02-02").cast("timestamp")).collect()}
    assert len(got) == 3 and {"m1", "m3"} < set(got)
    assert (got["m1"].citation_count, got["m1"].title, got["m1"].updated_at) == (5, "Bridge between the two", datetime(2026, 2, 2))


def test_reconcile(spark):
    ids = spark.createDataFrame([("b", "a")], "old_id string, new_id string")
    t = lambda d: NOW + timedelta(d)
    seen = spark.createDataFrame([("w", "a", t(2), t(3), 0.5, None), ("w", "b", t(1), t(2), 0.9, t(5)), ("v", "b", t(1), t(1), 0.1, None)], memory.TABLES["watch_papers"])
    got = {r.watch_topic_id: tuple(r)[1:] for r in resolve.reconcile_discoveries(seen, ids).select("watch_topic_id", "paper_id", "first_seen_at", "last_seen_at", "rank_score", "notified_at").collect()}
    assert got == {"w": ("a", t(1), t(3), 0.9, t(5)), "v": ("a", t(1), t(1), 0.1, None)}
    sources = spark.createDataFrame([("a", "p", "1", None, t(1)), ("b", "p", "1", "u", t(2))], memory.TABLES["paper_sources"])
    assert [tuple(r) for r in resolve.reconcile_sources(sources, ids).collect()] == [("a", "p", "1", t(2), "u")]
    kept = resolve.reconcile_cards(memory.empty(spark, "paper_cards").unionByName(spark.createDataFrame([("a", "old", t(1), t(1)), ("b", "new", t(0), t(2))], "paper_id string, problem string, created_at timestamp, updated_at timestamp"), allowMissingColumns=True), ids).collect()
    assert [(r.paper_id, r.problem, r.created_at) for r in kept] == [("a", "new", t(0))]


def test_ranking_prefers_relevance(spark):
    papers = paper(spark, {"title": "Visual anomaly detection", "publication_year": 2025, "citation_count": 3}, {"title": "Unrelated survey", "publication_year": 2000, "citation_count": 100_000})
    queries = spark.createDataFrame([(1, "visual anomaly detection")], "query_id int, query string")
    got = search.rank_papers(papers.selectExpr("1 AS query_id", "id"), queries, papers, 2026).orderBy("rank").collect()
    assert got[0].id == "p0" and got[0].title_overlap == 1.0 and abs(got[0].recency - 0.9) < 1e-9


def test_question_gate_and_project_bonus(spark):
    papers = paper(spark, {"id": "g", "title": "MRI enhancement"}, {"id": "s", "title": "enhancement", "abstract": "mri"}, {"id": "z", "title": "Off topic entirely"})
    links = spark.createDataFrame([("p", "s", "seed"), ("p", "z", "seed")], "project_id string, paper_id string, relation string")
    questions = spark.createDataFrame([(1, "mri enhancement", "p")], "question_id int, question string, project_id string")
    got = search.retrieve_evidence(questions, papers, cards(spark).drop("topic", "paper_ord"), links).orderBy("rank").collect()
    assert [(r.paper_id, r.lexical, r.total) for r in got] == [("s", 5.0, 18.0), ("g", 6.0, 12.0)]


def test_packet_is_bounded(spark):
    papers = paper(spark, *({"id": f"p{i}", "title": "long words here", "abstract": "x" * 5000} for i in range(6)))
    questions = spark.createDataFrame([(1, "q", "p")], "question_id int, question string, project_id string")
    evidence = spark.createDataFrame([(1, i + 1, f"p{i}") for i in range(6)], "question_id int, rank int, paper_id string")
    found = spark.createDataFrame([], "question_id int, rank int, candidate_id string")
    links = memory.empty(spark, "project_papers")
    project = spark.createDataFrame([("p", "Name", None, None, ["k"], [], [], ["bad idea"], NOW, NOW)], memory.TABLES["projects"])
    out = search.evidence_packet(questions, evidence, found, papers, cards(spark).drop("topic", "paper_ord"), memory.empty(spark, "gap_candidates"), memory.empty(spark, "gap_reviews"), project, links, memory.empty(spark, "project_gaps")).first().packet
    assert len(out) <= 8000 and out.startswith("# Project") and "given up earlier" in out and out.index("Paper p0") < out.index("Paper p5")


def test_headings_in_compatibility_form(spark):
    docs = spark.createDataFrame([(1, "\uff32\uff45\uff53\uff55\uff4c\uff54\uff53\u2028one\r\ntwo\x0bMethod: three\nResults\nfour"), (2, None), (3, ""), (4, "Abstract\n\n"), (4, "Abstract\nx")], "doc_id bigint, text string")
    got = {(r.doc, r.ord, r.section, r.body) for r in sections.detect_sections(docs).collect()}
    assert got == {(1, 6, "Results", "one\ntwo"), (1, 4, "Method", "three\nResults\nfour"), (4, 1, "Abstract", "x")}


def test_sections(spark):
    text = "Abstract: A concise abstract.\n1. Introduction\nintro line\nII. Methodology\nmethod line\n3 Results\nresult line\nMethods\nmore\nReferences\n[1]"
    docs = spark.createDataFrame([(1, text), (2, "no headings at all"), (3, None)], "doc_id int, text string")
    found = sections.detect_sections(docs).orderBy("ord").collect()
    assert [(r.section, r.body) for r in found] == [("Abstract", "A concise abstract."), ("Introduction", "intro line"), ("Method", "method line"), ("Results", "result line\nMethods\nmore"), ("References", "[1]")]
    many = spark.createDataFrame([(1, 9, "Conclusion", "c " * 80), (1, 4, "Method", "m " * 80), (1, 1, "Abstract", "a " * 80)], "doc int, ord int, section string, body string")
    chosen = sections.select_sections(docs, many, most=100, per_section=60).orderBy("doc", "ord").collect()
    assert [(r.doc, r.section) for r in chosen] == [(1, "Abstract"), (1, "Method"), (2, "Unsectioned excerpt")]
    assert [len(r.excerpt) for r in chosen[:2]] == [59, 40] or sum(len(r.excerpt) for r in chosen[:2]) <= 100
    claims = spark.createDataFrame([(1, "a", "methods", "METHOD  line"), (1, "b", "Results", "method line"), (1, "c", "Appendix", "x"), (1, "d", None, "x")], "doc int, claim string, source_section string, supporting_text string")
    got = {r.claim: (r.source_section, r.supporting_text) for r in sections.validate_evidence(claims, sections.detect_sections(docs)).collect()}
    assert got == {"a": ("Method", "METHOD  line"), "b": (None, None), "c": (None, None), "d": (None, None)}


def test_coverage_gaps(spark):
    rows = cards(spark, *({"methods": [m], "datasets": [d]} for m, d in (("Diffusion  Model", "Brain MRI"), ("Diffusion Model", "Brain MRI"), ("GAN", "Liver MRI Dataset"), ("Transformer", "Liver MRI Dataset"))))
    got = gaps.coverage_gaps(rows, gaps.build_facets(rows)).collect()
    assert [(r.method, r.value, r.dimension) for r in got] == [("Diffusion Model", "Liver MRI Dataset", "dataset")]
    thin = cards(spark, {"methods": ["M1"], "datasets": ["D1"]}, {"methods": ["M1"]}, {"methods": ["M2"]}, {"methods": ["M2"]}, {"methods": ["M3"]})
    assert gaps.coverage_gaps(thin, gaps.build_facets(thin)).count() == 0


def test_evaluation_gaps(spark):
    rows = cards(spark, {"methods": ["CNN net"], "evaluation_conditions": judged("Domain shift tests", status="explicitly_absent")}, {"methods": ["CNN net"], "evaluation_conditions": judged("noise", status="unknown")})
    got = gaps.evaluation_gaps(rows, gaps.build_facets(rows)).collect()
    assert [(r.method, r.condition, r.papers, r.absent) for r in got] == [("CNN net", "domain shift", 2, 1)]


@pytest.mark.parametrize(("a", "b", "want"), [({}, {}, ("compatible", 0.75, False)), ({"datasets": ["x"]}, {"datasets": ["y"]}, ("partially_compatible", 0.6, True)), ({"metrics": ["dice"]}, {"metrics": ["latency"]}, None)])
def test_contradictions(spark, a, b, want):
    base = {"problem": "segmentation", "tasks": judged("segmentation"), "modalities": judged("mri"), "metrics": ["dice"], "datasets": ["fastMRI"]}
    claim = lambda s: {"main_claims": [(s, "Results", None)]}
    rows = cards(spark, base | claim("Spectral regularization improves robustness under scanner shift.") | a, base | claim("Spectral regularization degrades performance under scanner shift.") | b)
    got = gaps.contradictions(rows, gaps.build_facets(rows)).collect()
    assert [(r.status, r.confidence, r.conditioned) for r in got] == ([want] if want else [])
    if got:
        assert got[0].concept == "regularization scanner shift" and (got[0].paper_a, got[0].paper_b) == ("p1", "p2")


def test_generic_terms_alone_are_no_concept(spark):
    rows = cards(spark, {"main_claims": [("The proposed model improves performance", None, None)]}, {"main_claims": [("The proposed model degrades performance", None, None)]})
    assert gaps.contradictions(rows, gaps.build_facets(rows)).count() == 0


def test_method_transfers(spark):
    rows = cards(spark, *[{"methods": ["Spectral Regularization"], "tasks": judged("segmentation")}] * 2, *[{"methods": ["U-Net"], "tasks": judged("reconstruction")}] * 2)
    got = {(r.method, r.source, r.target, r.method_class, r.confidence) for r in gaps.method_transfers(rows, gaps.build_facets(rows)).collect()}
    assert got == {("Spectral Regularization", "segmentation", "reconstruction", "generic_regularizer", 0.64), ("U-Net", "reconstruction", "segmentation", "architecture_component", 0.6)}
    assert [one(spark, gaps.method_class, m) for m in ("YOLO head", "Focal loss", "Distillation", "Thing")] == ["task_specific_head", "loss_objective", "training_strategy", "unknown"]


@pytest.mark.parametrize("mode", ["linked", "first_fit"])
def test_explicit_gaps(spark, mode):
    rows = cards(spark, {"limitations": ["Performance degrades severely under scanner domain shift."]}, {"limitations": ["Generalization across scanner domain shift remains limited."]}, {"future_work": ["Something wholly different"]})
    grouped = gaps.group_statements(gaps.limitation_statements(gaps.build_facets(rows)), mode=mode)
    got = gaps.explicit_gaps(grouped).collect()
    assert [(r.papers, r.statements, r.evidence_score, r.confidence, r.theme) for r in got] == [(2, 2, 0.8, 0.5, "scanner domain shift")]
    assert got[0].gap_id.startswith("gap-explicit-t-")


CANDIDATE = "id string, topic string, gap_type string, title string, research_question string, supporting_papers array<string>, conflicting_papers array<string>, confidence double, caveats array<string>"


def candidate(spark, **over):
    base = dict(id="c", topic="t", gap_type="explicit", title="Repeated limitation in mri: scanner shift", research_question="how can methods address scanner domain shift robustness?", supporting_papers=["p1"], conflicting_papers=[], confidence=0.5, caveats=["one"])
    return spark.createDataFrame([tuple({**base, **over}.values())], CANDIDATE)


def test_derived_queries(spark):
    got = [r.query for r in critic.derive_queries(candidate(spark)).orderBy("pos").collect()]
    assert got == ["mri: scanner shift", "scanner domain shift robustness", "scanner domain shift benchmark review", "scanner domain robustness solution"]


@pytest.mark.parametrize(
    ("claim", "fetched", "warning", "want"),
    [(None, None, [None], ("preserved", 0.65)), (None, "scanner domain shift again", [None], ("downgraded", 0.35)), (None, None, [None, "arxiv was unavailable"], ("downgraded", 0.35)), (None, "scanner domain shift", ["a", "b"], ("downgraded", 0.35)),
     ("Robustness to scanner domain shift is solved", "scanner domain shift", [None], ("rejected", 0.0)), ("Segmentation under scanner domain shift", None, [None], ("preserved", 0.65))],
)
def test_decisions(spark, claim, fetched, warning, want):
    found = candidate(spark, title="Repeated limitation in mri reconstruction")
    task = "segmentation" if claim and claim.startswith("Seg") else "reconstruction"
    rows = cards(spark, {"paper_id": "p9", "tasks": judged(task), "main_claims": [(claim, None, None)] if claim else []})
    papers = paper(spark, {"id": "f", "title": fetched or "other"})
    fresh = spark.createDataFrame([("c", 1, 1, "f")], "id string, pos int, rank int, paper_id string")
    state = spark.createDataFrame([(f"s{i}", w) for i, w in enumerate(warning)], "source string, warning string")
    support = found.select("id", F.explode("supporting_papers").alias("paper_id"))
    got = critic.decide(found, critic.memory_invalidation(found, rows, support), critic.overlap_check(found, fresh, papers, support), state).first()
    assert (got.decision, got.new_confidence) == want and got.caveats[0] == "one"
    log = critic.retrieval_log(critic.derive_queries(found), fresh, state, F.lit(NOW)).orderBy("pos").collect()
    assert log[0].retrieved_paper_ids == ["f"] and log[0].result_count == 1 and len(log[0].failed_sources) == sum(w is not None for w in warning)


def test_reviews_are_numbered_on(spark):
    review = lambda *ids: spark.createDataFrame([(i, "preserved", NOW) for i in ids], "candidate_id string, decision string, created_at timestamp")
    known = spark.createDataFrame([("c", 1)], "candidate_id string, review_version int")
    new, rejected = critic.append_reviews(known, review("c", "c", "nope"), candidate(spark))
    assert sorted((r.candidate_id, r.review_version) for r in new.collect()) == [("c", 2), ("c", 3)] and rejected.count() == 1


def test_watch(spark):
    t = lambda d: NOW + timedelta(d)
    rows = spark.createDataFrame([("w", "p", 0.8, t(2)), ("w", "p", 0.2, t(1)), ("w", "q", float("nan"), t(1)), ("x", "p", 0.9, t(1))], "watch_topic_id string, paper_id string, rank_score double, seen_at timestamp")
    topics = spark.createDataFrame([("w", "W", True)], "id string, name string, enabled boolean")
    good, bad = watch.valid_sightings(rows, topics)
    assert good.count() == 2 and sorted(r.reason for r in bad.collect()) == ["rank_score must be finite", "unknown watch_topic_id"]
    first = watch.track_discoveries(None, good)
    again = watch.track_discoveries(first.drop("is_new"), good.withColumn("rank_score", F.lit(0.1)))
    assert [(r.rank_score, r.is_new, r.first_seen_at) for r in again.collect()] == [(0.8, False, t(1))]
    sent = watch.mark_notified(first.drop("is_new"), watch.pending_notifications(first, least=0.7), F.lit(t(9)))
    assert [r.marked for r in sent.collect()] == [True] and watch.pending_notifications(sent).count() == 0
    state = watch.scan_state(topics.withColumns({"last_scan_at": F.lit(None).cast("timestamp"), "last_error": F.lit(None).cast("string")}), spark.createDataFrame([("w", t(1), None), ("w", t(2), "it   failed")], "watch_topic_id string, scanned_at timestamp, error string")).first()
    assert (state.last_scan_at, state.last_error) == (t(1), "it failed")


def test_digest(spark):
    t = lambda d: NOW + timedelta(d)
    items = spark.createDataFrame([("old", "Old", t(-9)), ("new", "New", t(0)), ("out", "Out", t(1))], "id string, title string, first_discovered_at timestamp")
    seen = spark.createDataFrame([("w", "old", t(0), t(0), 0.4)], "watch_topic_id string, paper_id string, first_seen_at timestamp, last_seen_at timestamp, rank_score double")
    topics = spark.createDataFrame([("w", "Topic")], "id string, name string")
    days = spark.createDataFrame([(t(0), t(1))], "period_start timestamp, period_end timestamp")
    found = watch.digest_candidates(items, seen, topics, days)
    assert [(r["rank"], r.paper_id, r.topic_names) for r in found.orderBy("rank").collect()] == [(1, "old", ["Topic"]), (2, "new", [])]
    counts, top, active = watch.build_digest(found, 1)
    assert counts.first().paper_count == 2 and top.count() == 1 and active.first().papers == 1
    runs = lambda *rows: spark.createDataFrame(rows, "period_start timestamp, period_end timestamp, status string")
    due = lambda r: sorted((x.period_start, x.period_end) for x in watch.digest_periods(r, F.lit(t(2))).collect())
    assert due(runs((t(0), t(1), "sent"))) == [(t(1), t(2))]
    assert due(runs((t(0), t(1), "sent"), (t(1), t(2), "failed"))) == [(t(1), t(2))]
    assert due(runs((t(0), t(2), "sent"))) == [] and due(runs((t(1), t(2), "running"))) == []
    insight = watch.pick_insight(cards(spark, {"methods": ["M"]}, {"main_claims": [("C", "Results", None)], "methods": ["M"]}, {})).orderBy("paper_id").collect()
    assert [(r.kind, r.text) for r in insight] == [("Method", "M"), ("Stored claim", "C")]


def test_stream_equals_batch(spark, tmp_path):
    from corpusloom.streaming import watch as streaming

    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), str(rnd.randrange(9)), rnd.random(), NOW + timedelta(hours=rnd.randrange(99))) for _ in range(120)]
    for i in range(4):
        spark.createDataFrame(rows[i::4], streaming.SIGHTING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(streaming.SIGHTING).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streaming.run_tracking(source, str(tmp_path / "state"), lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}")))
    got = streaming.latest(spark.read.parquet(str(tmp_path / "out")))
    want = watch.first_and_last(spark.createDataFrame(rows, streaming.SIGHTING))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    out = streaming.new_discoveries(source).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state2")).trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"new/batch={n}"))).start()
    out.awaitTermination()
    new = spark.read.parquet(str(tmp_path / "new"))
    assert new.where("is_new").count() == want.count()
    last = new.groupBy("watch_topic_id", "paper_id").agg(F.min("first_seen_at"), F.max("last_seen_at"), F.max("rank_score"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_daily_stream(spark, tmp_path):
    from corpusloom.streaming import watch as streaming

    rows = [("w", NOW + timedelta(hours=h), 0.1 * h) for h in (1, 2, 30, 24 * 20)]
    spark.createDataFrame(rows, "watch_topic_id string, first_seen_at timestamp, rank_score double").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("watch_topic_id string, first_seen_at timestamp, rank_score double").parquet(str(tmp_path / "in"))
    query = streaming.daily_stream(source).writeStream.outputMode("append").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.period_start, r["items"]) for r in spark.table("daily").collect())
    assert got == [(NOW, 2), (NOW + timedelta(1), 1)]


def test_upsert_and_guards(spark):
    base = spark.createDataFrame([(1, "a", 5, NOW, NOW), (2, "b", 1, NOW, NOW)], "id int, name string, n int, created_at timestamp, updated_at timestamp")
    new = spark.createDataFrame([(1, None, 3, 1, NOW + timedelta(1)), (1, "longer", 4, 2, NOW + timedelta(2)), (3, "c", 9, 1, NOW), (None, "x", 1, 1, NOW)], "id int, name string, n int, ord int, updated_at timestamp")
    got = sorted((r.id, r.name, r.n, r.updated_at) for r in upsert.upsert_snapshot(base, new, ["id"], {"n": "max", "name": "richer"}).collect())
    assert got == [(1, "longer", 5, NOW + timedelta(2)), (2, "b", 1, NOW), (3, "c", 9, NOW)]
    good, bad = upsert.check_parents(new.select("id"), {"id": (base, "id")})
    assert (good.count(), [r.reason for r in bad.collect()]) == (2, ["unknown id", "unknown id"])
    assert [r.n for r in upsert.check_unique(new, F.col("name")).collect()] == []
    assert upsert.cascade_delete({"c": (new, "id")}, base.where("id = 1"), "id")["c"].count() == 2


def test_openalex_feed(spark, tmp_path):
    page = """{"results":[{"id":"https://x.org/W1","title":" A robust method ","abstract_inverted_index":{"robust":[1],"A":[0],"method":[2]},"authorships":[{"author":{"display_name":"Ada"}},{"author":{"display_name":" "}}],"publication_year":2025,"primary_location":{"source":{"display_name":"Journal"},"landing_page_url":"https://example.test/paper"},"doi":"https://doi.org/10.1000/Example","ids":{"pmid":"99","ignored":{"nested":true}},"cited_by_count":4},{"id":"https://x.org/W2"}]}"""
    (tmp_path / "a.json").write_text(page)
    rows = feeds.read_openalex(spark, str(tmp_path / "a.json")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.id, r.title, r.abstract, r.authors, r.publication_year, r.venue, r.doi, r.url, r.citation_count) == ("openalex:W1", "A robust method", "A robust method", ["Ada"], 2025, "Journal", "10.1000/example", "https://example.test/paper", 4)
    assert r.external_ids == {"pmid": "99", "openalex": "W1", "doi": "10.1000/example"}
    assert one(spark, feeds.inverted_abstract, '{"a":[1,"bad"],"start":[0]}') == "start a" and one(spark, feeds.inverted_abstract, "[]") is None and one(spark, feeds.inverted_abstract, '{"a":[0],"b":[0]}') == "b"


def test_other_feeds(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"data":[{"paperId":"S1","externalIds":{"DOI":"10.1/Q","ArXiv":"2401.5v2","CorpusId":"7"},"title":"T","abstract":" ","authors":[{"name":"B"}],"year":2024,"citationCount":-1}]}')
    s = feeds.read_semantic_scholar(spark, str(tmp_path / "s.json")).first()
    assert (s.id, s.abstract, s.doi, s.citation_count, s.publication_year) == ("semantic_scholar:S1", None, "10.1/q", None, 2024) and s.external_ids == {"doi": "10.1/q", "arxiv": "2401.5", "semantic_scholar": "S1"}
    (tmp_path / "a.xml").write_text('<feed xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/2401.01234v2</id><title>Two\n  lines</title><summary> sum  it </summary><published>2024-01-02T00:00:00Z</published><author><name>C  D</name></author><arxiv:doi>10.1/Z</arxiv:doi></entry><entry><id>x</id><title>Error</title></entry></feed>')
    rows = feeds.read_arxiv(spark, str(tmp_path / "a.xml")).collect()
    assert [(r.id, r.title, r.abstract, r.authors, r.publication_year, r.doi) for r in rows] == [("arxiv:2401.01234", "Two lines", "sum it", ["C D"], 2024, "10.1/z")]
    both, report = feeds.union_feeds({"openalex": None, "arxiv": feeds.read_arxiv(spark, str(tmp_path / "a.xml"))})
    assert both.count() == 1 and {r.source: r.papers for r in report.collect()} == {"openalex": None, "arxiv": 1}
    with pytest.raises(ValueError, match="all feeds"):
        feeds.union_feeds({"openalex": None})


def test_text_gate(spark):
    docs = spark.createDataFrame([("a" * 200,), ("." * 300,), (None,), ("b" * 250_001,)], "text string")
    assert [r.reject_reason for r in feeds.text_gate(docs).collect()] == [None, "too_little_text", "too_little_text", "too_long"]


def test_snapshots(spark, tmp_path):
    path = memory.write_snapshot(stored(spark, {}), str(tmp_path), "papers", 1)
    assert path.endswith("v=1") and memory.read_snapshot(spark, str(tmp_path), "papers", 1).first().id == "m1"


def test_statement_links_as_brute_force(spark):
    rnd = random.Random(3)
    words = [a + b for a in "bcdgk" for b in ("al", "em", "in", "or")]
    rows = [(f"t{k % 3}", f"p{k}", "limitations[0]", " ".join(rnd.sample(words, rnd.choice([1, 1, 2, 2, 3, 4]))), k) for k in range(120)]
    given = spark.createDataFrame(rows, "topic string, paper_id string, field string, statement string, place int")
    root = {k: k for *_, k in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for topic, _, _, said, k in rows:
        for other, _, _, heard, j in rows[:k]:
            a, b = set(said.split()), set(heard.split())
            if topic == other and (len(a & b) >= 2 or len(a & b) / len(a | b) >= 0.35):
                root[find(max(k, j))] = find(min(k, j))
    want = {k: min(j for j in root if find(j) == find(k)) for k in root}
    got = {r.place: r.group for r in gaps.group_statements(given).collect()}
    first = {(r.topic, r.nth): r.place for r in gaps.group_statements(given).collect()}
    topics = {k: t for t, *_, k in rows}
    assert {k: first[topics[k], g] for k, g in got.items()} == want


def test_entry_without_the_subpackage(tmp_path):
    """Without the training-data folders and the pipeline all other queries are there."""
    top = Path(__file__).resolve().parent.parent
    shutil.copytree(top / "corpusloom", tmp_path / "corpusloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = set(e.queries()), set(e.oracle_sql()); assert o <= q and {'lexical_topk', 'coverage_gaps'} <= q and not any(x.startswith('op') or x == 'pipeline' for x in q); print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[-1]) > 50
