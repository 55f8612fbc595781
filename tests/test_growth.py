"""Memory kept up by batches, and dictionary joins by substring, against whole solves and brute force."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import components, dictionary, gaps, incremental, resolve
from corpusloom.operators.components import connected_components, cut_lineage

from .test_memory import NOW, cards, paper, stored


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(params=[components.BROADCAST_BYTES, -1], ids=["broadcast", "shuffled"])
def bound(request, monkeypatch):
    monkeypatch.setattr(components.few, "__defaults__", (None, request.param))


# -- components ----------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1])
def test_components_for_any_batches(spark, bound, seed):
    rnd = random.Random(seed)
    links = [(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(45)] + [("n1", None), (None, None), ("n7", "n7"), ("z", "z")]
    rnd.shuffle(links)
    known = spark.createDataFrame([], "node string, component string")
    for k in range(3):
        batch = spark.createDataFrame(links[k::3], "src string, dst string")
        for _ in range(2 if k == 1 else 1):  # a batch that comes again changes nothing
            known = cut_lineage(incremental.replaced(known, cut_lineage(incremental.grow_components(known, batch)), ["node"]))
    assert rows_of(known) == rows_of(connected_components(spark.createDataFrame(links, "src string, dst string")))


def test_untouched_components_are_not_returned_or_shuffled(spark, tmp_path):
    spark.createDataFrame([(f"{a}{i}", f"{a}0") for a in "abc" for i in range(5)], "node string, component string").write.parquet(str(tmp_path / "t"))
    known = spark.read.parquet(str(tmp_path / "t"))
    links = spark.createDataFrame([("b3", "c1"), ("b2", "new")], "src string, dst string")
    changed = cut_lineage(incremental.grow_components(known, links))
    assert rows_of(changed) == sorted([(f"c{i}", "b0") for i in range(5)] + [("new", "b0")], key=repr)
    again = incremental.replaced(known, changed, ["node"])
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert again.count() == 16
    empty = spark.createDataFrame([], "src string, dst string")
    assert incremental.grow_components(known, empty).count() == 0


# -- papers ----------------------------------------------------------------------------------


def random_records(rnd, n):
    out = []
    for i in range(n):
        doi = f"10.1/{rnd.randrange(n)}" if rnd.random() < 0.5 else None
        title = f"A shared title {rnd.randrange(n)}" if rnd.random() < 0.7 else "short"
        out.append({"id": f"p{i:03}", "doi": doi, "title": title, "abstract": "x" * rnd.randrange(5) or None, "citation_count": rnd.randrange(9), "publication_year": 2000 + i, "external_ids": {"openalex": f"W{i}"}, "authors": ["a"] * rnd.randrange(3)})
    return out


FIELDS = ["id", "canonical_key", "title", "abstract", "authors", "publication_year", "doi", "citation_count", "normalized_title", "first_discovered_at", "created_at", "updated_at"]


@pytest.mark.parametrize("seed", [3])
def test_one_batch_is_the_whole_upsert(spark, bound, seed):
    rnd = random.Random(seed)
    old = [{"id": f"m{i}", "canonical_key": f"k{i}", "doi": f"10.1/{rnd.randrange(12)}" if i % 2 else None, "title": f"A shared title {rnd.randrange(12)}", "created_at": NOW + timedelta(i % 3), "citation_count": i} for i in range(8)]
    memory = stored(spark, *old)
    sources = spark.createDataFrame([("m1", "openalex", "W3"), ("m2", "openalex", "W9")], "paper_id string, provider string, external_id string")
    incoming, now = paper(spark, *random_records(rnd, 24)), F.lit("2026-03-01").cast("timestamp")
    first = incremental.start_memory(memory, sources)
    state = cut_lineage(first.papers), cut_lineage(first.keys)
    changes = incremental.upsert_batch(*state, incoming, now)
    got, keys = map(cut_lineage, incremental.next_state(*state, changes))
    assert rows_of(got.select(FIELDS)) == rows_of(resolve.upsert_papers(memory, sources, incoming, now).select(FIELDS))
    assert keys.groupBy("key").count().where("count > 1").count() == 0
    assert keys.join(got, keys.paper_id == got.id, "left_anti").count() == 0
    # once more: nothing but the time
    changes = incremental.upsert_batch(got, keys, incoming, now)
    assert changes.moved.count() == changes.keys.count() == 0
    assert rows_of(incremental.next_state(got, keys, changes)[0].select(FIELDS)) == rows_of(got.select(FIELDS))


def test_batches_remember_every_key_and_touch_no_others(spark):
    """The second record's title is lost in the merged paper; a third one meets it all the same and joins two papers."""
    now = F.lit("2026-03-01").cast("timestamp")
    empty_sources = spark.createDataFrame([], "paper_id string, provider string, external_id string")
    start = incremental.start_memory(stored(spark, {"id": "m1", "doi": "10.1/a", "title": "The much longer first title"}, {"id": "m2", "canonical_key": "k2", "title": "Another paper of its own", "created_at": NOW + timedelta(1)}, {"id": "m3", "canonical_key": "k3", "title": "Nobody asks for it"}), empty_sources)
    state = start.papers, start.keys
    one = incremental.upsert_batch(*state, paper(spark, {"id": "x1", "doi": "10.1/a", "title": "Shorter name"}), now)
    assert [r.id for r in one.papers.collect()] == ["m1"] and one.moved.count() == 0
    state = tuple(map(cut_lineage, incremental.next_state(*state, one)))
    assert {r.title for r in state[0].collect()} == {"The much longer first title", "Another paper of its own", "Nobody asks for it"}
    two = incremental.upsert_batch(*state, paper(spark, {"id": "x2", "title": "Shorter name", "external_ids": {"openalex": "W1"}}, {"id": "x3", "title": "Another paper of its own", "external_ids": {"openalex": "W1"}}), now)
    assert rows_of(two.moved) == [("m2", "m1")] and [r.id for r in two.papers.collect()] == ["m1"]
    papers, keys = map(cut_lineage, incremental.next_state(*state, two))
    assert sorted(r.id for r in papers.collect()) == ["m1", "m3"]
    assert {r.paper_id for r in keys.where("key LIKE '%another paper%' OR key = 'key:k2'").collect()} == {"m1"}
    nothing = incremental.upsert_batch(papers, keys, paper(spark, {"id": "z"}).limit(0), now)
    assert nothing.papers.count() == nothing.keys.count() == 0


# -- dictionaries ------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [5, 6])
def test_entries_by_brute_force(spark, bound, seed):
    rnd = random.Random(seed)
    said = lambda n: "".join(rnd.choice("abcß\n😀.") for _ in range(n))
    texts = [(i, said(rnd.choice([0, 3, 40, 400]))) for i in range(40)] + [(90, None), (None, "abc"), (1, "abcabc"), (91, "lead " * 4000 + "the very last words")]
    entries = [said(rnd.choice([1, 2, 3, 4, 5, 6, 7, 9])) for _ in range(300)] + ["", None, "very last", "a.c", "lead " * 60]
    got = dictionary.find_entries(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(e,) for e in entries + entries[:9]], "entry string"))
    want = {(i, e) for i, t in texts for e in entries if i is not None and t is not None and e and e in t}
    assert len(rows_of(got)) == len(want) and set(rows_of(got)) == want


def test_empty_tables(spark):
    none, texts = spark.createDataFrame([], "entry string"), spark.createDataFrame([(1, "text")], "id int, text string")
    assert dictionary.find_entries(texts, none).count() == 0
    assert dictionary.find_entries(texts.limit(0), spark.createDataFrame([("e",)], "entry string")).count() == 0


def test_first_entry_either_way(spark):
    rnd = random.Random(7)
    said = lambda n: "".join(rnd.choice("abcd ") for _ in range(n))
    entries = [(said(rnd.randrange(2, 7)), i) for i in range(60)]
    entries += [(entries[5][0], 99)]
    values = [said(rnd.randrange(0, 9)).upper() for _ in range(200)] + ["  ", None, "none of them: xyz"]
    got = dictionary.first_entry(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame(entries, "entry string, nth int"))
    clean = lambda v: v.strip(" ").lower()
    want = {(v, clean(v), next((e for e, _ in entries if e in clean(v) or clean(v) in e), clean(v))) for v in values if v and clean(v)}
    assert set(rows_of(got)) == want and got.count() == len(want)


def test_phrases_of_a_table_as_the_fixed_ones(spark):
    texts = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate([("a", f"x {p.upper()} y") for p in T.ABSOLUTE_PHRASES] + [("b", "nothing"), (None, T.ABSOLUTE_PHRASES[0]), ("a", T.ABSOLUTE_PHRASES[0]), ("a", None)])], "id int, source string, text string")
    got = dictionary.scan_phrases(texts, spark.createDataFrame([(p,) for p in T.ABSOLUTE_PHRASES], "phrase string"), "id", "source", "text")
    assert rows_of(got) == rows_of(gaps.scan_claims(texts, "source", "text"))


def test_evaluation_gaps_of_a_table_of_conditions(spark):
    said = lambda *names: [(n, "explicitly_absent", "Limits", "not tested") for n in names]
    rows = cards(spark, {"methods": ["U-Net"], "evaluation_conditions": said("domain shift study", "night time")}, {"methods": ["U-Net"], "evaluation_conditions": said("noise", "rain")})
    facets = cut_lineage(gaps.build_facets(rows))
    standard = spark.createDataFrame([(c, i) for i, c in enumerate(gaps.CONDITIONS)], "entry string, nth int")
    plain = gaps.evaluation_gaps(rows, facets)
    assert rows_of(gaps.evaluation_gaps(rows, facets, conditions=standard).select(plain.columns)) == rows_of(plain) and plain.count() == 2
    own = standard.limit(0).union(spark.createDataFrame([("night time driving", 1), ("rain", 2)], "entry string, nth int"))
    assert {r.condition for r in gaps.evaluation_gaps(rows, facets, conditions=own).collect()} == {"night time driving", "rain"}
