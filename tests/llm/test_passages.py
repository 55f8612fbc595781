"""Substring dedup against all windows of 40 words."""

import random

import pytest

from corpusloom.llm import paragraphs
from corpusloom.llm.words import split_words

N = 40


def words(rnd, n):
    return [f"w{rnd.randrange(10**7)}" for _ in range(n)]


def nested(rnd, families):
    """Passages of 60 words, whole in two texts and in part in earlier and later ones, at no matter which side, among words of their own."""
    texts = []
    for _ in range(families):
        p = words(rnd, 60)
        cuts = [(rnd.randrange(0, 30), rnd.randrange(36, 61)) for _ in range(rnd.randrange(1, 4))]
        group = [p[a:b] for a, b in cuts] + [p, p] + [p[rnd.randrange(0, 15) : rnd.randrange(45, 61)] for _ in range(rnd.randrange(3))]
        rnd.shuffle(group)
        texts += [words(rnd, rnd.randrange(0, 30)) + g + words(rnd, rnd.randrange(0, 30)) for g in group]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    return [(i, " ".join(texts[k])) for i, k in enumerate(order)]


def earlier_windows(rows):
    """For each text the words that lie in a window of 40 that stands earlier: in a text of a smaller id, or 40 words before."""
    first, out = {}, {}
    for doc, text in sorted(rows):
        own = split_words((text or "").encode())
        covered = set()
        for i in range(len(own) - N + 1):
            key = tuple(own[i : i + N])
            d, j = first.setdefault(key, (doc, i))
            if d != doc or i >= j + N:
                covered.add(i)
        out[doc] = covered
    return out


def removed_words(rows, got):
    texts = dict(rows)
    out = {}
    for r in got:
        if r.removed:
            start = len(split_words(texts[r.doc_id][: r["from"]].encode()))
            out.setdefault(r.doc_id, []).append((start, start + r.n_words))
    return out


def spans(spark, tmp_path, rows, monkeypatch=None):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).write.parquet(path)
    return paragraphs.repeated_spans(spark.read.parquet(path)).collect()


def check(rows, got):
    held = removed_words(rows, got)
    wanted = earlier_windows(rows)
    lost = [(d, i) for d, windows in wanted.items() for i in windows if not any(a <= i and i + N <= b for a, b in held.get(d, []))]
    assert not lost, (len(lost), lost[:5])
    assert sum(map(len, wanted.values())) > 0
    # nothing else is removed: every removed word stands at an earlier place, with 20 words around it at least
    grams, covered = {}, {}
    for doc, text in sorted(rows):
        own = split_words((text or "").encode())
        for i in range(len(own) - 19):
            key = tuple(own[i : i + 20])
            d, j = grams.setdefault(key, (doc, i))
            if d != doc or i >= j + N:
                covered.setdefault(doc, set()).update(range(i, i + 20))
    assert all(set(range(a, b)) <= covered.get(d, set()) for d, some in held.items() for a, b in some)


@pytest.mark.parametrize("hot", [2_000, 2])
def test_every_window_with_an_earlier_copy_is_removed(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(paragraphs.verbatim_passages, "__defaults__", (hot,))
    rnd = random.Random(21)
    rows = nested(rnd, 60 if hot > 2 else 12)
    check(rows, spans(spark, tmp_path, rows))


def test_the_partly_held_passage_of_two_later_texts(spark, tmp_path):
    rnd = random.Random(22)
    rows = []
    for k in range(40):
        p = words(rnd, 60)
        rows += [(k, " ".join(words(rnd, 25) + p[12:48] + words(rnd, 25)))]
        rows += [(1000 + 2 * k + j, " ".join(words(rnd, 20) + p + words(rnd, 20))) for j in range(2)]
    got = spans(spark, tmp_path, rows)
    assert sorted((r.doc_id, r.n_words) for r in got if r.removed) == [(1001 + 2 * k, 60) for k in range(40)]


def test_a_very_common_passage_among_different_words(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(paragraphs.verbatim_passages, "__defaults__", (10,))
    rnd = random.Random(23)
    p, few = words(rnd, 45), words(rnd, 6)
    tail = lambda: [rnd.choice(few) for _ in range(30)]  # noqa: E731  beginnings are shared by some
    rows = [(i, " ".join(tail() + p + tail())) for i in range(120)] + [(500 + i, " ".join(p)) for i in range(5)] + [(600, " ".join(p * 5)), (601, None), (602, "")]
    check(rows, spans(spark, tmp_path, rows))


def test_common_passages_take_few_jobs_and_match_as_rare_ones_do(spark, tmp_path, monkeypatch):
    rnd = random.Random(26)
    p = words(rnd, 70)
    texts = [words(rnd, 30) + p[rnd.randrange(25) :][: rnd.randrange(42, 60)] + words(rnd, rnd.randrange(30)) for _ in range(40)] + [p * 3, p[:50] * 2, p[8:56], p[8:57]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rare = spans(spark, tmp_path / "rare", rows)
    monkeypatch.setattr(paragraphs.verbatim_passages, "__defaults__", (2,))
    cuts, cut = [], paragraphs.cut_lineage
    monkeypatch.setattr(paragraphs, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    common = spans(spark, tmp_path / "common", rows)
    as_rows = lambda got: sorted((r.doc_id, r["from"], r["to"], r.n_words, r.removed, r.keep_ids) for r in got)
    assert as_rows(common) == as_rows(rare)
    assert len(cuts) <= 20  # one for each of the words that agree would be 40 more
    check(rows, common)


def test_texts_that_repeat_themselves(spark, tmp_path):
    rnd = random.Random(24)
    a, b = words(rnd, 30), words(rnd, 7)
    rows = [(1, " ".join(["same"] * 150)), (2, " ".join(a * 6)), (3, " ".join(words(rnd, 5) + b * 30 + words(rnd, 50))), (4, " ".join(words(rnd, 9) + b * 20 + ["same"] * 90 + words(rnd, 9))), (5, " ".join(a * 4 + ["same"] * 41))]
    check(rows, spans(spark, tmp_path, rows))


def test_matches_are_the_longest_with_an_earlier_place():
    rnd = random.Random(25)
    for _ in range(60):
        rows = sorted((rnd.randrange(6), rnd.randrange(150)) for _ in range(25))
        rows = [(r, a, bytes(x for _ in range(rnd.randrange(7)) for x in (rnd.randrange(2), 0, 0, 0))) for r, a in rows]
        got = {i: (j, m) for i, j, m in paragraphs.matches(rows, 40)}
        for i, (rid, at, own) in enumerate(rows):
            best = -1
            for r, a, other in rows[:i]:
                if r != rid or a + 40 <= at:
                    m = 0
                    while m < min(len(own), len(other)) // 4 and own[4 * m : 4 * m + 4] == other[4 * m : 4 * m + 4]:
                        m += 1
                    best = max(best, m)
            assert got.get(i, (0, -1))[1] == best
