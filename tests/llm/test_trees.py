"""Byte-level BPE, whitening and the Merkle manifest against plain versions, and on awkward rows."""

import base64
import hashlib
import math
import random
import zlib
from array import array
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import byte_bpe, merkle, queries, whitening

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BPE = byte_bpe.ByteBpe(PATH, P.PATTERN)
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, rid string, ids string, tree string, path string, part string, `at` string, x string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else None, s, None if (i or 0) % 7 == 0 else len(t or ""), *["clash"] * 7) for i, t, s in rows], DOCS).repartition(3)


def long_match(rnd, n, alphabet):
    return "".join(rnd.choice(alphabet) for _ in range(n))


def awkward_texts():
    rnd = random.Random(5)
    long = [long_match(rnd, n, letters) for n in (300, 2000, 9000) for letters in ("a", "ab", "abcdefghijklmnop", "éßж中", "!?", "0123456789")]
    mixed = [long_match(rnd, 20_000, "ab  \n\t'lsretvmd 　.,5é中") for _ in range(3)]
    seams = [" " * k + "'" * j + "ll" * 5000 for k in (0, 1, 4095, 4096) for j in (0, 1, 2)] + ["x" * (4096 - k) + tail for k in range(4) for tail in ("'ll go", "  \n a", "'s", " 's", "  ")]
    return [None, "", " ", "<|endoftext|> <|im_end|>", "é" * 3000, *long, *mixed, *seams]


@pytest.mark.parametrize("text", awkward_texts()[1:], ids=lambda t: f"{len(t)}-{t[:6]!r}")
def test_encoding_is_that_of_the_public_library(text):
    ids = [i for found in BPE.matches(text)[1] for i in found]
    assert ids == TIKTOKEN.encode_ordinary(text)
    assert BPE.decoded(array("I", ids)) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab '\n\tlsd5é中.!", max_size=120), st.text(alphabet="ab '\n\tlsd5é中.!", max_size=120))
def test_texts_side_by_side_are_as_the_whole(a, b):
    found, ids = BPE.side_by_side(BPE.matches(a), BPE.matches(b))
    assert found == BPE.find(a + b)
    assert [i for x in ids for i in x] == TIKTOKEN.encode_ordinary(a + b)


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=80), st.binary(max_size=80))
def test_joined_encodings_are_those_of_the_whole(a, b):
    assert BPE.joined(BPE.merged(a), BPE.merged(b)) == BPE.merged(a + b)


def test_long_and_short_merges_agree():
    rnd = random.Random(2)
    for _ in range(200):
        raw = bytes(rnd.choice(b"abcde \xc3\xa9") for _ in range(rnd.randrange(40, 49)))
        pad = raw + b"\x00"  # longer than the short way takes
        assert BPE.merged(raw) + [RANKS[b"\x00"]] == BPE.merged(pad + b"\x00" * 0) or (b"\x00" in raw)
        assert BPE.encoded(raw * 30) == BPE.merged(raw * 30)


def test_small_leaves_change_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "TEXT_LEAF", 8)
    monkeypatch.setattr(byte_bpe, "MATCH_LEAF", 2)
    monkeypatch.setattr(byte_bpe, "ID_LEAF", 1)
    small = byte_bpe.ByteBpe(PATH, P.PATTERN)
    rnd = random.Random(9)
    for _ in range(60):
        text = long_match(rnd, rnd.randrange(400), "abc  '\nlsvert5é中.")
        ids = [i for found in small.matches(text)[1] for i in found]
        assert ids == TIKTOKEN.encode_ordinary(text)
        assert small.decoded(array("I", ids)) == text.encode()


def test_encode_and_decode_rows(spark):
    texts = awkward_texts()
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(3, texts[3], "s"), (3, texts[3], "s"), (None, "no id", None)]
    made = byte_bpe.decode(byte_bpe.encode(docs(spark, rows), PATH, P.PATTERN), PATH, P.PATTERN).collect()
    want = sorted((repr(i), TIKTOKEN.encode_ordinary(t or "")) for i, t, _ in rows)
    assert sorted((repr(r["doc_id"]), array("I", bytes(r["ids"])).tolist()) for r in made) == want
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in made)
    assert sorted(bytes(r["decoded"]) for r in made) == sorted((t or "").encode() for _, t, _ in rows)
    none = byte_bpe.encode(docs(spark, rows).where("false"), PATH, P.PATTERN)
    assert byte_bpe.decode(none, PATH, P.PATTERN).count() == 0


# -- whitening -------------------------------------------------------------------------


def plain_whitening(rows, weights="one", most=16):
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fixed = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in usable]
    counts = {}
    for _, x in fixed:
        counts[x] = counts.get(x, 0) + 1
    distinct = sorted(counts)
    w = [counts[x] if weights == "count" else 1 for x in distinct]
    n, d = sum(w), len(distinct[0])
    sums = [sum(k * x[j] for k, x in zip(w, distinct, strict=True)) for j in range(d)]
    c = np.array([[float(Fraction(n * x[j] - sums[j], n)) for j in range(d)] for x in distinct])
    e, u = np.linalg.eigh((c * np.array(w)[:, None]).T @ c / n)
    order = np.argsort(-e)[:most]
    white = dict(zip(distinct, c @ u[:, order] / np.sqrt(e[order]), strict=True))
    return n, {x: sum((n * a - b) ** 2 for a, b in zip(x, sums, strict=True)) for x in distinct}, fixed, white, e[order] / e.sum()


def vectors(seed=1, n=300, d=20):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(n, d)) * np.linspace(3, 0.3, d)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [rows[5], rows[5], (None, rows[9][1])]
    return rows, [(2000, None), (2001, [*rows[0][1][:-1], None]), (2002, [*rows[0][1][:-1], math.nan]), (2003, [*rows[0][1][:-1], math.inf]), (2004, [1.0, 2.0]), (2005, [])]


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash", "clash", "clash") for i, v in rows], "vec_id bigint, embedding array<float>, label int, x string, w string, white string").repartition(3)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening_is_that_of_the_distinct_vectors(spark, weights):
    good, bad = vectors()
    n, deviations, fixed, white, explained = plain_whitening(good, weights)
    got = whitening.whiten(embeddings(spark, good + bad), weights=weights).collect()
    assert len(got) == 16 * len(good)
    assert {r["n"] for r in got} == {n}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append((r["whitened"], r["deviation"]))
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
    signs = {}
    for i, x in fixed:
        for k in range(16):
            for value, deviation in by[i][k + 1]:
                assert deviation == deviations[x]
                signs.setdefault(k, set()).add(round(value / white[x][k], 6))
    assert all(s in ({1.0}, {-1.0}) for s in signs.values())


def test_whitening_without_variance_or_rows(spark):
    same = [(i, [1.0, 2.0]) for i in range(5)]
    assert whitening.whiten(embeddings(spark, same)).count() == 0
    assert whitening.whiten(embeddings(spark, same).where("false")).count() == 0
    assert whitening.whiten(embeddings(spark, [(1, None), (2, [])])).count() == 0
    flat = whitening.whiten(embeddings(spark, [(1, [0.0, 5.0]), (2, [1.0, 5.0]), (3, [2.0, 5.0])])).collect()
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 6)) for r in flat) == [(1, 1, 1.224745), (2, 1, 0.0), (3, 1, 1.224745)]
    assert {r["explained"] for r in flat} == {1.0}


def test_whitening_of_very_large_entries(spark):
    rows = [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [3e38, 1.0])]
    got = whitening.whiten(embeddings(spark, rows)).collect()
    assert {r["n"] for r in got} == {2}
    assert {r["deviation"] for r in got} == {None}
    assert {round(abs(r["whitened"]), 6) for r in got if r["component"] == 1} == {1.0}


def test_exact_sums_do_not_overflow():
    x, w = np.array([[1 << 62, -5], [(1 << 62) - 1, 7]], np.int64), np.array([3, 4], np.int64)
    assert whitening.exact_sums(x, w) == [3 * (1 << 62) + 4 * ((1 << 62) - 1), 13]
    m = whitening.scaled_deviations(x, 7, [0, 0])
    assert m[0][0] == 7 << 62
    assert whitening.squares(m)[0] is None and whitening.squares(np.array([[3, -4]], np.int64)) == [25]


# -- Merkle manifest --------------------------------------------------------------------


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        now = out[-1]
        out.append([digest("".join(now[i : i + 3])) for i in range(0, len(now), 3)])
    return out


def path_of(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = nodes[i - i % 3 : i - i % 3 + 3]
        out.append((run[: i % 3], run[i % 3 + 1 :]))
        i //= 3
    return out


def plain_manifest(rows):
    """rows of (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        trees[s] = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
    levels = {s: plain_levels([plain_leaf(r) for r in trees[s]]) for s in order}
    top = plain_levels([levels[s][-1][0] for s in order])
    out = []
    for g, s in enumerate(order):
        for i, r in enumerate(trees[s]):
            path = path_of(levels[s], i) + path_of(top, g)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            up = plain_leaf((*r[:4], r[4].replace("\n", ""))) if changed else plain_leaf(r)
            for left, right in path:
                up = digest("".join(left) + up + "".join(right))
            proof = digest("".join("".join(a) + "".join(b) for a, b in path))
            out.append((r[0], plain_leaf(r), levels[s][-1][0], top[-1][0], proof, up, up == top[-1][0]))
    return out


def manifest_rows(spark, tmp_path, rows):
    path = str(tmp_path / "sf")
    docs(spark, rows).write.parquet(f"{path}/documents.parquet")
    got = queries.op13_merkle_manifest(spark, path).collect()
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in got), key=repr)


def full(rows):
    return [(i, s, "en" if (i or 0) % 3 else None, None if (i or 0) % 7 == 0 else len(t or ""), t) for i, t, s in rows]


@pytest.mark.parametrize("sizes", [[1], [3], [4], [1, 1], [10, 1, 28, 2, 9, 81, 82, 3, 1, 5], [800, 1, 27]])
def test_manifest_is_that_of_the_plain_trees(spark, tmp_path, sizes):
    rows, i = [], 0
    for g, n in enumerate(sizes):
        for _ in range(n):
            rows.append((i, f"line {i}\nof {g}" if i % 5 else ("" if i % 2 else None), None if g == 1 else f"s{'é' * g}"))
            i += 1
    random.Random(1).shuffle(rows)
    assert manifest_rows(spark, tmp_path, rows) == sorted(plain_manifest(full(rows)), key=repr)


def test_manifest_of_awkward_rows(spark, tmp_path):
    rows = [(1, "a\nb", "x"), (1, "a\nb", "x"), (1, "a\nb", "x"), (1, "other", "x"), (None, "n", "x"), (None, "n", "x"), (2, "y\n" * 40_000, "x"), (3, None, None), (4, "t", ""), (5, "t", "z")]
    assert manifest_rows(spark, tmp_path, rows) == sorted(plain_manifest(full(rows)), key=repr)


def test_manifest_without_rows(spark):
    proofs, store = merkle.manifest(docs(spark, [(1, "a", "b")]).where("false"))
    assert proofs.count() == 0 and store.count() == 0


def test_store_is_addressed_by_content(spark):
    rows = docs(spark, [(i, f"t{i}", f"s{i % 4}") for i in range(100)])
    proofs, store = merkle.manifest(rows, levels=2)
    kids = {bytes(r["digest"]): bytes(r["children"]) for r in store.collect()}
    assert all(merkle.node_digest(c) == d for d, c in kids.items())
    root = bytes(proofs.first()["root"])
    reached, level = set(), {root}
    while level:  # everything hangs on the root
        reached |= level
        level = {kids[d][i : i + 32] for d in level if d in kids for i in range(0, len(kids[d]), 32)}
    assert {bytes(r["leaf"]) for r in proofs.collect()} <= reached
    assert proofs.where(merkle.folded(F.col("leaf"), F.col("path")) != merkle.as_text(F.col("root"))).count() == 0
