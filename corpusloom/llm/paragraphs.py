"""Substring dedup: paragraph MinHash bands, exact Jaccard and components; verbatim passages wherever they stand."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.components import connected_components, cut_lineage
from .jaccard_join import SHINGLE, SIMILARITY, shingles
from .similar import few, groups, links_within, only, signatures
from .words import HASHES, MULTIPLIER, TO_WORDS, grams, mix, split_words

#: Least hashes that a band takes together. Two are enough where unlike paragraphs share next to no shingles.
BAND_ROWS = 2
TARGET_RECALL = 0.999
#: Words of a repeated span, at least.
SPAN_WORDS = 40


def bands_for(target: float, t: float, rows: int) -> int:
    """Bands after which a pair of similarity t has met with the target's odds."""
    return math.ceil(math.log(1 - target) / math.log(1 - t**rows))


def seeds_for(count: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def band_keys(values: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """For each set a bucket for each band: the least hashes under ``rows`` permutations, and the band's number.

    The sets stand one after the other in ``values``, each from its start.
    """
    least = np.stack([np.minimum.reduceat(mix(values ^ seed), starts) for seed in seeds_for(bands * rows)], 1).reshape(-1, bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), least.shape[:2])
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least[:, :, k])
    return key


def paragraphs_of(text: str, n: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """Code points from and to, and words: lines with n words at least, and between them all shorter lines together."""
    held, at, start, end = [], 0, 0, 0
    for line in text.split("\n"):
        own = split_words(line.encode("utf-8", "surrogatepass"))
        if len(own) >= n:
            if held:
                yield start, end, held
                held = []
            yield at, at + len(line), own
        elif own:
            start = start if held else at
            held.extend(own)
            end = at + len(line)
        at += len(line) + 1
    if held:
        yield start, end, held


def _line_sets(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines with n words at least, the shingle sets of all of them one after the other, and each one's start."""
    g = grams(hashes, n)
    line = np.repeat(np.arange(len(counts)), counts)
    inside = line[: len(g)] == line[n - 1 :][: len(g)]
    g, line = g[inside], line[: len(g)][inside]
    order = np.lexsort((g, line))
    g, line = g[order], line[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (line[1:] != line[:-1])
    g, line = g[new], line[new]
    starts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(g) else np.empty(0, np.int64)
    return line[starts], g, starts


def _doubled(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive words, from halves where k is even."""
    if k % 2 or k < 8:
        return grams(hashes, k)
    half = _doubled(hashes, k // 2)
    return mix(half[: -(k // 2)] * MULTIPLIER + half[k // 2 :]) if len(half) > k // 2 else np.empty(0, np.uint64)


def _sliding(x: np.ndarray, w: int, best: np.ufunc) -> np.ndarray:
    """The best of every w consecutive values, by doubling."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


def anchors(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and hash of some n // 2-word grams; what n words of two texts share, they share one of them (winnowing).

    The texts' words stand one after the other. In a stretch where the same gram comes back again and
    again only some of its places are kept, n // 4 words apart at most where they are that near.
    """
    k = n // 2
    w = n - k + 1
    text = np.repeat(np.arange(len(counts)), counts)
    if len(hashes) < n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    g = _doubled(hashes, k)
    least = _sliding(g, w, np.minimum)
    least[text[: len(least)] != text[n - 1 :]] = 0
    edge = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero((_sliding(np.concatenate([edge, least, edge]), w, np.maximum) == g) & (g > 0))
    h, of = g[at], text[at]
    go_on = np.zeros(len(at), bool)
    go_on[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1]) & (np.diff(at) < w)
    first = np.maximum.accumulate(np.where(go_on, 0, np.arange(len(at)))) if len(at) else np.empty(0, np.int64)
    block = (at - at[first]) // max(1, w // 2)
    kept = ~go_on
    kept[1:] |= block[1:] != block[:-1]
    kept[:-1] |= ~go_on[1:]
    starts = np.cumsum(counts) - counts
    return of[kept], at[kept] - starts[of[kept]], h[kept]


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points from and to of each word of ``split_words``."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.r_[False, np.frombuffer(raw.tobytes().translate(TO_WORDS), np.uint8) != 32, False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    point = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    return point[edges[::2]], point[edges[1::2]]


#: What is known of each paragraph, as arrays of a document's row: plain arrays take a third of the room of structs.
LINE = {"para": "int", "from": "int", "to": "int", "w_from": "int", "n_words": "int", "sig": "bigint", "size": "int"}
_ARROW = {"int": np.int32, "bigint": np.int64}


def _lists(rows: np.ndarray, n: int, values: np.ndarray, each: int = 1) -> pa.ListArray:
    """Values as a list for each of n rows, ``each`` of them for every entry of ``rows``, which says to which row it belongs, in order."""
    return pa.ListArray.from_arrays(pa.array((np.searchsorted(rows, np.arange(n + 1)) * each).astype(np.int32)), pa.array(values))


def _lines(described: DataFrame, bands: int) -> DataFrame:
    """rid, doc_id and a row for each paragraph."""
    own = F.transform("sig", lambda _, i: F.slice("bands", i * bands + 1, F.lit(bands))).alias("bands")
    return described.select("rid", "doc_id", F.arrays_zip(*LINE, own).alias("lines")).select("rid", "doc_id", F.inline("lines"))


def _described(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int, span_words: int) -> DataFrame:
    """rid, doc_id, key and words (of the whole text), the arrays of LINE and ``bands``, and ``at`` and ``h`` of the anchors, of each row.

    A paragraph with n words at least has its place, the signature of its shingles and its bands. Texts of the same words have the same key.
    """

    def made(held: list[tuple], paras: list[tuple], words: list[bytes], counts: list[int]) -> pa.RecordBatch:
        hashes, per_para = HASHES.of(words), np.array(counts, np.int64)
        doc = np.array([p[0] for p in paras], np.int64)
        kept, values, starts = _line_sets(hashes, per_para, n)
        sizes = np.diff(starts, append=len(values))
        if len(kept):
            keys, sigs = np.ascontiguousarray(band_keys(values, starts, bands, rows)).view(np.int64).reshape(-1), signatures(values, starts).view(np.int64)
        else:
            keys, sigs = np.empty(0, np.int64), np.empty(0, np.int64)
        para, start, end, w_from = (np.array([p[i] for p in paras], np.int64)[kept] for i in range(1, 5))
        columns = dict(zip(LINE, (para, start, end, w_from, per_para[kept], sigs, sizes), strict=True))
        per_doc = np.bincount(doc, per_para, len(held)).astype(np.int64) if len(doc) else np.zeros(len(held), np.int64)
        of, at, h = anchors(hashes, per_doc, span_words)
        rid, ids, texts = zip(*held, strict=True)
        lines = [_lists(doc[kept], len(held), columns[c].astype(_ARROW[kind])) for c, kind in LINE.items()]
        found = [_lists(of, len(held), at.astype(np.int32)), _lists(of, len(held), h.view(np.int64))]
        return pa.RecordBatch.from_arrays(
            [pa.array(rid, pa.int64()), pa.array(ids, pa.int64()), pa.array(texts, pa.binary()), pa.array(per_doc), *lines, _lists(doc[kept], len(held), keys, bands), *found],
            ["rid", "doc_id", "key", "words", *LINE, "bands", "at", "h"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, paras, words, counts = [], [], [], []
        for batch in batches:
            for rid, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                n_before, key = 0, blake2b(digest_size=16)
                for para, (start, end, own) in enumerate(paragraphs_of(text.as_py() or "", n)):
                    paras.append((len(held), para, start, end, n_before))
                    n_before += len(own)
                    words += own
                    counts.append(len(own))
                    key.update(b" ".join(own) + b" ")
                held.append((rid, doc, key.digest() if n_before else None))
                if len(words) > 100_000 or len(held) >= 10_000:
                    yield made(held, paras, words, counts)
                    held, paras, words, counts = [], [], [], []
        if held:
            yield made(held, paras, words, counts)

    return docs.select(F.monotonically_increasing_id(), F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, f"rid long, doc_id long, key binary, words long, {', '.join(f'`{c}` array<{kind}>' for c, kind in LINE.items())}, bands array<bigint>, at array<int>, h array<bigint>"
    )


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(sig, shingles) of the wanted (rid, sig, para); the lines are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, packed = [], []
            for text, want in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text = text.as_py()
                places = [(start, end) for start, end, _ in paragraphs_of(text, n)]
                for w in want:
                    sigs.append(w["sig"])
                    packed.append(shingles(text[slice(*places[w["para"]])].encode("utf-8", "surrogatepass"), n).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(packed, pa.binary())], ["sig", "shingles"])

    by_doc = cut_lineage(wanted.groupBy("rid").agg(F.collect_list(F.struct("sig", "para")).alias("want")))
    return _numbered(docs, id_col, text_col).join(few(by_doc, 24 * F.size("want")), "rid").select("text", "want").mapInArrow(run, "sig long, shingles binary")


def _contexts(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str, k: int, reach: int) -> DataFrame:
    """For each place of ``asked`` (rid, at, h) two rows, of side 0 and 1: the hashes of up to ``reach`` words before the anchor, nearest first, and after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(a, 500) for a in range(0, whole.num_rows, 500)):
                rid, doc, place, held, beyond = [], [], [], [], []
                for r, d, text, want in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    low = (HASHES.of(split_words(text.encode("utf-8", "surrogatepass"))) >> np.uint64(32)).astype("<u4")
                    back = low[::-1].tobytes()
                    low, n = low.tobytes(), len(low)
                    for w in want:
                        a = w["at"]
                        rid += (r, r)
                        doc += (d, d)
                        place += (a, a)
                        held += (w["h"], w["h"])
                        beyond += (back[4 * (n - a) : 4 * (n - a + reach)], low[4 * (a + k) : 4 * (a + k + reach)])
                columns = [pa.array(held, pa.int64()), pa.array([0, 1] * (len(rid) // 2), pa.int32()), pa.array(doc, pa.int64()), pa.array(rid, pa.int64()), pa.array(place, pa.int32()), pa.array(beyond, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["h", "side", "doc_id", "rid", "at", "beyond"])

    by_doc = cut_lineage(asked.groupBy("rid").agg(F.collect_list(F.struct("at", "h")).alias("want")))
    rows = _numbered(docs, id_col, text_col).join(few(by_doc, 16 * F.size("want")), "rid").select("rid", "doc_id", "text", "want")
    return rows.mapInArrow(run, "h long, side int, doc_id long, rid long, at int, beyond binary")


#: A match: what stands before (side 0) or after an anchor agrees with an earlier place (removed), or with a later one, for n_more words.
_MATCH = "rid long, doc_id long, at int, side int, n_more int, removed boolean, keep_id long"


def matches(rows: list[tuple[int, int, bytes]], n: int) -> Iterator[tuple[int, int, int]]:
    """Of rows (rid, at, beyond) in order, which have an anchor in common: row, the earlier row with which it has most words in common, and how many.

    An earlier place in the same text counts if it begins n words before at least. All beginnings of what was met are
    held, so the longest one that a row has is found by halving.
    """
    if len(rows) == 2:
        (rid, at, a), (other, place, b) = rows
        if rid != other or place >= at + n:
            m, most = 0, min(len(a), len(b))
            while m < most and a[m : m + 4] == b[m : m + 4]:
                m += 4
            yield 1, 0, m // 4
        return
    seen: dict[bytes, int] = {}
    waiting: list[int] = []
    for i, (rid, at, beyond) in enumerate(rows):
        still = []
        for j in waiting:
            if rows[j][0] == rid and rows[j][1] + n > at:
                still.append(j)
                continue
            other, m = rows[j][2], 0
            if other not in seen:
                for m in range(len(other) // 4, -1, -1):
                    if other[: 4 * m] in seen:
                        break
                    seen[other[: 4 * m]] = j
        waiting = [*still, i]
        if b"" in seen:
            low, high = 0, len(beyond) // 4
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if beyond[: 4 * mid] in seen else (low, mid - 1)
            yield i, seen[beyond[: 4 * low]], low


def _matched(rows: DataFrame, n: int) -> DataFrame:
    """The matches among rows with the same key."""
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("side", pa.int32()), ("n_more", pa.int32()), ("removed", pa.bool_()), ("keep_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        group: list[tuple] = []
        last = None

        def finish() -> None:
            best: dict[int, int] = {}
            for i, j, more in matches([(r[0], r[1], r[4]) for r in group], n):
                rid, at, doc, side, _ = group[i]
                out.append((rid, doc, at, side, more, True, group[j][2]))
                if more >= best.get(j, 0):
                    best[j] = more
            for j, more in best.items():
                rid, at, doc, side, _ = group[j]
                out.append((rid, doc, at, side, more, False, doc))

        for batch in batches:
            key, doc, rid, at, side, beyond = (c.to_pylist() for c in batch.columns)
            for k, *row in zip(key, rid, at, doc, side, beyond, strict=True):
                if k != last:
                    if len(group) > 1:
                        finish()
                    group, last = [], k
                group.append(row)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if len(group) > 1:
            finish()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    order = ["key", F.col("doc_id").isNull(), "doc_id", "rid", "at"]
    rows = rows.select("key", "doc_id", "rid", "at", "side", "beyond").repartition("key").sortWithinPartitions(*order)
    return rows.mapInArrow(run, _MATCH)


def _hot_matches(rows: DataFrame, n: int) -> DataFrame:
    """The matches of anchors with many places: those of ``matches``, with no anchor's rows in one task, by the same few jobs however many words agree.

    Places with all words beyond in common are a class. For every beginning that it shares with others, a class knows the first of all
    places that have it; a place takes the longest beginning whose first place is far enough away.
    """
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid", "at")
    classes = cut_lineage(rows.groupBy("h", "side", "beyond").agg(F.min(place).alias("own"), F.count("*").alias("n")))
    begun = classes.withColumn("words", F.explode(F.sequence(F.lit(0), (F.octet_length("beyond") / 4).cast("int")))).select(
        F.xxhash64("h", "side", "beyond").alias("class"), F.xxhash64("h", "side", F.substring("beyond", F.lit(1), 4 * F.col("words"))).alias("begin"), "words", "own", "n"
    )
    firsts = cut_lineage(begun.groupBy("begin").agg(F.min("own").alias("first"), F.sum("n").alias("n")).where("n > 1").drop("n"))
    # the longest beginning with each first place
    chains = begun.select("class", "begin", "words").join(few(firsts, F.lit(48)), "begin").groupBy("class", "first").agg(F.max("words").alias("words"))
    chains = cut_lineage(chains.groupBy("class").agg(F.collect_list(F.struct("words", "first")).alias("chain")))
    apart = F.filter("chain", lambda c: (c["first"]["rid"] != F.col("rid")) | (F.col("at") >= c["first"]["at"] + n))
    found = rows.withColumn("class", F.xxhash64("h", "side", "beyond")).join(few(chains, 64 * F.size("chain")), "class").withColumn("most", F.array_max(apart)).where("most IS NOT NULL")
    found = cut_lineage(found.select("rid", "doc_id", "at", "side", F.col("most.words").alias("n_more"), F.col("most.first").alias("first")))
    kept = found.groupBy("first", "side").agg(F.max("n_more").alias("n_more"))
    return found.select("rid", "doc_id", "at", "side", "n_more", F.lit(True).alias("removed"), F.col("first.doc_id").alias("keep_id")).unionByName(
        kept.select("first.rid", "first.doc_id", "first.at", "side", "n_more", F.lit(False).alias("removed"), F.col("first.doc_id").alias("keep_id"))
    )


#: Places of an anchor that a task takes at once.
HOT = 2_000


def verbatim_passages(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, hot: int = HOT) -> DataFrame:
    """rid, w_from, w_to, removed, keep_ids: what stands verbatim elsewhere too, at no matter which place of a line.

    ``rows`` has rid, doc_id and the anchors of ``docs``. What n words and more of two texts have in common holds anchors that
    both have, the first and the last of them n - k words from its ends at most. So the words before and after each anchor that occurs
    twice are compared, on either side for itself, with those of all earlier places of the same anchor, and the longest agreement
    counts: nothing of n words and more that stands at an earlier place is lost or cut short, whichever places hold which part of it. A place in the
    same text is earlier if it begins n words before at least. Places are ordered by (doc_id, place). Of agreeing places the first stays.
    Words are compared by 32 bits of their hashes, anchors by 64.
    """
    k = n // 2
    found = rows.select("rid", "doc_id", F.arrays_zip("at", "h").alias("a")).select("rid", "doc_id", F.inline("a"))
    twice = cut_lineage(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    found = found.join(few(twice), "h")
    key = F.xxhash64("h", "side").alias("key")
    parts = _matched(_contexts(docs, found.where(F.col("n") <= hot), id_col, text_col, k, n - k).select("*", key), n)
    if not twice.where(F.col("n") > hot).isEmpty():
        many = cut_lineage(_contexts(docs, found.where(F.col("n") > hot), id_col, text_col, k, n - k))
        parts = parts.unionByName(_hot_matches(many, n))
    left = F.col("side") == 0
    return parts.select(
        "rid", F.when(left, F.col("at") - F.col("n_more")).otherwise(F.col("at")).alias("w_from"), F.when(left, F.col("at") + k).otherwise(F.col("at") + k + F.col("n_more")).alias("w_to"),
        "removed", F.when(F.col("keep_id").isNotNull(), F.array("keep_id")).otherwise(F.array().cast("array<bigint>")).alias("keep_ids"),
    )


def whole_copies(described: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rids of texts whose words are all those of an earlier text; and a part for each of them and for each first one that has some."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    firsts = cut_lineage(described.where("key IS NOT NULL").groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"))
    met = described.select("rid", "doc_id", "key", "words").join(few(firsts, F.lit(48)), "key").withColumn("removed", F.col("rid") != F.col("first.rid"))
    keep = F.when(F.col("first.doc_id").isNotNull(), F.array("first.doc_id")).otherwise(F.array().cast("array<bigint>"))
    met = cut_lineage(met.select("rid", F.lit(0).alias("w_from"), F.col("words").cast("int").alias("w_to"), "removed", keep.alias("keep_ids")))
    return met.where("removed").select("rid"), met


def merged(parts: list[dict], least: int) -> list[dict]:
    """Spans of one text from parts that overlap: removed ones joined where they meet, then what stays outside them; ``least`` words and more."""

    def joined(some: list[dict]) -> list[dict]:
        out: list[dict] = []
        for p in sorted(some, key=lambda p: p["w_from"]):
            if out and p["w_from"] <= out[-1]["w_to"]:
                q = out[-1]
                if p["w_to"] > q["w_to"]:
                    q["w_to"] = p["w_to"]
                q["keep_ids"].update(p["keep_ids"])
            else:
                out.append({**p, "keep_ids": set(p["keep_ids"])})
        return out

    gone = [p for p in joined([p for p in parts if p["removed"]]) if p["w_to"] - p["w_from"] >= least]
    out, k = list(gone), 0
    for p in joined([p for p in parts if not p["removed"]]):
        while k < len(gone) and gone[k]["w_to"] <= p["w_from"]:
            k += 1
        j, rest = k, dict(p)
        while j < len(gone) and gone[j]["w_from"] < p["w_to"]:
            g = gone[j]
            out.append({**rest, "w_to": g["w_from"]})
            rest["w_from"] = g["w_to"]
            j += 1
        out.append(rest)
    return [p for p in out if p["w_to"] - p["w_from"] >= least]


def _merge_spans(docs: DataFrame, parts: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """The spans of each text, with their places in it; the texts with parts are read again."""
    names = ["rid", "doc_id", "from", "to", "n_words", "removed", "keep_ids"]
    schema = pa.schema([*((c, pa.int64()) for c in names[:5]), ("removed", pa.bool_()), ("keep_ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(a, 500) for a in range(0, whole.num_rows, 500)):
                out: list[dict] = []
                for rid, doc, text, own in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if spans := merged(own, least):
                        first, last = word_places(text)
                        for p in spans:
                            out.append({"rid": rid, "doc_id": doc, "from": first[p["w_from"]], "to": last[p["w_to"] - 1], "n_words": p["w_to"] - p["w_from"], "removed": p["removed"], "keep_ids": sorted(p["keep_ids"])})
                yield pa.RecordBatch.from_pylist(out, schema)

    by_doc = cut_lineage(parts.groupBy("rid").agg(F.collect_list(F.struct("w_from", "w_to", "removed", "keep_ids")).alias("parts")))
    rows = _numbered(docs, id_col, text_col).join(few(by_doc, 48 * F.size("parts")), "rid").select("rid", "doc_id", "text", "parts")
    return rows.mapInArrow(run, "rid long, doc_id long, from long, to long, n_words long, removed boolean, keep_ids array<bigint>")


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, t: float = SIMILARITY, target: float = TARGET_RECALL,
    rows: int = BAND_ROWS, span_words: int = SPAN_WORDS,
) -> DataFrame:
    """rid, doc_id, from, to, n_words, removed and keep_ids: the spans of ``docs`` whose paragraphs also stand elsewhere.

    Paragraphs are lines with n words at least, and between those all shorter lines together. Those whose sets of n-word shingles are
    alike by t or more are linked, and what links connect is a class. Of a class the
    occurrence with the smallest (doc_id, place) stays (null ids count as the largest)
    and all others are removed. Adjacent repeated paragraphs that are both removed, or both stay,
    form a span of code points [from, to) with the doc_ids that keep its paragraphs;
    lines too short to judge between them go along, and their words count. Spans of fewer than
    ``span_words`` words are left alone, so short set phrases are. Equal paragraphs
    are one until the end, and so are texts of equal words: a copy of a whole earlier text is one span, which names the first
    such text; others meet by MinHash bands, tuned so that a pair at the
    threshold meets with ``target`` odds, and are compared exactly inside each
    bucket. Null and empty texts have no paragraphs. A line that repeats inside one
    document counts too, and so do repeated rows. Besides, every run of ``span_words`` words
    and more that stands verbatim at an earlier place, inside other lines or across other line
    breaks, is removed as well; overlapping spans are merged, and what stays is reported outside the
    removed ones. Very long texts are read whole. No rows give no rows. Other columns are ignored. ``docs`` has to
    be a stored table: it is read four times.
    """
    bands = bands_for(target, t, rows)
    described = cut_lineage(_described(docs, id_col, text_col, n, bands, rows, span_words))
    copies, whole = whole_copies(described)
    described = described.join(few(copies), "rid", "left_anti")
    units = _lines(described, bands)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid", "para")
    # one row for each set of shingles; its bands are the same in every copy
    reps = cut_lineage(units.groupBy("sig", "size").agg(F.count("*").alias("copies"), F.min(place).alias("first"), F.first("bands").alias("bands")))
    nodes = reps.select("sig", F.explode("bands").alias("bucket"))
    reps = reps.drop("bands")
    shared = cut_lineage(nodes.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"))
    members = cut_lineage(nodes.join(few(shared), "bucket", "left_semi"))
    wanted = only(reps, members, "sig").select("sig", "first.rid", "first.para")
    links = cut_lineage(links_within(members, reps, _sets(docs, cut_lineage(wanted), id_col, text_col, n), t, exact=True))
    component = connected_components(links.select(F.col("sig").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("node", "sig")
    linked = component.join(reps, "sig")
    heads = linked.groupBy("component").agg(F.min("first").alias("head"))
    near = linked.join(heads, "component").select("sig", "head")
    repeated = reps.join(near, "sig", "left").where((F.col("copies") > 1) | F.col("head").isNotNull()).select("sig", F.coalesce("head", "first").alias("head"))
    found = units.drop("size", "bands").join(few(cut_lineage(repeated), F.lit(48)), "sig").withColumn(
        "removed", (F.col("rid") != F.col("head.rid")) | (F.col("para") != F.col("head.para"))
    )
    # a span goes on while no judged line that isn't repeated stands between: number the judged lines of a document
    judged = units.select("rid", "para").withColumn("nth", F.row_number().over(W.partitionBy("rid").orderBy("para")))
    found = found.join(judged, ["rid", "para"])
    run = W.partitionBy("rid").orderBy("para")
    new = (F.col("nth") != F.lag("nth").over(run) + 1) | (F.col("removed") != F.lag("removed").over(run))
    found = found.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(run))
    lines = found.groupBy("rid", "span", "removed").agg(
        F.min("w_from").alias("w_from"), F.max(F.col("w_from") + F.col("n_words")).alias("w_to"), F.collect_set("head.doc_id").alias("keep_ids")
    )
    parts = lines.drop("span").unionByName(verbatim_passages(described, docs, id_col, text_col, span_words)).unionByName(whole)
    return _merge_spans(docs, parts, id_col, text_col, span_words)
