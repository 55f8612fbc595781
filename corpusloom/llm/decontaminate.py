"""Benchmark decontamination: winnowed word fingerprints, joined and extended."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.components import cut_lineage
from .rows import without
from .words import HASHES, grams, split_words, texts

WINDOW = 10
#: Words of a gram; a gram is picked from each WINDOW - GRAM + 1 consecutive ones.
GRAM = 5
#: Bits of the filter that documents carry; its size is the same for any benchmark.
FILTER_BITS = 1 << 24
BROADCAST_BYTES = 32 << 20

_FOUND = "array<struct<at:int,hash:bigint,span:int,lead:int,near:string>>"
_FOUND_ARROW = pa.list_(pa.struct([("at", pa.int32()), ("hash", pa.int64()), ("span", pa.int32()), ("lead", pa.int32()), ("near", pa.string())]))


def winnow(hashes: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the picked k-gram hashes: the least of every w consecutive ones, the last of equals."""
    g = grams(hashes, k)
    if len(g) < w:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    windows = np.lib.stride_tricks.sliding_window_view(g, w)
    at = np.arange(len(windows)) + (w - 1 - windows[:, ::-1].argmin(axis=1))
    at = at[np.r_[True, at[1:] != at[:-1]]]  # a window's pick never lies before the last one's
    return at, g[at]


def _near(words: list[bytes], at: int, span: int, room: int) -> tuple[int, str]:
    """The words from ``room`` before the gram to ``room`` after it, and how many stand before."""
    lead = min(at, room)
    return lead, b" ".join(words[at - lead : at + span + room]).decode("utf-8", "replace")


def item_fingerprints(benchmark: DataFrame, id_col: str, text_col: str, window: int, k: int) -> DataFrame:
    """item_id, hash, span, need, lead, near: an item's picked grams, or for a short item its only window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for item, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                words = split_words(text)
                n = len(words)
                if not n:
                    continue
                h = HASHES.of(words)
                if n < window:
                    rows.append((item, int(grams(h, n).view(np.int64)[0]), n, n, 0, b" ".join(words).decode("utf-8", "replace")))
                    continue
                for at, value in zip(*winnow(h, k, window - k + 1), strict=True):
                    rows.append((item, int(value.view(np.int64)), k, window, *_near(words, int(at), k, window - k)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["item_id", "hash", "span", "need", "lead", "near"])

    return benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, "item_id long, hash long, span int, need int, lead int, near string"
    )


def _filter_of(prints: DataFrame, bits: int) -> np.ndarray:
    """A bit for each fingerprint, as 64-bit words; at most ``bits`` / 64 rows come to the driver."""
    place = F.col("hash").bitwiseAND(F.lit(bits - 1))
    packed = prints.groupBy(F.floor(place / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[packed.column("word").to_numpy()] = packed.column("bits").to_numpy().view(np.uint64)
    return out


def _document_hits(docs: DataFrame, id_col: str, text_col: str, window: int, k: int, held: np.ndarray, short: list[int]) -> DataFrame:
    bits = np.uint64(len(held) * 64 - 1)

    def maybe(values: np.ndarray) -> np.ndarray:
        place = values & bits
        return np.flatnonzero((held[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found = [], []
            for text in texts(batch.column(2)):
                words = split_words(text)
                h = HASHES.of(words)
                counts.append(len(words))
                hits = []
                at, values = winnow(h, k, window - k + 1)
                for i in maybe(values):
                    lead, near = _near(words, int(at[i]), k, window - k)
                    hits.append({"at": int(at[i]), "hash": int(values[i].view(np.int64)), "span": k, "lead": lead, "near": near})
                for n in short:
                    values = grams(h, n)
                    hits += [
                        {"at": int(i), "hash": int(values[i].view(np.int64)), "span": n, "lead": 0, "near": b" ".join(words[i : i + n]).decode("utf-8", "replace")}
                        for i in maybe(values)
                    ]
                found.append(hits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(found, _FOUND_ARROW)], ["rid", "doc_id", "n_words", "found"]
            )

    return docs.select(F.monotonically_increasing_id(), F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, f"rid long, doc_id long, n_words long, found {_FOUND}"
    )


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words that agree to the left and right of a gram; the span is kept if it holds a window."""
    for batch in batches:
        rows = []
        for x in batch.to_pylist():
            a, b = x["near"].split(" "), x["i_near"].split(" ")
            i, j, span = x["lead"], x["i_lead"], x["span"]
            if a[i : i + span] != b[j : j + span]:
                continue
            left = right = 0
            if x["need"] > span:
                while left < min(i, j) and a[i - left - 1] == b[j - left - 1]:
                    left += 1
                while i + span + right < len(a) and j + span + right < len(b) and a[i + span + right] == b[j + span + right]:
                    right += 1
            if left + span + right >= x["need"]:
                rows.append((x["rid"], x["item_id"], x["at"] - left, x["at"] + span + right))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["rid", "item_id", "from", "to"])


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = GRAM
) -> DataFrame:
    """rid, doc_id, n_words, n_hit, items (sorted ids) and spans (word ranges) for every row of ``docs``.

    A word is hit when it lies inside an occurrence of ``window`` consecutive words
    of an item, or of a whole shorter item. Both sides keep the least k-gram hash of
    every ``window - k + 1`` consecutive grams, so any shared ``window`` words share
    a picked gram; the grams meet in a join, and each hit is extended to both sides,
    comparing the words themselves. Documents drop most grams early by a bit filter
    of fixed size; a full filter costs time, never a hit. Items shorter than
    ``window`` meet by the hash of all their words. Null and empty texts have no
    words; repeated rows are all judged; repeated items count once by their id.
    No rows give no rows; an empty benchmark hits nothing. Other columns are ignored.
    """
    prints = cut_lineage(item_fingerprints(benchmark, item_col, item_text_col, window, k))
    size = prints.agg(F.coalesce(F.sum(F.octet_length("near") + 40), F.lit(0)).alias("bytes"), F.collect_set(F.when(F.col("need") < window, F.col("need"))).alias("short")).first()
    held = _filter_of(prints, FILTER_BITS)
    seen = cut_lineage(_document_hits(docs, id_col, text_col, window, k, held, sorted(size["short"])))
    right = prints.select("item_id", "hash", "span", "need", F.col("lead").alias("i_lead"), F.col("near").alias("i_near"))
    met = seen.where(F.size("found") > 0).select("rid", F.inline("found")).join(
        F.broadcast(right) if size["bytes"] <= BROADCAST_BYTES else right, ["hash", "span"]
    )
    spans = met.select("rid", "item_id", "at", "span", "need", "lead", "near", "i_lead", "i_near").mapInArrow(_extend, "rid long, item_id long, from int, to int")
    per_doc = spans.groupBy("rid").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.array_sort(F.collect_set(F.struct("from", "to"))).alias("all"))
    empty = F.array().cast("array<struct<from:int,to:int>>")
    merged = F.aggregate(
        "all", empty,
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["to"] >= x["from"]),
            F.concat(
                F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.try_element_at(acc, F.lit(-1))["from"].alias("from"), F.greatest(F.try_element_at(acc, F.lit(-1))["to"], x["to"]).alias("to"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    per_doc = per_doc.select("rid", "items", merged.alias("spans"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + (x["to"] - x["from"]).cast("long"))
    no_items, no_spans = F.array().cast("array<bigint>"), empty
    judged = (
        seen.where(F.size("found") > 0).select("rid", "doc_id", "n_words").join(per_doc, "rid", "left")
        .select("rid", "doc_id", "n_words", F.coalesce(hit, F.lit(0)).alias("n_hit"), F.coalesce("items", no_items).alias("items"), F.coalesce("spans", no_spans).alias("spans"))
    )
    rest = seen.where(F.size("found") == 0).select("rid", "doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), no_items.alias("items"), no_spans.alias("spans"))
    return judged.unionByName(rest)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The rows of ``docs`` without a hit word, with their columns. ``docs`` has to be a stored table."""
    return without(docs, contamination(docs, benchmark, **names).where(F.col("n_hit") > 0))
