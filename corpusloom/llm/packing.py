"""Best-fit packing of token sequences with a bounded number of open bins."""

from __future__ import annotations

import json
import math
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..operators.components import cut_lineage

CAPACITY = 4096
OPEN_BINS = 256
FAN_IN = 16
END_ID = 1


#: Normalizer and pattern of tokenizers whose ids of a text are those of its parts between white space. Fixed values.
PARTED_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PARTED_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The step after the pattern that writes each byte as a letter, and the letters of bytes that stand for none themselves.
BYTEWISE = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
BYTE_LEVEL = {b: 256 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


class WordIds:
    """The ids of texts, each part between ASCII white space encoded once.

    Where the tokenizer's normalizer and pattern are the ones above, nothing crosses white space, so
    a text's ids are its parts' ids in order. Of a part of plain letters with punctuation
    behind them the pattern makes two pieces, which are looked up apart, in lower case as
    the tokenizer sees them. What has been encoded is remembered, ``limit`` parts and
    ``pieces_limit`` pieces at most; parts that come back outlast the others. Texts of other tokenizers are encoded whole.
    """

    LETTERS = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<behind>[!-/:-@\[-`{-~]*)$"
    #: Rows taken at once, and the longest part that is remembered.
    ROWS, LONGEST = 1000, 64

    def __init__(self, path: str, limit: int = 300_000, pieces_limit: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.pieces_limit = Tokenizer.from_file(path), limit, pieces_limit
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        first = ((made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        parted = made.get("normalizer") == PARTED_NORMALIZER and (first.get("pattern"), first.get("behavior"), first.get("invert")) == ({"Regex": PARTED_PATTERN}, "Removed", True)
        self.parted, self.pieces = parted and made.get("post_processor") is None, {}
        bytewise = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])[1:] == [BYTEWISE]
        self.model = self.tokenizer.model if self.parted and bytewise else None
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.n, self.starts, self.ids, self.again = 0, np.zeros(1, np.int64), np.empty(0, np.uint32), np.empty(0, bool)

    def _forget(self) -> None:
        """Keeps the parts that were met again since the last time, unless they are most of what there is room for."""
        kept = [(name, i) for name, i in self.place.items() if self.again[i]]
        if 2 * len(kept) > self.limit:
            return self._clear()
        at = np.array([i for _, i in kept], np.int64)
        begin, size = self.starts[at], self.starts[at + 1] - self.starts[at]
        self.n, self.starts = len(kept), np.r_[0, np.cumsum(size)]
        self.ids = self.ids[np.arange(self.starts[-1]) + np.repeat(begin - self.starts[:-1], size)]
        self.place, self.again = {name: k for k, (name, _) in enumerate(kept)}, np.zeros(self.n, bool)

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, text: str) -> bytes:
        """The ids of one match of the pattern, in lower case; the model takes it without the normalizer's and pattern's work."""
        if (got := self.pieces.get(text)) is None:
            if len(self.pieces) >= self.pieces_limit:
                self.pieces.clear()
            if self.model is None:
                got = self.encode(text)
            else:
                as_bytes = text if text.isascii() else text.encode().decode("latin-1").translate(BYTE_LEVEL)
                got = array("I", [x.id for x in self.model.tokenize(as_bytes)]).tobytes()
            self.pieces[text] = got
        return got

    def _encoded(self, parts: pa.Array) -> list[bytes]:
        """The ids of each part."""
        found = pc.extract_regex(parts, self.LETTERS)
        heads, behind = (pc.fill_null(pc.struct_field(found, c), "").dictionary_encode() for c in ("letters", "behind"))
        head_ids = [self.piece(x) if x else b"" for x in pc.utf8_lower(heads.dictionary).to_pylist()]
        behind_ids = [self.piece(x) if x else b"" for x in behind.dictionary.to_pylist()]
        out = [head_ids[i] + behind_ids[j] for i, j in zip(heads.indices.to_pylist(), behind.indices.to_pylist(), strict=True)]
        other = pc.or_(found.is_null(), pc.greater(pc.utf8_length(parts), self.LONGEST))
        for i in np.flatnonzero(other.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.encode(parts[i].as_py())
        return out

    def _places(self, parts: pa.Array, forgot: bool = False) -> np.ndarray:
        """Where the ids of each of these distinct parts are."""
        names = parts.to_pylist()
        at = np.fromiter(map(self.place.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        self.again[at[at >= 0]] = True
        if len(new) and self.n + len(new) > self.limit and self.n:
            self._clear() if forgot else self._forget()
            return self._places(parts, True)
        if len(new):
            got = self._encoded(parts.take(pa.array(new)))
            ends = self.starts[self.n] + np.cumsum([len(x) // 4 for x in got])
            at[new] = np.arange(self.n, self.n + len(new))
            self.starts = np.concatenate([self.starts[: self.n + 1], ends])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(got), "<u4")])
            # long ones are there for this call only
            self.place.update((names[i], int(at[i])) for i in new if len(names[i]) <= self.LONGEST)
            self.n += len(new)
            self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
        return at

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; null has none."""
        if not self.parted:
            for text in texts:
                yield np.frombuffer(self.encode(text.as_py() or ""), "<u4")
            return
        for few in (texts.slice(a, self.ROWS) for a in range(0, len(texts), self.ROWS)):
            split = pc.ascii_split_whitespace(pc.fill_null(few, ""))
            offsets = split.offsets.to_numpy()
            flat = split.flatten().dictionary_encode()
            at = self._places(flat.dictionary)[flat.indices.to_numpy()]
            begin = self.starts[at]
            size = self.starts[at + 1] - begin
            ends = np.r_[0, np.cumsum(size)]
            ids = self.ids[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)]
            cuts = ends[offsets - offsets[0]]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield ids[a:b]


_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each Python worker."""
    if path not in _ids:
        _ids[path] = WordIds(path)
    return _ids[path]


class OpenBins:
    """Best fit over at most ``limit`` open bins.

    Bit f of ``free`` is set while an open bin has f tokens free, so the tightest
    bin that still fits is the lowest bit from the length on. When one bin too many
    is open, the fullest closes.
    """

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit, self.free, self.by_free, self.n = capacity, limit, 0, {}, 0

    def _push(self, room: int, held: list) -> None:
        self.by_free.setdefault(room, []).append(held)
        self.free |= 1 << room

    def _pop(self, room: int) -> list:
        held = self.by_free[room].pop()
        if not self.by_free[room]:
            del self.by_free[room]
            self.free ^= 1 << room
        return held

    def put(self, length: int, item) -> list | None:
        """Places the item; gives a bin's items [(item, offset)...] when one closes."""
        fits = self.free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            held = self._pop(room)
        else:
            room, held = self.capacity, []
            self.n += 1
        held.append((item, self.capacity - room))
        if room == length:
            self.n -= 1
            return held
        self._push(room - length, held)
        if self.n > self.limit:
            self.n -= 1
            return self._pop((self.free & -self.free).bit_length() - 1)
        return None

    def rest(self) -> Iterator[tuple[list, int]]:
        """The bins still open and what they hold in tokens."""
        for room, bins in sorted(self.by_free.items()):
            for held in bins:
                yield held, self.capacity - room


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, open_with long"


def _pack_documents(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, open_bins: int) -> DataFrame:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in _PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bins, rows, closed = word_ids(path), OpenBins(capacity, open_bins), [], 0
        part = None

        def emit(held: list, used: int | None) -> None:
            nonlocal closed
            rows.extend((*piece, (part << 33) + closed, offset, used) for piece, offset in held)
            closed += 1

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 8, kinds, strict=True)], names)
            rows.clear()
            return out

        end = array("I", [END_ID]).tobytes()
        for batch in batches:
            part = batch.column(0)[0].as_py() if part is None and batch.num_rows else part
            for doc, found in zip(batch.column(1).to_pylist(), ids.of(batch.column(2)), strict=True):
                data = found.astype("<u4").tobytes() + end
                n = len(data) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    piece = (doc, k, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]))
                    if (held := bins.put(length, piece)) is not None:
                        emit(held, None)
            if len(rows) >= 10_000:
                yield batch_of()
        for held, used in bins.rest():
            emit(held, used)
        yield batch_of()

    return docs.select(F.spark_partition_id().cast("long"), F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _PIECES)


def _merge_open(bins: DataFrame, capacity: int, open_bins: int) -> DataFrame:
    """Packs whole open bins of a group of partitions: seq -> into, shift, used, still_open."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        packed, out = OpenBins(capacity, open_bins), []
        group = group.sort_values(["used", "seq"], ascending=[False, True])
        last = bool(group["last"].iloc[0])

        def emit(held: list, still_open: bool) -> None:
            used = max(offset + item[1] for item, offset in held)
            out.extend((item[0], held[0][0][0], offset, used, still_open) for item, offset in held)

        for seq, used in zip(group["seq"].tolist(), group["used"].tolist(), strict=True):
            if (held := packed.put(used, (seq, used))) is not None:
                emit(held, False)
        for held, _ in packed.rest():
            emit(held, not last)
        return pd.DataFrame(out, columns=["seq", "into", "shift", "used", "still_open"])

    return bins.groupBy("group").applyInPandas(run, "seq long, into long, shift long, used long, still_open boolean")


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, fan_in: int = FAN_IN
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for every piece of every row of ``docs``.

    A document's ids are its text's (null and empty: none) and the end id. Only
    longer ones than ``capacity`` are cut, into full pieces and a rest. Each
    partition packs its pieces as they come, with ``open_bins`` bins open at most.
    Bins still open at the partition's end are packed again, whole, by groups of
    ``fan_in`` partitions in rounds, so that no task gets more than ``fan_in`` *
    ``open_bins`` of them and few sequences stay short. Repeated rows are packed as
    often as they come, and a null id stays null. No rows give no rows. Other
    columns are ignored.
    """
    pieces = cut_lineage(_pack_documents(docs, tokenizer_path, id_col, text_col, capacity, open_bins))
    open_now = pieces.where(F.col("open_with").isNotNull()).groupBy(F.col("bin").alias("seq")).agg(F.max("open_with").alias("used"))
    rounds = max(1, math.ceil(math.log(max(2, pieces.rdd.getNumPartitions()), fan_in) - 1e-9))
    moved = open_now.select(F.col("seq").alias("bin"), "seq", F.lit(0).cast("long").alias("shift"), "used", F.lit(True).alias("still_open"))
    for r in range(1, rounds + 1):
        group = F.floor(F.shiftright("seq", 33) / fan_in**r)
        bins = moved.where("still_open").select("seq", "used").distinct().withColumns({"group": group, "last": F.lit(r == rounds)})
        merged = _merge_open(bins, capacity, open_bins)
        renamed = merged.select("seq", "into", F.col("shift").alias("more"), F.col("used").alias("used_now"), F.col("still_open").alias("open_now"))
        moved = cut_lineage(
            moved.join(renamed, "seq", "left").select(
                "bin", F.coalesce("into", "seq").alias("seq"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"),
                F.coalesce("used_now", "used").alias("used"), F.coalesce("open_now", F.lit(False)).alias("still_open"),
            )
        )
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.where(F.col("open_with").isNull()).select(*columns, F.col("bin").alias("sequence_id"), "offset")
    late = pieces.where(F.col("open_with").isNotNull()).join(moved.select("bin", "seq", "shift"), "bin")
    return full.unionByName(late.select(*columns, F.col("seq").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset")))
