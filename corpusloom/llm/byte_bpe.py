"""Byte-level BPE: texts encoded as a tree reduction of their halves, and ids decoded up the tree."""

from __future__ import annotations

import base64
import heapq
import sys
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Characters of a text, and bytes of a match, that are encoded in one go; ids that are decoded in one go.
TEXT_LEAF, MATCH_LEAF, ID_LEAF = 4_096, 256, 4_096
#: Characters beyond a match that the pattern may look at before it settles the match's end. It looks at none before its start.
LOOK = 2
_NONE = 1 << 62


class Matches(tuple):
    """A span of text: its matches, and the ids of each."""

    __slots__ = ()

    def __new__(cls, found: list[str], ids: list[tuple]):
        return super().__new__(cls, (found, ids))


class ByteBpe(dict):
    """match -> ids, worked out once for each match; forgets all when it holds ``limit`` matches.

    Ids of neighbours in an encoding are compatible: encoding the bytes of both gives them again. The converse holds as well. A sequence whose neighbours are all
    compatible is the encoding of its bytes: let the first merge across a boundary take place between two of its
    ids; up to it all merges took place inside the ids, in the order in which they do when the two are
    encoded alone, so that merge would take place there too. That is what joins rest on.
    """

    def __init__(self, path: str, pattern: str, limit: int = 400_000):
        super().__init__()
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.find, self.limit = regex.compile(pattern).findall, limit

    def __missing__(self, match: str) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        raw = match.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)  # a match that is in the vocabulary is that, whatever its merges would give
        ids = (whole,) if whole is not None else tuple(self.encoded(raw))
        if len(match) <= 64:
            self[match] = ids
        return ids

    def merged(self, raw: bytes) -> list[int]:
        """Of all neighbours the pair of the lowest rank is merged, the leftmost of several, until no pair is in the vocabulary."""
        n, rank = len(raw), self.ranks.get
        if n <= 48:
            ends = list(range(n + 1))
            scores = [rank(raw[i : i + 2], _NONE) for i in range(n - 1)]
            while scores and (low := min(scores)) != _NONE:
                i = scores.index(low)
                del ends[i + 1], scores[i]
                if i:
                    scores[i - 1] = rank(raw[ends[i - 1] : ends[i + 1]], _NONE)
                if i < len(scores):
                    scores[i] = rank(raw[ends[i] : ends[i + 2]], _NONE)
            return [self.ranks[raw[a:b]] for a, b in zip(ends, ends[1:])]  # noqa: B905
        after, before = list(range(1, n + 2)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or after[j] != end:
                continue  # one of the two has been merged since
            alive[j], after[i] = 0, end
            if end < n:
                before[end] = i
                if (r := rank(raw[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (h := before[i]) >= 0 and (r := rank(raw[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i : after[i]]])
            i = after[i]
        return out

    def encoded(self, raw: bytes) -> list[int]:
        """The merges' result for bytes of any length: halves, then their join."""
        if len(raw) <= MATCH_LEAF:
            return self.merged(raw)
        half = 1 << (len(raw) - 1).bit_length() - 1
        return self.joined(self.encoded(raw[:half]), self.encoded(raw[half:]))

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings: a window at the seam is encoded anew, and grows until its outer ids are what they were.

        Then they are compatible with the ids outside, so all neighbours are.
        """
        a = b = 1
        while left and right:
            a, b = min(a, len(left)), min(b, len(right))
            inner = self.merged(b"".join(map(self.bytes_of.__getitem__, chain(left[len(left) - a :], right[:b]))))
            left_holds = a == len(left) or inner[0] == left[-a]
            right_holds = b == len(right) or inner[-1] == right[b - 1]
            if left_holds and right_holds:
                return left[: len(left) - a] + inner + right[b:]
            a, b = a if left_holds else 2 * a, b if right_holds else 2 * b
        return left + right

    def matches(self, text: str) -> Matches:
        """A text's matches and ids: halves, then their join."""
        if len(text) <= TEXT_LEAF:
            found = self.find(text)
            return Matches(found, [self[m] for m in found])
        half = TEXT_LEAF << max(0, (len(text) - 1) // TEXT_LEAF).bit_length() - 1
        return self.side_by_side(self.matches(text[:half]), self.matches(text[half:]))

    def side_by_side(self, left: Matches, right: Matches) -> Matches:
        """The matches of two texts together: from the first one that the seam can reach, a window is matched anew, and grows until it begins a match where the right text does.

        From there on all is as in the right text alone, as the pattern looks at nothing before a match.
        """
        (l_found, l_ids), (r_found, r_ids) = left, right
        k, beyond = len(l_found), 0
        while k and beyond < LOOK:
            k -= 1
            beyond += len(l_found[k])
        head, j = "".join(l_found[k:]), 1
        while True:
            j = min(j, len(r_found))
            window = head + "".join(r_found[:j])
            starts, at = {}, len(head)
            for i, m in enumerate(r_found[:j]):
                starts[at] = i
                at += len(m)
            starts[at] = j
            found, at = [], 0
            for m in [*self.find(window), None]:
                if at >= len(head) and at in starts and (len(window) - at >= LOOK or j == len(r_found)):
                    ids = [self._across(m, l_found, l_ids, r_found, r_ids) for m in found]
                    return Matches(l_found[:k] + found + r_found[starts[at] :], l_ids[:k] + ids + r_ids[starts[at] :])
                if m is not None:
                    found.append(m)
                    at += len(m)
            j *= 2

    def _across(self, match: str, l_found: list[str], l_ids: list[tuple], r_found: list[str], r_ids: list[tuple]) -> tuple[int, ...]:
        """The ids of a match of the window; a long one that the seam cut in two is joined from those of its parts."""
        if len(match) > MATCH_LEAF and l_found and r_found and match == l_found[-1] + r_found[0]:
            return tuple(self.joined(list(l_ids[-1]), list(r_ids[0])))
        return self[match]

    def decoded(self, ids: array) -> bytes:
        """The ids' bytes, concatenated up the tree."""
        if len(ids) <= ID_LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decoded(ids[:half]) + self.decoded(ids[half:])


_bpe: dict[tuple[str, str], ByteBpe] = {}


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """The vocabulary of a rank file, read once by each worker."""
    if (path, pattern) not in _bpe:
        _bpe[path, pattern] = ByteBpe(path, pattern)
    return _bpe[path, pattern]


def _packed(ids: Iterator[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _unpacked(ids: bytes) -> array:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, doc_id, n_tokens and ids (little-endian unsigned 32-bit numbers) of every row's whole text.

    Each match of ``pattern`` is encoded for itself; special tokens are ordinary text. The pattern has to match every character, to look at
    ``LOOK`` characters beyond a match at most and at none before it. ``ranks_path`` is a file that all
    executors have. A text's halves are matched and encoded by recursion and joined where they meet, and so are long matches,
    so nothing depends on where a text was cut. A null text counts as empty and has no ids; very long texts are encoded whole,
    in the task that has the row. A null id stays, repeated rows give rows each, and no rows give no rows. Nothing is
    shuffled. Other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks_path, pattern)
        for whole in batches:
            for batch in (whole.slice(a, 500) for a in range(0, whole.num_rows, 500)):
                out = []
                for text in batch.column(2):
                    _, ids = bpe.matches(text.as_py() or "")
                    out.append(_packed(chain.from_iterable(ids)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())], ["rid", "doc_id", "n_tokens", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "rid long, doc_id long, n_tokens long, ids binary")


def decode(rows: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``rows`` of ``encode`` with ``decoded``, the bytes of their ids. Null ids decode to null, no ids to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks_path, pattern)
        for whole in batches:
            for batch in (whole.slice(a, 500) for a in range(0, whole.num_rows, 500)):
                out = []
                for x in batch.column(batch.schema.get_field_index("ids")):
                    out.append(None if x.as_py() is None else bpe.decoded(_unpacked(x.as_py())))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, f"{', '.join(f'`{c}` {kind}' for c, kind in rows.dtypes)}, decoded binary")
