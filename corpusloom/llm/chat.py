"""Chat formatting: root-to-leaf paths of reply trees as conversations with a loss mask."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.components import cut_lineage
from .similar import groups

START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def escaped(text: str, line: bool = False) -> str:
    """No control string of the template can stand in the result; a one-line text stays on its line."""
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\n") if line else text


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def as_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn, read back from a formatted conversation."""
    return [(unescaped(m[1]), unescaped(m[2])) for m in TURN.finditer(formatted)]


def ranked_paths(messages: DataFrame, branches: int | None = None, max_rounds: int = 40) -> DataFrame:
    """conv_id, leaf, rank, up, role, text: the messages of each chosen root-to-leaf path, ``up`` steps above its leaf.

    ``messages`` has conv_id, msg_id, parent_id, role, text and score. Self-joins double the
    reach of each message's ancestor link, so a path of n messages takes log2(n)
    rounds, and sum up scores on the way. Leaves are ranked inside their
    conversation by the mean score of their path, then depth, then id; the first
    ``branches`` stay (all if None). Only these paths are then enumerated, by the same
    links, one row for each message. A parent that isn't there makes a root; of rows with
    equal ids the first by parent, role and text counts; a null score is 0; rows with a null
    conv_id or msg_id, and messages on or below a cycle of parents, belong to no path.
    """
    first = W.partitionBy("conv_id", "msg_id").orderBy("parent_id", "role", "text")
    base = messages.where("conv_id IS NOT NULL AND msg_id IS NOT NULL").withColumn("__nth", F.row_number().over(first)).where("__nth = 1")
    base = base.select(
        "conv_id", "msg_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score")
    )
    light = cut_lineage(base.select("conv_id", "msg_id", "parent_id", "score"))
    there = light.select("conv_id", F.col("msg_id").alias("parent_id"), F.lit(True).alias("known"))
    start = light.join(there, ["conv_id", "parent_id"], "left").select(
        "conv_id", F.col("msg_id").alias("node"), F.when(F.col("known"), F.col("parent_id")).alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")
    )
    start = cut_lineage(start)
    # links[k]: the ancestor 2^k steps up, of messages that have one; done: depth and score of those whose root is reached
    links, done = [start.where("up IS NOT NULL")], start.where("up IS NULL")
    active = links[0].count()
    for _ in range(max_rounds):
        if not active:
            break
        above = links[-1].union(done).select("conv_id", F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("total").alias("plus"))
        moved = cut_lineage(
            links[-1].join(above, ["conv_id", "up"]).select("conv_id", "node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("plus")).alias("total"))
        )
        links.append(moved.where("up IS NOT NULL"))
        done = done.union(moved.where("up IS NULL"))
        before, active = active, links[-1].count()
        if active == before:
            break  # what still has an ancestor is on a cycle, or below one
    inner = start.where("up IS NOT NULL").select("conv_id", F.col("up").alias("node")).distinct()
    leaves = done.join(inner, ["conv_id", "node"], "left_anti")
    order = W.partitionBy("conv_id").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node")
    leaves = leaves.withColumn("rank", F.row_number().over(order))
    leaves = leaves if branches is None else leaves.where(F.col("rank") <= branches)
    paths = leaves.select("conv_id", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(links))):
        step = links[k].select("conv_id", "node", F.col("up").alias("to"))
        paths = paths.union(paths.join(step, ["conv_id", "node"]).select("conv_id", "leaf", "rank", F.col("to").alias("node"), (F.col("up") + 2**k).alias("up")))
        paths = cut_lineage(paths)
    return paths.join(base.select("conv_id", F.col("msg_id").alias("node"), "role", "text"), ["conv_id", "node"]).select("conv_id", "leaf", "rank", "up", "role", "text")


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mask = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    for table in groups(batches, 2):
        parts, spans, at = [], [], 0
        for role, text in zip(table.column("role").to_pylist(), table.column("text").to_pylist(), strict=True):
            head, body = f"{START}{escaped(role, True)}\n", escaped(text)
            if role == "assistant":
                spans.append({"from": at + len(head), "to": at + len(head) + len(body)})
            parts.append(head + body + END + "\n")
            at += len(parts[-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array([table.column(i)[0].as_py()], pa.int64()) for i in range(3)] + [pa.array(["".join(parts)]), pa.array([spans], mask)], ["conv_id", "leaf", "rank", "formatted", "loss"]
        )


def format_trees(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """conv_id, leaf, rank, formatted and loss (code point spans of the assistant's texts) for each chosen path.

    A conversation is one text: marked turns from root to leaf, with control
    strings inside roles and texts escaped so that ``as_turns`` gives back what went
    in. Null roles and texts are empty. No messages give no rows. Other columns are ignored.
    """
    rows = ranked_paths(messages, branches)
    rows = rows.select("conv_id", "leaf", "rank", "up", "role", "text").repartition("conv_id", "leaf").sortWithinPartitions("conv_id", "leaf", F.desc("up"))
    return rows.mapInArrow(_format, "conv_id long, leaf long, rank long, formatted string, loss array<struct<from:bigint,to:bigint>>")


def as_tree(conversations: DataFrame) -> DataFrame:
    """Rows by turn as a reply tree: each turn answers the one before. Equal turns follow each other by role and text."""
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), "role", "text")
    nth = F.row_number().over(order).cast("long")
    return conversations.select("conv_id", nth.alias("msg_id"), (nth - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from the formatted texts alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, loss in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py()
                turns = as_turns(text)
                learnt = "".join(unescaped(text[x["from"] : x["to"]]) for x in loss)
                data = "".join(f"{role}\n{said}\n" for role, said in turns).encode("utf-8", "surrogatepass")
                rows.append((conv, len(turns), sha256(data).hexdigest(), len(learnt), sha256(learnt.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 6, kinds, strict=True)], names)

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
