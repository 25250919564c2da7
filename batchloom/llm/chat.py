"""Chat formatting: conversations out of reply trees.

Messages form trees by their parents. Iterative self-joins double the reach of
each message's ancestor pointer, so a path of length n takes log2(n) joins; on
the way scores add up along the path. Branches (root to leaf) are ranked by mean
score, and only the chosen ones are spelled out, by walking the pointers back
from the leaf, longest steps first. Each chosen path becomes one text:

    <|turn|>role<|text|>text<|end|>\\n   for every message, root first

``&``, ``<`` and ``[`` in roles and texts are written as ``&amp;``, ``&lt;`` and
``&#91;``, so no mark and no control string of a common template can occur inside
one, and the step can be undone. The loss mask lists where assistant texts are.

A path is one cell of the result (Spark's limit is 2 GB), so a path meets in one
task; trees don't. Texts are shuffled once, after the paths are known.

Defined cases: null roles and texts are empty. A parent that does not exist makes
a root. Messages on a circle, or that lead to one, have no root and are left out.
Ids must be unique within a tree; null tree ids are a tree. Ties in score go to
the longer path, then the smaller id. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.llm.common import map_batches, stored

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")]
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ESCAPES, F.coalesce(text, F.lit("")))


def unescape(text: str) -> str:
    return reduce(lambda t, e: t.replace(e[1], e[0]), reversed(ESCAPES), text)


def pointers(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Path figures of every message, and tables of ancestors 1, 2, 4, ... steps up.

    ``messages`` has tree, id, parent, score. The figures are tree, id, depth
    (messages on the path) and total (their scores).
    """
    ids = messages.select("tree", F.col("id").alias("parent")).withColumn("known", F.lit(True))
    parents = messages.join(ids, ["tree", "parent"], "left")
    first = stored(
        parents.select(
            "tree", "id", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"),
            F.coalesce("score", F.lit(0.0)).alias("total"),
        ),
        "paths",
    )
    largest = first.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    # Messages whose pointer has reached the root are finished; only the others go
    # on. After as many rounds as the largest tree has binary digits, what still
    # points on is on a circle or leads to one.
    finished, going = [first.where(F.col("up").isNull())], first.where(F.col("up").isNotNull())
    jumps: list[DataFrame] = []
    for _ in range(int(largest).bit_length()):
        if going.isEmpty():
            break
        jumps.append(going.select("tree", F.col("id").alias("from"), F.col("up").alias("to")))
        above = reduce(DataFrame.unionByName, [*finished, going]).select(
            "tree", F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("d"), F.col("total").alias("t")
        )
        moved = going.join(above, ["tree", "up"]).select(
            "tree", "id", F.col("next").alias("up"), (F.col("depth") + F.col("d")).alias("depth"), (F.col("total") + F.col("t")).alias("total")
        )
        moved = stored(moved, "paths")  # the next round reads it twice
        finished.append(moved.where(F.col("up").isNull()))
        going = moved.where(F.col("up").isNotNull())
    return reduce(DataFrame.unionByName, finished).select("tree", "id", "depth", "total"), jumps


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Messages of the best ``branches`` paths of each tree: tree, leaf, id, depth."""
    figures, jumps = pointers(messages)
    inner = messages.select("tree", F.col("parent").alias("id")).where(F.col("id").isNotNull()).distinct()
    leaves = figures.join(inner, ["tree", "id"], "left_anti")
    order = Window.partitionBy("tree").orderBy((F.col("total") / F.col("depth")).desc(), F.col("depth").desc(), "id")
    best = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    path = best.select("tree", F.col("id").alias("leaf"), "id")
    for jump in reversed(jumps):  # each step reads the path twice, so it is written
        path = stored(path, "chosen")
        steps = jump.withColumnRenamed("from", "id")
        path = path.unionByName(path.join(steps, ["tree", "id"]).select("tree", "leaf", F.col("to").alias("id")))
    return stored(path, "chosen").join(figures.select("tree", "id", "depth"), ["tree", "id"])


def formatted(messages: DataFrame, branches: int = 1) -> DataFrame:
    """One row per chosen path: tree, leaf, conversation, loss (start, end), n_turns.

    ``messages`` has tree, id, parent, score, role, text.
    """
    keys = messages.select("tree", "id", "parent", "score")
    paths = chosen_paths(keys, branches)
    words = messages.select("tree", "id", F.coalesce("role", F.lit("")).alias("role"), escaped(F.col("text")).alias("body"))
    turns = paths.join(words, ["tree", "id"])
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))
    turn = F.struct("depth", head.alias("head"), "body", (F.col("role") == LEARNED).alias("learned"))
    rows = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))

    def add(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        span = F.struct(begin.alias("start"), end.alias("end"))
        loss = F.when(t["learned"], F.concat(state["loss"], F.array(span))).otherwise(state["loss"])
        return F.struct((end + len(END)).alias("at"), loss.alias("loss"))

    loss = F.aggregate("turns", start, add, lambda s: s["loss"])
    return rows.select("tree", "leaf", text.alias("conversation"), loss.alias("loss"), F.size("turns").cast("long").alias("n_turns"))


def parsed(conversation: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out = []
    for turn in conversation.split(END)[:-1]:
        role, _, text = turn.removeprefix(TURN).partition(TEXT)
        out.append((unescape(role), unescape(text)))
    return out


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            text = batch.column("conversation")[i].as_py()
            turns = parsed(text)
            whole = hashlib.sha256()
            for role, said in turns:
                whole.update(f"{role}\n{said}\n".encode())
            loss = "".join(unescape(text[s["start"] : s["end"]]) for s in batch.column("loss")[i].as_py())
            rows.append((len(turns), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        n, turns_sha, chars, loss_sha, length = zip(*rows) if rows else ([], [], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"), pa.array(n, pa.int64()), pa.array(turns_sha, pa.string()), pa.array(chars, pa.int64()),
                pa.array(loss_sha, pa.string()), pa.array(length, pa.int64()),
            ],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def as_tree(conversations: DataFrame) -> DataFrame:
    """Conversations of numbered turns as trees without branches.

    Equal turn numbers are put in order by role and text, so repeated rows stay.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.struct("conv_id").alias("tree"), "turn", "role", "text")
    rows = rows.withColumn("id", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("id") > 1, F.col("id") - 1)
    return rows.select("tree", "id", parent.alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def digest(conversations: DataFrame) -> DataFrame:
    """What the formatted conversations say when read back."""
    found = formatted(stored(as_tree(conversations), "messages"))
    rows = found.select(F.col("tree.conv_id").alias("conv_id"), "conversation", "loss")
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    return map_batches(
        rows,
        _read_back,
        f"conv_id {id_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )
