"""Chat formatting of reply trees (operator 6).

Iterative self-joins climb from all messages to the roots of their trees, twice as far in each round.
The branches of a tree are ranked by score, and each chosen path becomes one formatted conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import shared

# The control strings of the template.
BEGIN, END = "<s>", "</s>"
OPEN, CLOSE = "[INST]", "[/INST]"
SYSTEM_OPEN, SYSTEM_CLOSE = "<<SYS>>", "<</SYS>>"
CONTROL = (BEGIN, END, OPEN, CLOSE, SYSTEM_OPEN, SYSTEM_CLOSE)

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_HEAD = re.compile(re.escape(BEGIN) + r"\[INST\]([^\n]*)\n")


def escaped(text: str) -> str:
    """No control string stays whole: a backslash follows its first character; backslashes double."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as text, and the spans of its loss mask: the assistants' texts.

    A turn is ``<s>[INST]role\\ntext[/INST]</s>``; role and text are escaped, and line breaks of a
    role are written as ``\\n`` with the backslash rule.
    """
    out, mask, at = [], [], 0
    for role, text in turns:
        head = f"{BEGIN}{OPEN}{escaped(role).replace(chr(10), chr(92) + 'n')}\n"
        body = escaped(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        turn = f"{head}{body}{CLOSE}{END}"
        out.append(turn)
        at += len(turn)
    return "".join(out), mask


def parsed(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns, at = [], 0
    while at < len(text):
        head = _HEAD.match(text, at)
        stop = text.index(CLOSE + END, head.end())
        turns.append((unescaped(re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else m[0], head[1])), unescaped(text[head.end() : stop])))
        at = stop + len(CLOSE + END)
    return turns


def _climbed(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """tree, node, n (messages from the root to the node) and total (of their scores) of all messages that
    a root is above, and for each power of two the table tree, node, above of the ancestors that lie so far up.

    Each round joins what is known of a message with what is known of the ancestor where that ends, so that
    a chain of a thousand replies takes ten rounds of one row a message; each round is written to the
    shared folder, and its rows are counted on the way. Messages below a missing parent vanish on the way, circles
    never reach a root.
    """
    score = F.coalesce(F.col("score"), F.lit(0.0)) if "score" in messages.columns else F.lit(0.0)
    count = {"rows": F.count(F.lit(1)), "open": F.count("above")}
    state, seen = shared.observed(messages.select("tree", "node", F.col("parent").alias("above"), F.lit(1).cast("long").alias("n"), score.cast("double").alias("total")), "climb", **count)
    most, reach, ups = seen["rows"], 1, []
    while reach <= most and seen["open"]:
        rest = state.filter("above is not null")
        ups.append(rest.select("tree", "node", "above"))
        far = state.select("tree", F.col("node").alias("above"), F.col("above").alias("top"), F.col("n").alias("m"), F.col("total").alias("more"))
        further = shared.matched(rest, far, ["tree", "above"]).select("tree", "node", F.col("top").alias("above"), (F.col("n") + F.col("m")).alias("n"), (F.col("total") + F.col("more")).alias("total"))
        state, seen = shared.observed(state.filter("above is null").unionByName(further), "climb", **count)
        reach *= 2
    return state.filter("above is null").select("tree", "node", "n", "total"), ups


def _leaves(messages: DataFrame, reached: DataFrame) -> DataFrame:
    """The rows of ``reached`` to which nobody replied."""
    parents = messages.filter("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    return shared.matched(reached, parents, ["tree", "node"], "left_anti").withColumnRenamed("node", "leaf")


def _upwards(leaves: DataFrame, longest: int, ups: list[DataFrame]) -> DataFrame:
    """depth and node of the paths from the roots to ``leaves`` (tree, leaf, n and others, which stay but for n), of
    which the largest n is ``longest``."""
    kept = [c for c in leaves.columns if c != "n"]
    found = leaves.select(*kept, (F.col("n") - 1).cast("int").alias("depth"), F.col("leaf").alias("node"))
    for k, up in enumerate(ups):  # the ancestors known so far, and those as far above them
        if 1 << k >= longest:
            break
        step = shared.matched(found, up, ["tree", "node"]).select(*kept, (F.col("depth") - (1 << k)).alias("depth"), F.col("above").alias("node"))
        found = found.unionByName(shared.written(step, "paths"))
    return found


def paths(messages: DataFrame) -> DataFrame:
    """tree, leaf, depth, node of all root-to-leaf paths of messages (tree, node, parent).

    A root has a null parent. Messages below a missing parent, or in a circle, have no path. A path
    repeats its inner nodes for each leaf; :func:`conversations` makes only those of chosen leaves.
    """
    reached, ups = _climbed(messages)
    leaves, seen = shared.observed(_leaves(messages, reached).select("tree", "leaf", "n"), "leaves", longest=F.max("n"))
    return _upwards(leaves, seen["longest"] or 0, ups).select("tree", "leaf", "depth", "node")


#: Windows into which the branches of one tree are dealt before the best are compared.
SALTS = 32


def conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The ``branches`` best branches of each tree: tree, leaf, rank and turns in order.

    ``messages`` has tree, node, parent, role, text and score. A branch scores the mean of its
    messages (null as 0); of equal branches the longer, then that of the lesser leaf is first. Other
    branches aren't formatted; that is the feature. Null roles and texts count as empty. Branches are
    ranked by sums along the climb, and paths are made of the chosen ones only, a tree's only branch without
    climbing again; a tree of very many branches is ranked in parts first.
    """
    reached, ups = _climbed(messages)
    leaves = _leaves(messages, reached).withColumn("score", F.col("total") / F.col("n"))
    order = [F.desc("score"), F.desc("n"), F.asc("leaf")]
    if branches == 1:
        best = leaves.groupBy("tree").agg(F.max(F.struct("score", "n", (-F.col("leaf")).alias("l"))).alias("m"), (F.count(F.lit(1)) == 1).alias("alone"))
        best = best.select("tree", (-F.col("m.l")).alias("leaf"), F.lit(1).alias("rank"), "m.n", "alone")
    else:
        salted, of_tree = leaves.withColumn("salt", F.pmod(F.xxhash64("leaf"), F.lit(SALTS))), Window.partitionBy("tree")
        best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("tree", "salt").orderBy(*order))).filter(F.col("rank") <= branches)
        best = best.withColumn("rank", F.row_number().over(of_tree.orderBy(*order))).withColumn("alone", F.count(F.lit(1)).over(of_tree) == 1)
        best = best.filter(F.col("rank") <= branches).select("tree", "leaf", "rank", "n", "alone")
    best, seen = shared.observed(best, "branches", longest=F.max(F.when(~F.col("alone"), F.col("n"))))
    # above the only leaf of a tree are all messages that were reached
    found = shared.matched(reached.select("tree", "node", "n"), best.filter("alone").select("tree", "leaf", "rank"), ["tree"]).select("tree", "leaf", "rank", (F.col("n") - 1).cast("int").alias("depth"), "node")
    if seen["longest"]:
        found = found.unionByName(_upwards(best.filter(~F.col("alone")).drop("alone"), seen["longest"], ups))
    turn = F.struct("depth", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    full = shared.matched(found, messages.select("tree", "node", "role", "text"), ["tree", "node"])
    return full.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_paths(rows: DataFrame) -> DataFrame:
    """``rows`` of tree, leaf, rank and turns with the columns formatted and loss_mask (spans of
    characters) instead of turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, masks = [], []
            for turns in batch.column(3).to_pylist():
                text, mask = formatted([(t["role"], t["text"]) for t in turns])
                texts.append(text)
                masks.append([list(m) for m in mask])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string()), pa.array(masks, pa.list_(pa.list_(pa.int64())))], names=["tree", "leaf", "rank", "formatted", "loss_mask"])

    return shared.mapped(rows.select("tree", "leaf", "rank", "turns"), run, T.StructType([*rows.select("tree", "leaf", "rank").schema.fields, *T.StructType.fromDDL("formatted string, loss_mask array<array<long>>").fields]))


def read_back(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Digests of what formatted conversations hold, read from the text and the mask alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tree, text, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = parsed(text)
                loss = "".join(unescaped(text[a:b]) for a, b in mask)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((tree, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = (batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return shared.mapped(rows.select("tree", "formatted", "loss_mask"), run, T.StructType([T.StructField(key, rows.schema["tree"].dataType), *T.StructType.fromDDL("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields]))


def reply_trees(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as reply trees: each turn replies to the one before it.

    Rows of one conversation and turn are told apart by role and text, and rows that repeat whole
    by number; rows of a null conv_id are left out, unless the key is a struct around it. The score prefers nothing.
    """
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").alias("tree"), "turn", "role", "text")
    w = Window.partitionBy("tree").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    rows = rows.withColumn("node", F.row_number().over(w).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted, and their digests as read back. Rows of a null conv_id are a
    conversation too: keys travel as structs, which are never null themselves."""
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = shared.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    messages = shared.written(reply_trees(rows.withColumn("conv_id", F.struct("conv_id"))), "messages")
    out = read_back(shared.written(format_paths(conversations(messages)), "formatted"))
    return out.withColumn("conv_id", F.col("conv_id.conv_id"))
