"""Chat formatting of reply trees.

Root-to-leaf paths are enumerated by self-joins that double the reach: ancestor tables one, two, four ... steps up
are joined with themselves, and each join lets every leaf's path grow to twice its length, so the number of joins is the
logarithm of the deepest path. Branches are ranked by score, and each chosen path becomes one conversation.

The template is `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. A control string inside a role or text gets a
backslash behind its first character, and one more where there are some already, which unescaping takes back; so no text can
open or close a turn. The loss mask is a list of spans of the formatted text: the texts of the assistant's turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionweave.llm.common import Workspace, text_or_empty

# The control strings that a text can't hold as they are. All begin with < or [, which none has later on.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]"]

_RESTS = "|".join(re.escape(c[1:]).replace("/", r"/") for c in CONTROL)
ESCAPE_RE = rf"([<\[])(\\*)({_RESTS})"
UNESCAPE_RE = rf"([<\[])\\(\\*)({_RESTS})"
_UNESCAPE = re.compile(UNESCAPE_RE)
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE_RE, r"$1\\$2$3")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def escape_role(role: Column) -> Column:
    """A role stands on one line."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def root_paths(space: Workspace, nodes: DataFrame) -> DataFrame:
    """nodes (uid, tree_id, node_id, parent_id, role, text; written) -> (leaf, uid, up): the nodes of each leaf's path.

    up counts the steps from the leaf. A parent that the tree doesn't have makes its child a root. Rows that repeat a
    node_id are nodes of their own, but replies belong to the first of them by role and text. Paths that run into a cycle have no root and
    aren't returned.
    """
    first = Window.partitionBy("tree_id", "node_id").orderBy("role", "text", "uid")
    named = nodes.where("node_id is not null").withColumn("n", F.row_number().over(first)).where("n = 1")
    named = named.select(F.col("tree_id").alias("t"), F.col("node_id").alias("p"), F.col("uid").alias("up"))
    jumps = [space.write(nodes.join(named, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("parent_id") == F.col("p"))).select("uid", "up"), "up-1")]
    total = nodes.count()
    while 1 << len(jumps) <= 2 * total:
        last = jumps[-1]
        longer = last.join(last.select(F.col("uid").alias("up"), F.col("up").alias("far")), "up").select("uid", F.col("far").alias("up"))
        longer = space.write(longer, f"up-{1 << len(jumps)}")
        if longer.isEmpty():
            break
        jumps.append(longer)
    # what still has an ancestor further up than there are nodes runs into a cycle
    lost = jumps.pop() if 1 << len(jumps) > 2 * total else None
    leaves = nodes.select("uid").join(jumps[0].select(F.col("up").alias("uid")) if jumps else nodes.select("uid").limit(0), "uid", "left_anti")
    if lost is not None:
        leaves = leaves.join(lost.select("uid"), "uid", "left_anti")
    paths = space.write(leaves.select(F.col("uid").alias("leaf"), "uid", F.lit(0).cast("long").alias("up")), "paths-0")
    for k, jump in enumerate(jumps):
        grown = paths.join(jump.withColumnRenamed("up", "to"), "uid").select("leaf", F.col("to").alias("uid"), (F.col("up") + F.lit(1 << k)).alias("up"))
        paths = space.write(paths.unionByName(grown), f"paths-{k + 1}")
        space.drop(f"paths-{k}")
    return paths


def chat_formatting(
    rows: DataFrame,
    tree_id: Column | None = None,
    node_id: Column | None = None,
    parent_id: Column | None = None,
    score: Column | None = None,
    branches: int | None = None,
    loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row (tree_id, leaf, branch, path_score, n_turns, formatted, loss) for each chosen branch of each tree.

    branch ranks the paths of a tree from 1 by the sum of their nodes' scores, then by leaf; `branches` keeps that
    many. loss: array of (start, length) in code points of `formatted`. Null roles and texts are empty; a null tree_id is a
    tree of its own; see root_paths for repeated nodes. Texts of any length are formatted whole. An empty table gives no rows; other
    columns are ignored.
    """
    space = Workspace(rows.sparkSession, "chat")
    picked = rows.select(
        (tree_id if tree_id is not None else F.col("tree_id")).alias("tree_id"),
        (node_id if node_id is not None else F.col("node_id")).cast("long").alias("node_id"),
        (parent_id if parent_id is not None else F.col("parent_id")).cast("long").alias("parent_id"),
        text_or_empty("role").alias("role"),
        text_or_empty("text").alias("text"),
        F.coalesce((score if score is not None else F.lit(0.0)).cast("double"), F.lit(0.0)).alias("score"),
    )
    nodes = space.write(picked.withColumn("uid", F.monotonically_increasing_id()), "nodes")
    paths = root_paths(space, nodes)
    full = paths.join(nodes.select("uid", "tree_id", "score", "role", "text"), "uid")
    if branches is not None:
        scored = full.groupBy("tree_id", "leaf").agg(F.sum("score").alias("s"))
        rank = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("s"), "leaf"))
        best = scored.withColumn("branch", rank).where(F.col("branch") <= branches).select("leaf")
        full = full.join(best, "leaf", "left_semi")
    head = F.concat(F.lit("<|im_start|>"), escape_role(F.col("role")), F.lit("\n"))
    turns = full.withColumn("head", head).withColumn("body", escape(F.col("text"))).withColumn("turn", F.concat("head", "body", F.lit("<|im_end|>\n")))
    before = Window.partitionBy("leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("role").isin(*loss_roles), F.struct(F.col("start").alias("start"), F.length("body").cast("long").alias("length")))
    grouped = turns.groupBy("leaf").agg(
        F.first("tree_id").alias("tree_id"), F.sum("score").alias("path_score"), F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("pos"), "turn", span.alias("span")))).alias("all")
    )
    out = grouped.select(
        "tree_id", "leaf", "path_score", F.size("all").cast("long").alias("n_turns"), F.array_join(F.col("all.turn"), "").alias("formatted"), F.filter(F.col("all.span"), lambda s: s.isNotNull()).alias("loss")
    )
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("path_score"), "leaf"))
    return out.withColumn("branch", rank)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, as they were before formatting."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return turns


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of what the formatted texts hold: (tree_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(text)
                digest = hashlib.sha256()
                for role, body in turns:
                    digest.update(f"{role}\n{body}\n".encode())
                loss = "".join(unescape(text[s["start"] : s["start"] + s["length"]]) for s in spans)
                for column, value in zip(out, (len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=["tree_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.select(F.col("tree_id").cast("long").alias("tree_id"), "formatted", "loss").mapInArrow(run, "tree_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
