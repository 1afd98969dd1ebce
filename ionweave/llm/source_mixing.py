"""Mixing sources to target weights by the cube method (Deville and Tillé 2004).

Each source gets a target; target over size is the rate at which every document of it is expected. The whole part of
the rate is taken of every document, the fraction is its inclusion probability. The cube's flight moves
these probabilities to 0 or 1 inside the null space of two constraints, the number of documents and the number of words,
so both totals stay where they were. It runs in blocks of bounded size; each block leaves at most two undecided
documents, and these gather into the blocks of the next flight until one small landing problem is left per source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionweave.llm.common import Workspace, text_or_empty, word_count

BLOCK = 4_096
#: More flights than any table needs; what is undecided behind them is an error, never left out.
MOST_FLIGHTS = 40
EPS = 1e-9


def source_ranks(space: Workspace, sizes: DataFrame) -> DataFrame:
    """sizes (source, ...) with a dense 0-based `rank` by code point, null last; sorted by range, no single task.

    Strings compare by UTF-8 bytes, which is code point order.
    """
    ordered = sizes.withColumn("last", F.col("source").isNull()).repartitionByRange("last", F.coalesce("source", F.lit("")))
    ordered = space.write(ordered.withColumn("part", F.spark_partition_id()), "ranked")
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"), F.min(F.struct("last", F.coalesce("source", F.lit("")))).alias("first"))
    before = parts.withColumn("base", F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)))  # a row per partition
    own = F.row_number().over(Window.partitionBy("part").orderBy("last", "source"))
    return ordered.join(before.select("part", F.coalesce("base", F.lit(0)).alias("base")), "part").withColumn("rank", F.col("base") + own - 1).drop("part", "base", "last")


def targets(space: Workspace, sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sizes (source, n_docs, source_size) with `target`.

    Sources in order weigh weights[rank mod len]. They share `share` of all sizes by weight; a target stops at `most`
    times its source's size and the excess goes to the others, until none is above. That is min(most * size, level *
    weight) for one level, which rises as sources are filled; each step is one aggregate to a single row.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = space.write(source_ranks(space, sizes).withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))), "weighed")
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level = 0.0
    full = F.col("source_size") * most <= F.col("weight") * F.lit(level)
    while True:
        full = (F.col("source_size") * most <= F.col("weight") * F.lit(level)) | (F.col("source_size") == 0)
        got = rows.agg(F.sum(F.when(full, F.col("source_size") * most).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if not got["weight"]:
            break
        raised = (total - got["full"]) / got["weight"]
        if raised <= level * (1 + 1e-12):
            break
        level = raised
    return rows.withColumn("target", F.when(full, F.col("source_size") * most).otherwise(F.col("weight") * level).cast("double")).drop("rank", "weight")


def flight(chance: np.ndarray, size: np.ndarray, land: bool) -> np.ndarray:
    """Moves chances to 0 or 1 keeping sum(chance) and sum(size * chance); at most two stay between, none if land.

    The documents are taken in the order given: three undecided ones have a direction that keeps both sums, and the
    step along it ends where one of them is decided. Which way is drawn from a generator seeded by the sizes.
    """
    chance = chance.astype(np.float64)
    rng = np.random.default_rng([len(chance), int(size.sum()) & 0xFFFFFFFF])
    draws = rng.random(len(chance) + 3).tolist()
    p, s = chance.tolist(), size.astype(np.float64).tolist()
    active: list[int] = []
    for i in range(len(p)):
        if not EPS < p[i] < 1 - EPS:
            continue
        active.append(i)
        if len(active) < 3:
            continue
        a, b, c = active
        ua, ub, uc = s[b] - s[c], s[c] - s[a], s[a] - s[b]  # orthogonal to (1, 1, 1) and to the sizes
        if ua == ub == uc == 0:
            ua, ub, uc = 1.0, -1.0, 0.0
        up, down = 1e300, 1e300
        for j, u in ((a, ua), (b, ub), (c, uc)):
            if u > 0:
                up, down = min(up, (1 - p[j]) / u), min(down, p[j] / u)
            elif u < 0:
                up, down = min(up, -p[j] / u), min(down, (p[j] - 1) / u)
        step = up if draws[i] * (up + down) < down else -down
        for j, u in ((a, ua), (b, ub), (c, uc)):
            p[j] = min(1.0, max(0.0, p[j] + step * u))
        active = [j for j in active if EPS < p[j] < 1 - EPS]
    if land and active:  # the choice that keeps the words nearest to what the chances ask for, then the documents
        want_words, want_docs = sum(s[j] * p[j] for j in active), sum(p[j] for j in active)
        picks = [[k >> n & 1 for n in range(len(active))] for k in range(1 << len(active))]
        best = min(picks, key=lambda x: (abs(sum(s[j] * y for j, y in zip(active, x, strict=True)) - want_words), abs(sum(x) - want_docs), x))
        for j, y in zip(active, best, strict=True):
            p[j] = float(y)
    out = np.array([0.0 if x <= EPS else 1.0 if x >= 1 - EPS else x for x in p])
    return exchanged(out, chance, size) if land else out


def exchanged(taken: np.ndarray, chance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """After landing: the one exchange of a taken with an untaken document that brings the words nearest to what was asked for.

    The flight leaves the largest and the smallest document to the end, so landing alone may miss by half a large one.
    Only documents that had a choice take part, and all of a source had the same chance.
    """
    free = (chance > EPS) & (chance < 1 - EPS)
    missing = float(((chance - taken) * size).sum())
    inside, outside = np.flatnonzero(free & (taken > 0.5)), np.flatnonzero(free & (taken < 0.5))
    if not len(inside) or not len(outside) or abs(missing) < 1:
        return taken
    outside = outside[np.argsort(size[outside], kind="stable")]
    wanted = size[inside] + missing
    at = np.clip(np.searchsorted(size[outside], wanted), 1, max(len(outside) - 1, 1))
    best = None
    for k in (at - 1, np.minimum(at, len(outside) - 1)):
        off = np.abs(size[outside[k]] - wanted)
        i = int(off.argmin())
        if best is None or off[i] < best[0]:
            best = (float(off[i]), int(inside[i]), int(outside[k[i]]))
    if best[0] < abs(missing):
        taken[best[1]], taken[best[2]] = 0.0, 1.0
    return taken


FLOWN = "uid long, seed long, sid long, size long, chance double"


def _fly(rows: DataFrame, counts: DataFrame, salt: int) -> DataFrame:
    """One flight: sources with more than BLOCK undecided documents are dealt into blocks, the others land.

    Blocks and their order follow from `seed`, a hash of what the row says, so neither files nor cores change the choice.
    """

    def run(key: tuple, t: pa.Table) -> pa.Table:
        land = key[1].as_py() == 1
        t = t.sort_by([("ord", "ascending"), ("seed", "ascending"), ("size", "ascending"), ("uid", "ascending")])
        moved = flight(t["chance"].to_numpy(), t["size"].to_numpy(), land)
        return t.select(["uid", "seed", "sid", "size"]).append_column("chance", pa.array(moved))

    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("long")
    dealt = rows.join(counts, "sid").select(
        "uid", "seed", "sid", "size", "chance", blocks.alias("blocks"), F.xxhash64("seed", F.lit(salt)).alias("ord"), F.pmod(F.xxhash64("seed", F.lit(salt + 1000)), blocks).alias("block")
    )
    return dealt.groupBy("sid", "blocks", "block").applyInArrow(run, FLOWN)


def decide(space: Workspace, rows: DataFrame) -> DataFrame:
    """rows (uid, seed, sid, size, chance; written) -> (uid, extra): 1 where the fraction is taken; rows without aren't returned.

    A flight leaves two documents of a block of 2,048 to 4,096 or so, so the number of flights is a logarithm to about that base.
    """
    undecided = rows.where((F.col("chance") > EPS) & (F.col("chance") < 1 - EPS))
    done = [rows.where(F.col("chance") >= 1 - EPS).select("uid", F.lit(1).alias("extra"))]
    for k in range(MOST_FLIGHTS):
        counts = undecided.groupBy("sid").agg(F.count("*").alias("n"))
        flown = space.write(_fly(undecided, counts, k), f"flight-{k}")
        done.append(flown.where("chance = 1.0").select("uid", F.lit(1).alias("extra")))
        undecided = flown.where("chance > 0.0 and chance < 1.0")
        if undecided.isEmpty():
            break
    else:
        raise RuntimeError(f"documents are undecided after {MOST_FLIGHTS} flights")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mix_counts(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row (uid, doc_id, text_hash, source, size, source_size, target, copies) for each row of docs.

    size is the text's number of words (null text: 0); copies is how often the mix takes the document, at most
    `most`. Sources are ordered by code point, null is a source of its own and comes last; empty names are sources too.
    A source without words has target 0 and takes nothing. Repeated rows are chosen each for themselves. The choice
    follows from the rows alone: reruns agree whatever the files, partitions and cores (uid numbers rows of this run only).
    Texts of any length are counted whole. An empty table gives no rows; other columns are ignored.
    """
    space = Workspace(docs.sparkSession, "mixing")
    text = text_or_empty(text_col)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"))
    # rows that are equal in all of this are told apart by their number among each other, which no order of rows can change
    counted = base.groupBy("doc_id", "text_hash", "source", "size").agg(F.count("*").alias("row_count"))
    each = counted.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "row_count"))).drop("row_count")
    seed = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text_hash", "source", F.col("source").isNull(), "nth")
    sized = space.write(each.select("doc_id", "text_hash", "source", "size", seed.alias("seed"), F.monotonically_increasing_id().alias("uid")), "sized")
    per = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    goal = space.write(targets(space, per, weights, share, most).withColumn("sid", F.xxhash64("source", F.col("source").isNull())), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # rows of one source may be a third of all: the join has a row per source on its other side, which AQE splits or broadcasts
    key = F.coalesce(F.col("source"), F.lit("")).alias("k"), F.col("source").isNull().alias("none")
    rated = sized.select("*", *key).join(goal.select("source_size", "target", "sid", F.floor(rate + EPS).alias("whole"), rate.alias("rate"), *key), ["k", "none"]).drop("k", "none")
    rated = space.write(rated.withColumn("chance", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole"))), "rated")
    extra = decide(space, rated.where("size > 0").select("uid", "seed", "sid", "size", "chance"))
    out = rated.join(extra, "uid", "left").withColumn("copies", (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("int"))
    return out.select("uid", "doc_id", "text_hash", "source", "size", "source_size", "target", "copies")


def taken(copies: Column, size: Column) -> Column:
    return (copies * size).cast("long")
