"""Ordered-sequence operators.

Windows run per key. Where the order is over a whole table, ordered_running gives running sums by ranges: rows are
range-partitioned, each range sums itself and adds the totals of the ranges before it, so no task sees all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionweave.storage import staged


def frame_index(df: DataFrame, by: list[str], order: list[str], name: str = "frame_index") -> DataFrame:
    """0-based number of each row in its key's order."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))


def spread_frame_index(df: DataFrame, by: list[str], order: list[str], name: str = "frame_index") -> DataFrame:
    """frame_index for keys of any size: rows are dealt by ranges of (by, order), numbered in each range, and moved by what a key has in earlier ranges."""
    parts = staged(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy(*by, "_part").agg(F.count("*").alias("_n"))  # a row per key and range
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1
    return parts.withColumn("_i", own).join(offsets, [*by, "_part"]).withColumn(name, (F.col("_i") + F.col("_o")).cast("long")).drop("_part", "_i", "_o")


def clamped(index: Column, low: Column | int, high: Column | int) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.least(F.greatest(index, as_column(low)), as_column(high))


def intensity_rank(ions: Column) -> Column:
    """Array of ion structs with `rank` from 0 by falling intensity, then m/z; the order stays by rank."""
    keyed = F.transform(ions, lambda i: F.struct((-i["intensity"]).alias("k"), i["mz"].alias("m"), i.alias("ion")))
    return F.transform(F.array_sort(keyed), lambda k, n: F.struct(k["ion"].alias("ion"), n.alias("rank")))


def ordered_running(df: DataFrame, order: list[Column], sums: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """df with `run_<name>`: the sum of each column over all rows up to and with this one, in the order of the whole table.

    The order must be total for reruns to agree.
    """
    keyed = df.withColumns({f"_k{i}": c for i, c in enumerate(sums.values())})
    dealt = keyed.repartitionByRange(partitions, *order) if partitions else keyed.repartitionByRange(*order)
    parts = staged(dealt.withColumn("_part", F.spark_partition_id()))  # read twice: the numbers must not move
    totals = parts.groupBy("_part").agg(*[F.sum(f"_k{i}").alias(f"_t{i}") for i in range(len(sums))])  # a row per range
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_part", *[F.coalesce(F.sum(f"_t{i}").over(earlier), F.lit(0)).alias(f"_o{i}") for i in range(len(sums))])
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = parts.join(F.broadcast(before), "_part")
    for i, name in enumerate(sums):
        joined = joined.withColumn(f"run_{name}", F.sum(f"_k{i}").over(own) + F.col(f"_o{i}"))
    return joined.drop("_part", *[f"_k{i}" for i in range(len(sums))], *[f"_o{i}" for i in range(len(sums))])


def running_prefix(df: DataFrame, order: list[Column], decoy: Column, share: float = 0.5) -> DataFrame:
    """Rows in order until decoys make up `share` of the rows so far; that row and all behind it go."""
    rows = ordered_running(df, order, {"d": F.when(decoy, 1).otherwise(0), "n": F.lit(1)})
    stop = rows.where(F.col("run_d") >= F.col("run_n") * share).agg(F.min("run_n").alias("_stop"))
    return rows.crossJoin(F.broadcast(stop)).where(F.col("_stop").isNull() | (F.col("run_n") < F.col("_stop"))).drop("run_d", "run_n", "_stop")


def cut_at_first(df: DataFrame, order: list[Column], stop: Column) -> DataFrame:
    """Rows in order up to and with the first one where `stop` holds."""
    rows = ordered_running(df, order, {"s": F.when(stop, 1).otherwise(0)})
    return rows.where((F.col("run_s") == 0) | ((F.col("run_s") == 1) & stop)).drop("run_s")


def q_values(df: DataFrame, score: str, is_decoy: str) -> DataFrame:
    """df with `q_value` and `decoy_ratio`; decoys get q = 1.

    nd(x), nt(x): decoys and targets with a score of at least x; p: the largest decoy score below a target's score s. With a
    p above the smallest decoy score q = min(1, (nd(s) + 1) / max(1, nt(p))), else min(1, nd(s) / max(1, nt(s))).
    All are running counts over the distinct scores, which are aggregated first, so ties cost nothing.
    """
    per = df.groupBy(F.col(score).alias("_s")).agg(F.sum(F.when(F.col(is_decoy), 1).otherwise(0)).alias("_d"), F.sum(F.when(F.col(is_decoy), 0).otherwise(1)).alias("_t"))
    run = ordered_running(per, [F.desc("_s")], {"nd": F.col("_d"), "nt": F.col("_t")})
    decoys = run.where("_d > 0").select(F.col("_s").alias("_p"), F.col("run_nt").alias("_nt_p"))
    least = decoys.agg(F.min("_p").alias("_low"))
    # the decoy below a score is the one whose count of decoys above it is the score's own: an equi-join on that rank
    ranked = run.where("_d > 0").select((F.col("run_nd") - F.col("_d")).alias("_above"), F.col("_s").alias("_p"), F.col("run_nt").alias("_nt_p"))
    totals = df.agg(F.count_if(F.col(is_decoy)).alias("_all_d"), F.count_if(~F.col(is_decoy)).alias("_all_t"))
    table = run.where("_t > 0").join(ranked, F.col("run_nd") == F.col("_above"), "left").crossJoin(F.broadcast(least))
    first = F.least(F.lit(1.0), (F.col("run_nd") + 1) / F.greatest(F.lit(1), F.col("_nt_p")))
    plain = F.least(F.lit(1.0), F.col("run_nd") / F.greatest(F.lit(1), F.col("run_nt")))
    q = table.select("_s", F.when(F.col("_p").isNotNull() & (F.col("_p") > F.col("_low")), first).otherwise(plain).alias("_q"))
    joined = df.join(q, F.col(score) == F.col("_s"), "left").crossJoin(F.broadcast(totals))
    ratio = F.least(F.lit(1.0), F.col("_all_d") / F.col("_all_t"))
    return joined.select(
        *df.columns,
        F.when(F.col(is_decoy), 1.0).otherwise(F.coalesce("_q", F.lit(1.0))).alias("q_value"),
        F.when(F.col("_all_t") > 0, ratio).otherwise(F.lit(1.0)).alias("decoy_ratio"),
    )


def paired_q_values(pairs: DataFrame, target: str, decoy: str, library_decoy: str, inverse: bool = False) -> DataFrame:
    """pairs (one target and one decoy score per row) with the target's q_value; a library decoy's both sides count as decoys.

    inverse: lower scores are better, as those of the classifier; 1 / score takes their place.
    """
    turn = (lambda c: F.when(F.col(c) != 0, 1.0 / F.col(c)).otherwise(F.lit(float("inf")))) if inverse else F.col
    rows = pairs.withColumn("_row", F.monotonically_increasing_id())
    sides = F.explode(
        F.array(F.struct(turn(target).cast("double").alias("score"), F.col(library_decoy).alias("decoy"), F.lit(0).alias("side")), F.struct(turn(decoy).cast("double").alias("score"), F.lit(True).alias("decoy"), F.lit(1).alias("side")))
    )
    flat = rows.select(*rows.columns, sides.alias("_x")).select(*rows.columns, "_x.*")
    return q_values(flat, "score", "decoy").where("side = 0").drop("_row", "score", "decoy", "side")


def runner_up(df: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """Per key: best score, its lead over the second and third, number, and mean and sigma of the leads over all others."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    ranked = df.withColumn("_r", F.row_number().over(order)).withColumn("_top", F.first(score).over(order))
    lead = F.when(F.col("_r") > 1, F.col("_top") - F.col(score))
    at = lambda r: F.max(F.when(F.col("_r") == r, F.col("_top") - F.col(score)))
    return ranked.groupBy(*by).agg(
        F.max("_top").alias("best"), at(2).alias("lead_2"), at(3).alias("lead_3"), F.count("*").alias("n"), F.coalesce(F.avg(lead), F.lit(0.0)).alias("lead_mean"), F.coalesce(F.stddev_pop(lead), F.lit(0.0)).alias("lead_sigma")
    )


def islands(df: DataFrame, by: list[str], index: str, least: int = 2) -> DataFrame:
    """Runs of consecutive numbers of at least that length: (by, first, length)."""
    one = df.select(*by, index).distinct()
    grp = F.col(index) - F.row_number().over(Window.partitionBy(*by).orderBy(index))
    return one.withColumn("_g", grp).groupBy(*by, "_g").agg(F.min(index).alias("first"), F.count("*").alias("length")).where(F.col("length") >= least).drop("_g")


def run_ids(df: DataFrame, by: list[str], order: list[str], key: str) -> DataFrame:
    """df with `run`: a number that rises whenever the key changes in the order."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def cycle_ids(df: DataFrame, by: list[str], order: list[str], is_last: Column) -> DataFrame:
    """df with `cycle`, which rises behind every row that ends one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_e", F.when(is_last, 1).otherwise(0)).withColumn("cycle", F.coalesce(F.sum("_e").over(w), F.lit(0))).drop("_e")


def extrema(df: DataFrame, by: list[str], order: str, value: str, precision: float = 1e4, troughs: bool = False) -> DataFrame:
    """Rows that are local maxima (minima) of their key's sequence.

    Values are compared as whole numbers of 1 / precision of the key's maximum. A maximum is above its left and not below its
    right neighbour; the first needs no left one, the last no right one. Keys that add up to nothing have none.
    """
    every = Window.partitionBy(*by)
    w = every.orderBy(order)
    sign = -1 if troughs else 1
    level = F.round(F.col(value) / F.max(value).over(every) * precision).cast("long") * sign
    rows = df.withColumn("_sum", F.sum(value).over(every)).where(F.abs("_sum") > 1e-12).withColumn("_l", level)
    left, right = F.lag("_l").over(w), F.lead("_l").over(w)
    marked = rows.withColumn("_a", left).withColumn("_b", right)
    return marked.where((F.col("_a").isNull() | (F.col("_l") > F.col("_a"))) & (F.col("_b").isNull() | (F.col("_l") >= F.col("_b")))).drop("_sum", "_l", "_a", "_b")


def smoothed(df: DataFrame, by: list[str], order: str, value: str, kernel: list[float], name: str = "smoothed") -> DataFrame:
    """Dot product of the kernel with the centred window; beyond the ends stands the mean of the first / last half window and its centre.

    Sequences no longer than the kernel stay as they are.
    """
    half = (len(kernel) - 1) // 2
    every = Window.partitionBy(*by)
    w = every.orderBy(order)
    back = every.orderBy(F.desc(order))
    rows = df.withColumn("_i", F.row_number().over(w)).withColumn("_j", F.row_number().over(back)).withColumn("_n", F.count("*").over(every))
    rows = rows.withColumn("_head", F.avg(F.when(F.col("_i") <= half + 1, F.col(value))).over(every)).withColumn("_tail", F.avg(F.when(F.col("_j") <= half + 1, F.col(value))).over(every))
    total = F.lit(0.0)
    for k, weight in enumerate(kernel):
        shift = k - half
        near = F.col(value) if shift == 0 else F.lag(value, -shift).over(w) if shift < 0 else F.lead(value, shift).over(w)
        total = total + F.lit(float(weight)) * F.coalesce(near, F.col("_head") if shift < 0 else F.col("_tail"))
    return rows.withColumn(name, F.when(F.col("_n") > len(kernel), total).otherwise(F.col(value))).drop("_i", "_j", "_n", "_head", "_tail")


def trapezoid(df: DataFrame, by: list[str], x: str, y: str, name: str = "area") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(x)
    part = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return df.withColumn("_p", part).groupBy(*by).agg(F.coalesce(F.sum("_p"), F.lit(0.0)).alias(name))


def first_difference(df: DataFrame, by: list[str], order: str, value: str, name: str = "difference") -> DataFrame:
    """The next value less this one; null at the end."""
    return df.withColumn(name, F.lead(value).over(Window.partitionBy(*by).orderBy(order)) - F.col(value))


def evenly_spaced(df: DataFrame, start: str, slack: float = 0.01) -> DataFrame:
    """One row (even, width): whether all gaps between sorted starts agree. For tables of windows, of hundreds of rows."""
    gaps = df.select(start).distinct().withColumn("_g", F.lead(start).over(Window.orderBy(start)) - F.col(start)).where("_g is not null")
    return gaps.agg((F.max("_g") - F.min("_g") <= slack).alias("even"), F.avg("_g").alias("width"))


def grouped_scans(df: DataFrame, by: list[str], order: str, carry: str, skip: int = 0) -> DataFrame:
    """Each scan with the list of itself and its next 1 + skip ones."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(0, 1 + skip)
    return df.withColumn("grp", F.collect_list(carry).over(w))


def scaled_columns(df: DataFrame, columns: list[str], tiny: float = 1e-12) -> DataFrame:
    """Min-max scaled over the whole table: one aggregate, one row broadcast."""
    limits = df.agg(*[x for c in columns for x in (F.min(c).alias(f"_l_{c}"), F.max(c).alias(f"_h_{c}"))])
    joined = df.crossJoin(F.broadcast(limits))
    scale = lambda c: ((F.col(c) - F.col(f"_l_{c}")) / F.greatest(F.col(f"_h_{c}") - F.col(f"_l_{c}"), F.lit(tiny))).alias(c)
    return joined.select(*[scale(c) if c in columns else F.col(c) for c in df.columns])


def windows_around(df: DataFrame, by: list[str], index: str, start: str, length: str, factor: float, points: DataFrame) -> DataFrame:
    """Points of frames [start - factor * length, start + factor * length) of each row, both measured from its start."""
    spans = df.withColumn("_lo", F.col(start) - F.col(length) * factor).withColumn("_hi", F.col(start) + F.col(length) * factor)
    from ionweave.operators.joins import range_join

    return range_join(points, spans, index, "_lo", "_hi", 32.0, by).where(F.col(index) < F.col("_hi")).drop("_lo", "_hi")
