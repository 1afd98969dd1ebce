"""Grouped results: runs and windows, FDR counts, pivots, dedup, discriminant matrices, clusters of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FDR_LEVELS = (50, 20, 10, 5, 2, 1)


def points_by_window(scans: DataFrame, *more: str) -> DataFrame:
    """One row per scan point of level 2, keyed by its window; more: columns of the scan to keep."""
    zipped = scans.where("ms_level = 2").select("target_key", "scan_number", "scan_time", *more, F.explode(F.arrays_zip("mz", "intensity")).alias("p"))
    return zipped.select("target_key", "scan_number", "scan_time", *more, F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"))


def last_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; aggregates before it shuffles."""
    best = F.max(F.struct(*order, *[c for c in df.columns if c not in order])).alias("_m")
    return df.groupBy(*key).agg(best).select(*[F.col(f"_m.{c}").alias(c) for c in df.columns])


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    best = F.min(F.struct(*order, *[c for c in df.columns if c not in order])).alias("_m")
    return df.groupBy(*key).agg(best).select(*[F.col(f"_m.{c}").alias(c) for c in df.columns])


def cycles_evenly(df: DataFrame, key: str, slack: float = 2.0) -> DataFrame:
    """One row (even, keys, mean): whether every key comes more than `slack` times and within `slack` of the mean."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    s = counts.agg(F.avg("n").alias("mean"), F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("keys"))
    return s.select(((F.col("low") > slack) & (F.col("high") - F.col("mean") <= slack) & (F.col("mean") - F.col("low") <= slack)).alias("even"), "keys", "mean")


def run_summary(scans: DataFrame, level: str, time: str, value: str) -> DataFrame:
    """Per level: scans, time range and value range."""
    return scans.groupBy(level).agg(
        F.count("*").alias("n"), F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean")
    )


def fdr_counts(df: DataFrame, q: str, levels: tuple[int, ...] = FDR_LEVELS) -> DataFrame:
    """One row: how many q-values are strictly below each percentage."""
    return df.agg(*[F.count_if(F.col(q) < level / 100).alias(f"below_{level}") for level in levels])


def weighted_fdr_mean(counts: DataFrame, levels: tuple[int, ...] = FDR_LEVELS) -> DataFrame:
    """The mean of the counts, from the lowest level up weighted by 1, 0.9, 0.8 ..."""
    total = F.lit(0.0)
    for i, level in enumerate(sorted(levels)):
        total = total + F.col(f"below_{level}") * ((10 - i) / 10)
    return counts.select((total / len(levels)).alias("weighted_mean"))


def fdr_text(counts: DataFrame, levels: tuple[int, ...] = FDR_LEVELS) -> DataFrame:
    return counts.select(F.concat_ws(" | ", *[F.concat(F.lit(f"{p}%: "), F.col(f"below_{p}").cast("string")) for p in sorted(levels)]).alias("summary"))


def trace_pivot(points: DataFrame, keys: list[str], column: str, values: list, intensity: str) -> DataFrame:
    """A row per key with the summed intensity of each ion as a column, 0 without; named ion_<value>."""
    out = points.groupBy(*keys).pivot(column, values).agg(F.sum(intensity))
    return out.select(*keys, *[F.coalesce(F.col(f"`{v}`"), F.lit(0.0)).alias(f"ion_{v}") for v in values])


def ion_count(row_columns: list[str], least_value: float = 0.1, least_ions: int = 1) -> Column:
    """Ions above a value; 0 where there are fewer than least_ions."""
    n = F.lit(0)
    for c in row_columns:
        n = n + F.when(F.col(c) > least_value, 1).otherwise(0)
    return F.when(n >= least_ions, n).otherwise(0)


def centroid(mz: str, intensity: str) -> Column:
    return F.sum(F.col(mz) * F.col(intensity)) / F.sum(intensity)


def dedup_isomers(df: DataFrame, sequence: str, order: list[str]) -> DataFrame:
    """One row per sequence with I as L, the first in order."""
    from ionweave.functions.chem import isoleucine_as_leucine

    keyed = df.withColumn("_s", isoleucine_as_leucine(F.col(sequence)))
    return first_per_key(keyed, ["_s"], order).drop("_s")


def mean_by_decimal(df: DataFrame, value: str, places: int) -> DataFrame:
    """Values that agree to so many places, as one row with their mean and number."""
    from ionweave.functions.numeric import decimal_key

    return df.groupBy(decimal_key(F.col(value), places).alias("key")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def gap_groups(df: DataFrame, by: list[str], value: str, ppm: float) -> DataFrame:
    """df with `grp`: values in order belong together while each is within ppm of the one before; nulls come last, in the last group.

    The gap is a share of the value before as floating-point division has it: behind a zero (0 / 0 too) a group begins, behind a
    negative value none. Equal values are in one group otherwise, so ties in the order change nothing.
    """
    order = Window.partitionBy(*by).orderBy(F.asc_nulls_last(value))
    before = F.lag(value).over(order)
    far = (before == 0) | ((F.col(value) - before) * 1e6 / F.nullif(before, F.lit(0.0)) > ppm)
    return df.withColumn("_new", F.when(F.col(value).isNotNull() & far, 1).otherwise(0)).withColumn("grp", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def running_mean_groups(values: Column, ppm: float) -> Column:
    """Sorted values grouped while each is within ppm of its group's running mean: array of (mean, n).

    The mean moves with every value, which a window can't express; it is one fold over the array.
    """
    start = F.expr("named_struct('done', cast(array() as array<struct<mean:double,n:int>>), 'mean', cast(null as double), 'n', 0)")

    def step(acc: Column, v: Column) -> Column:
        near = acc["mean"].isNotNull() & (F.abs(v - acc["mean"]) * 1e6 <= ppm * acc["mean"])
        grown = F.struct(acc["done"].alias("done"), ((acc["mean"] * acc["n"] + v) / (acc["n"] + 1)).alias("mean"), (acc["n"] + 1).alias("n"))
        closed = F.when(acc["n"] > 0, F.concat(acc["done"], F.array(F.struct(acc["mean"].alias("mean"), acc["n"].alias("n"))))).otherwise(acc["done"])
        return F.when(near, grown).otherwise(F.struct(closed.alias("done"), v.alias("mean"), F.lit(1).alias("n")))

    end = lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], F.array(F.struct(acc["mean"].alias("mean"), acc["n"].alias("n"))))).otherwise(acc["done"])
    return F.aggregate(F.array_sort(values), start, step, end)


def lda_sums(features: list[str], label: str) -> list[Column]:
    """All sums that the discriminant needs, per class, in one aggregate: n, sums and products."""
    out = [F.count("*").alias("n")]
    for i, a in enumerate(features):
        out.append(F.sum(a).alias(f"s_{i}"))
        for j, b in enumerate(features[: i + 1]):
            out.append(F.sum(F.col(a) * F.col(b)).alias(f"p_{i}_{j}"))
    return out


def averagine_rows(spark, low: int = 300, high: int = 10_000, step: int = 10) -> DataFrame:
    """Rows (mass, shares), a bounded table to broadcast."""
    from ionweave.functions.chem import averagine_table

    return spark.createDataFrame([(m, list(s)) for m, s in averagine_table(low, high, step).items()], "mass int, shares array<double>")


def entrapment_summary(df: DataFrame, order: list[Column], decoy: str, entrapment: str, most_decoys: float = 0.5) -> DataFrame:
    """Running numbers of targets, decoys and entrapments until decoys make up `most_decoys` of the rows so far: one row."""
    from ionweave.operators.windows import ordered_running

    rows = ordered_running(df, order, {"decoys": F.when(F.col(decoy), 1).otherwise(0), "traps": F.when(F.col(entrapment), 1).otherwise(0), "rows": F.lit(1)})
    stop = rows.where(F.col("run_decoys") >= F.col("run_rows") * most_decoys).agg(F.min("run_rows").alias("_stop"))
    kept = rows.crossJoin(F.broadcast(stop)).where(F.col("_stop").isNull() | (F.col("run_rows") < F.col("_stop")))
    return kept.agg(F.count("*").alias("n"), F.coalesce(F.max("run_decoys"), F.lit(0)).alias("decoys"), F.coalesce(F.max("run_traps"), F.lit(0)).alias("traps"))
