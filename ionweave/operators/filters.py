"""Filters and checks. Interval ends are part of each operator's meaning and are named in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionweave.functions import chem


def closed(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """low <= value <= high; reaches the Parquet scan."""
    return df.where(F.col(column).between(low, high))


def opened(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """low < value < high."""
    return df.where((F.col(column) > low) & (F.col(column) < high))


def within_ppm(df: DataFrame, column: str, centre: Column, ppm: float, scale: float = 0.45) -> DataFrame:
    """Strictly nearer to the centre than `scale` of the tolerance."""
    return df.where(F.abs(F.col(column) - centre) < centre * F.lit(ppm * scale / 1e6))


def at_level(scans: DataFrame, level: int) -> DataFrame:
    return scans.where(F.col("ms_level") == level)


def in_window(scans: DataFrame, target_key: str) -> DataFrame:
    return scans.where(F.col("target_key") == target_key)


def without_empty_points(points: DataFrame, least: float = 1e-5) -> DataFrame:
    return points.where(F.abs(F.col("intensity")) > least)


def ions_in_range(ions: Column, low: float = 200.0, high: float = 1500.0) -> Column:
    """Array of ion structs: low < mz <= high."""
    return F.filter(ions, lambda i: (i["mz"] > low) & (i["mz"] <= high))


def eligible(library: DataFrame, length: tuple[int, int], charge: tuple[int, int]) -> DataFrame:
    """Bare length and charge in closed ranges; empty sequences never are."""
    n = chem.bare_length(F.col("peptide"))
    return library.where((n > 0) & n.between(*length) & F.col("charge").between(*charge))


def valid_sequences(library: DataFrame) -> DataFrame:
    return library.where(chem.is_valid_sequence(F.col("peptide")))


def precursors_in_range(library: DataFrame, low: float, high: float) -> DataFrame:
    return library.where(F.col("precursor_mz").between(low, high))


def correlated(df: DataFrame, column: str, least: float = 0.9) -> DataFrame:
    return df.where(F.col(column) > least)


def enough_fragments(df: DataFrame, count: str, least: float) -> DataFrame:
    return df.where(F.col(count) >= least)


def without_outliers(df: DataFrame, error: str, sigma: str, times: float = 3.0) -> DataFrame:
    """Keeps rows whose error is within `times` sigmas of the mean and whose own sigma is at most the median one.

    Both limits come from one aggregate to a single row.
    """
    limits = df.agg(F.avg(error).alias("_mean"), F.stddev_pop(error).alias("_sigma"), F.median(sigma).alias("_middle"))
    joined = df.crossJoin(F.broadcast(limits))
    return joined.where((F.abs(F.col(error) - F.col("_mean")) <= times * F.col("_sigma")) & (F.col(sigma) <= F.col("_middle"))).drop("_mean", "_sigma", "_middle")


def checked_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Raises when a feature is NaN or infinite."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    first, *rest = columns
    return df.select(*[F.when(bad, F.raise_error(F.lit("a feature is not finite")).cast("double")).otherwise(F.col(c)).alias(c) if c == first else F.col(c) for c in df.columns])


def repeated_only(df: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Rows of keys that come `least` times or more."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key)
    return df.join(counts, key, "left_semi")


def top_share(df: DataFrame, by: str, share: float, tie: str, partition: list[str] | None = None) -> DataFrame:
    """The round(share * n) rows with the largest values, halves rounded up; ties by `tie`.

    Without a partition the cut is found as an exact quantile of one aggregate, and only rows at the cut are ranked.
    """
    if partition:
        rank = F.row_number().over(Window.partitionBy(*partition).orderBy(F.desc(by), tie))
        n = F.count("*").over(Window.partitionBy(*partition))
        return df.withColumn("_rank", rank).withColumn("_n", n).where(F.col("_rank") <= F.floor(F.col("_n") * share + 0.5)).drop("_rank", "_n")
    from ionweave.operators.windows import ordered_running

    counts = df.groupBy(by).agg(F.count("*").alias("_n"))
    want = int(df.count() * share + 0.5)
    ordered = ordered_running(counts, [F.desc(by)], {"n": F.col("_n")}).withColumn("_before", F.col("run_n") - F.col("_n"))
    cut = ordered.where((F.col("_before") < want) & (F.col("run_n") >= want)).select(F.col(by).alias("_cut"), (F.lit(want) - F.col("_before")).alias("_take"))
    joined = df.crossJoin(F.broadcast(cut))  # one row
    above = joined.where(F.col(by) > F.col("_cut")).drop("_cut", "_take")
    # any share of the rows may be tied at the cut, so their order is spread over tasks too
    edge = ordered_running(joined.where(F.col(by) == F.col("_cut")), [F.asc(tie)], {"r": F.lit(1)})
    return above.unionByName(edge.where(F.col("run_r") <= F.col("_take")).drop("_cut", "_take", "run_r"))


# --- assertions -------------------------------------------------------------------------------------------------


class CheckFailed(ValueError):
    pass


def expect(condition: bool, message: str) -> None:
    if not condition:
        raise CheckFailed(message)


def expect_rows(df: DataFrame) -> DataFrame:
    expect(not df.isEmpty(), "no rows")
    return df


def expect_file(path: str, spark) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    expect(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop), f"no file {path}")


def expect_unique(df: DataFrame, *keys: str) -> DataFrame:
    twice = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").limit(1)
    expect(twice.isEmpty(), f"repeated {', '.join(keys)}")
    return df


def expect_in_range(df: DataFrame, column: str, low: float | None = None, high: float | None = None, include: bool = True) -> DataFrame:
    """Raises, while the rows are read, on a value out of range; null fails too."""
    c = F.col(column)
    good = F.lit(True)
    if low is not None:
        good = good & ((c >= low) if include else (c > low))
    if high is not None:
        good = good & ((c <= high) if include else (c < high))
    kind = df.schema[column].dataType
    return df.withColumn(column, F.when(good, c).otherwise(F.raise_error(F.lit(f"{column} out of range")).cast(kind)))


def expect_keys(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    expect(not missing, f"no columns {', '.join(missing)}")
    return df


def as_number(column: Column, kind: str = "double") -> Column:
    """The value as a number; text that isn't one is an error."""
    return F.when(column.isNotNull() & column.try_cast(kind).isNull(), F.raise_error(F.lit("not a number")).cast(kind)).otherwise(column.try_cast(kind))
