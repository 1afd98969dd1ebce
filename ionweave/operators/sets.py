"""Set operations, sorts and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def targets_and_decoys(pairs: DataFrame, shared: list[str], target: dict[str, str], decoy: dict[str, str]) -> DataFrame:
    """Two rows for each pair; target and decoy map result names to columns of the pair."""
    side = lambda names, flag: F.struct(*[F.col(c).alias(n) for n, c in names.items()], F.lit(flag).alias("is_decoy"))
    return pairs.select(*shared, F.explode(F.array(side(target, False), side(decoy, True))).alias("_x")).select(*shared, "_x.*")


def found_of(found: Column, theory: Column) -> Column:
    """Distinct theoretical numbers that were found."""
    return F.array_sort(F.array_intersect(F.array_distinct(theory), found))


def without_places(values: Column, places: Column) -> Column:
    return F.transform(F.filter(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda p: ~F.array_contains(places, p["i"])), lambda p: p["v"])


def insert_absent(base: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """base and those rows of more whose key it doesn't have; one row per key of more, the smallest."""
    from ionweave.operators.aggregates import first_per_key

    new = first_per_key(more, key, key).join(base.select(*key).distinct(), key, "left_anti")
    return base.unionByName(new.select(*base.columns))


def difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.join(b.select(*key).distinct(), key, "left_anti")


def sorted_points(points: Column, by: str = "mz", descending: bool = False) -> Column:
    keyed = F.transform(points, lambda p: F.struct((-p[by] if descending else p[by]).alias("k"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda k: k["p"])


def by_discriminant(score: str, cosine: str, over_time: str, is_decoy: str, row_id: str) -> list[Column]:
    """Order of candidates: best first, decoys first among equals; scores count to 1e-9, so that ties are ties on every machine."""
    return [F.desc(F.round(score, 9)), F.desc(F.round(cosine, 9)), F.desc(F.round(over_time, 9)), F.desc(is_decoy), F.asc(row_id)]


def by_classifier(classifier: str, score: str, row_id: str) -> list[Column]:
    return [F.asc(classifier), F.desc(score), F.asc(row_id)]


def is_sorted(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """One row: whether value never falls along the order of each key."""
    step = F.col(value) < F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return df.select(step.alias("_f")).agg((F.count_if(F.col("_f")) == 0).alias("is_sorted"))


def top_ions(ions: Column, n: int) -> Column:
    """The n most intense of an array of ion structs."""
    return F.slice(sorted_points(ions, "intensity", True), 1, n)


def best_per_group(df: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    best = F.max(F.struct(score, F.struct((-F.col(tie)).alias("_t")), *[c for c in df.columns if c != score])).alias("_m")
    return df.groupBy(*by).agg(best).select(*[F.col(f"_m.{c}").alias(c) for c in df.columns])


def within_of_best(df: DataFrame, by: list[str], score: str, slack: float = 1.0) -> DataFrame:
    best = F.max(score).over(Window.partitionBy(*by))
    return df.withColumn("_b", best).where(F.col(score) >= F.col("_b") - slack).drop("_b")


def training_prefix(df: DataFrame, order: list[Column], q: str, least: int = 50_000) -> DataFrame:
    """The first max(rows with q < 0.5, min(least, all)) rows."""
    s = df.agg(F.count_if(F.col(q) < 0.5).alias("good"), F.count("*").alias("n")).first()
    return df.orderBy(*order).limit(max(s["good"], min(least, s["n"])))


def centre_out(windows: DataFrame, order: str, most: int = 16) -> DataFrame:
    """At most so many windows, alternately right and left of the middle one."""
    n = windows.count()
    numbered = windows.withColumn("_i", F.row_number().over(Window.orderBy(order)) - 1)
    offset = F.col("_i") - n // 2
    place = F.when(offset >= 0, 2 * offset).otherwise(-2 * offset - 1)
    return numbered.withColumn("place", place).orderBy("place").limit(most).drop("_i")


def shuffled(df: DataFrame, row_id: str, seed: int = 666) -> DataFrame:
    """A fixed random order."""
    return df.orderBy(F.xxhash64(row_id, F.lit(seed)), row_id)


def split_train_test(df: DataFrame, row_id: str, share: float = 0.2, seed: int = 666) -> tuple[DataFrame, DataFrame]:
    """By a hash of the id: reruns and other partitions give the same split."""
    test = F.pmod(F.xxhash64(row_id, F.lit(seed)), F.lit(10_000)) < int(share * 10_000)
    return df.where(~test), df.where(test)


def feature_subsets(features: list[str], low: int = 10, high: int = 29, n: int = 1000, seed: int = 666) -> list[list[str]]:
    import random

    rng = random.Random(seed)
    return [rng.sample(features, rng.randint(min(low, len(features)), min(high, len(features)))) for _ in range(n)]


def in_parts(df: DataFrame, parts: int, contiguous_by: list[str] | None = None) -> DataFrame:
    """df with `part`: round robin by a hash of the row, or ranges of an order."""
    if contiguous_by:
        return df.repartitionByRange(parts, *contiguous_by).withColumn("part", F.spark_partition_id())
    return df.withColumn("part", F.pmod(F.xxhash64(*df.columns), F.lit(parts)).cast("int"))
