"""Vectors as array columns: similarities, scales, thresholds, shapes and packed bytes."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, floor: float = 1e-5, places: int | None = 4) -> Column:
    """Norms are raised to `floor`; rounded unless places is None."""
    value = dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))
    return value if places is None else F.round(value, places)


def _shares(v: Column, floor: float) -> Column:
    """Values below zero become `floor`, every one is raised by it, and all add up to 1."""
    raised = F.transform(v, lambda x: F.when(x < 0, F.lit(floor)).otherwise(x.cast("double")) + F.lit(floor))
    return F.transform(raised, lambda x: x / total(raised))


def kl_divergence(p: Column, q: Column, floor: float = 1e-5) -> Column:
    """Natural logarithm, of shares that are never zero."""
    return total(F.zip_with(_shares(p, floor), _shares(q, floor), lambda x, y: x * F.log(x / y)))


def scaled(v: Column, tiny: float = 1e-12) -> Column:
    low, high = F.array_min(v), F.array_max(v)
    return F.transform(v, lambda x: (x - low) / F.greatest(high - low, F.lit(tiny)))


def by_max(v: Column) -> Column:
    return F.transform(v, lambda x: x / F.array_max(v))


def sigma(v: Column) -> Column:
    mean = total(v) / F.size(v)
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / F.size(v))


def without_zeros(v: Column) -> Column:
    return F.filter(v, lambda x: x != 0)


def nonzero_count(v: Column) -> Column:
    return F.size(without_zeros(v))


def argmax(v: Column) -> Column:
    """0-based place of the first maximum; -1 if the values add up to nothing."""
    return F.when(F.abs(total(v)) <= 1e-12, F.lit(-1)).otherwise(F.array_position(v, F.array_max(v)).cast("int") - 1)


def raise_below(v: Column, threshold: float, fill: float = 0.0) -> Column:
    return F.transform(v, lambda x: F.when(x < threshold, F.lit(fill)).otherwise(x))


def drop_below(v: Column, threshold: float) -> Column:
    return F.filter(v, lambda x: x >= threshold)


def drop_sparse_below(m: Column, threshold: float) -> Column:
    """A map from place to value without the values below the threshold."""
    return F.map_filter(m, lambda _, x: x >= threshold)


def sparse_apexes(m: Column, precision: float = 1e4) -> Column:
    """Places of the local maxima of a map from place to value, by place; places without a value are 0.

    As for dense vectors, values are whole numbers of 1 / precision of the maximum, above the left and not below the right
    neighbour.
    """
    top = F.array_max(F.map_values(m))
    level = lambda i: F.round(F.coalesce(F.try_element_at(m, i), F.lit(0.0)) / top * precision)
    return F.filter(F.array_sort(F.map_keys(m)), lambda i: (level(i) > level(i - 1)) & (level(i) >= level(i + 1)))


def with_noise(v: Column, row_id: Column, amount: float, seed: int = 666) -> Column:
    """Values plus noise from -amount to amount, the same for a row and place in every run."""
    return F.transform(v, lambda x, i: x + (F.pmod(F.xxhash64(row_id, i, F.lit(seed)), F.lit(2_000_001)) / 1e6 - 1) * amount)


def replace_nan(v: Column, fill: float = 0.0) -> Column:
    return F.transform(v, lambda x: F.nanvl(x, F.lit(fill)))


def roll(v: Column, by: int) -> Column:
    """Values move `by` places to the right, those at the end come to the front."""
    n = F.size(v)
    k = F.pmod(F.lit(by), n)
    return F.concat(F.slice(v, n - k + 1, k), F.slice(v, F.lit(1), n - k))


def one_hot(index: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def top_places(v: Column, n: int) -> Column:
    """(place, value) of the largest values, at most all but one; ties by place."""
    pairs = F.transform(v, lambda x, i: F.struct((-x).alias("k"), i.alias("place"), x.alias("value")))
    best = F.slice(F.array_sort(pairs), F.lit(1), F.least(F.lit(n), F.size(v) - 1))
    return F.transform(best, lambda p: F.struct(p["place"].alias("place"), p["value"].alias("value")))


def nearest_places(v: Column, value: Column | float, n: int = 1) -> Column:
    pairs = F.transform(v, lambda x, i: F.struct(F.abs(x - value).alias("k"), i.alias("place")))
    return F.transform(F.slice(F.array_sort(pairs), 1, n), lambda p: p["place"])


def linear_score(features: list[Column], weights: list[float]) -> Column:
    out = F.lit(0.0)
    for f, w in zip(features, weights, strict=True):
        out = out + f * F.lit(float(w))
    return out


def zip_points(x: Column, y: Column) -> Column:
    """Parallel arrays as points; unequal lengths are an error."""
    checked = F.when(F.size(x) == F.size(y), F.zip_with(x, y, lambda a, b: F.struct(a.alias("x"), b.alias("y"))))
    return F.coalesce(checked, F.raise_error(F.lit("arrays of unequal length")).cast("array<struct<x:double,y:double>>"))


def unzip(points: Column, field: str) -> Column:
    return F.transform(points, lambda p: p[field])


def map_to_vector(m: Column, size: int) -> Column:
    """Places without a key are 0."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)))


def to_sparse(v: Column) -> Column:
    """A map from 0-based place to value, zeros left out."""
    pairs = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("key"), x.alias("value"))), lambda p: p["value"] != 0)
    return F.map_from_entries(pairs)


def comb(x: Column, teeth: list[float], width: float) -> Column:
    """Whether a place is within `width` of one of the teeth."""
    return F.exists(F.array(*[F.lit(float(t)) for t in teeth]), lambda t: F.abs(t - x) <= width)


def pack_doubles(v: Column) -> Column:
    """Little-endian 64-bit floats, through an Arrow function."""
    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else np.asarray(x, "<f8").tobytes())

    return run(v)


def unpack_floats(blob: Column, double: bool = False, zlib_packed: bool = False) -> Column:
    """Raw or deflated little-endian floats as an array of doubles."""
    kind = "<f8" if double else "<f4"

    @F.pandas_udf("array<double>")
    def run(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(zlib.decompress(b) if zlib_packed and b else b, kind).astype("f8"))

    return run(blob)


def sparse_stats(m: Column, size: int) -> Column:
    """Of a map from place to value, zeros included: max, min, mean and population sigma over `size` places; median over the stored values."""
    values = F.map_values(m)
    absent = F.lit(size) - F.size(values)
    mean = total(values) / size
    spread = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) + absent * mean * mean
    with_zero = F.when(absent > 0, F.concat(values, F.array(F.lit(0.0)))).otherwise(values)
    ordered, n = F.array_sort(values), F.size(values)
    middle = F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2).otherwise(0.0)
    return F.struct(F.array_max(with_zero).alias("max"), F.array_min(with_zero).alias("min"), mean.alias("mean"), F.sqrt(spread / size).alias("sigma"), middle.alias("median"))


def kl_by_sum(p: Column, q: Column, floor: float = 1e-5) -> Column:
    """The row form: shares, raised to `floor`, of p times the sum of all base-2 log ratios."""
    own = lambda v: F.transform(v, lambda x: F.greatest(x / F.when(total(v) < 0, F.lit(floor)).otherwise(total(v)), F.lit(floor)))
    a, b = own(p), own(q)
    logs = total(F.zip_with(a, b, lambda x, y: F.log2(x / y)))
    return total(F.transform(a, lambda x: x * logs))
