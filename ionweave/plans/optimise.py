"""Search for the subset of features that finds most at fixed false discovery rates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.operators import learn, windows
from ionweave.operators.sets import feature_subsets
from ionweave.storage import scratch, staged


def subset_score(rows: DataFrame, subset: list[str], weights: list[float], is_decoy: str) -> float:
    """The weighted mean of the numbers of targets below each rate, by a discriminant on these features."""
    from ionweave.operators.aggregates import fdr_counts, weighted_fdr_mean

    with scratch(rows.sparkSession):
        scored = learn.with_score(rows.select(is_decoy, *subset), subset, weights, "_score")
        q = windows.q_values(scored, "_score", is_decoy).where(~F.col(is_decoy))
        return float(weighted_fdr_mean(fdr_counts(q, "q_value")).first()[0])


def optimise(rows: DataFrame, features: list[str], is_decoy: str, n: int = 1000, low: int = 10, high: int = 29, seed: int = 666) -> list[tuple[float, list[str]]]:
    """(score, features) of random subsets, best first.

    The rows are staged once, and the sums of all features taken once: a subset's discriminant is solved from its part of
    them. What a subset stages is removed with it.
    """
    with scratch(rows.sparkSession):
        kept = staged(rows.select(is_decoy, *features))
        a, b = learn.lda_matrices(kept, features, is_decoy)
        tried = []
        for subset in feature_subsets(features, low, high, n, seed):
            at = [features.index(f) for f in subset]
            weights = learn.lda_weights(a[np.ix_(at, at)], b[at])
            tried.append((subset_score(kept, subset, weights, is_decoy), subset))
    return sorted(tried, key=lambda t: -t[0])


def write_results(spark, results: list[tuple[float, list[str]]], path: str) -> None:
    rows = [(score, len(names), ",".join(names)) for score, names in results]
    spark.createDataFrame(rows, "score double, n int, features string").write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
