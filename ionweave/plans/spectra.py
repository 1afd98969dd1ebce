"""Plans that start from spectra: a scan's candidates, calibration rows, process figures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.operators import joins, kernels, windows
from ionweave.operators.aggregates import first_per_key
from ionweave.operators.filters import enough_fragments
from ionweave.sources.tabular import Config


def spectrum_centric(points: DataFrame, ions: DataFrame, ppm: float, time_reach: float, least: int = 3) -> DataFrame:
    """(scan_number, candidate, weight): shares of the candidates in each scan.

    points (scan_number, scan_time, mz, intensity); ions (candidate, predicted_time, mz, intensity). A candidate counts in a scan
    with `least` of its ions within ppm and its time within time_reach; a two-axis binned join finds them, and a scan is then
    explained by non-negative least squares.
    """
    boxes = ions.select(
        "candidate", F.col("mz").alias("ion_mz"), F.col("intensity").alias("ion_intensity"), (F.col("mz") * (1 - ppm / 1e6)).alias("x0"), (F.col("mz") * (1 + ppm / 1e6)).alias("x1"),
        (F.col("predicted_time") - time_reach).alias("y0"), (F.col("predicted_time") + time_reach).alias("y1"),
    )
    hits = joins.range_join_2d(points, boxes, "mz", "scan_time", ("x0", "x1", "y0", "y1"), (0.05, max(2 * time_reach, 1e-3)))
    good = enough_fragments(hits.groupBy("scan_number", "candidate").agg(F.countDistinct("ion_mz").alias("n")), "n", least)
    kept = hits.join(good, ["scan_number", "candidate"], "left_semi")
    spectra = kept.select("scan_number", "candidate").distinct().join(ions.select("candidate", "mz", "intensity"), "candidate")
    seen = points.join(good.select("scan_number").distinct(), "scan_number", "left_semi").select("scan_number", "mz", "intensity")
    return kernels.deconvolution(seen, spectra, "scan_number", ppm)


def find_features(scans: DataFrame, config: Config, level: int = 1) -> DataFrame:
    """Hills of a run's profile scans of one level: target_key and the columns of kernels.hills, scans counted from 0 in their window.

    A scan is smoothed smooth_count times by a Gaussian of filter_length and sigma, its centroids below signal_to_noise_ratio
    times their median height go, and those of following scans, skip_scan_count of which may be missing, are linked
    within the survey width to hills of min_scan_count scans or more. A scan is one row; many come in a batch.
    """
    weights = kernels.gaussian(config.filter_length | 1, config.sigma)
    chosen = scans.where(F.col("ms_level") == level)
    frames = windows.frame_index(chosen.select("target_key", "scan_number"), ["target_key"], ["scan_number"], "frame")
    rows = chosen.select("target_key", "scan_number", "mz", "intensity").join(frames, ["target_key", "scan_number"]).select("target_key", "frame", "mz", "intensity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, centres, heights = [], [], []
            for k in range(batch.num_rows):
                x, y = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (2, 3))
                for _ in range(config.smooth_count):
                    y = kernels.convolved(y, weights)
                found = kernels.centroids(x, y)
                noise = float(np.median([h for _, h in found])) if found else 0.0
                kept = [(c, h) for c, h in found if h >= config.signal_to_noise_ratio * noise or len(found) == 1]
                at += [k] * len(kept)
                centres += [c for c, _ in kept]
                heights += [h for _, h in kept]
            place = pa.array(at, pa.int64())
            columns = [batch.column(0).take(place), batch.column(1).take(place), pa.array(centres, pa.float64()), pa.array(heights, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["target_key", "frame", "mz", "intensity"])

    points = rows.mapInArrow(run, "target_key string, frame long, mz double, intensity double")
    return kernels.hills(points, ["target_key"], "frame", "mz", "intensity", config.ms1_extraction_width_ppm, config.skip_scan_count, config.min_scan_count)


def calibration_rows(report: DataFrame, top: int = 6) -> DataFrame:
    """One row per peptide and charge, the best by discriminant, with its first ions' figures padded with -1."""
    best = first_per_key(report.withColumn("_d", -F.col("discriminant")), ["peptide", "charge"], ["_d", "candidate"])
    found = F.array(*[F.coalesce(F.col(f"found_{k}"), F.lit(-1.0)) for k in range(1, top + 1)])
    return best.select("peptide", "charge", "target_key", "irt", F.col("anchor_time").alias("scan_time"), "precursor_mz", "mz_found_mean", "mz_found_sigma", found.alias("intensities"))


def process_figures() -> dict[str, float]:
    """This process's memory now and at most, in MB, and the machine's cores."""
    import os
    import resource

    with open("/proc/self/statm") as f:
        now = int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6
    return {"rss_mb": now, "peak_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1e3, "cores": float(os.cpu_count() or 1)}
