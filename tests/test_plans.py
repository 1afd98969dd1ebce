"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ionweave.operators import joins
from ionweave.plans import kernel_queries

NO_PRODUCT = ["xic_range_join", "xic_2d_range_join", "range_anti_join", "box_overlap_join", "band_join_keep_max", "consecutive_links", "substring_groups", "window_shapes", "interference_anti_join", "xic_search", "precursor_window_join"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NO_PRODUCT)
def test_joins_have_keys(spark, data_dir, name):
    text = plan(entry.queries()[name](spark, data_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "HashJoin" in text or "SortMergeJoin" in text


def test_filters_and_columns_reach_the_scan(spark, data_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(entry.queries()["scan_filter_range"](spark, data_dir))
    assert "GreaterThanOrEqual(l_extendedprice,1000.0)" in text and "EqualTo(l_linenumber,1)" in text
    assert "l_comment" not in text and "l_tax" not in text.split("ReadSchema")[1]


@pytest.mark.parametrize("name", ["apexes", "smooth_sg", "trapezoid", "first_diff", "run_length_groups", "prefix_cycles", "ion_series_islands", "runner_up_diff", "frame_index"])
def test_no_window_over_the_whole_table(spark, data_dir, name):
    assert "SinglePartition" not in plan(entry.queries()[name](spark, data_dir))


def test_built_in_functions_only(spark, data_dir):
    python = {"peak_integration", "centroiding", "hill_trace", "nnls_deconv", "demux", "spline_map", "kfold_scores", "spectrum_centric"}
    for name in ["cosine_sim", "kl_div", "bseries", "peptide_mass", "linear_score", "xic_pivot", "asof_backward", "nearest_scan"]:
        assert name not in python and "Python" not in plan(entry.queries()[name](spark, data_dir))


def test_window_rows_of_a_substring_join_hold_no_text(spark, data_dir):
    docs, needles = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{data_dir}/benchmark.parquet")
    found = joins.substring_join(needles.select("item_id", F.col("text").alias("needle")), docs, "needle", "text", 24, (0, 0))
    generates = [line for line in plan(found).splitlines() if "Generate explode" in line]
    carried = [line.rpartition(", [")[0].rpartition(", [")[2] for line in generates]  # the columns beside the exploded one
    assert carried and all(re.fullmatch(r"_text#\d+L\], false", columns) for columns in carried)


def test_flagship_is_one_of_the_queries():
    assert callable(kernel_queries.dia_search)
