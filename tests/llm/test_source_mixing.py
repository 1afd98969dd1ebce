from collections import defaultdict

import numpy as np
import pytest
from fixtures import documents, empty, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ionweave.llm import source_mixing
from ionweave.llm.source_mixing import flight, mix_counts


def brute_targets(sizes: dict, share=1.5, most=2.0):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3.0, 1.0, 2.0)[n % 3] for n, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        left = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        now = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        above = [s for s in left if now[s] > most * sizes[s]]
        if not above:
            return fixed | now
        fixed |= {s: most * sizes[s] for s in above}


def test_targets_and_totals(spark, data_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = mix_counts(docs).collect()
    sizes, took, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in found:
        n = len((r["size"],)) and r["size"]
        sizes[r["source"]] += n
        took[r["source"]] += n * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], n)
        assert 0 <= r["copies"] <= 2
    want = brute_targets(sizes)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
    for s in sizes:
        assert abs(took[s] - want[s]) <= largest[s]
    again = {(r["doc_id"], r["copies"]) for r in mix_counts(docs).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in found}
    assert found[0]["size"] == len(docs.where(F.col("doc_id") == found[0]["doc_id"]).first()["text"].encode().split())


def test_reruns_agree_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(source_mixing, "BLOCK", 64)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(50))
    columns = ("doc_id", "text_hash", "source", "size", "target", "copies")
    rows_of = lambda df: sorted((tuple(r) for r in mix_counts(df).select(*columns).collect()), key=repr)
    first = rows_of(docs.repartition(1))
    assert first == rows_of(docs.repartition(7)) == rows_of(docs.orderBy(F.desc("text")))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert rows_of(docs) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_undecided_documents_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(source_mixing, "BLOCK", 16)
    monkeypatch.setattr(source_mixing, "MOST_FLIGHTS", 1)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"), F.lit("a b c").alias("text"))
    with pytest.raises(RuntimeError):
        mix_counts(docs).count()


def test_cases(spark):
    found = mix_counts(documents(spark)).collect()
    assert sorted((r["doc_id"] for r in found), key=repr) == sorted((r[0] for r in rows()), key=repr)
    sizes = defaultdict(int)
    for r in found:
        sizes[r["source"]] += r["size"]
    want = brute_targets(sizes)
    assert set(sizes) == {"b", "a", None, "", "é"}
    assert all(abs(r["target"] - want[r["source"]]) < 1e-6 for r in found)
    assert mix_counts(empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["copies"]) for r in mix_counts(nothing).collect()] == [(0, 0.0, 0)] * 2


def test_many_blocks_and_sources(spark, monkeypatch):
    monkeypatch.setattr(source_mixing, "BLOCK", 64)
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("source"),
        F.repeat(F.lit("w "), (F.xxhash64("id") % 50 + 60).cast("int")).alias("text"),
    )
    found = mix_counts(docs).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("took"), F.max("size").alias("m"), F.first("target").alias("target")).collect()
    for r in found:
        assert abs(r["took"] - r["target"]) <= r["m"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 500)), min_size=1, max_size=60))
def test_flight_keeps_both_totals(pairs):
    chance, size = np.array([p for p, _ in pairs]), np.array([s for _, s in pairs])
    flown = flight(chance, size, False)
    assert ((flown > 0) & (flown < 1)).sum() <= 2
    assert abs(flown.sum() - chance.sum()) < 1e-6 and abs((flown * size).sum() - (chance * size).sum()) < 1e-3
    landed = flight(chance, size, True)
    assert set(landed.tolist()) <= {0.0, 1.0}
    assert abs((landed * size).sum() - (chance * size).sum()) <= size.max() + 1e-6
