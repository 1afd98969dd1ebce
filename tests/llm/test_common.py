import random

from pyspark.sql import functions as F

from ionweave.llm.common import Workspace, connected_components, filter_by_id, text_or_empty, word_count


def test_components_against_union_find(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 6000 + i) for i in range(50)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    got = {r["node"]: r["component"] for r in connected_components(Workspace(spark, "test"), spark.createDataFrame(edges, "a long, b long"), "cc").collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(Workspace(spark, "test"), spark.createDataFrame([], "a long, b long"), "cc").count() == 0


def test_both_ways_to_filter_agree(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    space = Workspace(spark, "test")
    wanted = space.write(docs.where("doc_id % 7 = 0").select("doc_id"), "ids")
    for keep in (True, False):
        found = [sorted(r["doc_id"] for r in filter_by_id(docs, wanted, "doc_id", keep, limit).collect()) for limit in (1000, 3)]
        assert found[0] == found[1] == [i for i in range(100) if (i % 7 == 0) == keep]


def test_words_follow_the_rule_of_bytes(spark):
    texts = ["a b", " a\tb\nc\x0bd\x0ce\rf ", "", None, "no break here", "\x1c\x1d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(word_count(text_or_empty("t"))).collect()] == [len((t or "").encode().split()) for t in texts]


def test_tables_are_dropped(spark):
    space = Workspace(spark, "test")
    space.write(spark.range(5).toDF("a"), "x")
    space.drop("x")
    try:
        assert space.read("x").count() == 0
    except Exception as error:
        assert "PATH_NOT_FOUND" in str(error)
