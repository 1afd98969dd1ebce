import random

import pytest
from pyspark.sql import functions as F

from ionweave.functions import numeric, vectors
from ionweave.operators import aggregates, filters, joins, sets, windows


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_trace_probe(spark):
    pts = [(s, 100.1 + s / 100, 100.0 + s / 10) for s in range(1, 6)] + [(5, 100.151, 100.9)] + [(s, 200.1 + s / 100, 200.0 + s / 10) for s in range(1, 6)]
    points = spark.createDataFrame(pts, "scan long, mz double, intensity double")
    band = spark.createDataFrame([(100.0, 100.1300001)], "lo double, hi double")
    found = rows(joins.range_join(points, band, "mz", "lo", "hi", 0.05), "scan", "intensity")
    assert found == [(1, 100.1), (2, 100.2), (3, 100.3)]


def test_band_merge(spark):
    points = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0), (3.0, 30.0)], "x double, y double")
    searched = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "c double")
    assert rows(joins.band_join_keep_max(points, searched, "x", "y", "c", 10.0, 0.5), "c", "found_x", "found_y") == [(1.0, 1.0, 10.0), (2.0, 2.0, 20.0), (4.0, -1.0, -1.0)]


def test_running_mean_groups(spark):
    v = [666.666, 666.667, 666.668, 666.686, 666.687, 666.688, 777.0]
    df = spark.createDataFrame([(v,), ([],)], "v array<double>")
    first, second = df.select(aggregates.running_mean_groups(F.col("v"), 10.0).alias("g")).collect()
    assert [(round(g["mean"] * 1000), g["n"]) for g in first["g"]] == [(666667, 3), (666687, 3), (777000, 1)]
    assert second["g"] == []


def test_range_join_plans_an_equi_join(spark):
    left, right = spark.range(1000).select(F.col("id").cast("double").alias("v")), spark.range(50).select((F.col("id") * 20.0).alias("lo"), (F.col("id") * 20.0 + 3).alias("hi"))
    joined = joins.range_join(left, right, "v", "lo", "hi", 4.0)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    want = sorted((float(v), lo, lo + 3) for v in range(1000) for lo in (20.0 * i for i in range(50)) if lo <= v <= lo + 3)
    assert rows(joined, "v", "lo", "hi") == sorted(want, key=repr)


def test_asof_and_nearest(spark):
    left = spark.createDataFrame([(1, 5.0), (1, 0.5), (2, 1.0)], "k long, t double")
    right = spark.createDataFrame([(1, 1.0, "a"), (1, 4.0, "b"), (1, 6.0, "c")], "k long, rt double, v string")
    assert rows(joins.asof_backward(left, right, "t", "rt", ["k"], ["v"]), "k", "t", "asof_v") == [(1, 0.5, None), (1, 5.0, "b"), (2, 1.0, None)]
    assert rows(joins.nearest_join(left, right, "t", "rt", ["k"], ["v"]), "k", "t", "nearest_v") == [(1, 0.5, "a"), (1, 5.0, "c"), (2, 1.0, None)]


def test_sliced_asof_and_nearest_are_the_plain_ones(spark):
    rng = random.Random(8)
    left = spark.createDataFrame([(i, rng.randrange(3), float(rng.randrange(400))) for i in range(150)], "id long, k long, t double")
    right = spark.createDataFrame([(rng.randrange(2), float(rng.randrange(400)), i) for i in range(40)], "k long, rt double, v long")
    for join in (joins.asof_backward, joins.nearest_join):
        assert rows(join(left, right, "t", "rt", ["k"], ["v"])) == rows(join(left, right, "t", "rt", ["k"], ["v"], 7.0))


def test_q_values_against_plain_python(spark):
    rng = random.Random(4)
    for _ in range(3):
        table = [(i, float(rng.randrange(12)), rng.random() < 0.4) for i in range(60)]
        df = spark.createDataFrame(table, "id long, s double, d boolean")
        got = {r["id"]: r["q_value"] for r in windows.q_values(df, "s", "d").collect()}
        decoys = sorted(s for _, s, d in table if d)
        targets = [s for _, s, d in table if not d]
        for i, s, d in table:
            below = [x for x in decoys if x < s]
            nd = sum(x >= s for x in decoys)
            if d:
                want = 1.0
            elif below and below[-1] > decoys[0]:
                want = min(1.0, (nd + 1) / max(1, sum(x >= below[-1] for x in targets)))
            else:
                want = min(1.0, nd / max(1, sum(x >= s for x in targets)))
            assert got[i] == pytest.approx(want)


def test_paired_q_values(spark):
    df = spark.createDataFrame([(1, 10.0, 1.0, False), (2, 9.0, 2.0, False), (3, 8.0, 7.0, True)], "id long, t double, d double, lib boolean")
    got = {r["id"]: r["q_value"] for r in windows.paired_q_values(df, "t", "d", "lib").collect()}
    assert got[3] == 1.0 and got[1] <= 1.0
    inverse = spark.createDataFrame([(1, 0.1, 1.0, False), (2, 0.2, 0.9, False)], "id long, t double, d double, lib boolean")
    assert all(r["q_value"] <= 0.5 for r in windows.paired_q_values(inverse, "t", "d", "lib", inverse=True).collect())


def test_ordered_running_has_no_single_task(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("v"))
    out = windows.ordered_running(df, [F.desc("id")], {"v": F.col("v")}, 6).collect()
    total, want = 0, {}
    for i in range(4999, -1, -1):
        total += i % 7
        want[i] = total
    assert {r["id"]: r["run_v"] for r in out} == want


def test_assertions(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0)], "k long, v double")
    with pytest.raises(filters.CheckFailed):
        filters.expect_unique(df, "k")
    assert filters.expect_unique(df, "v").count() == 2
    with pytest.raises(filters.CheckFailed):
        filters.expect_rows(df.limit(0))
    with pytest.raises(filters.CheckFailed):
        filters.expect_keys(df, "nothing")
    with pytest.raises(Exception, match="out of range"):
        filters.expect_in_range(df, "v", 2.5).collect()
    assert filters.expect_in_range(df, "v", 2.0, 3.0).count() == 2
    with pytest.raises(Exception, match="not finite"):
        filters.checked_features(spark.createDataFrame([(float("nan"), 1.0)], "a double, b double"), ["a", "b"]).collect()
    text = spark.createDataFrame([("1.5",), (None,)], "s string")
    assert [r[0] for r in text.select(filters.as_number(F.col("s"))).collect()] == [1.5, None]
    with pytest.raises(Exception, match="not a number"):
        spark.createDataFrame([("x",)], "s string").select(filters.as_number(F.col("s"))).collect()


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 4.0, 6.0, 8.0, 10.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    r = df.select(
        vectors.cosine(a, b),
        vectors.argmax(b),
        vectors.roll(a, 2),
        vectors.nearest_places(a, 3.2, 2),
        vectors.raise_below(a, 2.5),
        vectors.to_sparse(vectors.raise_below(a, 4.5)),
        vectors.comb(F.lit(3.1), [1.0, 3.0], 0.2),
        vectors.unpack_floats(vectors.pack_doubles(a), double=True),
        F.transform(vectors.top_places(b, 9), lambda p: p["place"]),
    ).first()
    assert tuple(r)[:4] == (1.0, 4, [4.0, 5.0, 1.0, 2.0, 3.0], [2, 3])
    assert r[4] == [0.0, 0.0, 3.0, 4.0, 5.0] and r[5] == {4: 5.0} and r[6] is True and r[7] == [1.0, 2.0, 3.0, 4.0, 5.0]
    assert r[8] == [4, 3, 2, 1]
    with pytest.raises(Exception, match="unequal"):
        df.select(vectors.zip_points(a, F.array(F.lit(1.0)))).collect()
    pairs = spark.createDataFrame([(float(x), y) for x, y in zip(range(1, 6), [2.0, 5.0, 6.0, 7.0, 9.0])], "x double, y double")
    assert pairs.agg(numeric.pearson(F.col("x"), F.col("y"))).first()[0] == pytest.approx(0.977356, abs=1e-5)
    assert pairs.agg(numeric.pearson(F.col("x"), F.lit(1.0))).first()[0] == 0.0


def test_sets_and_samples(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") % 50).cast("double").alias("v"))
    train, test = sets.split_train_test(df, "id")
    assert train.count() + test.count() == 2000 and 300 < test.count() < 500
    assert sets.feature_subsets(list("abcdefghijklmnop"), n=5) == sets.feature_subsets(list("abcdefghijklmnop"), n=5)
    assert sets.shuffled(df, "id").limit(5).collect() == sets.shuffled(df, "id").limit(5).collect()
    assert [r["place"] for r in sets.centre_out(df.limit(40), "id", 4).orderBy("place").collect()] == [0, 1, 2, 3]
    top = filters.top_share(df, "v", 0.1, "id")
    assert top.count() == 200 and top.agg(F.min("v")).first()[0] == 45.0
    assert sets.in_parts(df, 4).select("part").distinct().count() == 4
    assert sets.training_prefix(df.withColumn("q", F.col("v") / 50), [F.asc("q"), F.asc("id")], "q", 100).count() == 1000


def test_curves_are_fitted_to_all_points(spark):
    from types import SimpleNamespace

    from ionweave.operators import learn
    from ionweave.plans import kernel_queries, search

    n = 60_000
    rows = spark.range(n).select(
        F.col("id").alias("l_orderkey"),
        F.lit(1).alias("l_linenumber"),
        F.lit(1).alias("l_partkey"),
        (F.pmod(F.xxhash64("id"), F.lit(100_000)) / 1000.0).alias("l_quantity"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 100.0).alias("_noise"),
    )
    rows = rows.withColumn("l_extendedprice", F.sin(F.col("l_quantity") / 20) * 10 + F.col("_noise"))
    found = kernel_queries.spline_map(SimpleNamespace(lineitem=rows)).toPandas()
    assert len(found) == n
    x, y = found["l_quantity"].to_numpy(), found["l_extendedprice"].to_numpy()
    assert found["predicted"].to_numpy() == pytest.approx(learn.fit_curve(x, y)(x), abs=1e-6)
    few = rows.where("l_orderkey < 7").toPandas()
    x, y = few["l_quantity"].to_numpy(), few["l_extendedprice"].to_numpy()
    assert learn.fit_curve_to(rows.where("l_orderkey < 7"), "l_quantity", "l_extendedprice")(x) == pytest.approx(learn.fit_curve(x, y)(x), abs=1e-6)
    good = rows.select(F.col("l_quantity").alias("irt"), F.col("l_extendedprice").alias("anchor_time"), F.col("l_orderkey").alias("candidate"), F.lit(0.0).alias("q_value"), F.lit(False).alias("is_decoy"))
    curve, sigma = search.calibrate(good)
    assert len(curve.knots) == 20 and sigma == pytest.approx(10 / 12**0.5, rel=0.02)


def test_bins_of_a_relative_width(spark):
    points = spark.createDataFrame([(float(v),) for v in (-1, 0, 0.001, 1, 99, 100, 104, 5000)], "v double")
    bands = spark.createDataFrame([(-2.0, 0.5), (0.0005, 0.002), (95.0, 104.0), (4900.0, 5100.0), (3.0, 2.0)], "lo double, hi double")
    got = sorted(tuple(r) for r in joins.range_join(points, bands, "v", "lo", "hi", 0.04, relative=True, small=True).collect())
    want = sorted((p["v"], *b) for p in points.collect() for b in bands.collect() if b["lo"] <= p["v"] <= b["hi"])
    assert got == want


def test_substrings_by_automaton_and_by_windows(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("abé") for _ in range(rng.choice([0, 3, 40, 2000]))) for _ in range(30)] + [None, "x" * 1200 + "needle", "dup", "dup"]
    words = sorted({t[i : i + n] for t in texts[:30] for i, n in ((2, 2), (5, 8), (9, 30), (1500, 12)) if t[i : i + n]} | {"needle", "absent", "", "dup"})
    needles = spark.createDataFrame([(k, w) for k, w in enumerate([*words, "dup"])], "k long, w string")
    rows_ = spark.createDataFrame(list(enumerate(texts)), "d long, t string")
    want = sorted((k, d) for k, w in enumerate([*words, "dup"]) for d, t in enumerate(texts) if w and t and w in t)
    for most in ((100_000, 4_000_000), (3, 10)):
        found = joins.substring_join(needles, rows_, "w", "t", 8, most)
        assert sorted((r["k"], r["d"]) for r in found.collect()) == want
    assert joins.substring_join(needles.limit(0), rows_, "w", "t").count() == 0


def test_rows_tied_at_the_cut_are_taken_in_order(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 100, 2.0).otherwise(1.0).alias("v"))
    assert sorted(r["id"] for r in filters.top_share(df, "v", 0.25, "id").collect()) == list(range(250))


def test_band_maxima_make_no_pairs_and_equal_centres_share(spark):
    points = spark.range(3000).selectExpr("floor(id / 3) / 10000 + 1.0 AS x", "cast(id % 7 AS double) AS y").unionByName(spark.createDataFrame([(1.02, 50.0), (None, 99.0), (float("nan"), 1.0)], "x double, y double"))
    searched = spark.createDataFrame([(k, 1.0 + k // 2 / 100) for k in range(20)] + [(90, None), (91, 0.0), (92, -1.0)], "k int, c double")
    found = joins.band_join_keep_max(points, searched, "x", "y", "c", 1e4, 0.01)
    assert found._jdf.queryExecution().executedPlan().toString().count("Join") == 1  # only the centres are joined
    held = sorted((r["x"], r["y"]) for r in points.where("x < 9").distinct().collect())
    want, centres = {}, sorted({r["c"] for r in searched.where("c > 0").collect()})
    for x, y in held:
        own = next((c for c in centres if c - c * 1e4 / 1e6 <= x <= c + c * 1e4 / 1e6), None)
        want[own] = max(want.get(own, (-1.0, 1.0)), (y, -x))
    got = {r["k"]: (r["c"], r["found_x"], r["found_y"]) for r in found.collect()}
    assert len(got) == 23 and all(got[k][1:] == (-1.0, -1.0) for k in (90, 91, 92))
    assert all(got[k] == (c := 1.0 + k // 2 / 100, -want[c][1], want[c][0]) if (1.0 + k // 2 / 100) in want else got[k][1:] == (-1.0, -1.0) for k in range(20))


def test_band_maxima_by_key(spark):
    points = spark.createDataFrame([("a", 1.0, 5.0), ("b", 1.0, 7.0), (None, 1.0, 9.0)], "w string, x double, y double")
    searched = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0), (None, 1.0)], "w string, c double")
    found = {r["w"]: (r["found_x"], r["found_y"]) for r in joins.band_join_keep_max(points, searched, "x", "y", "c", 10.0, 0.5, ["w"]).collect()}
    assert found == {"a": (1.0, 5.0), "b": (1.0, 7.0), "c": (-1.0, -1.0), None: (-1.0, -1.0)}


def test_range_sums_make_no_pairs(spark):
    data = [(random.Random(k).choice(["a", "b", None]), random.Random(k).randrange(400) / 100, random.Random(k).choice([None, -5, 2**62, 2**62 + 1, 7])) for k in range(300)]
    data += [("a", None, 1), ("a", float("nan"), 3), ("c", 2.0, None), ("a", 1.0, 2**62), ("a", 1.0, 2**62)]
    bands = [(k / 40, k / 40 + (k % 9) / 10) for k in range(160)] * 2 + [(2.0, 1.0), (50.0, 60.0), (1.0, 1.0), (None, 1.0)]
    points, spans = spark.createDataFrame(data, "w string, x double, i long"), spark.createDataFrame(bands, "lo double, hi double")
    want = {}
    for lo, hi in {b for b in bands if None not in b}:
        for w in ("a", "b", "c", None):
            held = [i for k, x, i in data if k == w and x is not None and lo <= x <= hi]
            if held:
                known = [i for i in held if i is not None]
                want[lo, hi, w] = (len(held), float(sum(known)) if known else None)
    found = joins.range_sums(points, spans, "x", "lo", "hi", "i", "w", 0.25)
    assert {(r["lo"], r["hi"], r["w"]): (r["n"], r["total"]) for r in found.collect()} == want


def test_band_sums_of_copies_grow_with_the_rows(spark, data_dir, tmp_path):
    import __spark_entry__ as entry

    events = spark.read.parquet(f"{data_dir}/events.parquet").where("value between 30 and 30.1")
    part = spark.read.parquet(f"{data_dir}/part.parquet").limit(1).withColumn("p_retailprice", F.lit(900.5))
    for name, df, key in (("events", events, "event_id"), ("part", part, "p_partkey")):
        df.crossJoin(spark.range(4000).withColumnRenamed("id", "_k")).withColumn(key, F.col(key) + 1_000_000 * F.col("_k")).drop("_k").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    n = events.groupBy("event_type").count().count()
    got = entry.queries()["xic_range_join"](spark, str(tmp_path))
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in text[text.index("Join") :]  # what is joined are sums
    rows = got.agg(F.count("*").alias("rows"), F.sum("n").alias("pairs")).first()
    assert n and rows["rows"] == 4000 * n and rows["pairs"] == 4000 * 4000 * events.count()


def test_gap_groups_divide_as_their_sql_does(spark):
    import duckdb

    import __spark_entry__ as entry
    from ionweave.plans.registry import Tables

    values = {1: [0.0, 5.0], 2: [0.0, 0.0, 0.0, 1.0], 3: [-3.0, -2.0, 4.0], 4: [None, 1.0, 1.01, 9.0], 5: [float("nan"), 2.0], 6: [1.0, 1.0, 1.02, 1.03, 1.06], 7: [None], 8: [7.0, 7.0, float("inf")]}
    table = [(1000 * u + k, u, v) for u, of in values.items() for k, v in enumerate(of)]

    class Made(Tables):
        events = spark.createDataFrame(table, "event_id long, user_id long, value double")

    from ionweave.plans import relational

    with duckdb.connect() as duck:
        duck.sql("CREATE TABLE events (event_id BIGINT, user_id BIGINT, value DOUBLE)")
        duck.executemany("INSERT INTO events VALUES (?, ?, ?)", table)
        want = duck.sql(entry.oracle_sql()["gap_groups"]).fetchall()
    order = lambda rows: sorted((tuple(map(str, r)) for r in rows))
    got = relational.gap_groups(Made(spark, "")).select("user_id", "mean", "n").collect()
    assert [r for r in order(got) if r[0] != "2"] == [r for r in order(want) if r[0] != "2"]
    assert order(r for r in got if r["user_id"] == 2) == [("2", "0.0", "1")] * 3 + [("2", "1.0", "1")]  # the SQL leaves the order of equal zeros open
