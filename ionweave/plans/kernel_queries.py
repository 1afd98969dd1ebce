"""Queries of stateful kernels and learners, held against plain versions in the tests, and of whole plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionweave.operators import aggregates, joins, kernels, learn, windows
from ionweave.plans.registry import Tables, query
from ionweave.plans.relational import _Q, hourly, labelled, points, q_sql
from ionweave.storage import staged


@query()
def peak_integration(t):
    return kernels.peak_integration(hourly(t), ["event_type"], "frame", "v", 0.2, 0.05)


@query()
def centroiding(t):
    scans = points(t).withColumn("scan", F.floor(F.col("scan_time") / 86_400).cast("long"))
    return kernels.centroiding(scans, ["target_key", "scan"], "mz", "intensity")


@query()
def hill_trace(t):
    rows = t.events.select("event_type", (F.unix_seconds("ts") / 86400).cast("long").alias("frame"), (F.col("value") + 100).alias("mz"), F.col("user_id").cast("double").alias("intensity"))
    return kernels.hills(rows, ["event_type"], "frame", "mz", "intensity", 300.0, 1, 3)


@query()
def nnls_deconv(t):
    lines = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    ions = lines.groupBy("o_custkey", F.col("l_returnflag").alias("candidate"), F.col("l_linenumber").cast("double").alias("mz")).agg(F.sum("l_quantity").alias("intensity"))
    ions = staged(ions)  # joined once, read for both sides
    peaks = ions.groupBy("o_custkey", "mz").agg(F.sum("intensity").alias("intensity"))
    return kernels.deconvolution(peaks, ions, "o_custkey")


@query()
def demux(t):
    rows = t.events.select(
        (F.unix_seconds("ts") / 86400).cast("long").alias("cycle"), ((F.col("user_id") % 6) * 10.0).alias("start"), F.lit(20.0).alias("width"), (F.col("value") + 100).alias("mz"), F.col("event_id").cast("double").alias("intensity")
    )
    return kernels.demultiplexing(rows, "cycle", 50.0)


@query()
def spline_map(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return learn.apply_curve(rows, learn.fit_curve_to(rows, "l_quantity", "l_extendedprice"), "l_quantity", "predicted")


@query()
def kfold_scores(t):
    names = [f"x{k}" for k in range(8)]
    rows = t.embeddings.select("vec_id", (F.col("label") < 5).alias("decoy"), *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(names)])
    return learn.fold_predictions(rows, names, "decoy", "vec_id", folds=3, epochs=5).select("vec_id", "fold", "classifier")


@query("""
WITH x AS (SELECT doc_id, CAST(doc_id % 3 AS INTEGER) AS fold, quality = 0 AS decoy, (n_chars % 997 + 1) / 1000.0 AS s, (n_chars % 13) / 100.0 AS q FROM labels JOIN documents USING (doc_id)),
l AS (SELECT fold, ln(max(s) FILTER (NOT decoy AND q <= 0.01)) AS c, ln(median(s) FILTER (decoy)) AS m FROM x GROUP BY fold)
SELECT doc_id, round(exp((ln(s) - c) / (m - c)), 5) AS norm FROM x JOIN l USING (fold)""")
def fold_normalisation(t):
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        "doc_id", (F.col("doc_id") % 3).cast("int").alias("fold"), (F.col("quality") == 0).alias("decoy"), ((F.col("n_chars") % 997 + 1) / 1000.0).alias("s"), ((F.col("n_chars") % 13) / 100.0).alias("q")
    )
    return learn.normalised_folds(rows, "s", "decoy", "q", name="norm").select("doc_id", F.round("norm", 5).alias("norm"))


_PAIRS = """(SELECT s_suppkey * 2 AS doc_id, s_suppkey % 20 = 0 AS decoy, s_acctbal AS score FROM supplier
  UNION ALL SELECT s_suppkey * 2 + 1, true, s_acctbal * 0.8::DOUBLE - 200 FROM supplier)"""


@query(f"""
SELECT doc_id // 2 AS s_suppkey, round(CAST(qv AS DOUBLE), 9) AS q_value,
  round((SELECT least(1.0, count(*) FILTER (decoy) / count(*) FILTER (NOT decoy)) FROM {_PAIRS}), 9) AS decoy_ratio FROM ({q_sql(_PAIRS)}) WHERE doc_id % 2 = 0""")
def paired_q_values(t):
    pairs = t.supplier.select("s_suppkey", "s_acctbal", (F.col("s_acctbal") * 0.8 - 200).alias("decoy_score"), (F.col("s_suppkey") % 20 == 0).alias("library_decoy"))
    found = windows.paired_q_values(pairs, "s_acctbal", "decoy_score", "library_decoy")
    return found.select("s_suppkey", F.round("q_value", 9).alias("q_value"), F.round("decoy_ratio", 9).alias("decoy_ratio"))


_BELOW = {p: f"count(*) FILTER (NOT decoy AND qv < {p / 100})" for p in (1, 2, 5, 10, 20, 50)}


@query(f"""
SELECT round(({" + ".join(f"{n} * {(10 - i) / 10}" for i, n in enumerate(_BELOW.values()))}) / 6.0, 6) AS weighted_mean,
  {" || ' | ' || ".join(f"'{p}%: ' || {n}" for p, n in _BELOW.items())} AS summary FROM ({_Q})""")
def weighted_fdr(t):
    counts = staged(aggregates.fdr_counts(windows.q_values(labelled(t), "score", "decoy").where("not decoy"), "q_value"))
    return aggregates.weighted_fdr_mean(counts).select(F.round("weighted_mean", 6).alias("weighted_mean")).crossJoin(aggregates.fdr_text(counts))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_returnflag = 'R' AS d, l_returnflag = 'A' AS t FROM lineitem),
r AS (SELECT *, row_number() OVER w AS n, sum(d::INT) OVER w AS nd, sum(t::INT) OVER w AS nt FROM x WINDOW w AS (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING)),
k AS (SELECT * FROM r WHERE n < coalesce((SELECT min(n) FROM r WHERE nd >= n * 0.6), 1000000000))
SELECT count(*) AS n, CAST(coalesce(max(nd), 0) AS BIGINT) AS decoys, CAST(coalesce(max(nt), 0) AS BIGINT) AS traps FROM k""")
def entrapment_summary(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", (F.col("l_returnflag") == "R").alias("d"), (F.col("l_returnflag") == "A").alias("trap"))
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return aggregates.entrapment_summary(rows, order, "d", "trap", 0.6)


@query()
def averagine_table(t):
    return aggregates.averagine_rows(t._spark)


@query("""
WITH x AS (SELECT l_quantity * 20 + 200 AS searched, (l_quantity * 20 + 200) * (1 + (3 + 0.01::DOUBLE * l_quantity) / 1e6) AS found, l_discount AS sigma,
  row_number() OVER (ORDER BY l_extendedprice DESC, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) AS i FROM lineitem),
e AS (SELECT found, (found - searched) * 1e6 / searched AS ppm, sigma FROM x WHERE i <= (SELECT floor(count(*) * 0.7 + 0.5) FROM lineitem)),
m AS (SELECT avg(ppm) AS a, stddev_pop(ppm) AS d, median(sigma) AS s FROM e),
k AS (SELECT (found - 700) / 500 AS u, ppm AS y FROM e, m WHERE abs(ppm - a) <= 3 * d AND sigma <= s),
s AS (SELECT count(*)::DOUBLE AS n, sum(u) AS u1, sum(u * u) AS u2, sum(u * u * u) AS u3, sum(u * u * u * u) AS u4, sum(y) AS y0, sum(u * y) AS y1, sum(u * u * y) AS y2 FROM k),
d AS (SELECT *, n * (u2 * u4 - u3 * u3) - u1 * (u1 * u4 - u3 * u2) + u2 * (u1 * u3 - u2 * u2) AS det FROM s),
c AS (SELECT (y0 * (u2 * u4 - u3 * u3) - u1 * (y1 * u4 - u3 * y2) + u2 * (y1 * u3 - u2 * y2)) / det AS c0, (n * (y1 * u4 - u3 * y2) - y0 * (u1 * u4 - u3 * u2) + u2 * (u1 * y2 - y1 * u2)) / det AS c1,
  (n * (u2 * y2 - y1 * u3) - u1 * (u1 * y2 - y1 * u2) + y0 * (u1 * u3 - u2 * u2)) / det AS c2 FROM d)
SELECT 0 AS power, round(c0 - c1 * 700 / 500 + c2 * 490000 / 250000, 4) + 0.0 AS coefficient FROM c UNION ALL SELECT 1, round(c1 / 500 - 2 * 700 * c2 / 250000, 6) + 0.0 FROM c UNION ALL SELECT 2, round(c2 / 250000, 8) + 0.0 FROM c""")
def mass_calibration(t):
    quantity = F.col("l_quantity") * 20 + 200
    rows = t.lineitem.select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("row_id"),
        quantity.alias("searched"),
        (quantity * (1 + (3 + 0.01 * F.col("l_quantity")) / 1e6)).alias("found"),
        F.col("l_discount").alias("sigma"),
        F.col("l_extendedprice").alias("intensity"),
    )
    c = learn.fit_mass_calibration(rows, "searched", "found", "sigma", "intensity", "row_id")
    return t._spark.createDataFrame([(k, round(float(v), places) + 0.0) for (k, v), places in zip(enumerate(c), (4, 6, 8), strict=True)], "power int, coefficient double")


@query("""
WITH b AS (SELECT p_partkey, (p_retailprice / 10 - 60) * 0.98::DOUBLE AS low, (p_retailprice / 10 - 60) * 1.02::DOUBLE AS high FROM part),
d AS (SELECT DISTINCT low, high FROM b),
t AS (SELECT low, high, event_type AS target_key, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS frame, sum(user_id)::DOUBLE AS intensity, count(*) AS n FROM events JOIN d ON value >= low AND value <= high GROUP BY ALL),
l AS (SELECT *, CAST(round(intensity / max(intensity) OVER (PARTITION BY low, high, target_key) * 1e4) AS BIGINT) AS k, sum(intensity) OVER (PARTITION BY low, high, target_key) AS s FROM t),
x AS (SELECT *, lag(k) OVER w AS a, lead(k) OVER w AS z FROM l WHERE abs(s) > 1e-12 WINDOW w AS (PARTITION BY low, high, target_key ORDER BY frame)),
p AS (SELECT *, count(*) OVER (PARTITION BY low, high, target_key) AS n_peaks, row_number() OVER (PARTITION BY low, high, target_key ORDER BY intensity DESC, frame) AS i FROM x WHERE (a IS NULL OR k > a) AND (z IS NULL OR k >= z))
SELECT p_partkey, target_key, frame, intensity, n AS n_points, n_peaks FROM b JOIN p USING (low, high) WHERE i = 1""")
def xic_search(t):
    return flagship_rows(t)


def flagship_rows(t: Tables):
    """Searched values of each window with their best frame: range join in bins of a relative width, sums by frame, local maxima, the top one.

    Windows are event types, frames are hours, searched values are part prices brought into the events' range.
    """
    rows = t.events.select("event_id", F.col("event_type").alias("target_key"), F.unix_seconds(F.date_trunc("hour", "ts")).alias("frame"), F.col("value").alias("mz"), F.col("user_id").cast("double").alias("intensity"))
    parts = t.part.select("p_partkey", ((F.col("p_retailprice") / 10 - 60) * 0.98).alias("low"), ((F.col("p_retailprice") / 10 - 60) * 1.02).alias("high"))
    # equal bands, which many candidates share, are extracted once
    found = joins.range_join(rows, parts.select("low", "high").distinct(), "mz", "low", "high", 0.04, relative=True, small=True)
    trace = found.groupBy("low", "high", "target_key", "frame").agg(F.sum("intensity").alias("intensity"), F.count("*").alias("n"))
    peaks = windows.extrema(trace, ["low", "high", "target_key"], "frame", "intensity")
    best = peaks.groupBy("low", "high", "target_key").agg(F.max(F.struct("intensity", (-F.col("frame")).alias("_f"), "n")).alias("b"), F.count("*").alias("n_peaks"))
    return parts.join(best, ["low", "high"]).select("p_partkey", "target_key", (-F.col("b._f")).alias("frame"), F.col("b.intensity").alias("intensity"), F.col("b.n").alias("n_points"), "n_peaks")


@query()
def dia_search(t):
    """The whole search of a run made from the tables: calibration, tolerance, discriminant, evidence, classifier, false-discovery filter, proteins."""
    from ionweave.plans import made_run, search
    from ionweave.sources.tabular import parse_config

    lib = staged(made_run.library(t))
    report = search.search(lib.drop("key"), staged(made_run.run(t, lib)), parse_config("percentFDR = 5.0\nminMs2FragCount = 2\npeakCenter = 5"), made_run.proteins(lib))
    return report.select("origin", "peptide", "charge", "precursor_mz", "is_decoy", "anchor_time", "discriminant", "classifier_norm", "q_value", "ms1_cosine", "full_share", *search.QUANTITIES, "protein_group")


# --- streams ----------------------------------------------------------------------------------------------------


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def stream_tumbling(t):
    from ionweave.streaming import events

    return events.tumbling(t.events)


@query("""
SELECT s AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1""")
def stream_sliding(t):
    from ionweave.streaming import events

    return events.sliding(t.events)


@query("""
WITH c AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM c)
SELECT user_id, min(ts) AS start, count(*) AS n FROM r GROUP BY user_id, k""")
def stream_sessions(t):
    from ionweave.streaming import events

    return events.sessions(t.events)


@query()
def spectrum_centric(t):
    from ionweave.plans.spectra import spectrum_centric as plan

    rows = t.events.select(
        F.unix_seconds(F.date_trunc("day", "ts")).alias("scan_number"), (F.dayofyear("ts") * 1.0).alias("scan_time"), F.round(F.col("value") + 100, 1).alias("mz"), F.col("user_id").cast("double").alias("intensity")
    )
    spots = rows.groupBy("scan_number", "scan_time", "mz").agg(F.sum("intensity").alias("intensity"))
    ions = t.part.select((F.col("p_partkey") % 40).alias("candidate"), (F.col("p_partkey") % 40 * 0.75).alias("predicted_time"), F.round(F.col("p_retailprice") / 10 + 12, 1).alias("mz"), F.col("p_size").cast("double").alias("intensity"))
    return plan(spots, ions.groupBy("candidate", "predicted_time", "mz").agg(F.max("intensity").alias("intensity")), 100.0, 3.0)


@query("""
WITH m AS (SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY 1, 2)
SELECT user_id, round(CASE WHEN count(*) < 8 THEN greatest(max(v), 0) ELSE max(v) END, 4) AS top, round(sum(v) / 8, 6) AS mean, round(sqrt(sum(v * v) / 8 - (sum(v) / 8) ** 2), 6) AS sigma, round(median(v), 6) AS middle FROM m GROUP BY 1""")
def sparse_statistics(t):
    from ionweave.functions.vectors import sparse_stats

    per = t.events.groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    maps = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    s = maps.withColumn("s", sparse_stats(F.col("m"), 8))
    return s.select("user_id", F.round("s.max", 4).alias("top"), F.round("s.mean", 6).alias("mean"), F.round("s.sigma", 6).alias("sigma"), F.round("s.median", 6).alias("middle"))
