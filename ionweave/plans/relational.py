"""Queries of scans, filters, joins, aggregates and windows over the driver's tables.

events stand for scan points (type: window, value: m/z, user: intensity), part for library entries, orders and
lineitem for candidates and their fragments, embeddings for spectra.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.functions import numeric, vectors
from ionweave.operators import aggregates, filters, joins, kernels, sets, windows
from ionweave.plans.registry import Tables, query

SECONDS = "epoch_us(ts) / 1e6"


def points(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.col("event_type").alias("target_key"), (F.unix_micros("ts") / 1e6).alias("scan_time"), F.col("value").alias("mz"), F.col("user_id").cast("double").alias("intensity"))


# --- filters ----------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice BETWEEN 1000 AND 30000 AND l_linenumber = 1""")
def scan_filter_range(t):
    return filters.closed(t.lineitem.where("l_linenumber = 1"), "l_extendedprice", 1000.0, 30000.0).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("""SELECT event_id, value FROM events WHERE value > 10 AND value < 20""")
def scan_filter_open(t):
    return filters.opened(t.events, "value", 10.0, 20.0).select("event_id", "value")


@query("""SELECT p_partkey, p_retailprice FROM part WHERE abs(p_retailprice - 950) < 950 * 20000 * 0.45 / 1e6""")
def tight_ppm_filter(t):
    return filters.within_ppm(t.part, "p_retailprice", F.lit(950.0), 20000.0).select("p_partkey", "p_retailprice")


@query("""SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""")
def scan_unique_by(t):
    return aggregates.first_per_key(t.events.select("event_id", "user_id"), ["user_id"], ["event_id"])


@query("""SELECT event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY event_type""")
def last_per_window(t):
    return aggregates.last_per_key(t.events.select("event_type", "event_id", "value"), ["event_type"], ["event_id"])


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 1.0 AS err, l_extendedprice AS s FROM lineitem),
m AS (SELECT avg(err) AS a, stddev_pop(err) AS d, median(s) AS q FROM x)
SELECT l_orderkey, l_linenumber, l_partkey FROM x, m WHERE abs(err - a) <= 1.5 * d AND s <= q""")
def outlier_filter(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("err"), F.col("l_extendedprice").alias("s"))
    return filters.without_outliers(rows, "err", "s", 1.5).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= floor(0.7 * count(*) OVER () + 0.5)""")
def top70pct(t):
    return filters.top_share(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 0.7, "o_orderkey")


@query("""SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3""")
def min_found_ions(t):
    return filters.enough_fragments(t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n")), "n", 3)


@query("""SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 60)""")
def repeated_keys(t):
    return filters.repeated_only(t.events.select("event_id", "user_id"), "user_id", 60)


@query("""SELECT event_id, CASE WHEN value < 5 THEN 0.0 ELSE value END AS value FROM events""")
def threshold_clamp(t):
    return t.events.select("event_id", vectors.raise_below(F.array("value"), 5.0)[0].alias("value"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE value >= 0""")
def checked_range(t):
    return filters.expect_in_range(t.events, "value", 0.0).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# --- joins ------------------------------------------------------------------------------------------------------

_WINDOWS = "(SELECT n_nationkey, 896.0 + 4 * n_nationkey AS lo, 902.0 + 4 * n_nationkey AS hi FROM nation)"


@query(f"""SELECT p_partkey, n_nationkey FROM part JOIN {_WINDOWS} w ON p_retailprice BETWEEN lo - 0.5 AND hi + 0.5""")
def precursor_window_join(t):
    w = t.nation.select("n_nationkey", (896.0 + 4 * F.col("n_nationkey")).alias("lo"), (902.0 + 4 * F.col("n_nationkey")).alias("hi"))
    return joins.window_join(t.part, w, "p_retailprice", "lo", "hi", 6.0, 0.5).select("p_partkey", "n_nationkey")


_BANDS = "(SELECT p_partkey, p_retailprice / 10 - 60 AS c, 0.05 AS tol FROM part)"


def _bands(t):
    c = F.col("p_retailprice") / 10 - 60
    return t.part.select("p_partkey", (c - 0.05).alias("lo"), (c + 0.05).alias("hi"))


@query(f"""SELECT p_partkey, event_type AS target_key, count(*) AS n, sum(user_id)::DOUBLE AS total FROM events JOIN {_BANDS} b ON value >= c - tol AND value <= c + tol GROUP BY ALL""")
def xic_range_join(t):
    rows = t.events.select(F.col("event_type").alias("target_key"), F.col("value").alias("mz"), "user_id")
    # equal bands, which many parts share, are summed once
    found = joins.range_sums(rows, _bands(t), "mz", "lo", "hi", "user_id", "target_key", 0.5)
    return _bands(t).join(found, ["lo", "hi"]).groupBy("p_partkey", "target_key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query(f"""SELECT p_partkey FROM {_BANDS} b WHERE NOT EXISTS (SELECT 1 FROM events WHERE value >= c - tol AND value <= c + tol)""")
def range_anti_join(t):
    spans = _bands(t).withColumn("centre", (F.col("lo") + F.col("hi")) / 2)
    hit = joins.range_join(t.events.select("value"), spans, "value", "lo", "hi", 0.5).select("p_partkey").distinct()
    return spans.select("p_partkey").join(hit, "p_partkey", "left_anti")


@query("""
SELECT s_suppkey, count(*) AS n FROM events, (SELECT s_suppkey, s_acctbal / 100 AS c, CAST(s_suppkey AS DOUBLE) AS u FROM supplier)
WHERE value BETWEEN c - 1 AND c + 1 AND user_id BETWEEN u - 5 AND u + 5 GROUP BY s_suppkey""")
def xic_2d_range_join(t):
    c, u = F.col("s_acctbal") / 100, F.col("s_suppkey").cast("double")
    boxes = t.supplier.select("s_suppkey", (c - 1).alias("x0"), (c + 1).alias("x1"), (u - 5).alias("y0"), (u + 5).alias("y1"))
    return joins.range_join_2d(points(t), boxes, "mz", "intensity", ("x0", "x1", "y0", "y1"), (2.0, 10.0)).groupBy("s_suppkey").agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey, c_custkey FROM supplier, customer WHERE s_acctbal <= c_acctbal + 3 AND s_acctbal + 5 >= c_acctbal""")
def box_overlap_join(t):
    a = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("a0"), (F.col("s_acctbal") + 5).alias("a1"))
    b = t.customer.select("c_custkey", F.col("c_acctbal").alias("b0"), (F.col("c_acctbal") + 3).alias("b1"))
    return joins.box_overlap_join(a, b, ("a0", "a1"), ("b0", "b1"), 8.0).select("s_suppkey", "c_custkey")


@query("""
WITH s AS (SELECT p_partkey, p_retailprice / 10 - 60 + p_partkey / 1e6 AS c FROM part),
hit AS (SELECT e.event_id, e.value, e.user_id, min(s.c) AS c FROM events e JOIN s ON e.value >= c - c * 1000 / 1e6 AND e.value <= c + c * 1000 / 1e6 GROUP BY ALL),
best AS (SELECT c, arg_max(value, (user_id, -value)) AS found_x, CAST(max(user_id) AS DOUBLE) AS found_y FROM hit GROUP BY c)
SELECT s.p_partkey, coalesce(found_x, -1.0) AS found_x, coalesce(found_y, -1.0) AS found_y FROM s LEFT JOIN best ON s.c = best.c""")
def band_join_keep_max(t):
    searched = t.part.select("p_partkey", (F.col("p_retailprice") / 10 - 60 + F.col("p_partkey") / 1e6).alias("c"))
    return joins.band_join_keep_max(points(t), searched, "mz", "intensity", "c", 1000.0, 0.1).select("p_partkey", "found_x", "found_y")


@query("""
SELECT a.event_id, b.event_id AS asof_event_id, b.value AS asof_value FROM (SELECT * FROM events WHERE event_type = 'purchase') a
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def asof_backward(t):
    e = t.events.withColumn("us", F.unix_micros("ts"))
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "us")
    right = e.where("event_type = 'view'").select("event_id", "user_id", F.col("us").alias("rus"), "value")
    return joins.asof_backward(left, right, "us", "rus", ["user_id"], ["event_id", "value"], 86_400e6).select("event_id", "asof_event_id", "asof_value")


@query("""
SELECT a.event_id, arg_min(b.event_id, (abs(epoch_us(a.ts) - epoch_us(b.ts)), -epoch_us(b.ts))) AS nearest_event_id
FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'click' GROUP BY a.event_id""")
def nearest_scan(t):
    e = t.events.withColumn("us", F.unix_micros("ts"))
    left = e.where("event_type = 'error'").select("event_id", "user_id", "us")
    right = e.where("event_type = 'click'").select("event_id", "user_id", F.col("us").alias("rus"))
    found = joins.nearest_join(left, right, "us", "rus", ["user_id"], ["event_id"], 86_400e6)
    return found.where("nearest_event_id is not null").select("event_id", "nearest_event_id")


@query("""SELECT item_id, string_agg(CAST(doc_id AS VARCHAR), ';' ORDER BY doc_id) AS docs FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id""")
def substring_groups(t):
    needles = t.benchmark.select("item_id", F.col("text").alias("needle"))
    found = joins.substring_join(needles, t.documents.select("doc_id", "text"), "needle", "text", 24)
    return found.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ";").alias("docs"))


@query("""
SELECT a.o_orderkey, arg_max(b.o_orderkey, (b.o_totalprice, b.o_orderkey)) AS alt_o_orderkey, max(b.o_totalprice) AS alt_o_totalprice
FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey GROUP BY a.o_orderkey""")
def alt_evidence_self_join(t):
    found = joins.alternative_evidence(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey", ["o_orderkey", "o_totalprice"])
    return found.select("o_orderkey", "alt_o_orderkey", "alt_o_totalprice")


@query("""SELECT min(p_partkey) AS p_partkey, replace(p_name, 'i', 'l') AS s FROM part GROUP BY 2""")
def isomer_dedup(t):
    named = t.part.select("p_partkey", F.upper("p_name").alias("p"))
    one = aggregates.dedup_isomers(named, "p", ["p_partkey"])
    return one.select("p_partkey", F.replace(F.lower("p"), F.lit("i"), F.lit("l")).alias("s"))


@query("""SELECT p_partkey, replace(p_name, 'I', 'L') IN (SELECT replace(p_name, 'I', 'L') FROM part WHERE p_size > 45) AS also_target FROM part WHERE p_size <= 45""")
def decoy_semi_join(t):
    both = t.part.select("p_partkey", "p_name", "p_size")
    return joins.in_targets(both.where("p_size <= 45"), both.where("p_size > 45"), "p_name").select("p_partkey", "also_target")


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS s FROM lineitem GROUP BY ALL),
p AS (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey % 6 AS b FROM lineitem),
x AS (SELECT p.*, s FROM p JOIN c USING (l_orderkey, l_linenumber)),
lost AS (SELECT DISTINCT a.l_orderkey, a.l_linenumber FROM x a JOIN x o ON a.l_orderkey = o.l_orderkey AND a.b = o.b AND (o.s > a.s OR (o.s = a.s AND o.l_linenumber < a.l_linenumber)))
SELECT l_orderkey, l_linenumber FROM c ANTI JOIN lost USING (l_orderkey, l_linenumber)""")
def interference_anti_join(t):
    cands = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("s"))
    peaks = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 6).alias("b"))
    return joins.without_interference(cands, peaks, "l_orderkey", "l_linenumber", "s", "b", 1).select("l_orderkey", "l_linenumber")


@query("""
WITH f AS (SELECT event_id, user_id % 20 AS frame, value + 100 AS mz FROM events)
SELECT a.event_id, arg_min(b.event_id, (abs(b.mz - a.mz), b.mz, b.event_id)) AS next_event FROM f a JOIN f b ON b.frame = a.frame + 1 AND abs(b.mz - a.mz) < a.mz * 200 / 1e6 GROUP BY a.event_id""")
def consecutive_links(t):
    frames = t.events.select("event_id", (F.col("user_id") % 20).alias("frame"), (F.col("value") + 100).alias("mz"))
    return joins.consecutive_links(frames, "frame", "mz", "event_id", 200.0).select("event_id", F.col("next_point").alias("next_event"))


@query("""SELECT s_suppkey, ppm, round(s_acctbal * ppm / 1e6, 6) AS tol FROM supplier, (SELECT unnest([5.0, 10.0, 20.0]::DOUBLE[]) AS ppm)""")
def parameter_grid(t):
    grid = joins.parameter_grid(t.supplier, "ppm", [5.0, 10.0, 20.0])
    return grid.select("s_suppkey", "ppm", F.round(numeric.ppm_width(F.col("s_acctbal"), F.col("ppm")), 6).alias("tol"))


@query("""
SELECT e.event_id, CASE WHEN min(abs(e.value - t.mz)) <= 0.2301 THEN arg_min(t.label, (abs(e.value - t.mz), t.label)) END AS label
FROM events e JOIN (SELECT DISTINCT n_regionkey, n_name AS label, n_nationkey * 1.7 AS mz FROM nation) t ON t.n_regionkey = e.user_id % 5 GROUP BY e.event_id""")
def label_by_nearest(t):
    theory = t.nation.select(F.col("n_regionkey").cast("long").alias("k"), F.col("n_name").alias("label"), (F.col("n_nationkey") * 1.7).alias("theo_mz"))
    rows = t.events.select("event_id", (F.col("user_id") % 5).alias("k"), F.col("value").alias("mz"))
    return joins.label_by_nearest(rows, theory, "k", "mz", 0.2301).select("event_id", "label")


# --- aggregates -------------------------------------------------------------------------------------------------


@query("""
WITH c AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)
SELECT min(n) > 2 AND max(n) - avg(n) <= 2 AND avg(n) - min(n) <= 2 AS even, count(*) AS keys, avg(n) AS mean FROM c""")
def dia_cycle_check(t):
    return aggregates.cycles_evenly(t.lineitem, "l_returnflag")


@query("""SELECT l_linenumber, count(*) AS n, min(l_shipdate) AS first_time, max(l_shipdate) AS last_time, min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1""")
def run_summary(t):
    return aggregates.run_summary(t.lineitem, "l_linenumber", "l_shipdate", "l_extendedprice").withColumn("mean", F.round("mean", 4))


@query("""SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sigma, median(value) AS middle FROM events GROUP BY 1""")
def stats_basic(t):
    v = F.col("value")
    return t.events.groupBy("event_type").agg(F.round(numeric.mean_or_zero(v), 6).alias("mean"), F.round(numeric.sigma(v), 6).alias("sigma"), numeric.exact_median(v).alias("middle"))


@query("""SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS weighted, round(sum(l_extendedprice / l_quantity) / sum(1 / l_quantity), 4) AS inverse FROM lineitem GROUP BY 1""")
def weighted_mean(t):
    x, w = F.col("l_extendedprice"), F.col("l_quantity")
    return t.lineitem.groupBy("l_returnflag").agg(F.round(numeric.weighted_mean(x, w), 4).alias("weighted"), F.round(numeric.weighted_mean(x, w, True), 4).alias("inverse"))


@query("""SELECT l_returnflag, round(sqrt(avg((l_extendedprice - 2000 * l_quantity) ** 2)), 4) AS rmse, round(greatest(corr(l_quantity, l_extendedprice), 1e-6), 6) AS pearson FROM lineitem GROUP BY 1""")
def rmse_pearson(t):
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    return t.lineitem.groupBy("l_returnflag").agg(F.round(numeric.rmse(y, 2000 * x), 4).alias("rmse"), F.round(numeric.pearson(x, y), 6).alias("pearson"))


@query("""
SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
  round(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ** 2 / regr_sxx(l_extendedprice, l_quantity)) / (regr_count(l_extendedprice, l_quantity) - 2) / regr_sxx(l_extendedprice, l_quantity)), 6) AS std_error
FROM lineitem GROUP BY 1""")
def linreg(t):
    out = t.lineitem.groupBy("l_returnflag").agg(*numeric.regression(F.col("l_quantity"), F.col("l_extendedprice")))
    return out.select("l_returnflag", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("std_error", 6).alias("std_error"))


@query("""
WITH s AS (SELECT l_linenumber AS g, count(*) * 1.0 AS s0, sum(x) AS s1, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4, sum(y) AS t0, sum(x*y) AS t1, sum(x*x*y) AS t2
  FROM (SELECT l_linenumber, l_quantity / 10 AS x, l_extendedprice / 1000 AS y FROM lineitem) GROUP BY 1),
d AS (SELECT *, s0*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2) AS det FROM s)
SELECT g, round((t0*(s2*s4-s3*s3) - s1*(t1*s4-t2*s3) + s2*(t1*s3-t2*s2)) / det, 4) AS c0, round((s0*(t1*s4-t2*s3) - t0*(s1*s4-s2*s3) + s2*(s1*t2-s2*t1)) / det, 4) AS c1,
  round((s0*(s2*t2-s3*t1) - s1*(s1*t2-s2*t1) + t0*(s1*s3-s2*s2)) / det, 4) AS c2 FROM d""")
def poly2_fit(t):
    x, y = F.col("l_quantity") / 10, F.col("l_extendedprice") / 1000
    s = t.lineitem.groupBy(F.col("l_linenumber").alias("g")).agg(*numeric.power_sums(x, y))
    s0, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    c0 = (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / det
    c1 = (s0 * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / det
    c2 = (s0 * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)) / det
    return s.select("g", F.round(c0, 4).alias("c0"), F.round(c1, 4).alias("c1"), F.round(c2, 4).alias("c2"))


@query("""SELECT CAST(floor(value * 100 + 0.5) AS BIGINT) AS key, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1""")
def target_key_hash(t):
    return aggregates.mean_by_decimal(t.events, "value", 2).withColumn("mean", F.round("mean", 6))


_TRACES = ", ".join(f"sum(CASE WHEN event_type = '{e}' THEN user_id ELSE 0 END)::DOUBLE AS ion_{e}" for e in ("click", "error", "purchase", "signup", "view"))
_KINDS = ["click", "error", "purchase", "signup", "view"]


@query(f"""SELECT date_trunc('hour', ts) AS frame, {_TRACES} FROM events GROUP BY 1""")
def xic_pivot(t):
    rows = t.events.withColumn("frame", F.date_trunc("hour", "ts")).withColumn("i", F.col("user_id").cast("double"))
    return aggregates.trace_pivot(rows, ["frame"], "event_type", _KINDS, "i")


@query(f"""
WITH x AS (SELECT date_trunc('hour', ts) AS frame, {_TRACES} FROM events GROUP BY 1),
c AS (SELECT frame, {" + ".join(f"(CASE WHEN ion_{e} > 100 THEN 1 ELSE 0 END)" for e in ("click", "error", "purchase", "signup", "view"))} AS n FROM x)
SELECT frame, CAST(CASE WHEN n >= 2 THEN n ELSE 0 END AS INTEGER) AS n FROM c""")
def ion_count(t):
    rows = t.events.withColumn("frame", F.date_trunc("hour", "ts")).withColumn("i", F.col("user_id").cast("double"))
    pivot = aggregates.trace_pivot(rows, ["frame"], "event_type", _KINDS, "i")
    return pivot.select("frame", aggregates.ion_count([f"ion_{e}" for e in _KINDS], 100, 2).alias("n"))


@query("""SELECT event_type, round(sum(value * user_id) / sum(user_id), 6) AS centroid FROM events GROUP BY 1""")
def weighted_centroid(t):
    return points(t).groupBy(F.col("target_key").alias("event_type")).agg(F.round(aggregates.centroid("mz", "intensity"), 6).alias("centroid"))


@query("""
WITH o AS (SELECT user_id, value, CASE WHEN (value - lag(value) OVER w) * 1e6 / lag(value) OVER w > 20000 THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id)),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY value ROWS UNBOUNDED PRECEDING) AS grp FROM o)
SELECT user_id, round(avg(value), 6) AS mean, count(*) AS n FROM g GROUP BY user_id, grp""")
def gap_groups(t):
    grouped = aggregates.gap_groups(t.events.select("user_id", "value"), ["user_id"], "value", 20000.0)
    return grouped.groupBy("user_id", "grp").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n")).drop("grp")


@query("""
WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS i FROM events),
r AS (SELECT user_id, i, value AS mean, 1 AS n, 1 AS g FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.i, CASE WHEN abs(o.value - r.mean) * 1e6 <= 20000 * r.mean THEN (r.mean * r.n + o.value) / (r.n + 1) ELSE o.value END,
    CASE WHEN abs(o.value - r.mean) * 1e6 <= 20000 * r.mean THEN r.n + 1 ELSE 1 END, CASE WHEN abs(o.value - r.mean) * 1e6 <= 20000 * r.mean THEN r.g ELSE r.g + 1 END
  FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT user_id, round(arg_max(mean, i), 6) AS mean, max(n) AS n FROM r GROUP BY user_id, g""")
def running_mean_groups(t):
    lists = t.events.groupBy("user_id").agg(F.collect_list("value").alias("v"))
    return lists.select("user_id", F.explode(aggregates.running_mean_groups(F.col("v"), 20000.0)).alias("g")).select("user_id", F.round("g.mean", 6).alias("mean"), "g.n")


# --- ordered rows -----------------------------------------------------------------------------------------------


@query("""SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS frame_index FROM events""")
def frame_index(t):
    return windows.frame_index(t.events, ["event_type"], ["ts", "event_id"]).select("event_id", "event_type", "frame_index")


@query("""SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS frame_index FROM events""")
def frame_index_spread(t):
    return windows.spread_frame_index(t.events, ["event_type"], ["ts", "event_id"]).select("event_id", "event_type", "frame_index")


_LABELS = "(SELECT doc_id, quality = 0 AS decoy, n_chars % 997 AS score FROM labels JOIN documents USING (doc_id))"


def labelled(t):
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select("doc_id", (F.col("quality") == 0).alias("decoy"), (F.col("n_chars") % 997).alias("score"))


def q_sql(rows: str) -> str:
    """q-values of a subquery (doc_id, decoy, score)."""
    return f"""
WITH x AS (SELECT doc_id, decoy, score FROM {rows}),
c AS (SELECT score, count(*) FILTER (decoy) AS d, count(*) FILTER (NOT decoy) AS t FROM x GROUP BY score),
r AS (SELECT score, d, t, sum(d) OVER w AS nd, sum(t) OVER w AS nt FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
p AS (SELECT a.score, a.nd, a.nt, (SELECT max(b.score) FROM r b WHERE b.d > 0 AND b.score < a.score) AS ps FROM r a WHERE a.t > 0),
q AS (SELECT p.score, CASE WHEN ps IS NOT NULL AND ps > (SELECT min(score) FROM r WHERE d > 0) THEN least(1.0, (p.nd + 1.0) / greatest(1, (SELECT nt FROM r WHERE r.score = ps))) ELSE least(1.0, p.nd * 1.0 / greatest(1, p.nt)) END AS qv FROM p)
SELECT x.doc_id, x.decoy, CASE WHEN x.decoy THEN 1.0 ELSE q.qv END AS qv FROM x LEFT JOIN q USING (score)"""


_Q = q_sql(_LABELS)


@query(f"""SELECT doc_id, round(CAST(qv AS DOUBLE), 9) AS q_value FROM ({_Q})""")
def q_value(t):
    return windows.q_values(labelled(t), "score", "decoy").select("doc_id", F.round("q_value", 9).alias("q_value"))


@query(f"""SELECT {", ".join(f"count(*) FILTER (NOT decoy AND qv < {p / 100}) AS below_{p}" for p in (50, 20, 10, 5, 2, 1))} FROM ({_Q})""")
def fdr_counts(t):
    return aggregates.fdr_counts(windows.q_values(labelled(t), "score", "decoy").where("not decoy"), "q_value")


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_returnflag = 'R' AS decoy FROM lineitem),
r AS (SELECT *, row_number() OVER w AS n, sum(CASE WHEN decoy THEN 1 ELSE 0 END) OVER w AS d FROM x WINDOW w AS (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING))
SELECT l_orderkey, l_linenumber, l_partkey FROM r WHERE n < coalesce((SELECT min(n) FROM r WHERE d >= n * 0.5), 1000000000)""")
def decoy_prefix(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", (F.col("l_returnflag") == "R").alias("decoy"))
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return windows.running_prefix(rows, order, F.col("decoy")).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""
WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS n FROM orders)
SELECT o_orderkey FROM r WHERE n <= coalesce((SELECT min(n) FROM r WHERE o_totalprice >= 250000), 1000000000)""")
def serial_prefix(t):
    return windows.cut_at_first(t.orders, [F.asc("o_totalprice"), F.asc("o_orderkey")], F.col("o_totalprice") >= 250000).select("o_orderkey")


@query("""
WITH x AS (SELECT l_orderkey, l_extendedprice AS s, row_number() OVER w AS r, first_value(l_extendedprice) OVER w AS top FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey))
SELECT l_orderkey, max(top) AS best, round(max(CASE WHEN r = 2 THEN top - s END), 6) AS lead_2, round(max(CASE WHEN r = 3 THEN top - s END), 6) AS lead_3, count(*) AS n,
  round(coalesce(avg(CASE WHEN r > 1 THEN top - s END), 0), 6) AS lead_mean FROM x GROUP BY 1""")
def runner_up_diff(t):
    rows = t.lineitem.withColumn("tie", F.struct("l_linenumber", "l_partkey"))
    out = windows.runner_up(rows, ["l_orderkey"], "l_extendedprice", "tie")
    return out.select("l_orderkey", "best", *[F.round(c, 6).alias(c) for c in ("lead_2", "lead_3")], "n", F.round("lead_mean", 6).alias("lead_mean"))


@query("""
WITH d AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), g AS (SELECT *, l_suppkey - row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS k FROM d)
SELECT l_partkey, min(l_suppkey) AS first, count(*) AS length FROM g GROUP BY l_partkey, k HAVING count(*) >= 2""")
def ion_series_islands(t):
    return windows.islands(t.lineitem, ["l_partkey"], "l_suppkey")


@query("""
WITH c AS (SELECT event_id, user_id, event_type, ts, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS n FROM r GROUP BY 1, 2""")
def run_length_groups(t):
    rows = windows.run_ids(t.events, ["user_id"], ["ts", "event_id"], "event_type")
    return rows.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n")).withColumn("run", F.col("run").cast("long"))


@query("""
SELECT event_id, CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cycle FROM events""")
def prefix_cycles(t):
    rows = windows.cycle_ids(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase")
    return rows.select("event_id", F.col("cycle").cast("long").alias("cycle"))


_DAYS = "(SELECT event_type, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS frame, sum(value) AS v FROM events GROUP BY 1, 2)"


def hourly(t):
    return t.events.groupBy("event_type", F.unix_seconds(F.date_trunc("hour", "ts")).alias("frame")).agg(F.sum("value").alias("v"))


def _extrema_sql(sign: str) -> str:
    return f"""
WITH h AS (SELECT *, max(v) OVER (PARTITION BY event_type) AS m FROM (SELECT event_type, frame, round(v, 2) AS v FROM {_DAYS})),
l AS (SELECT event_type, frame, v, {sign} CAST(round(v / m * 1e4) AS BIGINT) AS k FROM h),
n AS (SELECT *, lag(k) OVER w AS a, lead(k) OVER w AS b FROM l WINDOW w AS (PARTITION BY event_type ORDER BY frame))
SELECT event_type, frame FROM n WHERE (a IS NULL OR k > a) AND (b IS NULL OR k >= b)"""


@query(_extrema_sql("+"))
def apexes(t):
    return windows.extrema(hourly(t).withColumn("v", F.round("v", 2)), ["event_type"], "frame", "v").select("event_type", "frame")


@query(_extrema_sql("-"))
def troughs(t):
    return windows.extrema(hourly(t).withColumn("v", F.round("v", 2)), ["event_type"], "frame", "v", troughs=True).select("event_type", "frame")


_SG = kernels.savitzky_golay(5, 2).tolist()
_SMOOTH = " + ".join(f"{w!r} * coalesce({'lag' if k < 2 else 'lead'}(v, {abs(k - 2)}) OVER w, {'h' if k < 2 else 'e'})" if k != 2 else f"{w!r} * v" for k, w in enumerate(_SG))


@query(f"""
WITH i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY frame) AS i, row_number() OVER (PARTITION BY event_type ORDER BY frame DESC) AS j FROM {_DAYS}),
p AS (SELECT *, avg(v) FILTER (i <= 3) OVER (PARTITION BY event_type) AS h, avg(v) FILTER (j <= 3) OVER (PARTITION BY event_type) AS e, count(*) OVER (PARTITION BY event_type) AS n FROM i)
SELECT event_type, frame, round(CASE WHEN n <= 5 THEN v ELSE {_SMOOTH} END, 4) AS smoothed FROM p WINDOW w AS (PARTITION BY event_type ORDER BY frame)""")
def smooth_sg(t):
    return windows.smoothed(hourly(t), ["event_type"], "frame", "v", _SG).select("event_type", "frame", F.round("smoothed", 4).alias("smoothed"))


@query(f"""
WITH s AS (SELECT event_type, (frame - lag(frame) OVER w) * (v + lag(v) OVER w) / 2 AS a FROM {_DAYS} WINDOW w AS (PARTITION BY event_type ORDER BY frame))
SELECT event_type, round(coalesce(sum(a), 0), 2) AS area FROM s GROUP BY 1""")
def trapezoid(t):
    return windows.trapezoid(hourly(t), ["event_type"], "frame", "v").withColumn("area", F.round("area", 2))


@query(f"""SELECT event_type, frame, round(lead(v) OVER (PARTITION BY event_type ORDER BY frame) - v, 4) AS difference FROM {_DAYS}""")
def first_diff(t):
    out = windows.first_difference(hourly(t), ["event_type"], "frame", "v")
    return out.select("event_type", "frame", F.round("difference", 4).alias("difference"))


@query("""
WITH g AS (SELECT lead(x) OVER (ORDER BY x) - x AS d FROM (SELECT DISTINCT n_nationkey * 25.0 AS x FROM nation))
SELECT max(d) - min(d) <= 0.01 AS even, avg(d) AS width FROM g WHERE d IS NOT NULL""")
def window_spacing(t):
    return windows.evenly_spaced(t.nation.select((F.col("n_nationkey") * 25.0).alias("x")), "x")


@query("""
SELECT event_id, CAST(count(*) OVER w AS BIGINT) AS n, max(event_id) OVER w AS last_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)""")
def scan_groups(t):
    rows = windows.grouped_scans(t.events, ["user_id"], "event_id", "event_id", 2)
    return rows.select("event_id", F.size("grp").cast("long").alias("n"), F.array_max("grp").alias("last_id"))


@query("""
WITH m AS (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_extendedprice) AS e0, max(l_extendedprice) AS e1 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - q0) / greatest(q1 - q0, 1e-12), 9) AS l_quantity, round((l_extendedprice - e0) / greatest(e1 - e0, 1e-12), 9) AS l_extendedprice FROM lineitem, m""")
def minmax_scale(t):
    rows = windows.scaled_columns(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])
    return rows.withColumn("l_quantity", F.round("l_quantity", 9)).withColumn("l_extendedprice", F.round("l_extendedprice", 9))


@query("""
WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value FROM events)
SELECT u AS user_id, count(*) AS n, round(sum(value), 4) AS total FROM f JOIN (SELECT DISTINCT user_id AS u FROM events) ON u = user_id WHERE i >= 10 - 1.5 * 8 AND i < 10 + 1.5 * 8 GROUP BY 1""")
def window_shapes(t):
    frames = windows.frame_index(t.events, ["user_id"], ["ts", "event_id"], "i").select("user_id", "i", "value")
    peaks = t.events.select("user_id").distinct().select("user_id", F.lit(10.0).alias("start"), F.lit(8.0).alias("len"))
    found = windows.windows_around(peaks, ["user_id"], "i", "start", "len", 1.5, frames)
    return found.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# --- sets and sorts ---------------------------------------------------------------------------------------------


@query("""SELECT s_suppkey, s_acctbal AS score, false AS is_decoy FROM supplier UNION ALL SELECT s_suppkey, s_acctbal / 2, true FROM supplier""")
def union_targets_decoys(t):
    pairs = t.supplier.withColumn("half", F.col("s_acctbal") / 2)
    return sets.targets_and_decoys(pairs, ["s_suppkey"], {"score": "s_acctbal"}, {"score": "half"})


@query("""SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def set_diff(t):
    return sets.difference(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""SELECT p_partkey FROM part WHERE p_size < 10 UNION SELECT l_partkey FROM lineitem WHERE l_quantity > 45""")
def insert_if_absent(t):
    base = t.part.where("p_size < 10").select("p_partkey")
    return sets.insert_absent(base, t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


@query("""SELECT l_orderkey, list(l_partkey ORDER BY l_extendedprice DESC, l_partkey)[1:3] AS top FROM lineitem GROUP BY 1""")
def topn_ions(t):
    ions = F.collect_list(F.struct("l_partkey", F.col("l_extendedprice").alias("intensity"))).alias("ions")
    return t.lineitem.groupBy("l_orderkey").agg(ions).select("l_orderkey", sets.top_ions(F.col("ions"), 3)["l_partkey"].alias("top"))


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1""")
def best_peak(t):
    return sets.best_per_group(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey, o_totalprice FROM orders QUALIFY o_totalprice >= max(o_totalprice) OVER (PARTITION BY o_custkey) - 50000""")
def within_of_best(t):
    return sets.within_of_best(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], "o_totalprice", 50000.0).select("o_orderkey", "o_totalprice")


@query("""
WITH i AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 - (SELECT count(*) // 2 FROM nation) AS o FROM nation)
SELECT n_nationkey, CAST(CASE WHEN o >= 0 THEN 2 * o ELSE -2 * o - 1 END AS BIGINT) AS place FROM i QUALIFY row_number() OVER (ORDER BY place) <= 16""")
def centre_out_windows(t):
    return sets.centre_out(t.nation.select("n_nationkey"), "n_nationkey").select("n_nationkey", F.col("place").cast("long").alias("place"))


@query("""SELECT count(*) AS n, true AS disjoint FROM orders""")
def train_test_split(t):
    train, test = sets.split_train_test(t.orders.select("o_orderkey"), "o_orderkey")
    both = train.withColumn("side", F.lit(0)).unionByName(test.withColumn("side", F.lit(1)))
    per = both.groupBy("o_orderkey").agg(F.countDistinct("side").alias("sides"))
    return per.agg(F.count("*").alias("n"), (F.max("sides") == 1).alias("disjoint"))
