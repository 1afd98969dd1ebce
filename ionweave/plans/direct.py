"""Queries of single operators that no other module's queries reach, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionweave.functions import chem, numeric, vectors
from ionweave.operators import aggregates, filters, joins, learn, sets
from ionweave.plans.arrays import _MOD, _SEQ, _peptides
from ionweave.plans.registry import query
from ionweave.plans.relational import _LABELS, labelled
from ionweave.sources import tabular

# --- sources ----------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 20000 AND 90000")
def read_between(t):
    return tabular.read_scans_between(t._spark, f"{t._dir}/orders.parquet", "o_totalprice", 20000.0, 90000.0).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def read_unique(t):
    return tabular.read_unique(t._spark, f"{t._dir}/events.parquet", "user_id", "event_id").select("event_id", "user_id")


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(p_size AS DOUBLE) AS p_size FROM part")
def read_typed(t):
    return tabular.read_typed(t._spark, f"{t._dir}/part.parquet", "p_partkey long, p_size double")


def made_scans(t):
    """A scan for each type and user of the events, whose points they are."""
    points = F.collect_list(F.struct(F.col("value").alias("mz"), F.col("event_id").cast("double").alias("intensity"))).alias("p")
    rows = t.events.groupBy(F.col("event_type").alias("target_key"), F.col("user_id").alias("scan_number")).agg(points)
    level = F.when(F.col("scan_number") % 3 == 0, 1).otherwise(2).alias("ms_level")
    return rows.select("target_key", "scan_number", level, (F.col("scan_number") * 0.5).alias("scan_time"), F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"))


@query("SELECT event_type AS target_key, user_id AS scan_number, user_id * 0.5::DOUBLE AS scan_time, value AS mz, event_id::DOUBLE AS intensity FROM events WHERE user_id % 3 <> 0")
def points_of_windows(t):
    return aggregates.points_by_window(made_scans(t))


@query("SELECT event_type AS target_key, user_id AS scan_number, count(*) AS n FROM events WHERE user_id % 3 = 0 AND event_type = 'click' GROUP BY 1, 2")
def scans_of_a_window(t):
    return filters.in_window(filters.at_level(made_scans(t), 1), "click").select("target_key", "scan_number", F.size("mz").cast("long").alias("n"))


# --- filters ----------------------------------------------------------------------------------------------------


@query("SELECT event_id, value AS intensity FROM events WHERE abs(value) > 20")
def nonempty_points(t):
    return filters.without_empty_points(t.events.select("event_id", F.col("value").alias("intensity")), 20.0)


@query(f"""
SELECT p_partkey, {_MOD} AS peptide, CAST(p_size % 5 AS INTEGER) AS charge, p_retailprice AS precursor_mz FROM part
WHERE length({_SEQ}) BETWEEN 8 AND 14 AND p_size % 5 BETWEEN 1 AND 3 AND regexp_full_match({_SEQ}, '[ACDEFGHIJKLMNOPQRSTVWY]+') AND p_retailprice BETWEEN 910 AND 990""")
def eligible_precursors(t):
    rows = _peptides(t).drop("bare").join(t.part.select("p_partkey", (F.col("p_size") % 5).cast("int").alias("charge"), F.col("p_retailprice").alias("precursor_mz")), "p_partkey")
    return filters.precursors_in_range(filters.valid_sequences(filters.eligible(rows, (8, 14), (1, 3))), 910.0, 990.0)


@query("SELECT event_id, list_filter([value, value * 2, 15.0], lambda x: x > 10 AND x <= 40) AS mz FROM events")
def ions_in_range(t):
    ions = F.array(*[F.struct(c.cast("double").alias("mz")) for c in (F.col("value"), F.col("value") * 2, F.lit(15.0))])
    return t.events.select("event_id", filters.ions_in_range(ions, 10.0, 40.0)["mz"].alias("mz"))


@query("SELECT event_id, value FROM events WHERE value > 90")
def correlated_rows(t):
    return filters.correlated(t.events.select("event_id", "value"), "value", 90.0)


# --- vectors and numbers ----------------------------------------------------------------------------------------

_ARRAY = "[value, value - 30, (user_id % 3)::DOUBLE]"


@query(f"""
SELECT event_id, list_transform({_ARRAY}, lambda x: CASE WHEN x < 5 THEN 0.0 ELSE x END) AS clamped, list_filter({_ARRAY}, lambda x: x >= 5) AS kept,
  CAST(len(list_filter({_ARRAY}, lambda x: x >= 5)) AS INTEGER) AS nonzero, [value, 0.0] AS finite FROM events""")
def vector_cleanup(t):
    v = F.array(F.col("value"), F.col("value") - 30, (F.col("user_id") % 3).cast("double"))
    clamped = vectors.raise_below(v, 5.0)
    finite = vectors.replace_nan(F.array(F.col("value"), F.lit(float("nan"))))
    return t.events.select("event_id", clamped.alias("clamped"), vectors.drop_below(v, 5.0).alias("kept"), vectors.nonzero_count(clamped).alias("nonzero"), finite.alias("finite"))


@query("""
SELECT event_id, list_transform(range(5), lambda i: CASE WHEN i = user_id % 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hot, [value, user_id::DOUBLE] AS x,
  CASE WHEN user_id % 2 = 0 THEN [0.0::DOUBLE, value, 0.0::DOUBLE] ELSE [0.0::DOUBLE, 0.0::DOUBLE, value] END AS placed, [value, 2.5] AS packed FROM events""")
def vector_forms(t):
    points = vectors.zip_points(F.array(F.col("value"), F.col("user_id").cast("double")), F.array(F.lit(1.0), F.lit(2.0)))
    placed = vectors.map_to_vector(F.create_map(F.when(F.col("user_id") % 2 == 0, 1).otherwise(2), F.col("value")), 3)
    packed = vectors.unpack_floats(vectors.pack_doubles(F.array(F.col("value"), F.lit(2.5))), double=True)
    return t.events.select("event_id", vectors.one_hot((F.col("user_id") % 5).cast("int"), 5).alias("hot"), vectors.unzip(points, "x").alias("x"), placed.alias("placed"), packed.alias("packed"))


@query("SELECT event_id, value > 50 AS bad, CASE WHEN value > 50 THEN -1.0 ELSE value END AS repaired, abs(value - 50) <= 5 OR abs(value - 80) <= 5 AS on_comb, value <= 1e-12 AS zero FROM events")
def bad_values(t):
    broken = F.when(F.col("value") > 50, F.lit(float("inf"))).otherwise(F.col("value"))
    return t.events.select(
        "event_id", numeric.any_bad(F.array(broken, F.lit(1.0))).alias("bad"), numeric.replace_bad(broken, 0.0, -1.0).alias("repaired"), vectors.comb(F.col("value"), [50.0, 80.0], 5.0).alias("on_comb"), numeric.is_zero(F.col("value")).alias("zero")
    )


@query("SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity + l_discount - l_quantity) * 1e6 / l_quantity, 3) AS ppm, round((l_quantity + l_discount + l_tax) / 3, 9) AS mean FROM lineitem")
def ppm_errors(t):
    ppm = numeric.ppm_error(F.col("l_quantity") + F.col("l_discount"), F.col("l_quantity"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(ppm, 3).alias("ppm"), F.round(learn.bagged_mean(["l_quantity", "l_discount", "l_tax"]), 9).alias("mean"))


@query("""
SELECT p_partkey, CAST(round(p_retailprice / (p_size * 10.0 + 1)) AS INTEGER) AS charge,
  [round(p_retailprice - 1.003355 / 2, 6), round(p_retailprice, 6), round(p_retailprice + 1.003355 / 2, 6)] AS ladder FROM part""")
def charges_and_isotopes(t):
    ladder = chem.isotope_ladder(F.col("p_retailprice"), F.lit(2), 1, 1)
    return t.part.select("p_partkey", chem.guess_charge(F.col("p_retailprice"), F.col("p_size") * 10.0 + 1).alias("charge"), F.transform(ladder, lambda m: F.round(m, 6)).alias("ladder"))


@query("""
WITH m AS (SELECT user_id, event_id % 40 AS k, sum(event_id)::DOUBLE AS v FROM events GROUP BY 1, 2), t AS (SELECT user_id, max(v) AS top FROM m GROUP BY 1),
d AS (SELECT user_id, k, coalesce(v, 0) AS v, round(coalesce(v, 0) / top * 1e4) AS l FROM (SELECT user_id, top, unnest(range(-1, 41)) AS k FROM t) LEFT JOIN m USING (user_id, k)),
n AS (SELECT *, lag(l) OVER w AS a, lead(l) OVER w AS b FROM d WINDOW w AS (PARTITION BY user_id ORDER BY k))
SELECT user_id, list(k ORDER BY k) FILTER (v > 0 AND l > a AND l >= b) AS apexes, CAST(count(*) FILTER (v >= 20000) AS INTEGER) AS high FROM n GROUP BY 1""")
def sparse_maxima(t):
    per = t.events.groupBy("user_id", (F.col("event_id") % 40).alias("k")).agg(F.sum("event_id").cast("double").alias("v"))
    maps = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    return maps.select("user_id", vectors.sparse_apexes(F.col("m")).alias("apexes"), F.size(vectors.drop_sparse_below(F.col("m"), 20_000.0)).alias("high"))


@query("SELECT event_id, true AS within FROM events")
def noisy_vectors(t):
    v = F.array(F.col("value"), F.lit(0.0))
    noisy = vectors.with_noise(v, F.col("event_id"), 0.5)
    off = F.zip_with(v, noisy, lambda a, b: F.abs(a - b))
    return t.events.select("event_id", (F.forall(off, lambda x: x <= 0.5 + 1e-9) & F.exists(off, lambda x: x > 0)).alias("within"))


# --- sequences --------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderpriority AS peptide, CAST(o_orderkey % 4 AS INTEGER) AS charge, true AS same FROM orders")
def key_parts(t):
    key = chem.build_key(F.col("o_orderpriority"), (F.col("o_orderkey") % 4).cast("string"))
    return t.orders.select("o_orderkey", chem.split_key(key).alias("k"), chem.same_ignoring_case(F.col("o_orderpriority"), F.lower("o_orderpriority")).alias("same")).select("o_orderkey", "k.peptide", "k.charge", "same")


def _changes(values: dict[str, float]) -> str:
    table = "map {" + ", ".join(f"'{a}': {v!r}::DOUBLE" for a, v in sorted(values.items())) + "}"
    return f"coalesce({table}[s[2]], 0.0) + coalesce({table}[s[length(s) - 1]], 0.0)"


@query(f"""
WITH x AS (SELECT p_partkey, p_size, {_SEQ} AS s FROM part)
SELECT p_partkey, round({_changes(chem._DECOY_MASS)}, 6) AS mass_shift, round(p_size + {_changes(chem.IRT_SHIFT)}, 6) AS irt FROM x""")
def decoy_shifts(t):
    rows = _peptides(t).join(t.part.select("p_partkey", "p_size"), "p_partkey")
    p = F.col("peptide")
    return rows.select("p_partkey", F.round(chem.decoy_mass_shift(p), 6).alias("mass_shift"), F.round(chem.decoy_irt(F.col("p_size").cast("double"), p), 6).alias("irt"))


@query(f"""
WITH p AS (SELECT DISTINCT substr({_SEQ}, 3, 6) AS peptide FROM part), q AS (SELECT replace('>' || p_name, ',', ' ') AS d, replace({_SEQ}, 'I', 'L') AS s FROM part)
SELECT peptide, coalesce(string_agg(d, ';' ORDER BY d), '') AS protein_group FROM p LEFT JOIN q ON contains(s, replace(peptide, 'I', 'L')) GROUP BY peptide""")
def protein_groups(t):
    rows = _peptides(t)
    proteins = rows.join(t.part.select("p_partkey", "p_name"), "p_partkey").select(F.concat(F.lit(">"), "p_name").alias("description"), F.col("bare").alias("sequence"))
    return joins.protein_groups(rows.select(F.substring("bare", 3, 6).alias("peptide")), proteins)


# --- orders -----------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, list(l_partkey ORDER BY l_extendedprice DESC, l_partkey)[1:3] AS top FROM lineitem GROUP BY 1")
def top_ions(t):
    ions = F.collect_list(F.struct(F.col("l_partkey").alias("mz"), F.col("l_extendedprice").alias("intensity"))).alias("ions")
    return t.lineitem.groupBy("l_orderkey").agg(ions).select("l_orderkey", sets.top_ions(F.col("ions"), 3)["mz"].alias("top"))


@query("SELECT user_id, list(value ORDER BY value) AS mz FROM events GROUP BY 1")
def sorted_points(t):
    return t.events.groupBy("user_id").agg(F.collect_list(F.struct(F.col("value").alias("mz"), "event_id")).alias("p")).select("user_id", sets.sorted_points(F.col("p"))["mz"].alias("mz"))


@query("SELECT bool_and(value >= before) AS is_sorted FROM (SELECT value, coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), value) AS before FROM events)")
def sortedness(t):
    return sets.is_sorted(t.events.withColumn("order", F.struct("ts", "event_id")), ["user_id"], "order", "value")


@query(f"SELECT doc_id, score FROM {_LABELS} ORDER BY decoy, score DESC, doc_id LIMIT 50")
def classifier_order(t):
    rows = labelled(t).withColumn("classifier", F.col("decoy").cast("int"))
    return rows.orderBy(*sets.by_classifier("classifier", "score", "doc_id")).limit(50).select("doc_id", "score")


@query(f"SELECT doc_id, score FROM {_LABELS} ORDER BY round(score / 7.0, 9) DESC, decoy DESC, doc_id LIMIT 50")
def discriminant_order(t):
    rows = labelled(t).withColumn("d", F.col("score") / 7.0).withColumn("c", F.lit(0.5))
    return rows.orderBy(*sets.by_discriminant("d", "c", "c", "decoy", "doc_id")).limit(50).select("doc_id", "score")


@query(f"""
WITH x AS (SELECT doc_id, score, (score % 100) / 100.0 AS q FROM {_LABELS})
SELECT doc_id, score FROM x QUALIFY row_number() OVER (ORDER BY score DESC, doc_id) <= (SELECT greatest(count(*) FILTER (q < 0.5), least(10, count(*))) FROM x)""")
def training_rows(t):
    rows = labelled(t).withColumn("q", F.col("score") % 100 / 100.0)
    return sets.training_prefix(rows, [F.desc("score"), F.asc("doc_id")], "q", 10).select("doc_id", "score")


# --- learners ---------------------------------------------------------------------------------------------------


@query("""
WITH x AS (SELECT label < 5 AS d, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings),
m AS (SELECT (var_samp(a) FILTER (d) + var_samp(a) FILTER (NOT d)) / 2 + 1e-9 AS aa, (var_samp(b) FILTER (d) + var_samp(b) FILTER (NOT d)) / 2 + 1e-9 AS bb,
  (covar_samp(a, b) FILTER (d) + covar_samp(a, b) FILTER (NOT d)) / 2 AS ab, avg(a) FILTER (NOT d) - avg(a) FILTER (d) AS ma, avg(b) FILTER (NOT d) - avg(b) FILTER (d) AS mb FROM x)
SELECT 'a' AS feature, round((ma * bb - mb * ab) / (aa * bb - ab * ab), 5) AS weight FROM m UNION ALL SELECT 'b', round((mb * aa - ma * ab) / (aa * bb - ab * ab), 5) FROM m""")
def lda_weights(t):
    rows = t.embeddings.select((F.col("label") < 5).alias("decoy"), F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    found = learn.fit_lda(rows, ["a", "b"], "decoy")
    return t._spark.createDataFrame([(n, float(w)) for n, w in zip("ab", found, strict=True)], "feature string, weight double").select("feature", F.round("weight", 5).alias("weight"))


@query("""
SELECT * FROM (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL
  SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', round(corr(l_extendedprice, l_tax), 6) FROM lineitem) WHERE r >= -1""")
def correlated_features(t):
    return learn.correlated_pairs(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"], -1.0).withColumn("r", F.round("r", 6))
