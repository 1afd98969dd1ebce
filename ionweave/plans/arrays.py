"""Queries of vectors, sequences and chemistry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionweave.functions import chem, numeric, vectors
from ionweave.operators import aggregates, learn
from ionweave.operators.sets import found_of, without_places
from ionweave.plans.registry import query

# --- vectors ----------------------------------------------------------------------------------------------------

_PAIRS = "(SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _pairs(t):
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")


@query(f"""SELECT vec_id, round(list_dot_product(x, y) / (greatest(sqrt(list_dot_product(x, x)), 1e-5) * greatest(sqrt(list_dot_product(y, y)), 1e-5)), 4) AS cosine FROM {_PAIRS}""")
def cosine_sim(t):
    return _pairs(t).select("vec_id", vectors.cosine(F.col("x"), F.col("y")).alias("cosine"))


@query(f"""
WITH r AS (SELECT vec_id, list_transform(x, lambda v: CASE WHEN v < 0 THEN 1e-5 ELSE v END + 1e-5) AS p, list_transform(y, lambda v: CASE WHEN v < 0 THEN 1e-5 ELSE v END + 1e-5) AS q FROM {_PAIRS}),
s AS (SELECT vec_id, unnest(p) / list_sum(p) AS p, unnest(q) / list_sum(q) AS q FROM r)
SELECT vec_id, round(sum(p * ln(p / q)), 6) AS kl FROM s GROUP BY 1""")
def kl_div(t):
    return _pairs(t).select("vec_id", F.round(vectors.kl_divergence(F.col("x"), F.col("y")), 6).alias("kl"))


@query("""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT vec_id, round(list_max(x), 6) AS top, list_position(x, list_max(x)) - 1 AS place, round(list_stddev_pop(x), 6) AS sigma, CAST(len(list_filter(x, lambda v: v >= 0.1)) AS INTEGER) AS above FROM v""")
def vector_stats(t):
    x = F.col("embedding").cast("array<double>")
    return t.embeddings.select(
        "vec_id", F.round(F.array_max(x), 6).alias("top"), vectors.argmax(x).alias("place"), F.round(vectors.sigma(x), 6).alias("sigma"), F.size(vectors.drop_below(x, 0.1)).alias("above")
    )


@query("""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), m AS (SELECT *, list_min(x) AS a, list_max(x) AS b FROM v)
SELECT vec_id, round(list_sum(list_transform(x, lambda v: (v - a) / greatest(b - a, 1e-12))), 6) AS scaled, round(list_sum(list_transform(x, lambda v: v / b)), 5) AS by_max FROM m""")
def vector_scale(t):
    x = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", F.round(vectors.total(vectors.scaled(x)), 6).alias("scaled"), F.round(vectors.total(vectors.by_max(x)), 5).alias("by_max"))


@query("""
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT vec_id, x[62:64] || x[1:61] AS rolled, list_transform(range(10), lambda i: CASE WHEN i = label THEN 1.0 ELSE 0.0 END)::DOUBLE[] AS hot FROM v""")
def vector_shapes(t):
    x = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", vectors.roll(x, 3).alias("rolled"), vectors.one_hot(F.col("label"), 10).alias("hot"))


@query("""
WITH v AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS a, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x - 0.05), i) AS b FROM v)
SELECT vec_id, list(CAST(i AS INTEGER) ORDER BY a) FILTER (a <= 5) AS top, list(CAST(i AS INTEGER) ORDER BY b) FILTER (b <= 2) AS near FROM r GROUP BY 1""")
def topx_values(t):
    x = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", F.transform(vectors.top_places(x, 5), lambda p: p["place"]).alias("top"), vectors.nearest_places(x, 0.05, 2).alias("near"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * 0.5 + l_discount * -2.0 + l_tax * 1.5, 6) AS score FROM lineitem""")
def linear_score(t):
    score = vectors.linear_score([F.col(c) for c in ("l_quantity", "l_discount", "l_tax")], [0.5, -2.0, 1.5])
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(score, 6).alias("score"))


@query("""
SELECT label < 5 AS decoy, count(*) AS n, round(sum(embedding[1]), 5) AS s_0, round(sum(embedding[2]), 5) AS s_1, round(sum(embedding[1]::DOUBLE * embedding[1]), 5) AS p_0_0,
  round(sum(embedding[2]::DOUBLE * embedding[1]), 5) AS p_1_0, round(sum(embedding[2]::DOUBLE * embedding[2]), 5) AS p_1_1 FROM embeddings GROUP BY 1""")
def lda_gram(t):
    rows = t.embeddings.select((F.col("label") < 5).alias("decoy"), F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    out = rows.groupBy("decoy").agg(*aggregates.lda_sums(["a", "b"], "decoy"))
    return out.select("decoy", "n", *[F.round(c, 5).alias(c) for c in ("s_0", "s_1", "p_0_0", "p_1_0", "p_1_1")])


@query("""
WITH x AS (SELECT vec_id, label < 5 AS d, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings),
m AS (SELECT (var_samp(a) FILTER (d) + var_samp(a) FILTER (NOT d)) / 2 + 1e-9 AS aa, (var_samp(b) FILTER (d) + var_samp(b) FILTER (NOT d)) / 2 + 1e-9 AS bb,
  (covar_samp(a, b) FILTER (d) + covar_samp(a, b) FILTER (NOT d)) / 2 AS ab, avg(a) FILTER (NOT d) - avg(a) FILTER (d) AS ma, avg(b) FILTER (NOT d) - avg(b) FILTER (d) AS mb FROM x)
SELECT vec_id, round(a * (ma * bb - mb * ab) / (aa * bb - ab * ab) + b * (mb * aa - ma * ab) / (aa * bb - ab * ab), 5) AS discriminant FROM x, m""")
def lda_score(t):
    rows = t.embeddings.select("vec_id", (F.col("label") < 5).alias("decoy"), F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    scored = learn.with_score(rows, ["a", "b"], learn.fit_lda(rows, ["a", "b"], "decoy"))
    return scored.select("vec_id", F.round("discriminant", 5).alias("discriminant"))


@query("""SELECT label, round(corr(embedding[1], embedding[2]), 5) AS r FROM embeddings GROUP BY 1""")
def feature_correlation(t):
    return t.embeddings.groupBy("label").agg(F.round(F.corr(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")), 5).alias("r"))


@query("""SELECT event_id, round(value - value * (0.5 + 0.01 * value - 0.0001 * value * value) / 1e6, 9) AS mz, round(event_id / 7.0, 2) AS rounded FROM events""")
def mass_recalibration(t):
    rounded = numeric.round_to(F.col("event_id") / 7.0, 2)
    return t.events.select("event_id", F.round(numeric.recalibrated(F.col("value"), [0.5, 0.01, -0.0001]), 9).alias("mz"), F.round(rounded, 2).alias("rounded"))


@query("""
SELECT event_id, list_sort(list_distinct(list_filter([1, 3, 5, 7], lambda x: list_contains([user_id % 8, 3], x)))) AS found, list_filter([user_id, event_id, 7], lambda x: true)[2:3] AS kept FROM events""")
def set_arrays(t):
    theory, found = F.array(*[F.lit(x).cast("long") for x in (1, 3, 5, 7)]), F.array(F.col("user_id") % 8, F.lit(3).cast("long"))
    kept = without_places(F.array("user_id", "event_id", F.lit(7).cast("long")), F.array(F.lit(0)))
    return t.events.select("event_id", found_of(found, theory).alias("found"), kept.alias("kept"))


# --- sequences --------------------------------------------------------------------------------------------------

# a made-up peptide for each part, with a modification in every third
_SEQ = "upper(replace(regexp_replace(p_name, '[^a-z]', '', 'g'), 'b', 'k'))"
_MOD = f"CASE WHEN p_partkey % 3 = 0 THEN left({_SEQ}, 2) || '[57.021464]' || substr({_SEQ}, 3) ELSE {_SEQ} END"


def _peptides(t):
    bare = F.upper(F.replace(F.regexp_replace("p_name", "[^a-z]", ""), F.lit("b"), F.lit("k")))
    modded = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.substring(bare, 1, 2), F.lit("[57.021464]"), F.substr(bare, F.lit(3)))).otherwise(bare)
    return t.part.select("p_partkey", bare.alias("bare"), modded.alias("peptide"))


@query(f"""
SELECT p_partkey, {_SEQ} AS stripped, CAST(length({_SEQ}) AS INTEGER) AS n, regexp_full_match({_SEQ}, '[ACDEFGHIJKLMNOPQRSTVWY]+') AS valid, replace({_SEQ}, 'I', 'L') AS as_leucine,
  regexp_replace({_SEQ}, '[^AEIOU]', '', 'g') AS vowels, CAST(length({_SEQ}) - length(replace({_SEQ}, 'L', '')) AS INTEGER) AS leucines FROM part""")
def seq_cleanup(t):
    p = F.col("peptide")
    return _peptides(t).select(
        "p_partkey",
        chem.strip_modifications(p).alias("stripped"),
        chem.bare_length(p).alias("n"),
        chem.is_valid_sequence(p).alias("valid"),
        chem.isoleucine_as_leucine(chem.strip_modifications(p)).alias("as_leucine"),
        chem.keep_characters(chem.strip_modifications(p), "AEIOU").alias("vowels"),
        F.size(chem.positions_of(chem.strip_modifications(p), "L")).alias("leucines"),
    )


@query(f"""
WITH s AS (SELECT p_partkey, {_SEQ} AS s FROM part)
SELECT p_partkey, {", ".join(f"CAST(length(s) - length(replace(s, '{c}', '')) AS INTEGER) AS n_{c}" for c in "AEIKLNR")} FROM s""")
def residue_counts(t):
    counts = _peptides(t).withColumn("c", chem.residue_counts(F.col("peptide")))
    return counts.select("p_partkey", *[F.element_at("c", c).alias(f"n_{c}") for c in "AEIKLNR"])


_MASSES = "(VALUES " + ", ".join(f"('{r}', {m!r}::DOUBLE)" for r, m in sorted(chem.RESIDUE_MASS.items())) + ") m(r, w)"


@query(f"""
WITH s AS (SELECT p_partkey, {_SEQ} AS s FROM part), l AS (SELECT p_partkey, unnest(string_split(s, '')) AS r FROM s)
SELECT p_partkey, round({chem.WATER!r}::DOUBLE + sum(coalesce(w, 0.0)) + CASE WHEN p_partkey % 3 = 0 THEN 57.021464 ELSE 0.0 END, 3) AS mass FROM l LEFT JOIN {_MASSES} USING (r) GROUP BY p_partkey""")
def peptide_mass(t):
    return _peptides(t).select("p_partkey", F.round(chem.peptide_mass(F.col("peptide")), 3).alias("mass"))


def _series(kind: str) -> str:
    s = _SEQ if kind == "b" else f"reverse({_SEQ})"
    extra = 0.0 if kind == "b" else chem.WATER
    return f"""
WITH s AS (SELECT p_partkey, {s} AS s FROM part), l AS (SELECT p_partkey, unnest(range(1, length(s))) AS i, s FROM s),
w AS (SELECT p_partkey, i, coalesce(w, 0.0) AS w FROM l LEFT JOIN {_MASSES} ON r = substr(s, i, 1)),
c AS (SELECT p_partkey, i, sum(w) OVER (PARTITION BY p_partkey ORDER BY i) AS t FROM w)
SELECT p_partkey, CAST(i AS INTEGER) AS number, round((t + {extra!r}::DOUBLE + 2 * {chem.PROTON!r}::DOUBLE) / 2, 5) AS mz FROM c"""


def _series_rows(t, kind):
    ions = _peptides(t).select("p_partkey", F.posexplode(chem.series_mz(F.col("bare"), kind, 2)).alias("i", "mz"))
    return ions.select("p_partkey", (F.col("i") + 1).alias("number"), F.round("mz", 5).alias("mz"))


@query(_series("b"))
def bseries(t):
    return _series_rows(t, "b")


@query(_series("y"))
def yseries(t):
    return _series_rows(t, "y")


@query("""
WITH l AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'b' ELSE 'y' END || (user_id % 30) || CASE WHEN event_id % 5 = 0 THEN '^2' WHEN event_id % 5 = 1 THEN '-H2O' ELSE '' END AS s FROM events)
SELECT event_id, s[1] AS kind, CAST(regexp_extract(s, '^[by](\\d+)', 1) AS INTEGER) AS number, CAST(CASE WHEN contains(s, '^2') THEN 2 ELSE 1 END AS INTEGER) AS charge FROM l""")
def ion_label_parse(t):
    kind = F.when(F.col("user_id") % 2 == 0, "b").otherwise("y")
    tail = F.when(F.col("event_id") % 5 == 0, "^2").when(F.col("event_id") % 5 == 1, "-H2O").otherwise("")
    return t.events.select("event_id", chem.parse_label(F.concat(kind, (F.col("user_id") % 30).cast("string"), tail)).alias("l")).select("event_id", "l.*")


@query(f"""
WITH s AS (SELECT p_partkey, {_SEQ} AS s FROM part)
SELECT p_partkey, s[1] || translate(s[2], '{chem.DECOY_FROM}', '{chem.DECOY_TO}') || substr(s, 3, length(s) - 4) || translate(substr(s, length(s) - 1, 1), '{chem.DECOY_FROM}', '{chem.DECOY_TO}') || right(s, 1) AS decoy FROM s""")
def decoy_sequences(t):
    return _peptides(t).select("p_partkey", chem.strip_modifications(chem.decoy_sequence(F.col("peptide"))).alias("decoy"))


@query("""
SELECT o_orderkey, round(o_totalprice * 2 - 2 * 1.00727647, 6) AS mass, round((o_totalprice + 3 * 1.00727647 + 1.003355) / 3, 6) AS mz, o_orderpriority || '|' || o_orderstatus AS key,
  replace('>' || o_orderstatus || ';>' || o_orderpriority, '>', '>decoy_') AS proteins FROM orders""")
def mass_conversions(t):
    price = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey",
        F.round(chem.mz_to_mass(price, F.lit(2)), 6).alias("mass"),
        F.round(chem.mass_to_mz(price, F.lit(3), 1), 6).alias("mz"),
        chem.build_key(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("key"),
        chem.tag_decoy_proteins(F.concat(F.lit(">"), "o_orderstatus", F.lit(";>"), "o_orderpriority")).alias("proteins"),
    )


@query("""SELECT p_partkey, CAST(p_size AS INTEGER) AS c, CAST(2 * p_size + 2 AS INTEGER) AS h, CAST(CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS o FROM part""")
def formula_parse(t):
    text = F.concat(F.lit("C"), F.col("p_size").cast("string"), F.lit("H"), (2 * F.col("p_size") + 2).cast("string"), F.when(F.col("p_size") % 2 == 0, "O").otherwise(""))
    counts = t.part.withColumn("f", chem.formula_counts(text))
    return counts.select("p_partkey", F.element_at("f", "C").alias("c"), F.element_at("f", "H").alias("h"), F.element_at("f", "O").alias("o"))


@query("""
SELECT s_suppkey, round(s_acctbal - 4000, 6) AS time_delta, round(abs(s_acctbal - 4000), 6) AS time_delta_abs, round(sign(s_acctbal - 4000) * sqrt(least(abs(s_acctbal - 4000), 1000) / 1000), 6) AS time_delta_root FROM supplier""")
def time_features(t):
    from ionweave.operators.features import time_features as columns

    own = columns(F.col("s_acctbal"), F.lit(4000.0), 1000.0)
    return t.supplier.select("s_suppkey", *[F.round(own[c], 6).alias(c) for c in ("time_delta", "time_delta_abs", "time_delta_root")])
