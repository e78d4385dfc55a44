"""Spectral sums: each embedding's squares stand for the eigenvalues of a graph of its own, the dimensions for nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spectrum as sp
from .registry import query

VALUES = "WITH v AS (SELECT vec_id AS grp, x::DOUBLE * x::DOUBLE AS value, k AS mode, x::DOUBLE AS x, label FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings))"


def values(t):
    x = F.col("x").cast("double")
    return t("embeddings").select(F.col("vec_id").alias("grp"), "label", F.posexplode("embedding").alias("mode", "x")).select("grp", "label", "mode", (x * x).alias("value"), x.alias("x"))


def modes(t):
    """One graph for each class: its modes are its vectors, ordered by id; nodes are dimensions."""
    return values(t).select(F.col("label").alias("grp"), F.col("grp").alias("mode"), (F.col("grp") / 1000.0).alias("value"), F.col("mode").alias("node"), F.col("x").alias("u"))


@query(VALUES + """, z AS (SELECT grp, count(*) AS modes, sum(exp(-1.5 * value)) AS heat_trace, sum(exp(-1.5 * value)) FILTER (value > 1e-9) AS excited_heat_trace, sum(exp(-1.5 * value) * value) AS e1,
 sum(exp(-1.5 * value) * value * value) AS e2, sum(exp(-1.5 * value) * value) FILTER (value > 1e-9) AS x1, sum(pow(value, -0.5)) FILTER (value > 1e-9) AS zeta,
 sum(-ln(value) * pow(value, -0.5)) FILTER (value > 1e-9) AS zeta_derivative, sum(ln(value)) FILTER (value > 1e-9) AS log_det, min(value) FILTER (value > 1e-9) AS gap FROM (SELECT grp, value FROM v) GROUP BY 1),
p AS (SELECT v.grp, -sum(exp(-1.5 * value) / heat_trace * ln(exp(-1.5 * value) / heat_trace)) AS entropy FROM v JOIN z USING (grp) GROUP BY 1)
SELECT grp, modes, round(heat_trace, 6) AS heat_trace, round(excited_heat_trace, 6) AS excited_heat_trace, round(e1 / heat_trace, 6) AS mean_energy, round(greatest(0, e2 / heat_trace - (e1 / heat_trace) * (e1 / heat_trace)), 6) AS energy_variance,
 round(entropy, 6) AS entropy, round(zeta, 4) AS zeta, round(zeta_derivative, 4) AS zeta_derivative, round(log_det, 6) AS log_det, round(gap, 6) AS gap, round(x1 / excited_heat_trace, 6) AS relaxation_rate FROM z JOIN p USING (grp)""")
def spectral_sums(t):
    """Thermal sums of each spectrum at time 1.5."""
    out = sp.thermal(values(t).select("grp", "value"), 1.5, 0.5).drop("gap_saturation")
    return out.withColumn("zeta", F.round("zeta", 4)).withColumn("zeta_derivative", F.round("zeta_derivative", 4))


@query(VALUES + """, g AS (SELECT k::INT AS sample, 0.1 * pow(pow(500.0, 1.0 / 31), k) AS t FROM range(32) r(k))
SELECT grp, sample, round(max(t), 6) AS t, round(sum(exp(-t * value) * value) / sum(exp(-t * value)), 6) AS rate FROM v, g WHERE value > 1e-9 GROUP BY 1, 2""")
def relaxation_curve(t):
    return sp.relaxation_curve(values(t).select("grp", "value"))


@query(VALUES + "SELECT label AS grp, grp AS mode, round(sum(pow(x, 4)), 6) AS ipr FROM v GROUP BY 1, 2")
def mode_participation(t):
    return sp.participation(modes(t))


@query(VALUES + """, h AS (SELECT label AS grp, mode AS node, sum(exp(-0.5 * (grp / 1000.0)) * x * x) AS t0, sum(exp(-2.0 * (grp / 1000.0)) * x * x) AS t1 FROM v GROUP BY 1, 2)
SELECT a.grp, a.node::INT AS a, b.node::INT AS b, round(sqrt((a.t0 - b.t0) * (a.t0 - b.t0) + (a.t1 - b.t1) * (a.t1 - b.t1)), 6) AS distance FROM h a JOIN h b ON a.grp = b.grp AND b.node = a.node + 1""")
def heat_signatures(t):
    """Distance of neighbouring dimensions by their heat-kernel profiles at two times."""
    profiles = sp.heat_signature(modes(t), [0.5, 2.0])
    pairs = profiles.select("grp", F.col("node").alias("a"), (F.col("node") + 1).alias("b"))
    return sp.signature_distance(profiles, pairs)


FIELD = VALUES + """, c AS (SELECT label AS grp, grp AS mode, grp / 1000.0 AS value, sum(x * (mode % 3 - 1)) AS c FROM v GROUP BY 1, 2, 3)"""


def field(t):
    one = modes(t).select("grp", "node").distinct()
    return sp.projected(modes(t), one.select("grp", "node", (F.col("node") % 3 - 1).cast("double").alias("x")))


@query(FIELD + """, w AS (SELECT *, exp(-1.5 * value) * c * c AS w FROM c), z AS (SELECT grp, sum(w) AS z FROM w GROUP BY 1)
SELECT grp, round(any_value(z), 6) AS partition, round(sum(value * c * c) / sum(c * c), 6) AS rayleigh, round(coalesce(-sum(CASE WHEN w / z > 0 THEN w / z * ln(w / z) END), 0), 6) AS entropy FROM w JOIN z USING (grp) GROUP BY 1""")
def field_spectrum(t):
    """A field's partition function, Rayleigh quotient and spectral entropy on each class's modes."""
    return sp.field_sums(field(t), 1.5)


NEXT = ", pr AS (SELECT vec_id AS a, vec_id + 1 AS b FROM embeddings)"


def following(t):
    return t("embeddings").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))


@query(VALUES + NEXT + """, r AS (SELECT grp, value, row_number() OVER (PARTITION BY grp ORDER BY value) AS rank FROM v)
SELECT a, b, round(avg(abs(x.value - y.value)), 6) AS distance FROM pr JOIN r x ON x.grp = a JOIN r y ON y.grp = b AND y.rank = x.rank GROUP BY 1, 2""")
def spectrum_distance(t):
    """Mean absolute difference of the sorted spectra of neighbouring ids."""
    return sp.value_distance(values(t).select("grp", "value"), following(t))


@query(VALUES + NEXT + """, q AS (SELECT *, exp(-0.5 * (mode / 10.0)) * x * x AS w, sum(exp(-0.5 * (mode / 10.0)) * x * x) OVER (PARTITION BY grp) AS z FROM v)
SELECT a, b, round(sqrt(sum(exp(-(m.mode / 10.0)) * (m.x - n.x) * (m.x - n.x))), 6) AS l2, round(sum(CASE WHEN m.w > 0 AND n.w > 0 THEN (m.w / m.z - n.w / n.z) * ln((m.w / m.z) / (n.w / n.z)) ELSE 0 END), 4) AS jeffreys
FROM pr JOIN q m ON m.grp = a JOIN q n ON n.grp = b AND n.mode = m.mode GROUP BY 1, 2""")
def spectrum_divergence(t):
    """Diffused distance and symmetric divergence of neighbouring vectors over common modes."""
    c = values(t).select("grp", "mode", (F.col("mode") / 10.0).alias("value"), F.col("x").alias("c"))
    return sp.divergences(c, following(t), 0.5).withColumn("jeffreys", F.round("jeffreys", 4))


@query("SELECT count(*) AS nodes, round(count(*) / sum(1.0 / n), 6) AS harmonic FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)")
def harmonic_degree(t):
    return sp.harmonic_degree(t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("degree")), "degree")
