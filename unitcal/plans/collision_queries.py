"""Batch collision probability on geometry derived from the order lines.

No table holds close approaches, so position, velocity, sigmas and sizes are simple
arithmetic on the line keys.  A coarse disk grid keeps the SQL form of the integral
small; the operator's default grid is 200 x 360.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from unitcal.operators import collision, hypothesis_tests
from unitcal.operators.splits import stratum
from unitcal.plans.registry import longs, query, round_scaled, rounded
from unitcal.plans.tables import table

N_RADIAL, N_ANGULAR = 8, 12

FIELDS = {
    "relative_position_r": "CASE WHEN l_orderkey % 89 = 0 THEN 0 ELSE l_orderkey % 400 - 200 END",
    "relative_position_t": "CASE WHEN l_orderkey % 89 = 0 THEN 0 ELSE l_partkey % 300 - 150 END",
    "relative_position_n": "CASE WHEN l_orderkey % 89 = 0 THEN 0 ELSE l_suppkey % 100 - 50 END",
    "relative_velocity_r": "CASE WHEN l_orderkey % 101 = 0 THEN 0 ELSE (l_linenumber - 4) * 10 END",
    "relative_velocity_t": "CASE WHEN l_orderkey % 101 = 0 THEN 0 ELSE (l_orderkey % 7 - 3) * 100 END",
    "relative_velocity_n": "CASE WHEN l_orderkey % 101 = 0 THEN 0 ELSE 7000 + l_quantity * 10 END",
    "t_sigma_r": "20 + l_partkey % 100",
    "t_sigma_t": "50 + l_suppkey % 300",
    "t_sigma_n": "20 + l_linenumber * 10",
    "t_ct_r": "(l_orderkey % 9 - 4) / 10e0",
    "t_cn_r": "(l_partkey % 7 - 3) / 10e0",
    "t_cn_t": "(l_suppkey % 5 - 2) / 10e0",
    "c_sigma_r": "30 + l_suppkey % 70",
    "c_sigma_t": "60 + l_partkey % 200",
    "c_sigma_n": "25 + l_orderkey % 50",
    "c_ct_r": "(l_suppkey % 9 - 4) / 10e0",
    "c_cn_r": "(l_orderkey % 7 - 3) / 10e0",
    "c_cn_t": "(l_partkey % 5 - 2) / 10e0",
    "t_span": "CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE 1 + l_quantity / 10 END",
    "c_span": "CASE WHEN l_partkey % 211 = 0 THEN NULL ELSE 1 + l_tax * 10 END",
}
REPORTED = "-3e0 - (l_partkey % 270) / 10e0"
KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
MISSING = " + ".join(f"CAST({f} IS NULL AS INTEGER)" for f in collision.REQUIRED_FIELDS)


def approaches(spark, sf):
    return table(spark, sf, "lineitem").select(
        *KEYS,
        *[F.expr(f"CAST({text} AS DOUBLE)").alias(name) for name, text in FIELDS.items()],
        F.expr(f"CAST({REPORTED} AS DOUBLE)").alias("reported"),
    )


FIELD_SQL = "f AS (SELECT " + ", ".join(KEYS) + ", " + ", ".join(
    f"CAST({text} AS DOUBLE) AS {name}" for name, text in FIELDS.items()
) + f", CAST({REPORTED} AS DOUBLE) AS reported FROM lineitem)"
COV_SQL = """cv AS (SELECT *, (t_span + c_span) / 2 AS hbr,
  t_sigma_r * t_sigma_r + c_sigma_r * c_sigma_r AS rr, t_sigma_t * t_sigma_t + c_sigma_t * c_sigma_t AS tt,
  t_sigma_n * t_sigma_n + c_sigma_n * c_sigma_n AS nn, t_ct_r * t_sigma_t * t_sigma_r + c_ct_r * c_sigma_t * c_sigma_r AS rt,
  t_cn_r * t_sigma_n * t_sigma_r + c_cn_r * c_sigma_n * c_sigma_r AS rn, t_cn_t * t_sigma_n * t_sigma_t + c_cn_t * c_sigma_n * c_sigma_t AS tn
  FROM f)"""
DET_SQL = "rr * (tt * nn - tn * tn) - rt * (rt * nn - tn * rn) + rn * (rt * tn - tt * rn)"
PLANE_SQL = """v0 AS (SELECT *, relative_position_r AS pr, relative_position_t AS pt, relative_position_n AS pn,
  sqrt(relative_velocity_r * relative_velocity_r + relative_velocity_t * relative_velocity_t + relative_velocity_n * relative_velocity_n) AS speed FROM cv),
v1 AS (SELECT *, relative_velocity_r / nullif(speed, 0) AS vr, relative_velocity_t / nullif(speed, 0) AS vt, relative_velocity_n / nullif(speed, 0) AS vn,
  pt * relative_velocity_n - pn * relative_velocity_t AS wr, pn * relative_velocity_r - pr * relative_velocity_n AS wt,
  pr * relative_velocity_t - pt * relative_velocity_r AS wn FROM v0),
v2 AS (SELECT *, wr = 0 AND wt = 0 AND wn = 0 AS par, CASE WHEN abs(vr) > 0.9 THEN 0.0 ELSE 1.0 END AS sr, CASE WHEN abs(vr) > 0.9 THEN 1.0 ELSE 0.0 END AS st FROM v1),
v3 AS (SELECT *, CASE WHEN par THEN sr - (sr * vr + st * vt) * vr ELSE wr END AS qr, CASE WHEN par THEN st - (sr * vr + st * vt) * vt ELSE wt END AS qt,
  CASE WHEN par THEN -(sr * vr + st * vt) * vn ELSE wn END AS qn FROM v2),
v4 AS (SELECT *, qr / nullif(sqrt(qr * qr + qt * qt + qn * qn), 0) AS ar, qt / nullif(sqrt(qr * qr + qt * qt + qn * qn), 0) AS at_,
  qn / nullif(sqrt(qr * qr + qt * qt + qn * qn), 0) AS an FROM v3),
v5 AS (SELECT *, vt * an - vn * at_ AS br, vn * ar - vr * an AS bt, vr * at_ - vt * ar AS bn FROM v4),
pl AS (SELECT *, ar * pr + at_ * pt + an * pn AS mx, br * pr + bt * pt + bn * pn AS my,
  rr * ar * ar + tt * at_ * at_ + nn * an * an + 2 * rt * ar * at_ + 2 * rn * ar * an + 2 * tn * at_ * an AS xx,
  rr * br * br + tt * bt * bt + nn * bn * bn + 2 * rt * br * bt + 2 * rn * br * bn + 2 * tn * bt * bn AS yy,
  rr * ar * br + tt * at_ * bt + nn * an * bn + rt * (ar * bt + at_ * br) + rn * (ar * bn + an * br) + tn * (at_ * bn + an * bt) AS xy FROM v5)"""
STATUS_SQL = f"""CASE WHEN {MISSING} > 0 THEN 'missing' WHEN speed = 0 THEN 'degenerate' ELSE 'ok' END"""
AXES_SQL = f"""ax AS (SELECT *, {STATUS_SQL} AS status, (xx + yy) / 2 - sqrt(pow((xx - yy) / 2, 2) + xy * xy) AS v_1,
  (xx + yy) / 2 + sqrt(pow((xx - yy) / 2, 2) + xy * xy) AS v_2, atan2(xy, (xx - yy) / 2) / 2 AS turn,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id FROM pl),
an AS (SELECT *, -sin(turn) * mx + cos(turn) * my AS m_1, cos(turn) * mx + sin(turn) * my AS m_2 FROM ax)"""
GRID_SQL = f"""g AS (SELECT (i.range + 0.5) / {N_RADIAL} AS ring, (j.range + 0.5) * 2 * pi() / {N_ANGULAR} AS angle
  FROM range({N_RADIAL}) i, range({N_ANGULAR}) j),
ig AS (SELECT id, least(1.0, greatest(0.0, sum(exp(-0.5 * (pow(hbr * ring * cos(angle) - m_1, 2) / v_1 + pow(hbr * ring * sin(angle) - m_2, 2) / v_2))
    * ring) * any_value(hbr * hbr / (2 * pi() * sqrt(v_1 * v_2))) * 2 * pi() / {N_ANGULAR * N_RADIAL})) AS pc
  FROM an, g WHERE status = 'ok' GROUP BY id),
res AS (SELECT an.*, pc, CASE WHEN pc > 0 THEN greatest(log10(pc), -30.0) WHEN status = 'ok' THEN -30.0 END AS log10_pc FROM an LEFT JOIN ig USING (id))"""
ALL_SQL = f"WITH {FIELD_SQL}, {COV_SQL}, {PLANE_SQL}, {AXES_SQL}, {GRID_SQL}"
KEY_SQL = ", ".join(KEYS)


@query("pc_missing_fields", f"WITH {FIELD_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS field, count(*) FILTER (WHERE {c} IS NULL) AS n_missing, round(avg(({c} IS NULL)::INT), 8) AS rate FROM f"
    for c in collision.REQUIRED_FIELDS
))
def pc_missing_fields(spark, sf):
    return rounded(collision.missing_fields(approaches(spark, sf)), 8)


@query("pc_covariance", f"WITH {FIELD_SQL}, {COV_SQL} SELECT {KEY_SQL}, round(rr, 3) AS cov_rr, round(rt, 3) AS cov_rt, round(({DET_SQL}) / 1e9, 3) AS det_e9 FROM cv")
def pc_covariance(spark, sf):
    out = collision.combined_covariance(approaches(spark, sf))
    return rounded(out.select(*KEYS, "cov_rr", "cov_rt", (F.col("cov_det") / 1e9).alias("det_e9")), 3)


@query("pc_encounter_plane", f"""WITH {FIELD_SQL}, {COV_SQL}, {PLANE_SQL}
SELECT {KEY_SQL}, round(sqrt(mx * mx + my * my), 5) AS miss, round(xx + yy, 3) AS trace FROM pl""")
def pc_encounter_plane(spark, sf):
    out = collision.encounter_plane(collision.combined_covariance(approaches(spark, sf)))
    miss = F.sqrt(F.col("miss_x") * F.col("miss_x") + F.col("miss_y") * F.col("miss_y"))
    return out.select(*KEYS, round_scaled(miss, 5).alias("miss"), round_scaled(F.col("p_xx") + F.col("p_yy"), 3).alias("trace"))


@query("pc_batch", ALL_SQL + f"""
SELECT {KEY_SQL}, CAST({MISSING} AS BIGINT) AS n_missing, round(hbr, 6) AS hbr, round(CASE WHEN status = 'ok' THEN sqrt(mx * mx + my * my) END, 5) AS miss_2d,
  round(CASE WHEN status = 'ok' THEN sqrt((yy * mx * mx - 2 * xy * mx * my + xx * my * my) / (xx * yy - xy * xy)) END, 6) AS mahalanobis_2d,
  round(log10_pc, 6) AS log10_pc, status FROM res""")
def pc_batch(spark, sf):
    out = collision.collision_probability(approaches(spark, sf), N_RADIAL, N_ANGULAR)
    kept = out.select(*KEYS, "n_missing", "hbr", "miss_2d", "mahalanobis_2d", "log10_pc", "status")
    return longs(rounded(kept, 6, miss_2d=5), "n_missing")


@query("pc_status", ALL_SQL + " SELECT status, count(*) AS n, round(count(*) / (SELECT count(*) FROM res), 8) AS share FROM res GROUP BY status")
def pc_status(spark, sf):
    from unitcal.operators.audit import tally

    out = collision.collision_probability(approaches(spark, sf), N_RADIAL, N_ANGULAR)
    return rounded(tally(out.select("status"), "status"), 8)


STRATA_EDGES = (-30.0, -15.0, -10.0, -6.0, 0.0)


@query("pc_agreement", ALL_SQL + """,
d AS (SELECT abs(log10_pc - reported) <= 0.5 AS within, abs(reported + 30) <= 3.0001e-4 AND abs(log10_pc + 30) <= 3.0001e-4 AS both_floor FROM res WHERE status = 'ok'),
b AS (SELECT 'all' AS block, within FROM d UNION ALL SELECT 'excluding floor', within FROM d WHERE NOT both_floor)
SELECT block, count(*) AS n, round(avg(within::INT), 6) AS share, CASE WHEN avg(within::INT) >= 0.8 THEN 'at or above the bar'
  WHEN avg(within::INT) >= 0.5 THEN 'partial' ELSE 'below' END AS band FROM b GROUP BY block""")
def pc_agreement(spark, sf):
    out = collision.collision_probability(approaches(spark, sf), N_RADIAL, N_ANGULAR)
    return rounded(collision.agreement(collision.against_reported(out, "reported")))


@query("pc_against_reported", ALL_SQL + """,
d AS (SELECT CASE WHEN reported <= -15 THEN 1 WHEN reported <= -10 THEN 2 WHEN reported <= -6 THEN 3 ELSE 4 END AS stratum,
        log10_pc - reported AS delta FROM res WHERE status = 'ok')
SELECT CAST(stratum AS BIGINT) AS stratum, count(*) AS n, round(avg(delta), 5) AS mean_delta, round(max(abs(delta)), 5) AS worst,
  count(*) FILTER (WHERE abs(delta) <= 0.5) AS n_within FROM d GROUP BY stratum""")
def pc_against_reported(spark, sf):
    out = collision.collision_probability(approaches(spark, sf), N_RADIAL, N_ANGULAR)
    compared = collision.against_reported(out, "reported").filter("status = 'ok'")
    band = stratum(F.col("reported"), collision.FLOOR, STRATA_EDGES)
    return rounded(compared.groupBy(band.cast("bigint").alias("stratum")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean_delta"), F.max(F.abs("delta")).alias("worst"),
        F.count_if("within").alias("n_within"),
    ), 5)


@query("pc_miss_check", f"""WITH {FIELD_SQL}, {COV_SQL}, {PLANE_SQL},
k AS (SELECT sqrt(mx * mx + my * my) AS a, sqrt(pr * pr + pt * pt + pn * pn) AS b FROM pl WHERE speed > 0 AND {MISSING} = 0)
SELECT count(*) AS n, round(corr(a, b), 6) AS pearson FROM k""")
def pc_miss_check(spark, sf):
    """Projected against straight miss distance."""
    out = collision.collision_probability(approaches(spark, sf), 1, 4).filter("status = 'ok'")
    straight = F.sqrt(sum((F.col(f"relative_position_{a}") * F.col(f"relative_position_{a}") for a in "rtn"), F.lit(0.0)))
    pairs = out.select("miss_2d", straight.alias("straight"))
    return rounded(hypothesis_tests.correlations(pairs, "miss_2d", "straight").select("n", "pearson"))


@query("pc_reference", """WITH s AS (
  SELECT l_quantity AS q, count(*) AS n, 20.0 + l_quantity * 10 AS sigma, 1.0 + l_quantity / 5 AS hbr FROM lineitem GROUP BY l_quantity)
SELECT q, n, round(1 - exp(-(hbr * hbr) / (2 * sigma * sigma)), 10) AS exact,
  round(hbr * hbr / (2 * sigma * sigma) * exp(-(30.0 * 30.0) / (2 * sigma * sigma)), 10) AS point_mass, true AS close FROM s""")
def pc_reference(spark, sf):
    """Closed forms against the integral, for the sizes that occur."""
    sizes = table(spark, sf, "lineitem").groupBy(F.col("l_quantity").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    df = sizes.withColumns({
        "sigma": 20.0 + F.col("q") * 10, "hbr": 1.0 + F.col("q") / 5, "var": F.pow(20.0 + F.col("q") * 10, F.lit(2.0)),
        "zero": F.lit(0.0),
    })
    integral = collision.disk_probability(60, 24)("zero", "zero", "var", "zero", "var", "hbr")
    exact = collision.isotropic_centred(F.col("sigma"), F.col("hbr"))
    out = df.withColumn("integral", integral["pc"]).select(
        "q", "n", exact.alias("exact"),
        collision.isotropic_small(F.col("sigma"), F.col("hbr"), F.lit(30.0)).alias("point_mass"),
        (F.abs(F.col("integral") / exact - 1.0) < 1e-6).alias("close"),
    )
    return rounded(out, 10)
