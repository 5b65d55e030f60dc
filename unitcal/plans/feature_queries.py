"""Summaries, sequences and model inputs of the order series."""

from __future__ import annotations

from pyspark.sql import functions as F

from unitcal.operators import features, series
from unitcal.operators.ordered import with_row
from unitcal.plans.registry import longs, query, round_scaled, rounded
from unitcal.plans.series_queries import SPLIT_SQL, training_split
from unitcal.plans.tables import A, CUTOFF, M, ORDERS, T, THRESHOLD, U, messages, table

COVARIATES = ("qty", "discount", "n_lines")
POLICY = {
    "qty": "safe", "discount": "safe", "n_lines": "safe", "ttr": "safe",
    "value": "unsafe", "tie": "unsafe", "priority": "ambiguous",
}
SUMMARISED = ("discount", "n_lines", "qty", "ttr", "value")

C = """c AS (
  SELECT m.*, l.qty, l.discount, l.n_lines FROM m LEFT JOIN (
    SELECT l_orderkey, sum(l_quantity) AS qty, avg(l_discount) AS discount, count(*)::DOUBLE AS n_lines
    FROM lineitem GROUP BY l_orderkey) l ON m.tie = l.l_orderkey)"""
K = """k AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY unit ORDER BY ttr, tie DESC) AS recency FROM c WHERE ttr >= 180)
  WHERE recency <= 3)"""


def covariate_messages(spark, sf, group=True):
    """Order messages with the sums of their lines; orders without lines have NULLs."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("tie")).agg(
        F.sum("l_quantity").alias("qty"),
        F.avg("l_discount").alias("discount"),
        F.count(F.lit(1)).cast("double").alias("n_lines"),
    )
    return messages(spark, sf, group).join(lines, "tie", "left")


def summary_sql(c: str) -> str:
    ok = f"FILTER (WHERE {c} IS NOT NULL)"
    last = f"arg_min({c}, recency) {ok}"
    return f"""round({last}, 6) AS {c}_last, round(avg({c}), 6) AS {c}_mean, round(min({c}), 6) AS {c}_min,
  round(max({c}), 6) AS {c}_max, round(stddev_samp({c}), 4) AS {c}_std,
  round({last} - arg_max({c}, recency) {ok}, 6) AS {c}_delta"""


SUMMARIES_SQL = ", ".join(summary_sql(c) for c in SUMMARISED)
STD_DIGITS = {f"{c}_std": 4 for c in SUMMARISED}


def summaries(spark, sf, group=True):
    return features.tabular_features(
        covariate_messages(spark, sf, group), ORDERS if group else SeriesWithoutGroup, POLICY, CUTOFF, k=3,
        hard_excluded=("value", "tie"),
    )


SeriesWithoutGroup = type(ORDERS)(unit="unit", ttr="ttr", tie="tie", value="value", group=None)


@query("tabular_features", f"""WITH {M}, {C}, {K}
SELECT unit, any_value(grp) AS grp, {SUMMARIES_SQL}, count(*) AS n_admissible,
       max(ttr) - min(ttr) AS window_span, min(ttr) AS last_admissible_ttr
FROM k GROUP BY unit""")
def tabular_features(spark, sf):
    return rounded(summaries(spark, sf), 6, **STD_DIGITS)


@query("feature_targets", f"""WITH {M}, {T}, {A}
SELECT count(*) AS n_units, count(*) FILTER (WHERE known IS NULL) AS n_dropped, CAST(0 AS BIGINT) AS n_bad_target
FROM t LEFT JOIN a USING (unit)""")
def feature_targets(spark, sf):
    targets = series.final_messages(messages(spark, sf), ORDERS)
    return features.align_targets(summaries(spark, sf, group=False), targets, "unit")[1]


@query("model_inputs", f"""WITH {M}, {T}, {C}, {K}, {SPLIT_SQL}
SELECT unit, subset, round(target, 6) AS target, round(arg_min(value, recency), 6) AS value_last,
       round(avg(qty), 6) AS qty_mean, count(*) AS n_admissible
FROM k JOIN t USING (unit) JOIN s USING (unit) GROUP BY unit, subset, target""")
def model_inputs(spark, sf):
    """Features, target and subset of every training unit, aligned by unit."""
    targets = series.final_messages(messages(spark, sf), ORDERS)
    aligned, _ = features.align_targets(summaries(spark, sf, group=False), targets, "unit")
    rows = features.with_subset(aligned, training_split(spark, sf), "unit")
    return rounded(rows.select("unit", "subset", "target", "value_last", "qty_mean", "n_admissible"))


@query("residual_target", f"""WITH {M}, {T}, {C}, {K}
SELECT unit, round(target - arg_min(value, recency), 4) AS residual, round(target, 4) AS back
FROM k JOIN t USING (unit) GROUP BY unit, target""")
def residual_target(spark, sf):
    targets = series.final_messages(messages(spark, sf), ORDERS)
    df, _ = features.align_targets(summaries(spark, sf, group=False), targets, "unit")
    base = features.anchor(df, "value_last")
    residual = features.to_model_target(F.col("target"), base, "residual")
    return rounded(df.select(
        "unit", residual.alias("residual"),
        features.from_model_output(residual, base, "residual").alias("back"),
    ), 4)


# --- sequences: the price times 1e40 stands in for a column of extreme magnitude -----------

SEQUENCE = ("huge", "qty", "value")
MAX_LEN = 4
SEQ_SQL = f"""k4 AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY unit ORDER BY ttr, tie DESC) AS recency FROM c WHERE ttr >= 180)
  WHERE recency <= {MAX_LEN}),
f4 AS (SELECT unit, ttr, tie, asinh(value * 1e40) AS huge, coalesce(qty, 0.0) AS qty, value,
         row_number() OVER (PARTITION BY unit ORDER BY ttr DESC, tie) AS pos,
         count(*) OVER (PARTITION BY unit) AS length FROM k4),
sc AS (SELECT avg(huge) AS mh, stddev_pop(huge) AS sh, avg(qty) AS mq, stddev_pop(qty) AS sq,
              avg(value) AS mv, stddev_pop(value) AS sv
       FROM f4 WHERE unit IN (SELECT unit FROM s WHERE subset = 'fit_inner')),
z4 AS (SELECT unit, tie, pos, length,
         greatest(-20.0, least(20.0, (huge - mh) / CASE WHEN sh < 1e-8 THEN 1.0 ELSE sh END)) AS huge,
         greatest(-20.0, least(20.0, (qty - mq) / CASE WHEN sq < 1e-8 THEN 1.0 ELSE sq END)) AS qty,
         greatest(-20.0, least(20.0, (value - mv) / CASE WHEN sv < 1e-8 THEN 1.0 ELSE sv END)) AS value
       FROM f4, sc)"""


def sequence_source(spark, sf):
    return covariate_messages(spark, sf, group=False).withColumn("huge", F.col("value") * 1e40)


@query("sequence_pad", f"""WITH {M}, {C}, {SPLIT_SQL}, {SEQ_SQL}, u4 AS (SELECT DISTINCT unit, length FROM f4)
SELECT unit, CAST(length AS BIGINT) AS length, CAST(g.range + 1 AS BIGINT) AS pos, g.range < length AS mask,
  round(coalesce(z.huge, -999.0), 5) AS x_huge, round(coalesce(z.qty, -999.0), 5) AS x_qty,
  round(coalesce(z.value, -999.0), 5) AS x_value
FROM u4 CROSS JOIN range({MAX_LEN}) g LEFT JOIN (SELECT unit, pos, huge, qty, value FROM z4) z
  USING (unit) WHERE z.pos = g.range + 1
UNION ALL
SELECT unit, CAST(length AS BIGINT), CAST(g.range + 1 AS BIGINT), false, -999.0, -999.0, -999.0
FROM u4 CROSS JOIN range({MAX_LEN}) g WHERE g.range >= length""")
def sequence_pad(spark, sf):
    fit_units = training_split(spark, sf).filter("subset = 'fit_inner'")
    padded = features.prepared_sequences(
        sequence_source(spark, sf), ORDERS, SEQUENCE, CUTOFF, MAX_LEN, fit_units
    )
    long = padded.select("unit", "length", "mask", F.posexplode("x").alias("pos", "row"))
    rows = long.select(
        "unit", "length", (F.col("pos") + 1).alias("pos"), F.col("mask")[F.col("pos")].alias("mask"),
        *[round_scaled(F.col("row")[i], 5).alias(f"x_{c}") for i, c in enumerate(SEQUENCE)],
    )
    return longs(rows, "length", "pos")


@query("standardised_rows", f"""WITH {M}, {C}, {SPLIT_SQL}, {SEQ_SQL}
SELECT unit, tie, round(huge, 5) AS huge, round(qty, 5) AS qty, round(value, 5) AS value FROM z4""")
def standardised_rows(spark, sf):
    rows = features.sequence_messages(sequence_source(spark, sf), ORDERS, SEQUENCE, CUTOFF, MAX_LEN)
    rows = features.condition(rows, features.extreme_columns(rows, SEQUENCE))
    rows, _ = features.fill_missing(rows, SEQUENCE)
    fit_units = training_split(spark, sf).filter("subset = 'fit_inner'")
    scale = features.standard_scale(rows.join(fit_units, "unit", "left_semi"), SEQUENCE)
    return rounded(features.standardised(rows, scale, SEQUENCE).select("unit", "tie", *SEQUENCE), 5)


@query("filled_entries", f"""WITH {M}, {C}, {SPLIT_SQL}, {SEQ_SQL}
SELECT count(*) FILTER (WHERE qty IS NULL) AS n_filled FROM k4""")
def filled_entries(spark, sf):
    rows = features.sequence_messages(sequence_source(spark, sf), ORDERS, SEQUENCE, CUTOFF, MAX_LEN)
    return features.fill_missing(rows, SEQUENCE)[1]


@query("embedding_scale", """
WITH e AS (SELECT label, i.range + 1 AS pos, embedding[i.range + 1]::DOUBLE AS x FROM embeddings, range(64) i)
SELECT CAST(pos AS BIGINT) AS pos, round(avg(x), 6) AS mean,
       round(CASE WHEN stddev_pop(x) < 1e-8 THEN 1.0 ELSE stddev_pop(x) END, 6) AS sd,
       round(max(greatest(-20.0, least(20.0, (x - m) / s))), 4) AS largest
FROM e JOIN (SELECT pos AS p, avg(x) AS m, stddev_pop(x) AS s FROM e GROUP BY pos) ON p = pos GROUP BY pos""")
def embedding_scale(spark, sf):
    """Scale of every embedding component, and its largest standardised value."""
    n = 64
    names = [f"e{i}" for i in range(n)]
    wide = table(spark, sf, "embeddings").select(
        *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)]
    )
    scale = features.standard_scale(wide, names)
    largest = features.standardised(wide, scale, names).agg(*[F.max(c).alias(c) for c in names])
    rows = F.array(*[
        F.struct(
            F.lit(i + 1).cast("bigint").alias("pos"), F.col(f"s.mean_{c}").alias("mean"), F.col(f"s.sd_{c}").alias("sd"),
            round_scaled(F.col(c), 4).alias("largest"),
        )
        for i, c in enumerate(names)
    ])
    return rounded(with_row(largest, scale, "s").select(F.explode(rows).alias("r")).select("r.*"))
