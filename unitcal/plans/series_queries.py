"""Structure, targets, eligibility and splits of the order series."""

from __future__ import annotations

from pyspark.sql import functions as F

from unitcal.functions import high_flag
from unitcal.operators import series, splits
from unitcal.plans.registry import longs, query, round_scaled, rounded
from unitcal.plans.tables import (
    A, CUTOFF, M, ORDERS, P, PAIRS, RECENCY, SEED, T, THRESHOLD, U, messages, pairs, table,
)
from unitcal.sources.tables import coerce_types, file_manifest, settings_hash, stamp

WITH_M = f"WITH {M}"


@query("series_structure", WITH_M + """
SELECT split || '_' || unit AS unit_key, tie, ttr,
       row_number() OVER (PARTITION BY unit ORDER BY ttr DESC, tie) - 1 AS msg_index,
       count(*) OVER (PARTITION BY unit) AS n_msgs
FROM m""")
def series_structure(spark, sf):
    ordered = series.order_messages(messages(spark, sf), ORDERS)
    key = series.namespaced_unit(F.col("split"), "unit")
    return ordered.select(key.alias("unit_key"), "tie", "ttr", "msg_index", "n_msgs")


@query("final_row", f"WITH {M}, {T} SELECT * FROM t")
def final_row(spark, sf):
    return series.final_messages(messages(spark, sf), ORDERS)


@query("series_targets", f"""WITH {M}, {T}
SELECT split, unit, tie, target, target_ttr, target > 450000 AS is_high FROM m JOIN t USING (unit)""")
def series_targets(spark, sf):
    """Train targets from the series itself, test targets from a separate label table."""
    df = messages(spark, sf)
    labels = series.final_messages(df, ORDERS)
    parts = []
    for s in ("train", "test"):
        part = df.filter(F.col("split") == s)
        targets = series.final_messages(part, ORDERS) if s == "train" else labels
        parts.append(series.attach_targets(part, targets, ORDERS))
    return series.stack_splits(*parts).select(
        "split", "unit", "tie", "target", "target_ttr",
        high_flag(F.col("target"), THRESHOLD, inclusive=False).alias("is_high"),
    )


@query("target_gate", f"""WITH {M}, {T}
SELECT count(*) FILTER (WHERE tie % 17 = 0) AS n_missing
FROM (SELECT unit, tie FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY ttr, tie DESC) AS rn
      FROM m) WHERE rn = 1)""")
def target_gate(spark, sf):
    df = messages(spark, sf).withColumn("value", F.when(F.col("tie") % 17 != 0, F.col("value")))
    return series.units_without_target(
        series.attach_targets(df, series.final_messages(df, ORDERS), ORDERS), ORDERS
    )


@query("admissible_rows", WITH_M + " SELECT unit, tie, ttr, value FROM m WHERE ttr >= 180")
def admissible_rows(spark, sf):
    return series.admissible(messages(spark, sf), ORDERS, CUTOFF).select("unit", "tie", "ttr", "value")


@query("eligible_units", f"""WITH {M}, {U}
SELECT unit, n_msgs, last_ttr, first_ttr FROM u WHERE n_msgs >= 2 AND last_ttr < 90 AND first_ttr >= 180""")
def eligible_units(spark, sf):
    return series.eligible_units(messages(spark, sf), ORDERS, CUTOFF, RECENCY)


@query("eligible_messages", f"""WITH {M}, {U}
SELECT split, count(*) AS n_messages, count(DISTINCT unit) AS n_units FROM m
WHERE unit IN (SELECT unit FROM u WHERE n_msgs >= 2 AND last_ttr < 90 AND first_ttr >= 180) GROUP BY split""")
def eligible_messages(spark, sf):
    df = messages(spark, sf)
    kept = df.join(series.eligible_units(df, ORDERS, CUTOFF, RECENCY), "unit", "left_semi")
    return kept.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_messages"), F.countDistinct("unit").alias("n_units")
    )


@query("unit_frame", f"""WITH {M}, {U}, {T}
SELECT unit, grp, split, n_msgs, target, target_ttr, last_ttr AS last_input_ttr,
       target AS last_input_value, target >= 450000 AS is_high
FROM u JOIN t USING (unit)""")
def unit_frame(spark, sf):
    df = messages(spark, sf, group=True)
    with_target = series.attach_targets(df, series.final_messages(df, ORDERS), ORDERS)
    return series.unit_frame(with_target, ORDERS, THRESHOLD, first=("split",))


@query("unit_frame_gaps", f"""WITH {M}
SELECT unit, value AS last_input_value FROM (
  SELECT *, row_number() OVER (PARTITION BY unit ORDER BY ttr, tie DESC) AS rn FROM m WHERE tie % 17 <> 0)
WHERE rn = 1""")
def unit_frame_gaps(spark, sf):
    """The last *known* value where some values are missing."""
    df = messages(spark, sf, group=True).withColumn(
        "value", F.when(F.col("tie") % 17 != 0, F.col("value"))
    )
    with_target = series.attach_targets(df, series.final_messages(df, ORDERS), ORDERS)
    frame = series.unit_frame(with_target, ORDERS, THRESHOLD)
    return frame.select("unit", "last_input_value").filter(F.col("last_input_value").isNotNull())


@query("as_of_value", f"WITH {M}, {A} SELECT * FROM a")
def as_of_value(spark, sf):
    return series.as_of(messages(spark, sf), ORDERS, CUTOFF)


@query("forecast_frame", f"""WITH {M}, {U}, {T}, {A}
SELECT u.unit, split, target, target_ttr, known, n_msgs, n_admissible, last_ttr, first_ttr
FROM u JOIN t USING (unit) LEFT JOIN a USING (unit)""")
def forecast_frame(spark, sf):
    return series.forecast_frame(messages(spark, sf), ORDERS, CUTOFF, ("split",))


@query("last_k_rows", WITH_M + """
SELECT unit, tie, recency FROM (
  SELECT *, row_number() OVER (PARTITION BY unit ORDER BY ttr, tie DESC) AS recency FROM m WHERE ttr >= 180)
WHERE recency <= 3""")
def last_k_rows(spark, sf):
    kept = series.last_k(series.admissible(messages(spark, sf), ORDERS, CUTOFF), ORDERS, 3)
    return longs(kept.select("unit", "tie", "recency"), "recency")


@query("trivial_units", PAIRS + """
SELECT count(*) FILTER (WHERE abs(known - target) <= 1e-8 + 1e-5 * abs(target)) AS n_trivial,
       count(*) AS n_units,
       round(count(*) FILTER (WHERE abs(known - target) <= 1e-8 + 1e-5 * abs(target)) / count(*), 6) AS share
FROM p""")
def trivial_units(spark, sf):
    return rounded(series.trivial_units(pairs(spark, sf)))


@query("numeric_coercion", """
SELECT o_orderkey AS tie, try_cast(o_orderpriority AS DOUBLE) AS priority,
       try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority_rank, o_orderstatus
FROM orders""")
def numeric_coercion(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("tie"),
        F.col("o_orderpriority").alias("priority"),
        F.substring("o_orderpriority", 1, 1).alias("priority_rank"),
        "o_orderstatus",
    )
    return coerce_types(orders, text=("o_orderstatus",), keep=("tie",))


@query("table_manifest")
def table_manifest(spark, sf):
    """Size and checksum of the table files."""
    return file_manifest(spark, sf, glob="*.parquet")


@query("stamped_scores", PAIRS + f"""
SELECT split, count(*) AS n_units, 'persistence' AS experiment,
       '{settings_hash({"cutoff": CUTOFF, "threshold": THRESHOLD})}' AS settings_sha256,
       CAST(42 AS BIGINT) AS seed_used, CAST(2000 AS BIGINT) AS n_resamples
FROM p GROUP BY split""")
def stamped_scores(spark, sf):
    counts = pairs(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n_units"))
    settings = {"cutoff": CUTOFF, "threshold": THRESHOLD}
    stamped = stamp(counts, "persistence", settings, SEED, 2000).drop("stamped_utc")
    return longs(stamped, "seed_used", "n_resamples")


# --- splits ------------------------------------------------------------------------------

SPLIT_SQL = """placed AS (
  SELECT unit, row_number() OVER (ORDER BY md5('42:' || unit), unit) - 1 AS r, count(*) OVER () AS n
  FROM (SELECT DISTINCT unit FROM m WHERE split = 'train')),
outer_split AS (
  SELECT unit, CASE WHEN r < round_even(0.6 * n, 0) THEN 'fit'
              WHEN r < round_even(0.6 * n, 0) + round_even(0.2 * n, 0) THEN 'calibration'
              ELSE 'self_test' END AS subset FROM placed),
inner_placed AS (
  SELECT unit, row_number() OVER (ORDER BY md5('42:' || unit), unit) - 1 AS r, count(*) OVER () AS n
  FROM outer_split WHERE subset = 'fit'),
s AS (
  SELECT unit, subset FROM outer_split WHERE subset <> 'fit'
  UNION ALL
  SELECT unit, CASE WHEN r < round_even(0.8 * n, 0) THEN 'fit_inner' ELSE 'val_inner' END FROM inner_placed)"""


def training_split(spark, sf):
    train = messages(spark, sf).filter(F.col("split") == "train")
    return splits.nested_split(train, "unit", SEED)


@query("split_units", f"WITH {M}, {SPLIT_SQL} SELECT * FROM outer_split")
def split_units(spark, sf):
    train = messages(spark, sf).filter(F.col("split") == "train")
    return splits.split_units(train, "unit", {"fit": 0.6, "calibration": 0.2, "self_test": 0.2}, SEED)


@query("nested_split", f"WITH {M}, {SPLIT_SQL} SELECT * FROM s")
def nested_split(spark, sf):
    return training_split(spark, sf)


@query("split_overlap", f"""WITH {M}, {SPLIT_SQL}
SELECT unit, count(DISTINCT subset) AS n_subsets
FROM (SELECT * FROM s UNION ALL SELECT DISTINCT unit, 'urgent' FROM m WHERE priority = '1-URGENT')
GROUP BY unit HAVING count(DISTINCT subset) > 1""")
def split_overlap(spark, sf):
    """Customers of a split that also sit in a second, overlapping subset."""
    urgent = messages(spark, sf).filter(F.col("priority") == "1-URGENT").select(
        "unit", F.lit("urgent").alias("subset")
    ).distinct()
    return splits.overlapping_units(training_split(spark, sf).unionByName(urgent), "unit")


@query("split_members", f"""WITH {M}, {SPLIT_SQL}
SELECT count(*) AS n_messages, count(DISTINCT unit) AS n_units, round(avg(value), 4) AS mean_value
FROM m WHERE unit IN (SELECT unit FROM s WHERE subset IN ('calibration', 'self_test'))""")
def split_members(spark, sf):
    kept = splits.members(
        messages(spark, sf), training_split(spark, sf), "unit", "calibration", "self_test"
    )
    return kept.agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.countDistinct("unit").alias("n_units"),
        round_scaled(F.avg("value"), 4).alias("mean_value"),
    )


STRATUM_SQL = """CASE WHEN abs(l_discount - 0.0) <= 1e-8 THEN 0
  WHEN l_discount > 0.0 AND l_discount <= 0.025 THEN 1
  WHEN l_discount > 0.025 AND l_discount <= 0.055 THEN 2
  WHEN l_discount > 0.055 AND l_discount <= 0.075 THEN 3
  WHEN l_discount > 0.075 THEN 4 END"""
EDGES = (0.0, 0.025, 0.055, 0.075, float("inf"))


def lines_with_stratum(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line"),
        "l_discount",
        "l_extendedprice",
        splits.stratum(F.col("l_discount"), 0.0, EDGES).cast("bigint").alias("stratum"),
    )


@query("strata", f"""
SELECT CAST({STRATUM_SQL} AS BIGINT) AS stratum, count(*) AS n, round(min(l_discount), 6) AS lo,
       round(max(l_discount), 6) AS hi
FROM lineitem GROUP BY 1""")
def strata(spark, sf):
    return rounded(lines_with_stratum(spark, sf).groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), F.min("l_discount").alias("lo"), F.max("l_discount").alias("hi")
    ))


@query("stratified_sample", f"""
WITH l AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS line,
         CAST({STRATUM_SQL} AS BIGINT) AS stratum FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || line), line) AS rn,
             count(*) OVER (PARTITION BY stratum) AS population
      FROM l WHERE stratum IS NOT NULL)
SELECT line, stratum, population, least(20, population) AS take FROM r WHERE rn <= 20""")
def stratified_sample(spark, sf):
    drawn = splits.stratified_sample(
        lines_with_stratum(spark, sf), "stratum", "line", size=100, n_strata=5, seed=SEED
    )
    return longs(drawn.select("line", "stratum", "population", "take"), "take")


# --- column policy: customers stand in for columns, market segments for verdicts ----------

POLICY_SQL = """pol AS (
  SELECT c_name AS col, CASE c_mktsegment WHEN 'BUILDING' THEN 'unsafe' WHEN 'MACHINERY' THEN 'ambiguous'
                        ELSE 'safe' END AS leakage_class,
         CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END AS rationale
  FROM customer)"""


def policy_rows(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_name").alias("column"),
        F.when(F.col("c_mktsegment") == "BUILDING", "unsafe")
        .when(F.col("c_mktsegment") == "MACHINERY", "ambiguous")
        .otherwise("safe").alias("leakage_class"),
        F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment")).alias("rationale"),
    )


@query("policy_tally", f"""WITH {POLICY_SQL},
v AS (SELECT CASE WHEN col IN ('Customer#000000000', 'Customer#000000001') THEN 'hard_excluded'
             WHEN leakage_class = 'unsafe' THEN 'unsafe'
             WHEN leakage_class = 'ambiguous' THEN 'ambiguous_excluded' ELSE 'admitted' END AS verdict FROM pol)
SELECT verdict, count(*) AS n, round(count(*) / (SELECT count(*) FROM v), 8) AS share FROM v GROUP BY verdict""")
def policy_tally(spark, sf):
    from unitcal.operators.audit import tally

    verdict = splits.policy_class(["Customer#000000000", "Customer#000000001"])
    return rounded(tally(policy_rows(spark, sf).withColumn("verdict", verdict), "verdict"), 8)


@query("policy_coverage", f"""WITH {POLICY_SQL},
cols AS (SELECT DISTINCT 'Customer#' || lpad(CAST(o_custkey + 3 AS VARCHAR), 9, '0') AS col FROM orders)
SELECT col AS "column", 'missing' AS problem FROM cols WHERE col NOT IN (SELECT col FROM pol)
UNION ALL SELECT col, 'extra' FROM pol WHERE col NOT IN (SELECT col FROM cols)""")
def policy_coverage(spark, sf):
    columns = table(spark, sf, "orders").select(
        F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") + 3).cast("string"), 9, "0")).alias("column")
    ).distinct()
    return splits.policy_coverage(policy_rows(spark, sf), columns)


@query("policy_gaps", f"""WITH {POLICY_SQL}
SELECT col AS "column", CAST(1 AS BIGINT) AS n_empty FROM pol WHERE trim(rationale) = ''""")
def policy_gaps(spark, sf):
    gaps = splits.incomplete_policy_rows(policy_rows(spark, sf), ["leakage_class", "rationale"])
    return gaps.select("column", F.size("empty_fields").cast("bigint").alias("n_empty"))
