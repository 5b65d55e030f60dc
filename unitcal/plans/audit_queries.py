"""Distribution tests, audit tables and predictive distributions on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from unitcal.functions import draw_bits
from unitcal.functions.columns import HART_DENOMINATOR, HART_NUMERATOR, TWO_32
from unitcal.functions.exact import binomial_p
from unitcal.operators import audit, hypothesis_tests, models, ordered, resample, series
from unitcal.plans.conformal_queries import binomial_sql
from unitcal.plans.registry import longs, query, rounded
from unitcal.plans.score_queries import POISSON_DRAWS, REPLICATES
from unitcal.plans.tables import (
    A, CUTOFF, M, MARGIN, EPSILON, ORDERS, P, PAIRS, RECENCY, SEED, T, THRESHOLD, U,
    messages, pairs, sql_draw, table,
)
from unitcal.session import stage


def horner_sql(coefficients) -> str:
    text = repr(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * x + {c!r})"
    return text


def cdf_sql(z: str) -> str:
    """Normal distribution function as a scalar subquery-free expression."""
    body = f"exp(-x * x / 2.0) * {horner_sql(HART_NUMERATOR)} / {horner_sql(HART_DENOMINATOR)}"
    near = body.replace("x", f"abs({z})").replace(f"eabs({z})p", "exp")
    return f"(CASE WHEN abs({z}) > 7.07 THEN CASE WHEN {z} > 0 THEN 1.0 ELSE 0.0 END WHEN {z} > 0 THEN 1.0 - {near} ELSE {near} END)"


def kolmogorov_sql(t: str) -> str:
    return (
        f"(CASE WHEN {t} < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum(list_transform(range(1, 101), "
        f"lambda j: CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * j * j * ({t}) * ({t})))))) END)"
    )


def two_sample_sql(source: str) -> str:
    """Statistics of samples one and two of ``source(k, v, second)`` per key k."""
    return f"""tg AS (SELECT k, v, count(*) FILTER (WHERE NOT second) AS one, count(*) FILTER (WHERE second) AS two FROM {source} GROUP BY k, v),
tc AS (SELECT *, sum(one) OVER w AS c1, sum(two) OVER w AS c2, sum(one) OVER (PARTITION BY k) AS n1, sum(two) OVER (PARTITION BY k) AS n2
       FROM tg WINDOW w AS (PARTITION BY k ORDER BY v)),
ts AS (SELECT k, any_value(n1)::DOUBLE AS n1, any_value(n2)::DOUBLE AS n2, max(abs(c1 / n1 - c2 / n2)) AS ks,
         sum(one * ((c2 - two) + two / 2.0))::DOUBLE AS u, sum(pow(one + two, 3) - (one + two))::DOUBLE AS tt FROM tc GROUP BY k),
tz AS (SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - tt / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM ts),
tm AS (SELECT k, quantile_cont(v, 0.5) FILTER (WHERE NOT second) AS m1, quantile_cont(v, 0.5) FILTER (WHERE second) AS m2 FROM {source} GROUP BY k)"""


TWO_SAMPLE_OUT = f"""CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(m1, 4) AS median_one, round(m2, 4) AS median_two,
  round(ks, 8) AS ks, round({kolmogorov_sql("sqrt(n1 * n2 / (n1 + n2)) * ks")}::DOUBLE, 6) AS ks_p, round(u, 1) AS u,
  round(least(1.0, 2.0 * {cdf_sql("(-z)")})::DOUBLE, 6) AS mw_p, round(1 - 2 * u / (n1 * n2), 8) AS rank_biserial,
  round(1 - u / (n1 * n2), 8) AS auc"""


def tidy_two_sample(df):
    return longs(rounded(df, 8, median_one=4, median_two=4, ks_p=6, u=1, mw_p=6), "n1", "n2")


@query("two_sample_lines", f"""WITH src AS (SELECT l_returnflag AS k, l_extendedprice AS v, l_linestatus = 'F' AS second FROM lineitem),
{two_sample_sql("src")}
SELECT k AS l_returnflag, {TWO_SAMPLE_OUT} FROM tz JOIN tm USING (k)""")
def two_sample_lines(spark, sf):
    """Line prices by status, per return flag: medians, Kolmogorov-Smirnov, Mann-Whitney."""
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    return tidy_two_sample(hypothesis_tests.two_sample(
        lines, "l_extendedprice", F.col("l_linestatus") == "F", ["l_returnflag"]
    ))


@query("two_sample_targets", f"""WITH {M}, {U}, {T}, src AS (SELECT 1 AS k, target AS v, split = 'test' AS second FROM u JOIN t USING (unit)),
{two_sample_sql("src")}
SELECT {TWO_SAMPLE_OUT} FROM tz JOIN tm USING (k)""")
def two_sample_targets(spark, sf):
    frame = series.forecast_frame(messages(spark, sf), ORDERS, CUTOFF, ("split",))
    return tidy_two_sample(hypothesis_tests.two_sample(frame, "target", F.col("split") == "test"))


@query("two_sample_ties", f"""WITH src AS (SELECT l_returnflag AS k, l_quantity AS v, l_linestatus = 'F' AS second FROM lineitem),
{two_sample_sql("src")}
SELECT k AS l_returnflag, {TWO_SAMPLE_OUT} FROM tz JOIN tm USING (k)""")
def two_sample_ties(spark, sf):
    """The same on quantities, where nearly every value is tied."""
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return tidy_two_sample(hypothesis_tests.two_sample(
        lines, "l_quantity", F.col("l_linestatus") == "F", ["l_returnflag"]
    ))


@query("uniformity", f"""WITH x AS (SELECT event_type, value / 491.0 AS v FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM x),
s AS (SELECT event_type, any_value(n) AS n, max(greatest(i / n - v, v - (i - 1) / n)) AS ks FROM r GROUP BY event_type)
SELECT event_type, n, round(ks, 8) AS ks, round({kolmogorov_sql("sqrt(n) * ks")}::DOUBLE, 6) AS ks_p FROM s""")
def uniformity(spark, sf):
    events = table(spark, sf, "events").select("event_type", (F.col("value") / 491.0).alias("v"))
    return rounded(hypothesis_tests.uniformity(events, "v", ["event_type"]), 8, ks_p=6)


@query("uniformity_small_groups")
def uniformity_small_groups(spark, sf):
    """Every customer's order dates over the span of all orders, by the finite-n law."""
    orders = table(spark, sf, "orders").select("o_custkey", F.datediff("o_orderdate", F.lit("1992-01-01")).alias("day"))
    longest = orders.agg(F.max("day").alias("span"))
    shares = ordered.attach_one(orders, longest, []).select("o_custkey", (F.col("day") / F.col("span")).alias("v"))
    return rounded(hypothesis_tests.uniformity(shares, "v", ["o_custkey"], exact_up_to=140), 8, ks_p=6)


@query("signed_rank", PAIRS + f""", d AS (SELECT grp, known - target AS d FROM p WHERE abs(known - target) > 1e-8),
g AS (SELECT grp, abs(d) AS s, count(*) AS n, count(*) FILTER (WHERE d > 0) AS up FROM d GROUP BY grp, abs(d)),
c AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY s) - (n - 1) / 2.0 AS rk, sum(n) OVER (PARTITION BY grp) AS tot FROM g),
w AS (SELECT grp, any_value(tot)::DOUBLE AS n, sum(rk * up) AS wp, sum(pow(n, 3) - n) AS tt FROM c GROUP BY grp),
z AS (SELECT *, least(wp, n * (n + 1) / 2 - wp) AS w, sqrt((n * (n + 1) * (2 * n + 1) - tt / 2) / 24) AS sd FROM w),
y AS (SELECT *, (w - n * (n + 1) / 4) / sd AS z FROM z)
SELECT grp, CAST(n AS BIGINT) AS n_nonzero, round(w, 1) AS w, round(least(1.0, 2.0 * {cdf_sql("(-abs(z))")})::DOUBLE, 6) AS wilcoxon_p FROM y""")
def signed_rank(spark, sf):
    frame = pairs(spark, sf, group=True).withColumn("delta", F.col("known") - F.col("target"))
    return longs(rounded(hypothesis_tests.signed_rank(frame, "delta", ["grp"]), 6, w=1), "n_nonzero")


@query("correlations", """WITH r AS (
  SELECT l_returnflag, l_quantity AS a, l_extendedprice AS b,
    rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS ra,
    rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS rb
  FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM r GROUP BY l_returnflag""")
def correlations(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return rounded(hypothesis_tests.correlations(lines, "l_quantity", "l_extendedprice", ["l_returnflag"]))


@query("average_ranks", """
SELECT l_quantity, count(*) AS ties, (SELECT count(*) FROM lineitem) AS n_total,
  round((SELECT count(*) FROM lineitem b WHERE b.l_quantity < a.l_quantity) + (count(*) + 1) / 2.0, 4)::DOUBLE AS rank
FROM lineitem a GROUP BY l_quantity""")
def average_ranks(spark, sf):
    return rounded(ordered.average_ranks(table(spark, sf, "lineitem"), "l_quantity"), 4)


@query("exact_quantiles", """
SELECT l_shipmonth, round(quantile_cont(l_extendedprice, 0.05), 4) AS q05, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50,
       round(quantile_cont(l_extendedprice, 0.95), 4) AS q95
FROM (SELECT CAST(month(l_shipdate) AS BIGINT) AS l_shipmonth, l_extendedprice FROM lineitem) GROUP BY l_shipmonth""")
def exact_quantiles(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.month("l_shipdate").cast("bigint").alias("l_shipmonth"), "l_extendedprice"
    )
    return rounded(ordered.quantiles(
        lines, "l_extendedprice", {"q05": 0.05, "q50": 0.5, "q95": 0.95}, ["l_shipmonth"]
    ), 4)


# --- audit tables ----------------------------------------------------------------------------


@query("expected_counts", """WITH o AS (
  SELECT 'orders' AS item, count(*) AS observed FROM orders UNION ALL SELECT 'customers', count(DISTINCT o_custkey) FROM orders),
e AS (SELECT 'orders' AS item, count(DISTINCT l_orderkey) AS expected FROM lineitem UNION ALL SELECT 'customers', count(*) FROM customer)
SELECT item, expected, observed, observed - expected AS delta, observed = expected AS match FROM e JOIN o USING (item)""")
def expected_counts(spark, sf):
    """Orders against the orders that have lines, ordering customers against the register."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    customers = table(spark, sf, "customer")

    def one(df, item, value, name):
        return df.agg(value.alias(name)).select(F.lit(item).alias("item"), name)

    observed = one(orders, "orders", F.count(F.lit(1)), "observed").unionByName(
        one(orders, "customers", F.countDistinct("o_custkey"), "observed"))
    expected = one(lines, "orders", F.countDistinct("l_orderkey"), "expected").unionByName(
        one(customers, "customers", F.count(F.lit(1)), "expected"))
    return audit.expected_counts(observed, expected)


@query("rule_conformance", f"""WITH {M}, {U}, {T}, x AS (
  SELECT split, 'input before cutoff' AS rule, ttr AS x, ttr >= 180 AS ok FROM m UNION ALL
  SELECT split, 'priced', value, value > 0 FROM m)
SELECT split, rule, round(min(x), 4) AS min, round(max(x), 4) AS max, round(avg(ok::INT), 8) AS share, bool_and(ok) AS holds
FROM x GROUP BY split, rule""")
def rule_conformance(spark, sf):
    rules = {
        "input before cutoff": (F.col("ttr"), F.col("ttr") >= CUTOFF),
        "priced": (F.col("value"), F.col("value") > 0),
    }
    return rounded(audit.rule_conformance(messages(spark, sf), rules, ["split"]), 8, min=4, max=4)


@query("prevalence", PAIRS + f""", {POISSON_DRAWS},
r AS (SELECT split, replicate, sum(times * (target >= 450000)::INT) / sum(times) AS share FROM pw GROUP BY split, replicate),
b AS (SELECT split, quantile_cont(share, 0.025) AS lo, quantile_cont(share, 0.975) AS hi FROM r GROUP BY split),
s AS (SELECT split, count(*) AS n, count(*) FILTER (WHERE target >= 450000) AS k FROM p GROUP BY split)
SELECT split, n AS n_units, k, round(k / n, 6) AS share, round(lo, 6) AS share_lo, round(hi, 6) AS share_hi, CAST(0 AS BIGINT) AS share_undefined,
  round(k / n / (SELECT k / n FROM s WHERE split = 'train'), 6) AS enrichment
FROM s JOIN b USING (split)""")
def prevalence(spark, sf):
    shares = resample.share_bounds(pairs(spark, sf), F.col("target") >= THRESHOLD, ["split"], n_replicates=REPLICATES, unit="unit")
    return rounded(audit.enrichment(shares, "split", "train"))


@query("messages_per_unit", f"""WITH {M}, {U}
SELECT split, count(*) AS n_units, round(avg(n_msgs), 6) AS mean, min(n_msgs) AS min, max(n_msgs) AS max,
  round(quantile_cont(n_msgs, 0.25), 4)::DOUBLE AS q25, round(quantile_cont(n_msgs, 0.5), 4)::DOUBLE AS q50, round(quantile_cont(n_msgs, 0.75), 4)::DOUBLE AS q75
FROM u GROUP BY split""")
def messages_per_unit(spark, sf):
    units = messages(spark, sf).groupBy("split", "unit").agg(F.count(F.lit(1)).alias("n_msgs"))
    return rounded(audit.size_summary(units, "n_msgs", ["split"]), 6)


MISSING_SQL = f"""WITH {M}, x AS (SELECT split, CASE WHEN tie % 17 = 0 THEN NULL ELSE value END AS value,
    CASE WHEN tie % 5 = 0 THEN NULL ELSE priority END AS priority, ttr FROM m),
r AS (SELECT split, 'value' AS "column", avg((value IS NULL)::INT) AS rate FROM x GROUP BY split UNION ALL
      SELECT split, 'priority', avg((priority IS NULL)::INT) FROM x GROUP BY split UNION ALL
      SELECT split, 'ttr', avg((ttr IS NULL)::INT) FROM x GROUP BY split)"""


def holey(spark, sf):
    df = messages(spark, sf).withColumns({
        "value": F.when(F.col("tie") % 17 != 0, F.col("value")),
        "priority": F.when(F.col("tie") % 5 != 0, F.col("priority")),
    })
    return audit.missing_rates(df, ["value", "priority", "ttr"], "split")


@query("missing_rates", MISSING_SQL + ' SELECT split, "column", round(rate, 8) AS rate FROM r')
def missing_rates(spark, sf):
    return rounded(holey(spark, sf), 8)


@query("columns_with_missing", MISSING_SQL + ' SELECT "column", round(max(rate), 8) AS worst FROM r GROUP BY 1 HAVING max(rate) > 0')
def columns_with_missing(spark, sf):
    return rounded(audit.columns_with_missing(holey(spark, sf)), 8)


GROUP_SQL = PAIRS + """, g AS (SELECT grp, count(*) FILTER (WHERE split = 'train') AS train_units,
  count(*) FILTER (WHERE split = 'train' AND target >= 450000) AS train_high, count(*) FILTER (WHERE split = 'test') AS test_units,
  count(*) FILTER (WHERE split = 'test' AND target >= 450000) AS test_high FROM p GROUP BY grp)"""


def groups(spark, sf):
    return audit.group_counts(
        pairs(spark, sf, group=True), "grp", "split", ["train", "test"], F.col("target") >= THRESHOLD
    )


@query("group_counts", GROUP_SQL + " SELECT * FROM g")
def group_counts(spark, sf):
    return groups(spark, sf)


@query("shared_groups", GROUP_SQL + " SELECT * FROM g WHERE train_units > 0 AND test_units > 0")
def shared_groups(spark, sf):
    return audit.shared_groups(groups(spark, sf), ["train", "test"])


# the floor of the series is the smallest line discount, 0
@query("floor_mass", """WITH l AS (
  SELECT l_returnflag AS split, l_orderkey AS unit, max(l_discount) AS target FROM lineitem GROUP BY ALL),
a AS (SELECT split, count(*) AS n_units, count(*) FILTER (WHERE target <= 1e-8) AS units_at_floor, avg((target <= 1e-8)::INT) AS share_at_floor,
        count(*) FILTER (WHERE target > 1e-8 AND target <= 0.05) AS rest_below, count(*) FILTER (WHERE target > 0.05) AS rest_above
      FROM l GROUP BY ROLLUP (split)),
b AS (SELECT l_returnflag AS split, count(*) FILTER (WHERE l_discount <= 1e-8) AS messages_at_floor FROM lineitem GROUP BY ROLLUP (l_returnflag))
SELECT coalesce(a.split, 'all') AS split, n_units, units_at_floor, round(share_at_floor, 8) AS share_at_floor, rest_below, rest_above, messages_at_floor
FROM a JOIN b ON a.split IS NOT DISTINCT FROM b.split""")
def floor_mass(spark, sf):
    """Discounts at zero: orders per return flag by their largest discount, and lines."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("split"), F.col("l_orderkey").alias("unit"), F.col("l_discount").alias("value")
    )
    units = lines.groupBy("split", "unit").agg(F.max("value").alias("target"))
    return rounded(audit.floor_mass(units, lines, "split", "target", "value", 0.0, 0.05), 8)


@query("histogram", f"""WITH {M}, h AS (SELECT split, CAST(CASE WHEN ttr < 0 THEN 0 WHEN ttr > 2000 THEN 41 ELSE least(floor(ttr / 50) + 1, 40) END AS INTEGER) AS bin
      FROM m WHERE ttr IS NOT NULL)
SELECT split, bin, CASE WHEN bin > 0 THEN ((bin - 1) * 50)::DOUBLE END AS left_edge, count(*) AS n,
       CASE WHEN bin BETWEEN 1 AND 40 THEN round(count(*) / (sum(count(*)) OVER (PARTITION BY split) * 50), 10) END AS density
FROM h GROUP BY split, bin""")
def histogram(spark, sf):
    return rounded(audit.histogram(messages(spark, sf), "ttr", 0.0, 2000.0, 40, ["split"]), 10)


@query("tally", """SELECT lang, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 8) AS share
FROM documents GROUP BY lang, source""")
def tally(spark, sf):
    return rounded(audit.tally(table(spark, sf, "documents").select("lang", "source"), "source", ["lang"]), 8)


# orders against the same customer's known value, in units of 100,000
ERRORS_SQL = PAIRS + """, e AS (SELECT unit, grp, (known - target) / 100000.0 AS d, target >= 450000 AS high FROM p)"""


def errors(spark, sf):
    return pairs(spark, sf, group=True).select(
        "unit", "grp", ((F.col("known") - F.col("target")) / 100000.0).alias("d"),
        (F.col("target") >= THRESHOLD).alias("high"),
    )


@query("error_blocks", ERRORS_SQL + """,
b AS (SELECT 'all' AS block, d FROM e UNION ALL SELECT 'excluding', d FROM e WHERE NOT high UNION ALL SELECT 'stratum ' || grp, d FROM e)
SELECT block, count(*) AS n, round(avg((abs(d) <= 0.5)::INT), 6) AS share_within, round(avg(abs(d)), 6) AS mae, round(max(abs(d)), 6) AS max_abs,
  round(quantile_cont(abs(d), 0.5), 6) AS median_abs, round(quantile_cont(abs(d), 0.9), 6) AS p90_abs, round(quantile_cont(d, 0.5), 6) AS median_bias
FROM b GROUP BY block""")
def error_blocks(spark, sf):
    return rounded(audit.error_blocks(errors(spark, sf), "d", 0.5, "grp", F.col("high")))


@query("outside_tolerance", ERRORS_SQL + """
SELECT grp, CASE WHEN d > 0 THEN 'higher' ELSE 'lower' END AS direction, count(*) AS n, round(max(abs(d)), 6) AS worst
FROM e WHERE abs(d) > 0.5 GROUP BY 1, 2""")
def outside_tolerance(spark, sf):
    out = audit.outside_tolerance(errors(spark, sf), "d", 0.5)
    return rounded(out.groupBy("grp", "direction").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs("d")).alias("worst")
    ))


@query("largest_errors", ERRORS_SQL + " SELECT unit, grp, round(d, 6) AS d FROM e WHERE abs(d) > 0.5 ORDER BY abs(d) DESC, unit LIMIT 15")
def largest_errors(spark, sf):
    out = audit.outside_tolerance(errors(spark, sf), "d", 0.5)
    return rounded(audit.largest_errors(out, "d", "unit").select("unit", "grp", "d"))


@query("share_band", ERRORS_SQL + """
SELECT grp, round(avg((abs(d) <= 1.0)::INT), 6) AS share, CASE WHEN avg((abs(d) <= 1.0)::INT) >= 0.8 THEN 'at or above the bar'
  WHEN avg((abs(d) <= 1.0)::INT) >= 0.5 THEN 'partial' ELSE 'below' END AS band FROM e GROUP BY grp""")
def share_band(spark, sf):
    share = F.avg((F.abs("d") <= 1.0).cast("int"))
    return rounded(errors(spark, sf).groupBy("grp").agg(share.alias("share"), audit.share_band(share, 0.8).alias("band")))


@query("error_bounds", PAIRS + f""", {POISSON_DRAWS},
r AS (SELECT replicate, sum(times * abs(known - target) / 100000.0) / sum(times) AS mae,
        sum(times * (abs(known - target) / 100000.0 <= 0.5)::INT) / sum(times) AS within FROM pw GROUP BY replicate)
SELECT (SELECT count(*) FROM p) AS n_units, round((SELECT avg(abs(known - target) / 100000.0) FROM p), 6) AS mae,
  round((SELECT avg((abs(known - target) / 100000.0 <= 0.5)::INT) FROM p), 6) AS within,
  round(quantile_cont(mae, 0.025), 6) AS mae_lo, round(quantile_cont(mae, 0.975), 6) AS mae_hi, CAST(0 AS BIGINT) AS mae_undefined,
  round(quantile_cont(within, 0.025), 6) AS within_lo, round(quantile_cont(within, 0.975), 6) AS within_hi, CAST(0 AS BIGINT) AS within_undefined
FROM r""")
def error_bounds(spark, sf):
    """Mean absolute error and share within tolerance, both resampled in one pass."""
    return rounded(resample.bootstrap_means(
        errors(spark, sf), "unit",
        {"mae": F.abs("d"), "within": (F.abs("d") <= 0.5).cast("int")}, n_replicates=REPLICATES,
    ))


@query("findings", f"""WITH {M}, {U}, {T}, {A}, {P}
SELECT 'messages' AS item, (SELECT count(*) FROM m)::DOUBLE AS value UNION ALL
SELECT 'units', (SELECT count(*) FROM u) UNION ALL SELECT 'forecastable units', (SELECT count(*) FROM p) UNION ALL
SELECT 'high share', round((SELECT avg((target >= 450000)::INT) FROM p), 6) UNION ALL
SELECT 'late final share', round((SELECT avg((target_ttr <= 90)::INT) FROM p), 6)""")
def findings(spark, sf):
    df, frame = messages(spark, sf), pairs(spark, sf)
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("unit").alias("u"))
    shares = frame.agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("target") >= THRESHOLD).cast("int")).alias("high"),
        F.avg((F.col("target_ttr") <= RECENCY).cast("int")).alias("late"),
    )
    return rounded(audit.findings([
        ("messages", counts, F.col("n")), ("units", counts, F.col("u")),
        ("forecastable units", shares, F.col("n")), ("high share", shares, F.col("high")),
        ("late final share", shares, F.col("late")),
    ]))


# --- predictive distributions: every customer's last three known values are the samples -------

SAMPLES = PAIRS + """, k AS (SELECT unit, value AS yhat FROM (
    SELECT *, row_number() OVER (PARTITION BY unit ORDER BY ttr, tie DESC) AS r FROM m WHERE ttr >= 180) WHERE r <= 3),
s AS (SELECT k.*, p.target, p.split FROM k JOIN p USING (unit)),
mo AS (SELECT unit, avg(yhat) AS mean, stddev_samp(yhat) AS epi, count(*) AS n, any_value(target) AS target, any_value(split) AS split
       FROM s GROUP BY unit HAVING count(*) >= 2),
no AS (SELECT stddev_samp(target - mean) AS ale FROM mo WHERE split = 'train'),
di AS (SELECT mo.*, ale, sqrt(epi * epi + ale * ale) AS sd FROM mo, no WHERE split = 'test')"""
Z = {0.8: 1.2815515655446008, 0.9: 1.6448536269514722, 0.95: 1.959963984540054}
LEVEL_ROWS = ", ".join(f"({v}::DOUBLE, {z}::DOUBLE)" for v, z in Z.items())
GAUSS = f"""gi AS (SELECT *, mean - z * sd AS lo, mean + z * sd AS hi FROM di, (VALUES {LEVEL_ROWS}) l(level, z))"""


def sample_rows(spark, sf):
    """(unit, split, target, yhat): up to three samples per forecastable customer."""
    kept = series.last_k(series.admissible(messages(spark, sf), ORDERS, CUTOFF), ORDERS, 3)
    frame = pairs(spark, sf).select("unit", "target")
    return kept.select("unit", "split", F.col("value").alias("yhat")).join(frame, "unit")


def distribution(spark, sf):
    moments = models.sample_moments(
        sample_rows(spark, sf), "unit", carry=("target", "split")
    ).filter("n_samples >= 2")
    noise = models.aleatoric_sd(moments.filter("split = 'train'"), "target", "mean")
    return models.predictive(moments.filter("split = 'test'"), noise)


@query("sample_moments", SAMPLES + """
SELECT unit, round(mean, 4) AS mean, round(epi, 4) AS epistemic_sd, n AS n_samples, round(ale, 4) AS aleatoric_sd, round(sd, 4) AS sd FROM di""")
def sample_moments(spark, sf):
    return rounded(distribution(spark, sf).select(
        "unit", "mean", "epistemic_sd", "n_samples", "aleatoric_sd", "sd"), 4)


@query("aleatoric_sd", SAMPLES + """,
si AS (SELECT split, count(*) FILTER (WHERE n < 2) AS n_single
       FROM (SELECT unit, any_value(split) AS split, count(*) AS n FROM s GROUP BY unit) GROUP BY split)
SELECT split, round(stddev_samp(target - mean), 4) AS aleatoric_sd, count(*) AS n_residuals, any_value(n_single) AS n_single
FROM mo JOIN si USING (split) GROUP BY split""")
def aleatoric_sd(spark, sf):
    """Noise of the units with two samples or more; those with one are left out and counted."""
    moments = models.sample_moments(sample_rows(spark, sf), "unit", carry=("target", "split"))
    single = moments.groupBy("split").agg(F.count_if(F.col("n_samples") < 2).alias("n_single"))
    noise = models.aleatoric_sd(moments.filter("n_samples >= 2"), "target", "mean", ["split"])
    return rounded(noise.join(single, "split"), 4)


@query("gaussian_intervals", SAMPLES + f", {GAUSS} SELECT unit, level, round(lo, 4) AS lo, round(hi, 4) AS hi FROM gi")
def gaussian_intervals(spark, sf):
    out = models.gaussian_intervals(distribution(spark, sf), models.NOMINAL_LEVELS)
    return rounded(out.select("unit", "level", "lo", "hi"), 4)


@query("empirical_intervals", SAMPLES + f""",
q AS (SELECT unit, level, z, quantile_cont(yhat, (1 - level) / 2) AS a, quantile_cont(yhat, (1 + level) / 2) AS b
      FROM (SELECT s.unit, s.yhat, l.level, l.z FROM s JOIN di USING (unit), (VALUES {LEVEL_ROWS}) l(level, z)) GROUP BY unit, level, z)
SELECT unit, level, round(a - z * ale, 3) AS lo, round(b + z * ale, 3) AS hi FROM q, no""".replace("quantile_cont(yhat, (1 - level) / 2)", "CASE level WHEN 0.8 THEN quantile_cont(yhat, 0.1) WHEN 0.9 THEN quantile_cont(yhat, 0.05) ELSE quantile_cont(yhat, 0.025) END").replace("quantile_cont(yhat, (1 + level) / 2)", "CASE level WHEN 0.8 THEN quantile_cont(yhat, 0.9) WHEN 0.9 THEN quantile_cont(yhat, 0.95) ELSE quantile_cont(yhat, 0.975) END"))
def empirical_intervals(spark, sf):
    rows = sample_rows(spark, sf)
    moments = models.sample_moments(rows, "unit", carry=("target", "split")).filter("n_samples >= 2")
    noise = models.aleatoric_sd(moments.filter("split = 'train'"), "target", "mean")
    test = rows.join(moments.filter("split = 'test'").select("unit"), "unit", "left_semi")
    return rounded(models.empirical_intervals(test, "unit", noise, models.NOMINAL_LEVELS), 3)


@query("gaussian_pit", SAMPLES + f" SELECT unit, round({cdf_sql('((target - mean) / sd)')}::DOUBLE, 7) AS pit FROM di")
def gaussian_pit(spark, sf):
    return rounded(models.gaussian_pit(distribution(spark, sf), "target").select("unit", "pit"), 7)


@query("empirical_pit", SAMPLES + " SELECT unit, round(avg((yhat <= target)::INT), 6) AS pit FROM s GROUP BY unit")
def empirical_pit(spark, sf):
    return rounded(models.empirical_pit(sample_rows(spark, sf), "unit", "target"))


@query("pit_histogram", SAMPLES + f""", b AS (SELECT CAST(least(floor({cdf_sql('((target - mean) / sd)')} * 20) + 1, 20) AS INTEGER) AS bin FROM di)
SELECT bin, round((bin - 1) * 0.05, 6)::DOUBLE AS left_edge, count(*) AS n, round(count(*) / ((SELECT count(*) FROM b) * 0.05), 6)::DOUBLE AS density
FROM b GROUP BY bin""")
def pit_histogram(spark, sf):
    return rounded(audit.histogram(models.gaussian_pit(distribution(spark, sf), "target"), "pit", 0.0, 1.0, 20))


RELIABILITY = f"""rl AS (SELECT level, count(*) AS n, count(*) FILTER (WHERE target >= lo AND target <= hi) AS n_covered,
  avg((target >= lo AND target <= hi)::INT) AS coverage, avg(hi - lo) AS mean_width, quantile_cont(hi - lo, 0.5) AS median_width FROM gi GROUP BY level)"""


@query("reliability", SAMPLES + f""", {GAUSS}, {RELIABILITY}
SELECT level, n, n_covered, round(coverage, 6) AS coverage, round(mean_width, 3) AS mean_width, round(median_width, 3) AS median_width,
  round(100 * (coverage - level), 6) AS gap_pp, round({binomial_sql("n_covered", "n", "level")}::DOUBLE, 6) AS binomial_p FROM rl""")
def reliability(spark, sf):
    curve = models.reliability(
        models.gaussian_intervals(distribution(spark, sf), models.NOMINAL_LEVELS), "target"
    )
    return rounded(curve, 6, mean_width=3, median_width=3)


@query("coverage_objective", SAMPLES + f", {GAUSS}, {RELIABILITY} SELECT round(avg(abs(coverage - level)), 8) AS objective FROM rl")
def coverage_objective(spark, sf):
    curve = models.reliability(
        models.gaussian_intervals(distribution(spark, sf), models.NOMINAL_LEVELS), "target"
    )
    return rounded(models.coverage_objective(curve), 8)


# two "methods": the samples as they are, and with every sample disturbed per seed
AUDIT = PAIRS + f""", k AS (SELECT unit, value AS yhat FROM (
    SELECT *, row_number() OVER (PARTITION BY unit ORDER BY ttr, tie DESC) AS r FROM m WHERE ttr >= 180) WHERE r <= 3),
s AS (SELECT k.unit, p.target, p.split, seed, 'disturbed' AS method,
        yhat * (1.0 + ({sql_draw("seed || ':' || k.unit")} / 4294967296.0 - 0.5) * 0.2) AS yhat FROM k JOIN p USING (unit), (VALUES (42), (43)) v(seed)
      UNION ALL SELECT k.unit, p.target, p.split, -1, 'plain', yhat FROM k JOIN p USING (unit)),
mo AS (SELECT method, seed, unit, avg(yhat) AS mean, stddev_samp(yhat) AS epi, any_value(target) AS target, any_value(split) AS split
       FROM s GROUP BY method, seed, unit HAVING count(*) >= 2),
no AS (SELECT method, seed, stddev_samp(target - mean) AS ale FROM mo WHERE split = 'train' GROUP BY method, seed),
di AS (SELECT mo.*, ale, sqrt(epi * epi + ale * ale) AS sd FROM mo JOIN no USING (method, seed) WHERE split = 'test'),
gi AS (SELECT *, mean - z * sd AS lo, mean + z * sd AS hi FROM di, (VALUES {LEVEL_ROWS}) l(level, z)),
rl AS (SELECT method, seed, level, count(*) AS n, count(*) FILTER (WHERE target >= lo AND target <= hi) AS n_covered,
         avg((target >= lo AND target <= hi)::INT) AS coverage, avg(hi - lo) AS mean_width FROM gi GROUP BY method, seed, level),
pt AS (SELECT method, seed, {cdf_sql('((target - mean) / sd)')} AS v FROM di),
pr AS (SELECT *, row_number() OVER (PARTITION BY method, seed ORDER BY v) AS i, count(*) OVER (PARTITION BY method, seed) AS n FROM pt),
pk AS (SELECT method, seed, any_value(n) AS n, max(greatest(i / n - v, v - (i - 1) / n)) AS ks FROM pr GROUP BY method, seed),
bp AS (SELECT *, {binomial_sql("n_covered", "n", "level")}::DOUBLE AS binomial_p FROM rl)"""


def audited(spark, sf):
    def disturbed(seed):
        return F.col("yhat") * (1.0 + (draw_bits(F.lit(seed), F.col("unit")) / float(TWO_32) - 0.5) * 0.2)

    by = ["method", "seed"]
    variants = [({"method": "disturbed", "seed": seed}, disturbed(seed)) for seed in (42, 43)]
    variants.append(({"method": "plain", "seed": -1}, F.col("yhat")))
    moments = stage(models.moments_of_variants(
        sample_rows(spark, sf), "unit", variants, ("target", "split")
    ).filter("n_samples >= 2"))
    sd = models.aleatoric_sd(moments.filter("split = 'train'"), "target", "mean", by)
    return models.predictive(moments.filter("split = 'test'"), sd, by)


@query("coverage_audit", AUDIT + """
SELECT method, CAST(seed AS BIGINT) AS seed, level, n, n_covered, round(coverage, 6) AS coverage, round(mean_width, 3) AS mean_width,
  round(100 * (coverage - level), 6) AS gap_pp, round(binomial_p, 6) AS binomial_p FROM bp""")
def coverage_audit(spark, sf):
    curve, _ = models.coverage_audit(audited(spark, sf), "target")
    return longs(rounded(curve.drop("median_width"), 6, mean_width=3), "seed")


@query("audit_uniformity", AUDIT + f"""
SELECT method, CAST(seed AS BIGINT) AS seed, n, round(ks, 7) AS ks, round({kolmogorov_sql("sqrt(n) * ks")}::DOUBLE, 6) AS ks_p FROM pk""")
def audit_uniformity(spark, sf):
    _, pit = models.coverage_audit(audited(spark, sf), "target")
    return longs(rounded(pit, 7, ks_p=6), "seed")


@query("level_summary", AUDIT + """
SELECT method, level, round(avg(coverage), 6) AS coverage_mean, round(stddev_samp(coverage), 6) AS coverage_sd, round(avg(100 * (coverage - level)), 6) AS gap_pp,
  round(avg(mean_width), 3) AS mean_width, round(median(binomial_p), 6) AS median_p FROM bp GROUP BY method, level""")
def level_summary(spark, sf):
    curve, _ = models.coverage_audit(audited(spark, sf), "target")
    return rounded(audit.level_summary(curve), 6, mean_width=3)


@query("coverage_pivot", AUDIT + """
SELECT method, level, round(max(coverage) FILTER (WHERE seed = 42), 6) AS seed_42, round(max(coverage) FILTER (WHERE seed = 43), 6) AS seed_43
FROM rl GROUP BY method, level""")
def coverage_pivot(spark, sf):
    curve, _ = models.coverage_audit(audited(spark, sf), "target")
    return rounded(audit.by_seed(curve, [42, 43]))


@query("calibration_verdict", AUDIT + f""",
g AS (SELECT method, bool_and(abs(100 * (coverage - level)) <= 2) AS gaps_ok, avg(100 * (coverage - level)) AS gap FROM rl GROUP BY method),
ku AS (SELECT method, bool_and({kolmogorov_sql("sqrt(n) * ks")} > 0.05) AS uniform_ok FROM pk GROUP BY method)
SELECT method, gaps_ok, uniform_ok, round(gap, 6) AS mean_gap_pp, CASE WHEN gaps_ok AND uniform_ok THEN 'calibrated' WHEN gap < 0 THEN 'under-covering'
  ELSE 'miscalibrated' END AS verdict FROM g JOIN ku USING (method)""")
def calibration_verdict(spark, sf):
    curve, pit = models.coverage_audit(audited(spark, sf), "target")
    return rounded(audit.calibration_verdict(curve, pit))


@query("promoted_scores", SAMPLES + f""",
c AS (SELECT target, CASE WHEN mean >= 400000 THEN greatest(mean, 450000.001) ELSE 449999.999 END AS pred FROM di),
d AS (SELECT target, CASE WHEN pred < 450000 THEN 449999.999 ELSE pred END AS pred FROM c)
SELECT count(*) AS n_units, count(*) FILTER (WHERE target >= 450000 AND pred >= 450000) AS tp,
  count(*) FILTER (WHERE target < 450000 AND pred >= 450000) AS fp, count(*) FILTER (WHERE target >= 450000 AND pred < 450000) AS fn,
  round(avg((target - pred) * (target - pred)) FILTER (WHERE target >= 450000), 2) AS mse_high FROM d""")
def promoted_scores(spark, sf):
    out = models.promoted_scores(
        distribution(spark, sf), "unit", "target", 400000.0, THRESHOLD, MARGIN, EPSILON, n_replicates=40
    )
    return longs(rounded(out.select("n_units", "tp", "fp", "fn", "mse_high"), 2), "tp", "fp", "fn")


@query("pinball_loss", PAIRS + """,
k AS (SELECT unit, min(value) AS lo, avg(value) AS mid, max(value) AS hi FROM (
    SELECT *, row_number() OVER (PARTITION BY unit ORDER BY ttr, tie DESC) AS r FROM m WHERE ttr >= 180) WHERE r <= 3 GROUP BY unit),
l AS (SELECT split, q, target - f AS g FROM (SELECT split, target, 0.1 AS q, lo AS f FROM p JOIN k USING (unit) UNION ALL
  SELECT split, target, 0.5, mid FROM p JOIN k USING (unit) UNION ALL SELECT split, target, 0.9, hi FROM p JOIN k USING (unit)))
SELECT split, q::DOUBLE AS quantile, round(avg(greatest(q * g, (q - 1) * g)), 4)::DOUBLE AS pinball FROM l GROUP BY split, q""")
def pinball_loss(spark, sf):
    return rounded(models.pinball_loss(range_forecasts(spark, sf), "target", {0.1: "lo", 0.5: "mid", 0.9: "hi"}, ["split"]), 4)


def range_forecasts(spark, sf):
    return sample_rows(spark, sf).groupBy("unit").agg(
        F.first("split").alias("split"), F.first("target").alias("target"), F.min("yhat").alias("lo"),
        F.avg("yhat").alias("mid"), F.max("yhat").alias("hi"),
    )


@query("crossing_rate", """SELECT event_type, round(avg((b < a OR c < b)::INT), 6) AS crossing_rate FROM (
  SELECT event_type, value AS a, value + 20 - user_id % 23 AS b, value + 15 - user_id % 11 AS c FROM events) GROUP BY event_type""")
def crossing_rate(spark, sf):
    df = table(spark, sf, "events").select(
        "event_type", F.col("value").alias("a"), (F.col("value") + 20 - F.col("user_id") % 23).alias("b"),
        (F.col("value") + 15 - F.col("user_id") % 11).alias("c"),
    )
    return rounded(models.crossing_rate(df, ["a", "b", "c"], ["event_type"]))
