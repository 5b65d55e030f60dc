"""Intervals, weights and coverage on the order series."""

from __future__ import annotations

from pyspark.sql import functions as F

from unitcal.functions import draw_bits
from unitcal.functions.columns import TWO_32
from unitcal.functions.exact import binomial_p
from unitcal.operators import audit, conformal, discriminant, resample, weights
from unitcal.plans.registry import longs, query, round_scaled, rounded
from unitcal.plans.score_queries import POISSON_CASE, REPLICATES, shares_sql
from unitcal.plans.series_queries import SPLIT_SQL, training_split
from unitcal.plans.tables import (
    LEVELS, PAIRS, RECENCY, THRESHOLD, pairs, sql_draw, table,
)
from unitcal.session import stage

SEEDS = (42, 43)
KEYS = ["learner", "seed", "sided", "level"]

PREDS_SQL = f"""{SPLIT_SQL},
ps AS (SELECT p.unit, p.split, s.subset, p.target, p.target_ttr, p.known, v.seed
       FROM p LEFT JOIN s USING (unit), (VALUES (42), (43)) v(seed)),
preds AS (
  SELECT *, 'persistence' AS learner, known AS pred FROM ps UNION ALL
  SELECT *, 'noisy', known * (1.0 + ({sql_draw("seed || ':' || unit")} / 4294967296.0 - 0.5) * 0.2) FROM ps),
sides AS (SELECT * FROM (VALUES ('two'), ('upper')) v(sided)),
lv AS (SELECT level::DOUBLE AS level FROM (VALUES (0.9), (0.8), (0.95)) v(level)),
prev AS (SELECT avg(CASE WHEN target >= 450000 THEN 1 ELSE 0 END) FILTER (WHERE split = 'test') AS pt,
                avg(CASE WHEN target >= 450000 THEN 1 ELSE 0 END) FILTER (WHERE split = 'train') AS pr FROM p),
rule AS (SELECT unit, (CASE WHEN target_ttr <= 90 THEN 1.0 ELSE 0.0 END)::DOUBLE *
                CASE WHEN known >= 450000 THEN pt / pr ELSE (1 - pt) / (1 - pr) END AS w
         FROM p JOIN s USING (unit), prev WHERE subset = 'calibration'),
rule_test AS (SELECT pt * pt / pr + (1 - pt) * (1 - pt) / (1 - pr) AS test_weight FROM prev),
odds AS (SELECT unit, pp / (1 - pp) AS w FROM (
           SELECT unit, greatest(least(known / 500001.0, 1 - 1e-6), 1e-6) AS pp
           FROM p JOIN s USING (unit) WHERE subset = 'calibration')),
odds_test AS (SELECT avg(w) AS test_weight FROM odds),
scores AS (SELECT unit, learner, seed, sided,
             CASE WHEN sided = 'two' THEN abs(target - pred) ELSE target - pred END AS score
           FROM preds, sides WHERE subset = 'calibration')"""


def quantile_sql(name: str, source: str, weight: str, test_weight: str, shift: str = "0.0") -> str:
    """Weighted conformal quantile per (learner, seed, sided, level) as CTEs ending in ``name``."""
    return f"""{name}_g AS (SELECT learner, seed, sided, score, sum({weight}) AS w, count(*) AS n
    FROM {source} GROUP BY ALL),
{name}_c AS (SELECT *, sum(w) OVER (PARTITION BY learner, seed, sided ORDER BY score) AS cum,
    sum(w) OVER (PARTITION BY learner, seed, sided) AS tot, sum(n) OVER (PARTITION BY learner, seed, sided) AS nn
    FROM {name}_g),
{name} AS (SELECT learner, seed, sided, level, any_value(alpha) AS alpha, CAST(any_value(nn) AS BIGINT) AS n_cal,
    CASE WHEN any_value({test_weight} / (tot + {test_weight})) > any_value(alpha) + 1e-12 THEN 'infinity'::DOUBLE
         ELSE coalesce(min(score) FILTER (WHERE cum / (tot + {test_weight}) >= 1 - alpha - 1e-12), max(score)) END AS q
    FROM (SELECT *, CASE WHEN {shift} > 0 THEN greatest(1 - level - {shift}, 1e-6) ELSE 1 - level END AS alpha
          FROM {name}_c, lv) GROUP BY learner, seed, sided, level)"""


PLAIN = quantile_sql("qp", "scores", "1.0", "1.0")
RULE_Q = quantile_sql("qr", "(SELECT scores.*, w FROM scores JOIN rule USING (unit))", "w",
                      "(SELECT test_weight FROM rule_test)")
ODDS_Q = quantile_sql("qo", "(SELECT scores.*, w FROM scores JOIN odds USING (unit))", "w",
                      "(SELECT test_weight FROM odds_test)")


def intervals_sql(rows: str, q: str, method: str) -> str:
    return f"""SELECT unit, learner, seed, sided, level, '{method}' AS method, target, q,
  CASE WHEN sided = 'two' THEN pred - q ELSE '-infinity'::DOUBLE END AS lo, pred + q AS hi
  FROM (SELECT * FROM preds WHERE {rows}) JOIN {q} USING (learner, seed)"""


SWEEP = f"""{PREDS_SQL}, {PLAIN}, {RULE_Q}, {ODDS_Q},
iv AS ({intervals_sql("subset = 'self_test'", "qp", "selftest")} UNION ALL
  {intervals_sql("split = 'test'", "qp", "naive")} UNION ALL
  {intervals_sql("split = 'test' AND target_ttr <= 90", "qr", "weighted_rule")} UNION ALL
  {intervals_sql("split = 'test' AND target_ttr <= 90", "qo", "weighted_classifier")}),
ic AS (SELECT *, hi - lo AS width, target >= lo AND target <= hi AS covered FROM iv),
cov AS (SELECT learner, method, sided, level, seed, count(*) AS n, count(*) FILTER (WHERE covered) AS n_covered,
          avg(covered::INT) AS coverage, avg(CASE WHEN isinf(width) THEN 1 ELSE 0 END) AS share_infinite,
          coalesce(quantile_cont(width, 0.5) FILTER (WHERE NOT isinf(width)), 'infinity'::DOUBLE) AS median_width
        FROM ic GROUP BY ALL)"""


def bounds_sql(source: str) -> str:
    """Exact binomial bounds of every distinct (k, n) of ``source`` by bisection, as CTE ``cp``."""
    tail = (
        "list_sum(list_transform(range({lo}, {hi}), lambda i: exp(lgamma(n + 1) - lgamma(i + 1)"
        " - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))))"
    )
    upper = tail.format(lo="k", hi="n + 1", p="m1")
    lower = tail.format(lo="0", hi="k + 1", p="m2")
    return f"""bis AS (
  SELECT k, n, 0 AS it, 0.0::DOUBLE AS lo1, 1.0::DOUBLE AS hi1, 0.0::DOUBLE AS lo2, 1.0::DOUBLE AS hi2
  FROM (SELECT DISTINCT k, n FROM {source})
  UNION ALL
  SELECT k, n, it + 1, CASE WHEN up < 0.025 THEN m1 ELSE lo1 END, CASE WHEN up < 0.025 THEN hi1 ELSE m1 END,
         CASE WHEN down > 0.025 THEN m2 ELSE lo2 END, CASE WHEN down > 0.025 THEN hi2 ELSE m2 END
  FROM (SELECT *, {upper} AS up, {lower} AS down
        FROM (SELECT *, (lo1 + hi1) / 2 AS m1, (lo2 + hi2) / 2 AS m2 FROM bis WHERE it < 45))),
cp AS (SELECT k, n, CASE WHEN k = 0 THEN 0.0 ELSE lo1 END::DOUBLE AS cp_lo,
              CASE WHEN k = n THEN 1.0 ELSE hi2 END::DOUBLE AS cp_hi FROM bis WHERE it = 45)"""


def tagged_pairs(spark, sf):
    """Forecastable customers with split and training subset, written once per query."""
    frame = pairs(spark, sf).select("unit", "split", "target", "target_ttr", "known")
    return stage(frame.join(training_split(spark, sf), "unit", "left"))


def with_learners(frame):
    """Two learners and two seeds per row."""
    spread = frame.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
    noise = (draw_bits(F.col("seed"), F.col("unit")) / float(TWO_32) - 0.5) * 0.2
    learners = F.array(
        F.struct(F.lit("persistence").alias("learner"), F.col("known").alias("pred")),
        F.struct(F.lit("noisy").alias("learner"), (F.col("known") * (1.0 + noise)).alias("pred")),
    )
    return spread.withColumn("_l", F.explode(learners)).select("*", "_l.*").drop("_l")


def predictions(spark, sf):
    """Long prediction table of all customers."""
    return with_learners(tagged_pairs(spark, sf))


def calibration_units(spark, sf):
    frame = tagged_pairs(spark, sf)
    return frame, frame.filter("subset = 'calibration'")


def rule_weights_of(frame, cal):
    prev = weights.prevalences(
        frame, "target", THRESHOLD, F.col("split") == "test", F.col("split") == "train"
    )
    return weights.rule_weights(cal, prev, F.col("target_ttr") <= RECENCY, F.col("known"), THRESHOLD)


def odds_weights_of(cal):
    return weights.odds_weights(cal.withColumn("p", F.col("known") / 500001.0), "p")


def sweep_intervals(spark, sf):
    frame, cal = calibration_units(spark, sf)
    weighted, rule_test = rule_weights_of(frame, cal)
    weighted, odds_test = odds_weights_of(weighted.withColumnRenamed("w", "w_rule"))
    carried = ["unit", "learner", "seed", "target", "target_ttr", "pred"]
    return conformal.sweep(
        with_learners(weighted.withColumnRenamed("w", "w_odds")),
        {
            "selftest": with_learners(frame.filter("subset = 'self_test'")).select(*carried),
            "naive": with_learners(frame.filter("split = 'test'")).select(*carried),
        },
        LEVELS,
        {
            "rule": conformal.Weighting("w_rule", rule_test),
            "classifier": conformal.Weighting("w_odds", odds_test),
        },
        F.col("target_ttr") <= RECENCY,
    )


def coverage_rows(spark, sf):
    return conformal.coverage_table(
        sweep_intervals(spark, sf), ["learner", "method", "sided", "level", "seed"]
    )


@query("conformal_quantile", PAIRS + f", {PREDS_SQL}, {PLAIN}" + """
SELECT learner, CAST(seed AS BIGINT) AS seed, sided, level, round(alpha, 6) AS alpha, round(q, 4) AS q, n_cal FROM qp""")
def conformal_quantile(spark, sf):
    cal = predictions(spark, sf).filter("subset = 'calibration'")
    q = conformal.conformal_quantile(
        conformal.score_table(cal, "target", "pred"), LEVELS, ["learner", "seed", "sided"]
    )
    return longs(rounded(q, 6, q=4), "seed", "n_cal")


@query("order_statistic_quantile", PAIRS + f", {PREDS_SQL}" + """,
r AS (SELECT *, row_number() OVER (PARTITION BY learner, seed, sided ORDER BY score) AS rn,
             count(*) OVER (PARTITION BY learner, seed, sided) AS n FROM scores)
SELECT g.learner, CAST(g.seed AS BIGINT) AS seed, g.sided, level, round(coalesce(score, 'infinity'::DOUBLE), 4) AS q
FROM (SELECT DISTINCT learner, seed, sided, n, level FROM r, lv) g LEFT JOIN r
  ON r.learner = g.learner AND r.seed = g.seed AND r.sided = g.sided AND rn = ceil((g.n + 1) * level - 1e-9)""")
def order_statistic_quantile(spark, sf):
    """The uniform special case as an order statistic; must agree with the weighted form."""
    cal = predictions(spark, sf).filter("subset = 'calibration'")
    q = conformal.order_statistic_quantile(
        conformal.score_table(cal, "target", "pred"), LEVELS, ["learner", "seed", "sided"]
    )
    return longs(rounded(q, 6, q=4), "seed")


@query("weighted_quantile", f"""
WITH g AS (SELECT event_type, value AS score, sum(1.0 + user_id % 7) AS w, count(*) AS n FROM events GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY event_type ORDER BY score) AS cum,
        sum(w) OVER (PARTITION BY event_type) AS tot, sum(n) OVER (PARTITION BY event_type) AS nn FROM g),
lv AS (SELECT level::DOUBLE AS level FROM (VALUES (0.5), (0.9), (0.999)) v(level))
SELECT event_type, level, round(1 - level, 6) AS alpha, CAST(any_value(nn) AS BIGINT) AS n_cal,
  round(CASE WHEN any_value(tot / nn / (tot + tot / nn)) > 1 - level + 1e-12 THEN 'infinity'::DOUBLE
       ELSE coalesce(min(score) FILTER (WHERE cum / (tot + tot / nn) >= level - 1e-12), max(score)) END, 6) AS q
FROM c, lv GROUP BY event_type, level""")
def weighted_quantile(spark, sf):
    """Weighted quantile of event values with the mean weight at infinity."""
    events = table(spark, sf, "events").select(
        "event_type", "value", (1.0 + F.col("user_id") % 7).alias("w")
    )
    q = conformal.conformal_quantile(
        events, (0.5, 0.9, 0.999), ["event_type"], score="value", weight="w"
    )
    return longs(rounded(q), "n_cal")


@query("split_interval", PAIRS + f", {PREDS_SQL}, {PLAIN}, iv AS ({intervals_sql(chr(34) + 'split' + chr(34) + ' = ' + chr(39) + 'test' + chr(39), 'qp', 'naive')})" + """
SELECT unit, learner, CAST(seed AS BIGINT) AS seed, sided, level, round(lo, 4) AS lo, round(hi, 4) AS hi,
       target >= lo AND target <= hi AS covered
FROM iv""")
def split_interval(spark, sf):
    preds = predictions(spark, sf)
    q = conformal.conformal_quantile(
        conformal.score_table(preds.filter("subset = 'calibration'"), "target", "pred"),
        LEVELS, ["learner", "seed", "sided"],
    )
    out = conformal.attach_intervals(
        preds.filter("split = 'test'"), stage(q), ["learner", "seed"], "pred", "target"
    )
    return longs(out.select(
        "unit", "learner", "seed", "sided", "level",
        round_scaled(F.col("lo"), 4).alias("lo"), round_scaled(F.col("hi"), 4).alias("hi"), "covered",
    ), "seed")


@query("empirical_coverage", PAIRS + f", {SWEEP}" + """
SELECT method, sided, level, count(*) AS n, round(avg(covered::INT), 6) AS coverage, CAST(0 AS BIGINT) AS n_reversed
FROM ic GROUP BY method, sided, level""")
def empirical_coverage(spark, sf):
    return rounded(conformal.empirical_coverage(
        sweep_intervals(spark, sf), "target", "lo", "hi", ["method", "sided", "level"]
    ))


@query("coverage_sweep", PAIRS + f", {SWEEP}, kn AS (SELECT n_covered AS k, n FROM cov), {bounds_sql('kn')}" + """
SELECT learner, method, sided, level, CAST(seed AS BIGINT) AS seed, cov.n, n_covered, round(coverage, 6) AS coverage,
  round(share_infinite, 6) AS share_infinite, round(median_width, 3) AS median_width,
  round(cp_lo, 6) AS cp_lo, round(cp_hi, 6) AS cp_hi
FROM cov JOIN cp ON cp.k = cov.n_covered AND cp.n = cov.n""")
def coverage_sweep(spark, sf):
    return longs(rounded(coverage_rows(spark, sf), 6, median_width=3), "seed")


@query("coverage_by_seed", PAIRS + f", {SWEEP}, kn AS (SELECT n_covered AS k, n FROM cov), {bounds_sql('kn')}" + """
SELECT learner, method, sided, level, round(avg(coverage), 6) AS coverage_mean, round(stddev_samp(coverage), 6) AS coverage_sd,
  arg_min(cov.n, seed) AS n, round(avg(median_width), 3) AS median_width_mean, round(avg(cp_lo), 6) AS cp_lo_mean,
  round(avg(cp_hi), 6) AS cp_hi_mean, round(avg(share_infinite), 6) AS share_infinite, count(DISTINCT seed) AS n_seeds,
  round(100 * (avg(coverage) - level), 6) AS gap_pp
FROM cov JOIN cp ON cp.k = cov.n_covered AND cp.n = cov.n GROUP BY learner, method, sided, level""")
def coverage_by_seed(spark, sf):
    return rounded(conformal.aggregate_coverage(coverage_rows(spark, sf)), 6, median_width_mean=3)


@query("naive_weighted_contrast", PAIRS + f", {SWEEP}" + """
SELECT learner, round(a, 6) AS naive_coverage, round(b, 6) AS weighted_coverage, round(100 * (b - a), 6) AS gap_closed_pp,
  round(100 * (a - 0.9), 6) AS naive_gap_pp, round(100 * (b - 0.9), 6) AS weighted_gap_pp
FROM (SELECT learner, avg(coverage) FILTER (WHERE method = 'naive') AS a,
        avg(coverage) FILTER (WHERE method = 'weighted_rule') AS b
      FROM cov WHERE abs(level - 0.9) < 1e-9 AND sided = 'two' GROUP BY learner)""")
def naive_weighted_contrast(spark, sf):
    rows = conformal.coverage_table(
        sweep_intervals(spark, sf), ["learner", "method", "sided", "level", "seed"], bounds=False
    )
    return rounded(conformal.naive_weighted_contrast(rows, 0.9))


PAIRED_SQL = """pw AS (SELECT learner, level, unit, bool_or(covered) FILTER (WHERE method = 'naive') AS a,
    bool_or(covered) FILTER (WHERE method = 'weighted_rule') AS b
  FROM ic WHERE seed = 42 AND sided = 'two' GROUP BY learner, level, unit),
pc AS (SELECT learner, level, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS only_first,
    count(*) FILTER (WHERE NOT a AND b) AS only_second, count(*) FILTER (WHERE NOT a AND NOT b) AS neither
  FROM pw WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY learner, level)"""


def paired(spark, sf):
    return conformal.paired_coverage(
        sweep_intervals(spark, sf).filter("seed = 42 AND sided = 'two'"), "unit"
    )


@query("paired_coverage", PAIRS + f", {SWEEP}, {PAIRED_SQL} SELECT * FROM pc")
def paired_coverage(spark, sf):
    return paired(spark, sf)


def binomial_sql(k: str, n: str, p: str) -> str:
    """Two-sided exact binomial p-value as a scalar expression over list functions."""
    pmf = f"exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}))"
    at = pmf.replace("lgamma(i + 1)", f"lgamma({k} + 1)").replace(f"lgamma({n} - i + 1)", f"lgamma({n} - {k} + 1)").replace("i * ln", f"{k} * ln").replace(f"({n} - i)", f"({n} - {k})")
    return f"least(1.0, list_sum(list_transform(range(0, {n} + 1), lambda i: CASE WHEN {pmf} <= {at} * (1 + 1e-7) THEN {pmf} ELSE 0.0 END)))"


@query("mcnemar", PAIRS + f", {SWEEP}, {PAIRED_SQL} SELECT *, round(CASE WHEN only_first + only_second = 0 THEN 1.0 ELSE "
       + binomial_sql("least(only_first, only_second)", "(only_first + only_second)", "0.5")
       + " END::DOUBLE, 8) AS p_value FROM pc")
def mcnemar(spark, sf):
    return rounded(conformal.mcnemar(paired(spark, sf)), 8)


@query("largest_gap", PAIRS + f", {SWEEP}" + """,
r AS (SELECT learner, method, sided, level, 100 * (avg(coverage) - level) AS gap FROM cov GROUP BY learner, method, sided, level)
SELECT method, round(max(abs(gap)), 6) AS gap_pp FROM r GROUP BY method""")
def largest_gap(spark, sf):
    rows = conformal.aggregate_coverage(coverage_rows(spark, sf))
    return rounded(conformal.largest_gap(rows).select("method", F.abs("gap_pp").alias("gap_pp")))


@query("method_pivot", PAIRS + f", {SWEEP}" + """
SELECT learner, sided, level, round(avg(coverage) FILTER (WHERE method = 'selftest'), 6) AS selftest,
  round(avg(coverage) FILTER (WHERE method = 'naive'), 6) AS naive,
  round(avg(coverage) FILTER (WHERE method = 'weighted_rule'), 6) AS weighted_rule
FROM cov GROUP BY learner, sided, level""")
def method_pivot(spark, sf):
    rows = conformal.aggregate_coverage(coverage_rows(spark, sf))
    return rounded(conformal.method_pivot(rows, ["selftest", "naive", "weighted_rule"]))


@query("coverage_with_bounds", PAIRS + f", {SWEEP}, kn AS (SELECT n_covered AS k, n FROM cov), {bounds_sql('kn')}, {shares_sql('kn')}" + """
SELECT learner, method, sided, level, CAST(seed AS BIGINT) AS seed, cov.n, n_covered, round(coverage, 6) AS coverage,
  round(median_width, 3) AS median_width, round(share_infinite, 6) AS share_infinite,
  round(cp_lo, 6) AS cp_lo, round(cp_hi, 6) AS cp_hi, round(lo, 6) AS boot_lo, round(hi, 6) AS boot_hi
FROM cov JOIN cp ON cp.k = cov.n_covered AND cp.n = cov.n JOIN sb ON sb.k = cov.n_covered AND sb.n = cov.n""")
def coverage_with_bounds(spark, sf):
    """Both kinds of bounds on every cell of the sweep."""
    out = conformal.coverage_with_bounds(
        sweep_intervals(spark, sf), ["learner", "method", "sided", "level", "seed"], n_replicates=REPLICATES
    )
    return longs(rounded(out, 6, median_width=3), "seed")


# --- weights -------------------------------------------------------------------------------

W = PAIRS + f", {PREDS_SQL}"


@query("rule_weights", W + """
SELECT unit, round(w, 8) AS w, w > 0 AS supported, round(test_weight, 8) AS test_weight FROM rule, rule_test""")
def rule_weights(spark, sf):
    weighted, test_weight = rule_weights_of(*calibration_units(spark, sf))
    return rounded(weighted.select("unit", "w", "supported", test_weight.scalar().alias("test_weight")), 8)


@query("odds_weights", W + " SELECT unit, round(w, 8) AS w, round(test_weight, 8) AS test_weight FROM odds, odds_test")
def odds_weights(spark, sf):
    weighted, test_weight = odds_weights_of(calibration_units(spark, sf)[1])
    return rounded(weighted.select("unit", "w", test_weight.scalar().alias("test_weight")), 8)


BOTH_SQL = """both_w AS (SELECT unit, 'rule' AS method, w FROM rule UNION ALL SELECT unit, 'classifier', w FROM odds)"""


def both_weights(spark, sf):
    frame, cal = calibration_units(spark, sf)
    rule, _ = rule_weights_of(frame, cal)
    odds, _ = odds_weights_of(cal)
    kept = ["unit", "known", "target_ttr", "w"]
    return rule.select(*kept, F.lit("rule").alias("method")).unionByName(
        odds.select(*kept, F.lit("classifier").alias("method"))
    )


@query("normalised_weights", W + " SELECT unit, round(w / (SELECT sum(w) FROM rule), 10) AS w_norm FROM rule")
def normalised_weights(spark, sf):
    weighted, _ = rule_weights_of(*calibration_units(spark, sf))
    return rounded(weights.normalised(weighted).select("unit", "w_norm"), 10)


@query("effective_size", W + f", {BOTH_SQL}" + """
SELECT method, count(*) AS n, round(sum(w) * sum(w) / sum(w * w), 4) AS n_eff,
       round(count(*) / (sum(w) * sum(w) / sum(w * w)), 6) AS n_over_neff FROM both_w GROUP BY method""")
def effective_size(spark, sf):
    return rounded(weights.effective_size(both_weights(spark, sf), ["method"]), 6, n_eff=4)


@query("weight_summary", W + f", {BOTH_SQL}" + """
SELECT method, count(*) AS n, count(*) FILTER (WHERE w > 0) AS n_positive, round(min(w), 6) AS min, round(max(w), 6) AS max,
  round(avg(w), 6) AS mean, round(max(w) / sum(w), 8) AS max_share, round(quantile_cont(w, 0.25), 6) AS q25,
  round(quantile_cont(w, 0.5), 6) AS median, round(quantile_cont(w, 0.75), 6) AS q75 FROM both_w GROUP BY method""")
def weight_summary(spark, sf):
    out = weights.weight_summary(both_weights(spark, sf), ["method"])
    return rounded(out, 6, max_share=8)


@query("balance", W + f", {BOTH_SQL}" + """,
x AS (SELECT method, w, p.known, p.target_ttr FROM both_w JOIN p USING (unit)),
l AS (SELECT method, w, 'known' AS covariate, known AS v FROM x UNION ALL SELECT method, w, 'target_ttr', target_ttr FROM x)
SELECT method, covariate, round(abs(sum(w * v) / sum(w) - avg(v)) / stddev_samp(v), 6) AS asmd FROM l GROUP BY method, covariate""")
def balance(spark, sf):
    return rounded(weights.balance(both_weights(spark, sf), ["known", "target_ttr"], ["method"]))


@query("gamma_divergence", W + """,
j AS (SELECT rule.w AS a, odds.w AS b FROM rule JOIN odds USING (unit) WHERE rule.w > 0),
n AS (SELECT a / (SELECT avg(a) FROM j) AS a, b / (SELECT avg(b) FROM j) AS b FROM j)
SELECT round(max(greatest(a / b, b / a)), 4) AS gamma, count(*) AS n_compared FROM n""")
def gamma_divergence(spark, sf):
    frame, cal = calibration_units(spark, sf)
    rule, _ = rule_weights_of(frame, cal)
    odds, _ = odds_weights_of(cal)
    joined = rule.select("unit", F.col("w").alias("rule")).join(odds.select("unit", F.col("w").alias("odds")), "unit")
    return rounded(weights.gamma_divergence(joined, "rule", "odds"), 4)


@query("positivity", W + """
SELECT count(*) AS n_total, count(*) FILTER (WHERE target_ttr <= 90) AS n_supported,
  count(*) FILTER (WHERE target_ttr > 90) AS n_unsupported,
  count(*) FILTER (WHERE target_ttr > 90 AND target >= 450000) AS unsupported_high
FROM p WHERE split = 'test'""")
def positivity(spark, sf):
    test = pairs(spark, sf).filter("split = 'test'")
    return weights.positivity(test, F.col("target_ttr") <= RECENCY, F.col("target") >= THRESHOLD)


@query("zero_weights", W + f", {BOTH_SQL}" + """
SELECT method, round(avg(CASE WHEN w = 0 THEN 1 ELSE 0 END), 6) AS zero_share FROM both_w GROUP BY method""")
def zero_weights(spark, sf):
    return rounded(weights.zero_share(both_weights(spark, sf), ["method"]))


@query("weight_histogram", W + """,
b AS (SELECT CAST(CASE WHEN w < 0 THEN 0 WHEN w > 10 THEN 21 ELSE least(floor(w / 0.5) + 1, 20) END AS INTEGER) AS bin FROM odds WHERE w IS NOT NULL)
SELECT bin, CASE WHEN bin > 0 THEN ((bin - 1) * 0.5)::DOUBLE END AS left_edge, count(*) AS n,
       CASE WHEN bin BETWEEN 1 AND 20 THEN round(count(*) / ((SELECT count(*) FROM b) * 0.5), 6) END AS density
FROM b GROUP BY bin""")
def weight_histogram(spark, sf):
    odds, _ = odds_weights_of(calibration_units(spark, sf)[1])
    return rounded(audit.histogram(odds, "w", 0.0, 10.0, 20))


@query("weight_histogram_log", W + """,
b AS (SELECT CAST(CASE WHEN w <= 0 THEN 0 WHEN log10(w) < -2 THEN 0 WHEN log10(w) > 2 THEN 17
                  ELSE least(floor((log10(w) + 2.0) / 0.25) + 1, 16) END AS INTEGER) AS bin FROM odds WHERE w IS NOT NULL)
SELECT bin, CASE WHEN bin > 0 THEN (-2.0 + (bin - 1) * 0.25)::DOUBLE END AS left_edge, count(*) AS n,
       CASE WHEN bin BETWEEN 1 AND 16 THEN round(count(*) / ((SELECT count(*) FROM b) * 0.25), 6) END AS density FROM b GROUP BY bin""")
def weight_histogram_log(spark, sf):
    odds, _ = odds_weights_of(calibration_units(spark, sf)[1])
    logs = odds.withColumn("log_w", F.when(F.col("w") > 0, F.log10("w")).when(F.col("w") <= 0, float("-inf")))
    return rounded(audit.histogram(logs, "log_w", -2.0, 2.0, 16))


def khat_sql(name: str, source: str) -> str:
    """Tail index of column ``w`` of ``source`` by the same grid, ending in CTE ``name``."""
    grid = ", ".join(repr(t) for t in sorted(weights.GRID_NEGATIVE + weights.GRID_POSITIVE))

    def best(tag: str, thetas: str) -> str:
        return f"""{name}_s{tag} AS (SELECT t, avg(ln(1 + t * u)) AS shape FROM {name}_u, ({thetas}) WHERE t > -1 AND t <> 0 GROUP BY t),
{name}_b{tag} AS (SELECT t, shape FROM {name}_s{tag} ORDER BY -ln(shape / t) - shape DESC, t DESC LIMIT 1)"""

    def around(tag: str, reach: float) -> str:
        d = ", ".join(repr(reach * i / weights.REFINE_STEPS) for i in range(-weights.REFINE_STEPS, weights.REFINE_STEPS + 1))
        return f"SELECT CASE WHEN t > 0 THEN t * pow(10.0, d) ELSE -(1.0 - (1.0 + t) * pow(10.0, d)) END AS t FROM {name}_b{tag}, (SELECT unnest([{d}]) AS d)"

    refined = ", ".join(best(str(i + 1), around(str(i), r)) for i, r in enumerate(weights.REFINEMENTS))
    return f"""{name}_r AS (SELECT w, row_number() OVER (ORDER BY w) AS rn, count(*) OVER () AS n FROM {source} WHERE w > 0),
{name}_k AS (SELECT *, least(greatest(20, ceil(0.2 * n)), n - 1) AS n_tail FROM {name}_r),
{name}_x AS (SELECT w - (SELECT max(w) FROM {name}_k WHERE rn = n - n_tail) AS x FROM {name}_k WHERE rn > n - n_tail),
{name}_u AS (SELECT x / (SELECT max(x) FROM {name}_x) AS u FROM {name}_x WHERE x > 0),
{best("0", f"SELECT unnest([{grid}]) AS t")}, {refined},
{name} AS (SELECT (SELECT count(*) FROM {name}_r) AS n_positive,
   CASE WHEN (SELECT count(*) FROM {name}_r) < 40 THEN 'nan'::DOUBLE
        WHEN (SELECT max(x) FROM {name}_x) <= 1e-8 THEN '-infinity'::DOUBLE
        WHEN (SELECT count(*) FROM {name}_u) < 20 THEN 'nan'::DOUBLE
        WHEN (SELECT count(DISTINCT u) FROM {name}_u) <= 1 THEN '-infinity'::DOUBLE
        ELSE (SELECT shape FROM {name}_b{len(weights.REFINEMENTS)}) END AS khat)"""


BAND_SQL = """CASE WHEN isnan(khat) THEN 'undiagnosable' WHEN khat < 0.5 THEN 'stable' WHEN khat < 0.7 THEN 'flagged'
  WHEN khat <= 1.0 THEN 'clip' ELSE 'invalid' END"""


@query("pareto_khat", W + f", {khat_sql('ko', 'odds')}, {khat_sql('kr', 'rule')}," + f"""
k AS (SELECT 'classifier' AS method, * FROM ko UNION ALL SELECT 'rule', * FROM kr)
SELECT method, n_positive, round(khat, 4) AS khat, {BAND_SQL} AS band FROM k""")
def pareto_khat(spark, sf):
    return rounded(longs(weights.pareto_khat(both_weights(spark, sf), ["method"]), "n_positive"), 4)


@query("price_tail", """WITH src AS (SELECT l_extendedprice * l_extendedprice AS w FROM lineitem),
""" + khat_sql("k", "src") + f" SELECT n_positive, round(khat, 4) AS khat, {BAND_SQL} AS band FROM k")
def price_tail(spark, sf):
    """Tail index over all order lines."""
    lines = table(spark, sf, "lineitem").select((F.col("l_extendedprice") * F.col("l_extendedprice")).alias("w"))
    return rounded(longs(weights.pareto_khat(lines), "n_positive"), 4)


CLIP_SQL = f"""{khat_sql("kb", "odds")},
cl AS (SELECT khat > 0.7 AND NOT isnan(khat) AS clipped, CASE WHEN khat > 0.7 AND NOT isnan(khat) THEN (SELECT quantile_cont(w, 0.99) FROM odds) ELSE 'infinity'::DOUBLE END AS bound,
         khat AS khat_before FROM kb),
cw AS (SELECT unit, w, least(w, bound) AS w_used FROM odds, cl),
{khat_sql("ka", "(SELECT w_used AS w FROM cw)")},
cr AS (SELECT clipped, bound, (SELECT avg(CASE WHEN w > w_used THEN 1 ELSE 0 END) FROM cw) AS clipped_share,
  CASE WHEN clipped THEN 1 - (SELECT sum(w_used) / sum(w) FROM cw) ELSE 0.0 END AS bias, khat_before,
  CASE WHEN clipped THEN (SELECT khat FROM ka) ELSE khat_before END AS khat_after FROM cl)"""


@query("conditional_clip", W + f", {CLIP_SQL}" + """
SELECT clipped, round(bound, 6) AS bound, round(clipped_share, 6) AS clipped_share, round(bias, 6) AS bias,
  round(khat_before, 4) AS khat_before, round(khat_after, 4) AS khat_after FROM cr""")
def conditional_clip(spark, sf):
    odds, _ = odds_weights_of(calibration_units(spark, sf)[1])
    return rounded(weights.conditional_clip(odds)[1], 6, khat_before=4, khat_after=4)


CLIPPED_Q = quantile_sql(
    "qc", "(SELECT scores.*, w_used AS w FROM scores JOIN cw USING (unit))", "w",
    "(SELECT test_weight FROM odds_test)", "(SELECT bias FROM cr)",
)


@query("weighted_interval", W + f", {CLIP_SQL}, {CLIPPED_Q}, iv AS (" + intervals_sql("split = 'test' AND target_ttr <= 90", "qc", "weighted") + """)
SELECT learner, CAST(seed AS BIGINT) AS seed, sided, level, round(any_value(q), 4) AS q, count(*) AS n,
  round(avg(CASE WHEN target >= lo AND target <= hi THEN 1 ELSE 0 END), 6) AS coverage
FROM iv GROUP BY learner, seed, sided, level""")
def weighted_interval(spark, sf):
    """Weighted intervals with conditional clipping and the alpha it costs."""
    frame, cal = calibration_units(spark, sf)
    odds, test_weight = odds_weights_of(cal)
    clipped, row = weights.conditional_clip(odds)
    q = conformal.conformal_quantile(
        conformal.score_table(with_learners(clipped), "target", "pred"), LEVELS, ["learner", "seed", "sided"],
        weight="w_used", test_weight=test_weight, shrink=row.select(F.col("bias").alias("alpha_shift")),
    )
    test = frame.filter((F.col("split") == "test") & (F.col("target_ttr") <= RECENCY))
    out = conformal.attach_intervals(with_learners(test), stage(q), ["learner", "seed"], "pred", "target")
    return longs(rounded(out.groupBy(*KEYS).agg(
        F.max("q").alias("q"), F.count(F.lit(1)).alias("n"), F.avg(F.col("covered").cast("int")).alias("coverage")
    ), 6, q=4), "seed")


@query("weighted_diagnostics", W + f", {khat_sql('ko', 'odds')}" + """,
x AS (SELECT odds.w, p.known, p.target_ttr FROM odds JOIN p USING (unit))
SELECT count(*) AS n, round(sum(w) * sum(w) / sum(w * w), 4) AS n_eff, round(count(*) / (sum(w) * sum(w) / sum(w * w)), 6) AS n_over_neff,
  round((SELECT khat FROM ko), 4) AS khat, count(*) FILTER (WHERE w > 0) AS n_positive, round(max(w), 6) AS max, round(avg(w), 6) AS test_weight,
  round(abs(sum(w * known) / sum(w) - avg(known)) / stddev_samp(known), 6) AS asmd_risk_level,
  round(abs(sum(w * target_ttr) / sum(w) - avg(target_ttr)) / stddev_samp(target_ttr), 6) AS asmd_last_time FROM x""")
def weighted_diagnostics(spark, sf):
    odds, test_weight = odds_weights_of(calibration_units(spark, sf)[1])
    row = weights.weighted_diagnostics(stage(odds), {"risk_level": "known", "last_time": "target_ttr"}, test_weight)
    return rounded(row.select(
        "n", "n_eff", "n_over_neff", "khat", "n_positive", "max", "test_weight", "asmd_risk_level", "asmd_last_time"
    ), 6, khat=4, n_eff=4)


# --- exact intervals and tests on counts -----------------------------------------------------


@query("exact_bounds", f"""WITH RECURSIVE kn AS (
  SELECT lang, count(*) FILTER (WHERE quality = 1) AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang),
{bounds_sql("kn")}""" + """
SELECT lang, k, n, round(cp_lo, 7) AS cp_lo, round(cp_hi, 7) AS cp_hi, round(50 * (cp_hi - cp_lo), 5) AS half_pp
FROM kn JOIN cp USING (k, n)""")
def exact_bounds(spark, sf):
    from unitcal.functions.exact import clopper_pearson

    df = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    counts = df.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count(F.lit(1)).alias("n"))
    out = counts.withColumn("_b", clopper_pearson(F.col("k"), F.col("n"))).select("*", "_b.*").drop("_b")
    return rounded(out.withColumn("half_pp", 50.0 * (F.col("cp_hi") - F.col("cp_lo"))), 7, half_pp=5)


@query("binomial_test", """WITH c AS (
  SELECT lang, count(*) FILTER (WHERE toxic = 1) AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, k, n, round(""" + binomial_sql("k", "n", "0.1") + "::DOUBLE, 8) AS p_value FROM c")
def binomial_test(spark, sf):
    df = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    counts = df.groupBy("lang").agg(F.count_if(F.col("toxic") == 1).alias("k"), F.count(F.lit(1)).alias("n"))
    return rounded(counts.withColumn("p_value", binomial_p(F.col("k"), F.col("n"), F.lit(0.1))), 8)


PROP_BOOT = f"""pg AS (SELECT grp, target >= 450000 AS high, b.range AS blk, md5('42:' || b.range || ':' || unit) AS h FROM p, range({REPLICATES // 4}) b),
pd AS (SELECT grp, high, 4 * blk + s.range AS replicate, CAST('0x' || substr(h, CAST(8 * s.range + 1 AS INTEGER), 8) AS BIGINT) AS d
       FROM pg, range(4) s),
pr AS (SELECT grp, replicate, sum(({POISSON_CASE}) * high::INT) / sum({POISSON_CASE}) AS share FROM pd GROUP BY grp, replicate),
kn AS (SELECT grp, count(*) FILTER (WHERE target >= 450000) AS k, count(*) AS n FROM p GROUP BY grp)"""


@query("proportion_bounds", PAIRS + f", {PROP_BOOT}, {bounds_sql('kn')}" + """
SELECT grp, n AS n_units, k, round(k / n, 6) AS share, round(lo, 6) AS share_lo, round(hi, 6) AS share_hi, CAST(0 AS BIGINT) AS share_undefined,
  round(cp_lo, 6) AS cp_lo, round(cp_hi, 6) AS cp_hi, round(50 * (hi - lo), 4) AS boot_half_pp, round(50 * (cp_hi - cp_lo), 4) AS cp_half_pp,
  hi = lo AS degenerate
FROM kn JOIN cp USING (k, n) JOIN (SELECT grp, quantile_cont(share, 0.025) AS lo, quantile_cont(share, 0.975) AS hi FROM pr GROUP BY grp) USING (grp)""")
def proportion_bounds(spark, sf):
    """Share of high targets per segment, with bootstrap and exact bounds and the zero-width flag."""
    out = resample.proportion_bounds(
        pairs(spark, sf, group=True), F.col("target") >= THRESHOLD, ["grp"], n_replicates=REPLICATES, unit="unit"
    )
    return rounded(out, 6, boot_half_pp=4, cp_half_pp=4)


PRECISION_SQL = PAIRS + f""", {SWEEP},
g0 AS (SELECT p.grp, ic.covered FROM ic JOIN p USING (unit) WHERE method = 'naive' AND learner = 'persistence' AND sided = 'two'
        AND abs(level - 0.9) < 1e-9 AND seed = 42 AND p.target >= 450000),
g AS (SELECT 'all' AS scope, count(*) AS n, count(*) FILTER (WHERE covered) AS k FROM g0 UNION ALL
      SELECT grp, count(*), count(*) FILTER (WHERE covered) FROM g0 GROUP BY grp),
nc AS (SELECT count(*) AS n_cal FROM p JOIN s USING (unit) WHERE subset = 'calibration'),
kn AS (SELECT k, n FROM g), {bounds_sql("kn")},
j AS (SELECT scope, k, n, n_cal, 50 * (cp_hi - cp_lo) AS cp_half_pp, floor(0.1 * (n_cal + 1) + 1e-12) AS l FROM g JOIN cp USING (k, n), nc)"""


@query("precision_table", PRECISION_SQL + """
SELECT scope, k, n, n_cal, round(cp_half_pp, 4) AS cp_half_pp,
  round(100 * sqrt((n_cal + 1 - l) * l / (pow(n_cal + 1, 2) * (n_cal + 2))), 6) AS calibration_sd_pp,
  round(100 * sqrt(0.09 / n), 6) AS test_sd_pp, round(pow(0.9, n), 8) AS p_all_covered,
  cp_half_pp <= 5 AS meets_bar, cp_half_pp <= 10 AS meets_loose,
  CASE WHEN cp_half_pp <= 5 THEN 'estimable' WHEN cp_half_pp <= 10 THEN 'estimable at the looser bar' ELSE 'merge' END AS verdict
FROM j""")
def precision_table(spark, sf):
    """How precisely coverage of the high units is known: over all and per segment."""
    return rounded(precision_rows(spark, sf), 6, cp_half_pp=4, p_all_covered=8)


def precision_rows(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_mktsegment").alias("grp"))
    rows = sweep_intervals(spark, sf).filter(
        "method = 'naive' AND learner = 'persistence' AND sided = 'two' AND abs(level - 0.9) < 1e-9"
        f" AND seed = 42 AND target >= {THRESHOLD}"
    ).join(customers, "unit")
    scope = F.explode(F.array(F.lit("all"), F.col("grp")))
    n_cal = calibration_units(spark, sf)[1].agg(F.count(F.lit(1))).scalar()
    counts = rows.select(scope.alias("scope"), "covered").groupBy("scope").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("covered").alias("k")
    ).withColumn("n_cal", n_cal)
    return resample.judge_precision(counts, 0.9, 5.0, 10.0)


@query("smallest_adequate_group", PRECISION_SQL + " SELECT min(n) FILTER (WHERE cp_half_pp <= 15) AS min_n FROM j")
def smallest_adequate_group(spark, sf):
    rows = precision_rows(spark, sf).withColumn("meets", F.col("cp_half_pp") <= 15.0)
    return resample.smallest_adequate(rows, "meets")


@query("calibration_sizes", PAIRS + """,
c AS (SELECT count(*) AS all_units, count(*) FILTER (WHERE target >= 450000) AS high_units FROM p WHERE split = 'train'),
nt AS (SELECT count(*) AS n_test FROM p WHERE split = 'test' AND target >= 450000),
r AS (SELECT population, fraction::DOUBLE AS fraction, CAST(round_even(fraction * n, 0) AS BIGINT) AS n_cal, n_test
      FROM (SELECT 'all_units' AS population, all_units AS n FROM c UNION ALL SELECT 'high_units', high_units FROM c),
           (VALUES (0.1), (0.2), (0.3)) f(fraction), nt),
l AS (SELECT *, floor(0.1 * (n_cal + 1) + 1e-12) AS l FROM r),
v AS (SELECT *, CASE WHEN l >= 1 THEN 100 * sqrt((n_cal + 1 - l) * l / (pow(n_cal + 1, 2) * (n_cal + 2))) END AS sd, 100 * sqrt(0.09 / n_test) AS t FROM l)
SELECT population, fraction, n_cal, l < 1 AS infeasible, round(sd, 6) AS calibration_sd_pp, round(t, 6) AS test_sd_pp,
       round(t / sd, 6) AS test_to_calibration FROM v""")
def calibration_sizes(spark, sf):
    frame = pairs(spark, sf)
    n_test = frame.filter((F.col("split") == "test") & (F.col("target") >= THRESHOLD)).agg(F.count(F.lit(1)))
    return rounded(resample.calibration_sizes(
        frame.filter("split = 'train'"), F.col("target") >= THRESHOLD, (0.1, 0.2, 0.3), 0.9, n_test
    ))


# --- weights from a trained discriminator --------------------------------------------------

DISCRIMINATED = ("known", "n_admissible", "early")

#: The same penalised regression, solved one coefficient after the other by Newton steps.
REGRESSION_SQL = f"""{SPLIT_SQL},
df AS (SELECT p.unit, p.known, p.target_ttr, p.n_admissible::DOUBLE AS n_admissible,
         CASE WHEN p.n_admissible > 3 THEN p.first_ttr END AS early, (p.split = 'test')::INT AS y
       FROM p LEFT JOIN s USING (unit) WHERE p.split = 'test' OR subset = 'calibration'),
md AS (SELECT quantile_cont(known, 0.5) AS m1, quantile_cont(n_admissible, 0.5) AS m2, quantile_cont(early, 0.5) AS m3 FROM df),
fl AS (SELECT df.*, coalesce(known, m1) AS x1, coalesce(n_admissible, m2) AS x2, coalesce(early, m3) AS x3 FROM df, md),
sc AS (SELECT avg(x1) AS a1, avg(x2) AS a2, avg(x3) AS a3, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, stddev_pop(x3) AS s3 FROM fl),
z AS (SELECT unit, known, target_ttr, y, (x1 - a1) / s1 AS z1, (x2 - a2) / s2 AS z2, (x3 - a3) / s3 AS z3 FROM fl, sc),
fit AS (
  SELECT 0 AS it, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3
  UNION ALL
  SELECT it + 1, CASE WHEN it % 4 = 0 THEN b0 - g0 / h0 ELSE b0 END, CASE WHEN it % 4 = 1 THEN b1 - (g1 + b1) / (h1 + 1) ELSE b1 END,
         CASE WHEN it % 4 = 2 THEN b2 - (g2 + b2) / (h2 + 1) ELSE b2 END, CASE WHEN it % 4 = 3 THEN b3 - (g3 + b3) / (h3 + 1) ELSE b3 END
  FROM (SELECT it, b0, b1, b2, b3, sum(r) AS g0, sum(v) AS h0, sum(r * z1) AS g1, sum(v * z1 * z1) AS h1,
               sum(r * z2) AS g2, sum(v * z2 * z2) AS h2, sum(r * z3) AS g3, sum(v * z3 * z3) AS h3
        FROM (SELECT *, q - y AS r, q * (1 - q) AS v
              FROM (SELECT fit.*, z1, z2, z3, y, 1 / (1 + exp(-(b0 + b1 * z1 + b2 * z2 + b3 * z3))) AS q FROM fit, z))
        GROUP BY it, b0, b1, b2, b3)
  WHERE it < 800),
pt AS (SELECT z.*, 1 / (1 + exp(-(b0 + b1 * z1 + b2 * z2 + b3 * z3))) AS p_test FROM z, fit WHERE it = 800),
cw AS (SELECT unit, known, target_ttr, p_test, pp / (1 - pp) AS w_classifier
       FROM (SELECT *, greatest(least(p_test, 1 - 1e-6), 1e-6) AS pp FROM pt WHERE y = 0)),
prev AS (SELECT avg(CASE WHEN target >= 450000 THEN 1 ELSE 0 END) FILTER (WHERE split = 'test') AS pv,
                avg(CASE WHEN target >= 450000 THEN 1 ELSE 0 END) FILTER (WHERE split = 'train') AS pr FROM p),
bw AS (SELECT cw.*, (CASE WHEN target_ttr <= 90 THEN 1.0 ELSE 0.0 END)::DOUBLE *
              CASE WHEN known >= 450000 THEN pv / pr ELSE (1 - pv) / (1 - pr) END AS w_rule FROM cw, prev)"""


def discriminated_frame(spark, sf):
    """Forecastable customers with their training subset and what the discriminator may see."""
    frame = pairs(spark, sf).select(
        "unit", "split", "target", "target_ttr", "known", F.col("n_admissible").cast("double").alias("n_admissible"),
        F.when(F.col("n_admissible") > 3, F.col("first_ttr")).alias("early"),
    )
    return stage(frame.join(training_split(spark, sf), "unit", "left"))


def trained_weights(frame, tail_index=False):
    prev = weights.prevalences(frame, "target", THRESHOLD, F.col("split") == "test", F.col("split") == "train")
    return discriminant.build_weights(
        frame.filter("subset = 'calibration'"), frame.filter("split = 'test'"), DISCRIMINATED, prev,
        F.col("target_ttr") <= RECENCY, F.col("known"), THRESHOLD, tail_index=tail_index,
    )


@query("trained_weights", PAIRS + f", {REGRESSION_SQL} SELECT unit, round(p_test, 6) AS p_test, round(w_rule, 6) AS w_rule,"
       " round(w_classifier, 5) AS w_classifier FROM bw")
def trained_weight_rows(spark, sf):
    rows = trained_weights(discriminated_frame(spark, sf)).rows
    return rounded(rows.select("unit", "p_test", "w_rule", "w_classifier"), 6, w_classifier=5)


@query("build_weights", PAIRS + f", {REGRESSION_SQL}" + """,
gn AS (SELECT w_rule / (SELECT avg(w_rule) FROM bw WHERE w_rule > 0) AS a,
         w_classifier / (SELECT avg(w_classifier) FROM bw WHERE w_rule > 0) AS b FROM bw WHERE w_rule > 0),
rk AS (SELECT y, row_number() OVER (ORDER BY p_test) + (count(*) OVER (PARTITION BY p_test) - 1) / 2.0
         - (row_number() OVER (PARTITION BY p_test) - 1) AS rank FROM pt),
au AS (SELECT (sum(rank) FILTER (WHERE y = 1) - n1 * (n1 + 1) / 2.0) / (n1 * n0) AS auc
       FROM rk, (SELECT count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0 FROM pt) GROUP BY n1, n0)
SELECT (SELECT round(max(greatest(a / b, b / a)), 4) FROM gn) AS gamma_divergence, round(auc, 6) AS classifier_auc,
  (SELECT count(*) FROM bw) AS rule_n, (SELECT round(sum(w_rule) * sum(w_rule) / sum(w_rule * w_rule), 4) FROM bw) AS rule_n_effective,
  (SELECT round(sum(w_classifier) * sum(w_classifier) / sum(w_classifier * w_classifier), 4) FROM bw) AS classifier_n_effective,
  (SELECT round(avg(w_classifier), 5) FROM bw) AS classifier_test_weight,
  (SELECT round(pv * pv / pr + (1 - pv) * (1 - pv) / (1 - pr), 6) FROM prev) AS rule_test_weight
FROM au""")
def build_weights(spark, sf):
    built = trained_weights(discriminated_frame(spark, sf))
    out = built.summary.select(
        "*", built.classifier_test.scalar().alias("classifier_test_weight"), built.rule_test.scalar().alias("rule_test_weight")
    )
    return rounded(out, 6, gamma_divergence=4, rule_n_effective=4, classifier_n_effective=4, classifier_test_weight=5)
