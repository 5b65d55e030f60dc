"""Baselines, decision rule, scores and their summaries on the order series."""

from __future__ import annotations

from pyspark.sql import functions as F

from unitcal.functions import draw_bits
from unitcal.functions.columns import TWO_32
from unitcal.operators import resample, score, series, splits
from unitcal.plans.registry import longs, query, rounded
from unitcal.plans.tables import (
    A, CONSTANT, CUTOFF, EPSILON, M, MARGIN, ORDERS, PAIRS, T, TAUS, THRESHOLD, U,
    messages, pairs, sql_draw, table,
)

NUMBERS = ["precision", "recall", "f_beta", "mse_high", "loss"]


def score_sql(source: str, truth: str, pred: str, by: str, extra: str = "") -> str:
    """Score of already clipped predictions, grouped by ``by`` (comma-separated names)."""
    keys = by + "," if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""(
  SELECT {keys} n_units, tp, fp, fn, tn, precision, recall, f_beta,
         CASE WHEN n_high > 0 THEN sq / n_high ELSE 'nan'::DOUBLE END AS mse_high,
         CASE WHEN n_high = 0 THEN 'nan'::DOUBLE WHEN f_beta = 0 THEN 'infinity'::DOUBLE
              ELSE sq / n_high / f_beta END AS loss,
         n_high AS n_high_true, tp + fp AS n_high_pred, f_beta = 0 AS f_is_zero, n_high = 0 AS high_empty,
         f_beta > 0 AND n_high > 0 AS defined {extra}
  FROM (SELECT *, CASE WHEN 4 * precision + recall > 0
                       THEN 5 * precision * recall / (4 * precision + recall) ELSE 0.0 END::DOUBLE AS f_beta
        FROM (SELECT *, tp + fn AS n_high, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END::DOUBLE AS precision,
                     CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END::DOUBLE AS recall
              FROM (SELECT {keys} count(*) AS n_units,
                      count(*) FILTER (WHERE {truth} >= 450000 AND {pred} >= 450000) AS tp,
                      count(*) FILTER (WHERE {truth} < 450000 AND {pred} >= 450000) AS fp,
                      count(*) FILTER (WHERE {truth} >= 450000 AND {pred} < 450000) AS fn,
                      count(*) FILTER (WHERE {truth} < 450000 AND {pred} < 450000) AS tn,
                      coalesce(sum(({truth} - {pred}) * ({truth} - {pred})) FILTER (WHERE {truth} >= 450000), 0.0) AS sq
                    FROM {source} {group}))))"""


ROUNDED_SCORE = """n_units, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f_beta, 6) AS f_beta, round(mse_high, 2) AS mse_high, round(loss, 2) AS loss,
  n_high_true, n_high_pred, f_is_zero, high_empty, defined"""
SUBTOTALS = ("tp", "fp", "fn", "tn", "n_high_true", "n_high_pred")


def tidy(df):
    return longs(rounded(df, 6, mse_high=2, loss=2), *SUBTOTALS)


CLIPPED = "CASE WHEN known >= 450000 THEN known ELSE 449999.999 END"
# predictions of three "seeds": the known value with a reproducible +-10% disturbance
SEEDED_SQL = f"""sp AS (
  SELECT p.*, seed, known * (1.0 + ({sql_draw("seed || ':' || unit")} / 4294967296.0 - 0.5) * 0.2) AS pred
  FROM p, (VALUES (42), (43), (44)) v(seed))"""


def seeded(spark, sf):
    """Known value with a reproducible disturbance, for three seeds."""
    spread = pairs(spark, sf).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in (42, 43, 44)])))
    noise = (draw_bits(F.col("seed"), F.col("unit")) / float(TWO_32) - 0.5) * 0.2
    return spread.withColumn("pred", F.col("known") * (1.0 + noise))


@query("baseline_frame", f"""WITH {M}, {U}, {T}, {A}
SELECT unit, grp, target, known, CASE WHEN known >= 450000 THEN known ELSE 449999.999 END AS pred_persistence,
       460000.0::DOUBLE AS pred_constant
FROM u JOIN t USING (unit) JOIN a USING (unit) WHERE split = 'test'""")
def baseline_frame(spark, sf):
    frame, _ = baseline_tables(spark, sf)
    return frame.select("unit", "grp", "target", "known", "pred_persistence", "pred_constant")


def baseline_tables(spark, sf, split="test"):
    df = messages(spark, sf, group=True).filter(F.col("split") == split)
    units = series.unit_frame(
        series.attach_targets(df, series.final_messages(df, ORDERS), ORDERS), ORDERS, THRESHOLD
    )
    known = series.as_of(df, ORDERS, CUTOFF)
    return score.baseline_frame(units, known, "unit", THRESHOLD, EPSILON, CONSTANT)


@query("baseline_dropped", f"""WITH {M}, {U}, {A}
SELECT count(*) AS n_units, count(*) FILTER (WHERE known IS NULL) AS n_dropped
FROM u LEFT JOIN a USING (unit) WHERE split = 'train'""")
def baseline_dropped(spark, sf):
    return baseline_tables(spark, sf, "train")[1]


@query("confusion", f"""
SELECT lang, n_units, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f_beta, 6) AS f_beta
FROM (SELECT lang, n_units, tp, fp, fn, tn, precision, recall,
        CASE WHEN 4 * precision + recall > 0 THEN 5 * precision * recall / (4 * precision + recall) ELSE 0.0 END AS f_beta
      FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END::DOUBLE AS precision,
                   CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END::DOUBLE AS recall
            FROM (SELECT lang, count(*) AS n_units,
                    count(*) FILTER (WHERE quality = 1 AND n_chars >= 500) AS tp,
                    count(*) FILTER (WHERE quality = 0 AND n_chars >= 500) AS fp,
                    count(*) FILTER (WHERE quality = 1 AND n_chars < 500) AS fn,
                    count(*) FILTER (WHERE quality = 0 AND n_chars < 500) AS tn
                  FROM labels JOIN documents USING (doc_id) GROUP BY lang)))""")
def confusion(spark, sf):
    """Quality labels against a plain length rule, per language."""
    df = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    long_enough = F.when(F.col("n_chars") >= 500, 1.0).otherwise(0.0)
    counts = df.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_units"),
        *[c.alias(n) for n, c in score.confusion(F.col("quality"), long_enough, 0.5).items()],
    )
    return rounded(counts.withColumns(score.f_beta(F.col("tp"), F.col("fp"), F.col("fn"))))


@query("challenge_loss_by_group", PAIRS + f""",
c AS (SELECT *, {CLIPPED} AS pred FROM p)
SELECT split, grp, {ROUNDED_SCORE} FROM {score_sql("c", "target", "pred", "split, grp")}""")
def challenge_loss_by_group(spark, sf):
    """How good is the last value known before the cutoff as a forecast of the final one?"""
    scored = score.point_score(
        pairs(spark, sf, group=True), "target", "known", ["split", "grp"], THRESHOLD, epsilon=EPSILON
    )
    return tidy(scored)


@query("challenge_loss", PAIRS + f""",
c AS (SELECT *, {CLIPPED} AS pred FROM p)
SELECT {ROUNDED_SCORE} FROM {score_sql("c", "target", "pred", "")}""")
def challenge_loss(spark, sf):
    return tidy(score.point_score(pairs(spark, sf), "target", "known", (), THRESHOLD, epsilon=EPSILON))


@query("eligible_loss", PAIRS + f""",
c AS (SELECT *, {CLIPPED} AS pred FROM p WHERE n_msgs >= 2 AND last_ttr < 90 AND first_ttr >= 180)
SELECT split, {ROUNDED_SCORE} FROM {score_sql("c", "target", "pred", "split")}""")
def eligible_loss(spark, sf):
    """The baseline restricted to eligible units; eligibility is read off the same frame."""
    eligible = (F.col("n_msgs") >= 2) & (F.col("last_ttr") < 90) & (F.col("first_ttr") >= 180)
    return tidy(score.point_score(
        pairs(spark, sf).filter(eligible), "target", "known", ["split"], THRESHOLD, epsilon=EPSILON
    ))


TAU_VALUES = ", ".join(f"({t})" for t in TAUS)
SWEEP_SQL = f"""g AS (
  SELECT split, target, known, tau::DOUBLE AS tau,
         CASE WHEN known >= tau THEN greatest(known, 450000.001) ELSE known END AS promoted
  FROM p, (VALUES {TAU_VALUES}) v(tau)),
c AS (SELECT *, CASE WHEN promoted < 450000 THEN 449999.999 ELSE promoted END AS pred FROM g),
n AS (SELECT split, tau, count(*) FILTER (WHERE known >= tau) AS n_promoted FROM g GROUP BY split, tau),
sweep AS (SELECT * FROM {score_sql("c", "target", "pred", "split, tau")} JOIN n USING (split, tau))"""


def sweep_table(spark, sf):
    return score.promotion_sweep(
        pairs(spark, sf), "target", "known", TAUS, THRESHOLD, MARGIN, ["split"], epsilon=EPSILON
    )


@query("promotion_sweep", PAIRS + f", {SWEEP_SQL} SELECT split, tau, n_promoted, {ROUNDED_SCORE} FROM sweep")
def promotion_sweep(spark, sf):
    return tidy(sweep_table(spark, sf))


@query("best_promotion", PAIRS + f""", {SWEEP_SQL}
SELECT split, tau, round(loss, 2) AS loss
FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY loss, tau) AS rn FROM sweep WHERE defined) WHERE rn = 1""")
def best_promotion(spark, sf):
    return rounded(score.best_promotion(sweep_table(spark, sf), ["split"]), 2)


SEED_SCORES = f"""sc AS (SELECT *, CASE WHEN pred < 450000 THEN 449999.999 ELSE pred END AS clipped FROM sp),
ss AS (SELECT * FROM {score_sql("sc", "target", "clipped", "split, seed")})"""


def seed_scores(spark, sf):
    return score.point_score(seeded(spark, sf), "target", "pred", ["split", "seed"], THRESHOLD, epsilon=EPSILON)


@query("seed_aggregate", PAIRS + f""", {SEEDED_SQL}, {SEED_SCORES},
o AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY loss, seed) - 1 AS place FROM ss)
SELECT split, count(*) AS n_seeds, CAST(max(seed) FILTER (WHERE place = 1) AS BIGINT) AS median_seed,
  round(avg(loss), 2) AS loss_mean, round(stddev_samp(loss), 2) AS loss_sd, round(min(loss), 2) AS loss_min,
  round(max(loss), 2) AS loss_max, round(avg(f_beta), 6) AS f_beta_mean, round(stddev_samp(f_beta), 6) AS f_beta_sd,
  round(min(f_beta), 6) AS f_beta_min, round(max(f_beta), 6) AS f_beta_max
FROM o GROUP BY split""")
def seed_aggregate(spark, sf):
    out = score.aggregate_seeds(seed_scores(spark, sf), ["split"], ["loss", "f_beta"])
    digits = {f"loss_{s}": 2 for s in ("mean", "sd", "min", "max")}
    return longs(rounded(out, 6, **digits), "median_seed")


@query("seed_spread", PAIRS + f""", {SEEDED_SQL}, {SEED_SCORES}
SELECT split, round(max(loss) - min(loss), 2) AS spread, round((max(loss) - min(loss)) / avg(loss), 6) AS relative,
       (max(loss) - min(loss)) / avg(loss) > 0.5 AS unstable
FROM ss GROUP BY split""")
def seed_spread(spark, sf):
    return rounded(score.seed_spread(seed_scores(spark, sf), ["split"], "loss"), 6, spread=2)


# the train split takes the place of the published numbers, the test split of ours
VERDICT_SQL = f"""c AS (SELECT *, {CLIPPED} AS pred FROM p),
r AS (SELECT * FROM {score_sql("c", "target", "pred", "split, grp")}),
l AS (SELECT split, grp, 'loss' AS metric, loss AS value FROM r UNION ALL
      SELECT split, grp, 'f_beta', f_beta FROM r UNION ALL SELECT split, grp, 'mse_high', mse_high FROM r)"""


@query("published_verdict", PAIRS + f""", {VERDICT_SQL}
SELECT e.grp, e.metric, round(e.value, 2) AS expected, round(v.value, 2) AS value,
  round(abs(v.value - e.value), 2) AS difference,
  CASE WHEN abs(v.value - e.value) <= CASE e.metric WHEN 'f_beta' THEN 0.05 ELSE 1e9 END THEN 'MATCH'
       WHEN abs(v.value - e.value) <= 1e10 THEN 'PARTIAL' ELSE 'MISMATCH' END AS verdict
FROM (SELECT * FROM l WHERE split = 'train') e JOIN (SELECT * FROM l WHERE split = 'test') v USING (grp, metric)""")
def published_verdict(spark, sf):
    """Test scores judged against the train scores as if those were published."""
    rows = score.melt(
        score.point_score(pairs(spark, sf, group=True), "target", "known", ["split", "grp"], THRESHOLD, epsilon=EPSILON),
        ["split", "grp"], ["loss", "f_beta", "mse_high"],
    )
    expected = rows.filter("split = 'train'").select(
        "grp", "metric", F.col("value").alias("expected"),
        F.when(F.col("metric") == "f_beta", F.lit(0.05)).alias("tolerance"),
    )
    ours = rows.filter("split = 'test'").drop("split")
    return rounded(score.published_verdict(ours, expected, ["grp"], 1e9, 1e10), 2)


COMPARE_SQL = f"""b AS (SELECT *, {CLIPPED} AS pred_a, 460000.0 AS pred_b FROM p WHERE split = 'test'),
k AS (SELECT *, 'persistence' AS model FROM {score_sql("b", "target", "pred_a", "")} UNION ALL
      SELECT *, 'constant' FROM {score_sql("b", "target", "pred_b", "")})"""


def comparison(spark, sf):
    test = pairs(spark, sf).filter("split = 'test'").withColumn("constant", F.lit(CONSTANT))
    return score.compare_models({
        "persistence": score.point_score(test, "target", "known", (), THRESHOLD, epsilon=EPSILON),
        "constant": score.point_score(test, "target", "constant", (), THRESHOLD, epsilon=EPSILON),
    })


@query("model_comparison", PAIRS + f""", {COMPARE_SQL}
SELECT model, {ROUNDED_SCORE}, loss = (SELECT min(loss) FROM k) AS is_best FROM k""")
def model_comparison(spark, sf):
    return tidy(comparison(spark, sf))


@query("leakage_screen", PAIRS + f""", {COMPARE_SQL},
r AS (SELECT model, loss, (SELECT loss FROM k WHERE model = 'persistence') / loss AS loss_ratio FROM k)
SELECT model, round(loss_ratio, 6) AS loss_ratio, loss_ratio >= 2 AS suspicious FROM r""")
def leakage_screen(spark, sf):
    table_ = comparison(spark, sf)
    reference = table_.filter("model = 'persistence'").agg(F.max("loss")).scalar()
    return rounded(splits.leakage_screen(table_, reference).select("model", "loss_ratio", "suspicious"))


@query("target_distribution", f"""WITH {M}, {U}, {T}
SELECT split, count(*) AS n_units, round(avg(CASE WHEN target <= 0 THEN 1 ELSE 0 END), 6) AS share_floor,
  round(avg(CASE WHEN target >= 450000 THEN 1 ELSE 0 END), 6) AS share_high, round(quantile_cont(target, 0.5), 4) AS median
FROM u JOIN t USING (unit) GROUP BY split""")
def target_distribution(spark, sf):
    frame = series.forecast_frame(messages(spark, sf), ORDERS, CUTOFF, ("split",))
    return rounded(score.target_distribution(frame, "target", 0.0, THRESHOLD, ["split"]), 6, median=4)


@query("undefined_scores", """
SELECT event_type, n_units, CAST(n_high AS BIGINT) AS n_high_true, mse_high IS NULL AS mse_undefined,
       n_high = 0 AS high_empty, n_high > 0 AND NOT hit AS f_is_zero_with_high
FROM (SELECT event_type, count(*) AS n_units, count(*) FILTER (WHERE value >= 400) AS n_high,
        avg(value) FILTER (WHERE value >= 400) AS mse_high, false AS hit
      FROM events GROUP BY event_type)""")
def undefined_scores(spark, sf):
    """A forecast that is never high: the F-score is 0, or nothing is high at all."""
    df = table(spark, sf, "events").withColumn("pred", F.lit(0.0))
    s = score.point_score(df, "value", "pred", ["event_type"], 400.0, epsilon=EPSILON)
    return longs(s.select(
        "event_type", "n_units", "n_high_true", F.isnan("mse_high").alias("mse_undefined"), "high_empty",
        ((F.col("n_high_true") > 0) & (F.col("loss") == float("inf"))).alias("f_is_zero_with_high"),
    ), "n_high_true")


# --- bounds --------------------------------------------------------------------------------

REPLICATES = 2000
EXACT_DRAWS = f"""ix AS (
  SELECT split, unit, row_number() OVER (PARTITION BY split ORDER BY unit) - 1 AS idx,
         count(*) OVER (PARTITION BY split) AS n_total FROM p),
dg AS (
  SELECT split, n_total, b.range AS blk, md5('42:' || b.range || ':' || idx) AS h FROM ix, range({REPLICATES // 2}) b),
dr AS (
  SELECT split, 2 * blk + s.range AS replicate,
         CAST(CAST('0x' || substr(h, CAST(16 * s.range + 1 AS INTEGER), 16) AS UBIGINT) % n_total::UBIGINT AS BIGINT) AS idx
  FROM dg, range(2) s)"""


@query("bootstrap_mean", PAIRS + f""", {EXACT_DRAWS},
v AS (SELECT ix.split, ix.idx, p.target, abs(p.target - p.known) AS err FROM ix JOIN p USING (unit)),
r AS (SELECT split, replicate, avg(target) AS target, avg(err) AS err FROM dr JOIN v USING (split, idx) GROUP BY split, replicate)
SELECT r.split, any_value(n_units) AS n_units, round(any_value(m.target), 4) AS target, round(any_value(m.err), 4) AS err,
  round(quantile_cont(r.target, 0.025), 4) AS target_lo, round(quantile_cont(r.target, 0.975), 4) AS target_hi, CAST(0 AS BIGINT) AS target_undefined,
  round(quantile_cont(r.err, 0.025), 4) AS err_lo, round(quantile_cont(r.err, 0.975), 4) AS err_hi, CAST(0 AS BIGINT) AS err_undefined
FROM r JOIN (SELECT split, count(*) AS n_units, avg(target) AS target, avg(abs(target - known)) AS err FROM p GROUP BY split) m USING (split)
GROUP BY r.split""")
def bootstrap_mean(spark, sf):
    """Mean target and mean absolute error with bounds from exact draws."""
    return rounded(resample.bootstrap_means(
        pairs(spark, sf), "unit",
        {"target": F.col("target"), "err": F.abs(F.col("target") - F.col("known"))},
        ["split"], n_replicates=REPLICATES, mode="exact",
    ), 4)


PARTS_SQL = """v AS (SELECT ix.split, ix.idx, unit, target,
   CASE WHEN known >= 450000 THEN known ELSE 449999.999 END AS pred FROM ix JOIN p USING (unit))"""
REPLICATE_SCORES = """r AS (SELECT split, replicate, tp, fp, fn,
    CASE WHEN tp + fn > 0 THEN sq / (tp + fn) END AS mse,
    CASE WHEN 5 * tp + 4 * fn + fp > 0 THEN 5.0 * tp / (5 * tp + 4 * fn + fp) ELSE 0.0 END AS f FROM q),
f AS (SELECT split, replicate, mse, CASE WHEN mse IS NOT NULL THEN f END AS f_any, f,
        CASE WHEN f > 0 THEN mse / f END AS loss FROM r)"""
BOUNDS_SQL = """
  round(quantile_cont(loss, 0.025), 1) AS loss_lo, round(quantile_cont(loss, 0.975), 1) AS loss_hi,
  count(*) FILTER (WHERE loss IS NULL) AS loss_undefined,
  round(quantile_cont(mse, 0.025), 1) AS mse_high_lo, round(quantile_cont(mse, 0.975), 1) AS mse_high_hi,
  count(*) FILTER (WHERE mse IS NULL) AS mse_high_undefined,
  round(quantile_cont(f, 0.025), 6) AS f_beta_lo, round(quantile_cont(f, 0.975), 6) AS f_beta_hi,
  CAST(0 AS BIGINT) AS f_beta_undefined"""
BOUND_DIGITS = {"loss_lo": 1, "loss_hi": 1, "mse_high_lo": 1, "mse_high_hi": 1}


@query("bootstrap_loss", PAIRS + f""", {EXACT_DRAWS}, {PARTS_SQL},
q AS (SELECT split, replicate, count(*) FILTER (WHERE target >= 450000 AND pred >= 450000) AS tp,
        count(*) FILTER (WHERE target < 450000 AND pred >= 450000) AS fp,
        count(*) FILTER (WHERE target >= 450000 AND pred < 450000) AS fn,
        sum((target - pred) * (target - pred)) FILTER (WHERE target >= 450000) AS sq
      FROM dr JOIN v USING (split, idx) GROUP BY split, replicate), {REPLICATE_SCORES}
SELECT split, {BOUNDS_SQL} FROM f GROUP BY split""")
def bootstrap_loss(spark, sf):
    return rounded(resample.bootstrap_score(
        pairs(spark, sf), "unit", "target", "known", ["split"], THRESHOLD, epsilon=EPSILON,
        n_replicates=REPLICATES, mode="exact",
    ), 6, **BOUND_DIGITS)




def shares_sql(source: str) -> str:
    """Percentile bounds ``lo`` and ``hi`` of the resampled share of every (k, n) of ``source``, as CTE ``sb``."""
    return f"""bu AS (SELECT r.range AS replicate, (CAST('0x' || substr(md5('42:' || r.range), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE AS u
  FROM range({REPLICATES}) r),
bk AS (SELECT DISTINCT k, n FROM {source}),
bc AS (SELECT k, n, i, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(k / n) + (n - i) * ln(1 - k / n)))
         OVER (PARTITION BY k, n ORDER BY i) AS c
       FROM (SELECT k, n, unnest(range(0, n + 1)) AS i FROM bk WHERE k > 0 AND k < n)),
bs AS (SELECT k, n, replicate, coalesce(min(i) FILTER (WHERE c >= u), n) / n AS share FROM bc, bu GROUP BY k, n, replicate
       UNION ALL SELECT k, n, 0, k / n FROM bk WHERE k = 0 OR k = n),
sb AS (SELECT k, n, quantile_cont(share, 0.025) AS lo, quantile_cont(share, 0.975) AS hi FROM bs GROUP BY k, n)"""


POISSON_CASE = " + ".join(f"CAST(d >= {s} AS INTEGER)" for s in resample.poisson_steps())
POISSON_DRAWS = f"""pg AS (SELECT p.*, b.range AS blk, md5('42:' || b.range || ':' || unit) AS h
  FROM p, range({REPLICATES // 4}) b),
pd AS (SELECT * EXCLUDE (h, blk), 4 * blk + s.range AS replicate,
         CAST('0x' || substr(h, CAST(8 * s.range + 1 AS INTEGER), 8) AS BIGINT) AS d FROM pg, range(4) s),
pw AS (SELECT *, {POISSON_CASE} AS times, CASE WHEN known >= 450000 THEN known ELSE 449999.999 END AS pred FROM pd)"""


@query("bootstrap_loss_poisson", PAIRS + f""", {POISSON_DRAWS},
q AS (SELECT split, replicate, sum(times) FILTER (WHERE target >= 450000 AND pred >= 450000) AS tp,
        sum(times) FILTER (WHERE target < 450000 AND pred >= 450000) AS fp,
        sum(times) FILTER (WHERE target >= 450000 AND pred < 450000) AS fn,
        sum(times * (target - pred) * (target - pred)) FILTER (WHERE target >= 450000) AS sq
      FROM pw GROUP BY split, replicate), {REPLICATE_SCORES}
SELECT split, {BOUNDS_SQL} FROM f GROUP BY split""")
def bootstrap_loss_poisson(spark, sf):
    """The form for large unit counts: independent counts per unit, summed in place."""
    return rounded(resample.bootstrap_score(
        pairs(spark, sf), "unit", "target", "known", ["split"], THRESHOLD, epsilon=EPSILON,
        n_replicates=REPLICATES, mode="poisson",
    ), 6, **BOUND_DIGITS)


@query("score_with_bounds", PAIRS + f""", {POISSON_DRAWS},
q AS (SELECT split, replicate, sum(times) FILTER (WHERE target >= 450000 AND pred >= 450000) AS tp,
        sum(times) FILTER (WHERE target < 450000 AND pred >= 450000) AS fp,
        sum(times) FILTER (WHERE target >= 450000 AND pred < 450000) AS fn,
        sum(times * (target - pred) * (target - pred)) FILTER (WHERE target >= 450000) AS sq
      FROM pw GROUP BY split, replicate), {REPLICATE_SCORES},
c AS (SELECT *, {CLIPPED} AS pred FROM p)
SELECT * FROM (SELECT split, {ROUNDED_SCORE} FROM {score_sql("c", "target", "pred", "split")})
JOIN (SELECT split, {BOUNDS_SQL} FROM f GROUP BY split) USING (split)""")
def score_with_bounds(spark, sf):
    out = resample.score_with_bounds(
        pairs(spark, sf), "unit", "target", "known", ["split"], THRESHOLD, epsilon=EPSILON,
        n_replicates=REPLICATES,
    )
    return longs(rounded(out, 6, mse_high=2, loss=2, **BOUND_DIGITS), *SUBTOTALS)
