import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitcal.operators import conformal

RNG = np.random.default_rng(5)


def scores(spark, values, weights=None):
    if weights is None:
        return spark.createDataFrame([(float(v),) for v in values], "score double")
    return spark.createDataFrame([(float(v), float(w)) for v, w in zip(values, weights)], "score double, w double")


def one(df):
    return df.first()["q"]


@pytest.mark.parametrize("n,alpha", [(19, 0.05), (99, 0.1), (200, 0.1), (39, 0.05)])
def test_uniform_quantile_is_an_order_statistic(spark, n, alpha):
    values = RNG.normal(size=n)
    expected = np.sort(values)[math.ceil((n + 1) * (1 - alpha) - 1e-9) - 1]
    df = scores(spark, values)
    assert one(conformal.conformal_quantile(df, [1 - alpha])) == pytest.approx(expected)
    assert one(conformal.order_statistic_quantile(df, [1 - alpha])) == pytest.approx(expected)


def test_too_few_scores_are_unbounded(spark):
    df = scores(spark, range(8))
    assert one(conformal.conformal_quantile(df, [0.9])) == math.inf
    assert one(conformal.order_statistic_quantile(df, [0.9])) == math.inf
    assert one(conformal.conformal_quantile(scores(spark, range(9)), [0.9])) == 8.0


def test_equal_weights_change_nothing(spark):
    values = RNG.normal(size=150)
    plain = one(conformal.conformal_quantile(scores(spark, values), [0.9]))
    assert one(conformal.conformal_quantile(scores(spark, values, [3.7] * 150), [0.9], weight="w")) == plain


def test_weighted_quantile_against_brute_force(spark):
    values, w = RNG.normal(size=120), RNG.uniform(0, 3, size=120)
    order = np.argsort(values)
    mass = np.cumsum(w[order]) / (w.sum() + w.mean())
    expected = values[order][np.argmax(mass >= 0.8 - 1e-12)]
    assert one(conformal.conformal_quantile(scores(spark, values, w), [0.8], weight="w")) == pytest.approx(expected)


def test_a_heavy_test_point_is_unbounded(spark):
    df = scores(spark, range(50), [1.0] * 50)
    heavy = spark.createDataFrame([(20.0,)], "test_weight double")
    assert one(conformal.conformal_quantile(df, [0.9], weight="w", test_weight=heavy)) == math.inf


def test_ties_and_groups(spark):
    df = spark.createDataFrame([("a", 1.0)] * 60 + [("a", 2.0)] * 40 + [("b", 5.0)] * 30, "k string, score double")
    got = {(r["k"], r["level"]): r["q"] for r in conformal.conformal_quantile(df, [0.5, 0.9], ["k"]).collect()}
    assert got == {("a", 0.5): 1.0, ("a", 0.9): 2.0, ("b", 0.5): 5.0, ("b", 0.9): 5.0}


@pytest.mark.parametrize("values,weights", [([], []), ([math.nan], [1.0]), ([1.0], [-1.0]), ([1.0], [0.0]), ([1.0], [math.inf])])
def test_gates(spark, values, weights):
    with pytest.raises(conformal.ConformalError):
        conformal.require_scores(scores(spark, values, weights) if values else scores(spark, [1.0], [1.0]).limit(0), "score", "w")


def test_bad_level_raises(spark):
    with pytest.raises(ValueError):
        conformal.conformal_quantile(scores(spark, [1.0]), [1.0])


def test_one_sided_interval(spark):
    test = spark.createDataFrame([(1.0, 9.0)], "pred double, y double")
    q = spark.createDataFrame([("two", 0.9, 2.0), ("upper", 0.9, math.inf)], "sided string, level double, q double")
    rows = {r["sided"]: r for r in conformal.attach_intervals(test, q, [], "pred", "y").collect()}
    assert (rows["two"]["lo"], rows["two"]["hi"], rows["two"]["covered"]) == (-1.0, 3.0, False)
    assert rows["upper"]["lo"] == -math.inf and rows["upper"]["covered"]


def test_end_points_belong_to_the_interval_and_reversed_ones_raise(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (2.0, 1.0, 2.0), (3.0, 1.0, 2.0)], "y double, lo double, hi double")
    assert conformal.empirical_coverage(df, "y", "lo", "hi").first()["coverage"] == pytest.approx(2 / 3)
    with pytest.raises(conformal.ConformalError):
        conformal.require_intervals(conformal.empirical_coverage(df, "y", "hi", "lo"))


def test_infinite_widths_do_not_enter_the_median(spark):
    df = spark.createDataFrame(
        [("a", 1.0, True), ("a", 3.0, False), ("a", math.inf, True), ("b", math.inf, True)],
        "k string, width double, covered boolean",
    )
    rows = {r["k"]: r for r in conformal.coverage_table(df, ["k"]).collect()}
    assert rows["a"]["median_width"] == 2.0 and rows["a"]["share_infinite"] == pytest.approx(1 / 3)
    assert rows["b"]["median_width"] == math.inf and rows["b"]["cp_hi"] == 1.0


def test_nominal_coverage_when_exchangeable(spark):
    """60 calibrations at once: the replicate is a column."""
    reps, n_cal, n_test = 60, 150, 150
    data = RNG.standard_t(5, size=(reps, n_cal + n_test)) * 2
    cal = spark.createDataFrame([(r, abs(float(v))) for r in range(reps) for v in data[r, :n_cal]], "rep int, score double")
    test = spark.createDataFrame([(r, 0.0, float(v)) for r in range(reps) for v in data[r, n_cal:]], "rep int, pred double, y double")
    q = conformal.conformal_quantile(cal, [0.9], ["rep"]).withColumn("sided", F.lit("two"))
    covered = conformal.attach_intervals(test, q, ["rep"], "pred", "y").agg(F.avg(F.col("covered").cast("int"))).first()[0]
    assert 0.885 < covered < 0.925


def test_weights_restore_coverage_under_known_shift(spark):
    reps, n = 40, 300
    rows = []
    for r in range(reps):
        x = RNG.normal(size=n)
        y = RNG.normal(size=n) * (0.5 + 0.5 * np.abs(x))
        rows += [(r, abs(float(b)), float(np.exp(a - 0.5))) for a, b in zip(x, y)]
    cal = spark.createDataFrame(rows, "rep int, score double, w double")
    tests = []
    for r in range(reps):
        x = RNG.normal(1.0, 1.0, size=n)
        y = RNG.normal(size=n) * (0.5 + 0.5 * np.abs(x))
        tests += [(r, 0.0, float(b)) for b in y]
    test = spark.createDataFrame(tests, "rep int, pred double, y double")

    def coverage(**kw):
        q = conformal.conformal_quantile(cal, [0.9], ["rep"], **kw).withColumn("sided", F.lit("two"))
        return conformal.attach_intervals(test, q, ["rep"], "pred", "y").agg(F.avg(F.col("covered").cast("int"))).first()[0]

    plain, weighted = coverage(), coverage(weight="w")
    assert plain < 0.88 and abs(weighted - 0.9) < 0.02 and weighted > plain


def test_paired_counts_and_mcnemar(spark):
    rows = [("naive", i, i < 5, "l", 0.9) for i in range(10)] + [("weighted_rule", i, i < 9, "l", 0.9) for i in range(10)]
    df = spark.createDataFrame(rows, "method string, unit int, covered boolean, learner string, level double")
    row = conformal.mcnemar(conformal.paired_coverage(df, "unit")).first()
    assert (row["both"], row["only_first"], row["only_second"], row["neither"]) == (5, 0, 4, 1)
    assert row["p_value"] == pytest.approx(0.125)


def test_rounding_is_that_of_the_sql(spark):
    """bounds a little below a tie of the fourth digit, negative, infinite and missing ones."""
    duckdb = pytest.importorskip("duckdb")
    from unitcal.plans.registry import round_scaled

    values = [894824.8517499999, 517638.80364999996, -894824.8517499999, 0.5, 1e300, float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = [r[0] for r in df.select(round_scaled(F.col("v"), 4)).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 4)", [v]).fetchone()[0] for v in values] + [None]
    nan = spark.range(1).select(round_scaled(F.lit(float("nan")), 4).alias("v")).first()["v"]
    assert nan != nan
