import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitcal.operators import weights

RNG = np.random.default_rng(11)


def frame(spark, w):
    return spark.createDataFrame([(float(v),) for v in w], "w double")


def khat(spark, w):
    return weights.pareto_khat(frame(spark, w)).first()["khat"]


def test_rule_weights(spark):
    cal = spark.createDataFrame([(True, -5.0), (True, -9.0), (False, -5.0)], "ok boolean, proxy double")
    prev = spark.createDataFrame([(0.07, 0.028)], "test_prev double, train_prev double")
    rows, test_weight = weights.rule_weights(cal, prev, F.col("ok"), F.col("proxy"), -6.0)
    got = [r["w"] for r in rows.collect()]
    assert got == pytest.approx([0.07 / 0.028, 0.93 / 0.972, 0.0])
    assert [r["supported"] for r in rows.collect()] == [True, True, False]
    assert test_weight.first()[0] == pytest.approx(0.07 * 0.07 / 0.028 + 0.93 * 0.93 / 0.972)
    with pytest.raises(weights.WeightError):
        weights.require_prevalences(spark.createDataFrame([(0.0, 0.5)], "test_prev double, train_prev double"))


def test_odds_are_clipped(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "p double")
    rows, _ = weights.odds_weights(df, "p")
    got = [r["w"] for r in rows.collect()]
    assert got[1] == 1.0 and got[0] == pytest.approx(1e-6, rel=1e-5) and got[2] == pytest.approx(1e6, rel=1e-5)


def test_effective_size_bounds(spark):
    assert weights.effective_size(frame(spark, [2.0] * 50)).first()["n_eff"] == pytest.approx(50)
    row = weights.effective_size(frame(spark, [0.0] * 9 + [1.0])).first()
    assert row["n_eff"] == pytest.approx(1) and row["n_over_neff"] == pytest.approx(10)
    empty = weights.effective_size(frame(spark, [0.0, 0.0])).first()
    assert empty["n_eff"] == 0.0 and empty["n_over_neff"] == math.inf


@pytest.mark.parametrize("shape", [0.1, 0.7, 1.2])
def test_tail_index_of_pareto_draws(spark, shape):
    u = RNG.uniform(size=10000)
    assert khat(spark, 1.0 + ((1 - u) ** (-shape) - 1) / shape) == pytest.approx(shape, abs=0.12)


def test_bounded_tail_is_negative(spark):
    assert khat(spark, RNG.uniform(size=4000)) < -0.5


def test_degenerate_tails(spark):
    assert math.isnan(khat(spark, [1.0] * 39))
    assert khat(spark, [2.0] * 100) == -math.inf
    assert khat(spark, [1.0] * 300 + [5.0] * 60) == -math.inf
    assert weights.pareto_khat(frame(spark, [2.0] * 100)).first()["band"] == "stable"


def test_clip_only_when_the_tail_asks_for_it(spark):
    calm = RNG.uniform(0.5, 1.5, size=500)
    rows, row = weights.conditional_clip(frame(spark, calm))
    got = row.first()
    assert not got["clipped"] and got["bias"] == 0.0 and got["bound"] == math.inf
    assert rows.filter("w <> w_used").count() == 0
    wild = (1 - RNG.uniform(size=500)) ** -1.3
    rows, row = weights.conditional_clip(frame(spark, wild))
    got = row.first()
    bound = np.quantile(wild, 0.99)
    assert got["clipped"] and got["bound"] == pytest.approx(bound)
    assert got["clipped_share"] == pytest.approx(np.mean(wild > bound))
    assert got["bias"] == pytest.approx(1 - np.mean(np.minimum(wild, bound) / wild.mean()))
    assert rows.agg(F.max("w_used")).first()[0] == pytest.approx(bound)


def test_summary_quantiles(spark):
    w = RNG.gamma(2.0, size=101)
    row = weights.weight_summary(frame(spark, w)).first()
    assert row["q25"] == pytest.approx(np.percentile(w, 25)) and row["max_share"] == pytest.approx(w.max() / w.sum())


def test_balance(spark):
    x, w = RNG.normal(size=200), RNG.uniform(size=200)
    df = spark.createDataFrame([(float(a), float(b), 1.0) for a, b in zip(x, w)], "x double, w double, flat double")
    got = {r["covariate"]: r["asmd"] for r in weights.balance(df, ["x", "flat"]).collect()}
    assert got["x"] == pytest.approx(abs(np.average(x, weights=w) - x.mean()) / x.std(ddof=1))
    assert got["flat"] == 0.0


def test_gamma(spark):
    a = RNG.uniform(0.5, 2, size=60)
    df = spark.createDataFrame([(float(v), float(3 * v)) for v in a], "r double, o double")
    assert weights.gamma_divergence(df, "r", "o").first()["gamma"] == pytest.approx(1.0)
    b = RNG.uniform(0.5, 2, size=60)
    a[:5] = 0.0
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "r double, o double")
    m = a > 0
    x, y = a[m] / a[m].mean(), b[m] / b[m].mean()
    assert weights.gamma_divergence(df, "r", "o").first()["gamma"] == pytest.approx(np.maximum(x / y, y / x).max())


def test_positivity(spark):
    df = spark.createDataFrame([(True, True), (False, True), (False, False)], "ok boolean, high boolean")
    row = weights.positivity(df, F.col("ok"), F.col("high")).first()
    assert (row["n_supported"], row["n_unsupported"], row["unsupported_high"]) == (1, 2, 1)
