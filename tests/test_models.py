import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitcal.operators import models

RNG = np.random.default_rng(17)
COLUMNS = ["a", "b"]


@pytest.fixture(scope="module")
def data(spark):
    a, b = RNG.normal(size=600), RNG.normal(size=600)
    y = 3 * a + b**2 + RNG.normal(scale=0.3, size=600)
    rows = [(i, float(p) if i % 19 else None, float(q), float(t)) for i, (p, q, t) in enumerate(zip(a, b, y))]
    df = spark.createDataFrame(rows, "unit long, a double, b double, y double")
    return df.filter("unit < 400").cache(), df.filter("unit >= 400 AND unit < 500").cache(), df.filter("unit >= 500").cache()


def predictions(data, seed):
    fit, val, test = data
    model = models.fit_boosted(fit, val, COLUMNS, "y", seed, maxIter=8)
    return model, models.predict(model, test, keep=("unit", "y")).orderBy("unit").collect()


def test_boosting_learns_and_follows_its_seed(data, spark):
    model, one = predictions(data, 1)
    _, again = predictions(data, 1)
    _, other = predictions(data, 2)
    assert [r["yhat"] for r in one] == [r["yhat"] for r in again]
    assert [r["yhat"] for r in one] != [r["yhat"] for r in other]
    y = np.array([r["y"] for r in one])
    assert np.mean((y - [r["yhat"] for r in one]) ** 2) < 0.4 * y.var()
    top = models.feature_importance(model, COLUMNS, spark).collect()
    assert top[0]["feature"] == "a" and top[0]["importance"] >= top[1]["importance"]


def test_quantile_heads_are_ordered_and_beat_the_unconditional(data):
    fit, _, test = data
    model, leaves = models.fit_quantile_tree(fit, COLUMNS, "y", (0.1, 0.5, 0.9))
    out = models.predict_quantiles(model, leaves, test)
    assert models.crossing_rate(out, ["q_10", "q_50", "q_90"]).first()[0] == 0.0
    flat = {q: float(np.quantile([r["y"] for r in fit.select("y").collect()], q)) for q in (0.1, 0.5, 0.9)}
    out = out.withColumns({f"f_{round(q * 100)}": F.lit(v) for q, v in flat.items()})
    head = models.pinball_loss(out, "y", {0.1: "q_10", 0.5: "q_50", 0.9: "q_90"}).agg(F.avg("pinball")).first()[0]
    base = models.pinball_loss(out, "y", {0.1: "f_10", 0.5: "f_50", 0.9: "f_90"}).agg(F.avg("pinball")).first()[0]
    assert head < base


def test_discriminator_sees_a_shift(spark, data):
    fit, _, test = data
    shifted = test.withColumn("a", F.col("a") + 2.0)
    cal, auc = models.discriminator(fit.select("unit", *COLUMNS), shifted.select("unit", *COLUMNS), COLUMNS)
    assert auc.first()[0] > 0.85 and cal.count() == 400
    assert cal.filter("p_test <= 0 OR p_test >= 1").count() == 0


def test_search_budget_and_determinism(data):
    fit, val, _ = data
    table, best = models.search_boosted(fit, val, COLUMNS, "y", trials=2, seed=5, max_iter=2)
    rows = table.collect()
    assert len(rows) == 2 and set(best) == set(models.SEARCH_GRID)
    assert models.sample_params(4, 5) == models.sample_params(4, 5) != models.sample_params(4, 6)


def test_predictive_distribution(spark):
    samples = spark.createDataFrame(
        [(u, s, float(v)) for u in range(3) for s, v in enumerate([1.0 + u, 3.0 + u, 5.0 + u])], "unit long, sample_id int, yhat double"
    )
    noise = spark.createDataFrame([(1.5,)], "aleatoric_sd double")
    dist = models.predictive(models.sample_moments(samples, "unit"), noise)
    row = dist.filter("unit = 0").first()
    assert row["mean"] == 3.0 and row["epistemic_sd"] == 2.0 and row["sd"] == 2.5
    iv = models.gaussian_intervals(dist, [0.9]).filter("unit = 0").first()
    assert iv["hi"] == pytest.approx(3.0 + 1.6448536269514722 * 2.5)
    emp = models.empirical_intervals(samples, "unit", noise, [0.9]).filter("unit = 0").first()
    assert emp["lo"] == pytest.approx(np.percentile([1, 3, 5], 5) - 1.6448536269514722 * 1.5)
    with pytest.raises(models.ModelError):
        models.require_samples(models.sample_moments(samples.filter("sample_id = 0"), "unit"))
    with pytest.raises(models.ModelError):
        models.require_residuals(models.aleatoric_sd(samples.limit(1).withColumn("y", F.lit(1.0)), "y", "yhat"))


def test_calibrated_distribution_passes_its_audit(spark):
    y = RNG.normal(size=1500)
    df = spark.createDataFrame([(i, float(v), 0.0, 1.0, "m", 1) for i, v in enumerate(y)], "unit long, y double, mean double, sd double, method string, seed int")
    curve, pit = models.coverage_audit(df, "y")
    for r in curve.collect():
        assert abs(r["gap_pp"]) < 3 and r["binomial_p"] > 0.001
    assert pit.first()["ks_p"] > 0.01
    assert models.coverage_objective(curve).first()[0] < 0.03
    narrow = models.coverage_audit(df.withColumn("sd", F.lit(0.5)), "y")[0]
    assert all(r["gap_pp"] < -10 and r["binomial_p"] < 1e-6 for r in narrow.collect())


def test_empirical_pit(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (1, 5.0, 5.0), (1, 9.0, 5.0), (1, 8.0, 5.0)], "unit long, yhat double, y double")
    assert models.empirical_pit(df, "unit", "y").first()["pit"] == 0.5
    assert math.isclose(models.normal_quantile(0.975), 1.959963984540054, rel_tol=1e-12)


def test_moments_of_variants_read_the_samples_once(spark):
    rows = spark.createDataFrame(
        [(u, float(u * 7 + i * i), u * 2.0, "train" if u % 2 else "test") for u in range(12) for i in range(u % 4 + 1)],
        "unit long, yhat double, target double, split string",
    )
    variants = [({"method": m, "seed": s}, F.col("yhat") * k) for m, s, k in (("a", 1, 1.0), ("a", 2, 1.5), ("b", 1, 2.0))]
    got = models.moments_of_variants(rows, "unit", variants, ("target", "split"))
    copies = None
    for keys, yhat in variants:
        one = rows.withColumns({**{k: F.lit(v) for k, v in keys.items()}, "yhat": yhat})
        copies = one if copies is None else copies.unionByName(one)
    want = models.sample_moments(copies, "unit", ["method", "seed"], ("target", "split"))
    order = ["unit", "method", "seed"]
    assert [tuple(r) for r in got.select(want.columns).orderBy(order).collect()] == [
        tuple(r) for r in want.orderBy(order).collect()
    ]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(unit") == 1 and "Union" not in plan
