import numpy as np
import pytest
from pyspark.sql import functions as F

from unitcal.operators import discriminant

RNG = np.random.default_rng(23)
COLUMNS = ["a", "b", "c", "same"]


def sample(n, shift, start):
    a, b = RNG.normal(size=n) + shift, RNG.exponential(size=n)
    c = 0.7 * a + RNG.normal(size=n)
    return [
        (start + i, float(x), float("nan") if i % 11 == 0 else float(y), None if i % 7 == 0 else float(z), 5.0)
        for i, (x, y, z) in enumerate(zip(a, b, c))
    ]


def plain_newton(rows, y):
    """The regression on a matrix, by Newton steps from zero."""
    x = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows], float)
    x = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    scale = x.std(axis=0)
    z = np.column_stack([np.ones(len(x)), (x - x.mean(axis=0)) / np.where(scale > 0, scale, 1.0)])
    ridge = np.diag([0.0] + [1.0] * (z.shape[1] - 1))
    beta = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve((z.T * (p * (1 - p))) @ z + ridge, z.T @ (p - y) + ridge @ beta)
    return 1 / (1 + np.exp(-z @ beta))


@pytest.fixture(scope="module")
def samples(spark):
    one, two = sample(300, 0.0, 0), sample(200, 0.8, 1000)
    schema = "unit long, a double, b double, c double, same double"
    return one, two, spark.createDataFrame(one, schema).repartition(4), spark.createDataFrame(two, schema).repartition(3)


def test_equals_plain_newton(samples):
    one, two, cal, test = samples
    want = dict(zip((r[0] for r in one + two), plain_newton(one + two, np.array([0.0] * len(one) + [1.0] * len(two)))))
    scored, auc = discriminant.discriminator(cal, test, COLUMNS)
    rows = scored.collect()
    assert len(rows) == len(one) and scored.columns == [*cal.columns, "p_test"]
    assert max(abs(r["p_test"] - want[r["unit"]]) for r in rows) < 1e-8
    p0, p1 = np.array([want[r[0]] for r in one]), np.array([want[r[0]] for r in two])
    assert auc.first()[0] == pytest.approx(np.mean((p1[None] > p0[:, None]) + 0.5 * (p1[None] == p0[:, None])))


def test_separated_samples_stay_finite(spark):
    rows = [(float(i), float(i >= 50)) for i in range(100)]
    fit = discriminant.fit_logistic(spark.createDataFrame(rows, "a double, y double"), ["a"], "y")
    assert np.isfinite(fit.coefficients).all() and fit.coefficients[1] > 1 and fit.steps < 100


def test_one_sample_is_an_error(samples):
    _, _, cal, test = samples
    with pytest.raises(discriminant.DiscriminantError):
        discriminant.discriminator(cal, test.limit(0), COLUMNS)


def test_medians_are_exact(spark):
    rows = [(float(v), None) for v in (9, 1, 4)] + [(None, None), (float("nan"), None), (2.0, None)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert discriminant.pooled_medians(df, ["a", "b"]) == {"a": 3.0, "b": 0.0}


def test_build_weights(samples, spark):
    _, _, cal, test = samples
    prev = spark.createDataFrame([(0.3, 0.2)], "test_prev double, train_prev double")
    built = discriminant.build_weights(cal, test, COLUMNS[:2], prev, F.col("unit") % 2 == 0, F.col("a"), 0.5)
    rows = built.rows.collect()
    odds = np.array([r["p_test"] / (1 - r["p_test"]) for r in rows])
    rule = np.array([(r["unit"] % 2 == 0) * (0.3 / 0.2 if r["a"] >= 0.5 else 0.7 / 0.8) for r in rows])
    assert [r["w_classifier"] for r in rows] == pytest.approx(odds.tolist())
    assert [r["w_rule"] for r in rows] == pytest.approx(rule.tolist())
    found = built.summary.first()
    x, y = rule[rule > 0] / rule[rule > 0].mean(), odds[rule > 0] / odds[rule > 0].mean()
    assert found["gamma_divergence"] == pytest.approx(np.maximum(x / y, y / x).max())
    assert found["rule_n"] == len(rows) and found["rule_n_effective"] == pytest.approx(rule.sum() ** 2 / (rule**2).sum())
    assert found["classifier_n_effective"] == pytest.approx(odds.sum() ** 2 / (odds**2).sum())
    assert 0.5 < found["classifier_auc"] < 1 and built.classifier_test.first()[0] == pytest.approx(odds.mean())
