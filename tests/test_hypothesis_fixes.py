"""Cases with a large offset, many groups, and values outside of a range."""

import random
from itertools import product

import numpy as np
import pytest

from unitcal.functions import exact
from unitcal.operators import audit, models
from unitcal.operators.hypothesis_tests import correlations, signed_rank, uniformity


@pytest.mark.parametrize("by", [[], ["g"]])
def test_correlation_far_from_zero(spark, by):
    rng = random.Random(1)
    rows = [("a", 1e9 + x, 1e9 + x + 0.25 * rng.gauss(0, 1)) for x in (rng.gauss(0, 1) for _ in range(2000))]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    n = len(rows)
    mx, my = (sum(r[i] - 1e9 for r in rows) / n for i in (1, 2))
    pairs = [(r[1] - 1e9 - mx, r[2] - 1e9 - my) for r in rows]
    want = sum(x * y for x, y in pairs) / (sum(x * x for x, _ in pairs) * sum(y * y for _, y in pairs)) ** 0.5
    assert correlations(df, "x", "y", by).first().pearson == pytest.approx(want, abs=1e-6)


def test_group_with_many_values_is_a_feature(spark):
    rows = [(float(i % 7), f"g{i % 60}", float(i % 60)) for i in range(1200)]
    df = spark.createDataFrame(rows, "x double, g string, y double")
    model = models.fit_boosted(df, df.limit(100), ["x"], "y", 1, group="g", maxIter=2)
    got = {r.feature: r.importance for r in models.feature_importance(model, ["x"], spark).collect()}
    assert set(got) == {"x", "group_index"}
    assert sum(got.values()) == pytest.approx(1) and got["group_index"] > 0.9


def test_histogram_counts_every_value(spark):
    df = spark.createDataFrame([(v,) for v in (-5.0, 0.0, 1.0, 9.9, 10.0, 10.1, 1e9, None)], "v double")
    got = {r.bin: (r.left_edge, r.n, r.density) for r in audit.histogram(df, "v", 0.0, 10.0, 2).collect()}
    assert got == {0: (None, 1, None), 1: (0.0, 2, 2 / 35), 2: (5.0, 2, 2 / 35), 3: (10.0, 2, None)}


def test_finite_kolmogorov_law_against_simulation_and_known_cases():
    # one draw: P(D >= d) = 2 * (1 - d); two draws: the law is piecewise quadratic
    for d in (0.55, 0.7, 0.9):
        assert exact.kolmogorov_tail(1, d) == pytest.approx(2 * (1 - d), abs=1e-12)
        assert exact.kolmogorov_tail(2, d) == pytest.approx(2 * (1 - d) ** 2, abs=1e-12)
    rng = np.random.default_rng(3)
    for n, d in ((5, 0.4), (20, 0.25), (100, 0.1)):
        x = np.sort(rng.random((100_000, n)), axis=1)
        i = np.arange(n)
        distance = np.maximum((i + 1) / n - x, x - i / n).max(axis=1)
        assert exact.kolmogorov_tail(n, d) == pytest.approx((distance >= d).mean(), abs=0.006)


def test_exact_signed_ranks_are_all_sign_patterns(spark):
    deltas = [0.3, -1.2, 2.5, 0.7, -0.1, 4.0, 3.3]
    ranks = {v: i + 1 for i, v in enumerate(sorted(map(abs, deltas)))}
    w = min(sum(ranks[abs(v)] for v in deltas if (v > 0) == up) for up in (True, False))
    sums = [sum(r for r, up in zip(ranks.values(), signs) if up) for signs in product([0, 1], repeat=len(deltas))]
    got = signed_rank(spark.createDataFrame([(v,) for v in deltas], "d double"), "d", exact_up_to=50).first()
    assert (got.n_nonzero, got.w) == (7, w)
    assert got.wilcoxon_p == pytest.approx(min(1.0, 2 * sum(s <= w for s in sums) / len(sums)))


def test_uniformity_uses_the_finite_law_up_to_a_size(spark):
    df = spark.createDataFrame([(v,) for v in (0.1, 0.35, 0.4, 0.8, 0.85)], "v double")
    small, large = uniformity(df, "v", exact_up_to=140).first(), uniformity(df, "v", exact_up_to=4).first()
    assert small.ks == large.ks and small.ks_p == pytest.approx(exact.kolmogorov_tail(5, small.ks))
    assert small.ks_p != pytest.approx(large.ks_p, abs=1e-3)
    assert uniformity(df.limit(0), "v", exact_up_to=140).count() <= 1


def test_uniformity_of_values_outside_the_unit_interval(spark, tmp_path):
    """a value far beyond 1 was cut to 1, the SQL of the query takes it as it is."""
    duckdb = pytest.importorskip("duckdb")
    from unitcal.plans.catalog import CATALOG

    values = [4.91, 30.0, 120.5, 333.25, 490.0, 980.0, -700.0]
    rows = [("a", v) for v in values[:6]] + [("b", v) for v in values[:5]] + [("c", v) for v in values]
    spark.createDataFrame(rows, "event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(CATALOG["uniformity"].sql).fetchall())
    assert sorted(map(tuple, CATALOG["uniformity"].run(spark, str(tmp_path)).collect())) == want
