import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitcal.functions import exact, normal_cdf
from unitcal.operators import hypothesis_tests, ordered, resample

RNG = np.random.default_rng(3)


def direct_binomial(k, n, p):
    pmf = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
    return min(1.0, sum(v for v in pmf if v <= pmf[k] * (1 + 1e-7)))


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.5), (3, 20, 0.9), (17, 20, 0.9), (148, 148, 0.5), (45, 60, 0.8), (5, 10, 0.5)])
def test_two_sided_binomial(k, n, p):
    assert exact.binomial_two_sided(k, n, p) == pytest.approx(direct_binomial(k, n, p), rel=1e-9)


def test_tiny_p_values_keep_their_size():
    assert exact.binomial_two_sided(0, 148, 0.5) == pytest.approx(2 * 0.5**148, rel=1e-9)


def test_exact_bounds():
    lo, hi = exact.clopper_pearson_bounds(20, 20, 0.95)
    assert hi == 1.0 and lo == pytest.approx(0.025 ** (1 / 20), rel=1e-9)
    lo, hi = exact.clopper_pearson_bounds(0, 30, 0.95)
    assert lo == 0.0 and hi == pytest.approx(1 - 0.025 ** (1 / 30), rel=1e-9)
    lo, hi = exact.clopper_pearson_bounds(7, 40, 0.95)
    tail = sum(math.comb(40, i) * lo**i * (1 - lo) ** (40 - i) for i in range(7, 41))
    assert tail == pytest.approx(0.025, rel=1e-8)


def test_normal_cdf(spark):
    z = np.linspace(-9, 9, 181)
    df = spark.createDataFrame([(float(v),) for v in z], "z double")
    got = [r[0] for r in df.select(normal_cdf(F.col("z"))).collect()]
    want = [0.5 * math.erfc(-v / math.sqrt(2)) for v in z]
    assert np.allclose(got, want, rtol=1e-10, atol=1e-14)


@pytest.mark.parametrize("mode", ["exact", "poisson"])
@pytest.mark.parametrize("fast", [False, True])
def test_interval_width_matches_normal_theory(spark, mode, fast):
    x = RNG.normal(10.0, 2.0, size=400)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "unit long, x double")
    row = resample.bootstrap_means(df, "unit", {"m": F.col("x")}, n_replicates=400, mode=mode, fast=fast).first()
    theory = 2 * 1.96 * x.std() / math.sqrt(400)
    assert row["m"] == pytest.approx(x.mean())
    assert row["m_lo"] < x.mean() < row["m_hi"]
    assert (row["m_hi"] - row["m_lo"]) == pytest.approx(theory, rel=0.2)


def test_exact_mode_draws_n_whole_units(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(37)], "unit long, x double")
    reps = resample.replicates(df, "unit", {"x": F.col("x")}, 50, mode="exact")
    assert {r["n_drawn"] for r in reps.collect()} == {37} and reps.count() == 50


def test_same_seed_same_replicates_on_any_layout(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(60)], "unit long, x double")
    run = lambda d, s, mode: sorted(map(tuple, resample.replicates(d, "unit", {"x": F.col("x")}, 20, s, mode=mode).collect()))
    for mode in ("exact", "poisson"):
        assert run(df, 1, mode) == run(df.repartition(5), 1, mode)
        assert run(df, 1, mode) != run(df, 2, mode)


def test_poisson_counts_have_mean_and_variance_one(spark):
    draws = spark.range(20000).select(resample.poisson_count(F.expr("conv(substring(md5(cast(id as string)), 1, 8), 16, 10)").cast("bigint")).alias("c"))
    row = draws.agg(F.avg("c").alias("m"), F.var_samp("c").alias("v")).first()
    assert row["m"] == pytest.approx(1.0, abs=0.03) and row["v"] == pytest.approx(1.0, abs=0.05)


def test_undefined_replicates_are_counted(spark):
    # one high unit among ten: about a third of the replicates have none
    df = spark.createDataFrame([(i, -5.0 if i == 0 else -9.0, -5.0 if i == 0 else -9.0) for i in range(10)], "unit long, y double, p double")
    row = resample.bootstrap_score(df, "unit", "y", "p", n_replicates=200, mode="exact").first()
    assert 40 < row["loss_undefined"] < 110 and row["f_beta_undefined"] == 0
    none = df.withColumn("y", F.lit(-9.0))
    bounds = resample.bootstrap_score(none, "unit", "y", "p", n_replicates=40, mode="exact")
    assert math.isnan(bounds.first()["loss_lo"]) and bounds.first()["loss_undefined"] == 40
    with pytest.raises(resample.ResampleError):
        resample.require_defined(bounds, "loss")


def test_zero_width_is_flagged_but_exact_bounds_are_not_fooled(spark):
    df = spark.createDataFrame([(i, True) for i in range(5)], "unit long, ok boolean")
    row = resample.proportion_bounds(df, F.col("ok"), n_replicates=100).first()
    assert row["degenerate"] and row["boot_half_pp"] == 0.0 and row["cp_half_pp"] > 20


def test_coverage_law(spark):
    df = spark.createDataFrame([(8,), (99,), (1000,)], "n long")
    law = resample.coverage_law(F.col("n"), 0.1)
    rows = df.select("n", *[c.alias(k) for k, c in law.items()]).collect()
    assert rows[0]["infeasible"] and rows[0]["beta_a"] is None
    assert (rows[1]["beta_a"], rows[1]["beta_b"]) == (90.0, 10.0)
    a, b = 901.0, 100.0
    assert rows[2]["calibration_sd_pp"] == pytest.approx(100 * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))))


def test_running_totals_equal_a_plain_window(spark):
    v = RNG.integers(0, 40, size=900)
    df = spark.createDataFrame([("a" if i % 3 else "b", int(x)) for i, x in enumerate(v)], "k string, v int")
    got = {(r["k"], r["v"]): (r["n"], r["cum_n"], r["all_n"]) for r in ordered.running_totals(df, "v", {"n": F.lit(1)}, ["k"]).collect()}
    for k in "ab":
        values = np.sort([x for i, x in enumerate(v) if ("a" if i % 3 else "b") == k])
        for x in np.unique(values):
            assert got[k, int(x)] == ((values == x).sum(), (values <= x).sum(), len(values))


def test_running_totals_with_a_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 1.0)], "k string, v double")
    rows = ordered.running_totals(df, "v", {"n": F.lit(1)}, ["k"]).collect()
    assert len(rows) == 3 and max(r["cum_n"] for r in rows) == 2


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_quantiles_interpolate(spark, n):
    x = RNG.normal(size=n)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    row = ordered.quantiles(df, "x", {"a": 0.1, "b": 0.5, "c": 0.99}).first()
    assert [row["a"], row["b"], row["c"]] == pytest.approx(np.quantile(x, [0.1, 0.5, 0.99]).tolist())


def test_two_sample_against_brute_force(spark):
    a, b = RNG.integers(0, 12, size=80).astype(float), RNG.integers(2, 15, size=60).astype(float)
    df = spark.createDataFrame([(float(v), False) for v in a] + [(float(v), True) for v in b], "v double, second boolean")
    row = hypothesis_tests.two_sample(df, "v", F.col("second")).first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    grid = np.unique(np.concatenate([a, b]))
    ks = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    assert row["u"] == pytest.approx(u) and row["ks"] == pytest.approx(ks)
    assert row["auc"] == pytest.approx(1 - u / (80 * 60))
    assert row["median_one"] == np.median(a) and row["median_two"] == np.median(b)
    assert 0 <= row["mw_p"] <= 1 and 0 <= row["ks_p"] <= 1


def test_signed_rank_and_correlations(spark):
    d = np.round(RNG.normal(0.3, 1.0, size=90), 1)
    other = d + np.round(RNG.normal(size=90), 1)
    df = spark.createDataFrame(list(zip(d.tolist(), other.tolist())), "d double, o double")
    row = hypothesis_tests.signed_rank(df, "d").first()
    nz = d[np.abs(d) > 1e-8]
    ranks = {v: np.mean(np.flatnonzero(np.sort(np.abs(nz)) == v)) + 1 for v in np.unique(np.abs(nz))}
    plus = sum(ranks[abs(v)] for v in nz if v > 0)
    assert row["n_nonzero"] == len(nz)
    assert row["w"] == pytest.approx(min(plus, len(nz) * (len(nz) + 1) / 2 - plus))
    c = hypothesis_tests.correlations(df, "d", "o").first()

    def rank(x):
        s = np.sort(x)
        return np.array([np.mean(np.flatnonzero(s == v)) for v in x])

    assert c["pearson"] == pytest.approx(np.corrcoef(d, other)[0, 1])
    assert c["spearman"] == pytest.approx(np.corrcoef(rank(d), rank(other))[0, 1])


def test_poisson_sums_equal_plain_sums(spark):
    """Groups, missing values and a part without values, on several layouts."""
    rows = [(i, ("a", "b", None)[i % 3], float(i % 7) if i % 5 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "unit long, grp string, x double").withColumn("none", F.lit(None).cast("double"))
    want = {}
    for i, g, x in rows:
        for block in range(3):
            digest = hashlib.md5(f"42:{block}:{i}".encode()).digest()
            for slot in range(4):
                draw, r = int.from_bytes(digest[4 * slot:4 * slot + 4], "big"), 4 * block + slot
                times = sum(draw >= s for s in resample.poisson_steps())
                cell = want.setdefault((g, r), [0, 0.0])
                cell[0] += times
                cell[1] += times * (x or 0.0)
    for parts in (1, 6):
        got = resample.replicates(df.repartition(parts), "unit", {"x": F.col("x"), "none": F.col("none")}, 10, by=["grp"]).collect()
        assert {(r["grp"], r["replicate"]): [r["n_drawn"], r["x"]] for r in got} == {k: v for k, v in want.items() if k[1] < 10}
        assert all(r["none"] is None for r in got)


def test_many_groups_are_sent_in_parts(spark, monkeypatch):
    df = spark.range(900).select(F.col("id").alias("unit"), (F.col("id") % 300).alias("g"), F.lit(1.0).alias("x"))
    got = resample.replicates(df, "unit", {"x": F.col("x")}, 5, by=["g"]).collect()
    assert len(got) == 1500 and all(r["n_drawn"] == r["x"] for r in got)


@pytest.mark.parametrize("k, n", [(1, 3), (7, 20), (300, 310), (5, 40_000), (0, 9), (9, 9)])
def test_binomial_draws_follow_their_law(k, n):
    u = (np.arange(20_000) + 0.5) / 20_000
    got = resample.binomial_draws(k, n, u)
    assert got.mean() == pytest.approx(k, rel=2e-3, abs=1e-3) and got.var() == pytest.approx(k * (1 - k / n), rel=2e-2, abs=1e-9)
    if n <= 20:
        p = k / n
        law = np.cumsum([math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)])
        assert got.tolist() == [int(np.argmax(law >= v)) for v in u]


def test_shares_agree_with_drawn_units(spark):
    df = spark.range(400).select(F.col("id").alias("unit"), (F.col("id") % 5 == 0).alias("ok"))
    row = resample.share_bounds(df, F.col("ok")).first()
    other = resample.bootstrap_means(df, "unit", {"share": F.col("ok").cast("int")}, mode="exact").first()
    assert (row["n_units"], row["k"], row["share"]) == (400, 80, 0.2)
    assert abs(row["share_lo"] - other["share_lo"]) < 0.01 and abs(row["share_hi"] - other["share_hi"]) < 0.01
    none = resample.share_bounds(df.limit(0), F.col("ok")).first()
    assert none["n_units"] == 0 and math.isnan(none["share_lo"]) and none["share_undefined"] == 2000


def test_exact_draws_across_stretches_and_groups(spark, monkeypatch):
    """groups (one is NULL), missing values and several stretches give the sums of the named draws, without a broadcast."""
    monkeypatch.setattr(resample, "STRETCH", 16)
    rows = [(i, ("a", "b", None)[i % 3], float(i % 7) if i % 5 else None) for i in range(150)]
    df = spark.createDataFrame(rows, "unit long, grp string, x double").withColumn("none", F.lit(None).cast("double"))
    want = {}
    for g in ("a", "b", None):
        values = [x for _, h, x in rows if h == g]
        for r in range(10):
            cell = want.setdefault((g, r), [0, 0.0])
            for j in range(len(values)):
                digest = hashlib.md5(f"42:{r // 2}:{j}".encode()).digest()
                at = int.from_bytes(digest[8 * (r % 2):8 * (r % 2) + 8], "big") % len(values)
                cell[0] += 1
                cell[1] += values[at] or 0.0
    reps = resample.replicates(df, "unit", {"x": F.col("x"), "none": F.col("none")}, 10, by=["grp"], mode="exact")
    got = reps.collect()
    assert {(r["grp"], r["replicate"]): [r["n_drawn"], r["x"]] for r in got} == want
    assert all(r["none"] is None for r in got)


@pytest.mark.parametrize("n", [20_000])
def test_exact_draws_are_never_broadcast(spark, n):
    """the rows of all replicates were planned at the size of the units and broadcast."""
    df = spark.range(n).select(F.col("id").alias("unit"), F.lit(1.0).alias("x"))
    reps = resample.replicates(df, "unit", {"x": F.col("x")}, 40, mode="exact")
    plan = reps._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan
    assert {r["n_drawn"] for r in reps.collect()} == {n}


def test_shares_of_drawn_units(spark):
    """F7, F8: with a unit the bounds are those of every unit's own draws; groups without a flag stay, undefined."""
    rows = [(i, "a" if i % 2 else None, i % 5 == 0) for i in range(200)] + [(300, "none", None)]
    df = spark.createDataFrame(rows, "unit long, grp string, ok boolean")
    got = {r["grp"]: r for r in resample.proportion_bounds(df, F.col("ok"), ["grp"], n_replicates=60, unit="unit").collect()}
    for g in ("a", None):
        own = [(i, ok) for i, h, ok in rows if h == g]
        shares = []
        for r in range(60):
            times = []
            for i, _ in own:
                digest = hashlib.md5(f"42:{r // 4}:{i}".encode()).digest()
                draw = int.from_bytes(digest[4 * (r % 4):4 * (r % 4) + 4], "big")
                times.append(sum(draw >= s for s in resample.poisson_steps()))
            shares.append(sum(t for t, (_, ok) in zip(times, own) if ok) / sum(times))
        assert (got[g]["n_units"], got[g]["k"]) == (100, 20)
        assert [got[g]["share_lo"], got[g]["share_hi"]] == pytest.approx(np.quantile(shares, [0.025, 0.975]).tolist())
    assert got["none"]["n_units"] == 0 and math.isnan(got["none"]["share_lo"]) and got["none"]["share_undefined"] == 60


@pytest.mark.parametrize("name", ["proportion_bounds", "prevalence"])
def test_share_queries_draw_units(name):
    """F7, F8: the SQL draws every unit and not one number per group."""
    from unitcal.plans.catalog import CATALOG

    assert "':' || unit)" in CATALOG[name].sql and "lgamma(i + 1) - lgamma(n - i + 1) + i * ln(k / n)" not in CATALOG[name].sql
