import math
import statistics

import pytest
from pyspark.sql import functions as F

from unitcal.operators import features
from unitcal.roles import SeriesSpec

SPEC = SeriesSpec()
POLICY = {"x": "safe", "value": "unsafe", "z": "ambiguous"}


@pytest.fixture(scope="module")
def messages(spark):
    rows = [
        ("a", 6.0, 1, 10.0, 100.0, "g"), ("a", 5.0, 2, 1.0, 2.0, "g"), ("a", 4.0, 3, None, 4.0, "g"),
        ("a", 3.0, 4, 7.0, 8.0, "g"), ("a", 1.0, 5, 99.0, 99.0, "g"), ("b", 1.0, 6, 3.0, 3.0, "h"),
        ("c", 2.0, 7, 5.0, float("nan"), "h"),
    ]
    return spark.createDataFrame(rows, "unit string, ttr double, tie long, value double, x double, grp string")


def build(df, **kw):
    return features.tabular_features(df, SPEC, POLICY, 2.0, k=3, hard_excluded=("value",), **kw)


def test_summaries(messages):
    rows = {r["unit"]: r for r in build(messages).collect()}
    a = rows["a"]
    assert (a["x_last"], a["x_min"], a["x_max"], a["x_delta"]) == (8.0, 2.0, 8.0, 6.0)
    assert a["x_std"] == pytest.approx(statistics.stdev([2.0, 4.0, 8.0]))
    assert (a["value_last"], a["value_mean"], a["value_delta"]) == (7.0, 4.0, 6.0)
    assert (a["n_admissible"], a["window_span"], a["last_admissible_ttr"]) == (3, 2.0, 3.0)
    assert "b" not in rows
    assert rows["c"]["x_last"] is None and rows["c"]["value_std"] is None


def test_last_is_last_known(spark, messages):
    hidden = messages.withColumn("x", F.when(F.col("tie") == 4, None).otherwise(F.col("x")))
    a = {r["unit"]: r for r in build(hidden).collect()}["a"]
    assert a["x_last"] == 4.0 and a["x_delta"] == 2.0


def test_rows_after_the_cutoff_cannot_matter(messages):
    changed = messages.withColumns({
        c: F.when(F.col("ttr") < 2.0, F.lit(-1e9)).otherwise(F.col(c)) for c in ("x", "value")
    })
    assert sorted(map(repr, build(messages).collect())) == sorted(map(repr, build(changed).collect()))


def test_history_needs_the_exclusion(messages):
    with pytest.raises(features.FeatureError):
        features.tabular_features(messages, SPEC, POLICY, 2.0, hard_excluded=())
    assert not [c for c in build(messages, history=False).columns if c.startswith("value_")]


def test_dropped_units_are_counted(messages):
    targets = messages.groupBy("unit").agg(F.lit(1.0).alias("target"))
    rows, dropped = features.align_targets(build(messages), targets, "unit")
    assert dropped.first().asDict() == {"n_units": 3, "n_dropped": 1, "n_bad_target": 0}
    assert rows.count() == 2
    bad = targets.withColumn("target", F.lit(float("nan")))
    with pytest.raises(features.FeatureError):
        features.require_finite_targets(features.align_targets(build(messages), bad, "unit")[1])


def test_padding_order_mask_and_sentinel(messages):
    kept = features.sequence_messages(messages.fillna(0.0), SPEC, ["x", "value"], 2.0, 4)
    rows = {r["unit"]: r for r in features.padded_sequences(kept, SPEC, ["x", "value"], 4).collect()}
    assert rows["a"]["x"][0] == [100.0, 10.0] and rows["a"]["length"] == 4
    assert rows["c"]["mask"] == [True, False, False, False]
    assert rows["c"]["x"][1:] == [[-999.0, -999.0]] * 3


def test_extreme_columns_are_compressed_before_zeros_and_scaling(spark):
    df = spark.createDataFrame([(-1e40, 1.0), (2e40, None), (0.0, 3.0)], "h double, v double")
    assert features.extreme_columns(df, ["h", "v"]) == ["h"]
    out = features.condition(df, ["h"])
    assert [r["h"] for r in out.collect()] == pytest.approx([math.asinh(-1e40), math.asinh(2e40), 0.0])
    filled, n = features.fill_missing(out, ["h", "v"])
    assert n.first()["n_filled"] == 1
    scale = features.standard_scale(filled, ["v"]).first()
    assert scale["mean_v"] == pytest.approx(4 / 3)
    assert scale["sd_v"] == pytest.approx(statistics.pstdev([1.0, 0.0, 3.0]))


def test_flat_column_and_clip(spark):
    df = spark.createDataFrame([(1.0, 0.0)] * 999 + [(1.0, 1e6)], "flat double, spike double")
    scale = features.standard_scale(df, ["flat", "spike"])
    out = features.standardised(df, scale, ["flat", "spike"])
    assert out.agg(F.max("flat")).first()[0] == 0.0
    assert out.agg(F.max("spike")).first()[0] == 20.0


def test_scale_comes_from_fit_units_only(messages, spark):
    fit = spark.createDataFrame([("a",)], "unit string")
    first = features.prepared_sequences(messages, SPEC, ["x", "value"], 2.0, 3, fit)
    other = messages.withColumn("value", F.when(F.col("unit") == "c", 1e5).otherwise(F.col("value")))
    second = features.prepared_sequences(other, SPEC, ["x", "value"], 2.0, 3, fit)
    pick = lambda df: df.filter("unit = 'a'").first()["x"]
    assert pick(first) == pick(second)


def test_alignment_requires_the_same_units(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 3.0)], "unit long, p double")
    b = spark.createDataFrame([(1, 5.0)], "unit long, q double")
    assert features.aligned(a.filter("unit = 1"), b, unit="unit").first().asDict() == {"unit": 1, "p": 2.0, "q": 5.0}
    with pytest.raises(features.FeatureError):
        features.aligned(a, b, unit="unit")
    with pytest.raises(features.FeatureError):
        features.aligned(b, a, unit="unit")


def test_residual_round_trip(spark):
    df = spark.createDataFrame([(5.0, 2.0)], "target double, value_last double")
    base = features.anchor(df, "value_last")
    residual = features.to_model_target(F.col("target"), base, "residual")
    row = df.select(residual.alias("r"), features.from_model_output(residual, base, "residual").alias("back")).first()
    assert (row["r"], row["back"]) == (3.0, 5.0)
    assert df.select(features.anchor(df, None).alias("a")).first()["a"] == 0.0
    with pytest.raises(ValueError):
        features.to_model_target(F.col("target"), base, "log")
