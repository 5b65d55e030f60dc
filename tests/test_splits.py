import pytest
from pyspark.sql import functions as F

from unitcal.operators import splits
from unitcal.sources.cdm import CDM_COLUMNS, CDM_HARD_EXCLUDED, cdm_policy

FRACTIONS = {"fit": 0.6, "calibration": 0.2, "self_test": 0.2}


def units(spark, n=103):
    return spark.range(n).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("unit"))


def sizes(df):
    return {r["subset"]: r["count"] for r in df.groupBy("subset").count().collect()}


def test_sizes_disjoint_and_complete(spark):
    df = splits.split_units(units(spark), "unit", FRACTIONS, 7)
    assert sizes(df) == {"fit": round(0.6 * 103), "calibration": round(0.2 * 103), "self_test": 103 - 62 - 21}
    assert df.select("unit").distinct().count() == 103
    splits.require_disjoint(df, "unit")


def test_same_seed_same_split_whatever_the_layout(spark):
    a = {tuple(r) for r in splits.split_units(units(spark), "unit", FRACTIONS, 7).collect()}
    b = {tuple(r) for r in splits.split_units(units(spark).repartition(9), "unit", FRACTIONS, 7).collect()}
    c = {tuple(r) for r in splits.split_units(units(spark), "unit", FRACTIONS, 8).collect()}
    assert a == b and a != c


def test_half_even_rounding(spark):
    df = splits.split_units(units(spark, 5), "unit", {"x": 0.5, "y": 0.5}, 1)
    assert sizes(df) == {"x": 2, "y": 3}


def test_bad_fractions_raise(spark):
    with pytest.raises(ValueError):
        splits.split_units(units(spark), "unit", {"x": 0.5, "y": 0.4}, 1)


def test_nested_split_keeps_the_outer_subsets(spark):
    outer = splits.split_units(units(spark), "unit", FRACTIONS, 7)
    inner = splits.nested_split(units(spark), "unit", 7)
    got = sizes(inner)
    assert got["fit_inner"] == round(0.8 * 62) and got["fit_inner"] + got["val_inner"] == 62
    same = outer.filter("subset <> 'fit'").join(inner, ["unit", "subset"]).count()
    assert same == 103 - 62


def test_overlap_raises(spark):
    df = splits.split_units(units(spark), "unit", FRACTIONS, 7)
    with pytest.raises(splits.SplitError):
        splits.require_disjoint(df.unionByName(df.limit(1).withColumn("subset", F.lit("other"))), "unit")


def test_strata(spark):
    df = spark.createDataFrame([(-30.0,), (-20.0,), (-15.0,), (-6.0,), (-1.0,), (3.0,)], "v double")
    got = [r[0] for r in df.select(splits.stratum(F.col("v"), -30.0, (-30.0, -15.0, -10.0, -6.0, 0.0))).collect()]
    assert got == [0, 1, 1, 3, 4, None]


def test_stratified_sample_takes_what_there_is(spark):
    df = spark.range(100).select(F.col("id"), F.when(F.col("id") < 3, 0).otherwise(1).alias("s"))
    out = splits.stratified_sample(df, "s", "id", 20, 2, 42)
    got = {r["s"]: (r["count"]) for r in out.groupBy("s").count().collect()}
    assert got == {0: 3, 1: 10}
    assert out.filter("s = 0").first()["take"] == 3


def test_policy_of_the_public_columns():
    classes = splits.classify_columns(cdm_policy(), CDM_HARD_EXCLUDED)
    assert len(CDM_COLUMNS) == 103
    assert classes["hard_excluded"] == ["event_id", "risk"]
    assert classes["ambiguous_excluded"] == ["max_risk_estimate", "max_risk_scaling"]
    assert len(classes["admitted"]) == 99


@pytest.mark.parametrize("name", ["risk", "event_id", "target_log_risk", "max_risk_estimate", "max_risk_estimate_mean", "risk_last"])
def test_barred_columns_raise(name):
    with pytest.raises(splits.FeatureSafetyError, match=name):
        splits.require_safe_features(["miss_distance_last", name], cdm_policy(), CDM_HARD_EXCLUDED)


def test_value_history_is_the_one_exception():
    splits.require_safe_features(["risk_last", "miss_distance_std"], cdm_policy(), CDM_HARD_EXCLUDED, history_of="risk")
    with pytest.raises(splits.FeatureSafetyError):
        splits.require_safe_features(["event_id_last"], cdm_policy(), CDM_HARD_EXCLUDED, history_of="risk")
