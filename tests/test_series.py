import pytest
from pyspark.sql import functions as F

from unitcal.operators import series
from unitcal.roles import SeriesSpec

SPEC = SeriesSpec()


@pytest.fixture(scope="module")
def small(spark):
    rows = [
        # unit, ttr, tie, value, grp
        ("a", 5.0, 1, 1.0, "x"), ("a", 3.0, 2, 2.0, "x"), ("a", 2.0, 3, 3.0, "x"), ("a", 2.0, 4, 4.0, "x"), ("a", 0.5, 5, 9.0, "x"),
        ("b", 1.5, 6, 7.0, "y"), ("b", 0.2, 7, 8.0, "y"),
        ("c", 4.0, 8, 6.0, "y"), ("c", 2.5, 9, None, "y"), ("c", 1.0, 10, 5.0, "y"),
    ]
    return spark.createDataFrame(rows, "unit string, ttr double, tie long, value double, grp string")


def as_dict(df, key="unit"):
    return {r[key]: r for r in df.collect()}


def test_order_index_and_count(small):
    rows = {(r["unit"], r["tie"]): r for r in series.order_messages(small, SPEC).collect()}
    assert [rows["a", t]["msg_index"] for t in (1, 2, 3, 4, 5)] == [0, 1, 2, 3, 4]
    assert rows["b", 7]["n_msgs"] == 2


def test_huge_units_are_numbered_the_same(small, spark):
    wide = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), (F.col("id") % 40).cast("string"))).alias("unit"),
        (F.col("id") % 17).cast("double").alias("ttr"), F.col("id").alias("tie"), F.lit(1.0).alias("value"), F.lit("g").alias("grp"),
    )
    key = ["unit", "tie", "msg_index", "n_msgs"]
    plain = sorted(map(tuple, series.order_messages(wide, SPEC).select(key).collect()))
    split = sorted(map(tuple, series.order_messages(wide, SPEC, hot_rows=500).select(key).collect()))
    assert plain == split


def test_final_is_last_in_time_then_tie(small):
    got = as_dict(series.final_messages(small, SPEC))
    assert got["a"]["target"] == 9.0 and got["c"]["target_ttr"] == 1.0


def test_as_of_takes_first_of_equal_times_and_never_later_rows(small):
    got = as_dict(series.as_of(small, SPEC, 2.0))
    assert got["a"]["known"] == 3.0
    assert "b" not in got  # no admissible message: absent, not imputed
    assert got["c"]["known"] is None


def test_frame_agrees_with_the_single_operators(small):
    frame = as_dict(series.forecast_frame(small, SPEC, 2.0))
    final, known = as_dict(series.final_messages(small, SPEC)), as_dict(series.as_of(small, SPEC, 2.0))
    for unit, row in frame.items():
        assert row["target"] == final[unit]["target"]
        assert row["known"] == (known[unit]["known"] if unit in known else None)


def test_last_k_prefers_later_ties(small):
    got = {(r["unit"], r["tie"]) for r in series.last_k(series.admissible(small, SPEC, 2.0), SPEC, 2).collect()}
    assert got == {("a", 4), ("a", 3), ("c", 9), ("c", 8)}


def test_eligibility_is_strict_on_recency(spark):
    rows = [("p", 3.0, 1), ("p", 1.0, 2), ("q", 2.0, 3), ("q", 0.9, 4), ("r", 2.0, 5)]
    df = spark.createDataFrame(rows, "unit string, ttr double, tie long")
    assert [r["unit"] for r in series.eligible_units(df, SPEC, 2.0, 1.0).collect()] == ["q"]


def test_last_input_value_skips_missing(small):
    df = series.attach_targets(small, series.final_messages(small, SPEC), SPEC)
    later = df.withColumn("value", F.when((F.col("unit") == "a") & (F.col("ttr") < 1), None).otherwise(F.col("value")))
    assert as_dict(series.unit_frame(later, SPEC, 6.0))["a"]["last_input_value"] == 4.0


def test_missing_target_is_counted_and_raises(small):
    broken = series.attach_targets(small, series.final_messages(small.filter("unit <> 'b'"), SPEC), SPEC)
    assert series.units_without_target(broken, SPEC).first()["n_missing"] == 1
    with pytest.raises(series.SeriesError):
        series.require_targets(broken, SPEC)


def test_empty_admissible_set_raises(small):
    with pytest.raises(series.SeriesError):
        series.require_rows(series.admissible(small, SPEC, 99.0), "admissible messages")


def test_row_order_and_partitioning_do_not_matter(small):
    a = sorted(map(repr, series.forecast_frame(small, SPEC, 2.0).collect()))
    b = sorted(map(repr, series.forecast_frame(small.orderBy(F.rand(3)).repartition(7), SPEC, 2.0).collect()))
    assert a == b


def test_changing_rows_after_the_cutoff_changes_nothing_known(small):
    changed = small.withColumn("value", F.when(F.col("ttr") < 2.0, 1e6).otherwise(F.col("value")))
    a = sorted(map(repr, series.as_of(small, SPEC, 2.0).collect()))
    assert a == sorted(map(repr, series.as_of(changed, SPEC, 2.0).collect()))
