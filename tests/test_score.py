import math

import pytest
from pyspark.sql import functions as F

from unitcal.operators import score

TRUTH = [-4.0, -5.0, -6.0, -8.0, -10.0, -20.0]
PRED = [-4.5, -7.0, -5.5, -5.0, -12.0, -30.0]


def pairs(spark, truth, pred):
    return spark.createDataFrame(list(zip(truth, pred)), "y double, p double")


def test_hand_computed_score(spark):
    row = score.point_score(pairs(spark, TRUTH, PRED), "y", "p").first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (2, 1, 1, 2)
    for name in ("precision", "recall", "f_beta"):
        assert row[name] == pytest.approx(2 / 3)
    mse = (0.25 + 1.001**2 + 0.25) / 3
    assert row["mse_high"] == pytest.approx(mse)
    assert row["loss"] == pytest.approx(mse / (2 / 3))
    assert row["defined"]


def test_threshold_is_inclusive(spark):
    row = score.point_score(pairs(spark, [-6.0], [-6.0]), "y", "p").first()
    assert (row["tp"], row["n_high_true"]) == (1, 1)


def test_no_high_truth_is_unscorable(spark):
    row = score.point_score(pairs(spark, [-9.0, -8.0], [-5.0, -9.0]), "y", "p").first()
    assert math.isnan(row["loss"]) and math.isnan(row["mse_high"]) and row["high_empty"] and not row["defined"]


def test_zero_f_score_is_infinite_loss(spark):
    row = score.point_score(pairs(spark, [-5.0, -9.0], [-9.0, -9.0]), "y", "p").first()
    assert row["loss"] == math.inf and row["f_is_zero"] and row["f_beta"] == 0.0


@pytest.mark.parametrize("truth,pred", [([], []), ([math.nan], [1.0]), ([1.0], [math.inf])])
def test_gate(spark, truth, pred):
    df = spark.createDataFrame(list(zip(truth, pred)), "y double, p double")
    with pytest.raises(score.ScoreError):
        score.require_scorable(df, "y", "p")


def test_floored_persistence_differs_from_clip_of_none(spark):
    row = spark.range(1).select(
        score.floored_persistence(F.lit(-6.0), -6.0, 0.001).alias("at"),
        score.floored_persistence(F.lit(-7.0), -6.0, 0.001).alias("below"),
        score.clip_predictions(F.lit(-7.0), -6.0, None).alias("raw"),
    ).first()
    assert (row["at"], row["below"], row["raw"]) == (-6.0, -6.001, -7.0)


def test_promotion_and_sweep(spark):
    df = pairs(spark, [-5.0, -5.5, -20.0, -9.0], [-7.0, -8.0, -12.0, -9.5])
    sweep = score.promotion_sweep(df, "y", "p", [-12.0, -9.0, -7.5, -6.0], -6.0, 0.001)
    rows = {r["tau"]: r for r in sweep.collect()}
    assert rows[-9.0]["n_promoted"] == 2 and rows[-9.0]["tp"] == 2 and rows[-9.0]["fp"] == 0
    assert not rows[-6.0]["defined"]
    assert score.best_promotion(sweep).first()["tau"] == -9.0


def test_promotion_without_defined_loss_raises(spark):
    sweep = score.promotion_sweep(pairs(spark, [-9.0], [-9.0]), "y", "p", [-9.0], -6.0, 0.001)
    best = score.best_promotion(sweep, ["tau"])
    with pytest.raises(score.ScoreError):
        score.require_promotion(best)


def test_seed_summary_uses_the_median_seed(spark):
    df = spark.createDataFrame(
        [("m", 1, 3.0, 2.9, 3.1), ("m", 2, 1.0, 0.9, 1.1), ("m", 3, 2.0, 1.9, 2.1), ("one", 1, 5.0, 4.0, 6.0)],
        "model string, seed int, loss double, loss_lo double, loss_hi double",
    )
    rows = {r["model"]: r for r in score.aggregate_seeds(df, ["model"], ["loss"]).collect()}
    assert rows["m"]["median_seed"] == 3 and rows["m"]["loss_lo"] == 1.9
    assert rows["m"]["loss_sd"] == pytest.approx(1.0)
    assert rows["one"]["loss_sd"] == 0.0


def test_verdicts(spark):
    ours = spark.createDataFrame([("a", "loss", 0.694), ("b", "loss", 0.70), ("c", "loss", 0.9)], "k string, metric string, value double")
    expected = spark.createDataFrame(
        [("a", "loss", 0.6941, None), ("b", "loss", 0.694, None), ("c", "loss", 0.694, None)],
        "k string, metric string, expected double, tolerance double",
    )
    got = {r["k"]: r["verdict"] for r in score.published_verdict(ours, expected, ["k"], 0.001, 0.01).collect()}
    assert got == {"a": "MATCH", "b": "PARTIAL", "c": "MISMATCH"}
