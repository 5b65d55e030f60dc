"""Baselines, decision rule and the group-wise point score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitcal.functions import approximately, inf, is_finite, nan
from unitcal.operators.ordered import interpolate, running_totals


class ScoreError(ValueError):
    """The pairs cannot be scored."""


def floored_persistence(value: Column, threshold: float, epsilon: float) -> Column:
    """Last known value, with everything below the threshold set just under it."""
    return F.when(value >= threshold, value).otherwise(F.lit(threshold - epsilon))


def clip_predictions(pred: Column, threshold: float, epsilon: float | None) -> Column:
    if epsilon is None:
        return pred
    return F.when(pred < threshold, F.lit(threshold - epsilon)).otherwise(pred)


def baseline_frame(
    units: DataFrame,
    known: DataFrame,
    unit: str,
    threshold: float,
    epsilon: float,
    constant: float,
    last: str = "known",
) -> tuple[DataFrame, DataFrame]:
    """Truth with both baseline predictions per unit, and the count of dropped units.

    ``units`` is the per-unit frame, ``known`` the as-of table with its column ``last``.  Units without an as-of
    value cannot be forecast: they leave the frame and are counted in the second table.
    """
    joined = units.join(known, unit, "left")
    missing = F.col(last).isNull()
    dropped = joined.agg(
        F.count(F.lit(1)).alias("n_units"), F.count_if(missing).alias("n_dropped")
    )
    frame = joined.filter(~missing).withColumns({
        "pred_persistence": floored_persistence(F.col(last), threshold, epsilon),
        "pred_constant": F.lit(float(constant)),
    })
    return frame, dropped


def promote(pred: Column, tau, threshold: float, margin: float) -> Column:
    """Lift predictions at or above ``tau`` to at least just above the threshold."""
    return F.when(pred >= tau, F.greatest(pred, F.lit(threshold + margin))).otherwise(pred)


def confusion(truth: Column, pred: Column, threshold: float) -> dict[str, Column]:
    t, p = truth >= threshold, pred >= threshold
    return {
        "tp": F.count_if(t & p),
        "fp": F.count_if(~t & p),
        "fn": F.count_if(t & ~p),
        "tn": F.count_if(~t & ~p),
    }


def f_beta(tp: Column, fp: Column, fn: Column, beta: float = 2.0) -> dict[str, Column]:
    """Precision, recall and F-beta; each is 0 where its denominator is 0."""
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    weight = beta * beta
    pooled = weight * precision + recall
    return {
        "precision": precision,
        "recall": recall,
        "f_beta": F.when(pooled > 0, (1.0 + weight) * precision * recall / pooled).otherwise(0.0),
    }


def additive_score_parts(
    truth: Column, pred: Column, threshold: float, epsilon: float | None
) -> dict[str, Column]:
    """Per-row parts whose sums give the score of any set of units."""
    clipped = clip_predictions(pred, threshold, epsilon)
    t, p = truth >= threshold, clipped >= threshold
    return {
        "tp": (t & p).cast("int"),
        "fp": (~t & p).cast("int"),
        "fn": (t & ~p).cast("int"),
        "tn": (~t & ~p).cast("int"),
        "sq_high": F.when(t, F.pow(truth - clipped, F.lit(2.0))).otherwise(0.0),
    }


def score_from_parts(beta: float = 2.0) -> dict[str, Column]:
    """Score columns from summed parts ``tp, fp, fn, tn, sq_high``.

    Without true positives-class units the error and loss are NaN (unscorable); an
    F-score of zero makes the loss infinite.  Neither is ever dropped silently.
    """
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    n_high = tp + fn
    fb = f_beta(tp, fp, fn, beta)
    mse = F.when(n_high > 0, F.col("sq_high") / n_high).otherwise(nan())
    loss = F.when(n_high == 0, nan()).when(fb["f_beta"] == 0, inf()).otherwise(mse / fb["f_beta"])
    return {
        **fb,
        "mse_high": mse,
        "loss": loss,
        "n_high_true": n_high,
        "n_high_pred": tp + fp,
        "f_is_zero": fb["f_beta"] == 0,
        "high_empty": n_high == 0,
        "defined": (fb["f_beta"] > 0) & (n_high > 0),
    }


def point_score(
    df: DataFrame,
    truth: str,
    pred: str,
    by: Sequence[str] = (),
    threshold: float = -6.0,
    beta: float = 2.0,
    epsilon: float | None = 0.001,
) -> DataFrame:
    """Loss = mean squared error on truly high units / F-beta, one row per group."""
    parts = additive_score_parts(F.col(truth), F.col(pred), threshold, epsilon)
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_units"), *[F.sum(c).alias(n) for n, c in parts.items()]
    )
    return sums.withColumns(score_from_parts(beta)).drop("sq_high")


def require_scorable(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Reject an empty set and any pair that is not two finite numbers."""
    check = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~(is_finite(F.col(truth)) & is_finite(F.col(pred)))).alias("bad"),
    ).first()
    if check["n"] == 0:
        raise ScoreError("cannot score an empty set")
    if check["bad"]:
        raise ScoreError(f"{check['bad']} pairs are not finite")
    return df


def promotion_sweep(
    df: DataFrame,
    truth: str,
    pred: str,
    taus: Sequence[float],
    threshold: float,
    margin: float,
    by: Sequence[str] = (),
    beta: float = 2.0,
    epsilon: float | None = 0.001,
) -> DataFrame:
    """Score of every promotion threshold of a fixed grid, one row per (group, tau)."""
    grid = df.select(*by, truth, pred, F.explode(F.array(*[F.lit(float(t)) for t in taus])).alias("tau"))
    promoted = grid.withColumn("promoted", promote(F.col(pred), F.col("tau"), threshold, margin))
    scores = point_score(promoted, truth, "promoted", [*by, "tau"], threshold, beta, epsilon)
    lifted = grid.groupBy(*by, "tau").agg(F.count_if(F.col(pred) >= F.col("tau")).alias("n_promoted"))
    return scores.join(lifted, [*by, "tau"])


def best_promotion(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The tau with the smallest defined loss (the first of equals) and that loss."""
    rank = F.struct("loss", "tau")
    defined = sweep.filter("defined")
    return defined.groupBy(*by).agg(
        F.min_by("tau", rank).alias("tau"), F.min("loss").alias("loss")
    )


def require_promotion(best: DataFrame) -> DataFrame:
    if best.isEmpty():
        raise ScoreError("no promotion threshold gives a defined loss")
    return best


def aggregate_seeds(rows: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, sd, min and max over seeds, plus the row of the seed with the median loss.

    One seed has no spread: its sd is 0.
    """
    w = Window.partitionBy(*by)
    placed = rows.withColumns({
        "place": F.row_number().over(w.orderBy("loss", "seed")) - 1,
        "n_seeds": F.count(F.lit(1)).over(w),
    })
    middle = F.col("place") == F.floor(F.col("n_seeds") / 2)
    aggs = [F.max("n_seeds").alias("n_seeds"), F.max(F.when(middle, F.col("seed"))).alias("median_seed")]
    for m in metrics:
        aggs += [
            F.avg(m).alias(f"{m}_mean"),
            F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_sd"),
            F.min(m).alias(f"{m}_min"),
            F.max(m).alias(f"{m}_max"),
        ]
        aggs += [
            F.max(F.when(middle, F.col(f"{m}_{side}"))).alias(f"{m}_{side}")
            for side in ("lo", "hi")
            if f"{m}_{side}" in rows.columns
        ]
    return placed.groupBy(*by).agg(*aggs)


def seed_spread(rows: DataFrame, by: Sequence[str], metric: str, bar: float = 0.5) -> DataFrame:
    """Range of a metric over seeds, absolute and relative to its mean."""
    spread = F.max(metric) - F.min(metric)
    relative = F.try_divide(spread, F.avg(metric))
    return rows.groupBy(*by).agg(
        spread.alias("spread"), relative.alias("relative"), (relative > bar).alias("unstable")
    )


def published_verdict(
    scores: DataFrame, expected: DataFrame, keys: Sequence[str], primary: float, secondary: float
) -> DataFrame:
    """Ours against expected numbers ``(keys, metric, expected, tolerance?)``.

    MATCH within the row's tolerance (``primary`` where it has none), PARTIAL within
    ``secondary``, else MISMATCH.
    """
    difference = F.abs(F.col("value") - F.col("expected"))
    tolerance = F.coalesce(F.col("tolerance"), F.lit(primary))
    return expected.join(scores, [*keys, "metric"], "left").select(
        *keys,
        "metric",
        "expected",
        "value",
        difference.alias("difference"),
        F.when(difference <= tolerance, "MATCH")
        .when(difference <= secondary, "PARTIAL")
        .otherwise("MISMATCH")
        .alias("verdict"),
    )


def melt(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide score columns to ``(keys, metric, value)`` rows."""
    return df.unpivot(list(keys), list(metrics), "metric", "value")


def compare_models(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Union of score tables with the best defined loss marked."""
    out = None
    for name, t in tables.items():
        named = t.withColumn("model", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    best = out.filter("defined").agg(F.min_by("model", F.struct("loss", "model")).alias("m"))
    return out.withColumn("is_best", F.coalesce(F.col("model") == best.scalar(), F.lit(False)))


def target_distribution(
    df: DataFrame, target: str, floor: float, threshold: float, by: Sequence[str]
) -> DataFrame:
    """Units, share at the floor, share high and median target per split."""
    ranked = running_totals(df, target, {"n": F.lit(1)}, by)
    total = F.sum("n")

    def share(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)) / total

    return interpolate(ranked, target, {"median": 0.5}, by, {
        "n_units": total,
        "share_floor": share(approximately(F.col(target), floor)),
        "share_high": share(F.col(target) >= threshold),
    })
