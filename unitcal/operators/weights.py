"""Likelihood-ratio weights, their diagnostics, clipping and positivity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitcal.functions import inf, is_finite, nan
from unitcal.operators.ordered import attach_one, interpolate, running_totals, with_row
from unitcal.session import stage


class WeightError(ValueError):
    """Weights that cannot be used."""


def prevalences(
    units: DataFrame, target: str, threshold: float, in_test: Column, in_train: Column
) -> DataFrame:
    """One row: share of high targets among test and among training units."""
    high = F.col(target) >= threshold
    return units.agg(
        F.avg(F.when(in_test, high.cast("int"))).alias("test_prev"),
        F.avg(F.when(in_train, high.cast("int"))).alias("train_prev"),
    )


def require_prevalences(prev: DataFrame) -> DataFrame:
    row = prev.first()
    for name in ("test_prev", "train_prev"):
        if row[name] is None or not 0.0 < row[name] < 1.0:
            raise WeightError(f"{name} must be in (0, 1), got {row[name]}")
    return prev


def rule_weights(
    cal: DataFrame,
    prev: DataFrame,
    recency_ok: Column,
    proxy: Column,
    threshold: float,
    recency_epsilon: float = 0.0,
) -> tuple[DataFrame, DataFrame]:
    """Bucketed likelihood ratio from observable recency and the pre-cutoff value.

    Returns the calibration rows with ``w`` and ``supported``, and the one-row
    ``test_weight``.
    """
    ratios = prev.select(
        (F.col("test_prev") / F.col("train_prev")).alias("high"),
        ((1.0 - F.col("test_prev")) / (1.0 - F.col("train_prev"))).alias("low"),
        "test_prev",
    )
    risk = F.when(proxy >= threshold, F.col("_lr.high")).otherwise(F.col("_lr.low"))
    weighted = (
        with_row(cal, ratios, "_lr")
        .withColumn("w", risk * F.when(recency_ok, 1.0).otherwise(float(recency_epsilon)))
        .withColumn("supported", F.col("w") > 0)
        .drop("_lr")
    )
    mixed = F.col("test_prev") * F.col("high") + (1.0 - F.col("test_prev")) * F.col("low")
    return weighted, ratios.select(mixed.alias("test_weight"))


def odds_weights(cal: DataFrame, p: str, clip: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Density-ratio weights p/(1-p) from a discriminator; the test weight is their mean."""
    bounded = F.greatest(F.least(F.col(p), F.lit(1.0 - clip)), F.lit(clip))
    weighted = cal.withColumn("w", bounded / (1.0 - bounded)).withColumn(
        "supported", F.col("w") > 0
    )
    return weighted, weighted.agg(F.avg("w").alias("test_weight"))


def normalised(df: DataFrame, w: str = "w") -> DataFrame:
    """Weights scaled to sum 1, as ``w_norm``."""
    total = df.agg(F.sum(w).alias("total")).scalar()
    return df.withColumn("w_norm", F.try_divide(F.col(w), total))


def effective_size(df: DataFrame, by: Sequence[str] = (), w: str = "w") -> DataFrame:
    """Kish effective size of the positive weights, and n over it."""
    positive = F.when(F.col(w) > 0, F.col(w))
    return (
        df.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(
                F.try_divide(F.pow(F.sum(positive), F.lit(2.0)), F.sum(positive * positive)),
                F.lit(0.0),
            ).alias("n_eff"),
        )
        .withColumn(
            "n_over_neff", F.when(F.col("n_eff") > 0, F.col("n") / F.col("n_eff")).otherwise(inf())
        )
    )


def weight_summary(df: DataFrame, by: Sequence[str] = (), w: str = "w") -> DataFrame:
    """Counts, quartiles, mean and the largest share of a weight distribution."""
    ranked = running_totals(df, w, {"n": F.lit(1), "mass": F.col(w)}, by)
    return interpolate(ranked, w, {"q25": 0.25, "median": 0.5, "q75": 0.75}, by, {
        "rows": F.sum("n"),
        "n_positive": F.coalesce(F.sum(F.when(F.col(w) > 0, F.col("n"))), F.lit(0)),
        "min": F.min(w),
        "max": F.max(w),
        "mean": F.sum("mass") / F.sum("n"),
        "max_share": F.coalesce(F.try_divide(F.max(w), F.sum("mass")), nan()),
    }).withColumnRenamed("rows", "n")


def balance(
    df: DataFrame, covariates: Sequence[str], by: Sequence[str] = (), w: str = "w"
) -> DataFrame:
    """Absolute standardised difference of weighted and plain mean, per covariate."""
    entries = [F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("x")) for c in covariates]
    long = df.select(*by, w, F.explode(F.array(*entries)).alias("e")).select(*by, w, "e.*")
    weighted = F.try_divide(F.sum(F.col(w) * F.col("x")), F.sum(w))
    sd = F.stddev_samp("x")
    return long.groupBy(*by, "covariate").agg(
        F.when(sd == 0, F.lit(0.0))
        .when(F.sum(w) <= 0, nan())
        .otherwise(F.abs(weighted - F.avg("x")) / sd)
        .alias("asmd")
    )


def gamma_divergence(df: DataFrame, rule: str, other: str) -> DataFrame:
    """Largest ratio between two weightings, each scaled to mean 1 where the rule has support."""
    kept = df.filter(F.col(rule) > 0)
    means = kept.agg(F.avg(rule).alias("rule"), F.avg(other).alias("other"))
    kept = with_row(kept, means, "_mean")
    a = F.col(rule) / F.col("_mean.rule")
    b = F.when(
        F.col("_mean.other") > 0, F.try_divide(F.col(other), F.col("_mean.other"))
    ).otherwise(F.col(other))
    ratio = F.greatest(F.try_divide(a, b), F.try_divide(b, a))
    usable = is_finite(ratio) & (b > 0)
    return kept.agg(
        F.coalesce(F.max(F.when(usable, ratio)), inf()).alias("gamma"),
        F.count(F.lit(1)).alias("n_compared"),
    )


def positivity(
    test: DataFrame, recency_ok: Column, is_high: Column, recency_required: bool = True
) -> DataFrame:
    """Supported and unsupported test units with the high ones among the unsupported."""
    supported = recency_ok if recency_required else F.lit(True)
    return test.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(supported).alias("n_supported"),
        F.count_if(~supported).alias("n_unsupported"),
        F.count_if(~supported & is_high).alias("unsupported_high"),
    )


def zero_share(df: DataFrame, by: Sequence[str] = (), w: str = "w") -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(w) == 0).cast("int")).alias("zero_share"))


# --- tail index --------------------------------------------------------------------


def khat_band(k: Column) -> Column:
    return (
        F.when(F.isnan(k) | k.isNull(), "undiagnosable")
        .when(k < 0.5, "stable")
        .when(k < 0.7, "flagged")
        .when(k <= 1.0, "clip")
        .otherwise("invalid")
    )


def tail_excess(
    df: DataFrame, by: Sequence[str] = (), w: str = "w", tail: float = 0.2, min_tail: int = 20
) -> DataFrame:
    """Distinct excesses of the upper tail with their counts, and per-group bookkeeping.

    The tail is the top ``max(min_tail, ceil(tail * n))`` positive weights; the excess is
    over the next smaller weight.  Values tied with that weight have excess 0 and are kept,
    because they decide whether the tail is degenerate.
    """
    by = list(by)
    ranked = running_totals(df.filter(F.col(w) > 0), w, {"n": F.lit(1)}, by)
    size = F.least(
        F.greatest(F.lit(min_tail), F.ceil(F.lit(tail) * F.col("all_n"))), F.col("all_n") - 1
    )
    sized = ranked.withColumn("first_tail_rank", F.col("all_n") - size)
    # the weight of rank n - n_tail (1-based) is the first whose running count reaches it
    thresholds = sized.groupBy(*by).agg(
        F.min(F.when(F.col("cum_n") >= F.col("first_tail_rank"), F.col(w))).alias("threshold"),
        F.max("all_n").alias("n_positive"),
    )
    joined = (
        attach_one(sized, thresholds, by)
        .filter(F.col(w) >= F.col("threshold"))
        .withColumn(
            "count", F.least(F.col("n"), F.col("cum_n") - F.col("first_tail_rank"))
        )
        .filter(F.col("count") > 0)
    )
    return joined.select(
        *by,
        (F.col(w) - F.col("threshold")).alias("x"),
        F.col("count").cast("bigint").alias("count"),
        "n_positive",
    )


# The search grid of the tail fit in units of theta * (largest excess), and
# the half widths (in decades) of the refinements around its best point.  A heavy tail of n
# excesses has its optimum near n ** shape, hence the long positive side.
GRID_POSITIVE = tuple(10.0 ** (-3.0 + 0.25 * i) for i in range(109))
GRID_NEGATIVE = tuple(-(10.0 ** (-3.0 + 0.25 * i)) for i in range(9)) + tuple(
    -(1.0 - 10.0 ** (-0.1 * i)) for i in range(1, 41)
)
REFINEMENTS = (0.25, 0.025, 0.0025)
REFINE_STEPS = 10


def pareto_khat(
    df: DataFrame, by: Sequence[str] = (), w: str = "w", tail: float = 0.2, min_tail: int = 20
) -> DataFrame:
    """Shape of a generalised Pareto fit to the upper tail of the positive weights.

    Profile likelihood: with t = theta * max(x), the shape is mean(log1p(theta x)) and the
    profile is -log(shape / theta) - shape.  A fixed grid on both signs is refined around
    its best point.  NaN when fewer than ``2 * min_tail`` weights are positive or
    fewer than ``min_tail`` excesses are; -Infinity when all excesses are equal.
    """
    by = list(by)
    # read once per step below, so it is written once
    excess = stage(tail_excess(df, by, w, tail, min_tail))
    facts = excess.groupBy(*by).agg(
        F.max("n_positive").alias("n_positive"),
        F.max("x").alias("largest"),
        F.coalesce(F.sum(F.when(F.col("x") > 0, F.col("count"))), F.lit(0)).alias("n_excess"),
        F.count_distinct(F.when(F.col("x") > 0, F.col("x"))).alias("n_distinct"),
    )
    usable = attach_one(excess.filter(F.col("x") > 0).select(*by, "x", "count"), facts.select(*by, "largest"), by)
    rel = usable.select(*by, (F.col("x") / F.col("largest")).alias("u"), "count")
    grid = F.array(*[F.lit(t) for t in sorted(GRID_NEGATIVE + GRID_POSITIVE)])
    best = best_theta(rel, grid, by)
    for reach in REFINEMENTS:
        around = attach_one(rel, best.select(*by, "t"), by)
        best = best_theta(around, neighbours(F.col("t"), reach), by)
    degenerate = (F.col("largest") <= 1e-8) | (F.col("n_distinct") <= 1) & (F.col("n_excess") > 0)
    merged = (
        attach_one(facts, best.select(*by, F.col("shape").alias("k")), by, "left")
        .withColumn(
            "khat",
            F.when(F.col("n_positive") < 2 * min_tail, nan())
            .when(F.col("largest") <= 1e-8, -inf())
            .when(F.col("n_excess") < min_tail, nan())
            .when(degenerate, -inf())
            .otherwise(F.col("k")),
        )
    )
    return merged.select(*by, "n_positive", "khat", khat_band(F.col("khat")).alias("band"))


def neighbours(t: Column, reach: float) -> Column:
    """Ten points on either side of ``t``, spaced on the same log scale as the grid."""
    offsets = F.array(*[F.lit(reach * i / REFINE_STEPS) for i in range(-REFINE_STEPS, REFINE_STEPS + 1)])
    return F.transform(
        offsets,
        lambda d: F.when(t > 0, t * F.pow(F.lit(10.0), d)).otherwise(
            -(1.0 - (1.0 + t) * F.pow(F.lit(10.0), d))
        ),
    )


def best_theta(rel: DataFrame, grid: Column, by: Sequence[str]) -> DataFrame:
    """Best grid point per group: ``t`` and its ``shape``.  One partial aggregation."""
    spread = rel.select(*by, "u", "count", F.explode(grid).alias("t")).filter(
        (F.col("t") > -1.0) & (F.col("t") != 0.0)
    )
    shapes = spread.groupBy(*by, "t").agg(
        (F.sum(F.col("count") * F.log1p(F.col("t") * F.col("u"))) / F.sum("count")).alias("shape")
    )
    profile = -F.log(F.col("shape") / F.col("t")) - F.col("shape")
    return (
        shapes.withColumn("profile", profile)
        .groupBy(*by)
        .agg(
            F.max_by("t", F.struct("profile", "t")).alias("t"),
            F.max_by("shape", F.struct("profile", "t")).alias("shape"),
        )
    )


def conditional_clip(
    df: DataFrame, w: str = "w", trigger: float = 0.7, quantile: float = 0.99
) -> tuple[DataFrame, DataFrame]:
    """Clip the weights at a quantile only when their tail index exceeds the trigger.

    Returns the rows with ``w_used`` and one diagnostics row: clipped, bound,
    clipped_share, bias, khat before and after.  The clip decision is a value on the
    row, so the plan is the same either way.
    """
    before = pareto_khat(df, (), w).select(F.col("khat").alias("khat_before"))
    ranked = running_totals(df, w, {"n": F.lit(1), "mass": F.col(w)})
    bound = interpolate(ranked, w, {"cut": quantile})
    decided = attach_one(before, bound, ()).withColumn(
        "clipped", ~F.isnan("khat_before") & (F.col("khat_before") > trigger)
    ).withColumn("bound", F.when(F.col("clipped"), F.col("cut")).otherwise(inf()))
    decided = stage(decided)
    limit = F.col("_cut.bound")
    cut = decided.select("bound")
    clipped_rows = with_row(df, cut, "_cut").withColumn("w_used", F.least(F.col(w), limit)).drop("_cut")
    after = pareto_khat(clipped_rows, (), "w_used").select(F.col("khat").alias("khat_after"))
    effect = with_row(ranked, cut, "_cut").agg(
        (F.sum(F.when(F.col(w) > limit, F.col("n")).otherwise(0)) / F.sum("n")).alias("clipped_share"),
        (
            1.0
            - F.sum(F.least(F.col(w), limit) * F.col("n")) / F.sum("mass")
        ).alias("raw_bias"),
    )
    row = attach_one(attach_one(decided, effect, ()), after, ())
    return clipped_rows, row.select(
        "clipped",
        "bound",
        "clipped_share",
        F.when(F.col("clipped"), F.col("raw_bias")).otherwise(F.lit(0.0)).alias("bias"),
        "khat_before",
        F.when(F.col("clipped"), F.col("khat_after")).otherwise(F.col("khat_before")).alias("khat_after"),
    )


def weighted_diagnostics(
    cal: DataFrame, covariates: Mapping[str, str], test_weight: DataFrame, w: str = "w"
) -> DataFrame:
    """The diagnostics row that goes with every weighted interval."""
    row = attach_one(effective_size(cal, (), w), pareto_khat(cal, (), w).drop("n_positive"), ())
    row = attach_one(row, weight_summary(cal, (), w).drop("n"), ())
    row = row.withColumn("test_weight", test_weight.select("test_weight").scalar())
    report = balance(cal.select(w, *[F.col(c).alias(n) for n, c in covariates.items()]), list(covariates), (), w)
    pivoted = report.agg(*[
        F.max(F.when(F.col("covariate") == n, F.col("asmd"))).alias(f"asmd_{n}") for n in covariates
    ])
    return attach_one(row, pivoted, ())
