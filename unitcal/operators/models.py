"""MLlib models behind the forecasts, and predictive distributions from samples."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitcal.functions import normal_cdf, normal_quantile
from unitcal.functions.exact import binomial_p
from unitcal.operators.features import anchor, from_model_output, to_model_target
from unitcal.operators.discriminant import discriminator  # noqa: F401  part of this module's interface
from unitcal.operators.hypothesis_tests import uniformity
from unitcal.operators.ordered import (
    attach_one,
    interpolate,
    null_safe_join,
    quantiles,
    running_totals,
)
from unitcal.operators.resample import score_with_bounds
from unitcal.operators.score import best_promotion, promote, promotion_sweep
from unitcal.session import stage

# The quantile heads, the search grid and the nominal levels.
QUANTILE_LEVELS = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)
SEARCH_GRID = {
    "stepSize": (0.02, 0.05, 0.08, 0.12),
    "maxDepth": (4, 5, 6, 7),
    "minInstancesPerNode": (10, 20, 40, 80),
    "featureSubsetStrategy": ("0.5", "0.7", "0.9"),
    "subsamplingRate": (0.6, 0.8, 1.0),
}
NOMINAL_LEVELS = (0.80, 0.90, 0.95)


class ModelError(ValueError):
    """A model that cannot be fitted or judged."""


def feature_stages(columns: Sequence[str], group: str | None = None) -> list:
    """Median imputation, the group as a category index, and assembly."""
    filled = [f"{c}__filled" for c in columns]
    stages = [
        Imputer(strategy="median", relativeError=1e-4, inputCols=list(columns), outputCols=filled)
    ]
    inputs = filled
    if group:
        stages.append(StringIndexer(inputCol=group, outputCol="group_index", handleInvalid="keep"))
        inputs = [*filled, "group_index"]
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")]


def fit_boosted(
    fit: DataFrame,
    validation: DataFrame,
    columns: Sequence[str],
    label: str,
    seed: int,
    group: str | None = None,
    **params,
):
    """Boosted trees with early stopping on the validation rows.  All randomness follows ``seed``.

    A group is a category, for which ``maxBins`` is at least its number of values and one more.
    """
    both = fit.withColumn("is_validation", F.lit(False)).unionByName(
        validation.withColumn("is_validation", F.lit(True))
    )
    settings = {
        "maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8,
        "featureSubsetStrategy": "0.7", **params,
    }
    if group:
        values = both.agg(F.count_distinct(group)).first()[0]
        settings["maxBins"] = max(settings.get("maxBins", 32), values + 1)
    trees = GBTRegressor(
        featuresCol="features", labelCol=label, predictionCol="yhat",
        validationIndicatorCol="is_validation", seed=seed, **settings,
    )
    return Pipeline(stages=[*feature_stages(columns, group), trees]).fit(both)


def predict(model, df: DataFrame, output: str = "yhat", keep: Sequence[str] = ()) -> DataFrame:
    scored = model.transform(df)
    return scored.select(*(keep or df.columns), F.col("yhat").alias(output))


def feature_importance(model, columns: Sequence[str], spark) -> DataFrame:
    """(feature, importance), largest first.  One row per feature column, and one for a group (``group_index``)."""
    weights = model.stages[-1].featureImportances.toArray()
    names = [*columns, *model.stages[-2].getInputCols()[len(columns):]]
    rows = [(n, float(w)) for n, w in zip(names, weights, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature"
    )


def fit_quantile_tree(
    fit: DataFrame, columns: Sequence[str], label: str, levels: Sequence[float] = QUANTILE_LEVELS,
    max_depth: int = 4, min_leaf: int = 20, seed: int = 42,
):
    """Quantile heads: one regression tree, then the exact label quantiles of its leaves.

    Returns the tree pipeline and the leaf table ``(leaf, q_<percent>...)``.  The quantiles
    of one leaf come from the same sorted labels, so they never cross.
    """
    tree = DecisionTreeRegressor(
        featuresCol="features", labelCol=label, predictionCol="yhat", leafCol="leaf",
        maxDepth=max_depth, minInstancesPerNode=min_leaf, seed=seed,
    )
    model = Pipeline(stages=[*feature_stages(columns), tree]).fit(fit)
    leaves = quantiles(
        model.transform(fit).select("leaf", label), label,
        {quantile_name(q): q for q in levels}, ["leaf"],
    )
    return model, leaves


def quantile_name(level: float) -> str:
    return f"q_{round(level * 100):02d}"


def predict_quantiles(model, leaves: DataFrame, df: DataFrame) -> DataFrame:
    """Quantile columns for every row, by its leaf (at most 2^depth leaf rows)."""
    scored = model.transform(df).select(*df.columns, "leaf")
    return null_safe_join(scored, leaves, ["leaf"], "left")


def pinball_loss(df: DataFrame, truth: str, preds: Mapping[float, str], by: Sequence[str] = ()) -> DataFrame:
    """Mean pinball loss per quantile level: ``(by, quantile, pinball)``."""
    entries = F.array(*[
        F.struct(F.lit(float(q)).alias("quantile"), F.col(c).alias("f")) for q, c in preds.items()
    ])
    gap = F.col(truth) - F.col("e.f")
    loss = F.greatest(F.col("e.quantile") * gap, (F.col("e.quantile") - 1.0) * gap)
    return (
        df.select(*by, truth, F.explode(entries).alias("e"))
        .groupBy(*by, "e.quantile")
        .agg(F.avg(loss).alias("pinball"))
    )


def crossing_rate(df: DataFrame, preds: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of rows in which a higher quantile lies below a lower one."""
    crossed = F.lit(False)
    for lower, upper in zip(preds, preds[1:]):
        crossed = crossed | (F.col(upper) < F.col(lower))
    return df.groupBy(*by).agg(F.avg(crossed.cast("int")).alias("crossing_rate"))


# --- search and multi-seed runs --------------------------------------------------------


def sample_params(trials: int, seed: int) -> list[dict]:
    """A seeded list of configurations from the fixed grid."""
    rng = random.Random(seed)
    return [{k: rng.choice(v) for k, v in SEARCH_GRID.items()} for _ in range(trials)]


def search_boosted(
    fit: DataFrame, validation: DataFrame, columns: Sequence[str], label: str, trials: int,
    seed: int, max_iter: int = 20,
) -> tuple[DataFrame, dict]:
    """Random search with a fixed budget, judged by validation MSE.

    Each trial is one distributed training job; the trial table holds one row per trial.
    """
    fit, validation = stage(fit), stage(validation)
    rows, best, best_mse = [], {}, float("inf")
    for trial, params in enumerate(sample_params(trials, seed)):
        model = fit_boosted(fit, validation, columns, label, seed, maxIter=max_iter, **params)
        error = F.col("yhat") - F.col(label)
        mse = model.transform(validation).agg(F.avg(error * error)).first()[0]
        rows.append((trial, repr(sorted(params.items())), float(mse)))
        if mse < best_mse:
            best, best_mse = params, mse
    table = fit.sparkSession.createDataFrame(rows, "trial int, params string, validation_mse double")
    return table, best


def select_target_mode(
    fit: DataFrame, validation: DataFrame, columns: Sequence[str], target: str,
    anchor_column: str | None, seed: int, taus: Sequence[float], threshold: float, margin: float,
    epsilon: float, **params,
) -> tuple[DataFrame, str, float]:
    """Absolute or residual target, chosen by validation loss after promotion."""
    tables = []
    for mode in ("absolute", "residual"):
        label = to_model_target(F.col(target), anchor(fit, anchor_column), mode)
        model = fit_boosted(
            fit.withColumn("label", label), validation.withColumn("label", label), columns,
            "label", seed, **params,
        )
        pred = from_model_output(F.col("yhat"), anchor(fit, anchor_column), mode)
        scored = model.transform(validation).select(target, pred.alias("pred"), F.lit(mode).alias("mode"))
        tables.append(scored)
    scored = stage(tables[0].unionByName(tables[1]))
    sweep = promotion_sweep(scored, target, "pred", taus, threshold, margin, ["mode"], epsilon=epsilon)
    best = stage(best_promotion(sweep, ["mode"]))
    chosen = best.orderBy("loss", "mode").first()
    if chosen is None:
        raise ModelError("no target mode gives a defined loss on validation")
    return best, chosen["mode"], chosen["tau"]


def multi_seed_run(
    fit: DataFrame, validation: DataFrame, test: DataFrame, unit: str, columns: Sequence[str],
    target: str, anchor_column: str | None, seeds: Sequence[int], taus: Sequence[float],
    threshold: float, margin: float, epsilon: float, n_replicates: int = 200, **params,
) -> DataFrame:
    """Mode and promotion from validation, then one fit and one test score per seed."""
    fit, validation, test = stage(fit), stage(validation), stage(test)
    _, mode, tau = select_target_mode(
        fit, validation, columns, target, anchor_column, seeds[0], taus, threshold, margin,
        epsilon, **params,
    )
    label = to_model_target(F.col(target), anchor(fit, anchor_column), mode)
    tables = []
    for seed in seeds:
        model = fit_boosted(
            fit.withColumn("label", label), validation.withColumn("label", label), columns,
            "label", seed, **params,
        )
        pred = from_model_output(F.col("yhat"), anchor(test, anchor_column), mode)
        tables.append(model.transform(test).select(
            unit, target, promote(pred, tau, threshold, margin).alias("pred"), F.lit(seed).alias("seed")
        ))
    predictions = tables[0]
    for t in tables[1:]:
        predictions = predictions.unionByName(t)
    return score_with_bounds(
        stage(predictions), unit, target, "pred", ["seed"], threshold, epsilon=epsilon,
        n_replicates=n_replicates,
    ).withColumns({"target_mode": F.lit(mode), "tau": F.lit(float(tau))})


# --- predictive distributions ----------------------------------------------------------


def sample_moments(
    samples: DataFrame, unit: str, by: Sequence[str] = (), carry: Sequence[str] = ()
) -> DataFrame:
    """Mean and sample sd of the predictions per unit (at least two samples each)."""
    return (
        samples.groupBy(*by, unit)
        .agg(
            F.avg("yhat").alias("mean"),
            F.stddev_samp("yhat").alias("epistemic_sd"),
            F.count(F.lit(1)).alias("n_samples"),
            *[F.first(c).alias(c) for c in carry],
        )
    )


def moments_of_variants(
    samples: DataFrame, unit: str, variants: Sequence[tuple[Mapping[str, object], Column]],
    carry: Sequence[str] = (),
) -> DataFrame:
    """:func:`sample_moments` of several variants of every sample, one row per unit and variant.

    A variant is its key columns' values and its prediction.  The variants are columns of one
    aggregation by unit, so that no copies of the samples are sorted or held.
    """
    names = [f"_variant_{i}" for i in range(len(variants))]
    told = samples.withColumns({n: c for n, (_, c) in zip(names, variants)})
    wide = told.groupBy(unit).agg(
        *[
            F.struct(
                *[F.lit(v).alias(k) for k, v in keys.items()],
                F.avg(n).alias("mean"),
                F.stddev_samp(n).alias("epistemic_sd"),
                F.count(F.lit(1)).alias("n_samples"),
            ).alias(n)
            for n, (keys, _) in zip(names, variants)
        ],
        *[F.first(c).alias(c) for c in carry],
    )
    return wide.select(unit, *carry, F.inline(F.array(*names)))


def require_samples(moments: DataFrame, least: int = 2) -> DataFrame:
    if moments.filter(F.col("n_samples") < least).limit(1).count():
        raise ModelError(f"a predictive distribution needs at least {least} samples per unit")
    return moments


def aleatoric_sd(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Residual sample deviation on held-out rows."""
    residual = F.col(truth) - F.col(pred)
    return df.groupBy(*by).agg(
        F.stddev_samp(residual).alias("aleatoric_sd"), F.count(residual).alias("n_residuals")
    )


def require_residuals(noise: DataFrame) -> DataFrame:
    if noise.filter(F.col("n_residuals") < 2).limit(1).count():
        raise ModelError("need at least 2 residuals")
    return noise


def predictive(moments: DataFrame, noise: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total predictive deviation sqrt(epistemic^2 + aleatoric^2)."""
    table = attach_one(moments, noise.select(*by, "aleatoric_sd"), by)
    total = F.sqrt(F.col("epistemic_sd") * F.col("epistemic_sd") + F.col("aleatoric_sd") * F.col("aleatoric_sd"))
    return table.withColumn("sd", total)


def gaussian_intervals(dist: DataFrame, levels: Sequence[float]) -> DataFrame:
    """mean +- z * sd for every level."""
    entries = F.array(*[
        F.struct(F.lit(float(v)).alias("level"), F.lit(normal_quantile(0.5 + v / 2.0)).alias("z"))
        for v in levels
    ])
    spread = dist.withColumn("_l", F.explode(entries)).select("*", "_l.*").drop("_l")
    return spread.withColumns({
        "lo": F.col("mean") - F.col("z") * F.col("sd"), "hi": F.col("mean") + F.col("z") * F.col("sd"),
    }).drop("z")


def empirical_intervals(
    samples: DataFrame, unit: str, noise: DataFrame, levels: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Sample percentiles widened by z * aleatoric sd.

    A unit holds one prediction per sample id, a bounded number, so the built-in exact
    percentile is used.
    """
    probs = [p for v in levels for p in ((1.0 - v) / 2.0, (1.0 + v) / 2.0)]
    spread = attach_one(
        samples.groupBy(*by, unit).agg(F.percentile("yhat", F.array(*[F.lit(p) for p in probs])).alias("p")),
        noise.select(*by, "aleatoric_sd"), by,
    )
    entries = F.array(*[
        F.struct(
            F.lit(float(v)).alias("level"),
            (F.col("p")[2 * i] - F.lit(normal_quantile(0.5 + v / 2.0)) * F.col("aleatoric_sd")).alias("lo"),
            (F.col("p")[2 * i + 1] + F.lit(normal_quantile(0.5 + v / 2.0)) * F.col("aleatoric_sd")).alias("hi"),
        )
        for i, v in enumerate(levels)
    ])
    return spread.select(*by, unit, F.explode(entries).alias("l")).select(*by, unit, "l.*")


def gaussian_pit(dist: DataFrame, truth: str) -> DataFrame:
    return dist.withColumn("pit", normal_cdf((F.col(truth) - F.col("mean")) / F.col("sd")))


def empirical_pit(samples: DataFrame, unit: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of a unit's samples at or below the truth."""
    return samples.groupBy(*by, unit).agg(
        F.avg((F.col("yhat") <= F.col(truth)).cast("int")).alias("pit")
    )


def reliability(intervals: DataFrame, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """Empirical coverage per nominal level with gap, widths and the binomial p-value."""
    covered = (F.col(truth) >= F.col("lo")) & (F.col(truth) <= F.col("hi"))
    keys = [*by, "level"]
    ranked = running_totals(
        intervals.withColumn("width", F.col("hi") - F.col("lo")),
        "width", {"n": F.lit(1), "hits": covered.cast("int")}, keys,
    )
    total = F.sum("n")
    table = interpolate(ranked, "width", {"median_width": 0.5}, keys, {
        "rows": total,
        "n_covered": F.sum("hits"),
        "coverage": F.sum("hits") / total,
        "mean_width": F.sum(F.col("width") * F.col("n")) / total,
    }).withColumnRenamed("rows", "n")
    return table.withColumns({
        "gap_pp": 100.0 * (F.col("coverage") - F.col("level")),
        "binomial_p": binomial_p(F.col("n_covered"), F.col("n"), F.col("level")),
    })


def coverage_objective(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute distance of empirical from nominal coverage."""
    return curve.groupBy(*by).agg(F.avg(F.abs(F.col("coverage") - F.col("level"))).alias("objective"))


def coverage_audit(
    dist: DataFrame, truth: str, levels: Sequence[float] = NOMINAL_LEVELS, by: Sequence[str] = ("method", "seed")
) -> tuple[DataFrame, DataFrame]:
    """Reliability rows and the uniformity test of the PIT, per method and seed."""
    curve = reliability(gaussian_intervals(dist, levels), truth, by)
    pit = uniformity(gaussian_pit(dist, truth), "pit", by)
    return curve, pit


def promoted_scores(
    dist: DataFrame, unit: str, truth: str, tau: Column | float, threshold: float, margin: float,
    epsilon: float, by: Sequence[str] = (), **drawing,
) -> DataFrame:
    """Score of a distribution's mean after promotion, for the common comparison table."""
    promoted = dist.withColumn("pred", promote(F.col("mean"), tau, threshold, margin))
    return score_with_bounds(promoted, unit, truth, "pred", by, threshold, epsilon=epsilon, **drawing)
