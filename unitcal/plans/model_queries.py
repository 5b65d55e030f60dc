"""MLlib fits on the order series.  They have no SQL form; the tests check their properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from unitcal.operators import boosting, conformal, features, models, series
from unitcal.plans.feature_queries import SUMMARISED, summaries
from unitcal.plans.registry import query
from unitcal.plans.series_queries import training_split
from unitcal.plans.tables import (
    EPSILON, LEVELS, MARGIN, ORDERS, RECENCY, SEED, THRESHOLD, messages,
)
from unitcal.session import stage

COLUMNS = [f"{c}_{s}" for c in SUMMARISED for s in ("last", "mean", "std", "delta")] + [
    "n_admissible", "window_span",
]
TAUS = tuple(200000.0 + 20000.0 * i for i in range(13))
QUICK = {"maxIter": 5, "maxDepth": 3}


def model_table(spark, sf):
    """Features, target, split and subset of every forecastable customer."""
    df = messages(spark, sf)
    targets = df.groupBy("unit").agg(F.min("split").alias("split")).join(
        series.final_messages(df, ORDERS), "unit"
    )
    rows, _ = features.align_targets(summaries(spark, sf, group=False), targets, "unit")
    rows = rows.join(targets.select("unit", "split"), "unit").join(training_split(spark, sf), "unit", "left")
    return stage(rows.withColumn("n_admissible", F.col("n_admissible").cast("double")))


def subsets(rows):
    fit, validation = rows.filter("subset = 'fit_inner'"), rows.filter("subset = 'val_inner'")
    return fit, validation, rows.filter("split = 'test'")


@query("boosted_forecast")
def boosted_forecast(spark, sf):
    fit, validation, test = subsets(model_table(spark, sf))
    model = models.fit_boosted(fit, validation, COLUMNS, "target", SEED, **QUICK)
    return models.predict(model, test, keep=("unit", "target"))


@query("feature_importance")
def feature_importance(spark, sf):
    fit, validation, _ = subsets(model_table(spark, sf))
    model = models.fit_boosted(fit, validation, COLUMNS, "target", SEED, **QUICK)
    return models.feature_importance(model, COLUMNS, spark)


@query("quantile_forecast")
def quantile_forecast(spark, sf):
    fit, _, test = subsets(model_table(spark, sf))
    model, leaves = models.fit_quantile_tree(fit, COLUMNS, "target")
    heads = [models.quantile_name(q) for q in models.QUANTILE_LEVELS]
    return models.predict_quantiles(model, leaves, test).select("unit", "target", *heads)


@query("discriminator")
def discriminator(spark, sf):
    rows = model_table(spark, sf)
    cal = rows.filter("subset = 'calibration'").select("unit", *COLUMNS)
    test = rows.filter("split = 'test'").select("unit", *COLUMNS)
    scored, auc = models.discriminator(cal, test, COLUMNS)
    return scored.select("unit", "p_test", auc.scalar().alias("auc_in_sample"))


@query("parameter_search")
def parameter_search(spark, sf):
    fit, validation, _ = subsets(model_table(spark, sf))
    table_, _ = models.search_boosted(fit, validation, COLUMNS, "target", trials=2, seed=SEED, max_iter=3)
    return table_


@query("multi_seed_run")
def multi_seed_run(spark, sf):
    fit, validation, test = subsets(model_table(spark, sf))
    return models.multi_seed_run(
        fit, validation, test, "unit", COLUMNS, "target", "value_last", (42, 43), TAUS, THRESHOLD,
        MARGIN, EPSILON, n_replicates=40, **QUICK,
    )


# --- boosting with patience: point and quantile heads in one fit -----------------------------

POINT_SEEDS = (42, 43, 44)
POINT_HEADS = tuple(boosting.Head(f"yhat_{seed}", None, seed) for seed in POINT_SEEDS)
QUANTILE_HEADS = tuple(boosting.Head(models.quantile_name(q), q, SEED) for q in models.QUANTILE_LEVELS)


def boosted(rows, heads):
    fit, validation, _ = subsets(rows)
    return boosting.fit_heads(fit, validation, COLUMNS, "target", heads, key="unit")


@query("boosted_heads")
def boosted_heads(spark, sf):
    """Point forecasts of three seeds and seven quantile heads for every test customer."""
    rows = model_table(spark, sf)
    heads = POINT_HEADS + QUANTILE_HEADS
    out = boosted(rows, heads).transform(rows.filter("split = 'test'").select("unit", "target", *COLUMNS))
    return out.select("unit", "target", *[h.name for h in heads])


@query("boosted_report")
def boosted_report(spark, sf):
    """Per quantile head its rounds and losses: validation at the start and the best round, test, and crossings."""
    rows = model_table(spark, sf)
    model = boosted(rows, QUANTILE_HEADS)
    scored = stage(model.transform(rows.filter("split = 'test'").select("target", *COLUMNS)))
    names = {h.level: h.name for h in QUANTILE_HEADS}
    test = models.pinball_loss(scored, "target", names)
    crossing = models.crossing_rate(scored, list(names.values()))
    fits = spark.createDataFrame(
        [(h.level, b, len(x) - 1, x[0], x[b]) for h, b, x in zip(QUANTILE_HEADS, model.best, model.history)],
        "quantile double, best_round bigint, rounds bigint, first_loss double, best_loss double",
    )
    return fits.join(test, "quantile").withColumn("crossing_rate", crossing.scalar())


@query("trained_sweep")
def trained_sweep(spark, sf):
    """Coverage with both kinds of bounds of persistence and boosted forecasts, plain and under both trained weightings."""
    from unitcal.plans.conformal_queries import discriminated_frame, trained_weights

    rows, frame = model_table(spark, sf), discriminated_frame(spark, sf)
    model = boosted(rows, POINT_HEADS)
    points = model.transform(rows.select("unit", *COLUMNS)).select("unit", *[h.name for h in POINT_HEADS])
    built = trained_weights(frame)
    learners = F.explode(F.array(*[
        F.struct(F.lit(name).alias("learner"), F.lit(h.seed).alias("seed"), F.col(column).alias("pred"))
        for h in POINT_HEADS for name, column in (("persistence", "known"), ("boosted", h.name))
    ]))

    def predictions(table):
        return table.join(points, "unit").select(*table.columns, learners.alias("l")).select(*table.columns, "l.*")

    columns = ["unit", "target", "target_ttr", "known"]
    intervals = conformal.sweep(
        predictions(built.rows.select(*columns, "w_rule", "w_classifier")),
        {
            "selftest": predictions(frame.filter("subset = 'self_test'").select(*columns)),
            "naive": predictions(frame.filter("split = 'test'").select(*columns)),
        },
        LEVELS,
        {
            "rule": conformal.Weighting("w_rule", built.rule_test),
            "classifier": conformal.Weighting("w_classifier", built.classifier_test),
        },
        F.col("target_ttr") <= RECENCY,
    )
    return conformal.coverage_with_bounds(stage(intervals), ["learner", "method", "sided", "level", "seed"])
