"""Density ratio of two samples by logistic regression, and the weights built from it.

The regression is fitted by Newton steps.  A step is one aggregate of the gradient, the Gram
matrix of the weighted features and the penalised loss: tasks sum them over their rows, and
the driver sees (columns + 1) squared numbers, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitcal.operators import weights
from unitcal.operators.hypothesis_tests import two_sample
from unitcal.operators.ordered import quantiles, with_row
from unitcal.session import stage


class DiscriminantError(ValueError):
    """Samples that no regression can tell apart or that are empty."""


def present(column: str) -> Column:
    """The column as a number, NULL where it is not a number."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def pooled_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians of the present values; a column without any is 0."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), present(c).alias("value")) for c in columns
    ])).alias("e")).select("e.*").filter("value IS NOT NULL")
    found = {r["name"]: r["median"] for r in quantiles(long, "value", {"median": 0.5}, ["name"]).collect()}
    return {c: float(found.get(c, 0.0)) for c in columns}


@dataclass(frozen=True)
class Logistic:
    """Coefficients on standardised columns, the intercept first, and how they were reached."""

    columns: tuple[str, ...]
    medians: np.ndarray
    means: np.ndarray
    scales: np.ndarray
    coefficients: np.ndarray
    steps: int
    loss: float

    def probability(self, df: DataFrame, output: str = "p_test") -> DataFrame:
        """Adds the chance of the second sample, as a plain expression."""
        score = F.lit(float(self.coefficients[0]))
        for name, median, mean, scale, w in zip(
            self.columns, self.medians, self.means, self.scales, self.coefficients[1:]
        ):
            score = score + float(w) * (F.coalesce(present(name), F.lit(float(median))) - float(mean)) / float(scale)
        return df.withColumn(output, 1.0 / (1.0 + F.exp(-score)))


def standardised(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Medians, means and n-divided deviations of the imputed columns; a constant column has scale 1."""
    medians = pooled_medians(df, columns)
    filled = [F.coalesce(present(c), F.lit(medians[c])) for c in columns]
    row = df.agg(*[F.avg(c) for c in filled], *[F.stddev_pop(c) for c in filled]).first()
    means, scales = np.array(row[:len(columns)], float), np.array(row[len(columns):], float)
    return np.array([medians[c] for c in columns]), means, np.where(scales > 0, scales, 1.0)


def newton_sums(rows: DataFrame, width: int, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient, Gram matrix and sum of log losses at ``beta`` over rows (z binary, y double)."""
    upper = np.triu_indices(width)
    size = width + len(upper[0]) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            z = np.frombuffer(b"".join(batch.column(0).to_pylist()), float).reshape(len(batch), width)
            y = batch.column(1).to_numpy()
            score = z @ beta
            p = 1.0 / (1.0 + np.exp(-score))
            gram = (z * (p * (1.0 - p))[:, None]).T @ z
            loss = (np.logaddexp(0.0, score) - y * score).sum()
            total += np.concatenate([z.T @ (p - y), gram[upper], [loss]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["at", "value"])

    found = np.zeros(size)
    for at, value in rows.mapInArrow(run, "at bigint, value double").groupBy("at").agg(F.sum("value")).collect():
        found[at] = value
    gram = np.zeros((width, width))
    gram[upper] = found[width:-1]
    return found[:width], gram + np.triu(gram, 1).T, float(found[-1])


def fit_logistic(
    df: DataFrame, columns: Sequence[str], label: str, strength: float = 1.0, tolerance: float = 1e-10, max_steps: int = 100
) -> Logistic:
    """L2-penalised logistic regression: sum of log losses plus half the squared coefficients over ``strength``.

    The intercept is free.  A step that raises the penalised loss is halved until it does not.
    """
    medians, means, scales = standardised(df, columns)
    width = len(columns) + 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.ones((len(batch), width))
            for j, column in enumerate(batch.columns[:-1]):
                x = column.to_numpy(zero_copy_only=False).astype(float)
                z[:, j + 1] = (np.where(np.isnan(x), medians[j], x) - means[j]) / scales[j]
            raw = z.tobytes()
            made = [raw[8 * width * i:8 * width * (i + 1)] for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.columns[-1]], names=["z", "y"])

    rows = stage(
        df.select(*[present(c).alias(f"x{i}") for i, c in enumerate(columns)], F.col(label).cast("double").alias("y"))
        .mapInArrow(encode, "z binary, y double")
    )
    sizes = rows.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
    if not all(sizes):
        raise DiscriminantError(f"both samples need rows, they have {sizes[0]} and {sizes[1]}")
    ridge = np.full(width, 1.0 / strength)
    ridge[0] = 0.0
    beta, steps = np.zeros(width), 0
    gradient, gram, loss = newton_sums(rows, width, beta)
    while steps < max_steps:
        step = np.linalg.solve(gram + np.diag(ridge), gradient + ridge * beta)
        now = loss + 0.5 * (ridge * beta * beta).sum()
        share = 1.0
        while True:
            tried = beta - share * step
            gradient, gram, loss = newton_sums(rows, width, tried)
            if loss + 0.5 * (ridge * tried * tried).sum() <= now * (1 + 1e-12) or share < 1e-6:
                break
            share /= 2
        beta, steps = tried, steps + 1
        if np.abs(share * step).max() <= tolerance * max(1.0, np.abs(beta).max()):
            break
    return Logistic(tuple(columns), medians, means, scales, beta, steps, loss)


def discriminator(cal: DataFrame, test: DataFrame, columns: Sequence[str], strength: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Chance of belonging to the test set for every calibration row (``p_test``), and the in-sample AUC."""
    pooled = stage(cal.withColumn("_is_test", F.lit(0.0)).unionByName(test.withColumn("_is_test", F.lit(1.0))))
    scored = fit_logistic(pooled, columns, "_is_test", strength).probability(pooled)
    auc = two_sample(scored, "p_test", F.col("_is_test") == 1.0).select(F.col("auc").alias("auc_in_sample"))
    return scored.filter("_is_test = 0").drop("_is_test"), auc


@dataclass(frozen=True)
class Weights:
    """Calibration rows with ``w_rule``, ``w_classifier`` and ``p_test``, the test weight of each, and the one-row summary."""

    rows: DataFrame
    rule_test: DataFrame
    classifier_test: DataFrame
    summary: DataFrame


def build_weights(
    cal: DataFrame,
    test: DataFrame,
    columns: Sequence[str],
    prevalences: DataFrame,
    recency_ok: Column,
    proxy: Column,
    threshold: float,
    recency_epsilon: float = 0.0,
    tail_index: bool = True,
) -> Weights:
    """Rule and classifier weights of the calibration rows and how far they agree.

    The summary holds their divergence, the discriminator's AUC, the number of rows, the effective size of
    each weighting and, with ``tail_index``, its tail index.
    """
    scored, auc = discriminator(cal, test, columns)
    rule, rule_test = weights.rule_weights(scored, prevalences, recency_ok, proxy, threshold, recency_epsilon)
    rule = rule.withColumnRenamed("w", "w_rule").drop("supported")
    both, classifier_test = weights.odds_weights(rule, "p_test")
    both = stage(both.withColumnRenamed("w", "w_classifier").drop("supported"))
    classifier_test = both.agg(F.avg("w_classifier").alias("test_weight"))
    long = both.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(f"w_{n}").alias("w")) for n in ("rule", "classifier")
    ])).alias("e")).select("e.*")
    tables = [("n_effective", weights.effective_size(long, ["name"]), "n_eff")]
    if tail_index:
        tables.append(("khat", weights.pareto_khat(long, ["name"]), "khat"))
    summary = weights.gamma_divergence(both, "w_rule", "w_classifier").select(F.col("gamma").alias("gamma_divergence"))
    summary = with_row(summary, auc, "_a").select("*", F.col("_a.auc_in_sample").alias("classifier_auc")).drop("_a")
    summary = with_row(summary, both.agg(F.count(F.lit(1)).alias("n")), "_n").select("*", F.col("_n.n").alias("rule_n")).drop("_n")
    for name, table, value in tables:
        wide = table.agg(*[F.max(F.when(F.col("name") == n, F.col(value))).alias(n) for n in ("rule", "classifier")])
        summary = with_row(summary, wide, "_t").select(
            "*", F.col("_t.rule").alias(f"rule_{name}"), F.col("_t.classifier").alias(f"classifier_{name}")
        ).drop("_t")
    return Weights(both, rule_test, classifier_test, summary)
