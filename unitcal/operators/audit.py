"""Audit tables: counts, shares, missing rates, histograms, error blocks, findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitcal.functions import approximately
from unitcal.operators.ordered import (
    attach_one,
    interpolate,
    null_safe_join,
    quantiles,
    running_totals,
)


def expected_counts(observed: DataFrame, expected: DataFrame, key: str = "item") -> DataFrame:
    """Observed against expected counts: ``(item, expected, observed, delta, match)``."""
    return expected.join(observed, key, "left").select(
        key,
        "expected",
        "observed",
        (F.col("observed") - F.col("expected")).alias("delta"),
        F.coalesce(F.col("observed") == F.col("expected"), F.lit(False)).alias("match"),
    )


def rule_conformance(
    df: DataFrame, rules: Mapping[str, tuple[Column, Column]], by: Sequence[str]
) -> DataFrame:
    """Range of a quantity and share of rows that keep the rule, per rule and group.

    ``rules`` maps a name to (quantity, condition).
    """
    entries = [
        F.struct(F.lit(n).alias("rule"), q.cast("double").alias("x"), ok.alias("ok"))
        for n, (q, ok) in rules.items()
    ]
    long = df.select(*by, F.explode(F.array(*entries)).alias("e")).select(*by, "e.*")
    share = F.avg(F.col("ok").cast("int"))
    return long.groupBy(*by, "rule").agg(
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        share.alias("share"),
        F.bool_and("ok").alias("holds"),
    )


def enrichment(prevalence: DataFrame, key: str, base: str, share: str = "share") -> DataFrame:
    """Ratio of every group's share to the base group's."""
    reference = prevalence.filter(F.col(key) == base).agg(F.max(share)).scalar()
    return prevalence.withColumn("enrichment", F.try_divide(F.col(share), reference))


def size_summary(units: DataFrame, size: str, by: Sequence[str]) -> DataFrame:
    """Count, mean, extremes and quartiles of the rows per unit."""
    ranked = running_totals(units, size, {"n": F.lit(1)}, by)
    return interpolate(ranked, size, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, by, {
        "n_units": F.sum("n"),
        "mean": F.sum(F.col(size) * F.col("n")) / F.sum("n"),
        "min": F.min(size),
        "max": F.max(size),
    })


def missing_rates(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """Share of missing entries per column, one output column per split value.

    Long form throughout: one partial aggregate per (split, position) instead of one
    aggregate with a hundred outputs.
    """
    flags = F.array(*[F.col(c).isNull().cast("int") for c in columns])
    counts = (
        df.select(by, F.posexplode(flags).alias("pos", "missing"))
        .groupBy(by, "pos")
        .agg(F.avg("missing").alias("rate"))
    )
    names = F.array(*[F.lit(c) for c in columns])
    return counts.select(by, names[F.col("pos")].alias("column"), "rate")


def columns_with_missing(rates: DataFrame) -> DataFrame:
    return rates.groupBy("column").agg(F.max("rate").alias("worst")).filter(F.col("worst") > 0)


def group_counts(
    units: DataFrame, group: str, split: str, splits: Sequence[str], high: Column
) -> DataFrame:
    """Units and high units per group, one pair of columns per split; absent means 0."""
    aggs = []
    for s in splits:
        here = F.col(split) == s
        aggs += [
            F.count_if(here).alias(f"{s}_units"),
            F.count_if(here & high).alias(f"{s}_high"),
        ]
    return units.groupBy(group).agg(*aggs)


def shared_groups(counts: DataFrame, splits: Sequence[str]) -> DataFrame:
    condition = F.lit(True)
    for s in splits:
        condition = condition & (F.col(f"{s}_units") > 0)
    return counts.filter(condition)


def floor_mass(
    units: DataFrame, messages: DataFrame, split: str, target: str, value: str, floor: float,
    threshold: float,
) -> DataFrame:
    """Mass at the floor per split and over all: units, messages, and where the rest lies."""
    at = approximately(F.col(target), floor)
    per_unit = units.rollup(split).agg(
        F.count(F.lit(1)).alias("n_units"),
        F.count_if(at).alias("units_at_floor"),
        F.avg(at.cast("int")).alias("share_at_floor"),
        F.count_if(~at & (F.col(target) <= threshold)).alias("rest_below"),
        F.count_if(~at & (F.col(target) > threshold)).alias("rest_above"),
    )
    per_row = messages.rollup(split).agg(
        F.count_if(approximately(F.col(value), floor)).alias("messages_at_floor")
    )
    return null_safe_join(per_unit, per_row, [split]).withColumn(
        split, F.coalesce(split, F.lit("all"))
    )


def histogram(
    df: DataFrame, value: str, lo: float, hi: float, bins: int, by: Sequence[str] = ()
) -> DataFrame:
    """Counts and density per equal-width bin of [lo, hi]; the last bin includes ``hi``.

    Values below ``lo`` are bin 0 (no left edge), values above ``hi`` bin ``bins + 1``, both without a
    density, so counts add up to all values that aren't NULL.  Density is the share of these per unit.
    """
    width = (hi - lo) / bins
    x = F.col(value)
    inner = F.least(F.width_bucket(x, F.lit(float(lo)), F.lit(float(hi)), F.lit(bins)), F.lit(bins))
    slot = F.when(x < lo, 0).when(x > hi, bins + 1).otherwise(inner)
    counted = df.filter(x.isNotNull()).groupBy(*by, slot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy(*by).agg(F.sum("n").alias("total"))
    return attach_one(counted, totals, by).select(
        *by,
        "bin",
        F.when(F.col("bin") > 0, F.lit(lo) + (F.col("bin") - 1) * width).alias("left_edge"),
        "n",
        F.when(F.col("bin").between(1, bins), F.col("n") / (F.col("total") * width)).alias("density"),
    )


def tally(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per value with their share of the group."""
    counts = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    return attach_one(counts, totals, by).select(
        *by, key, "n", (F.col("n") / F.col("total")).alias("share")
    )


def error_blocks(
    df: DataFrame, delta: str, tolerance: float, stratum: str, exclude: Column
) -> DataFrame:
    """Error statistics over all rows, without an excluded subset, and per stratum.

    Every row is labelled with the blocks it belongs to; all blocks share one ordering of
    the sizes and one of the signed errors.
    """
    labels = F.array_compact(F.array(
        F.lit("all"),
        F.when(~exclude, F.lit("excluding")),
        F.concat(F.lit("stratum "), F.col(stratum).cast("string")),
    ))
    long = df.select(
        F.explode(labels).alias("block"), F.col(delta).alias("d"), F.abs(delta).alias("size")
    )
    by = ["block"]
    ranked = running_totals(long, "size", {"n": F.lit(1)}, by)
    total = F.sum("n")
    sizes = interpolate(ranked, "size", {"median_abs": 0.5, "p90_abs": 0.9}, by, {
        "n": total,
        "share_within": F.sum(F.when(F.col("size") <= tolerance, F.col("n")).otherwise(0)) / total,
        "mae": F.sum(F.col("size") * F.col("n")) / total,
        "max_abs": F.max("size"),
    })
    return null_safe_join(sizes, quantiles(long, "d", {"median_bias": 0.5}, by), by)


def outside_tolerance(df: DataFrame, delta: str, tolerance: float) -> DataFrame:
    """Rows beyond the tolerance with the direction of their error."""
    return df.filter(F.abs(delta) > tolerance).withColumn(
        "direction", F.when(F.col(delta) > 0, "higher").otherwise("lower")
    )


def largest_errors(df: DataFrame, delta: str, tie: str, n: int = 15) -> DataFrame:
    """The ``n`` rows with the largest absolute error (a top-n report)."""
    return df.orderBy(F.abs(delta).desc(), tie).limit(n)


def share_band(share: Column, bar: float, partial: float = 0.5) -> Column:
    return (
        F.when(share >= bar, "at or above the bar")
        .when(share >= partial, "partial")
        .otherwise("below")
    )


def level_summary(rows: DataFrame, by: Sequence[str] = ("method", "level")) -> DataFrame:
    """Coverage over seeds: mean, sd, gap in points, mean width, median p-value."""
    return rows.groupBy(*by).agg(
        F.avg("coverage").alias("coverage_mean"),
        F.stddev_samp("coverage").alias("coverage_sd"),
        F.avg(100.0 * (F.col("coverage") - F.col("level"))).alias("gap_pp"),
        F.avg("mean_width").alias("mean_width"),
        F.median("binomial_p").alias("median_p"),
    )


def by_seed(rows: DataFrame, seeds: Sequence[int], value: str = "coverage") -> DataFrame:
    """One row per (method, level) with the value of each seed in its own column."""
    pivoted = rows.groupBy("method", "level").pivot("seed", list(seeds)).agg(F.first(value))
    return pivoted.withColumnsRenamed({str(s): f"seed_{s}" for s in seeds})


def calibration_verdict(
    coverage: DataFrame, uniform: DataFrame, by: Sequence[str] = ("method",), gap_pp: float = 2.0
) -> DataFrame:
    """Calibrated when every gap is within ``gap_pp`` points and uniformity is not rejected."""
    gaps = coverage.groupBy(*by).agg(
        F.bool_and(F.abs(100.0 * (F.col("coverage") - F.col("level"))) <= gap_pp).alias("gaps_ok"),
        F.avg(100.0 * (F.col("coverage") - F.col("level"))).alias("mean_gap_pp"),
    )
    tests = uniform.groupBy(*by).agg(F.bool_and(F.col("ks_p") > 0.05).alias("uniform_ok"))
    return null_safe_join(gaps, tests, list(by)).withColumn(
        "verdict",
        F.when(F.col("gaps_ok") & F.col("uniform_ok"), "calibrated")
        .when(F.col("mean_gap_pp") < 0, "under-covering")
        .otherwise("miscalibrated"),
    )


def findings(entries: Sequence[tuple[str, DataFrame, Column]]) -> DataFrame:
    """One (item, value) row per audit result; each source must be a one-row table."""
    out = None
    for item, table, value in entries:
        row = table.select(F.lit(item).alias("item"), value.cast("double").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out
