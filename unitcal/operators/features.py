"""Leakage-checked summaries and padded sequences of the admissible messages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitcal.functions import is_finite, signed_asinh
from unitcal.operators.ordered import null_safe_join, with_row
from unitcal.operators.series import admissible, last_k, lateness
from unitcal.operators.splits import SUMMARIES, require_safe_features
from unitcal.roles import SeriesSpec
from unitcal.session import stage

# The padding sentinel, the size beyond which a column is compressed,
# the clip of standardised values and the smallest usable deviation.
PAD = -999.0
EXTREME = 1e30
CLIP = 20.0
MIN_SD = 1e-8


class FeatureError(ValueError):
    """A feature table breaks one of its gates."""


def known(c: Column) -> Column:
    """NULL for missing input, whether it arrived as NULL or NaN."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def window_summaries(
    df: DataFrame,
    spec: SeriesSpec,
    columns: Sequence[str],
    cutoff: float,
    k: int = 3,
    history: bool = True,
) -> DataFrame:
    """Last, mean, min, max, std and delta of each column over the last ``k`` admissible messages.

    One row per unit with at least one admissible message, wide.  Adds the message
    count, the time span and the last admissible time, the group and, with ``history``,
    the summaries of the value column itself.

    The messages are kept narrow (only the needed columns enter the shuffle) and the
    summaries are computed in long form: one small aggregate per (unit, column) instead
    of one aggregate with hundreds of outputs.  All steps share the partitioning by unit.
    """
    names = list(columns) + ([spec.value] if history and spec.value not in columns else [])
    window = last_k(
        admissible(df, spec, cutoff).select(
            spec.unit,
            spec.ttr,
            spec.tie,
            *([spec.group] if spec.group else []),
            F.array(*[known(F.col(c)) for c in names]).alias("row"),
        ),
        spec,
        k,
    )
    keys = [spec.unit]
    if spec.group:
        # the earliest known group of the window, put on all of its rows, so that it can be
        # a grouping key: as an aggregate it would turn the hash aggregation into a sort
        whole = (
            Window.partitionBy(spec.unit)
            .orderBy("recency")
            .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        )
        window = window.withColumn(spec.group, F.last(spec.group, ignorenulls=True).over(whole))
        keys.append(spec.group)
    long = window.select(*keys, "recency", spec.ttr, F.posexplode("row").alias("pos", "x"))
    at = F.when(F.col("x").isNotNull(), F.col("recency"))
    newest, oldest = F.min_by("x", at), F.max_by("x", at)
    per_column = long.groupBy(*keys, "pos").agg(
        newest.alias("last"),
        F.avg("x").alias("mean"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.stddev_samp("x").alias("std"),
        (newest - oldest).alias("delta"),
        F.count(F.lit(1)).alias("n"),
        F.max(spec.ttr).alias("first_ttr"),
        F.min(spec.ttr).alias("last_ttr"),
    )
    packed = per_column.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("pos", *SUMMARIES))).alias("s"),
        F.max("n").alias("n_admissible"),
        F.max(F.col("first_ttr") - F.col("last_ttr")).alias("window_span"),
        F.min("last_ttr").alias("last_admissible_ttr"),
    )
    wide = [
        F.col("s")[i][summary].alias(f"{name}_{summary}")
        for i, name in enumerate(names)
        for summary in SUMMARIES
    ]
    return packed.select(*keys, *wide, "n_admissible", "window_span", "last_admissible_ttr")


def align_targets(
    features: DataFrame, units: DataFrame, unit: str, target: str = "target"
) -> tuple[DataFrame, DataFrame]:
    """Features with their targets, and one row counting units that could not be forecast."""
    joined = units.select(unit, target).join(features.withColumn("_has", F.lit(1)), unit, "left")
    dropped = joined.agg(
        F.count(F.lit(1)).alias("n_units"),
        F.count_if(F.col("_has").isNull()).alias("n_dropped"),
        F.count_if(F.col("_has").isNotNull() & ~is_finite(F.col(target))).alias("n_bad_target"),
    )
    return joined.filter(F.col("_has").isNotNull()).drop("_has"), dropped


def require_finite_targets(dropped: DataFrame) -> None:
    bad = dropped.first()["n_bad_target"]
    if bad:
        raise FeatureError(f"{bad} targets in the feature table are not finite")


def tabular_features(
    df: DataFrame,
    spec: SeriesSpec,
    policy: Mapping[str, str],
    cutoff: float,
    k: int = 3,
    hard_excluded: Sequence[str] = (),
    include_ambiguous: bool = False,
    history: bool = True,
    text_columns: Sequence[str] = (),
) -> DataFrame:
    """Summaries of every admitted numeric column, with the safety gate on the result.

    ``policy`` maps raw columns to their leakage class.  The value column must be hard
    excluded: its history enters only through pre-cutoff summaries.
    """
    from unitcal.operators.splits import classify_columns

    if history and spec.value not in hard_excluded:
        raise FeatureError(f"{spec.value} must stay hard excluded while its history is used")
    admitted = classify_columns(policy, hard_excluded, include_ambiguous)["admitted"]
    skip = {spec.group, spec.unit, spec.value, *text_columns}
    columns = [c for c in admitted if c not in skip and c in df.columns]
    out = window_summaries(df, spec, columns, cutoff, k, history)
    require_safe_features(
        [c for c in out.columns if c not in (spec.unit, spec.group)],
        policy,
        hard_excluded,
        include_ambiguous,
        history_of=spec.value if history else None,
    )
    return out


# --- sequences -----------------------------------------------------------------------


def extreme_columns(df: DataFrame, columns: Sequence[str], limit: float = EXTREME) -> list[str]:
    """Columns whose largest finite magnitude exceeds ``limit`` (one aggregate row is read)."""
    row = df.agg(*[
        F.max(F.when(is_finite(F.col(c).cast("double")), F.abs(F.col(c).cast("double")))).alias(c)
        for c in columns
    ]).first()
    return [c for c in columns if row[c] is not None and row[c] > limit]


def condition(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Compress the named columns with a signed inverse hyperbolic sine."""
    return df.withColumns({c: signed_asinh(F.col(c).cast("double")) for c in columns})


def fill_missing(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Missing and infinite entries of real messages to 0, with the number replaced."""
    ok = {c: is_finite(F.col(c).cast("double")) for c in columns}
    n_bad = sum((F.when(ok[c], 0).otherwise(1) for c in columns), F.lit(0))
    counted = df.agg(F.coalesce(F.sum(n_bad), F.lit(0)).cast("bigint").alias("n_filled"))
    filled = df.withColumns({
        c: F.when(ok[c], F.col(c).cast("double")).otherwise(0.0) for c in columns
    })
    return filled, counted


def standard_scale(fit: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation of every column over the fit messages: one row.

    A deviation below 1e-8 becomes 1.
    """
    stats = fit.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"sd_{c}") for c in columns],
    )
    return stats.withColumns({
        f"sd_{c}": F.when(F.col(f"sd_{c}") < MIN_SD, 1.0).otherwise(F.col(f"sd_{c}")) for c in columns
    })


def standardised(df: DataFrame, scale: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns on the given scale, clipped to +-20."""
    z = {c: (F.col(c) - F.col(f"_scale.mean_{c}")) / F.col(f"_scale.sd_{c}") for c in columns}
    return with_row(df, scale, "_scale").withColumns({
        c: F.greatest(F.least(v, F.lit(CLIP)), F.lit(-CLIP)) for c, v in z.items()
    }).drop("_scale")


def padded_sequences(
    df: DataFrame, spec: SeriesSpec, columns: Sequence[str], max_len: int, carry: Sequence[str] = ()
) -> DataFrame:
    """Right-padded message sequences, earliest first: ``x`` (max_len x columns), ``mask``, ``length``.

    ``df`` holds the last ``max_len`` admissible messages of each unit, so the collected
    list is bounded.  ``carry`` names per-unit constants to keep.
    """
    entry = F.struct(
        lateness(spec).alias("late"), F.array(*[F.col(c).cast("double") for c in columns]).alias("v")
    )
    collected = df.groupBy(spec.unit).agg(
        F.array_sort(F.collect_list(entry)).alias("m"), *[F.first(c).alias(c) for c in carry]
    )
    real = F.transform("m", lambda e: e["v"])
    empty = F.array(*[F.lit(PAD)] * len(columns))
    n = F.size("m")
    return collected.select(
        spec.unit,
        *carry,
        F.concat(real, F.array_repeat(empty, F.lit(max_len) - n)).alias("x"),
        F.transform(F.sequence(F.lit(1), F.lit(max_len)), lambda i: i <= n).alias("mask"),
        n.alias("length"),
    )


def sequence_messages(
    df: DataFrame, spec: SeriesSpec, columns: Sequence[str], cutoff: float, max_len: int,
    carry: Sequence[str] = (),
) -> DataFrame:
    """The messages that enter the sequences, narrow."""
    kept = admissible(df, spec, cutoff).select(
        spec.unit, spec.ttr, spec.tie, *carry, *[F.col(c).cast("double").alias(c) for c in columns]
    )
    return last_k(kept, spec, max_len)


def prepared_sequences(
    df: DataFrame,
    spec: SeriesSpec,
    columns: Sequence[str],
    cutoff: float,
    max_len: int,
    fit_units: DataFrame,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Condition, fill, standardise on the fit units only, clip and pad."""
    messages = stage(sequence_messages(df, spec, columns, cutoff, max_len, carry))
    messages = condition(messages, extreme_columns(messages, columns))
    messages, _ = fill_missing(messages, columns)
    scale = standard_scale(messages.join(fit_units.select(spec.unit), spec.unit, "left_semi"), columns)
    return padded_sequences(standardised(messages, scale, columns), spec, columns, max_len, carry)


# --- assembly ------------------------------------------------------------------------


def aligned(*tables: DataFrame, unit: str) -> DataFrame:
    """Align per-unit tables by unit; a unit missing from any of them is an error."""
    out = tables[0]
    for t in tables[1:]:
        new = [c for c in t.columns if c not in out.columns]
        left, right = out.withColumn("_l", F.lit(1)), t.select(unit, *new).withColumn("_r", F.lit(1))
        joined = stage(left.join(right, unit, "full_outer"))
        if not joined.filter(F.col("_l").isNull() | F.col("_r").isNull()).isEmpty():
            raise FeatureError("per-unit tables do not hold the same units")
        out = joined.drop("_l", "_r")
    return out


def with_subset(features: DataFrame, splits: DataFrame, unit: str) -> DataFrame:
    """Attach the subset of each unit."""
    return null_safe_join(features, splits.select(unit, "subset"), [unit])


def anchor(df: DataFrame, column: str | None) -> Column:
    """The persistence anchor: the last known value, or 0 without history."""
    return F.col(column) if column and column in df.columns else F.lit(0.0)


def to_model_target(target: Column, anchor_value: Column, mode: str) -> Column:
    return _by_mode(mode, target, target - anchor_value)


def from_model_output(pred: Column, anchor_value: Column, mode: str) -> Column:
    return _by_mode(mode, pred, pred + anchor_value)


def _by_mode(mode: str, absolute: Column, residual: Column) -> Column:
    if mode == "absolute":
        return absolute
    if mode == "residual":
        return residual
    raise ValueError(f"mode must be 'absolute' or 'residual', got {mode!r}")
