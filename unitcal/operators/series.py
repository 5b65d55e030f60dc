"""Per-unit structure, targets and eligibility of a message series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitcal.functions import approximately, high_flag, inf
from unitcal.operators.ordered import null_safe_join
from unitcal.roles import SeriesSpec
from unitcal.session import stage


class SeriesError(ValueError):
    """A series table breaks one of its gates."""


def namespaced_unit(split: str | Column, raw_id: str) -> Column:
    """Unit key that cannot collide between splits: ``<split>_<id>``."""
    prefix = split if isinstance(split, Column) else F.lit(split)
    return F.concat_ws("_", prefix, F.col(raw_id).cast("bigint").cast("string"))


def lateness(spec: SeriesSpec) -> Column:
    """Sorts messages of a unit from the earliest to the latest; unknown time is last."""
    return F.struct(F.coalesce(-F.col(spec.ttr), inf()).alias("late"), F.col(spec.tie).alias("tie"))


def order_messages(df: DataFrame, spec: SeriesSpec, hot_rows: int = 5_000_000) -> DataFrame:
    """Add ``msg_index`` (0 = earliest) and ``n_msgs`` to every message.

    Units are numbered by a window per unit.  Units above ``hot_rows`` messages would
    swamp one task, so those are range-partitioned on their full sort order instead
    and numbered range by range.
    """
    sizes = df.groupBy(spec.unit).agg(F.count(F.lit(1)).alias("n_msgs"))
    hot = sizes.filter(F.col("n_msgs") > hot_rows)
    if hot.isEmpty():
        return number_by_window(df, spec)
    hot = stage(hot)
    usual = df.join(hot.select(spec.unit), spec.unit, "left_anti")
    return number_by_window(usual, spec).unionByName(
        number_by_ranges(df.join(hot, spec.unit), spec)
    )


def number_by_window(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    unit = Window.partitionBy(spec.unit)
    return df.withColumns({
        "msg_index": (F.row_number().over(unit.orderBy(lateness(spec))) - 1).cast("bigint"),
        "n_msgs": F.count(F.lit(1)).over(unit),
    })


def number_by_ranges(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Number the messages of huge units; expects ``n_msgs`` to be present."""
    ranged = stage(
        df.withColumn("late", lateness(spec))
        .repartitionByRange(spec.unit, "late")
        .withColumn("range_id", F.spark_partition_id())
    )
    before = Window.partitionBy(spec.unit).orderBy("range_id").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = ranged.groupBy(spec.unit, "range_id").agg(F.count(F.lit(1)).alias("n")).select(
        spec.unit, "range_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy(spec.unit, "range_id").orderBy("late")
    return (
        null_safe_join(ranged, offsets, [spec.unit, "range_id"])
        .withColumn("msg_index", F.col("offset") + F.row_number().over(inside) - 1)
        .drop("range_id", "offset", "late")
    )


def final_messages(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Value and time of each unit's last message: the target of the unit."""
    last = F.max_by(F.struct(F.col(spec.value), F.col(spec.ttr)), lateness(spec))
    return (
        df.groupBy(spec.unit)
        .agg(last.alias("last"))
        .select(
            spec.unit,
            F.col("last")[spec.value].alias("target"),
            F.col("last")[spec.ttr].alias("target_ttr"),
        )
    )


def attach_targets(df: DataFrame, targets: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Put the per-unit ``target`` and ``target_ttr`` on every message."""
    return df.join(targets.select(spec.unit, "target", "target_ttr"), spec.unit, "left")


def units_without_target(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """One row: the number of units whose target is missing."""
    per_unit = df.groupBy(spec.unit).agg(F.max(F.col("target").isNull().cast("int")).alias("bad"))
    return per_unit.agg(F.coalesce(F.sum("bad"), F.lit(0)).cast("bigint").alias("n_missing"))


def require_targets(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    missing = units_without_target(df, spec).first()["n_missing"]
    if missing:
        raise SeriesError(f"{missing} units have no target")
    return df


def admissible(df: DataFrame, spec: SeriesSpec, cutoff: float) -> DataFrame:
    """Messages a forecaster may see; the comparison is pushed into the scan."""
    return df.filter(F.col(spec.ttr) >= cutoff)


def last_k(df: DataFrame, spec: SeriesSpec, k: int) -> DataFrame:
    """The latest ``k`` messages of each unit, with ``recency`` 1 = latest.

    The rank limit is applied before the shuffle, so a huge unit sends only ``k`` rows
    per input partition.
    """
    w = Window.partitionBy(spec.unit).orderBy(
        F.col(spec.ttr).asc_nulls_first(), F.col(spec.tie).desc()
    )
    return df.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= k)


def eligible_units(
    df: DataFrame, spec: SeriesSpec, cutoff: float, recency: float, min_msgs: int = 2
) -> DataFrame:
    """Units with enough messages, a late last message and an early first one."""
    return (
        df.groupBy(spec.unit)
        .agg(
            F.count(F.lit(1)).alias("n_msgs"),
            F.min(spec.ttr).alias("last_ttr"),
            F.max(spec.ttr).alias("first_ttr"),
        )
        .filter(
            (F.col("n_msgs") >= min_msgs)
            & (F.col("last_ttr") < recency)
            & (F.col("first_ttr") >= cutoff)
        )
    )


def as_of(df: DataFrame, spec: SeriesSpec, cutoff: float, name: str = "known") -> DataFrame:
    """Each unit's value from its latest message at or before the cutoff.

    Units without one are absent.  Equal times resolve to the first message in tie order.
    """
    return (
        admissible(df, spec, cutoff)
        .groupBy(spec.unit)
        .agg(F.min_by(spec.value, F.struct(spec.ttr, spec.tie)).alias(name))
    )


def forecast_frame(
    df: DataFrame, spec: SeriesSpec, cutoff: float, constants: tuple[str, ...] = (), known: str = "known"
) -> DataFrame:
    """Target, as-of value, counts and times of every unit from one aggregation.

    The same numbers as :func:`final_messages`, :func:`as_of` and the counts of
    :func:`eligible_units`, without joining three per-unit tables.  ``known`` is NULL for
    units without an admissible message.
    """
    late = lateness(spec)
    seen = F.col(spec.ttr) >= cutoff
    known_order = F.when(seen, F.struct(spec.ttr, spec.tie))
    return (
        df.groupBy(spec.unit)
        .agg(
            *[F.min_by(c, late).alias(c) for c in constants],
            F.max_by(F.struct(F.col(spec.value).alias("v"), F.col(spec.ttr).alias("t")), late).alias("_last"),
            F.min_by(spec.value, known_order).alias(known),
            F.count(F.lit(1)).alias("n_msgs"),
            F.count_if(seen).alias("n_admissible"),
            F.min(spec.ttr).alias("last_ttr"),
            F.max(spec.ttr).alias("first_ttr"),
        )
        .withColumns({"target": F.col("_last.v"), "target_ttr": F.col("_last.t")})
        .drop("_last")
    )


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise SeriesError(f"no rows: {what}")
    return df


def unit_frame(
    df: DataFrame,
    spec: SeriesSpec,
    threshold: float,
    inclusive: bool = True,
    first: tuple[str, ...] = (),
) -> DataFrame:
    """One row per unit: constants, message count, target, last input time and value."""
    known = F.col(spec.value).isNotNull()
    constants = [c for c in (spec.group, *first) if c]
    return (
        df.groupBy(spec.unit)
        .agg(
            *[F.min_by(c, lateness(spec)).alias(c) for c in constants],
            F.count(F.lit(1)).alias("n_msgs"),
            F.max_by("target", lateness(spec)).alias("target"),
            F.max_by("target_ttr", lateness(spec)).alias("target_ttr"),
            F.min(spec.ttr).alias("last_input_ttr"),
            F.max_by(F.when(known, F.col(spec.value)), F.when(known, lateness(spec))).alias(
                "last_input_value"
            ),
        )
        .withColumn("is_high", high_flag(F.col("target"), threshold, inclusive))
    )


def stack_splits(*tables: DataFrame) -> DataFrame:
    """Stack per-split series tables that share their columns."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def trivial_units(pairs: DataFrame, known: str = "known", target: str = "target") -> DataFrame:
    """How many units already carry their final value at the cutoff."""
    same = approximately(F.col(known), F.col(target))
    return pairs.agg(
        F.count_if(same).alias("n_trivial"),
        F.count(F.lit(1)).alias("n_units"),
        F.try_divide(F.count_if(same), F.count(F.lit(1))).alias("share"),
    )
