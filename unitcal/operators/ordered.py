"""Global order statistics without a single-task window.

A window without ``partitionBy`` (or partitioned by a handful of groups) would pull
all rows into one task.  Here the rows are first collapsed to one per distinct value
(map-side combine, so a value that holds a third of the table is one row), then
range-partitioned, and the running totals are the in-range window plus the total of
the ranges before it.  Range tags are staged, so they cannot move between passes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitcal.session import stage

RANGE = "range_id"


def running_totals(
    df: DataFrame,
    order: str,
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """Per distinct ``order`` value of each group: totals, running and grand totals.

    Output: ``by``, ``order``, and per name in ``sums`` the columns ``name`` (total at
    the value), ``cum_name`` (up to and including it) and ``all_name`` (the group's).
    Rows whose ``order`` is NULL are left out.
    """
    by = list(by)
    collapsed = (
        df.filter(F.col(order).isNotNull())
        .groupBy(*by, order)
        .agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    )
    # The number of ranges is left to the session and to adaptive coalescing, which merges
    # neighbouring ranges only, so the tags stay in value order.
    ranged = stage(collapsed.repartitionByRange(order).withColumn(RANGE, F.spark_partition_id()))
    # One row per (group, range): at most groups x ranges rows.
    before = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = (
        ranged.groupBy(*by, RANGE)
        .agg(*[F.sum(name).alias(name) for name in sums])
        .select(
            *by,
            RANGE,
            *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"before_{name}") for name in sums],
            *[F.sum(name).over(whole).alias(f"all_{name}") for name in sums],
        )
    )
    inside = (
        Window.partitionBy(*by, RANGE)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        null_safe_join(ranged, offsets, [*by, RANGE])
        .withColumns({
            f"cum_{name}": F.col(f"before_{name}") + F.sum(name).over(inside) for name in sums
        })
        .drop(RANGE, *[f"before_{name}" for name in sums])
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; the right keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def with_row(df: DataFrame, row: DataFrame, name: str) -> DataFrame:
    """Attach a one-row table to every row as the struct column ``name``.

    The row enters the plan once, as a scalar subquery: no join, and no repeated
    evaluation when many of its fields are used.
    """
    return df.withColumn(name, row.select(F.struct(*row.columns).alias("r")).scalar())


def attach_one(
    left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join per-group tables; without groups the right side is one row and becomes a subquery."""
    if by:
        return null_safe_join(left, right, by, how)
    return with_row(left, right, "_one").select(*left.columns, "_one.*")


def dense_index(df: DataFrame, key: str, by: Sequence[str] = (), name: str = "idx") -> DataFrame:
    """Distinct ``key`` values of each group with their 0-based rank and the group size."""
    ranked = running_totals(df.select(*by, key).distinct(), key, {"one": F.lit(1)}, by)
    return ranked.select(
        *by, key, (F.col("cum_one") - 1).alias(name), F.col("all_one").alias("n_total")
    )


def quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation between the neighbouring order statistics.

    One row per group with a column per entry of ``probs``.  Values must be numbers;
    NULL is ignored.
    """
    ranked = running_totals(df, value, {"n": F.lit(1)}, by)
    return interpolate(ranked, value, probs, by)


def interpolate(
    ranked: DataFrame,
    value: str,
    probs: Mapping[str, float],
    by: Sequence[str] = (),
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Quantiles from a :func:`running_totals` table that counted rows as ``n``.

    ``extra`` adds aggregates over the same table, so that a summary needs one pass.
    """
    extra = extra or {}
    picked = {name: quantile_pick(value, name, p) for name, p in probs.items()}
    return (
        ranked.groupBy(*by)
        .agg(
            *[a for aggregates, _ in picked.values() for a in aggregates],
            *[c.alias(n) for n, c in extra.items()],
        )
        .select(*by, *extra, *[result.alias(name) for name, (_, result) in picked.items()])
    )


def quantile_pick(
    value: str, name: str, p: float, count: str = "n"
) -> tuple[list[Column], Column]:
    """Aggregates over a :func:`running_totals` table, and the quantile built from them.

    ``count`` is the running count that orders the sample (a table can order several).
    """
    at = F.lit(float(p)) * (F.col(f"all_{count}") - 1)
    aggregates = [
        F.min(F.when(F.col(f"cum_{count}") > rank, F.col(value))).alias(f"{side}_{name}")
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at)))
    ]
    aggregates.append(F.max(at - F.floor(at)).alias(f"part_{name}"))
    low, high = F.col(f"lo_{name}"), F.col(f"hi_{name}")
    return aggregates, low + F.col(f"part_{name}") * (high - low)


def average_ranks(
    df: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank", weight: Column | None = None
) -> DataFrame:
    """Average rank (1-based, ties share the mean) per distinct value, with the tie count.

    ``weight`` counts rows that stand for several equal ones.
    """
    ranked = running_totals(df, value, {"ties": F.lit(1) if weight is None else weight}, by)
    return ranked.select(
        *by,
        value,
        "ties",
        F.col("all_ties").alias("n_total"),
        (F.col("cum_ties") - (F.col("ties") - 1) / 2.0).alias(name),
    )
