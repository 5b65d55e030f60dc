"""Unit-level splits, samples and column-policy gates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitcal.functions import approximately
from unitcal.functions.columns import joined
from unitcal.operators.ordered import running_totals

# Summary suffixes a derived feature name may carry, and the
# bookkeeping columns that are never features.
SUMMARIES = ("last", "mean", "min", "max", "std", "delta")
BOOKKEEPING = (
    "event_uid",
    "split",
    "cdm_index",
    "n_cdms",
    "target_log_risk",
    "target_time_to_tca",
    "is_high_risk",
)


class SplitError(AssertionError):
    """A unit sits in more than one split."""


class FeatureSafetyError(ValueError):
    """A barred column reached a feature table."""


def split_units(
    units: DataFrame, unit: str, fractions: Mapping[str, float], seed: int
) -> DataFrame:
    """Random partition of the distinct units into named subsets: ``(unit, subset)``.

    Sizes are the half-even rounded shares; the last subset takes what is left.  The
    permutation is the order of ``md5(seed:unit)``, so it depends on nothing but the
    seed and the unit ids.
    """
    placed = shuffled(units, unit, seed)
    subset = by_rank(F.col("rank"), F.col("n_total"), fractions)
    return placed.select(unit, subset.alias("subset"))


def shuffled(units: DataFrame, unit: str, seed: int) -> DataFrame:
    """Distinct units with their 0-based ``rank`` in the seeded order, and ``n_total``."""
    place = F.struct(F.md5(joined(seed, F.col(unit))).alias("shuffle_key"), F.col(unit))
    placed = running_totals(
        units.select(unit).distinct().select(place.alias("place")), "place", {"one": F.lit(1)}
    )
    return placed.select(
        F.col("place")[unit].alias(unit),
        (F.col("cum_one") - 1).alias("rank"),
        F.col("all_one").alias("n_total"),
    )


def by_rank(rank: Column, total: Column, fractions: Mapping[str, float]) -> Column:
    """Subset name from a rank: consecutive blocks of the rounded sizes."""
    if abs(sum(fractions.values()) - 1.0) > 1e-9:
        raise ValueError(f"fractions must sum to 1, got {sum(fractions.values())}")
    *firsts, last = fractions
    edge, subset = F.lit(0), None
    for name in firsts:
        edge = edge + share_size(total, fractions[name])
        subset = F.when(rank < edge, name) if subset is None else subset.when(rank < edge, name)
    return F.lit(last) if subset is None else subset.otherwise(last)


def share_size(total: Column, fraction: float) -> Column:
    return F.bround(F.lit(float(fraction)) * total).cast("bigint")


def nested_split(
    units: DataFrame,
    unit: str,
    seed: int,
    fractions: Mapping[str, float] | None = None,
    inner_validation: float = 0.2,
) -> DataFrame:
    """Training pool into fit_inner / val_inner / calibration / self_test.

    Both levels use the same seeded order, so the units are ranked once: the first block
    is the fit pool, and the inner split cuts that block by the same rank.
    """
    fractions = fractions or {"fit": 0.6, "calibration": 0.2, "self_test": 0.2}
    if next(iter(fractions)) != "fit":
        raise ValueError("the fit pool must come first")
    rank, total = F.col("rank"), F.col("n_total")
    outer = by_rank(rank, total, fractions)
    inner = by_rank(
        rank,
        share_size(total, fractions["fit"]),
        {"fit_inner": 1.0 - inner_validation, "val_inner": inner_validation},
    )
    subset = F.when(outer == "fit", inner).otherwise(outer)
    return shuffled(units, unit, seed).select(unit, subset.alias("subset"))


def overlapping_units(splits: DataFrame, unit: str, subset: str = "subset") -> DataFrame:
    """Units that appear in more than one subset (empty when the split is sound)."""
    return (
        splits.groupBy(unit)
        .agg(F.countDistinct(subset).alias("n_subsets"))
        .filter(F.col("n_subsets") > 1)
    )


def require_disjoint(splits: DataFrame, unit: str, subset: str = "subset") -> DataFrame:
    example = overlapping_units(splits, unit, subset).first()
    if example is not None:
        raise SplitError(f"unit {example[unit]!r} is in {example['n_subsets']} subsets")
    return splits


def members(df: DataFrame, splits: DataFrame, unit: str, *subsets: str) -> DataFrame:
    """Rows whose unit belongs to one of ``subsets``."""
    wanted = splits.filter(F.col("subset").isin(*subsets)).select(unit)
    return df.join(wanted, unit, "left_semi")


def stratum(value: Column, floor: float, edges: Sequence[float]) -> Column:
    """0 for the floor value, i for (edges[i-1], edges[i]], NULL outside."""
    out = F.when(approximately(value, floor), 0)
    for i, (lo, hi) in enumerate(zip(edges, edges[1:]), start=1):
        out = out.when((value > lo) & (value <= hi), i)
    return out


def stratified_sample(
    df: DataFrame, strata: str, key: str, size: int, n_strata: int, seed: int
) -> DataFrame:
    """At most ``ceil(size / n_strata)`` rows of each stratum, drawn without replacement.

    Adds ``population`` and ``take`` of the stratum.  Rows are drawn in the order of
    ``md5(seed:key)``; the rank limit prunes before the shuffle.
    """
    per = -(-size // n_strata)
    known = df.filter(F.col(strata).isNotNull())
    order = Window.partitionBy(strata).orderBy(F.md5(joined(seed, F.col(key))), key)
    drawn = known.withColumn("draw", F.row_number().over(order)).filter(F.col("draw") <= per)
    counts = known.groupBy(strata).agg(F.count(F.lit(1)).alias("population"))
    return drawn.join(counts, strata).withColumn("take", F.least(F.lit(per), F.col("population")))


# --- column policy ---------------------------------------------------------------


def policy_class(
    hard_excluded: Sequence[str], include_ambiguous: bool = False, column: str = "column"
) -> Column:
    """Verdict on a policy row: hard_excluded, unsafe, ambiguous_excluded or admitted."""
    verdict = F.when(F.col(column).isin(*hard_excluded), "hard_excluded").when(
        F.col("leakage_class") == "unsafe", "unsafe"
    )
    if not include_ambiguous:
        verdict = verdict.when(F.col("leakage_class") == "ambiguous", "ambiguous_excluded")
    return verdict.otherwise("admitted")


def classify_columns(
    policy: Mapping[str, str], hard_excluded: Iterable[str] = (), include_ambiguous: bool = False
) -> dict[str, list[str]]:
    """Sort column names into the four verdicts.  ``policy`` maps column to leakage class."""
    barred = barred_columns(policy, hard_excluded, include_ambiguous)
    out = {k: [] for k in ("admitted", "unsafe", "ambiguous_excluded", "hard_excluded")}
    for column in sorted(policy):
        out[barred.get(column, "admitted")].append(column)
    return out


def barred_columns(
    policy: Mapping[str, str], hard_excluded: Iterable[str], include_ambiguous: bool
) -> dict[str, str]:
    reasons = {"unsafe": "unsafe"} if include_ambiguous else {
        "unsafe": "unsafe", "ambiguous": "ambiguous_excluded"
    }
    barred = {c: reasons[k] for c, k in policy.items() if k in reasons}
    return barred | {c: "hard_excluded" for c in hard_excluded if c in policy}


def source_column(name: str) -> str:
    """Raw column a derived feature summarises (``x_last`` -> ``x``), or the name itself."""
    for suffix in SUMMARIES:
        if name.endswith("_" + suffix):
            return name.removesuffix("_" + suffix)
    return name


def require_safe_features(
    columns: Iterable[str],
    policy: Mapping[str, str],
    hard_excluded: Iterable[str] = (),
    include_ambiguous: bool = False,
    history_of: str | None = None,
    bookkeeping: Iterable[str] = BOOKKEEPING,
) -> None:
    """Raise naming every column the policy bars, directly or through its source.

    ``history_of`` names the one value column whose pre-cutoff summaries are allowed.
    """
    barred = barred_columns(policy, hard_excluded, include_ambiguous)
    kept_out = set(bookkeeping)
    offenders = {}
    for name in columns:
        source = source_column(name)
        if name in barred:
            offenders[name] = barred[name]
        elif name in kept_out:
            offenders[name] = "bookkeeping or target column"
        elif source in barred and source != history_of:
            offenders[name] = f"summary of {source} ({barred[source]})"
    if offenders:
        listing = "; ".join(f"{n}: {why}" for n, why in sorted(offenders.items()))
        raise FeatureSafetyError(f"barred columns in the feature table: {listing}")


def policy_coverage(policy: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns without a policy row, and policy rows without a column: ``(column, problem)``."""
    missing = columns.join(policy, "column", "left_anti").select(
        "column", F.lit("missing").alias("problem")
    )
    extra = policy.join(columns, "column", "left_anti").select(
        "column", F.lit("extra").alias("problem")
    )
    return missing.unionByName(extra)


def incomplete_policy_rows(policy: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Policy rows in which a required field is empty, with the names of those fields."""
    empty = [F.when(F.col(f).isNull() | (F.trim(F.col(f)) == ""), F.lit(f)) for f in fields]
    return policy.select("column", F.array_compact(F.array(*empty)).alias("empty_fields")).filter(
        F.size("empty_fields") > 0
    )


def leakage_screen(scores: DataFrame, reference_loss: Column, factor: float = 2.0) -> DataFrame:
    """Flag models whose loss beats the reference by ``factor`` or more: too good to trust."""
    usable = F.col("loss").isNotNull() & ~F.isnan("loss") & (F.col("loss") > 0) & (
        F.col("loss") != float("inf")
    )
    ratio = F.when(usable, F.try_divide(reference_loss, F.col("loss")))
    return scores.withColumns({
        "loss_ratio": ratio,
        "suspicious": F.coalesce(ratio >= factor, F.lit(False)),
    })
