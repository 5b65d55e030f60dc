"""Conformal quantiles, intervals and their coverage, for all groups at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitcal.functions import inf, is_finite
from unitcal.functions.exact import binomial_p, clopper_pearson
from unitcal.operators.ordered import interpolate, null_safe_join, running_totals
from unitcal.operators.resample import resampled_share
from unitcal.session import stage

# Fixed value: slack in the comparisons of cumulative mass.
MASS_SLACK = 1e-12


class ConformalError(ValueError):
    """Calibration input that no interval can be built from."""


def nonconformity(truth: Column, pred: Column, sided: str) -> Column:
    """|y - p| for two-sided intervals, y - p for an upper bound."""
    if sided not in ("two", "upper"):
        raise ValueError(f"sided must be 'two' or 'upper', got {sided!r}")
    return F.abs(truth - pred) if sided == "two" else truth - pred


def score_table(
    df: DataFrame, truth: str, pred: str, sides: Sequence[str] = ("two", "upper")
) -> DataFrame:
    """Long table with one row per input row and side: adds ``sided`` and ``score``."""
    entries = [
        F.struct(F.lit(s).alias("sided"), nonconformity(F.col(truth), F.col(pred), s).alias("score"))
        for s in sides
    ]
    return df.withColumn("_s", F.explode(F.array(*entries))).select("*", "_s.*").drop("_s")


def require_scores(cal: DataFrame, score: str = "score", weight: str | None = None) -> DataFrame:
    """Gate on finite scores and on finite, non-negative weights with a positive sum."""
    checks = [F.count(F.lit(1)).alias("n"), F.count_if(~is_finite(F.col(score))).alias("bad")]
    if weight:
        w = F.col(weight)
        checks += [
            F.count_if(~is_finite(w) | (w < 0)).alias("bad_weights"),
            F.sum(F.when(is_finite(w), w)).alias("total"),
        ]
    row = cal.agg(*checks).first()
    if row["n"] == 0:
        raise ConformalError("no calibration scores")
    if row["bad"]:
        raise ConformalError(f"{row['bad']} calibration scores are not finite")
    if weight and row["bad_weights"]:
        raise ConformalError("weights must be finite and non-negative")
    if weight and not row["total"]:
        raise ConformalError("weights sum to zero")
    return cal


@dataclass(frozen=True)
class Weighting:
    """How one method weighs the calibration rows.

    ``weight`` names a column (uniform without it).  ``test_weight`` is a one-row or
    per-group table with the test point's weight; without it the mean calibration weight
    is used.  ``shrink`` is a like table with an ``alpha_shift`` taken off alpha (the bias
    of clipped weights).
    """

    weight: str | None = None
    test_weight: DataFrame | None = None
    shrink: DataFrame | None = None


def conformal_quantiles(
    cal: DataFrame,
    levels: Sequence[float],
    weightings: Mapping[str, Weighting],
    by: Sequence[str] = (),
    score: str = "score",
) -> DataFrame:
    """Score quantiles with the test point's mass at +Infinity, for several weightings at once.

    All weightings share one ordering of the scores: each is one more running sum in the
    same pass.  One row per (group, method, level): ``alpha, q, n_cal``.
    """
    for level in levels:
        if not 0.0 < level < 1.0:
            raise ValueError(f"level must be in (0, 1), got {level}")
    by = list(by)
    sums = {"n": F.lit(1)}
    for i, spec in enumerate(weightings.values()):
        sums[f"w{i}"] = F.col(spec.weight).cast("double") if spec.weight else F.lit(1.0)
    ranked = running_totals(cal, score, sums, by)
    for i, spec in enumerate(weightings.values()):
        ranked = with_group_value(ranked, spec.test_weight, "test_weight", f"atom{i}", by)
        ranked = with_group_value(ranked, spec.shrink, "alpha_shift", f"shift{i}", by)
    picked, rows = [], []
    for i, method in enumerate(weightings):
        total = F.col(f"all_w{i}")
        atom = F.coalesce(F.col(f"atom{i}"), total / F.col("all_n"))
        mass = total + atom
        for j, level in enumerate(levels):
            alpha = alpha_after(level, F.coalesce(F.col(f"shift{i}"), F.lit(0.0)))
            reached = F.col(f"cum_w{i}") / mass >= 1.0 - alpha - MASS_SLACK
            tag = f"{i}_{j}"
            picked += [
                F.min(F.when(reached, F.col(score))).alias(f"q{tag}"),
                F.max(atom / mass > alpha + MASS_SLACK).alias(f"open{tag}"),
                F.max(alpha).alias(f"alpha{tag}"),
            ]
            q = F.when(F.col(f"open{tag}"), inf()).otherwise(F.coalesce(f"q{tag}", "largest"))
            rows.append(F.struct(
                F.lit(method).alias("method"), F.lit(float(level)).alias("level"),
                F.col(f"alpha{tag}").alias("alpha"), q.alias("q"),
            ))
    wide = ranked.groupBy(*by).agg(
        F.max("all_n").alias("n_cal"), F.max(score).alias("largest"), *picked
    )
    return wide.select(*by, "n_cal", F.explode(F.array(*rows)).alias("r")).select(*by, "r.*", "n_cal")


def conformal_quantile(
    cal: DataFrame,
    levels: Sequence[float],
    by: Sequence[str] = (),
    score: str = "score",
    weight: str | None = None,
    test_weight: DataFrame | None = None,
    shrink: DataFrame | None = None,
) -> DataFrame:
    """:func:`conformal_quantiles` for one weighting: ``by, level, alpha, q, n_cal``."""
    one = {"only": Weighting(weight, test_weight, shrink)}
    return conformal_quantiles(cal, levels, one, by, score).drop("method")


def alpha_after(level: float, shift: Column) -> Column:
    """1 - level, lowered by the clip bias but never below 1e-6."""
    alpha = F.lit(1.0 - float(level))
    return F.when(shift > 0, F.greatest(alpha - shift, F.lit(1e-6))).otherwise(alpha)


def with_group_value(
    df: DataFrame, table: DataFrame | None, column: str, name: str, by: Sequence[str]
) -> DataFrame:
    """Attach a per-group value; a table without group columns holds one value for all."""
    if table is None:
        return df.withColumn(name, F.lit(None).cast("double"))
    keys = [c for c in table.columns if c in by]
    if not keys:
        return df.withColumn(name, table.select(column).scalar())
    return null_safe_join(df, table.select(*keys, F.col(column).alias(name)), keys, "left")


def order_statistic_quantile(
    cal: DataFrame, levels: Sequence[float], by: Sequence[str] = (), score: str = "score"
) -> DataFrame:
    """Uniform-weight special case: the ceil((n+1)(1-alpha))-th smallest score."""
    ranked = running_totals(cal, score, {"n": F.lit(1)}, by)
    picked = []
    for i, level in enumerate(levels):
        place = F.ceil((F.col("all_n") + 1) * F.lit(float(level)) - 1e-9)
        picked += [
            F.min(F.when(F.col("cum_n") >= place, F.col(score))).alias(f"q{i}"),
        ]
    wide = ranked.groupBy(*by).agg(*picked)
    rows = [
        F.struct(F.lit(float(v)).alias("level"), F.coalesce(F.col(f"q{i}"), inf()).alias("q"))
        for i, v in enumerate(levels)
    ]
    return wide.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.level", "r.q")


def interval_bounds(pred: Column, q: Column, sided: Column) -> dict[str, Column]:
    """pred +- q, or (-Infinity, pred + q] for an upper bound."""
    return {"lo": F.when(sided == "two", pred - q).otherwise(-inf()), "hi": pred + q}


def attach_intervals(
    test: DataFrame, q: DataFrame, keys: Sequence[str], pred: str = "pred", truth: str | None = None
) -> DataFrame:
    """Intervals for every test row and every (side, level) of the quantile table.

    ``keys`` are shared group columns (for example the learner).  With ``truth`` the
    coverage indicator is added; both end points belong to the interval.  How ``q`` is
    joined is left to adaptive execution, which knows its size when it is staged.
    """
    joined = null_safe_join(test, q, keys) if keys else with_quantiles(test, q)
    out = joined.withColumns(interval_bounds(F.col(pred), F.col("q"), F.col("sided")))
    out = out.withColumn("width", F.col("hi") - F.col("lo"))
    if truth:
        out = out.withColumn("covered", covers(F.col(truth), F.col("lo"), F.col("hi")))
    return out


def with_quantiles(test: DataFrame, q: DataFrame) -> DataFrame:
    """Attach an ungrouped quantile table (sides x levels) to every row without a join."""
    packed = q.agg(F.collect_list(F.struct(*q.columns)).alias("p"))
    return test.withColumn("_q", F.explode(packed.scalar())).select("*", "_q.*").drop("_q")


def covers(truth: Column, lo: Column, hi: Column) -> Column:
    return (truth >= lo) & (truth <= hi)


def empirical_coverage(df: DataFrame, truth: str, lo: str, hi: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows inside [lo, hi], with the number of reversed intervals found."""
    inside = covers(F.col(truth), F.col(lo), F.col(hi)).cast("int")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(inside).alias("coverage"),
        F.count_if(F.col(hi) < F.col(lo)).alias("n_reversed"),
    )


def require_intervals(coverage: DataFrame) -> DataFrame:
    row = coverage.agg(F.sum("n").alias("n"), F.sum("n_reversed").alias("bad")).first()
    if not row["n"]:
        raise ConformalError("cannot compute coverage on an empty set")
    if row["bad"]:
        raise ConformalError(f"{row['bad']} intervals have hi < lo")
    return coverage


def coverage_table(
    intervals: DataFrame, by: Sequence[str], bounds: bool = True, level: float = 0.95
) -> DataFrame:
    """Coverage per group: n, n_covered, share of infinite widths, median finite width, exact bounds."""
    by = list(by)
    finite = is_finite(F.col("width")).cast("int")
    ranked = running_totals(
        intervals, "width", {"all": F.lit(1), "hits": F.col("covered").cast("int"), "n": finite}, by
    )
    # infinite widths sort last, so the running count of finite ones orders the finite part
    out = interpolate(ranked, "width", {"median_width": 0.5}, by, {
        "total": F.sum("all"), "n_covered": F.sum("hits"), "n_finite": F.sum("n"),
    }).select(
        *by,
        F.col("total").alias("n"),
        "n_covered",
        (F.col("n_covered") / F.col("total")).alias("coverage"),
        (1.0 - F.col("n_finite") / F.col("total")).alias("share_infinite"),
        F.when(F.col("n_finite") > 0, F.col("median_width")).otherwise(inf()).alias("median_width"),
    )
    if bounds:
        out = out.withColumn(
            "_b", clopper_pearson(F.col("n_covered"), F.col("n"), level)
        ).select("*", "_b.*").drop("_b")
    return out


def coverage_with_bounds(
    intervals: DataFrame, by: Sequence[str], level: float = 0.95, **drawing
) -> DataFrame:
    """:func:`coverage_table` plus percentile bounds from resampled units, for every group."""
    table = coverage_table(intervals, by, True, level)
    return table.withColumn("_s", resampled_share(F.col("n_covered"), F.col("n"), level, **drawing)).select(
        *table.columns, F.col("_s.lo").alias("boot_lo"), F.col("_s.hi").alias("boot_hi")
    )


def sweep(
    cal: DataFrame,
    evaluations: Mapping[str, DataFrame],
    levels: Sequence[float],
    weightings: Mapping[str, Weighting],
    supported: Column,
    keys: Sequence[str] = ("learner", "seed"),
    truth: str = "target",
    pred: str = "pred",
    sides: Sequence[str] = ("two", "upper"),
) -> DataFrame:
    """Per-row intervals of the whole comparison as one long table.

    ``cal`` and the ``evaluations`` are prediction tables ``(*keys, truth, pred, ...)``;
    ``cal`` also carries the weight columns.  Every evaluation gets the plain quantile
    under its own name; every weighting is evaluated as ``weighted_<name>`` on the
    supported rows of the evaluation called ``naive``.
    """
    keys = list(keys)
    scored = score_table(cal, truth, pred, sides)
    every = {"plain": Weighting()} | {f"weighted_{n}": w for n, w in weightings.items()}
    # a few rows: groups x sides x levels x methods
    q = stage(conformal_quantiles(scored, levels, every, [*keys, "sided"]))
    plain = q.filter("method = 'plain'").drop("method")
    parts = [
        attach_intervals(table, plain, keys, pred, truth).withColumn("method", F.lit(name))
        for name, table in evaluations.items()
    ]
    if weightings:
        weighted = q.filter("method <> 'plain'")
        parts.append(attach_intervals(evaluations["naive"].filter(supported), weighted, keys, pred, truth))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def aggregate_coverage(rows: DataFrame) -> DataFrame:
    """Over seeds: mean and sd of coverage, mean width and bounds, gap to nominal in points.

    ``n`` is the first seed's; the bounds are means of the per-seed bounds.
    """
    return (
        rows.groupBy("learner", "method", "sided", "level")
        .agg(
            F.avg("coverage").alias("coverage_mean"),
            F.stddev_samp("coverage").alias("coverage_sd"),
            F.min_by("n", "seed").alias("n"),
            F.avg("median_width").alias("median_width_mean"),
            F.avg("cp_lo").alias("cp_lo_mean"),
            F.avg("cp_hi").alias("cp_hi_mean"),
            F.avg("share_infinite").alias("share_infinite"),
            F.countDistinct("seed").alias("n_seeds"),
        )
        .withColumn("gap_pp", 100.0 * (F.col("coverage_mean") - F.col("level")))
    )


def naive_weighted_contrast(rows: DataFrame, level: float, method: str = "weighted_rule") -> DataFrame:
    """Per learner at one two-sided level: naive and weighted coverage and their gaps."""
    at = rows.filter(
        (F.abs(F.col("level") - level) < 1e-9)
        & (F.col("sided") == "two")
        & F.col("method").isin("naive", method)
    )
    naive = F.avg(F.when(F.col("method") == "naive", F.col("coverage")))
    weighted = F.avg(F.when(F.col("method") == method, F.col("coverage")))
    return at.groupBy("learner").agg(
        naive.alias("naive_coverage"),
        weighted.alias("weighted_coverage"),
        (100.0 * (weighted - naive)).alias("gap_closed_pp"),
        (100.0 * (naive - level)).alias("naive_gap_pp"),
        (100.0 * (weighted - level)).alias("weighted_gap_pp"),
    )


def paired_coverage(
    intervals: DataFrame, unit: str, first: str = "naive", second: str = "weighted_rule",
    by: Sequence[str] = ("learner", "level"),
) -> DataFrame:
    """Same units under two methods: covered by both, only one, or neither."""
    per_unit = (
        intervals.filter(F.col("method").isin(first, second))
        .groupBy(*by, unit)
        .agg(
            F.bool_or(F.when(F.col("method") == first, F.col("covered"))).alias("a"),
            F.bool_or(F.when(F.col("method") == second, F.col("covered"))).alias("b"),
        )
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    )
    a, b = F.col("a"), F.col("b")
    return per_unit.groupBy(*by).agg(
        F.count_if(a & b).alias("both"),
        F.count_if(a & ~b).alias("only_first"),
        F.count_if(~a & b).alias("only_second"),
        F.count_if(~a & ~b).alias("neither"),
    )


def mcnemar(paired: DataFrame) -> DataFrame:
    """Exact McNemar p-value on the discordant counts (1 when there are none)."""
    discordant = F.col("only_first") + F.col("only_second")
    return paired.withColumn(
        "p_value", binomial_p(F.least("only_first", "only_second"), discordant, F.lit(0.5))
    )


def largest_gap(rows: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """The row with the largest absolute gap to nominal per method."""
    rest = [c for c in rows.columns if c not in by]
    return (
        rows.groupBy(*by)
        .agg(F.max_by(F.struct(*rest), F.struct(F.abs("gap_pp"), "learner", "sided", "level")).alias("r"))
        .select(*by, "r.*")
    )


def method_pivot(rows: DataFrame, methods: Sequence[str], value: str = "coverage_mean") -> DataFrame:
    """One row per (learner, sided, level) with a column per method."""
    return rows.groupBy("learner", "sided", "level").pivot("method", list(methods)).agg(F.first(value))
