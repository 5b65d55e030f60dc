"""Unit-level bootstrap and exact intervals.

A statistic is given by *additive parts*: per-unit columns whose sums determine it
(a mean is ``x`` and the count, the point score is its confusion counts and squared
error).  A replicate is then one row of sums, and no unit list is ever materialised.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from unitcal.functions import is_finite, nan
from unitcal.functions.columns import TWO_32
from unitcal.functions.exact import clopper_pearson
from unitcal.operators.ordered import attach_one, dense_index, null_safe_join
from unitcal.operators.score import additive_score_parts, score_from_parts

SLOTS = 4
POISSON_CUTS = 12
#: Units whose draws are made together, and groups whose sums a task holds before it sends them.
UNITS_AT_ONCE, GROUPS_AT_ONCE = 256, 256
#: Exact draws: index rows whose draws are made together, and units of a stretch of the index (at most 2**16).
DRAWN_AT_ONCE, STRETCH = 1024, 16_384


class ResampleError(ValueError):
    """A bootstrap that cannot be reported."""


def poisson_steps() -> list[int]:
    """Integer cut points of a 32-bit draw for Poisson(1) counts."""
    cdf, term, out = 0.0, math.exp(-1.0), []
    for k in range(POISSON_CUTS):
        cdf += term
        term /= k + 1
        out.append(math.floor(cdf * TWO_32))
    return out


def poisson_count(draw: Column) -> Column:
    """Poisson(1) count by inverse distribution function of a 32-bit draw."""
    count = F.lit(0)
    for step in poisson_steps():
        count = count + (draw >= step).cast("int")
    return count


def draw_table(keys: Sequence[int], n_replicates: int, seed: int) -> np.ndarray:
    """Draws of 64 bits (keys x replicates); one md5 digest serves two replicates."""
    blocks = -(-n_replicates // 2)
    starts = [hashlib.md5(f"{seed}:{block}:".encode(), usedforsecurity=False) for block in range(blocks)]
    digests = []
    for key in keys:
        tail = str(key).encode()
        for start in starts:
            h = start.copy()
            h.update(tail)
            digests.append(h.digest())
    return np.frombuffer(b"".join(digests), ">u8").reshape(len(keys), blocks * 2)[:, :n_replicates]


def draw_table_fast(keys: Sequence[int], n_replicates: int, seed: int) -> np.ndarray:
    """The same from the mixed bits of key and replicate."""
    with np.errstate(over="ignore"):
        x = np.array(keys, np.uint64)[:, None] * np.uint64(0xD1342543DE82EF95) + (np.arange(1, n_replicates + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def exact_sums(
    units: DataFrame, index: DataFrame, parts: Sequence[str], n_replicates: int, seed: int, by: Sequence[str], fast: bool
) -> DataFrame:
    """Per group, stretch of the index and replicate: the drawn rows and the sum of each part over them.

    ``index`` holds every (by, idx, n_total) once, ``units`` the parts at (by, idx).  Draws are made where the
    index rows live and sent to the stretch of ``STRETCH`` units that they name, as two bytes each; a stretch's
    draws and units meet in one task, of a size that does not grow with the table.  Nothing is broadcast.
    """
    by, make = list(by), draw_table_fast if fast else draw_table
    wide = len(parts) + 1
    keys = index.select(*by).schema
    sent = index.select(*by).schema.add("_stretch", "long").add("_counts", "binary").add("_offsets", "binary")
    out = index.select(*by).schema.add("replicate", "long").add("n_drawn", "long")
    for name in parts:
        out = out.add(name, "double")
    types = to_arrow_schema(keys).types
    tail = to_arrow_schema(out).names

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = list(zip(*[c.to_pylist() for c in batch.columns[:len(by)]])) if by else [()] * len(batch)
            idx, total = batch.column(len(by)).to_pylist(), batch.column(len(by) + 1).to_pylist()
            rows_of: dict[tuple, list[int]] = {}
            for i, g in enumerate(groups):
                rows_of.setdefault(g, []).append(i)
            for g, rows in rows_of.items():
                for start in range(0, len(rows), DRAWN_AT_ONCE):
                    some = rows[start:start + DRAWN_AT_ONCE]
                    at = (make([idx[i] for i in some], n_replicates, seed) % np.uint64(total[some[0]])).T.ravel()
                    place = (at // np.uint64(STRETCH)).astype(np.int64)
                    stretches = -(-total[some[0]] // STRETCH)
                    order = np.argsort(place.astype(np.uint16) if stretches < 1 << 16 else place, kind="stable")
                    cells = place * n_replicates + np.repeat(np.arange(n_replicates), len(some))
                    counts = np.bincount(cells, minlength=stretches * n_replicates).astype(np.uint16).reshape(stretches, -1)
                    offsets = (at % np.uint64(STRETCH)).astype(np.uint16)[order]
                    ends = np.cumsum(counts.sum(axis=1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v] * stretches, t) for v, t in zip(g, types)] + [
                            pa.array(np.arange(stretches)), pa.array([c.tobytes() for c in counts], pa.binary()),
                            pa.array([o.tobytes() for o in np.split(offsets, ends[:-1])], pa.binary()),
                        ], names=[*by, "_stretch", "_counts", "_offsets"],
                    )

    def gather(picks: pa.Table, rows: pa.Table) -> pa.Table:
        at = rows.column("idx").to_numpy() % STRETCH
        columns = [rows.column(name).combine_chunks() for name in parts]
        there = [np.ones(len(at))] + [c.is_valid().to_numpy(zero_copy_only=False).astype(float) for c in columns]
        x = [there[0]] + [c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns]
        x, there = ([np.bincount(at, weights=v, minlength=STRETCH) for v in side] for side in (x, there))
        gaps = [i for i in range(1, wide) if (there[i] < there[0]).any()]
        sums, seen = np.zeros((wide, n_replicates)), np.zeros((wide, n_replicates))
        for counts, offsets in zip(picks.column("_counts"), picks.column("_offsets")):
            offsets = np.frombuffer(offsets.as_buffer(), np.uint16)
            replicate = np.repeat(np.arange(n_replicates), np.frombuffer(counts.as_buffer(), np.uint16))
            for i in range(wide):
                sums[i] += np.bincount(replicate, weights=x[i][offsets], minlength=n_replicates)
            for i in gaps:
                seen[i] += np.bincount(replicate, weights=there[i][offsets], minlength=n_replicates)
        key = [(picks if len(picks) else rows).column(name)[0].as_py() for name in by]
        return pa.Table.from_arrays(
            [pa.array([v] * n_replicates, t) for v, t in zip(key, types)] + [
                pa.array(np.arange(n_replicates)), pa.array(sums[0].astype(np.int64)),
                *[pa.array(sums[i], mask=(seen[i] if i in gaps else sums[0]) == 0) for i in range(1, wide)],
            ], names=tail,
        )

    # every index row becomes all replicates' draws here, so the number of tasks must follow from that work
    width = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    picks = index.select(*by, "idx", "n_total").repartition(width, *by, "idx").mapInArrow(draw, sent)
    placed = units.select(*by, "idx", *parts).withColumn("_stretch", F.floor(F.col("idx") / STRETCH).cast("long"))
    return picks.groupBy(*by, "_stretch").cogroup(placed.groupBy(*by, "_stretch")).applyInArrow(gather, out)


def poisson_table(keys: list[str], n_replicates: int, seed: int, steps: np.ndarray) -> np.ndarray:
    """Poisson(1) counts (keys x replicates); one md5 digest serves four replicates."""
    blocks = -(-n_replicates // SLOTS)
    starts = [hashlib.md5(f"{seed}:{block}".encode(), usedforsecurity=False) for block in range(blocks)]
    digests = []
    for key in keys:
        tail = key.encode()
        for start in starts:
            h = start.copy()
            h.update(tail)
            digests.append(h.digest())
    draws = np.frombuffer(b"".join(digests), ">u4").reshape(len(keys), blocks * SLOTS)[:, :n_replicates]
    return np.searchsorted(steps, draws.astype(np.int64), side="right")


def poisson_table_fast(hashes: np.ndarray, n_replicates: int, seed: int, steps: np.ndarray) -> np.ndarray:
    """The same from 64-bit hashes of the keys, mixed with the replicate."""
    with np.errstate(over="ignore"):
        x = hashes.view(np.uint64)[:, None] + (np.arange(1, n_replicates + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(steps, (x >> np.uint64(32)).astype(np.int64), side="right")


def poisson_sums(
    values: DataFrame, unit: str, parts: Sequence[str], n_replicates: int, seed: int, by: Sequence[str], fast: bool
) -> DataFrame:
    """Per task, group and replicate: the sum of the counts and of each part times its count.

    Sums are kept in arrays of ``n_replicates`` where the units live; a part without any value is NULL.
    """
    steps, wide = np.array(poisson_steps()), len(parts) + 1
    key = F.xxhash64(unit) if fast else F.coalesce(F.concat(F.lit(":"), F.col(unit).cast("string")), F.lit(""))
    source = values.select(*by, key.alias("_key"), *parts)
    schema = source.select(*by).schema.add("replicate", "long").add("n_drawn", "long")
    for name in parts:
        schema = schema.add(name, "double")
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        types: list[pa.DataType] = []

        def sent() -> pa.RecordBatch:
            groups = list(held)
            columns = [pa.array([g[i] for g in groups for _ in range(n_replicates)], types[i]) for i in range(len(by))]
            columns.append(pa.array(np.tile(np.arange(n_replicates), len(groups))))
            columns.append(pa.array(np.concatenate([held[g][0][0] for g in groups]).astype(np.int64)))
            for i in range(1, wide):
                sums = np.concatenate([held[g][0][i] for g in groups])
                columns.append(pa.array(sums, mask=np.repeat([not held[g][1][i] for g in groups], n_replicates)))
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            types = [c.type for c in batch.columns[:len(by)]]
            for start in range(0, len(batch), UNITS_AT_ONCE):
                part = batch.slice(start, UNITS_AT_ONCE)
                keys = part.column(len(by))
                times = (
                    poisson_table_fast(keys.to_numpy(), n_replicates, seed, steps) if fast
                    else poisson_table(keys.to_pylist(), n_replicates, seed, steps)
                )
                there = [np.ones(len(part), bool)] + [c.is_valid().to_numpy(zero_copy_only=False) for c in part.columns[len(by) + 1:]]
                x = [np.ones(len(part))] + [c.fill_null(0.0).to_numpy() for c in part.columns[len(by) + 1:]]
                groups = list(zip(*[c.to_pylist() for c in part.columns[:len(by)]])) if by else [()] * len(part)
                rows_of: dict[tuple, list[int]] = {}
                for i, g in enumerate(groups):
                    rows_of.setdefault(g, []).append(i)
                for g, rows in rows_of.items():
                    if g not in held:
                        held[g] = [np.zeros((wide, n_replicates)), np.zeros(wide, bool)]
                    held[g][0] += np.stack([v[rows] for v in x]) @ times[rows]
                    held[g][1] |= np.array([t[rows].any() for t in there])
                if len(held) > GROUPS_AT_ONCE:
                    yield sent()
        if held:
            yield sent()

    return source.mapInArrow(run, schema)


def replicates(
    df: DataFrame,
    unit: str,
    parts: Mapping[str, Column],
    n_replicates: int = 2000,
    seed: int = 42,
    by: Sequence[str] = (),
    mode: str = "poisson",
    fast: bool = False,
) -> DataFrame:
    """Sums of the parts for every bootstrap replicate: ``by``, ``replicate``, ``n_drawn``, parts.

    ``exact`` draws n units with replacement: draw j of replicate b is
    ``md5(seed:b:j) mod n`` looked up in a dense unit index.  It shuffles two bytes
    per unit and replicate.  ``poisson`` gives each unit an
    independent Poisson(1) count per replicate; the counts are summed where the unit lives
    and only one row per (task, group, replicate) is made and shuffled.
    """
    by = list(by)
    values = df.select(*by, unit, *[c.cast("double").alias(n) for n, c in parts.items()])
    if mode == "poisson":
        # every row is multiplied by the replicates here, so the number of tasks must follow
        # from that work and not from the bytes of the narrow input
        width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sums = poisson_sums(values.repartition(width, unit), unit, list(parts), n_replicates, seed, by, fast)
        return sums.groupBy(*by, "replicate").agg(
            F.sum("n_drawn").alias("n_drawn"), *[F.sum(n).alias(n) for n in parts]
        )
    if mode != "exact":
        raise ValueError(f"mode must be 'exact' or 'poisson', got {mode!r}")
    index = dense_index(values, unit, by)
    units = null_safe_join(values, index.drop("n_total"), [*by, unit])
    return exact_sums(units, index, list(parts), n_replicates, seed, by, fast).groupBy(*by, "replicate").agg(
        F.sum("n_drawn").alias("n_drawn"), *[F.sum(n).alias(n) for n in parts]
    )


def percentile_intervals(
    reps: DataFrame, statistics: Mapping[str, Column], by: Sequence[str] = (), level: float = 0.95
) -> DataFrame:
    """Percentile bounds of each statistic over its defined replicates.

    Undefined replicates (NULL, NaN, infinite) are left out and counted in
    ``<name>_undefined``; without any defined replicate the bounds are NaN.
    """
    if not 0.0 < level < 1.0:
        raise ValueError(f"level must be in (0, 1), got {level}")
    tail = (1.0 - level) / 2.0
    valued = reps.select(*by, *[c.cast("double").alias(n) for n, c in statistics.items()])
    aggs, outputs = [], []
    for name in statistics:
        c = F.col(name)
        ok = is_finite(c)
        # at most n_replicates values per group, so the built-in exact percentile is bounded
        aggs += [
            F.percentile(F.when(ok, c), F.array(F.lit(tail), F.lit(1.0 - tail))).alias(f"b_{name}"),
            F.count_if(~ok | c.isNull()).alias(f"{name}_undefined"),
        ]
        outputs += [
            F.coalesce(F.col(f"b_{name}")[0], nan()).alias(f"{name}_lo"),
            F.coalesce(F.col(f"b_{name}")[1], nan()).alias(f"{name}_hi"),
            f"{name}_undefined",
        ]
    return valued.groupBy(*by).agg(*aggs).select(*by, *outputs)


def require_defined(intervals: DataFrame, name: str) -> DataFrame:
    if intervals.filter(F.isnan(f"{name}_lo")).limit(1).count():
        raise ResampleError(f"{name} is undefined on every replicate")
    return intervals


def bootstrap_means(
    df: DataFrame,
    unit: str,
    columns: Mapping[str, Column],
    by: Sequence[str] = (),
    level: float = 0.95,
    **drawing,
) -> DataFrame:
    """Point value and percentile bounds of the mean of each column, in one pass."""
    points = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_units"), *[F.avg(c.cast("double")).alias(n) for n, c in columns.items()]
    )
    reps = replicates(df, unit, columns, by=by, **drawing)
    means = {n: F.try_divide(F.col(n), F.col("n_drawn")) for n in columns}
    return attach_one(points, percentile_intervals(reps, means, by, level), by)


def bootstrap_score(
    df: DataFrame,
    unit: str,
    truth: str,
    pred: str,
    by: Sequence[str] = (),
    threshold: float = -6.0,
    beta: float = 2.0,
    epsilon: float | None = 0.001,
    level: float = 0.95,
    **drawing,
) -> DataFrame:
    """Bounds on loss, error and F-score; both components are redrawn before they divide."""
    parts = additive_score_parts(F.col(truth), F.col(pred), threshold, epsilon)
    reps = replicates(df, unit, parts, by=by, **drawing)
    score = score_from_parts(beta)
    wanted = {n: score[n] for n in ("loss", "mse_high", "f_beta")}
    return percentile_intervals(reps, wanted, by, level)


def score_with_bounds(
    df: DataFrame,
    unit: str,
    truth: str,
    pred: str,
    by: Sequence[str] = (),
    threshold: float = -6.0,
    beta: float = 2.0,
    epsilon: float | None = 0.001,
    **drawing,
) -> DataFrame:
    """Score row and its bounds; the bounds are NaN when every replicate was undefined."""
    from unitcal.operators.score import point_score

    rows = point_score(df, truth, pred, by, threshold, beta, epsilon)
    bounds = bootstrap_score(df, unit, truth, pred, by, threshold, beta, epsilon, **drawing)
    return attach_one(rows, bounds, by)


def binomial_draws(k: int, n: int, u: np.ndarray) -> np.ndarray:
    """Successes among ``n`` draws with chance k / n, by the inverse distribution at each ``u``.

    Probabilities follow from that of the mode by their ratios, as far out as they matter.
    """
    if k == 0 or k == n:
        return np.full(len(u), k)
    reach = 14 * math.sqrt(k * (1 - k / n)) + 30
    low, high = max(0, math.floor(k - reach)), min(n, math.ceil(k + reach))
    at = np.arange(low, high)
    steps = np.concatenate([[0.0], np.cumsum(np.log((n - at) / (at + 1.0)) + math.log(k / (n - k)))])
    p = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(k / n) + (n - k) * math.log1p(-k / n)
    return np.minimum(low + np.searchsorted(np.cumsum(np.exp(steps - steps[k - low] + p)), u, side="left"), high)


def resampled_share(k: Column, n: Column, level: float = 0.95, n_replicates: int = 2000, seed: int = 42) -> Column:
    """Struct (lo, hi): percentile bounds of the share k / n over resamples of its rows.

    A resample of n flags of which k are set is one binomial number, so it is drawn from (k, n) and no row per
    unit and replicate is made.  Draw r is ``md5(seed:r)`` for every group.  Without rows the bounds are NaN.
    """
    words = [hashlib.md5(f"{seed}:{r}".encode(), usedforsecurity=False).hexdigest()[:8] for r in range(n_replicates)]
    u = (np.array([int(w, 16) for w in words]) + 0.5) / TWO_32
    tails = [(1.0 - level) / 2.0, (1.0 + level) / 2.0]

    @F.arrow_udf("lo double, hi double")
    def bounds(ks: pa.Array, ns: pa.Array) -> pa.Array:
        found = [
            np.quantile(binomial_draws(a, b, u) / b, tails) if b else (math.nan, math.nan)
            for a, b in zip(ks.to_pylist(), ns.to_pylist())
        ]
        return pa.StructArray.from_arrays([pa.array([float(f[i]) for f in found], pa.float64()) for i in range(2)], names=["lo", "hi"])

    return bounds(k, n)


def share_bounds(
    df: DataFrame, flag: Column, by: Sequence[str] = (), level: float = 0.95, n_replicates: int = 2000, seed: int = 42,
    unit: str | None = None,
) -> DataFrame:
    """n_units and k (rows whose flag is set), share and its percentile bounds; rows without a flag are left out.

    With ``unit`` every unit is drawn by its own Poisson counts, as in :func:`replicates`; without it the share is
    resampled from (k, n).
    """
    counts = df.groupBy(*by).agg(F.count(flag).alias("n_units"), F.count_if(flag).alias("k"))
    if unit is not None:
        reps = replicates(df.filter(flag.isNotNull()), unit, {"k": flag.cast("int")}, n_replicates, seed, by)
        bounds = percentile_intervals(reps, {"share": F.try_divide("k", "n_drawn")}, by, level)
        return attach_one(counts, bounds, by, "left").select(
            *by, "n_units", "k", F.coalesce(F.try_divide("k", "n_units"), nan()).alias("share"),
            F.coalesce("share_lo", nan()).alias("share_lo"), F.coalesce("share_hi", nan()).alias("share_hi"),
            F.when(F.col("n_units") > 0, F.col("share_undefined")).otherwise(n_replicates).cast("bigint").alias("share_undefined"),
        )
    drawn = counts.withColumn("_b", resampled_share(F.col("k"), F.col("n_units"), level, n_replicates, seed))
    return drawn.select(
        *by, "n_units", "k", F.coalesce(F.try_divide("k", "n_units"), nan()).alias("share"),
        F.col("_b.lo").alias("share_lo"), F.col("_b.hi").alias("share_hi"),
        F.when(F.col("n_units") > 0, 0).otherwise(n_replicates).cast("bigint").alias("share_undefined"),
    )


def proportion_bounds(
    df: DataFrame, flag: Column, by: Sequence[str] = (), level: float = 0.95, n_replicates: int = 2000, seed: int = 42,
    unit: str | None = None,
) -> DataFrame:
    """n, k, share with bootstrap (of units, when ``unit`` is named) and exact bounds, half widths in points, zero-width flag."""
    exact = (
        share_bounds(df, flag, by, level, n_replicates, seed, unit)
        .withColumn("_b", clopper_pearson(F.col("k"), F.col("n_units"), level))
        .select("*", "_b.*")
        .drop("_b")
    )
    return exact.withColumns({
        "boot_half_pp": 50.0 * (F.col("share_hi") - F.col("share_lo")),
        "cp_half_pp": 50.0 * (F.col("cp_hi") - F.col("cp_lo")),
        "degenerate": F.col("share_hi") == F.col("share_lo"),
    })


# --- laws and precision --------------------------------------------------------------


def coverage_law(n_cal: Column, alpha: float) -> dict[str, Column]:
    """Beta law of split-conformal coverage given the calibration size.

    ``infeasible`` marks sizes too small for a finite interval; their law is NULL.
    """
    ell = F.floor(F.lit(alpha) * (n_cal + 1) + 1e-12).cast("double")
    infeasible = ell < 1
    a = F.when(~infeasible, n_cal + 1 - ell)
    b = F.when(~infeasible, ell)
    variance = a * b / (F.pow(a + b, F.lit(2.0)) * (a + b + 1.0))
    return {
        "beta_a": a,
        "beta_b": b,
        "infeasible": infeasible,
        "calibration_sd_pp": 100.0 * F.sqrt(variance),
    }


def binomial_sd_pp(n: Column, nominal: float) -> Column:
    return 100.0 * F.sqrt(F.try_divide(F.lit(nominal * (1.0 - nominal)), n.cast("double")))


def group_precision(
    df: DataFrame,
    covered: Column,
    by: Sequence[str],
    n_cal: Column,
    nominal: float = 0.9,
    bar_pp: float = 5.0,
    loose_pp: float = 10.0,
    level: float = 0.95,
) -> DataFrame:
    """How precisely coverage is known per group, judged on the exact half width."""
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(covered).alias("k"), F.max(n_cal).alias("n_cal")
    )
    return judge_precision(counts, nominal, bar_pp, loose_pp, level)


def judge_precision(
    counts: DataFrame, nominal: float, bar_pp: float, loose_pp: float, level: float = 0.95
) -> DataFrame:
    """Adds half width, the two sd terms, chance of full coverage and the verdict to (n, k, n_cal)."""
    half = 50.0 * (F.col("_b.cp_hi") - F.col("_b.cp_lo"))
    scored = F.col("n") > 0
    law = coverage_law(F.col("n_cal"), 1.0 - nominal)
    return (
        counts.withColumn("_b", clopper_pearson(F.col("k"), F.greatest(F.col("n"), F.lit(1)), level))
        .withColumn("cp_half_pp", F.when(scored, half))
        .drop("_b")
        .withColumns({
            "calibration_sd_pp": law["calibration_sd_pp"],
            "test_sd_pp": binomial_sd_pp(F.col("n"), nominal),
            "p_all_covered": F.pow(F.lit(nominal), F.col("n")),
            "meets_bar": F.coalesce(F.col("cp_half_pp") <= bar_pp, F.lit(False)),
            "meets_loose": F.coalesce(F.col("cp_half_pp") <= loose_pp, F.lit(False)),
        })
        .withColumn(
            "verdict",
            F.when(~scored, "unscorable")
            .when(F.col("meets_bar"), "estimable")
            .when(F.col("meets_loose"), "estimable at the looser bar")
            .otherwise("merge"),
        )
    )


def smallest_adequate(precision: DataFrame, meets: str = "meets_bar") -> DataFrame:
    """Size of the smallest group that meets the bar (NULL when none does)."""
    return precision.agg(F.min(F.when(F.col(meets), F.col("n"))).alias("min_n"))


def calibration_sizes(
    units: DataFrame, high: Column, fractions: Sequence[float], nominal: float, n_test: DataFrame
) -> DataFrame:
    """Calibration size per fraction, over all units and over high ones, with both sd terms.

    ``n_test`` is a one-row table with the number of evaluation units.
    """
    totals = units.agg(F.count(F.lit(1)).alias("all_units"), F.count_if(high).alias("high_units"))
    rows = totals.unpivot([], ["all_units", "high_units"], "population", "n").select(
        "population", "n", F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction")
    )
    sized = rows.withColumn("n_cal", F.bround(F.col("fraction") * F.col("n")).cast("bigint"))
    law = coverage_law(F.col("n_cal"), 1.0 - nominal)
    test_sd = binomial_sd_pp(n_test.scalar(), nominal)
    return sized.select(
        "population",
        "fraction",
        "n_cal",
        law["infeasible"].alias("infeasible"),
        law["calibration_sd_pp"].alias("calibration_sd_pp"),
        test_sd.alias("test_sd_pp"),
        F.try_divide(test_sd, law["calibration_sd_pp"]).alias("test_to_calibration"),
    )
