"""Importance resampling towards a target distribution of hashed features.

A feature is a run of 1 to ``longest`` consecutive words; its bucket is the CRC-32 of its bytes
modulo ``buckets``.  The counts of the buckets over the documents and over the target texts give
an array of integer gains, and a document's weight is the floored mean of the gains of its
features.  Adding hashed Gumbel noise makes the highest scores a draw without replacement with
probabilities by weight.

The draw never sorts the documents.  Scores are persisted; the cut-off is found by bisection,
each step one job that counts exactly the rows at or before ``CUTS`` values, first over scores, then among
the rows tied there over ids and, where rows share both, over a row number.  Only drawn rows
are range-partitioned for their ranks.

Defined cases: a NULL or blank text has no feature, weight 0 and is not drawn; a NULL id is hashed
as an empty string and comes after all ids; repeated rows are scored and drawn as often as they
occur; an empty table gives no row, empty target texts count nothing; other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitcal.llm.shared import Batches, forget, in_arrow
from unitcal.llm.words import byte_table, numbered, runs, split
from unitcal.session import stage

BUCKETS = 10_000

#: Words hold digits, letters and bytes above 7F; everything else separates them.
_WORDS = byte_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

#: Values whose rows one counting job counts.
CUTS = 31


def feature_buckets(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, text after text; the numbers of features and of words of each text."""
    words, n_words = split(texts, _WORDS)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    found, owners = [], []
    for n in range(1, longest + 1):
        if n == 1:
            grams, of = words, owner
        elif len(words) < n:
            break
        else:
            inside = owner[n - 1:] == owner[:len(owner) - n + 1]
            parts = [words.slice(j, len(words) - n + 1).filter(pa.array(inside)) for j in range(n)]
            grams, of = pc.binary_join_element_wise(*parts, " "), owner[n - 1:][inside]
        codes, distinct = numbered(grams)
        own = [zlib.crc32(g) % buckets for g in distinct.cast(pa.binary()).to_pylist()]
        found.append(np.array(own, np.int64)[codes] if own else np.zeros(0, np.int64))
        owners.append(of)
    owners = np.concatenate(owners)
    by_text = np.argsort(owners, kind="stable")
    return np.concatenate(found)[by_text], np.bincount(owners, minlength=len(n_words)), n_words


def with_buckets(docs: DataFrame, text: str, longest: int, buckets: int, *keep: str) -> DataFrame:
    """The columns ``keep`` with n_words, n_features and the buckets of each text as 32-bit integers."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(len(keep))
        made, features, words = [], [], []
        for part in runs(texts):
            values, n, n_words = feature_buckets(texts[part.start:part.stop], longest, buckets)
            raw, ends = values.astype("<i4").tobytes(), np.cumsum(n) * 4
            made += [raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
            features.append(n)
            words.append(n_words)
        numbers = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (words, features)]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:len(keep)], *[pa.array(x, pa.int64()) for x in numbers], pa.array(made, pa.binary())],
            names=[*keep, "n_words", "n_features", "buckets"],
        )

    kept = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return in_arrow(docs.select(*keep, text), step, kept + "n_words bigint, n_features bigint, buckets binary")


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket.  A task sends one row per bucket, and ``buckets`` rows come to the driver."""

    def run(batches: Batches) -> Batches:
        forget()
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(raw, "<i4"), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    found = features.select("buckets").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    for bucket, n in found.collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket, floored."""
    buckets, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1) * (all_source + buckets) / ((s + 1) * (all_target + buckets))))
        for s, t in zip(source.tolist(), target.tolist())
    ], np.int64)


def with_weights(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """Adds the floored mean gain of each row's features; without features 0."""

    @F.arrow_udf("bigint")
    def weight(raws: pa.Array) -> pa.Array:
        found = (np.frombuffer(raw, "<i4") for raw in raws.to_pylist())
        return pa.array([int(gain[b].sum()) // len(b) if len(b) else 0 for b in found], pa.int64())

    return features.withColumn("weight", weight("buckets")).drop("buckets")


def gumbel(seed: str) -> Column:
    """Thousandths of the Gumbel noise of a row, from a hash of ``seed`` and its id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def first_rows(rows: DataFrame, order: list[Column], n: int) -> Column:
    """The condition that exactly the first ``n`` rows meet, by integer columns whose tuples are unique.

    One column after the other: bisection finds its least value up to which there are ``n`` rows
    among those that tie on the columns before.
    """
    if n <= 0:
        return F.lit(False)
    better, tied = F.lit(False), F.lit(True)
    for column in order:
        # bounds are Python integers, so that their difference cannot overflow
        low, high, count = rows.filter(tied).agg(F.min(column), F.max(column), F.count("*")).first()
        if count <= n:
            return better | tied
        before = 0  # rows under low
        while low < high:
            cuts = sorted({low + (high - low) * (i + 1) // (CUTS + 1) for i in range(CUTS)} - {high})
            counts = rows.filter(tied).agg(*[F.count_if(column <= c) for c in cuts]).first()
            reached = [i for i, c in enumerate(counts) if c >= n]
            at = reached[0] if reached else len(cuts)
            if at < len(cuts):
                high = cuts[at]
            if at > 0:
                low, before = cuts[at - 1] + 1, counts[at - 1]
        better, tied = better | (tied & (column < low)), tied & (column == low)
        n -= before
    return better | tied


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds 1, 2, 3, ... in this order: places in ranges, and the rows of the ranges before.

    The offsets are one row per range, whatever the rows.
    """
    placed = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    counts = dict(placed.groupBy(part.alias("part")).count().collect())
    offsets, so_far = [], 0
    for p in sorted(counts):
        offsets.append((p, so_far))
        so_far += counts[p]
    table = rows.sparkSession.createDataFrame(offsets, "_part bigint, _before bigint")
    inside = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(table), part == F.col("_part")).withColumn(name, F.col("_before") + inside + 1).drop("_m", "_part", "_before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    seed: str = "2024",
    percent: int = 10,
    longest: int = 1,
    buckets: int = BUCKETS,
    least_words: int = 20,
    text: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is NULL where it is not drawn.

    ``percent`` of the documents of at least ``least_words`` words are drawn, rounded down.
    """
    features = stage(with_buckets(docs, text, longest, buckets, "doc_id"))
    wanted = with_buckets(target, text, longest, buckets)
    gain = gains(bucket_counts(features, buckets), bucket_counts(wanted, buckets))
    scored = stage(
        with_weights(features, gain)
        .withColumn("score", F.col("weight") + gumbel(seed))
        .withColumn("row", F.monotonically_increasing_id())
    )
    able = scored.filter(F.col("n_words") >= least_words)
    order = [-F.col("score"), F.isnull("doc_id").cast("int"), F.coalesce("doc_id", F.lit(0)), F.col("row")]
    drawn = (F.col("n_words") >= least_words) & first_rows(able, order, able.count() * percent // 100)
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked(scored.filter(drawn), order, "rank").select(*columns).unionByName(
        scored.filter(~drawn).withColumn("rank", F.lit(None).cast("bigint")).select(*columns)
    )
