"""Pieces that several operators of this folder use."""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitcal.session import stage, unstage

#: One row per batch element; whole texts, so a batch is bounded by Spark's rows and bytes per batch.
Batches = Iterator[pa.RecordBatch]


#: What operators remember in this worker from task to task.
_memories: dict[tuple, object] = {}


def memory(key: tuple, make: Callable[[], object]):
    """What the worker remembers under ``key``, made when it is missing."""
    if key not in _memories:
        _memories[key] = make()
    return _memories[key]


def forget() -> None:
    """Drop what operators that ran before remembered: Spark uses a worker for one stage after the other."""
    _memories.clear()


def in_arrow(
    df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, remembers: bool = False
) -> DataFrame:
    """Apply a function of one Arrow batch to every batch of ``df``.

    A step that does not use :func:`memory` (``remembers``) frees it for its own work.
    """

    def run(batches: Batches) -> Batches:
        if not remembers:
            forget()
        for batch in batches:
            yield step(batch)

    return df.mapInArrow(run, schema)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; NULL is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def squeezed(text: str) -> Column:
    """The UTF-8 bytes of a text column, compressed for an exchange; NULL is empty."""

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        packer = zstandard.ZstdCompressor(level=3, write_checksum=False)
        return pa.array([packer.compress(t) for t in raw_texts(texts)], pa.binary())

    return run(F.col(text))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now.

    It deletes them when the driver's garbage collection finds that nothing can read them any more,
    which on a driver with little to do comes late.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(staged: DataFrame) -> None:
    """Delete the folder of a staged table that nothing reads any more."""
    for folder in {os.path.dirname(f) for f in staged.inputFiles()}:
        unstage(staged.sparkSession, folder)


def unsqueezed(column: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(b) for b in column.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of ``a[i]`` and ``b[i]`` for all i; ``label`` holds each node's smallest member."""
    a, b = label[a], label[b]
    while (apart := a != b).any():
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (jumped := label[label]).tobytes() != label.tobytes():
            label[:] = jumped
        a, b = label[a], label[b]


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of the links (longs): rows (node, root) of all nodes that are no root.

    ``root`` is the smallest node of the component.  Large-star and small-star rounds: each
    links every neighbour to the smallest one, so rows never grow in number, and the stars are
    reached in a logarithmic number of rounds.  Minima are aggregates with partial combine and
    the joins are plain equi-joins, so a node with very many links is no single task's work.
    """
    edges = stage(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter("u <> v").distinct()
    )
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            both.filter("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.union(least).distinct())
