"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard transform; its hash is the
nearest of the 2 * D signed axes (D: its length, filled up to a power of two).  ``FUNCTIONS`` such
hashes name a bucket of a table, and there are ``TABLES`` tables.  A vector is at home in one bucket
of each table and is also sent to the ``PROBES`` buckets that it missed by the least.  Vectors of one label and
length that meet in a bucket, one of them at home there, are compared in double precision.

Equal vectors of a label are one vector with a count.  Buckets are counted first, and only those
where something can be met go on; a bucket of more than ``BLOCK`` rows is split into blocks of
those at home, and each row is compared with every block.  No pairs leave a block: a row leaves it with the
number of its links and the root of what it is linked to.  A pair that meets in several buckets is counted in the
smallest of them, which both vectors tell.

Pairs at a cosine of 0.98 exactly are found with probability 0.999 (64 numbers a vector), closer ones
more often.

Defined cases: a vector that is NULL, empty, zero, or holds a NULL or a number that isn't finite, or whose label is
NULL, links with nothing; repeated rows are vectors of their own that link with each other; a NULL
id names a component only if it has no other id; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitcal.llm.shared import Batches, components, in_arrow, unite
from unitcal.session import stage

TABLES = 4
FUNCTIONS = 3
PROBES = 4
NEAREST = 3  # axes that a probe may take instead of the nearest
ROUNDS = 3
BLOCK = 1024
COSINE = 0.98
PAIRS_AT_ONCE = 1_000_000
_NOWHERE = np.iinfo(np.int64).max


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows (their length is a power of two), not scaled."""
    n, h = x.shape[1], 1
    while h < n:
        pairs = x.reshape(len(x), -1, 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def buckets(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home buckets (row, table) and further buckets (row, table, probe); tables have buckets of their own."""
    rows, d = unit.shape
    width = 1 << max(1, d - 1).bit_length()
    filled = np.zeros((rows, width))
    filled[:, :d] = unit
    home = np.zeros((rows, TABLES), np.int64)
    probes = np.zeros((rows, TABLES, PROBES), np.int64)
    choices = [c for c in product(range(NEAREST), repeat=FUNCTIONS) if any(c)]
    every = np.arange(rows)[:, None]
    for table in range(TABLES):
        near, lost = [], []
        for function in range(FUNCTIONS):
            signs = np.random.default_rng([width, table, function]).choice([-1.0, 1.0], (ROUNDS, width))
            turned = filled
            for round_signs in signs:
                turned = hadamard(turned * round_signs) / np.sqrt(width)
            both = np.concatenate([turned, -turned], axis=1)
            axes = np.argsort(-both, axis=1, kind="stable")[:, :NEAREST]
            heights = both[every, axes]
            near.append(axes)
            lost.append((heights[:, :1] - heights) ** 2)

        def code(choice: tuple[int, ...]) -> np.ndarray:
            name = np.full(rows, table, np.int64)
            for axes, c in zip(near, choice):
                name = name * (2 * width) + axes[:, c]
            return name

        home[:, table] = code((0,) * FUNCTIONS)
        others = np.stack([code(c) for c in choices], axis=1)
        losses = np.stack([sum(l[:, c] for l, c in zip(lost, choice)) for choice in choices], axis=1)
        probes[:, table] = others[every, np.argsort(losses, axis=1, kind="stable")[:, :PROBES]]
    return home, probes


def unit_vectors(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    """Those rows, all of one length, as doubles of length one."""
    x = np.asarray(column.take(pa.array(rows)).flatten(), float).reshape(len(rows), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


PLACE = ("label", "width", "bucket")
PLACES = "key_a bigint, key_b bigint, label bigint, width int, bucket bigint, home boolean"


def places(classes: DataFrame) -> DataFrame:
    """Every bucket that a vector is sent to (``PLACES``)."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        widths = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
        out: list[list[np.ndarray]] = [[], [], []]
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            for start in range(0, len(rows), 2048):
                part = rows[start:start + 2048]
                home, probes = buckets(unit_vectors(batch.column(3), part))
                names = np.concatenate([home, probes.reshape(len(part), -1)], axis=1)
                out[0].append(np.repeat(part, names.shape[1]))
                out[1].append(names.reshape(-1))
                out[2].append(np.tile(np.arange(names.shape[1]) < TABLES, len(part)))
        rows, names, home = (np.concatenate(o) if o else np.zeros(0, t) for o, t in zip(out, (np.int64, np.int64, bool)))
        at = pa.array(rows)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at),
                pa.array(widths[rows], pa.int32()), pa.array(names), pa.array(home),
            ],
            names=["key_a", "key_b", *PLACE, "home"],
        )

    return in_arrow(classes.select("key_a", "key_b", "label", "vector"), step, PLACES)


def dealt(sent: DataFrame) -> DataFrame:
    """Rows of the places where something can be met, for each block (``block``, ``held``) of those at home.

    A row at home is held in one block and, to be compared, also goes to the blocks before.
    """
    met = sent.groupBy(*PLACE).agg(F.count("*").alias("rows"), F.count_if("home").alias("homes")).filter("rows > 1 and homes > 0")
    blocks = met.withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int")).drop("rows", "homes")
    rows = sent.join(blocks, list(PLACE))
    own = F.when(F.col("home"), F.pmod(F.xxhash64("key_a", "key_b", "bucket"), F.col("blocks")).cast("int")).otherwise(F.col("blocks") - 1)
    return (
        rows.withColumn("own", own)
        .withColumn("block", F.explode(F.sequence(F.lit(0), "own")))
        .withColumn("held", F.col("home") & (F.col("block") == F.col("own")))
        .select("key_a", "key_b", *PLACE, "block", "held")
    )


COMPARED = "key_a bigint, key_b bigint, links bigint, node bigint, other bigint"


def first_bucket(homes, probes, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest bucket in which each pair is compared."""

    def meets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Homes of a that b is sent to."""
        home = homes[a]
        there = (home == homes[b]) | (probes[b] == home[:, :, None]).any(axis=2)
        return np.where(there, home, _NOWHERE).min(axis=1)

    return np.minimum(meets(p, q), meets(q, p))


def compare(cosine: float):
    """Per block and batch, for every row that links there: its links and the root of what it links to."""

    def links_of(at: tuple, rows: dict, n_old: int) -> pa.RecordBatch | None:
        """``rows``: those held from before, then new ones, held ones first."""
        unit, held = rows["unit"], np.flatnonzero(rows["held"])
        total = len(unit)
        links, label = np.zeros(total, np.int64), np.arange(total)
        step = max(1, PAIRS_AT_ONCE // max(1, len(held)))
        known = None
        for start in range(n_old, total, step):
            part = np.arange(start, min(total, start + step))
            close = unit[part] @ unit[held].T >= cosine
            p, q = np.nonzero(close & (held[None, :] < part[:, None]))
            if not len(p):
                continue
            p, q = part[p], held[q]
            if known is None:
                known = buckets(unit)
            for begin in range(0, len(p), 100_000):
                a, b = p[begin:begin + 100_000], q[begin:begin + 100_000]
                own = first_bucket(*known, a, b) == at[2]
                a, b = a[own], b[own]
                np.add.at(links, a, rows["n"][b])
                np.add.at(links, b, rows["n"][a])
                unite(label, a, b)
        hit = np.flatnonzero(links)
        if not len(hit):
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (rows["a"][hit], rows["b"][hit], links[hit], rows["node"][hit], rows["node"][label[hit]])],
            names=["key_a", "key_b", "links", "node", "other"],
        )

    def run(batches: Batches) -> Batches:
        last, kept = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            places = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])
            change = np.flatnonzero((places[:, 1:] != places[:, :-1]).any(axis=0)) + 1
            names = ("held", "a", "b", "node", "n")
            columns = {c: batch.column(4 + i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)}
            for start, end in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                at = tuple(places[:, start].tolist())
                old = kept if at == last else None
                last = at
                if end - start == 1 and old is None and end < batch.num_rows:
                    continue
                rows = {c: v[start:end] for c, v in columns.items()}
                rows["unit"] = unit_vectors(batch.column(9), np.arange(start, end))
                n_old = 0
                if old is not None:
                    n_old = len(old["unit"])
                    rows = {c: np.concatenate([old[c], v]) for c, v in rows.items()}
                if rows["held"].any():
                    found = links_of(at, rows, n_old)
                    if found is not None:
                        yield found
                kept = None
                if end == batch.num_rows:
                    stay = rows["held"].astype(bool)
                    kept = {c: v[stay] for c, v in rows.items()}

    return run


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label)."""
    label, vector = F.col("label").cast("bigint"), F.col("embedding")
    known = vectors.select(F.col("vec_id").cast("bigint"), label.alias("label"), vector.alias("vector"))
    known = known.withColumn("usable", usable(F.col("vector")) & F.col("label").isNotNull())
    # two hashes of 64 bits stand for label and vector
    keys = {"key_a": F.xxhash64("label", "vector"), "key_b": F.xxhash64(F.lit("again"), "vector", "label")}
    known = known.withColumns({k: F.when(F.col("usable"), v) for k, v in keys.items()})
    rows = known.select("vec_id", "key_a", "key_b")
    key = ["key_a", "key_b"]
    classes = stage(
        known.filter("usable").groupBy(*key, "label", "vector").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
        .withColumn("node", F.coalesce("first_id", "key_a"))
    )
    at = dealt(stage(places(classes))).join(classes.select(*key, "node", "n", "vector"), key)
    place = [*PLACE, "block"]
    compared = stage(
        at.select(*place, "held", "key_a", "key_b", "node", "n", "vector")
        .repartition(*place).sortWithinPartitions(*place, F.desc("held"))
        .mapInArrow(compare(cosine), COMPARED)
    )
    roots = components(compared, "node", "other")
    links = compared.groupBy(*key).agg(F.sum("links").alias("links"))
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    told = named.join(smallest, "root").join(links, key, "left").select(
        *key, "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")
    )
    return rows.join(told, key, "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
