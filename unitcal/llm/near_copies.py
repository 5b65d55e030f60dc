"""Near copies by the Jaccard similarity of word shingles, found by anchors of several fingerprints.

Two texts link when the sets of their shingles (``SHINGLE`` words, XXH64) have a Jaccard similarity of
``SIMILAR`` or more.  A set has ``SEEDS`` SimHash fingerprints, each of other scrambled hashes, and
each holds two words of 23 bits.  For each word the set is at home at the one Golay code word
within the covering radius, and is also sent to those within the radius plus ``MORE``: similar sets
meet unless they fail in all of the 2 * SEEDS words.  At an anchor the sets sent that differ from one at home in at most ``FAR`` of the
64 * SEEDS bits are candidates.  Only those are made again from their texts and taken to their
anchors, where each pair is compared by its sets, unless links found there join it already; so a
large group of near copies costs about one comparison for each member.  No pair links by fingerprints alone.

Defined cases: equal sets are one node, blank texts among them; a text of fewer words than a
shingle is one shingle; a NULL text is blank; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitcal.llm.shared import Batches, components, in_arrow, mix64, raw_texts
from unitcal.llm.simhash import BITS, SALTS, expand, golay_code, majority, shingles
from unitcal.session import stage

SHINGLE = 5
SIMILAR = 0.8
SEEDS = 6
MORE = 1
FAR = 96
PAIRS_AT_ONCE = 1_000_000
_STEP = 0x9E3779B97F4A7C15

PRINTS = [f"f{i}" for i in range(SEEDS)]
PRINTS_TYPE = ", ".join(f"{f} bigint" for f in PRINTS)


def shingle_set(raw: bytes) -> np.ndarray:
    return np.unique(shingles(raw, SHINGLE))


def fingerprints(members: np.ndarray) -> list[int]:
    """One SimHash of a set per seed."""
    return [majority(mix64(members + np.uint64(i * _STEP % (1 << 64)))) for i in range(SEEDS)]


def node_of(members: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(members.tobytes(), SHINGLE)


def nodes(rows: DataFrame) -> DataFrame:
    """(doc_id, row_key, node, fingerprints) of rows (doc_id, row_key, text)."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t) for t in raw_texts(batch.column(2))]
        names = np.array([node_of(s) for s in sets], np.uint64).view(np.int64)
        prints = np.array([fingerprints(s) for s in sets], np.uint64).reshape(-1, SEEDS).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(names), *[pa.array(prints[:, i]) for i in range(SEEDS)]],
            names=["doc_id", "row_key", "node", *PRINTS],
        )

    return in_arrow(rows, step, f"doc_id bigint, row_key bigint, node bigint, {PRINTS_TYPE}")


def prints_of(batch: pa.RecordBatch) -> np.ndarray:
    """Fingerprints of a batch, a row for each of its rows."""
    return np.stack([batch.column(f).to_numpy() for f in PRINTS], axis=1).view(np.uint64)


def send(classes: DataFrame) -> DataFrame:
    """Rows for the anchors: ``place`` is word, anchor and salt, ``sent`` 0 for those at home there."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = prints_of(batch)
        salt = (mix64(prints[:, 0]) % np.uint64(SALTS)).astype(np.int64)
        places, who, sent = [], [], []
        for word in range(2 * SEEDS):
            shift = np.uint64(BITS * (word % 2))
            bits = ((prints[:, word // 2] >> shift) & np.uint64((1 << BITS) - 1)).astype(np.int64)
            for more in range(MORE + 1):
                rows, keys = golay_code().near(bits, more)
                keys = (word << 12 | keys) * SALTS
                places.append(keys + salt[rows])
                who.append(rows)
                sent.append(np.ones(len(rows), np.int8))
                for s in range(SALTS if more == 0 else 0):
                    places.append(keys + s)
                    who.append(rows)
                    sent.append(np.zeros(len(rows), np.int8))
        who = np.concatenate(who)
        columns = [batch.column(c).take(pa.array(who)) for c in ("node", *PRINTS)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(places)), pa.array(np.concatenate(sent)), *columns],
            names=["place", "sent", "node", *PRINTS],
        )

    return in_arrow(classes.select("node", *PRINTS), step, f"place bigint, sent tinyint, node bigint, {PRINTS_TYPE}")


def candidates(batches: Batches) -> Batches:
    """Rows that have a candidate at their place; rows come sorted by place, those at home first."""
    kept: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        n_kept = 0
        if kept is not None and kept.num_rows and kept.column(0)[0] == batch.column(0)[0]:
            n_kept = kept.num_rows
            batch = pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
        place, sent, node = (batch.column(i).to_numpy() for i in range(3))
        prints = prints_of(batch)
        new = np.diff(place, prepend=place[0] - 1) != 0
        first = np.flatnonzero(new)
        segment = np.cumsum(new) - 1
        homes = np.add.reduceat((sent == 0).astype(np.int64), first)
        probes = np.flatnonzero((sent == 1) & (homes[segment] > 0))
        counts = homes[segment[probes]]
        total = np.cumsum(counts)
        found = np.zeros(len(place), bool)
        start = 0
        while start < len(probes):
            done = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, done + PAIRS_AT_ONCE, side="right")))
            row, home = expand(first[segment[probes[start:end]]], counts[start:end])
            probe = probes[start:end][row]
            apart = np.zeros(len(probe), np.int64)
            for i in range(SEEDS):
                apart += np.bitwise_count(prints[probe, i] ^ prints[home, i])
            near = (apart <= FAR) & (node[probe] != node[home])
            found[probe[near]] = True
            found[home[near]] = True
            start = end
        if found.any():
            yield batch.take(pa.array(np.flatnonzero(found)))
        kept = batch.take(pa.array(np.flatnonzero((place == place[-1]) & (sent == 0))))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of ``SIMILAR`` or more."""
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILAR * (len(a) + len(b) - both)


def verified(batches: Batches) -> Batches:
    """Links that span the similar sets at each place; rows as for :func:`candidates`, and the sets."""
    place = None
    homes: list[np.ndarray] = []
    at: dict[int, int] = {}
    names: list[int] = []
    prints, label = np.zeros((0, SEEDS), np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        links: list[tuple[int, int]] = []
        every = prints_of(batch)
        rows = zip(*(batch.column(c).to_pylist() for c in ("place", "sent", "node", "members")))
        for i, (where, sent, node, members) in enumerate(rows):
            if where != place:
                place, homes, at, names = where, [], {}, []
                waiting, prints = [], None
            members = np.frombuffer(members, "<u8")
            if sent == 0:
                if node not in at:
                    at[node] = len(homes)
                    homes.append(members)
                    names.append(node)
                    waiting.append(every[i])
                continue
            if prints is None:
                prints, label = np.array(waiting, np.uint64).reshape(-1, SEEDS), np.arange(len(homes))
            mine = label[at[node]] if node in at else -1
            open_ = np.bitwise_count(prints ^ every[i]).sum(1, dtype=np.int64) <= FAR
            open_ &= label != mine
            while len(left := np.flatnonzero(open_)):
                h = left[0]
                open_[h] = False
                if names[h] == node or not similar(members, homes[h]):
                    continue
                links.append((node, names[h]))
                if mine < 0:
                    mine = label[h]
                else:
                    label[label == label[h]] = mine
                open_ &= label != mine
        if links:
            a, b = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def with_members(rows: DataFrame) -> DataFrame:
    """(named, members) of rows (named, text)."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t).tobytes() for t in raw_texts(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["named", "members"])

    return in_arrow(rows, step, "named bigint, members binary")


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns of a row; a hash skips NULLs, so where they are is hashed too."""
    columns = [docs[f"`{c.replace('`', '``')}`"] for c in docs.columns]
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, root) of every row; rows of one root are linked by chains of near copies."""
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key(docs).alias("row_key"), "text")
    named = stage(nodes(keyed))
    classes = stage(named.groupBy("node").agg(F.min("row_key").alias("row_key"), *[F.first(f).alias(f) for f in PRINTS]))
    sent = send(classes).repartition("place").sortWithinPartitions("place", "sent")
    met = stage(sent.mapInArrow(candidates, sent.schema))
    wanted = met.select("node").distinct().join(classes, "node").select(F.col("node").alias("named"), F.col("row_key").alias("_key"))
    texts = keyed.join(wanted, F.col("row_key") == F.col("_key")).dropDuplicates(["named"]).select("named", "text")
    members = stage(with_members(texts))
    at_anchor = met.join(members, met.node == members.named).drop("named")
    at_anchor = at_anchor.repartition("place").sortWithinPartitions("place", "sent")
    roots = components(at_anchor.mapInArrow(verified, "a bigint, b bigint"), "a", "b").withColumnRenamed("node", "_node")
    return named.join(roots, F.col("node") == F.col("_node"), "left").select(
        "doc_id", "row_key", F.coalesce("root", "node").alias("root")
    )
