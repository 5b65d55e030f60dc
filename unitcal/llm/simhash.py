"""SimHash near-duplicates by anchor points.

A fingerprint is 64 bits: bit b is set when it is set in over half of the shingles' hashes.
Two fingerprints link at ``THRESHOLD`` or fewer differing bits.

The anchors are pairs of words of the perfect binary Golay code of length 23, whose covering
radius is 3, over the bits 0-22 and 23-45.  A fingerprint's home is the one anchor within the
radius in both halves.  A fingerprint that differs from it by a bits in one half and b in the
other, a + b <= 2, lies within 3 + a and 3 + b of that anchor, so each fingerprint is also sent
to all anchors within such distances (about 61 of 16.8 million); at an anchor those sent are
compared with those at home on all 64 bits.  No pair can be missed, and none is compared by chance
but a few.  Equal fingerprints are one fingerprint with its smallest document id, so copies cost
nothing.  What an anchor finds leaves it as a spanning forest, never as all pairs; rows for an
anchor are spread over ``SALTS`` tasks (the few at home go to each), and a task holds only the
fingerprints at home of the anchor it is at.

Defined cases: a NULL or blank text has fingerprint zero, which links like any other; a text
of fewer words than a shingle is one shingle; repeated rows stay rows and share a component; a
NULL id never names a component unless it has no other id; an empty table gives no row; columns
other than id and text are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitcal.llm.shared import Batches, components, in_arrow, mix64, raw_texts, unite
from unitcal.session import stage

SHINGLE = 3
SEED = 42
THRESHOLD = 2
SALTS = 4
PAIRS_AT_ONCE = 4_000_000

#: Fixed value: generator polynomial of the cyclic Golay code (23, 12, 7).
GOLAY = 0xC75
BITS = 23
RADIUS = 3


def shingles(raw: bytes, shingle: int) -> np.ndarray:
    """Hashes of the shingles of a text in order; none without words."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    n = len(words)
    size = min(shingle, n)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n - size + 1]
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1:].tolist())], "<u8"
    )


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text; zero without words."""
    return majority(shingles(raw, shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero without hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a long."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in raw_texts(batch.column(1))], np.uint64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"]
        )

    return in_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), step, "doc_id bigint, fp bigint")


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of the words (as polynomials) by the generator: 11 bits."""
    left = words.astype(np.int64, copy=True)
    for shift in range(BITS - 12, -1, -1):
        left ^= ((left >> (shift + 11)) & 1) * (GOLAY << shift)
    return left


class Golay:
    """For each syndrome the differences to all code words at distance at most 3, at 4, and at 5."""

    def __init__(self) -> None:
        self.tables = []
        for weights in (range(RADIUS + 1), (RADIUS + 1,), (RADIUS + 2,)):
            words = np.array([sum(1 << b for b in c) for w in weights for c in combinations(range(BITS), w)], np.int64)
            found = syndromes(words)
            order = np.argsort(found, kind="stable")
            counts = np.bincount(found, minlength=1 << 11)
            self.tables.append((words[order], np.cumsum(counts) - counts, counts))

    def near(self, words: np.ndarray, more: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and code words whose distance is ``RADIUS + more`` (at most ``RADIUS`` for 0)."""
        table, start, count = self.tables[more]
        found = syndromes(words)
        rows, at = expand(start[found], count[found])
        # a code word is known by its upper 12 bits
        return rows, (words[rows] ^ table[at]) >> 11


def expand(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers, and start[row], start[row] + 1, ... (count[row] of them)."""
    rows = np.repeat(np.arange(len(start)), count)
    begins = np.cumsum(count) - count
    return rows, np.arange(len(rows)) - begins[rows] + start[rows]


_golay: list[Golay] = []


def golay_code() -> Golay:
    """The worker's tables."""
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, at home) of all anchors that a fingerprint is sent to."""
    golay = golay_code()
    mask = np.uint64((1 << BITS) - 1)
    halves = [((fps >> np.uint64(s)) & mask).astype(np.int64) for s in (0, BITS)]
    near = [[golay.near(h, more) for more in range(THRESHOLD + 1)] for h in halves]
    rows, keys, home = [], [], []
    for a in range(THRESHOLD + 1):
        left_rows, left = near[0][a]
        for b in range(THRESHOLD + 1 - a):
            right_rows, right = near[1][b]
            count = np.bincount(right_rows, minlength=len(fps))
            start = np.cumsum(count) - count
            i, j = expand(start[left_rows], count[left_rows])
            rows.append(left_rows[i])
            keys.append(left[i] << 12 | right[j])
            home.append(np.full(len(i), a == b == 0))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(home)


SENT = "place bigint, sent tinyint, fp bigint"


def send(distinct: DataFrame) -> DataFrame:
    """Rows for the anchors: ``place`` is anchor and salt, ``sent`` 0 for those at home there."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = batch.column(0).to_numpy().view(np.uint64)
        rows, keys, home = anchors(fps)
        salt = (mix64(fps) % np.uint64(SALTS)).astype(np.int64)
        at_home = np.flatnonzero(home)
        place = np.concatenate([keys * SALTS + salt[rows], *[keys[at_home] * SALTS + s for s in range(SALTS)]])
        who = np.concatenate([rows, *[rows[at_home]] * SALTS])
        sent = np.ones(len(place), np.int8)
        sent[len(rows):] = 0
        return pa.RecordBatch.from_arrays(
            [pa.array(place), pa.array(sent), pa.array(fps[who].view(np.int64))], names=["place", "sent", "fp"]
        )

    return in_arrow(distinct.select("fp"), step, SENT)


def compare(batches: Batches) -> Batches:
    """Spanning forest of the links at each place; rows come sorted by place, those at home first."""
    held_place, held, held_label = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        place = batch.column(0).to_numpy()
        sent = batch.column(1).to_numpy()
        fps = batch.column(2).to_numpy().view(np.uint64)
        n_held = len(held) if held_place == place[0] else 0
        label = np.arange(n_held + len(fps))
        if n_held:
            place = np.concatenate([np.full(n_held, held_place), place])
            sent = np.concatenate([np.zeros(n_held, sent.dtype), sent])
            fps = np.concatenate([held, fps])
            label[:n_held] = held_label
        before = label.copy()
        first = np.flatnonzero(np.diff(place, prepend=place[0] - 1))
        segment = np.cumsum(np.diff(place, prepend=place[0]) != 0)
        homes = np.add.reduceat(sent == 0, first)
        probes = np.flatnonzero((sent == 1) & (homes[segment] > 0))
        counts = homes[segment[probes]]
        total = np.cumsum(counts)
        start = 0
        while start < len(probes):
            done = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, done + PAIRS_AT_ONCE, side="right")))
            part = probes[start:end]
            row, home = expand(first[segment[part]], counts[start:end])
            probe = part[row]
            other = fps[probe] ^ fps[home]
            near = (np.bitwise_count(other) <= THRESHOLD) & (other != 0)
            unite(label, probe[near], home[near])
            start = end
        moved = np.flatnonzero(label != before)
        last = place == place[-1]
        keep = np.flatnonzero(last & (sent == 0))
        held_place, held = place[-1], fps[keep]
        # labels inside the kept rows: the first kept row of each set stands for it
        _, where, inverse = np.unique(label[keep], return_index=True, return_inverse=True)
        held_label = where[inverse]
        if len(moved):
            yield pa.RecordBatch.from_arrays(
                [pa.array(fps[moved].view(np.int64)), pa.array(fps[label[moved]].view(np.int64))], names=["a", "b"]
            )


def link_components(distinct: DataFrame) -> DataFrame:
    """(node, root) over distinct fingerprints ``fp``, for all fingerprints that are no root."""
    at_anchor = send(distinct).repartition("place").sortWithinPartitions("place", "sent")
    return components(at_anchor.mapInArrow(compare, "a bigint, b bigint"), "a", "b")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    ``fingerprint`` is 16 hexadecimal digits, ``component_id`` the smallest id reachable by links.
    """
    fps = stage(fingerprints(docs, shingle))
    classes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = link_components(classes)
    rooted = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
