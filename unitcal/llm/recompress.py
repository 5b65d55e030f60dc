"""Repeated passages of words by recompression.

A document's words become 64-bit names (XXH64 of their bytes).  Runs of one word take one name, then ``ROUNDS`` rounds of
pairing follow: a hash of a name and the round puts the name on the left or the right side, and
every neighbouring pair (left, right) becomes one name, the hash of the two.  Names depend on
nothing but the words below them, so all documents agree on them and equal passages get equal
symbols inside.  Each symbol carries the stretch of words that decides it: whatever stands
outside, a passage that contains that stretch has that symbol there.

A window of ``WINDOW`` words is known by the symbol of most words among those that it decides (without
any, by its own hash).  Equal windows therefore share their symbol.  Two exchanges of small rows follow:

1. the symbols of all documents are brought together, and a document learns which of its symbols
   another document has too;
2. windows with such a symbol are candidates; their hashes are brought together, which verifies
   them: a window is a repeat if a smaller document has its hash.

What is shared inside one batch of documents is settled there, and the batch sends one row for
it.  So a passage that a third of all documents share meets as one row per batch, not per document.
Each document then leaves out the words that its repeated windows cover.

Defined cases: a NULL or blank text has no words; a text shorter than a window keeps all words; rows
with one id are one document, none of whose windows repeats the other's; a NULL id is smaller and
larger than no other, so its row stays whole and is nobody's original; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitcal.llm.shared import Batches, in_arrow, memory, mix64, raw_texts, release, squeezed, unsqueezed
from unitcal.session import stage

WINDOW = 13
SEED = 17
ROUNDS = 4

_rng = np.random.default_rng(11)
_POWERS = _rng.integers(1, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)
_SIDES = _rng.integers(1, 1 << 63, ROUNDS, dtype=np.uint64)
_LEFT, _RUN = (np.uint64(x) for x in _rng.integers(1, 1 << 63, 2, dtype=np.uint64) | np.uint64(1))
NAME_BITS = 58  # of a symbol's name in a key; the upper bits hold the number of its words


#: Distinct words whose names a worker remembers.
REMEMBERED = 400_000


class Names(dict):
    """word -> XXH64 of its bytes, made when it is asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = name = xxhash.xxh64_intdigest(word, SEED)
        return name


def word_names(words: list[bytes]) -> np.ndarray:
    """The names of the words."""
    known = memory(("word names",), Names)
    if len(known) > REMEMBERED:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def parse(names: np.ndarray, doc: np.ndarray):
    """Symbols after the runs and after each round, as (name, words, low, high).

    Words low to high (exclusive) decide the symbol.  A symbol whose neighbour would be in another
    document is given a stretch that reaches over the edge, so no window contains it.
    """
    n = len(names)
    new = np.ones(n, bool)
    new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [n]])
    long = last - first
    names = names[first]
    names = np.where(long > 1, mix64(names + _RUN * long.astype(np.uint64)), names)
    # that a run ends is decided by the words next to it
    low, high, doc = first - 1, last + 1, doc[first]
    size = long
    levels = [(names, size, low, high)]
    for side in _SIDES:
        left = (mix64(names ^ side) & np.uint64(1)).astype(bool)
        follows = np.zeros(len(names), bool)
        follows[:-1] = doc[1:] == doc[:-1]
        joins = np.zeros(len(names), bool)
        joins[:-1] = left[:-1] & ~left[1:] & follows[:-1]
        joined = np.zeros(len(names), bool)
        joined[1:] = joins[:-1]
        keep = np.flatnonzero(~joined)
        pair = joins[keep]
        nxt = np.minimum(keep + 1, len(names) - 1)
        prv = np.maximum(keep - 1, 0)
        # a single symbol is decided by the neighbour it does not pair with
        to_right = pair | left[keep]
        new_high = np.where(to_right, np.where(follows[keep], high[nxt], high[keep] + (1 << 40)), high[keep])
        after = np.zeros(len(names), bool)
        after[1:] = follows[:-1]
        new_low = np.where(~to_right, np.where(after[keep], low[prv], low[keep] - (1 << 40)), low[keep])
        new_low = np.minimum(new_low, low[keep])
        new_high = np.maximum(new_high, high[keep])
        size = np.where(pair, size[keep] + size[nxt], size[keep])
        names = np.where(pair, mix64(names[keep] * _LEFT + names[nxt]), names[keep])
        low, high, doc = new_low, new_high, doc[keep]
        levels.append((names, size, low, high))
    return levels


def window_hashes(names: np.ndarray) -> np.ndarray:
    n = max(0, len(names) - WINDOW + 1)
    total = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        total += names[j:j + n] * _POWERS[j]
    return mix64(total)


def window_keys(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, key and hash of every window of the documents."""
    hashes = window_hashes(names)
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), hashes, hashes
    by_width: list[list] = [[] for _ in range(WINDOW + 1)]
    for name, size, low, high in parse(names, doc):
        fit = np.flatnonzero((high - low <= WINDOW) & (low >= 0) & (high <= len(names)))
        key = (np.minimum(size[fit], 63).astype(np.uint64) << np.uint64(NAME_BITS)) | (name[fit] >> np.uint64(64 - NAME_BITS))
        width = (high - low)[fit]
        low = low[fit]
        for w in range(1, WINDOW + 1):
            mine = np.flatnonzero(width == w)
            by_width[w].append((low[mine], key[mine]))
    # best[s]: the largest key that the w words from s decide, for w = 1, 2, ... WINDOW
    best = np.zeros(len(names) + 1, np.uint64)
    for w in range(1, WINDOW + 1):
        np.maximum(best[:-1], best[1:], out=best[:-1])
        for low, key in by_width[w]:
            np.maximum.at(best, low, key)
    starts = np.flatnonzero(doc[:n] == doc[WINDOW - 1:])
    keys = best[starts]
    hashes = hashes[starts]
    return starts, np.where(keys > 0, keys, hashes >> np.uint64(64 - NAME_BITS)), hashes


#: Bytes of text that are looked at together.
BYTES_AT_ONCE = 1_000_000


def in_runs(raws: list[bytes]):
    """(row number of every word, its name) of the texts, in runs of about ``BYTES_AT_ONCE``."""
    start = size = 0
    for i, raw in enumerate(raws):
        size += len(raw) + 1
        if size >= BYTES_AT_ONCE or i == len(raws) - 1:
            split = [r.split() for r in raws[start:i + 1]]
            rows = np.repeat(np.arange(start, i + 1), [len(w) for w in split])
            yield rows, word_names(list(chain.from_iterable(split)))
            start, size = i + 1, 0


def distinct_pairs(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (key, doc) in ascending order."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[new], doc[new]


SETTLED, MANY = 0, 2
MET = "key bigint, doc bigint, n tinyint"


def met(key: np.ndarray, doc: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(doc), pa.array(n.astype(np.int8))], names=["key", "doc", "n"]
    )


def meet(rows: DataFrame) -> DataFrame:
    """Bring the rows of a key together, in order; settled rows go anywhere."""
    place = F.when(F.col("n") == SETTLED, F.xxhash64("doc", "key")).otherwise(F.col("key"))
    return rows.repartition(place).sortWithinPartitions("key", "doc")


def symbols(docs: DataFrame) -> DataFrame:
    """``MET`` rows of all documents' symbols: of one that several documents of a batch have, a row for
    each of them (settled) and one for all (many)."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_numpy()
        found = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for rows, names in in_runs(raw_texts(batch.column(1))):
            starts, keys, _ = window_keys(names, rows)
            key, doc = distinct_pairs(keys, ids[rows[starts]])
            found[0].append(key)
            found[1].append(doc)
        key, doc = distinct_pairs(*map(np.concatenate, found))
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
        many = np.diff(np.append(first, len(key)))
        n = np.where(np.repeat(many, many) > 1, SETTLED, 1)
        several = first[many > 1]
        return met(
            np.concatenate([key, key[several]]), np.concatenate([doc, doc[several]]),
            np.concatenate([n, np.full(len(several), MANY)]),
        )

    return in_arrow(docs, step, MET)


def shared_symbols(batches: Batches) -> Batches:
    """From rows in order of key: (key, doc) of the symbols that more than one document has."""
    held = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, bool))

    def told(key, doc, n, again, upto):
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        hit = (n == 1) & (again | same[:-1] | same[1:])
        hit[upto:] = False
        return met(key[hit], doc[hit], n[hit]), same

    for batch in batches:
        key, doc, n = (batch.column(i).to_numpy() for i in range(3))
        key = key.view(np.uint64)
        done = n == SETTLED
        if done.any():
            yield met(key[done], doc[done], n[done])
        key, doc, n = (np.concatenate([h, x[~done]]) for h, x in zip(held, (key, doc, n)))
        if not len(key):
            continue
        again = np.zeros(len(key), bool)
        again[:len(held[3])] = held[3]
        # the last row waits for what follows it
        out, same = told(key, doc, n, again, len(key) - 1)
        yield out
        held = key[-1:], doc[-1:], n[-1:], again[-1:] | same[-2:-1]
    yield told(*held, 1)[0]


def windows(docs: DataFrame) -> DataFrame:
    """``MET`` rows of the windows with one of the symbols in ``shared``: per batch the smallest document of
    a window, and those after it (settled)."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_numpy()
        shared = [np.zeros(0, np.uint64) if s is None else np.sort(s.values.to_numpy().view(np.uint64)) for s in batch.column(2)]
        raws = [t if len(s) else b"" for t, s in zip(unsqueezed(batch.column(1)), shared)]
        found = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for rows, names in in_runs(raws):
            starts, keys, hashes = window_keys(names, rows)
            of = rows[starts]
            edges = np.flatnonzero(np.diff(of, prepend=-1))
            hit = np.zeros(len(of), bool)
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(of)]):
                hit[a:b] = among(keys[a:b], shared[of[a]])
            found[0].append(hashes[hit])
            found[1].append(ids[of[hit]])
        key, doc = distinct_pairs(*map(np.concatenate, found))
        return met(key, doc, np.diff(key, prepend=~key[:1]) != 0)

    return in_arrow(docs, step, MET)


def among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def repeats(batches: Batches) -> Batches:
    """From rows in order of key and doc: those of a window that a smaller document has."""
    last_key, first_doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc, n = (batch.column(i).to_numpy() for i in range(3))
        key = key.view(np.uint64)
        k, d = np.concatenate([last_key, key]), np.concatenate([first_doc, doc])
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        first = d[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
        hit = (first[len(k) - len(key):] < doc) | (n == SETTLED)
        last_key, first_doc = k[-1:], first[-1:]
        yield met(key[hit], doc[hit], n[hit])


def by_document(rows: DataFrame, name: str) -> DataFrame:
    """(doc_id, array of keys): no more than the document has windows."""
    return rows.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("key").alias(name))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, repeated): hashes of the windows of each document that a smaller document has too."""
    known = docs.select(F.col("doc_id").cast("bigint"), "text").filter("doc_id is not null")
    common = stage(by_document(meet(symbols(known)).mapInArrow(shared_symbols, MET), "shared"))
    release(docs.sparkSession)
    packed = known.select("doc_id", squeezed("text").alias("text"))
    candidates = packed.join(common, "doc_id").select("doc_id", "text", "shared")
    found = stage(by_document(meet(windows(candidates)).mapInArrow(repeats, MET), "repeated"))
    release(docs.sparkSession)
    return found


CUT = "text string, n_words bigint, n_removed bigint, kept_sha256 string"


def cut_text(raw: bytes, repeated: np.ndarray) -> tuple[bytes, int, int, str]:
    """The text without the words that windows with one of these hashes cover.

    A text that loses nothing stays as it is; else its kept words are joined by one space.
    """
    words = raw.split()
    removed = 0
    if len(repeated):
        hashes = window_hashes(word_names(words))
        hit = among(hashes, np.sort(repeated))
        edge = np.zeros(len(words) + 1, np.int64)
        edge[:len(hit)] += hit
        edge[WINDOW:WINDOW + len(hit)] -= hit
        keep = np.cumsum(edge)[:len(words)] == 0
        kept = [w for w, k in zip(words, keep.tolist()) if k]
        removed = len(words) - len(kept)
        text = b" ".join(kept)
    else:
        text = b" ".join(words)
    return raw if not removed else text, len(words), removed, hashlib.sha256(text).hexdigest()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` cut, and n_words, n_removed and kept_sha256 (of the kept words joined by a space).

    Other columns stay, but for ones of these names.
    """
    others = [c for c in docs.columns if c not in ("text", "n_words", "n_removed", "kept_sha256")]
    repeated = repeated_windows(docs).select(F.col("doc_id").alias("of"), "repeated")
    packed = docs.select(
        F.struct(*others).alias("row"), F.col("doc_id").cast("bigint").alias("id"), squeezed("text").alias("packed")
    )
    joined = packed.join(repeated, F.col("id") == F.col("of"), "left")

    @F.arrow_udf(f"struct<{CUT.replace(' ', ':').replace(',:', ',')}>")
    def cut(texts: pa.Array, hashes: pa.Array) -> pa.Array:
        rows = [
            cut_text(raw, np.zeros(0, np.uint64) if h.values is None else h.values.to_numpy().view(np.uint64))
            for raw, h in zip(unsqueezed(texts), hashes)
        ]
        columns = list(zip(*rows)) if rows else [[]] * 4
        types = (pa.string(), pa.int64(), pa.int64(), pa.string())
        arrays = [pa.array(columns[0], pa.binary()).cast(pa.string()), *[pa.array(c, t) for c, t in zip(columns[1:], types[1:])]]
        return pa.StructArray.from_arrays(arrays, names=[c.split()[0] for c in CUT.split(", ")])

    return joined.select("row", cut("packed", "repeated").alias("cut")).select("row.*", "cut.*")
