"""Scores of texts by a hierarchical Pitman-Yor language model.

The restaurant of a context is that of one previous word (or of the begin of a text); all of
them share the root as parent, whose dishes come from a uniform base over the known words and one
unknown word.  A customer of a context restaurant is a token after that word; each of its
tables is a customer of the root.

Seating is sampled by Gibbs steps.  Given all else, a dish with c customers has t tables with probability
proportional to S(c, t) a**t, S being the generalised Stirling numbers of the discount and
``a`` the concentration plus discount times the restaurant's tables, times the parent's probability of the dish;
table sizes are summed out.  This law is drawn by its exact distribution up to ``EXACT`` customers and by
its saddle point beyond.  A sweep draws all dishes of the context restaurants at once from
the state of the sweep before, then the root's.  A dish with one customer has one table and is never drawn.  Predictive probabilities
are averaged over the last ``KEPT`` of ``SWEEPS`` sweeps.  Draws are hashed from the dish and the sweep.

Texts are tokenised once and staged in chunks of about ``CHUNK`` bytes.  A chunk sends each distinct word
and each distinct pair once.  Pairs of a word that only this chunk holds stay there, unless they must be drawn.
A pair's count goes back to the chunks that hold the pair, and with it, and with the state of its words, a
chunk repeats the draws and scores its texts.  One key has one row per chunk at most.  Pairs travel in
compressed runs, dealt by the hash of the pair to buckets of about ``BUCKET`` tokens.

The pairs to be drawn are put once into blocks of ``BLOCK`` pairs, which number their own words.  A sweep
sends the state of the words to the blocks that hold them, and a block answers with one row per word.  A word
that was learned once at most is in no such pair; its state is that of all its kind and is not kept.

Defined cases: a NULL text is empty and has the end token alone; a NULL id is hashed as an empty string and so
learned from; repeated rows count as often as they occur; without learned texts every token is unknown
and has probability 1; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitcal.llm.shared import Batches, drop, forget, memory, mix64
from unitcal.llm.words import byte_table, numbered, runs, split
from unitcal.session import stage

SWEEPS, KEPT = 3, 2
CONCENTRATION = 1.0
EXACT = 256
CHUNK = 16_000_000
BUCKET = 2_000_000  # tokens for each bucket of pairs; distinct pairs of a chunk are fewer
BLOCK = 1 << 20  # pairs that are drawn together
PARTS = 4  # exchanges of whole chunks are made one after the other, so that the disk holds one of them

#: Blanks are space and 09-0D; a blank is no word, so its hash names the end token.
_WORDS = byte_table(b"\t\n\v\f\r")
END_HASH = np.uint64(xxhash.xxh64_intdigest(b" ")).astype(np.int64).item()
BEGIN_ID, END = 0, 0  # the id of the begin of a text as context; the end token's number in a chunk
_MASK = (1 << 32) - 1


# Draws


def stirling_logs(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) for c and t up to ``EXACT``."""
    logs = np.full((EXACT + 1, EXACT + 1), -np.inf)
    logs[1, 1] = 0.0
    t = np.arange(EXACT + 1)
    for c in range(1, EXACT):
        with np.errstate(divide="ignore"):
            joined = logs[c] + np.log(np.maximum(c - discount * t, 0.0))
        logs[c + 1, 1:] = np.logaddexp(joined[1:], logs[c, :-1])
    return logs


def uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """A number between 0 and 1 for each key."""
    return ((mix64(keys.view(np.uint64) + mix64(np.array([salt + 1], np.uint64))) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def saddle_point(c: np.ndarray, a: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the number of tables in the limit of many customers.

    Tables are a Poisson number, their sizes have the generating function (1 - (1 - x)**d) / d, tilted at the
    x where the expected number of customers is c.
    """
    low, high = np.full(len(c), -80.0), np.zeros(len(c))  # of log(1 - x)
    for _ in range(60):
        at = (low + high) / 2
        beyond = np.log(a) + np.log(-np.expm1(at)) + (discount - 1) * at > np.log(c)
        low, high = np.where(beyond, at, low), np.where(beyond, high, at)
    rest = np.exp(at)
    x = 1 - rest
    mean = a * (1 - rest**discount) / discount
    spread = a * (x * rest ** (discount - 1) + x * x * (1 - discount) * rest ** (discount - 2))
    return mean, np.maximum(mean - c * c / spread, 0.0)


def draw_tables(c: np.ndarray, a: np.ndarray, keys: np.ndarray, salt: int, discount: float) -> np.ndarray:
    """Tables of dishes with ``c`` customers, given ``a``."""
    logs = memory(("stirling", discount), lambda: stirling_logs(discount))
    out = np.minimum(c, 1).astype(np.int64)
    several = np.flatnonzero(c > 1)
    if len(several) < len(c):  # the others are not drawn
        if len(several):
            out[several] = draw_tables(c[several], a[several], keys[several], salt, discount)
        return out
    u = uniform(keys, salt)
    a = np.maximum(a, 1e-300)
    for n in np.unique(c[(c > 1) & (c <= EXACT)]).tolist():
        rows = np.flatnonzero(c == n)
        for start in range(0, len(rows), part := max(1, 2_000_000 // n)):
            some = rows[start:start + part]
            weight = logs[n, 1:n + 1] + np.log(a[some])[:, None] * np.arange(1, n + 1)
            weight = np.exp(weight - weight.max(axis=1, keepdims=True))
            sums = np.cumsum(weight, axis=1)
            out[some] = 1 + (sums < u[some, None] * sums[:, -1:]).sum(axis=1)
    rows = np.flatnonzero(c > EXACT)
    if len(rows):
        mean, variance = saddle_point(c[rows].astype(float), a[rows], discount)
        few = mean < 20
        # one table and a Poisson number of further ones, by the inverse of its distribution
        term = np.exp(-np.minimum(mean, 20.0))
        reached, more = term.copy(), np.zeros(len(rows))
        for k in range(1, 120):
            more += u[rows] > reached
            term = term * np.minimum(mean, 20.0) / k
            reached += term
        angle = 2 * np.pi * uniform(keys[rows], salt + 1000)
        normal = np.sqrt(-2 * np.log(u[rows])) * np.cos(angle)
        many = np.rint(mean + variance / np.maximum(mean, 1.0) + np.sqrt(variance) * normal)
        out[rows] = np.clip(np.where(few, 1 + more, many), 1, c[rows])
    return out


@dataclass(frozen=True)
class Settings:
    """What all restaurants share; ``known`` counts the distinct learned tokens."""

    tokens: int
    known: int
    documents: int
    discount: float
    root_discount: float
    #: the root's probability of a dish without and with one customer, for each kept state
    rare: tuple[tuple[float, float], ...] = ()

    @property
    def base(self) -> float:
        return 1.0 / (self.known + 1)


def estimated(ones: int, twos: int) -> float:
    """A discount from the dishes with one and with two customers."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos) if ones else 0.5))


# Chunks of tokens


def tokens_of(docs: DataFrame, folds: int, fold: int) -> DataFrame:
    """A row per text with its tokens, numbered inside its chunk; a chunk's first row has its words.

    A chunk is named by its partition and its place there; the rows are to be staged at once.
    """

    def run(batches: Batches) -> Batches:
        forget()
        pack = zstandard.ZstdCompressor(level=1, write_checksum=False)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, held_out = batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
            for part in runs(texts, CHUNK):
                words, n = split(texts[part.start:part.stop], _WORDS)
                codes, distinct = numbered(words)
                ends = np.cumsum(n + 1)
                tokens = np.full(int(ends[-1]), END, "<i4")
                inside = np.ones(len(tokens), bool)
                inside[ends - 1] = False
                tokens[inside] = codes + 1
                learned = np.repeat(~held_out[part], n + 1)
                counts = np.bincount(tokens[learned], minlength=len(distinct) + 1)
                hashes = [END_HASH, *np.array([xxhash.xxh64_intdigest(w) for w in distinct.cast(pa.binary()).to_pylist()], np.uint64).astype(np.int64).tolist()]
                raw = tokens.tobytes()
                cuts = [0, *(4 * ends).tolist()]
                blank = [None] * (len(n) - 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array([number] * len(n), pa.int64()),
                    batch.column(0)[part.start:part.stop],
                    batch.column(2)[part.start:part.stop],
                    pa.array([pack.compress(raw[x:y]) for x, y in zip(cuts, cuts[1:])], pa.binary()),
                    pa.array([hashes, *blank], pa.list_(pa.int64())),
                    pa.array([counts.tolist(), *blank], pa.list_(pa.int64())),
                ], names=["chunk", "doc_id", "held_out", "tokens", "words", "counts"])
                number += 1

    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == fold
    return docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(
        run, "chunk bigint, doc_id bigint, held_out boolean, tokens binary, words array<bigint>, counts array<bigint>"
    )


class Chunk:
    """The tokens of a chunk, with the state of its words and the counts of its pairs."""

    def __init__(self, docs: pa.Table, words: pa.Table) -> None:
        unpack = zstandard.ZstdDecompressor()
        parts = [np.frombuffer(unpack.decompress(t), "<i4") for t in docs["tokens"].to_pylist()]
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.tokens = np.concatenate(parts)
        self.starts = np.cumsum(self.lengths) - self.lengths
        held = docs["held_out"].to_numpy()
        self.learned = np.repeat(~held, self.lengths)
        by_number = np.argsort(words["number"].to_numpy())
        self.words = {c: words[c].combine_chunks().take(pa.array(by_number)) for c in words.column_names}

    def of(self, column: str) -> np.ndarray:
        """The words' values; NaN where there is none."""
        return self.words[column].to_numpy(zero_copy_only=False)

    def contexts(self, values: np.ndarray, begin) -> np.ndarray:
        """The context's value for each token, ``begin`` at the starts of texts."""
        out = np.empty(len(self.tokens), values.dtype) if values.ndim == 1 else np.empty((len(self.tokens), values.shape[1]))
        out[1:] = values[self.tokens[:-1]]
        out[self.starts] = begin
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of known tokens: a token of each, its key, the pair of each token (or -1), learned counts."""
        ids, c = self.of("id"), self.of("c")
        key = (self.contexts(ids, BEGIN_ID) << 32) | ids[self.tokens]
        known = (self.contexts(c, 1) > 0) & (c[self.tokens] > 0)
        distinct, first, inverse = np.unique(key[known], return_index=True, return_inverse=True)
        pair = np.full(len(key), -1)
        pair[known] = inverse
        n = np.bincount(inverse[self.learned[known]], minlength=len(distinct))
        return np.flatnonzero(known)[first], distinct, pair, n


def packed(ascending: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending keys and a number for each, compressed."""
    both = np.concatenate([np.diff(ascending, prepend=0), n]).astype("<i8")
    return zstandard.ZstdCompressor(level=1, write_checksum=False).compress(both.tobytes())


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<i8")
    return np.cumsum(both[:len(both) // 2]), both[len(both) // 2:]


def dealt(place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each place, and the elements that go there, in their order."""
    order = np.argsort(place, kind="stable")
    starts = np.flatnonzero(np.diff(place[order], prepend=-2))
    for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
        yield int(place[order[start]]), order[start:stop]


def part(df: DataFrame, column: str, number: int) -> DataFrame:
    """The rows of one of ``PARTS`` by a column's hash."""
    return df.filter(F.pmod(F.xxhash64(column), F.lit(PARTS)) == number)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def n_buckets(chunks: DataFrame) -> int:
    """Buckets for the pairs of all chunks."""
    held = chunks.filter("words IS NOT NULL").select(
        F.aggregate("counts", F.lit(0).cast("bigint"), lambda x, y: x + y).alias("learned"), F.size("words").alias("words")
    )
    learned, distinct = held.agg(F.coalesce(F.sum("learned"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    return 1 + max(learned, distinct) // BUCKET


def pair_counts(chunks: DataFrame, words: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows (bucket, chunk, pairs) with the pairs of each chunk and their counts; chunk is -1 where no answer is needed."""
    buckets = buckets or n_buckets(chunks)

    def step(docs: pa.Table, words: pa.Table) -> pa.Table:
        chunk = Chunk(docs, words)
        at, key, _, n = chunk.pairs()
        df = chunk.of("df")
        own = (df[chunk.tokens[at]] == 1) | (chunk.contexts(df, 2)[at] == 1)
        number = docs["chunk"][0].as_py()
        bucket = (mix64(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        out: list[tuple[int, int, bytes]] = []
        for named, some in ((number, np.flatnonzero(~own)), (-1, np.flatnonzero(own & (n > 1)))):
            for place, rows in dealt(bucket[some]):
                out.append((place, named, packed(key[some[rows]], n[some[rows]])))
        kinds = (pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["bucket", "chunk", "pairs"])

    return chunks.select("chunk", "held_out", "tokens").groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(
        step, "bucket bigint, chunk bigint, pairs binary"
    )


def pair_answers(pairs: DataFrame) -> DataFrame:
    """Rows (key, c) with ``first`` for the pairs to be drawn; else (chunk, pairs) for the chunks that cannot know the counts."""

    def step(rows: pa.Table) -> pa.Table:
        forget()
        parts = [unpacked(b) for b in rows["pairs"].to_pylist()]
        key, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        chunk = np.repeat(rows["chunk"].to_numpy(), [len(k) for k, _ in parts])
        order = np.argsort(key, kind="stable")
        key, n, chunk = key[order], n[order], chunk[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        sums = np.add.reduceat(n, starts)
        c = np.repeat(sums, np.diff(np.append(starts, len(key))))
        drawn = starts[sums > 1]
        told = np.flatnonzero((chunk >= 0) & ((c > 1) | ((c == 1) & (n == 0))))
        blobs = [(named, packed(key[told[some]], c[told[some]])) for named, some in dealt(chunk[told])]
        none, no = [None] * len(drawn), [None] * len(blobs)
        return pa.table([
            pa.array([*none, *[named for named, _ in blobs]], pa.int64()),
            pa.concat_arrays([pa.array(key[drawn]), pa.array(no, pa.int64())]),
            pa.concat_arrays([pa.array(c[drawn]), pa.array(no, pa.int64())]),
            pa.array(np.arange(len(drawn) + len(blobs)) < len(drawn)),
            pa.array([*none, *[blob for _, blob in blobs]], pa.binary()),
        ], names=["chunk", "key", "c", "first", "pairs"])

    return pairs.groupBy("bucket").applyInArrow(step, "chunk bigint, key bigint, c bigint, first boolean, pairs binary")


# The model


def word_table(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct words (id, hash, c, df) and each chunk's words (chunk, number, id, c, df).

    ids are dense: a partition's own numbers after those of the partitions before it.
    """
    held = stage(
        chunks.filter("words IS NOT NULL")
        .select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("number", "w"))
        .select("chunk", "number", F.col("w.words").alias("hash"), F.col("w.counts").alias("n"))
    )
    words = stage(
        held.groupBy("hash").agg(F.sum("n").alias("c"), F.count("*").alias("df")).withColumn("m", F.monotonically_increasing_id())
    )
    part = F.shiftright("m", 33)
    sizes = dict(words.groupBy(part.alias("p")).count().collect())  # a row per partition
    offsets, total = [], 1
    for p in sorted(sizes):
        offsets.append((p, total))
        total += sizes[p]
    if total > _MASK:
        raise ValueError(f"{total} distinct words do not fit 32 bits")
    table = chunks.sparkSession.createDataFrame(offsets, "p bigint, before bigint")
    words = words.join(F.broadcast(table), part == F.col("p")).select(
        (F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"), "hash", "c", "df"
    )
    chunk_words = stage(held.drop("n").join(words, "hash").drop("hash"))
    drop(held)
    return words, chunk_words


def pair_blocks(pairs: DataFrame) -> DataFrame:
    """The words of each block of pairs (block, at, id), the block's pairs in the first row; the rows are to be staged at once.

    ``of_context`` and ``of_dish`` tell how many fewer tables than customers a word has in the
    block's pairs, as context and as dish, when each dish has one table.
    """

    def block(number: int, key: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(key)
        key, c = key[order], c[order]
        ids, places = np.unique(np.concatenate([key >> 32, key & _MASK]), return_inverse=True)
        u, w = places[:len(key)], places[len(key):]
        raw = np.concatenate([u, w]).astype("<i4").tobytes() + c.astype("<i8").tobytes()
        blob = zstandard.ZstdCompressor(level=1, write_checksum=False).compress(raw)
        sums = [np.bincount(x, c - 1, len(ids)).astype(np.int64) for x in (u, w)]
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(ids), number)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids),
            *map(pa.array, sums), pa.array([blob, *[None] * (len(ids) - 1)], pa.binary()),
        ], names=["block", "at", "id", "of_context", "of_dish", "pairs"])

    def run(batches: Batches) -> Batches:
        forget()
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            held.append([x.to_numpy() for x in batch.columns])
            size += len(batch)
            if size >= BLOCK:
                yield block(number, *map(np.concatenate, zip(*held)))
                number, held, size = number + 1, [], 0
        if size:
            yield block(number, *map(np.concatenate, zip(*held)))

    # ranges of the key keep the pairs of a context together
    return pairs.select("key", "c").repartitionByRange("key").mapInArrow(
        run, "block bigint, at int, id bigint, of_context bigint, of_dish bigint, pairs binary"
    )


def summed(fewer: DataFrame) -> DataFrame:
    return fewer.groupBy("id").agg(F.sum("of_context").alias("of_context"), F.sum("of_dish").alias("of_dish"))


def sweep(blocks: DataFrame, words: DataFrame, settings: Settings, number: int) -> DataFrame:
    """Draw the tables of all dishes: how many fewer than customers each word has as context and as dish."""

    def draw(pairs: pa.Table, members: pa.Table) -> pa.Table:
        order = np.argsort(members["at"].to_numpy())
        ids, tables, p = (members[x].to_numpy()[order] for x in ("id", "tables", "p"))
        raw = zstandard.ZstdDecompressor().decompress(pairs["pairs"][0].as_py())
        n = len(raw) // 16
        u, w = np.frombuffer(raw, "<i4", 2 * n).reshape(2, n)
        c = np.frombuffer(raw, "<i8", n, 8 * n)
        a = (CONCENTRATION + settings.discount * tables[u]) * p[w].astype(float)
        less = c - draw_tables(c, a, (ids[u] << 32) | ids[w], number, settings.discount)
        sums = [np.bincount(x, less, len(ids)).astype(np.int64) for x in (u, w)]
        some = (sums[0] > 0) | (sums[1] > 0)
        return pa.table([pa.array(x[some]) for x in (ids, *sums)], names=["id", "of_context", "of_dish"])

    state = words.filter("paired").select(
        "id", F.element_at("tables", -1).alias("tables"), F.element_at("p", -1).alias("p")
    )
    members = blocks.select("block", "at", "id").join(state, "id")
    return summed(
        blocks.filter("pairs IS NOT NULL").select(F.col("block").alias("named"), "pairs").groupBy("named")
        .cogroup(members.groupBy("block")).applyInArrow(draw, "id bigint, of_context bigint, of_dish bigint")
    )


def with_state(
    words: DataFrame, fewer: DataFrame, settings: Settings, number: int, lone: int
) -> tuple[DataFrame, tuple[float, float]]:
    """Adds to the words' histories the tables of each context and the root's probability of each dish.

    ``fewer`` tells how many fewer tables than customers the words have.  The root's seating is drawn, too.
    ``lone`` dishes that are not among ``words`` have one customer; the probabilities
    of dishes without and with one customer are the second result.
    """
    seats = (words.agg(F.sum("seats")).first()[0] or 0) + lone
    root_a = (CONCENTRATION + settings.root_discount * seats) * settings.base

    @F.arrow_udf("bigint")
    def seated(ids: pa.Array, customers: pa.Array) -> pa.Array:
        c = customers.to_numpy()
        return pa.array(draw_tables(c, np.full(len(c), root_a), ids.to_numpy(), 2000 + number, settings.root_discount))

    old = ["id", "c", "total", "paired", "tables", "p"]
    zero = F.lit(0).cast("bigint")
    state = words.filter("paired").select(*old).join(fewer, "id", "left").unionByName(
        words.filter("not paired").select(*old, zero.alias("of_context"), zero.alias("of_dish"))
    )
    customers = F.col("c") - F.coalesce("of_dish", zero)
    state = stage(state.select(
        "id", "c", "total", "paired", "p", customers.alias("customers"), seated("id", customers).alias("seats"),
        F.array_append("tables", F.col("total") - F.coalesce("of_context", zero)).alias("tables"),
    ))
    customers, seats = state.agg(F.coalesce(F.sum("customers"), zero), F.coalesce(F.sum("seats"), zero)).first()
    customers, seats = customers + lone, seats + lone
    more = (CONCENTRATION + settings.root_discount * seats) * settings.base
    p = (F.col("customers") - settings.root_discount * F.col("seats") + more) / (CONCENTRATION + customers)
    rare = more / (CONCENTRATION + customers), (1 - settings.root_discount + more) / (CONCENTRATION + customers)
    return state.withColumn("p", F.array_append("p", p.cast("float"))), rare


#: Words with a state of their own: learned more than once, or the end token.
OWN_STATE = f"(c > 1 OR hash = {END_HASH})"


def fit_frequent(pairs: DataFrame, words: DataFrame, documents: int) -> tuple[Settings, DataFrame]:
    """Settings, and the last ``KEPT`` + 1 states of the words of ``OWN_STATE`` by id: arrays ``tables`` and ``p``.

    ``pairs`` holds the counts above one of distinct pairs; a context's customers that they do not hold sit alone.
    """
    blocks = stage(pair_blocks(pairs))
    tokens, known, lone = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.expr(f"count_if(c = 1 AND NOT {OWN_STATE})")
    ).first()
    in_pairs, twos = pairs.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") == 2)).first()
    begin = words.sparkSession.createDataFrame([(BEGIN_ID, 0, documents)], "id bigint, c bigint, total bigint")
    total = F.when(F.col("hash") == END_HASH, F.lit(0)).otherwise(F.col("c")).cast("bigint").alias("total")
    # at first every dish has one table in its context
    alone = summed(blocks)
    state = stage(words.filter(OWN_STATE).select("id", "c", total).unionByName(begin).join(alone, "id", "left").select(
        "id", "c", "total", F.isnotnull("of_dish").alias("paired"),
        (F.col("c") - F.coalesce("of_dish", F.lit(0))).alias("customers"),
        F.lit(1).alias("seats"), F.array().cast("array<bigint>").alias("tables"), F.array().cast("array<float>").alias("p"),
    ))
    ones, two = state.agg(F.count_if(F.col("customers") == 1), F.count_if(F.col("customers") == 2)).first()
    settings = Settings(tokens, known, documents, estimated(tokens - in_pairs, twos), estimated(ones + lone, two))
    rare = []
    for number in range(SWEEPS + 1):
        before = state
        fewer = sweep(blocks, state, settings, number) if number else alone
        state, now = with_state(state, fewer, settings, number, lone)
        rare.append(now)
        drop(before)
    drop(blocks)
    last = [F.slice(c, -KEPT - 1, KEPT + 1).alias(c) for c in ("tables", "p")]
    return replace(settings, rare=tuple(rare[-KEPT - 1:])), state.select("id", "total", *last)


def fit(pairs: DataFrame, words: DataFrame, documents: int) -> tuple[Settings, DataFrame]:
    """As :func:`fit_frequent`, with the states of all words."""
    settings, state = fit_frequent(pairs, words, documents)
    p = [F.when(F.col("c") > 0, F.lit(one)).otherwise(F.lit(none)).cast("float") for none, one in settings.rare]
    rare = words.filter(f"NOT {OWN_STATE}").select(
        "id", F.col("c").alias("total"), F.array_repeat("c", KEPT + 1).alias("tables"), F.array(*p).alias("p")
    )
    return settings, state.unionByName(rare)


def predictive(
    c: np.ndarray, key: np.ndarray, total: np.ndarray, tables: np.ndarray, p: np.ndarray, settings: Settings
) -> np.ndarray:
    """Probabilities of dishes with ``c`` customers in their contexts, averaged over the kept sweeps.

    ``tables`` of the context and ``p`` of the dish hold one column per state, that before the first kept sweep first.
    """
    d, out = settings.discount, np.zeros(len(c))
    for i in range(KEPT):
        a = (CONCENTRATION + d * tables[:, i]) * p[:, i].astype(float)
        t = draw_tables(c, a, key, SWEEPS - KEPT + 1 + i, d)
        own = np.where(c > 0, c - d * t, 0.0)
        out += (own + (CONCENTRATION + d * tables[:, i + 1]) * p[:, i + 1]) / (CONCENTRATION + total)
    return out / KEPT


SCORES = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint,"
    " base_score double, score double"
)


def scored(chunks: DataFrame, words: DataFrame, answers: DataFrame, settings: Settings, begin: tuple) -> DataFrame:
    """``SCORES`` of every text.  ``begin`` holds total, tables and p of the begin of a text."""
    both = words.unionByName(answers.select("chunk", "pairs"), allowMissingColumns=True)
    states = range(KEPT + 1)

    def step(docs: pa.Table, replies: pa.Table) -> pa.Table:
        told = replies["pairs"].drop_null().to_pylist()
        chunk = Chunk(docs, replies.filter(replies["pairs"].is_null()).drop_columns("pairs"))
        c_word = chunk.of("c")
        at, key, pair, c = chunk.pairs()
        # a pair without an answer has no other chunk's counts
        for blob in told:
            keys, counts = unpacked(blob)
            c[np.searchsorted(key, keys)] = counts
        # a word without a state of its own has that of all words of its count
        rare = np.isnan(chunk.of("p0"))
        word_total = c_word.copy()
        word_total[END] = 0  # nothing follows the end
        word_tables = np.stack([np.where(rare, c_word, chunk.of(f"tables{i}")) for i in states], axis=1)
        word_p = np.stack([
            np.where(rare, np.array(settings.rare[i], np.float32)[np.minimum(c_word, 1)], chunk.of(f"p{i}")) for i in states
        ], axis=1)
        value = np.empty(len(chunk.tokens))
        known = pair >= 0

        def probability(c: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
            start = np.isin(at, chunk.starts)
            before = chunk.tokens[np.maximum(at - 1, 0)]
            total = np.where(start, begin[0], word_total[before])
            tables = np.where(start[:, None], np.array(begin[1], float), word_tables[before])
            return predictive(c, key, total, tables, word_p[chunk.tokens[at]], settings)

        value[known] = probability(c, key, at)[pair[known]]
        rest = np.flatnonzero(~known)
        value[rest] = probability(np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64), rest)
        token_c = c_word[chunk.tokens]
        base = np.log10((token_c + 0.5) / (settings.tokens + 0.5 * (settings.known + 1)))
        sums = [np.add.reduceat(x, chunk.starts) for x in ((token_c > 0).astype(np.int64), base, np.log10(value))]
        return pa.table({
            "doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": chunk.lengths, "n_known": sums[0],
            "train_tokens": np.full(len(docs), settings.tokens, np.int64), "base_score": sums[1], "score": sums[2],
        })

    return chunks.select("chunk", "doc_id", "held_out", "tokens").groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(step, SCORES)


def score_texts(docs: DataFrame, folds: int = 5, fold: int = 1) -> DataFrame:
    """Base score and log10 probability (``SCORES``) of every text.

    Learned from are the texts whose hashed id modulo ``folds`` is not ``fold``.
    """
    chunks = stage(tokens_of(docs, folds, fold))
    words, chunk_words = word_table(chunks)
    buckets = n_buckets(chunks)
    pairs = [
        stage(pair_counts(part(chunks, "chunk", i), part(chunk_words, "chunk", i), buckets)) for i in range(PARTS)
    ]
    answers = union([stage(pair_answers(part(union(pairs), "bucket", i))) for i in range(PARTS)])
    for staged in pairs:
        drop(staged)
    documents = chunks.filter("not held_out").count()
    settings, state = fit_frequent(answers.filter("first").select("key", "c"), words, documents)
    drop(words)
    begin = tuple(state.filter(F.col("id") == BEGIN_ID).select("total", "tables", "p").first())
    columns = ["chunk", "number", "id", "c"]
    own = (F.col("c") > 1) | (F.col("number") == END)
    none = F.lit(None).cast("binary").alias("pairs")
    flat = [F.col(c)[i].cast("double").alias(f"{c}{i}") for c in ("tables", "p") for i in range(KEPT + 1)]
    scores = []
    for i in range(PARTS):
        some = part(chunk_words, "chunk", i)
        with_states = some.filter(own).join(state, "id").select(*columns, none, *flat).unionByName(
            some.filter(~own).select(*columns), allowMissingColumns=True
        )
        replies = part(answers.filter("not first"), "chunk", i)
        scores.append(stage(scored(part(chunks, "chunk", i), with_states, replies, settings, begin)))
    return union(scores)


def perplexity(scores: DataFrame) -> Column:
    """Perplexity of each row of ``SCORES``."""
    return F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
