"""Quality rules: counts of the words of a text, and the perplexity of its characters.

The language model is an interpolated modified Kneser-Ney model of characters (order ``ORDER``) over
the words of a text, joined by one blank, with its start and its end: n-grams cross blanks, so the
order of words and the marks between sentences count.  There is one model per language, counted on
all documents, and it grows with them: n-grams are exact (their characters, packed in two longs),
and no task and no driver holds the whole model.

* ``chunked``: tasks cut their documents into chunks of about ``CHUNK`` bytes and write, per chunk, its
  documents (blocks of counts and compressed words) and its distinct n-grams of the highest order with their
  counts.  Both are rows of one staged table.
* ``probabilities``: aggregates and joins over the count tables give the lower orders (distinct left
  extensions), discounts, context totals and the probability of each n-gram.
* ``score``: the chunks' n-grams are joined with their probabilities, and each chunk meets the
  probabilities of its own n-grams, which a task keeps in a sorted array of 64-bit hashes.  The chunks
  are exchanged in ``WAVES`` parts, one after the other, so that the disk holds the exchange of one.

Two perplexities of a document are judged: that of all its characters, and that of the characters told
across a blank (one of the characters before them is a blank), which is where the order of words and
sentences shows.  Per language, the documents that pass the counts give the median and the quartiles of
the logarithm of each; a document outside ``[median - low * spread, median + high * spread]`` of either is
rejected, with low and high of ``BANDS`` and spread being half the distance between the quartiles, at
least ``LEAST_SPREAD``.

Defined cases: a NULL or blank text has no words, fails the counts and is not kept; a NULL
language is a language of its own, the same as an empty name; repeated rows are judged as often as
they occur; a text of any length is one chunk's, scored in windows; an empty table gives no row;
columns other than id, text and lang are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitcal.llm.shared import Batches, drop, forget, mix64, raw_texts
from unitcal.llm.words import runs
from unitcal.session import stage

ORDER = 4
#: Half interquartile distances below and above the median that a document may be away.
BANDS = {"log_perplexity": (12.0, 6.0), "log_perplexity_across": (12.0, 6.0)}
LEAST_SPREAD = 0.02
SYMBOLS = b"#*$%&|<>"
REPEAT = 8  # words of a repeated window

CHUNK = 32_000_000  # bytes of text whose n-grams are told apart together
WINDOW = 1_000_000  # characters that are looked at together
BLOCK = 1_000_000  # bytes of text of a row of documents, one text at least
WAVES = 4  # a power of two: parts of the chunks that are exchanged and scored one after the other
SALTS = 64  # copies of a language's row in joins, so that no task has a whole language

_START, _END = 0x110000, 0x110001  # behind the last character of Unicode
_BITS = 21  # of a packed character
_rng = np.random.default_rng(7)
_WINDOW = _rng.integers(1, 1 << 63, REPEAT, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, ORDER, dtype=np.uint64) | np.uint64(1)
_CHAR = mix64(np.arange(1, _END + 2, dtype=np.uint64))


def base_counts(raw: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    n = len(words)
    joined = b"".join(words)
    chars = len(joined)
    if not joined.isascii():
        chars -= int((np.frombuffer(joined, np.uint8) & 0xC0 == 0x80).sum())
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeated = 0
    if n > REPEAT:
        ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        windows = n - REPEAT + 1
        keys = np.zeros(windows, np.uint64)
        for j in range(REPEAT):
            keys += ids[j:j + windows] * _WINDOW[j]
        _, where, many = np.unique(keys, return_inverse=True, return_counts=True)
        twice = many[where] > 1
        if twice.any():
            edge = np.zeros(n + 1, np.int64)
            edge[:windows] += twice
            edge[REPEAT:] -= twice
            repeated = int((np.cumsum(edge)[:n] > 0).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


@dataclass(frozen=True)
class Stream:
    """The characters of several texts, each with its start and its end."""

    chars: np.ndarray  # code points, ORDER - 1 starts before each text and one end behind it
    doc: np.ndarray  # number of the text of each place
    told: np.ndarray  # places that the model predicts: all but the starts

    @classmethod
    def of(cls, texts: list[bytes]) -> Stream:
        plain = [t.decode("utf-8", "replace") for t in texts]
        lengths = np.fromiter(map(len, plain), np.int64, len(plain)) + ORDER
        ends = np.cumsum(lengths)
        chars = np.full(int(ends[-1]) if len(ends) else 0, _START, np.uint32)
        told = np.ones(len(chars), bool)
        for j in range(ORDER - 1):
            told[ends - lengths + j] = False
        chars[ends - 1] = _END
        inner = told.copy()
        inner[ends - 1] = False
        chars[inner] = np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32)
        return cls(chars, np.repeat(np.arange(len(plain), dtype=np.int32), lengths), told)

    def windows(self, seeds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (a window at a time) and the hashes of the n-grams that end there; ``seeds`` are of the texts."""
        for start in range(0, len(self.chars), WINDOW):
            at = start + np.flatnonzero(self.told[start:start + WINDOW])
            if len(at):
                first = at[0] - ORDER + 1
                mixed = _CHAR[self.chars[first:at[-1] + 1]]
                keys = seeds[self.doc[at]]
                for j in range(ORDER):
                    keys += mixed[at - first - j] * _PLACE[j]
                yield at, keys


def seed(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def packed(chars: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end at the places: one character in the first long, three in the second."""
    c = [chars[at - j].astype(np.int64) + 1 for j in range(ORDER - 1, -1, -1)]
    return c[0], c[1] << 2 * _BITS | c[2] << _BITS | c[3]


def hashed(a: np.ndarray, b: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The hashes of packed n-grams, as :meth:`Stream.windows` gives them."""
    mask = (1 << _BITS) - 1
    parts = [b & mask, b >> _BITS & mask, b >> 2 * _BITS, a]
    keys = seeds.astype(np.uint64, copy=True)
    for place, c in zip(_PLACE, parts):
        keys += _CHAR[c - 1] * place
    return keys


class GramCounts:
    """The distinct n-grams of a chunk's texts with their counts, gathered window by window."""

    def __init__(self) -> None:
        self.parts: list[pd.DataFrame] = []

    def add(self, texts: list[bytes], langs: list[str]) -> None:
        if not texts:
            return
        stream = Stream.of(texts)
        seeds = np.array([seed(lang) for lang in langs], np.uint64)
        names = np.array(langs, object)
        for at, keys in stream.windows(seeds):
            codes, found = pd.factorize(keys)
            first = np.empty(len(found), np.int64)
            first[codes[::-1]] = at[::-1]
            a, b = packed(stream.chars, first)
            self.parts.append(pd.DataFrame({
                "key": found, "lang": names[stream.doc[first]], "a": a, "b": b,
                "n": np.bincount(codes, minlength=len(found)),
            }))
            if len(self.parts) == 8:
                self.parts = [self.merged()]

    def merged(self) -> pd.DataFrame:
        every = pd.concat(self.parts, ignore_index=True)
        codes, found = pd.factorize(every["key"].to_numpy())
        first = np.empty(len(found), np.int64)
        first[codes[::-1]] = np.arange(len(every))[::-1]
        total = np.zeros(len(found), np.int64)
        np.add.at(total, codes, every["n"].to_numpy())
        return every.iloc[first].assign(n=total)

    def rows(self, chunk: int) -> pa.RecordBatch | None:
        if not self.parts:
            return None
        grams = self.merged().sort_values(["lang", "a", "b"])  # neighbours are alike, and take less disk
        return batch_of(len(grams), {"chunk": [chunk] * len(grams), **{c: grams[c].to_numpy() for c in ("lang", "a", "b", "n")}})


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
CHUNKED = pa.schema(
    [("chunk", pa.int64()), ("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()),
     ("ids", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("words", pa.binary())]
)
TYPES = (
    "chunk bigint, lang string, a bigint, b bigint, n bigint,"
    " ids array<bigint>, langs array<string>, counts array<bigint>, words binary"
)
SCORES = "doc_id bigint, lang string, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", log_perplexity double, log_perplexity_across double"


EMPTY = pa.schema(
    [("doc_id", pa.int64()), ("lang", pa.string()), *[(c, pa.int64()) for c in COUNTS],
     ("log_perplexity", pa.float64()), ("log_perplexity_across", pa.float64())]
).empty_table()


def batch_of(rows: int, columns: dict[str, object]) -> pa.RecordBatch:
    """Rows of ``CHUNKED``; columns that are not given are NULL."""
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in CHUNKED], schema=CHUNKED
    )


def chunked(docs: DataFrame) -> DataFrame:
    """Rows of blocks of documents (``a`` is NULL) and of the distinct n-grams of each chunk, in one table.

    A block's words are compressed together, a document a line.
    """

    def run(batches: Batches) -> Batches:
        forget()
        squeeze = zstandard.ZstdCompressor(level=3, write_checksum=False)
        chunk, size, grams = TaskContext.get().partitionId() << 32, 0, GramCounts()
        for batch in batches:
            for block in runs(batch.column(2), BLOCK):
                part = batch.slice(block.start, block.stop - block.start)
                ids, langs = part.column(0).to_pylist(), part.column(1).to_pylist()
                counts, words = [], []
                for raw in raw_texts(part.column(2)):
                    split = raw.split()
                    counts += base_counts(raw, split)
                    words.append(b" ".join(split))
                some = [i for i, w in enumerate(words) if w]
                grams.add([words[i] for i in some], [langs[i] for i in some])
                yield batch_of(1, {
                    "chunk": [chunk], "ids": [ids], "langs": [langs], "counts": [counts],
                    "words": [squeeze.compress(b"\n".join(words))],
                })
                size += sum(map(len, words))
                if size >= CHUNK:
                    if (rows := grams.rows(chunk)) is not None:
                        yield rows
                    chunk, size, grams = chunk + 1, 0, GramCounts()
        if (rows := grams.rows(chunk)) is not None:
            yield rows

    return docs.select("doc_id", language(docs), "text").mapInArrow(run, TYPES)


def language(docs: DataFrame) -> Column:
    """The language column; without one all documents are of one language."""
    return F.coalesce(F.col("lang"), F.lit("")).alias("lang") if "lang" in docs.columns else F.lit("").alias("lang")


def of_language(df: DataFrame, rows: DataFrame, salt: Column) -> DataFrame:
    """Join ``rows`` (one per language) to ``df``, each language's rows dealt to ``SALTS`` keys."""
    copies = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = df.withColumn("salt", F.pmod(salt, F.lit(SALTS)).cast("int"))
    return salted.join(copies, ["lang", "salt"], "left").drop("salt")


def suffix(n: int) -> list[Column]:
    """The last ``n`` characters of a packed n-gram."""
    keep = [F.lit((1 << _BITS * max(n - 3, 0)) - 1), F.lit((1 << _BITS * min(n, 3)) - 1)]
    return [F.col("a").bitwiseAND(keep[0]).alias("a"), F.col("b").bitwiseAND(keep[1]).alias("b")]


def context() -> list[Column]:
    """A packed n-gram without its last character."""
    carried = F.shiftleft(F.col("a").bitwiseAND(F.lit((1 << _BITS) - 1)), 2 * _BITS)
    return [F.shiftright("a", _BITS).alias("xa"), F.shiftright("b", _BITS).bitwiseOR(carried).alias("xb")]


def discounts(level: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts per language from the counts of counts, and the number of n-grams."""
    of = [F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def d(i: int) -> Column:
        # without the needed counts of counts (a tiny corpus) half of each count is kept back
        value = i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))
        return F.coalesce(F.when((value > 0) & (value < i), value), F.lit(i / 2)).alias(f"d{i}")

    return level.groupBy("lang").agg(*of, F.count("*").alias("size")).select("lang", "size", *[d(i) for i in (1, 2, 3)])


def probabilities(counts: DataFrame) -> list[DataFrame]:
    """Per order the n-grams (lang, a, b) with their probability ``p`` and their context's ``back_off``.

    Counts are raw at the highest order and distinct left extensions below it.
    """
    levels = [counts]
    for n in range(ORDER - 1, 0, -1):
        levels.insert(0, stage(levels[0].groupBy("lang", *suffix(n)).agg(F.count("*").alias("c"))))
    tables: list[DataFrame] = []
    for n, level in enumerate(levels, 1):
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        level = of_language(level, discounts(level), F.xxhash64("a", "b")).withColumn("cut", F.least(cut, "c"))
        level = level.select("lang", "a", "b", *context(), "c", "cut", "size")
        totals = level.groupBy("lang", "xa", "xb").agg(F.sum("c").alias("total"), F.sum("cut").alias("held"))
        joined = level.join(totals, ["lang", "xa", "xb"])
        if tables:
            lower = tables[-1].select("lang", F.col("a").alias("la"), F.col("b").alias("lb"), F.col("p").alias("p_lower"))
            short = dict(zip(("la", "lb"), suffix(n - 1)))
            joined = joined.withColumns(short).join(lower, ["lang", "la", "lb"])
        else:
            joined = joined.withColumn("p_lower", 1 / (F.col("size") + 1))
        back_off = F.col("held") / F.col("total")
        p = (F.col("c") - F.col("cut")) / F.col("total") + back_off * F.col("p_lower")
        tables.append(stage(joined.select("lang", "a", "b", p.alias("p"), back_off.alias("back_off"))))
    for level in levels[:-1]:
        drop(level)
    return tables


@dataclass(frozen=True)
class Slice:
    """A chunk's n-grams as a sorted array of hashes, with their log probabilities."""

    keys: np.ndarray
    values: np.ndarray
    across: np.ndarray  # whether a blank is among the characters before the last one


def sliced(grams: pa.Table) -> Slice:
    a, b = grams["a"].to_numpy(), grams["b"].to_numpy()
    langs = grams["lang"].combine_chunks().dictionary_encode()
    seeds = np.array([seed(lang) for lang in langs.dictionary.to_pylist()], np.uint64)[langs.indices.to_numpy()]
    keys = hashed(a, b, seeds)
    by_key = np.argsort(keys)
    mask, blank = (1 << _BITS) - 1, ord(" ") + 1
    across = np.zeros(len(a), bool)
    for c in (a, b >> 2 * _BITS, b >> _BITS & mask):
        across |= c == blank
    return Slice(keys[by_key], np.log(grams["p"].to_numpy())[by_key], across[by_key])


def log_probability(words: list[bytes], langs: list[str], known: Slice) -> np.ndarray:
    """Of each text, whose n-grams are all known: of all characters, of those told across a blank, and how many these are."""
    total = np.zeros((3, len(words)))
    stream = Stream.of(words)
    for at, found in stream.windows(np.array([seed(lang) for lang in langs], np.uint64)):
        codes, distinct = pd.factorize(found)
        where = np.searchsorted(known.keys, distinct)
        doc, value = stream.doc[at], known.values[where][codes]
        over = np.flatnonzero(known.across[where][codes])
        total[0] += np.bincount(doc, value, len(words))
        total[1] += np.bincount(doc[over], value[over], len(words))
        total[2] += np.bincount(doc[over], minlength=len(words))
    return total


def score_chunk(blocks: pa.Table, grams: pa.Table) -> pa.Table:
    """The rows of ``SCORES`` of a chunk's documents."""
    known = sliced(grams) if grams.num_rows else None
    unpack = zstandard.ZstdDecompressor()
    results = []
    for block in blocks.to_pylist():
        ids, langs, words = block["ids"], block["langs"], unpack.decompress(block["words"]).split(b"\n")
        counts = np.array(block["counts"], np.int64).reshape(len(ids), len(COUNTS))
        sizes = counts[:, 0] + counts[:, 1]
        value = np.zeros((3, len(ids)))
        some = np.flatnonzero(sizes)
        if len(some):
            value[:, some] = log_probability([words[i] for i in some], [langs[i] for i in some], known)
        columns = {"doc_id": pa.array(ids, pa.int64()), "lang": pa.array(langs, pa.string())}
        columns |= {c: pa.array(counts[:, j]) for j, c in enumerate(COUNTS)}
        for name, of, many in (("log_perplexity", value[0], sizes), ("log_perplexity_across", value[1], value[2])):
            columns[name] = pa.array(-of / np.maximum(many, 1), pa.float64(), mask=many == 0)
        results.append(pa.table(columns))
    return pa.concat_tables(results) if results else EMPTY


def score(chunks: DataFrame, top: DataFrame) -> DataFrame:
    """Counts and mean negative log probability per character of every document (``SCORES``).

    ``top`` has the probability of every n-gram of the highest order in the chunks.
    """
    wanted = chunks.filter("a is not null").select("chunk", "lang", "a", "b")
    grams = stage(wanted.join(top.select("lang", "a", "b", "p"), ["lang", "a", "b"]).select("chunk", "lang", "a", "b", "p"))
    columns = ["chunk", "ids", "langs", "counts", "words"]
    docs = chunks.filter("a is null").select(columns).toDF(*columns)  # columns of their own: both sides are of one table
    # a chunk's name is its partition and its place there
    wave = F.pmod(F.shiftright("chunk", 32) + F.col("chunk"), F.lit(WAVES))
    parts = []
    for i in range(WAVES):
        own, known = docs.filter(wave == i).groupBy("chunk"), grams.filter(wave == i).groupBy("chunk")
        parts.append(stage(own.cogroup(known).applyInArrow(score_chunk, SCORES)))
    drop(grams)
    return reduce(DataFrame.unionByName, parts)


def judge(scores: DataFrame, bands: dict[str, tuple[float, float]] = BANDS) -> DataFrame:
    """Add base_failed, the bands of the document's language (``<perplexity>_low``, ``_high``) and kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scores = scores.withColumn("base_failed", failed)
    edges, inside = [], F.lit(True)
    for value, (low, high) in bands.items():
        quartiles = F.percentile_approx(value, [0.25, 0.5, 0.75], 10_000)
        spread = F.greatest((quartiles[2] - quartiles[0]) / 2, F.lit(LEAST_SPREAD))
        edges += [(quartiles[1] - low * spread).alias(f"{value}_low"), (quartiles[1] + high * spread).alias(f"{value}_high")]
        inside = inside & F.col(value).between(F.col(f"{value}_low"), F.col(f"{value}_high"))
    of_lang = scores.filter("not base_failed").groupBy("lang").agg(*edges)
    return of_language(scores, of_lang, F.xxhash64("doc_id", "word_chars")).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    )


def count_grams(chunks: DataFrame) -> DataFrame:
    """Counts of the highest-order n-grams of all documents."""
    return chunks.filter("a is not null").groupBy("lang", "a", "b").agg(F.sum("n").alias("c"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, perplexity, band and verdict of every document."""
    chunks = stage(chunked(docs))
    counts = stage(count_grams(chunks))
    tables = probabilities(counts)
    for done in (counts, *tables[:-1]):
        drop(done)
    scores = score(chunks, tables[-1])
    for done in (chunks, tables[-1]):
        drop(done)
    return judge(scores)
