"""Chat formatting after collapse of cumulative snapshots.

Logs often hold a conversation once per turn: each record repeats all turns so far.  Such a
snapshot is a prefix of a longer conversation.  Every turn gets a hash of its place, role and text;
the sums of these up to each turn are the rolling hashes of the conversation's prefixes (two
independent 64-bit sums, so 128 bits).  A conversation goes when its last rolling hash is that
of a proper prefix of another one, or the last of an equal one with a smaller id: two anti-joins
on distinct hashes.  What is left is rendered.

The hashes are collapsed to distinct ones with a partial combine before they are joined, so a first
turn or a whole conversation that a third of the log shares is one row by then.

Defined cases: rows that repeat a (conversation, turn, role, text) count once; other rows of one
turn are ordered by role and text; NULL turns come last; NULL role or text is rendered empty but
is not equal to an empty one; rows with a NULL conversation id are one conversation;
an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitcal.operators.ordered import null_safe_join
from unitcal.session import stage

#: The marks around a turn in the rendered text.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

TURN = ("turn", "role", "text")
PREFIX = ("place", "hash_a", "hash_b")


def rolling_hashes(turns: DataFrame) -> DataFrame:
    """Add ``place`` (from 1) and the rolling hashes of the prefix that ends at each turn."""
    order = [F.asc_nulls_last(c) for c in TURN]
    in_order = Window.partitionBy("conv_id").orderBy(*order)
    placed = turns.select("conv_id", *TURN).distinct().withColumn("place", F.row_number().over(in_order).cast("bigint"))
    up_to = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    flags = F.concat_ws(",", F.col("role").isNull(), F.col("text").isNull())

    def rolling(salt: str) -> Column:
        # sums of longs wrap around under bit arithmetic only, so they are kept as 20 digits
        own = F.xxhash64(F.lit(salt), "place", flags, "role", "text").cast("decimal(20,0)")
        return F.sum(own).over(up_to).cast("decimal(30,0)")

    return placed.withColumns({"hash_a": rolling("a"), "hash_b": rolling("b")})


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that are no prefix of another one.

    Of equal conversations the one with the smallest id stays; ``n_copies`` counts them all.
    """
    lengths = prefixes.groupBy("conv_id").agg(F.max_by(F.struct(*PREFIX), "place").alias("last"))
    whole = lengths.select("conv_id", *[F.col(f"last.{c}").alias(c) for c in PREFIX])
    classes = whole.groupBy(*PREFIX).agg(
        F.min(F.struct(F.col("conv_id").isNotNull(), "conv_id")).alias("first"), F.count("*").alias("n_copies")
    )
    with_length = null_safe_join(prefixes.select("conv_id", *PREFIX), whole.select("conv_id", F.col("place").alias("n")), ["conv_id"])
    inner = with_length.filter("place < n").select(*PREFIX).distinct()
    return classes.join(inner, list(PREFIX), "left_anti").select(
        F.col("first.conv_id").alias("conv_id"), F.col("place").alias("n_turns"), "n_copies"
    )


def escaped(text: Column) -> Column:
    """The marks inside a text lose their bars, so that a text can't open or close a turn."""
    return reduce(lambda t, m: F.replace(t, F.lit(m), F.lit(m.replace("|", ""))), (OPEN, CLOSE), F.coalesce(text, F.lit("")))


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, text): the turns of each conversation in order of ``place``."""
    turn = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit("\n"), escaped(F.col("text")), F.lit(CLOSE + "\n"))
    return turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("place", turn.alias("turn")))).alias("turns")
    ).select("conv_id", F.array_join(F.col("turns.turn"), "").alias("text"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, text) of the maximal conversations of (conv_id, turn, role, text)."""
    prefixes = stage(rolling_hashes(turns))
    kept = stage(maximal(prefixes))
    texts = render(null_safe_join(prefixes, kept.select("conv_id"), ["conv_id"], "left_semi"))
    return null_safe_join(kept, texts, ["conv_id"])
