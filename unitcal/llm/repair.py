"""Repair of conversation structure by the cheapest edits.

A conversation must read ``(s?(ua)+)?`` in the first letters of its roles.  Its lattice has a node
for every place before, between and after its rows and for what came last there (nothing,
system, user, assistant).  An arc is an edit of the next row (Keep, Rerole, Delete) or an Insert,
with an integer cost; nodes at the end where a conversation may stop have a free arc to the
destination.

Bertsekas's auction algorithm finds the shortest paths.  Every node has a price, a lower bound of its distance to the
destination.  A path starts at an origin and is extended from its last node along the arc whose cost and
price behind it are least; where this exceeds the last node's price, that price is raised and the
path contracted by one node.  Origins are taken from the end of the conversation backwards and prices are kept, so a
path ends at the first node whose price is settled, and every node is settled in the end.  A place begins
with the least settled price behind it, so that prices rise by a few units only, however long the conversation is.  Settled prices are
exact distances, so the arcs that they expose as tight are those of the shortest paths, and the
ASCII-least audit takes from node to node the tight arc with the least letter.

Spark cleans the rows, finds their faults and sorts them.  The auction sees two
codes a row and no text.  The repaired text is hashed as the rows of a partition stream by, after
the row with their conversation's audit, so a task holds the codes of one
conversation and the text of a batch.

Defined cases: NULL roles and texts are one space, and so are a NULL conv_id and turn in the damage hash; rows without
conv_id are one conversation; NULL turns come first; equal turns go by role, then text; a role that begins with none of the letters
s, u and a cannot be kept; repeated rows are duplicates; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitcal.llm.shared import Batches, forget, memory
from unitcal.session import stage

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: What came last: nothing, system, user, assistant; a conversation may stop at the first and the last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STOPS = (NOTHING, ASSISTANT)

#: Row codes: the letter of the role that may be kept ("-" for none), then the fault.
CLEAN, CUT, DOOMED = "c", "t", "d"

ROLES = {USER: "user", ASSISTANT: "assistant"}
BLANKS = r"[^\x20\x09-\x0D]"


def wanted(state: int) -> int:
    """The role that an Insert or Rerole gives after ``state``."""
    return ASSISTANT if state == USER else USER


def arcs(codes: str, at: int, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, place, state) of the edits from a node, by letter."""
    role = wanted(state)
    out = []
    if 2 * at < len(codes):
        letter, fault = codes[2 * at], codes[2 * at + 1]
        late = TRUNCATED if fault == CUT else 0
        out.append(("D", DELETE, at + 1, state))
        if fault != DOOMED:
            if letter == ("a" if role == ASSISTANT else "u"):
                out.append(("K", late, at + 1, role))
            elif letter == "s" and state == NOTHING:
                out.append(("K", late, at + 1, SYSTEM))
            out.append(("R", REROLE + late, at + 1, role))
    out.append(("I", INSERT, at, role))
    return sorted(out)


def auction(codes: str) -> list[int]:
    """Settled prices of all nodes, four to a place."""
    places = len(codes) // 2 + 1
    price = [0] * (4 * places)
    settled = bytearray(4 * places)
    for state in STOPS:
        settled[4 * (places - 1) + state] = 1
    for at in range(places - 1, -1, -1):
        if at < places - 1:
            # no edit has a negative cost, so a place costs at least what the cheapest node of the next one does
            price[4 * at:4 * at + 4] = [min(price[4 * at + 4:4 * at + 8])] * 4
        for state in range(4):
            path = [4 * at + state]
            while not settled[path[-1]]:
                node = path[-1]
                best, nearest = min((cost + price[4 * a + s], 4 * a + s) for _, cost, a, s in arcs(codes, *divmod(node, 4)))
                if price[node] < best:
                    price[node] = best
                    if len(path) > 1:
                        path.pop()
                else:
                    path.append(nearest)
            for node in path:
                settled[node] = 1
    return price


def trace(codes: str, price: list[int]) -> str:
    """The letters of the tight arcs from the start, always the least."""
    audit, at, state = [], 0, NOTHING
    while not (2 * at == len(codes) and state in STOPS):
        here = price[4 * at + state]
        letter, _, at, state = next(x for x in arcs(codes, at, state) if x[1] + price[4 * x[2] + x[3]] == here)
        audit.append(letter)
    return "".join(audit)


def solve(codes: str) -> tuple[int, str]:
    """Cost and audit of the cheapest edits."""
    price = auction(codes)
    return price[NOTHING], trace(codes, price)


#: Short conversations repeat their codes, so a worker remembers so many of their repairs; longer ones are solved each time.
REMEMBERED, SHORT = 1 << 16, 64


def repair(codes: str) -> tuple[int, str]:
    if len(codes) > SHORT:
        return solve(codes)
    known = memory(("repairs",), dict)
    if codes not in known:
        if len(known) >= REMEMBERED:
            known.clear()
        known[codes] = solve(codes)
    return known[codes]


def damage(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, chosen by a hash of conversation and turn."""
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(text) % 20
    return (
        rows.withColumn("kind", kind).filter("kind <> 0")
        .withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
        .withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))))
        .drop("kind", "copy")
    )


def filled(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds place (1, 2, ... in the conversation), fault (``blank``, ``duplicate``, ``truncated`` or NULL) and codes.

    The first of equal rows is found by a hash aggregate of 256-bit digests, not by collecting them.
    """
    conversation = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = stage(rows.withColumn("place", F.row_number().over(conversation).cast("bigint")))
    name = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    first = placed.groupBy("conv_id", name.alias("name")).agg(F.min("place").alias("place")).select(
        F.col("conv_id").alias("_conv"), F.col("place").alias("_place")
    )
    seen = (F.col("conv_id").eqNullSafe(F.col("_conv"))) & (F.col("place") == F.col("_place"))
    blank = ~F.col("text").rlike(BLANKS)
    last = F.regexp_extract("text", rf"({BLANKS})[\x20\x09-\x0D]*\z", 1)
    fault = (
        F.when(blank, "blank").when(F.col("_place").isNull(), "duplicate")
        .when(~last.isin(".", "!", "?"), "truncated")
    )
    letter = F.substring("role", 1, 1)
    code = F.concat(
        F.when(letter.isin("s", "u", "a"), letter).otherwise("-"),
        F.when(fault == "truncated", CUT).when(fault.isNotNull(), DOOMED).otherwise(CLEAN),
    )
    return placed.join(first, seen, "left").withColumn("fault", fault).withColumn("letter", letter).withColumn("code", code).drop("_conv", "_place")


def summaries(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps, counts of faults and illegal neighbours, and the codes of its rows in order."""
    neighbours = Window.partitionBy("conv_id").orderBy("place")
    pair = F.concat(F.lag("letter").over(neighbours), "letter")
    rows = rows.withColumn("bad", F.when(F.col("place") > 1, (~pair.isin("su", "ua", "au")).cast("bigint")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda x: x["code"])
    counts = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    # distinct turns are counted where a turn begins
    begins = F.coalesce((F.col("turn") != F.lag("turn").over(neighbours)) | F.lag("turn").over(neighbours).isNull(), F.lit(False))
    rows = rows.withColumn("begins", (begins & F.col("turn").isNotNull()).cast("bigint"))
    return rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.sum("begins"), F.lit(0)).cast("bigint").alias("gaps"),
        *counts,
        F.coalesce(F.sum("bad"), F.lit(0)).alias("illegal"),
        F.array_join(ordered, "").alias("codes"),
    )


def with_audits(conversations: DataFrame) -> DataFrame:
    """Replaces codes by cost and audit."""

    @F.arrow_udf("cost bigint, audit string")
    def solved(codes: pa.Array) -> pa.Array:
        found = [repair(c) for c in codes.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["cost", "audit"]
        )

    return conversations.withColumn("s", solved("codes")).select("*", "s.cost", "s.audit").drop("s", "codes")


class Repaired:
    """The SHA-256 of a conversation's repaired text, row by row."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.first = audit, 0, NOTHING, True
        self.digest = hashlib.sha256()

    def put(self, role: str, text: str) -> None:
        self.digest.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
        self.first = False

    def inserts(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.state = wanted(self.state)
            self.put(ROLES[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self.state = SYSTEM if edit == "K" and role[0] == "s" else wanted(self.state)
            self.put(role if edit == "K" else ROLES[self.state], text)

    def end(self) -> str:
        self.inserts()
        return self.digest.hexdigest()


def hashed(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of every conversation that has rows."""
    both = conversations.select("conv_id", F.lit(0).cast("bigint").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text")).unionByName(
        rows.select("conv_id", "place", "role", "text")
    )

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        forget()
        now, conv = None, None
        for batch in batches:
            ids, digests = [], []
            for conv_id, place, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if place == 0:
                    if now is not None:
                        ids.append(conv)
                        digests.append(now.end())
                    conv, now = conv_id, Repaired(text)
                else:
                    now.row(role, text)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], names=["conv_id", "repaired_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([now.end()])], names=["conv_id", "repaired_sha256"])

    # both sorts keep a conversation together: rows of one key follow each other in one partition
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def repair_conversations(conversations: DataFrame, damaged: DataFrame | None = None) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired text of every conversation.

    ``damaged`` holds the rows that are judged, by default those of ``conversations``; a conversation that has
    none there has zeros, an empty audit and the digest of the empty string.
    """
    rows = stage(with_faults(filled(conversations) if damaged is None else damaged))
    solved = stage(with_audits(summaries(rows)))
    digests = hashed(rows, solved).select(F.col("conv_id").alias("_id"), "repaired_sha256")
    found = solved.join(digests, F.col("conv_id").eqNullSafe(F.col("_id"))).drop("conv_id")
    ids = conversations.select("conv_id").distinct()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left").select(
        "conv_id",
        *[zero(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)
