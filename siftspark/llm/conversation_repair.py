"""Conversation structure repair: the cheapest edits that give a conversation its turn order, by iterative-deepening A*.

A conversation should read: a system turn or none, then user and assistant in turns. Blank and repeated rows must go,
other rows may be kept, given another role, or deleted, and empty turns may be inserted. The search is depth-first in
ASCII order of the edits' letters under a cost bound that rises until a path is accepted, so the first path accepted is
the cheapest and, of those, the least in ASCII. A transposition table keeps for each (row, state) the least cost that is
still possible after it failed.

Rows are dealt out by conversation and sorted there by turn, and read as a stream: a conversation is held as its rows'
initials, faults and digests (some hundred bytes a row), never as its texts. The texts pass by a second time, when the
edits are applied.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from siftspark.llm._shared import ASCII_SPACE, scratch, stored

DELETE, INSERT, REROLE = 4, 3, 3
#: Added for a truncated row that isn't deleted.
TRUNCATED = 3
#: States: nothing yet, after system, after user, after assistant. The first and the last accept.
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {"su", "ua", "au"}
ROLES = {USER: "user", ASSISTANT: "assistant"}


def kept_state(state: int, initial: str) -> int | None:
    """The state after a row of this initial, None if it can't stand there."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def added_state(state: int) -> int:
    """The state after an inserted or reroled row: its role follows from the state before."""
    return ASSISTANT if state == USER else USER


def least_costs(initials: list[str], faults: str) -> list[int]:
    """For each row, a bound of the cost from there to the end.

    Faulty rows cost what they must. Two neighbours among the rows that may stay, if their roles don't fit, need an edit
    at one of them or between; neighbours that share no row need edits of their own, so the dearest such choice counts.
    """
    n = len(initials)
    stay = [i for i in range(n) if faults[i] not in "bd"]
    pairs = [0] * (len(stay) + 2)
    for m in range(len(stay) - 1, -1, -1):
        last = m + 1 == len(stay)
        fits = initials[stay[m]] == "a" if last else initials[stay[m]] + initials[stay[m + 1]] in LEGAL
        cut = faults[stay[m]] == "t" or not last and faults[stay[m + 1]] == "t"
        pairs[m] = max(pairs[m + 1], pairs[m + 2] + (0 if fits else DELETE - TRUNCATED if cut else min(INSERT, REROLE, DELETE)))
    out, m, must = [0] * (n + 1), len(stay), 0
    for i in range(n - 1, -1, -1):
        must += DELETE if faults[i] in "bd" else TRUNCATED if faults[i] == "t" else 0
        m -= faults[i] not in "bd"
        out[i] = must + pairs[m]
    return out


def cheapest_edits(initials: list[str], faults: str) -> tuple[int, str]:
    """(cost, edits) of rows with these role initials and faults ("b" blank, "d" duplicate, "t" truncated, "-" none).

    Edits are letters: Delete, Insert, Keep, Rerole; ties are the ASCII-least. Memory: four numbers a row.
    """
    n = len(initials)
    low = [x for x in least_costs(initials, faults) for _ in range(4)]
    low[4 * n + SYSTEM], low[4 * n + USER] = 2 * INSERT, INSERT

    def edit(k: int, i: int, state: int) -> tuple[str, int, int, int] | None:
        """The k-th edit in ASCII order: its letter, cost, next row and next state."""
        if k == 1:
            return "I", INSERT, i, added_state(state)
        if i == n:
            return None
        if k == 0:
            return "D", DELETE, i + 1, state
        if faults[i] in "bd":
            return None
        more = TRUNCATED if faults[i] == "t" else 0
        if k == 3:
            return "R", REROLE + more, i + 1, added_state(state)
        after = kept_state(state, initials[i])
        return None if after is None else ("K", more, i + 1, after)

    while True:
        bound, path = low[START], []
        frames = [[0, START, bound, 0, 1 << 62]]  # row, state, cost left, next edit, least cost of those that failed
        while frames:
            frame = frames[-1]
            i, state, left = frame[:3]
            if i == n and state in (START, ASSISTANT):
                return bound - left, "".join(path)
            while frame[3] < 4:
                found = edit(frame[3], i, state)
                frame[3] += 1
                if found is None:
                    continue
                letter, cost, j, after = found
                least = cost + low[4 * j + after]
                if least <= left:
                    path.append(letter)
                    frames.append([j, after, left - cost, 0, 1 << 62])
                    break
                frame[4] = min(frame[4], least)
            else:
                low[4 * i + state] = max(low[4 * i + state], frame[4])
                frames.pop()
                if frames:
                    path.pop()
                    frames[-1][4] = min(frames[-1][4], frames[-1][2] - left + low[4 * i + state])


class _Report:
    """What is counted of one conversation while its rows pass by."""

    def __init__(self):
        self.initials: list[str] = []
        self.faults: list[str] = []
        self.seen: set[bytes] = set()
        self.first = self.last = None
        self.turns = 0

    def add(self, turn, role: str, text: str) -> None:
        from xxhash import xxh3_128_digest

        bare = text.rstrip(ASCII_SPACE)
        digest = xxh3_128_digest(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"))
        self.faults.append("b" if not bare else "d" if digest in self.seen else "t" if bare[-1] not in ".!?" else "-")
        self.seen.add(digest)
        self.initials.append(role[:1])
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        faults = "".join(self.faults)
        illegal = sum(a + b not in LEGAL for a, b in zip(self.initials, self.initials[1:], strict=False))
        return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, *cheapest_edits(self.initials, faults)


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
#: Spark puts nulls first.
ORDER = ["_conv", "_kind", "_turn", "_role", "_text"]


def _plain(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    words = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(k) for c, k in ((role_col, "_role"), (text_col, "_text"))]
    return rows.select(F.col(conv_col).alias("_conv"), F.lit(1).alias("_kind"), F.col(turn_col).cast("long").alias("_turn"), *words)


def audit_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_col, gaps, blank, duplicate, truncated, illegal, cost (longs) and `audit`, the edits in order.

    Rows are taken by turn (nulls first), then role and text. A row's first fault counts: blank (white space only),
    duplicate (role and text seen earlier), truncated (it doesn't end in `.`, `!` or `?`). `gaps` are turns missing
    between the least and the greatest, `illegal` are neighbours whose role initials don't follow each other. A null
    role or text counts as one space, null conversations as one. Texts of any length are taken whole and read once; one
    conversation is one task's work, in the order of its turns. An empty table gives none; further columns don't matter.
    """
    plain = _plain(rows, conv_col, turn_col, role_col, text_col)
    schema = StructType([plain.schema["_conv"], *(StructField(c, LongType()) for c in COUNTS), StructField("audit", StringType())])
    arrow = {}

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, report, out = None, None, []

        def batch_of(rows):
            columns = list(zip(*rows, strict=True))
            kinds = [arrow["conv"], *[pa.int64()] * len(COUNTS), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["_conv", *COUNTS, "audit"])

        for batch in batches:
            arrow["conv"] = batch.schema.field(0).type
            for conv, turn, role, text in zip(*(batch.column(k).to_pylist() for k in ("_conv", "_turn", "_role", "_text")), strict=True):
                if report is None or conv != now:
                    if report is not None:
                        out.append((now, *report.row()))
                    now, report = conv, _Report()
                report.add(turn, role, text)
            if out:
                yield batch_of(out)
                out = []
        if report is not None:
            yield batch_of([(now, *report.row())])

    return plain.repartition("_conv").sortWithinPartitions(*ORDER).mapInArrow(audit, schema).withColumnRenamed("_conv", conv_col)


def repair_conversations(rows: DataFrame, audits: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The conversations after their edits: conv_col, position (from 0), turn (null if inserted), role, text and edit.

    audits: of `audit_conversations` over the same rows. A conversation's rows come in order within one partition; a
    conversation that loses all rows gives none. The edits come first in the stream, then the rows, so no text is held.
    """
    plain = _plain(rows, conv_col, turn_col, role_col, text_col).withColumn("_audit", F.lit(None).cast("string"))
    heads = audits.select(F.col(conv_col).alias("_conv"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_turn"), F.lit("").alias("_role"), F.lit("").alias("_text"), F.col("audit").alias("_audit"))
    schema = StructType([plain.schema["_conv"], StructField("position", LongType()), StructField("turn", LongType()), StructField("role", StringType()), StructField("text", StringType()), StructField("edit", StringType())])

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, kind = [], None
        now, edits, at, state, position = None, "", 0, START, 0

        def put(edit, turn, role, text):
            nonlocal state, position
            if edit != "K":
                state = added_state(state)
                role = ROLES[state]
            else:
                state = kept_state(state, role[:1])
            out.append((now, position, turn, role, text, edit))
            position += 1

        def inserted():
            nonlocal at
            while edits[at : at + 1] == "I":
                at += 1
                put("I", None, None, "")

        def taken():
            columns = list(zip(*out, strict=True))
            out.clear()
            kinds = [kind, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, head, turn, role, text, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if head == 0:
                    inserted()
                    now, edits, at, state, position = conv, audit, 0, START, 0
                    continue
                inserted()
                edit, at = edits[at], at + 1
                if edit != "D":
                    put(edit, turn, role, text)
            if out:
                yield taken()
        inserted()
        if out:
            yield taken()

    both = plain.unionByName(heads).select("_conv", "_kind", "_turn", "_role", "_text", "_audit")
    return both.repartition("_conv").sortWithinPartitions(*ORDER).mapInArrow(edited, schema).withColumnRenamed("_conv", conv_col)


def digests(repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_col, repaired_sha256) over `role:text` of a conversation's rows, joined by newlines. repaired: as `repair_conversations` gives it."""
    schema = StructType([repaired.schema[conv_col], StructField("repaired_sha256", StringType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, kind = None, None, None

        def done(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())], schema.names)

        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for conv, position, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if position == 0:
                    if sha is not None:
                        out.append((now, sha.hexdigest()))
                    now, sha = conv, hashlib.sha256()
                sha.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            if out:
                yield done(out)
        if sha is not None:
            yield done([(now, sha.hexdigest())])

    return repaired.select(conv_col, "position", "role", "text").mapInArrow(digest, schema)


def audited_digests(rows: DataFrame, conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """For every conversation of `conversations` (its conv_col): the audit of its rows and the digest of what they become; zeros, no edits and the digest of nothing if no row is left."""
    with scratch(rows.sparkSession) as keep:
        audits = keep(stored(audit_conversations(rows, conv_col), "audits"))
    sums = digests(repair_conversations(rows, audits, conv_col), conv_col)
    out = conversations.select(F.col(conv_col).alias("_of")).distinct()
    for part in (audits, sums):
        out = out.join(part, F.col("_of").eqNullSafe(part[conv_col]), "left").drop(part[conv_col])
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("_of").alias(conv_col), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations (conv_id, turn, role, text) with faults put in by crc32 of `conv_id:turn`: a twentieth each dropped, emptied, without `.!?`, repeated, of role user. Nulls but of conv_id and turn become one space."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    spelled = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    by = F.crc32(F.encode(spelled, "UTF-8")) % 20
    text = F.when(by == 1, "").when(by == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    times = F.when(by == 0, F.array().cast("array<int>")).when(by == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(by == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")
