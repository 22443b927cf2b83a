"""Repair of conversation structure by iterative-deepening A*.

A conversation is right if its role initials are an optional system turn and then pairs of user and assistant turns,
or nothing. Rows are kept, given another role or deleted, and empty turns are inserted. A depth-first search tries the
edits in the order of their initials (Delete, Insert, Keep, Rerole) under a cost bound; the bound is raised to the
least estimate that went beyond it. A table remembers, for each state that failed, how much the rest costs at least,
so no state is searched twice with the same budget. The first accepting path under the least bound is the answer.

Conversations of any length are cut into pieces of ``PIECE`` rows that are searched on their own, from every state a
piece may be entered in to every state it may be left in. Of two edit strings of equal cost that use the same rows
neither is the beginning of the other, so the cheapest and then least strings of the pieces make up that of the whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from dripline.llm.catalog import query
from dripline.llm.common import map_batches, table, written

#: Costs of the edits.
DELETE, INSERT, REROLE, UNFINISHED = 4, 3, 3, 3
#: Rows of a piece.
PIECE = 64
#: Faults of a row; the first that fits counts.
FINE, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
#: States: nothing yet, after system, after user, after assistant. A right conversation ends in the first or last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
NAMES = {USER: b"user", ASSISTANT: b"assistant"}
_FAR = 1 << 60
_SPACE = r"\x20\x09-\x0D"


def _after(state: int, initial: str) -> int | None:
    """State after a turn with this role initial; None if it can't stand here."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def search(initials: str, faults: list[int], start: int = START, ends: tuple[int, ...] = ENDS) -> tuple[int, str, int] | None:
    """(cost, edits, last state): the cheapest edits from ``start`` to one of ``ends``, of equal ones the least string."""
    n = len(initials)
    # What every later row costs at least, whatever happens around it.
    floor = [[0] * (n + 1) for _ in range(4)]
    for state in range(4):
        for i in range(n - 1, -1, -1):
            late = UNFINISHED if faults[i] == TRUNCATED else 0
            if faults[i] in (BLANK, DUPLICATE):
                least = DELETE
            elif initials[i] in "ua" or initials[i] == "s" and state == START:
                least = late
            else:
                least = min(DELETE, REROLE + late)
            floor[state][i] = floor[state][i + 1] + least
    for state in range(4):
        for i in range(n + 1):
            opening = any(initials[k] == "s" and faults[k] in (FINE, TRUNCATED) for k in range(i, n)) if state == START else state == SYSTEM
            if not any(e in (USER, ASSISTANT) or e == START == state or e == SYSTEM and opening for e in ends):
                floor[state][i] = _FAR
    left = floor  # the table: raised where a search has failed
    bound = left[start][0]

    def edits(i: int, state: int) -> list[tuple[str, int, int, int]]:
        """(initial, cost, next row, next state) in ASCII order."""
        out = []
        if i < n:
            out.append(("D", DELETE, i + 1, state))
        turned = ASSISTANT if state == USER else USER
        out.append(("I", INSERT, i, turned))
        if i < n and faults[i] in (FINE, TRUNCATED):
            late = UNFINISHED if faults[i] == TRUNCATED else 0
            kept = _after(state, initials[i])
            if kept is not None:
                out.append(("K", late, i + 1, kept))
            out.append(("R", REROLE + late, i + 1, turned))
        return out

    while bound < _FAR:
        # Frames: row, state, cost so far, edits, next edit, least cost of the rest seen below this state.
        stack = [[0, start, 0, edits(0, start), 0, _FAR]]
        path: list[str] = []
        if n == 0 and start in ends:
            return 0, "", start
        while stack:
            frame = stack[-1]
            i, state, cost, choices, k, _ = frame
            if k == len(choices):
                stack.pop()
                left[state][i] = max(left[state][i], frame[5])
                if stack:
                    path.pop()
                    above = stack[-1]
                    step = above[3][above[4] - 1][1]
                    above[5] = min(above[5], step + left[state][i])
                continue
            frame[4] += 1
            name, price, j, then = choices[k]
            if cost + price + left[then][j] > bound:
                frame[5] = min(frame[5], price + left[then][j])
                continue
            path.append(name)
            if j == n and then in ends:
                return cost + price, "".join(path), then
            stack.append([j, then, cost + price, edits(j, then), 0, _FAR])
        bound = left[start][0]
    return None


def join_pieces(pieces: list[dict[tuple[int, int], tuple[int, str]]]) -> tuple[int, str]:
    """Cheapest and then least edits over pieces given as {(state before, state after): (cost, edits)}."""
    best = {START: (0, "")}
    for piece in pieces:
        new: dict[int, tuple[int, str]] = {}
        for (before, after), (cost, audit) in piece.items():
            if before in best:
                got = (best[before][0] + cost, best[before][1] + audit)
                new[after] = min(new.get(after, got), got)
        best = new
    return min(best[e] for e in ENDS if e in best)


def ordered(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, pos, fault): rows in the order of their conversation, with the first fault of each.

    Rows are placed by range, so a conversation of any size is spread. ``pos`` grows along a conversation: by turn,
    nulls first, then role and text. A null role or text counts as one space.
    """
    spark = rows.sparkSession
    spaced = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(a) for c, a in ((role_col, "role"), (text_col, "text"))]
    rows = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), *spaced)
    order = ["conv", "turn", "role", "text"]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("pos", F.monotonically_increasing_id()), "turns")
    said = [F.col("role"), F.md5(F.col("text").cast("binary"))]
    marked = placed.withColumn("said", F.struct(*said))
    firsts = marked.groupBy(F.col("conv").alias("c"), F.col("said").alias("s")).agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    firsts = firsts.filter("n > 1").drop("n")
    joined = marked.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    last = F.regexp_extract("text", rf"([^{_SPACE}])[{_SPACE}]*\z", 1)
    fault = (
        F.when(last == "", BLANK).when(F.col("pos") > F.col("first"), DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    )
    return written(joined.select("conv", "turn", "role", "text", "pos", fault.alias("fault")), "judged-turns")


_PIECE_FIELDS = "conv {kind}, piece long, first string, last string, illegal long, ways array<struct<before: int, after: int, cost: long, audit: string>>"


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Runs of rows with equal first ``keys`` columns of a sorted stream: (key, columns)."""
    held: list[list] | None = None
    key = None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if held is not None and row[:keys] == key:
                for c, x in zip(held, row[keys:]):
                    c.append(x)
                continue
            if held is not None:
                yield key, held
            key, held = row[:keys], [[x] for x in row[keys:]]
    if held is not None:
        yield key, held


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _piece_rows(judged: DataFrame, size: int) -> DataFrame:
    """One row per piece: its borders, its illegal neighbours, and the best edits between states."""
    spans = judged.groupBy(F.col("conv").alias("c")).agg(F.min("pos").alias("start"), F.max("pos").alias("stop"))
    rows = judged.join(spans, F.col("conv").eqNullSafe(F.col("c")))
    initial = F.substring("role", 1, 1)  # whatever else a role begins with fits nowhere
    rows = rows.select(
        "conv", F.expr(f"(pos - start) div {size}").alias("piece"), (F.expr(f"(stop - start) div {size}") == 0).alias("whole"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("?").alias("initial"), "fault", "pos",
    )
    n = int(judged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "conv", "piece").sortWithinPartitions("conv", "piece", "pos")
    schema = _PIECE_FIELDS.format(kind=dict(judged.dtypes)["conv"])

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for (conv, piece, whole), (initials, faults, _) in _groups(batches, 3):
            roles, ways = "".join(initials), []
            for before in (START,) if whole else range(4):
                for after in (ENDS,) if whole else ((s,) for s in range(4)):
                    found = search(roles, faults, before, after)
                    if found:
                        ways.append({"before": before, "after": found[2], "cost": found[0], "audit": found[1]})
            illegal = sum(not _legal(a, b) for a, b in zip(initials, initials[1:]))
            out.append({"conv": conv, "piece": piece, "first": initials[0], "last": initials[-1], "illegal": illegal, "ways": ways})
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, fields)
                out = []
        yield pa.RecordBatch.from_pylist(out, fields)

    return map_batches(rows, run, schema)


def audits(judged: DataFrame, size: int = PIECE) -> DataFrame:
    """(conv, cost, audit, illegal) of every conversation that has rows."""
    pieces = written(_piece_rows(judged, size), "pieces")
    n = int(judged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = pieces.repartition(n, "conv").sortWithinPartitions("conv", "piece")
    schema = f"conv {dict(judged.dtypes)['conv']}, cost long, audit string, illegal long"

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for (conv,), (_, first, last, illegal, ways) in _groups(batches, 1):
            tables = [{(w["before"], w["after"]): (w["cost"], w["audit"]) for w in x} for x in ways]
            cost, audit = join_pieces(tables)
            across = sum(not _legal(a, b) for a, b in zip(last, first[1:]))
            out.append({"conv": conv, "cost": cost, "audit": audit, "illegal": sum(illegal) + across})
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, fields)
                out = []
        yield pa.RecordBatch.from_pylist(out, fields)

    return map_batches(placed, run, schema)


def repaired(judged: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, step, role, text): the rows of the repaired conversations in order.

    The edits of a conversation come first in its stream, then its rows one batch at a time, so the rows of a long
    conversation are never held together.
    """
    kind = dict(judged.dtypes)["conv"]
    rows = judged.select("conv", "pos", "role", "text").unionByName(
        found.select("conv", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    )
    rows = rows.select("conv", "pos", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"))
    n = int(judged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartition(n, "conv").sortWithinPartitions("conv", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, step, conv = "", 0, START, 0, None

        def inserted(out: list) -> None:
            nonlocal at, state, step
            while at < len(audit) and audit[at] == "I":
                state = ASSISTANT if state == USER else USER
                out.append((conv, step, NAMES[state], b""))
                step += 1
                at += 1

        for batch in batches:
            out: list[tuple] = []
            for c, pos, role, text in zip(*[x.to_pylist() for x in batch.columns]):
                if pos < 0:
                    audit, at, state, step, conv = text.decode(), 0, START, 0, c
                    inserted(out)
                    continue
                edit = audit[at]
                at += 1
                if edit == "R":
                    state = ASSISTANT if state == USER else USER
                    role = NAMES[state]
                elif edit == "K":
                    state = _after(state, role[:1].decode())
                if edit != "D":
                    out.append((c, step, role, text))
                    step += 1
                inserted(out)
            columns = list(zip(*out)) if out else [[], [], [], []]
            kinds = [batch.schema.field(0).type, pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["conv", "step", "role", "text"])

    out = map_batches(placed, run, f"conv {kind}, step long, role binary, text binary")
    return out.select("conv", "step", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def digests(turns: DataFrame) -> DataFrame:
    """(conv, sha256): digest of the ``role:text`` lines of each conversation, fed row by row."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = turns.select("conv", "step", F.concat_ws(":", "role", "text").cast("binary").alias("line"))
    placed = lines.repartition(n, "conv").sortWithinPartitions("conv", "step")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, conv, state = None, None, None

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())], ["conv", "sha256"])

        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for c, step, line in zip(*[x.to_pylist() for x in batch.columns]):
                if step == 0:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line)
            yield out(done)
        if state is not None:
            yield out([(conv, state.hexdigest())])

    return map_batches(placed, run, f"conv {dict(turns.dtypes)['conv']}, sha256 string")


def repair(rows: DataFrame, size: int = PIECE, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(report, turns): one row per conversation with its faults, cost and edits, and the repaired rows.

    A null conversation id names one conversation. A null role or text is one space: such a text is blank, such a role
    fits nowhere. Rows that repeat within a conversation are duplicates; rows of one turn are ordered by role and text,
    null turns come first. Texts of any length only pass through; an empty table gives empty results.
    """
    judged = ordered(rows, **columns)
    found = written(audits(judged, size), "audits")
    turns = written(repaired(judged, found), "repaired")
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    faults = [F.count_if(F.col("fault") == k).alias(n) for n, k in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))]
    stats = judged.groupBy(F.col("conv").alias("c")).agg(gaps.alias("gaps"), *faults)
    return found.join(stats, F.col("conv").eqNullSafe(F.col("c"))).drop("c"), turns


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with the faults of the contract, chosen by a checksum of conversation and turn."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(name.cast("binary")) % 20
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies: Column = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.filter(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(copies).alias("_copy")
    )
    return rows.drop("_copy")


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    report, turns = repair(damaged(rows))
    every = rows.select("conv_id").distinct()
    shas = digests(turns).withColumnRenamed("conv", "d")
    out = every.join(report, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(shas, F.col("conv_id").eqNullSafe(F.col("d")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(empty)).alias("repaired_sha256"))
