"""Repair of damaged conversations by Hirschberg's divide and conquer.

The roles kept must read `(s?(ua)+)?`, which a machine of four states accepts: at the start, after the system's turn, after
the user's, after the assistant's. A row is consumed by an edit, K (keep), R (another role) or D (delete), with inserted
turns (I) before it; so between two rows there are four states, and a stretch of rows is a table of costs from four states
to four. For a stretch with a given first and last state, forward costs of its first half and backward costs of its second
meet in the middle; the cheapest crossing is taken and the halves are solved alike, so a reconstruction holds two vectors
of four costs and never a table over all rows.

Ties: a stretch's audit ends where a row is consumed, so no audit of the same rows is the beginning of another one.
Hence of the cheapest crossings the one with the ASCII-least audit before it begins the ASCII-least audit, whatever follows.
Forward vectors carry the order of their four audits, not the audits.

Rows are sorted by ranges over the whole table, so a conversation may span many tasks. Those that lie within one task are
repaired there. The others, the first and the last of a task, are repaired by stretches: each stretch gives its four-by-four
table, the tables of a conversation (one a task) give the crossings between its stretches, and each stretch is reconstructed
between its crossings.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histoframe.scratch import Scratch

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
FAR = 1 << 60  # no way
INSERTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
TAKES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
FINE, CUT, GONE = range(3)  # a row's faults: none, truncated, blank or duplicate
SPACE = " \t\n\v\f\r"
LEGAL = {"su", "ua", "au"}


def _steps(initial: str, fault: int) -> dict[tuple[int, int], tuple[int, str]]:
    """For a row: (state before, state after) to the least cost and the ASCII-least edits of that cost."""
    found: dict[tuple[int, int], tuple[int, str]] = {}
    for before in STATES:
        state, cost, edits = before, 0, ""
        for _ in range(3):  # a third insertion comes back to a state that was there before
            ways = [(state, 4, "D")]
            if fault != GONE:
                extra = 3 * (fault == CUT)
                ways.append((INSERTED[state], 3 + extra, "R"))
                if (state, initial) in TAKES:
                    ways.append((TAKES[state, initial], extra, "K"))
            for after, own, letter in ways:
                new = (cost + own, edits + letter)
                found[before, after] = min(new, found.get((before, after), new))
            state, cost, edits = INSERTED[state], cost + 3, edits + "I"
    return found


#: Rows are told apart by their initial (s, u, a, another) and fault.
STEPS = {(initial, fault): _steps(initial, fault) for initial in ("s", "u", "a", "") for fault in (FINE, CUT, GONE)}
#: What follows the last row: cost and edits, by state.
ENDS = {START: (0, ""), SYSTEM: (6, "II"), USER: (3, "I"), ASSISTANT: (0, "")}

Vector = tuple[tuple[int, ...], tuple[int, ...]]


@functools.lru_cache(maxsize=65536)
def _forward_step(vector: Vector, kind: tuple[str, int]) -> tuple[Vector, int]:
    """Costs and order of audits after one more row; costs less their least, which is given too."""
    costs, order = vector
    best: list[tuple[int, tuple[int, str]]] = [(FAR, (0, ""))] * 4
    for (before, after), (cost, edits) in STEPS[kind].items():
        if costs[before] < FAR:
            best[after] = min(best[after], (costs[before] + cost, (order[before], edits)))
    least = min(c for c, _ in best)
    ranks = {x: n for n, x in enumerate(sorted({o for c, o in best if c < FAR}))}
    return (tuple(c - least if c < FAR else FAR for c, _ in best), tuple(ranks.get(o, 0) if c < FAR else 0 for c, o in best)), least


@functools.lru_cache(maxsize=65536)
def _backward_step(costs: tuple[int, ...], kind: tuple[str, int]) -> tuple[int, ...]:
    best = [FAR] * 4
    for (before, after), (cost, _) in STEPS[kind].items():
        if costs[after] < FAR:
            best[before] = min(best[before], cost + costs[after])
    least = min(best)
    return tuple(c - least if c < FAR else FAR for c in best)


def forward(kinds: list, lo: int, hi: int, before: int) -> tuple[Vector, int]:
    """From one state over rows lo to hi: costs less their least, the order of the audits, and the least cost."""
    vector, total = (tuple(0 if s == before else FAR for s in STATES), (0, 0, 0, 0)), 0
    for k in range(lo, hi):
        vector, least = _forward_step(vector, kinds[k])
        total += least
    return vector, total


def reconstruct(kinds: list, before: int, after: int) -> str:
    """The ASCII-least audit of least cost over all rows from one state to another."""
    out: list[str] = []
    stack = [(0, len(kinds), before, after)] if kinds else []
    while stack:
        lo, hi, p, q = stack.pop()
        if hi - lo == 1:
            out.append(STEPS[kinds[lo]][p, q][1])
            continue
        middle = (lo + hi) // 2
        (costs, order), _ = forward(kinds, lo, middle, p)
        rest = tuple(0 if s == q else FAR for s in STATES)
        for k in range(hi - 1, middle - 1, -1):
            rest = _backward_step(rest, kinds[k])
        crossing = min((costs[s] + rest[s], order[s], s) for s in STATES)[2]
        stack += [(middle, hi, crossing, q), (lo, middle, p, crossing)]
    return "".join(out)


def kind_of(role: str, text: str, seen_before: bool) -> tuple[tuple[str, int], str]:
    """A row's kind, and its first fault: blank, duplicate, truncated or none."""
    shown = text.rstrip(SPACE)
    fault = "blank" if not shown else "duplicate" if seen_before else "" if shown[-1] in ".!?" else "truncated"
    initial = role[:1] if role[:1] in ("s", "u", "a") else ""
    return (initial, CUT if fault == "truncated" else GONE if fault else FINE), fault


def edited(audit: str, roles: list[str], texts: list[str], state: int = START) -> list[list[str]]:
    """The lines `role:text` that each row's edits leave, and a last list for what follows the rows."""
    out: list[list[str]] = [[]]
    k = 0
    for letter in audit:
        if letter == "I":
            state = INSERTED[state]
            out[-1].append(f"{NAMES[state]}:")
            continue
        if letter == "K":
            state = TAKES[state, roles[k][:1]]
            out[-1].append(f"{roles[k]}:{texts[k]}")
        elif letter == "R":
            state = INSERTED[state]
            out[-1].append(f"{NAMES[state]}:{texts[k]}")
        out.append([])
        k += 1
    return out


def cost_of(audit: str, kinds: list) -> int:
    rows = iter(kinds)
    total = 0
    for letter in audit:
        fault = FINE if letter == "I" else next(rows)[1]
        total += {"K": 0, "R": 3, "D": 4, "I": 3}[letter] + (3 if fault == CUT and letter != "D" else 0)
    return total


def repair(roles: list[str], texts: list[str], digests: list[bytes]) -> dict:
    """The repair of one conversation, its rows in order."""
    seen: set[bytes] = set()
    kinds, faults = [], []
    for role, text, digest in zip(roles, texts, digests, strict=True):
        kind, fault = kind_of(role, text, digest in seen)
        seen.add(digest)
        kinds.append(kind)
        faults.append(fault)
    (costs, order), _ = forward(kinds, 0, len(kinds), START)
    last = min((costs[s] + ENDS[s][0], order[s], s) for s in STATES)[2]
    audit = reconstruct(kinds, START, last) + ENDS[last][1]
    lines = [line for some in edited(audit, roles, texts) for line in some]
    initials = [r[:1] for r in roles]
    return {
        "blank": faults.count("blank"),
        "duplicate": faults.count("duplicate"),
        "truncated": faults.count("truncated"),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        "cost": cost_of(audit, kinds),
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest(),
    }


def gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
OPEN = "turn long, role string, text string, digest binary, part int, pos long"


def _whole_or_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's sorted rows: conversations repaired, but for the first and the last one, whose rows are given on."""
    part = TaskContext.get().partitionId()
    more = [x.split()[0] for x in OPEN.split(", ")]
    schema = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in FACTS), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("digest", pa.binary()), ("part", pa.int32()), ("pos", pa.int64())])
    held: list[tuple] = []  # rows of the conversation at hand
    first, at = True, 0

    def opened(rows: list[tuple]) -> list[dict]:
        nonlocal at
        at += len(rows)
        return [dict(zip(["conv_id", *more], (*row, part, at - len(rows) + k), strict=True)) for k, row in enumerate(rows)]

    for batch in batches:
        out: list[dict] = []
        for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if held and row[0] != held[0][0]:
                if first:
                    out += opened(held)
                else:
                    _, turns, roles, texts, digests = zip(*held, strict=True)
                    out.append({"conv_id": held[0][0], "gaps": gaps(turns)} | repair(roles, texts, digests))
                held, first = [], False
            held.append(row)
        if first and held:  # given on at once, but for one row that says which conversation it is
            out += opened(held[:-1])
            held = held[-1:]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if held:
        yield pa.RecordBatch.from_pylist(opened(held), schema)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """The rows of each (conv_id, part), which come sorted."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["conv_id"], row["part"]) != (held[0]["conv_id"], held[0]["part"]):
                yield (held[0]["conv_id"], held[0]["part"]), held
                held = []
            held.append(row)
    if held:
        yield (held[0]["conv_id"], held[0]["part"]), held


TABLE = "conv_id long, part int, blank long, duplicate long, truncated long, illegal long, head string, tail string, costs array<long>, orders array<int>"
CROSSINGS = "conv_id long, part int, before int, after int, ends boolean, blank long, duplicate long, truncated long, illegal long, cost long"


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stretch's counts, and its costs and orders of audits from four states to four."""
    for (conv_id, part), rows in _stretches(batches):
        kinds, faults = zip(*(kind_of(r["role"], r["text"], r["again"]) for r in rows), strict=True)
        initials = [r["role"][:1] for r in rows]
        costs, orders = [], []
        for before in STATES:
            (some, order), least = forward(kinds, 0, len(kinds), before)
            costs += [c + least if c < FAR else FAR for c in some]
            orders += order
        row = {"conv_id": conv_id, "part": part} | {f: faults.count(f) for f in ("blank", "duplicate", "truncated")}
        row |= {"illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "head": initials[0], "tail": initials[-1], "costs": costs, "orders": orders}
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), *((n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal")), ("head", pa.string()), ("tail", pa.string()), ("costs", pa.list_(pa.int64())), ("orders", pa.list_(pa.int32()))])
        yield pa.RecordBatch.from_pylist([row], schema)


def _crossings(rows: pd.DataFrame) -> pd.DataFrame:
    """The states between the stretches of one conversation, at most one row a task of the sort."""
    rows = rows.sort_values("part")
    costs, order, came = [0, FAR, FAR, FAR], [0, 0, 0, 0], []
    for table, ranks in zip(rows["costs"], rows["orders"], strict=True):
        best = [min((costs[p] + int(table[4 * p + q]), order[p], int(ranks[4 * p + q]), p) if max(costs[p], table[4 * p + q]) < FAR else (FAR, 0, 0, p) for p in STATES) for q in STATES]
        places = {x: n for n, x in enumerate(sorted({b[1:3] for b in best if b[0] < FAR}))}
        costs, order = [b[0] for b in best], [places.get(b[1:3], 0) for b in best]
        came.append([b[3] for b in best])
    total, _, state = min((costs[s] + ENDS[s][0], order[s], s) for s in STATES if costs[s] < FAR)
    between = [state]
    for back in reversed(came):
        between.append(back[between[-1]])
    between = between[::-1]
    pairs = zip(rows["tail"][:-1], rows["head"][1:], strict=True)
    out = rows[["conv_id", "part"]].assign(before=between[:-1], after=between[1:], ends=False)
    out.loc[out.index[-1], "ends"] = True
    facts = {f: rows[f].sum() for f in ("blank", "duplicate", "truncated")} | {"illegal": rows["illegal"].sum() + sum(a + b not in LEGAL for a, b in pairs), "cost": total}
    return out.assign(**facts)


PIECES = "conv_id long, part int, pos long, edits string, lines string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's edits and the lines that they leave; what follows the last row goes with it."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("pos", pa.int64()), ("edits", pa.string()), ("lines", pa.string())])
    for (conv_id, part), rows in _stretches(batches):
        kinds = [kind_of(r["role"], r["text"], r["again"])[0] for r in rows]
        audit = reconstruct(kinds, rows[0]["before"], rows[0]["after"]) + (ENDS[rows[0]["after"]][1] if rows[0]["ends"] else "")
        lines = edited(audit, [r["role"] for r in rows], [r["text"] for r in rows], rows[0]["before"])
        edits, at = [], 0
        for _ in rows:
            end = at
            while audit[end] == "I":
                end += 1
            edits.append(audit[at : end + 1])
            at = end + 1
        edits[-1] += audit[at:]
        rest = lines.pop()
        lines[-1] += rest
        out = [{"conv_id": conv_id, "part": part, "pos": r["pos"], "edits": e, "lines": "\n".join(x) if x else None} for r, e, x in zip(rows, edits, lines, strict=True)]
        yield pa.RecordBatch.from_pylist(out, schema)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's audit and the digest of its lines, its rows one after the other."""
    names = ["conv_id", "audit", "repaired_sha256"]
    now, audit, digest, some = None, [], hashlib.sha256(), False

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], names)

    for batch in batches:
        for conv_id, edits, lines in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4)), strict=True):
            if now is not None and now[0] != conv_id:
                yield row()
                audit, digest, some = [], hashlib.sha256(), False
            now = (conv_id,)
            audit.append(edits)
            if lines is not None:
                digest.update(("\n" * some + lines).encode("utf-8", "surrogatepass"))
                some = True
    if now is not None:
        yield row()


def damage_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after planned damage, by crc32 of `conv_id:turn` modulo 20.

    0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the
    user's. A null id, turn, role or text counts as one space, in the crc32 too; ids and turns stay null.
    """
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(F.concat_ws(":", *name)) % 20).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("fate <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row a conversation: its faults, the least cost of its repair, the audit of edits, and the repaired text's digest.

    Rows are taken by turn, nulls first; those of one turn by a digest of role and text, so equal rows are adjacent and all
    but the first are duplicates. Null roles and texts count as one space, which is blank. Rows without a conv_id are one
    conversation. A role is told by its first letter, s, u or a; every other has to go or be changed. An empty table gives
    no rows. Extra columns are dropped, whatever their names. Rows that share conv_id and turn, repeated ones too, all count.

    The audit and the digest of a conversation are one value each: for a conversation that spans tasks, its rows pass one
    task for them, one at a time.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark, "conversations")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256)))
    order = ["conv_id", "turn", "digest"]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    first = scratch.table(rows.mapInArrow(_whole_or_open, f"{REPORT}, {OPEN}"), "first")
    whole = first.where("part is null").select("conv_id", *FACTS, "audit", "repaired_sha256")
    rows = first.where("part is not null").select("conv_id", *(x.split()[0] for x in OPEN.split(", ")))

    same = rows.groupBy("conv_id", "digest").agg(F.min(F.struct("part", "pos")).alias("one"), F.count("*").alias("times")).where("times > 1").toDF("conv", "same", "one", "times")
    again = F.coalesce(F.struct("part", "pos") > F.col("one"), F.lit(False)).alias("again")
    rows = scratch.table(rows.join(same, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("digest") == F.col("same")), "left").select("conv_id", "part", "pos", "turn", "role", "text", again), "open")
    place = ["conv_id", "part"]
    tables = rows.repartition(parts, *place).sortWithinPartitions(*place, "pos").mapInArrow(_tables, TABLE)
    crossings = scratch.table(tables.groupBy("conv_id").applyInPandas(_crossings, CROSSINGS), "crossings")

    turns = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    facts = crossings.where("ends").select("conv_id", *FACTS[1:]).withColumnRenamed("conv_id", "conv")
    facts = facts.join(turns, F.col("conv").eqNullSafe(F.col("conv_id"))).select("conv", *FACTS)
    between = crossings.select(F.col("conv_id").alias("conv"), F.col("part").alias("own"), "before", "after", "ends")
    rows = rows.join(between, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("part") == F.col("own"))).select("conv_id", "part", "pos", "role", "text", "again", "before", "after", "ends")
    pieces = rows.repartition(parts, *place).sortWithinPartitions(*place, "pos").mapInArrow(_pieces, PIECES)
    told = pieces.repartition(parts, "conv_id").sortWithinPartitions(*place, "pos").mapInArrow(_told, "conv_id long, audit string, repaired_sha256 string")
    spanning = told.join(facts, F.col("conv_id").eqNullSafe(F.col("conv"))).select("conv_id", *FACTS, "audit", "repaired_sha256")
    return whole.unionByName(spanning)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The repair of every conversation after planned damage; one that the damage leaves no rows has zeros and an empty audit."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv")).distinct()
    found = repair_conversations(damage_conversations(conversations))
    both = ids.join(found, F.col("conv").eqNullSafe(F.col("conv_id")), "left")
    return both.select(F.col("conv").alias("conv_id"), *(F.coalesce(f, F.lit(0).cast("long")).alias(f) for f in FACTS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
