"""Repair of the structure of conversations at the least cost.

A well-formed conversation is empty, or an optional system turn and then user and assistant turns in alternation, the last one by the assistant. Edits
make one out of any conversation: keep a turn, give it the role that is due, delete it, insert an empty one. Blank and repeated turns have
to be deleted; a truncated turn that stays costs extra.

The least cost is found in layers, one for each cost from zero. A layer has, for each turn, the set of grammar states, as bits, from which the rest of the
conversation can be accepted at that cost and not at a lower one. An edit leads to a layer of higher cost, and keeping a
turn stays in it. The first layer that holds the start gives the cost; following the bits from there, always by the edit that comes first in
ASCII, gives the least audit. A state is entered once for each turn, so work is in proportion to the turns.

Turns of a conversation are put in order by Spark, by ``turn`` (nulls first), then role and text. A task holds one conversation at a time; its audit and
repaired turns are one row of the result. Null roles and texts count as one space; a null conv_id is a conversation of its own;
repeated rows are repeated turns. A row whose ``present`` is false only names its conversation. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Grammar states: nothing yet, after the system turn, after a user turn, after an assistant turn; an end is accepted in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = 1 << START | 1 << ASSISTANT
#: State after a turn with an initial, for each state that may stand before it.
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The turn that is due in a state, if its role is free.
DUE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Conversations of one shape that a worker remembers, and letters of one that is remembered.
SHAPES, SHAPE = 20_000, 64


def _sources(steps: dict[int, int]) -> list[int]:
    """For each set of states the states from which a step leads into it."""
    return [sum(1 << a for a, b in steps.items() if bits >> b & 1) for bits in range(16)]


BEFORE_KEEP = {c: _sources(steps) for c, steps in STEPS.items()}
BEFORE_DUE = _sources(DUE)


def cost_layers(codes: str) -> list[dict[int, int]]:
    """For each cost the states, as bits, from which the turns from some place on are accepted at that cost and no lower one.

    ``codes`` has a letter for each turn: s, u, a or x (another role), in upper case if the turn is truncated, or - if it has to go. The
    last layer is the first that holds the start at place 0."""
    n = len(codes)
    settled = bytearray(n + 1)
    layers: list[dict[int, int]] = []
    open_: dict[int, dict[int, int]] = {0: {n: ACCEPTED}}
    while not settled[0] & 1 << START:
        cost = len(layers)
        due = open_.pop(cost, {})
        layer: dict[int, int] = {}
        places = sorted(due)
        while places:
            t = places.pop()
            bits = due[t] & ~settled[t]
            if not bits:
                continue
            settled[t] |= bits
            layer[t] = bits
            edits = [(INSERT, t, BEFORE_DUE[bits])]
            if t:
                code = codes[t - 1]
                edits.append((DELETE, t - 1, bits))
                if code != "-":
                    extra = TRUNCATED if code.isupper() else 0
                    edits.append((REROLE + extra, t - 1, BEFORE_DUE[bits]))
                    if code.lower() in BEFORE_KEEP:
                        edits.append((extra, t - 1, BEFORE_KEEP[code.lower()][bits]))
            for price, at, states in edits:
                if states & ~settled[at]:
                    target = due if not price else open_.setdefault(cost + price, {})
                    if not price and at not in due:
                        places.append(at)  # just before t, and so before all that wait
                    target[at] = target.get(at, 0) | states
        layers.append(layer)
    return layers


def least_edits(codes: str) -> tuple[int, str, list[tuple[int, int]]]:
    """Least cost, least audit, and the turns that it gives: the place in ``codes`` (-1 for an inserted turn) and the role's state, 0 for
    the turn's own."""
    layers = cost_layers(codes)
    left = cost = len(layers) - 1
    t, state, audit, turns = 0, START, [], []

    def holds(price: int, place: int, then: int) -> bool:
        return left >= price and bool(layers[left - price].get(place, 0) >> then & 1)

    while t < len(codes) or left or not ACCEPTED >> state & 1:
        code = codes[t] if t < len(codes) else "-"
        extra = TRUNCATED if code.isupper() else 0
        own = STEPS.get(code.lower(), {}).get(state)
        if t < len(codes) and holds(DELETE, t + 1, state):
            letter, price, then, step = "D", DELETE, state, 1
        elif holds(INSERT, t, DUE[state]):
            letter, price, then, step = "I", INSERT, DUE[state], 0
            turns.append((-1, then))
        elif own is not None and holds(extra, t + 1, own):
            letter, price, then, step = "K", extra, own, 1
            turns.append((t, 0))
        else:
            letter, price, then, step = "R", REROLE + extra, DUE[state], 1
            turns.append((t, then))
        audit.append(letter)
        t, state, left = t + step, then, left - price
    return cost, "".join(audit), turns


_remembered = lru_cache(SHAPES)(least_edits)


def judged(turns: list[tuple[int | None, str, str, bool, bool]]) -> dict:
    """Faults, edits and repaired turns of a conversation; a turn has its number, role, text, and whether it is blank and ends a sentence."""
    seen: set[tuple[str, str]] = set()
    codes, faults = [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text, blank, ended in turns:
        first = role[:1] if role[:1] in STEPS else "x"
        fault = "blank" if blank else "duplicate" if (role, text) in seen else "" if ended else "truncated"
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        codes.append("-" if fault in ("blank", "duplicate") else first.upper() if fault else first)
    numbers = [n for n, *_ in turns if n is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [t[1][:1] for t in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cost, audit, plan = (_remembered if len(codes) <= SHAPE else least_edits)("".join(codes))
    repaired = [{"role": NAMES.get(state) or turns[i][1], "text": turns[i][2] if i >= 0 else ""} for i, state in plan]
    return {"gaps": gaps, **faults, "illegal": illegal, "cost": cost, "audit": audit, "repaired": repaired}


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired array<struct<role:string,text:string>>"


def repair_conversations(turns: DataFrame) -> DataFrame:
    """One row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit and the repaired turns."""
    bound_batches(turns.sparkSession)
    text = F.coalesce("text", F.lit(" "))
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        text.rlike(r"[.!?][\x20\x09-\x0D]*\z").alias("ended"), (F.col("present") if "present" in turns.columns else F.lit(True)).alias("present"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    schema = rows.select("conv_id").schema
    for field in spark_fields(RESULT):
        schema = schema.add(field)
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def batch_of(ids: list[pa.Scalar], found: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array([x.as_py() for x in ids], id_type)]
        for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"):
            columns.append(pa.array([f[name] for f in found], pa.int64()))
        columns += [pa.array([f["audit"] for f in found], pa.string()), pa.array([f["repaired"] for f in found], kind)]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        id_type = None
        for batch in batches:
            ids, found = [], []
            id_type = batch.column(0).type
            others = [batch.column(k).to_pylist() for k in range(1, 7)]
            for name, *turn, present in zip(batch.column(0), *others, strict=True):
                if now is not None and (now.is_valid != name.is_valid or now.is_valid and now != name):
                    ids.append(now)
                    found.append(judged(held))
                    held = []
                now = name
                if present:
                    held.append(tuple(turn))
            if ids:
                yield batch_of(ids, found, id_type)
        if now is not None:
            yield batch_of([now], [judged(held)], id_type)

    return rows.mapInArrow(run, schema)


def spark_fields(ddl: str) -> list:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).fields


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` with faults by a hash of ``conv_id:turn``: rows that it drops have ``present`` false."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), (F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20).alias("_h"))
    text = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    changed = rows.withColumns({"text": text, "role": F.when(F.col("_h") == 4, "user").otherwise(F.col("role")), "present": F.col("_h") != 0})
    return changed.withColumn("_again", F.explode(F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_h", "_again")


def op13_conversation_repair(turns: DataFrame) -> DataFrame:
    repaired = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return repair_conversations(damaged(turns)).withColumn("repaired_sha256", F.sha2(repaired, 256)).drop("repaired")
