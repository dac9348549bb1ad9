"""Repair of the turn structure of conversations as a lightest derivation.

Rows in order are the input of a grammar of roles: at most one system row, then user and assistant in turn, the
last an assistant. An item (rows used, grammar state) is deduced from another by an edit: Keep, Rerole or Delete uses
a row, Insert adds one. Its weight is (cost, audit), the audit being the edits' initials; items leave an agenda in the
order of weights until the goal item is final. Equal costs over the same rows never give audits of which one begins
the other (an insertion costs), so an edit never turns the order of two weights, and the weights are superior.

A conversation can be of any length. Rows are sorted over all tasks, cut into segments of bounded size, and each
segment gives the lightest derivation from every grammar state to every other; segments are then joined by the same
agenda, with the next segment's derivations as axioms. A conversation whole inside a task is one segment.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.agenda import lightest
from shelfsight.workspace import written

#: Grammar states by the last role given: none, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
ENDS = (START, ASSISTANT)
#: The state after a row of a role's initial.
AFTER = {
    START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER},
}
#: The role that Rerole and Insert give in a state.
GIVEN = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
LEGAL = ("su", "ua", "au")
SPACE = r"\x20\x09-\x0D"
#: Faults of a row, the first that counts.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)


@dataclass(frozen=True)
class EditCosts:
    """``segment`` rows are derived together, ``join`` segments are joined together."""

    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1
    segment: int = 256
    join: int = 16


def derive(
    initials: list[str], faults: list[int], entries: tuple[int, ...], costs: EditCosts
) -> dict[tuple[int, int], tuple[int, str]]:
    """(entry state, exit state): (cost, audit) of the lightest edits of rows given by role initial and fault. From
    START alone the rows are a whole conversation: the goal is the lightest of the exits that end one."""
    n, whole = len(initials), entries == (START,)
    out = {}

    def conclusions(item, weight):
        (at, state), (cost, audit) = item, weight
        if at > n:
            return
        given = AFTER[state][GIVEN[state][0]]
        yield (at, given), (cost + costs.insert, audit + "I")
        if at == n:
            if whole and state in ENDS:
                yield (n + 1, state), weight
            return
        yield (at + 1, state), (cost + costs.delete, audit + "D")
        fault = faults[at]
        if fault in (BLANK, DUPLICATE):
            return
        cost += costs.truncated * (fault == TRUNCATED)
        kept = AFTER[state].get(initials[at])
        if kept is not None:
            yield (at + 1, kept), (cost, audit + "K")
        yield (at + 1, given), (cost + costs.rerole, audit + "R")

    for entry in entries:
        end = n + whole
        final = lightest([((0, entry), (0, ""))], conclusions, [{(end, q)} for q in ENDS] if whole else [{(end, q) for q in STATES}])
        out |= {(entry, q): final[end, q] for q in STATES if (end, q) in final}
    return out


def joined(parts: list[dict], entries: tuple[int, ...] = STATES) -> dict[tuple[int, int], tuple[int, str]]:
    """The same for consecutive segments, from those of each: a prefix and a segment's derivation give a prefix."""
    out = {}

    def conclusions(item, weight):
        at, state = item
        if at < len(parts):
            for q in STATES:
                if (state, q) in parts[at]:
                    cost, audit = parts[at][state, q]
                    yield (at + 1, q), (weight[0] + cost, weight[1] + audit)

    for entry in entries:
        final = lightest([((0, entry), (0, ""))], conclusions, [{(len(parts), q) for q in STATES}])
        out |= {(entry, q): final[len(parts), q] for q in STATES if (len(parts), q) in final}
    return out


class Joiner:
    """Segments of one conversation joined in groups of ``width``, groups likewise: the text of an audit is copied as
    often as there are levels."""

    def __init__(self, width: int):
        self.width, self.levels = width, [[]]

    def add(self, part: dict, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(part)
        if len(self.levels[level]) == self.width:
            whole = joined(self.levels[level])
            self.levels[level] = []
            self.add(whole, level + 1)

    def best(self) -> tuple[int, str]:
        rest = [part for level in reversed(self.levels) for part in level]
        whole = joined(rest, (START,))
        return min(whole[START, q] for q in ENDS if (START, q) in whole)


_STEP = re.compile(r"(I*)([KRD])")


def edits(audit: str, initials: list[str]) -> Iterator[tuple[list[str], str, str | None, list[str]]]:
    """For every row: roles inserted before it, edit, new role of a Rerole, and roles inserted after it (at the end)."""
    state, end = START, 0
    steps = list(_STEP.finditer(audit))

    def insert(times: int) -> list[str]:
        nonlocal state
        roles = []
        for _ in range(times):
            roles.append(GIVEN[state])
            state = AFTER[state][roles[-1][0]]
        return roles

    for k, (step, initial) in enumerate(zip(steps, initials, strict=True)):
        before, role = insert(len(step[1])), None
        if step[2] == "R":
            role = GIVEN[state]
            state = AFTER[state][role[0]]
        elif step[2] == "K":
            state = AFTER[state][initial]
        end = step.end()
        after = insert(len(audit) - end) if k == len(steps) - 1 else []
        yield before, step[2], role, after


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (key, conv_id, turn, role, text) with the stated damage by crc32 of "conv_id:turn" (nulls read as one
    space), and ``copy`` 1 on the repetition of a row."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (
        rows.withColumns({"role": F.coalesce("role", space), "text": F.coalesce("text", space), "kind": F.crc32(name.cast("binary")) % 20})
        .where("kind != 0")
        .withColumns({"was_role": F.col("role"), "was_text": F.col("text")})
        .withColumns({"text": text, "role": F.when(kind == 4, "user").otherwise(F.col("role"))})
        .withColumn("copy", F.explode(F.expr("CASE WHEN kind = 3 THEN array(0, 1) ELSE array(0) END")))
        .drop("kind")
    )


def _segments(costs: EditCosts):
    """Sorted rows (key, pos, initial, fault) of a task to segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, cut, out = None, ([], [], []), True, []

        def close(whole: bool) -> None:
            at, initials, faults = rows
            found = derive(initials, faults, (START,) if whole else STATES, costs)
            out.append(
                (
                    key, at[0], at, initials, [p * 4 + q for p, q in found], [c for c, _ in found.values()],
                    [a for _, a in found.values()],
                    [faults.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)],
                    sum(x + y not in LEGAL for x, y in zip(initials, initials[1:])),
                )
            )

        def flush() -> pa.RecordBatch:
            columns = [pa.array(list(x), t) for x, t in zip(zip(*out), _SEGMENT_TYPES)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, _SEGMENT_NAMES)

        for batch in batches:
            for name, pos, initial, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if name != key:
                    if rows[0]:
                        close(not cut)
                    # A conversation that begins a task may have begun in the one before.
                    cut = key is None
                    key, rows = name, ([], [], [])
                elif len(rows[0]) == costs.segment:
                    cut = True
                    close(False)
                    rows = ([], [], [])
                for column, value in zip(rows, (pos, initial, fault)):
                    column.append(value)
            if len(out) >= 256:
                yield flush()
        if rows[0]:
            close(False)
        if out:
            yield flush()

    return run


_SEGMENT_NAMES = ["key", "pos", "places", "initials", "ends", "costs", "audits", "faults", "illegal"]
_SEGMENT_TYPES = [
    pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()),
    pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(),
]
_SEGMENTS = (
    "key string, pos long, places array<long>, initials array<string>, ends array<int>, costs array<long>, "
    "audits array<string>, faults array<long>, illegal long"
)
_EDITS = (
    "key string, pos long, before array<string>, edit string, role string, after array<string>, cost long, "
    "audit string, blank long, duplicate long, truncated long, illegal long"
)
_EDIT_TYPES = [
    pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(),
    pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
]


def _resolved(costs: EditCosts):
    """Sorted segments of whole conversations to one row per row, and one without an edit per conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in _EDITS.split(", ")]
        out = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(list(x), t) for x, t in zip(zip(*out), _EDIT_TYPES)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        def close(key, joiner, places, initials, faults, illegal):
            cost, audit = joiner.best()
            out.append((key, places[0], None, None, None, None, cost, audit, *faults, illegal))
            for place, (before, edit, role, after) in zip(places, edits(audit, initials)):
                out.append((key, place, before, edit, role, after, *(None,) * 6))
                if len(out) >= 4096:
                    yield flush()

        key, state = None, None
        for batch in batches:
            for row in batch.to_pylist():
                part = {(e // 4, e % 4): (c, a) for e, c, a in zip(row["ends"], row["costs"], row["audits"])}
                if state is None or row["key"] != key:
                    if state is not None:
                        yield from close(key, *state)
                    key, state = row["key"], (Joiner(costs.join), row["places"], row["initials"], row["faults"], row["illegal"])
                    state[0].add(part)
                else:
                    joiner, places, initials, faults, illegal = state
                    joiner.add(part)
                    illegal += row["illegal"] + (initials[-1] + row["initials"][0] not in LEGAL)
                    faults = [x + y for x, y in zip(faults, row["faults"])]
                    places.extend(row["places"])
                    initials.extend(row["initials"])
                    state = joiner, places, initials, faults, illegal
        if state is not None:
            yield from close(key, *state)
        if out:
            yield flush()

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of the sorted pieces of each conversation, joined by newlines, one piece in memory at a time."""
    key, state, done = None, None, ([], [])

    def close() -> None:
        done[0].append(key)
        done[1].append(state.hexdigest())

    for batch in batches:
        for name, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if state is None or name != key:
                if state is not None:
                    close()
                key, state = name, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in done], ["key", "sha"])
        done = ([], [])
    if state is not None:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in done], ["key", "sha"])


def repaired_rows(conversations: DataFrame, costs: EditCosts = EditCosts()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows after damage with their place ``pos``, the edit of each, and the repaired pieces of each (role:text, several
    joined by newlines), all with ``key``, the conversation's id as text."""
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    given = conversations.select("conv_id", "turn", "role", "text").withColumn("key", key)
    order = ["key", F.col("turn").asc_nulls_first(), "was_role", "was_text", "copy"]
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    # The beginnings of texts are enough to deal the rows out; whole ones would be sampled to the driver.
    dealt = damaged(given).withColumn("begin", F.substring("was_text", 1, 32)).repartitionByRange(*order[:3], "begin")
    sorted_rows = dealt.sortWithinPartitions(*order)
    rows = written(
        sorted_rows.select(
            "key", "turn", "role", "text", F.monotonically_increasing_id().alias("pos"),
            F.sha2(F.concat("role", F.lit("\0"), "text"), 256).alias("digest"), F.substring("role", 1, 1).alias("initial"),
            F.when(blank, BLANK).when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), TRUNCATED).otherwise(SOUND).alias("fault"),
        ),
        "damaged",
    )
    first = rows.groupBy("key", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when((F.col("fault") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    light = (
        rows.select("key", "pos", "initial", "fault").join(first, "pos", "left")
        .select("key", "pos", "initial", fault.alias("fault"))
        .repartitionByRange("pos").sortWithinPartitions("pos")
    )
    segments = light.mapInArrow(_segments(costs), _SEGMENTS)
    decided = written(
        segments.repartition("key").sortWithinPartitions("key", "pos").mapInArrow(_resolved(costs), _EDITS), "edits"
    )
    edit = decided.where("edit IS NOT NULL").select("pos", "before", "edit", F.col("role").alias("new_role"), "after")
    own = F.when(F.col("edit") != "D", F.concat(F.coalesce("new_role", "role"), F.lit(":"), "text"))
    lines = [F.transform(c, lambda r: F.concat(r, F.lit(":"))) for c in ("before", "after")]
    pieces = (
        rows.join(edit, "pos")
        .select("key", "pos", F.array_compact(F.concat(lines[0], F.array(own), lines[1])).alias("lines"))
        .where("size(lines) > 0").select("key", "pos", F.array_join("lines", "\n").alias("piece"))
    )
    return rows, decided, pieces


def repaired_conversations(conversations: DataFrame, costs: EditCosts = EditCosts()) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation of
    ``conversations`` (conv_id, turn, role, text; other columns are not read), after the stated damage.

    A null turn comes first and is no turn for ``gaps``; a null role or text is one space; a null conv_id is a
    conversation of its own. Rows of one turn are in order of role and text as given. Repeated rows are duplicates. A
    role without characters has no initial, so its row is never kept as it is. An empty or blank text must go.
    Conversations without rows after damage have zeros, an empty audit and the hash of nothing. No rows give no rows.
    The hash of a conversation is taken in one task, as such a hash can only be, one row in memory at a time.
    """
    rows, decided, pieces = repaired_rows(conversations, costs)
    turns = rows.where("turn IS NOT NULL").groupBy("key", "turn").count()
    gaps = turns.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    hashes = pieces.repartition("key").sortWithinPartitions("key", "pos").select("key", "piece").mapInArrow(
        _hashed, "key string, sha string"
    )
    zero = F.lit(0)
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    return (
        conversations.select("conv_id").distinct().withColumn("key", key)
        .join(decided.where("edit IS NULL").drop("pos", "before", "edit", "role", "after"), "key", "left")
        .join(gaps, "key", "left").join(hashes, "key", "left")
        .select(
            "conv_id", *(F.coalesce(c, zero).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
        )
    )
