"""Repair of conversations against plain recounts and exhaustive search."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from shelfsight.llm.conversations import (
    BLANK, DUPLICATE, ENDS, SOUND, START, STATES, TRUNCATED, EditCosts, Joiner, derive, edits, repaired_conversations,
)

NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def exhaustive(initials, faults, most_inserts=2):
    """Cheapest (cost, audit) of all edit sequences with up to ``most_inserts`` insertions in each gap."""
    best = None
    gaps = itertools.product(range(most_inserts + 1), repeat=len(initials) + 1)
    for inserts, kinds in itertools.product(list(gaps), itertools.product("DKR", repeat=len(initials))):
        audit = "".join("I" * k + kind for k, kind in zip(inserts, kinds)) + "I" * inserts[-1]
        cost = 2 * sum(inserts)
        choices = [["u", "a"]] * inserts[0]
        for k, kind, initial, fault in zip(inserts[1:], kinds, initials, faults):
            cost += {"D": 3, "K": 0, "R": 2}[kind] + (fault == TRUNCATED and kind != "D")
            if kind != "D" and fault in (BLANK, DUPLICATE):
                break
            choices += [] if kind == "D" else [[initial]] if kind == "K" else [["u", "a"]]
            choices += [["u", "a"]] * k
        else:
            legal = any(re.fullmatch(r"(s?(ua)+)?", "".join(x)) for x in itertools.product(*choices) if all(x))
            if legal and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def test_agenda_against_every_edit_sequence():
    rng = random.Random(1)
    cases = [([i], [f]) for i in "suat" for f in (SOUND, BLANK, DUPLICATE, TRUNCATED)] + [([""], [SOUND])]
    cases += [
        ([rng.choice("suatu") for _ in range(n)], [rng.choice([SOUND, SOUND, BLANK, DUPLICATE, TRUNCATED]) for _ in range(n)])
        for n in (2, 2, 2, 2, 3, 3, 3, 3) for _ in range(6)
    ]
    for initials, faults in cases:
        found = derive(initials, faults, (START,), EditCosts())
        assert min(found.values()) == exhaustive(initials, faults), (initials, faults)


@pytest.mark.parametrize("width", [2, 3, 16])
def test_segments_join_to_the_whole(width):
    rng = random.Random(width)
    for _ in range(60):
        n = rng.randrange(1, 40)
        initials = [rng.choice("suat") for _ in range(n)]
        faults = [rng.choice([SOUND, SOUND, BLANK, TRUNCATED]) for _ in range(n)]
        joiner, at = Joiner(width), 0
        while at < n:
            step = rng.randrange(1, 6)
            joiner.add(derive(initials[at : at + step], faults[at : at + step], STATES, EditCosts()))
            at += step
        assert joiner.best() == min(derive(initials, faults, (START,), EditCosts()).values())


def test_edits_give_the_roles_of_the_grammar():
    assert list(edits("IKDRI", ["a", "u", "u"])) == [
        (["user"], "K", None, []), ([], "D", None, []), ([], "R", "user", ["assistant"]),
    ]


def recount(rows) -> list[tuple]:
    conversations = defaultdict(list)
    for conv, turn, role, text in rows:
        given = conversations[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        place = (turn is not None, turn or 0), (role, text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        given += [(place, copy, turn, role, text) for copy in range((kind != 0) + (kind == 3))]
    out = []
    for conv, given in conversations.items():
        given.sort(key=lambda r: r[:2])
        seen, faults, counts = set(), [], [0, 0, 0]
        for *_, role, text in given:
            core = re.sub("[\x20\x09-\x0d]", "", text)
            fault = BLANK if not core else DUPLICATE if (role, text) in seen else TRUNCATED if core[-1] not in ".!?" else SOUND
            seen.add((role, text))
            faults.append(fault)
            if fault != SOUND:
                counts[(BLANK, DUPLICATE, TRUNCATED).index(fault)] += 1
        initials = [r[3][:1] for r in given]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        turns = [r[2] for r in given if r[2] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, lines = plain_repair(given, initials, faults)
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def plain_repair(given, initials, faults) -> tuple:
    """Row by row, the best of every last role with all its lines."""

    def inserted(best):
        best = dict(best)
        for _ in range(4):
            for last, (cost, audit, lines) in list(best.items()):
                for role in NEXT[last].replace("s", ""):
                    value = cost + 2, audit + "I", (*lines, NAMES[role] + ":")
                    best[role] = min(best.get(role, value), value, key=lambda v: v[:2])
        return best

    best = inserted({"": (0, "", ())})
    for (*_, role, text), initial, fault in zip(given, initials, faults):
        after: dict = {}
        for last, (cost, audit, lines) in best.items():
            ways = [(last, 3, "D", ())]
            if fault not in (BLANK, DUPLICATE):
                more = fault == TRUNCATED
                if initial and initial in NEXT[last]:
                    ways.append((initial, more, "K", (f"{role}:{text}",)))
                ways += [(x, 2 + more, "R", (f"{NAMES[x]}:{text}",)) for x in NEXT[last].replace("s", "")]
            for state, price, name, line in ways:
                value = cost + price, audit + name, (*lines, *line)
                after[state] = min(after.get(state, value), value, key=lambda v: v[:2])
        best = inserted(after)
    return min((best[x] for x in ("", "a") if x in best), key=lambda v: v[:2])


ROLES = ["user", "assistant", "user", "assistant", "system", "tool", "", None]


def odd_rows() -> list[tuple]:
    rng = random.Random(3)
    rows = []
    for conv in [*range(50), None]:
        for turn in range(700 if conv == 5 else rng.choice([0, 1, 2, 3, 8, 40])):
            text = rng.choice(["Hi. ", "no end", "", "  \n", "A?", None, "é" * 900, f"x{rng.randrange(9)}.", f"y{turn}! "])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn // 2]), rng.choice(ROLES), text))
    return rows + rows[:9]


@pytest.mark.parametrize("costs", [EditCosts(), EditCosts(segment=4, join=3)])
def test_conversations_against_a_recount(spark, costs):
    rows = odd_rows()
    clashing = spark.createDataFrame(
        [(*r, "k", 7, "e") for r in rows],
        "conv_id long, turn long, role string, text string, key string, pos int, edit string",
    )
    got = repaired_conversations(clashing.repartition(6), costs)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == recount(rows)


def test_conversations_of_next_to_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repaired_conversations(spark.createDataFrame([], schema)).collect() == []
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Hi."), (None, None, None, None)]
    assert sorted(map(tuple, repaired_conversations(spark.createDataFrame(rows, schema)).collect()), key=str) == recount(rows)
    assert ENDS == (START, 3)
