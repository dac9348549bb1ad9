"""Hard negatives and near-duplicate vectors against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest

from shelfsight.llm.cap_filters import CapCode, Decoder, near_vectors
from shelfsight.llm.hard_negatives import Best, NegativeRules, Side, hard_negatives, score_bounds, scores
from shelfsight.llm.vectors import units

SCHEMA = "vec_id long, embedding array<double>, label int, node string, n int, tile int, links string"
CLASHING = ("x", 1, 2, "y")


def table(spark, rows):
    return spark.createDataFrame([(*row, *CLASHING) for row in rows], SCHEMA).repartition(5)


def usable(vector) -> bool:
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def expected_negatives(rows) -> list[tuple]:
    best: dict[int, tuple] = {}
    for vec_id, vector, label in rows:
        if vec_id is not None and label is not None and usable(vector):
            best[vec_id] = min(best.get(vec_id, (label, vector)), (label, vector))
    rows = {
        i: ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in vector])
        for i, (label, vector) in best.items()
    }
    out = []
    for anchor in (i for i in rows if i % 100 == 0):
        found = sorted(
            (-sum(x * y for x, y in zip(rows[anchor][1], rows[i][1])), i) for i in rows if i != anchor
        )
        same = [(-s, i) for s, i in found if rows[i][0] == rows[anchor][0]][:5]
        for positive, i in same:
            other = [
                (-s, j) for s, j in found
                if rows[j][0] != rows[anchor][0] and 30 * positive <= 100 * -s <= 90 * positive
            ][:10]
            out += [(anchor, i, k + 1, j, positive, s) for k, (s, j) in enumerate(other)]
    return sorted(out)


def mixed_rows() -> list[tuple]:
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    rows = []
    for i in range(900):
        vector = centres[i % 6] + rng.normal(size=12) * rng.choice([0.05, 0.5, 2])
        rows.append((i, [float(x) for x in np.round(vector, 1 if i % 3 else 6)], int(rng.integers(0, 3))))
    rows += [
        (1000, None, 1), (1001, [1.0] * 12, None), (1002, [float("nan")] * 12, 1), (1003, [None] + [1.0] * 11, 1),
        (1004, [float("inf")] + [1.0] * 11, 1), (1005, [], 1), (1006, [0.0] * 12, 1), (1007, [2.0, 1.0], 1),
        (None, [1.0] * 12, 1), (1008, [1e300] + [0.0] * 11, 2), (3, rows[3][1], rows[3][2]), (4, rows[5][1], 2),
    ]
    return rows


def test_negatives_against_all_pairs(spark):
    rows = [r for r in mixed_rows() if r[0] != 1008]
    got = sorted(map(tuple, hard_negatives(table(spark, rows)).collect()))
    assert got == expected_negatives(rows)
    assert len({r[0] for r in got}) >= 9


def test_negatives_in_many_small_tiles(spark):
    rows = [r for r in mixed_rows() if r[0] != 1008]
    small = NegativeRules(tile_values=1, references=0)
    assert sorted(map(tuple, hard_negatives(table(spark, rows), small).collect())) == expected_negatives(rows)


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 1)], [(0, None, None)], [(0, [], 1), (1, [], 1), (2, [], 2)]])
def test_negatives_of_next_to_nothing(spark, rows):
    assert sorted(map(tuple, hard_negatives(table(spark, rows)).collect())) == expected_negatives(rows)


def test_huge_components_do_not_break_scores(spark):
    got = hard_negatives(table(spark, [(0, [1e300], 1), (1, [1e300], 1), (2, [-1.0], 2)])).collect()
    assert got == []
    assert scores(np.array([[2.0**40, 3.0]]), np.array([[2.0**14, 5.0]])).tolist() == [[2**54 + 15]]


def test_score_bounds_hold():
    rng = np.random.default_rng(1)
    z = np.floor(rng.normal(size=(60, 8)) * rng.choice([1, 256, 1e6], (60, 1)))
    directions = units(z[:4])
    side = Side(
        np.arange(60), np.zeros(60, int), z, np.linalg.norm(z, axis=1), np.clip(units(z) @ directions.T, -1, 1),
        rng.integers(0, 4, 60),
    )
    low, high = score_bounds(side.part(slice(0, 30)), side)
    exact = scores(z[:30], z)
    assert (low <= exact).all() and (exact <= high).all()
    # A reference bounds its own score tightly.
    own = side.part([0])
    own.cell[:] = 0
    low, high = score_bounds(own, own)
    assert high[0, 0] - low[0, 0] < 1e-5 * own.norms[0] ** 2 + 1e-5


def test_best_keeps_the_first_by_score_and_id():
    best = Best(2, 2)
    for slot, score, vec_id in ((0, 5, 9), (0, 5, 3), (1, 1, 1), (0, 7, 8), (0, 5, 2)):
        best.add(np.array([slot]), np.array([score]), np.array([vec_id]))
    assert list(zip(best.slot, best.score, best.id)) == [(0, 7, 8), (0, 5, 2), (1, 1, 1)]
    assert best.floor[0] == 5 and best.floor[1] < -(2**60)


def expected_links(rows, cosine=0.93):
    names = [r[0] for r in rows]
    vectors = [
        np.array(v) / max(map(abs, v)) if label is not None and usable(v) and any(v) else None for _, v, label in rows
    ]
    vectors = [v / np.linalg.norm(v) if v is not None else None for v in vectors]
    near = [
        [
            j for j in range(len(rows))
            if i != j and rows[i][2] == rows[j][2] and vectors[i] is not None and vectors[j] is not None
            and len(vectors[i]) == len(vectors[j]) and vectors[i] @ vectors[j] >= cosine
        ]
        for i in range(len(rows))
    ]
    out = []
    for i in range(len(rows)):
        seen, stack = {i}, [i]
        while stack:
            for j in near[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        component = min((names[j] for j in seen if names[j] is not None), default=None)
        out.append((names[i], len(near[i]), component, names[i] == component))
    return sorted(out, key=str)


def clustered_rows(size: int, rng) -> list[tuple]:
    rows = []
    for _ in range(40):
        centre = units(rng.normal(size=(1, size)))[0]
        for _ in range(int(rng.integers(1, 12))):
            vector = units((centre + rng.normal(size=size) * rng.choice([0, 0.1, 0.25]) / np.sqrt(size))[None])[0]
            rows.append((len(rows), [float(x) for x in vector * rng.choice([1, 1e-3, 1e200])], int(rng.integers(0, 2))))
    return rows


@pytest.mark.parametrize("code", [CapCode(), CapCode(block=4)])
def test_links_against_all_pairs(spark, code):
    rng = np.random.default_rng(2)
    rows = clustered_rows(64, rng)
    n = len(rows)
    rows += [
        (n, None, 1), (n + 1, rows[0][1], None), (n + 2, [0.0] * 64, 1), (n + 3, [float("nan")] * 64, 1),
        (n + 4, [None, 1.0], 1), (n + 5, [], 1), (n + 6, [], 1), (n + 7, [1.0, 2.0], 1), (n + 8, [1.0, 2.1], 1),
        (None, rows[0][1], rows[0][2]), (None, None, None), (None, [5.0, -9.0, 2.0], 1), (0, rows[0][1], rows[0][2]),
        (0, rows[3][1], rows[3][2]), (-5, rows[7][1], rows[7][2]), (n + 9, [1.0, 2.0], None),
    ]
    got = sorted(map(tuple, near_vectors(table(spark, rows), code=code).collect()), key=str)
    assert got == expected_links(rows)
    assert near_vectors(table(spark, [])).collect() == []


def test_one_large_group_of_near_copies(spark):
    rng = np.random.default_rng(3)
    centre = units(rng.normal(size=(1, 64)))[0]
    near = units(centre + rng.normal(size=(600, 64)) * 0.15 / 8)
    other = units(rng.normal(size=(200, 64)))
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate([*near, *other])]
    rows += [(1000 + i, rows[0][1], 1) for i in range(300)]
    for code in (CapCode(), CapCode(block=100)):
        got = sorted(map(tuple, near_vectors(table(spark, rows), code=code).collect()), key=str)
        assert got == expected_links(rows)


@pytest.mark.parametrize("size", [3, 24, 64, 300])
def test_pairs_at_the_limit_share_a_filter(size):
    rng = np.random.default_rng(size)
    a = units(rng.normal(size=(400, size)))
    side = rng.normal(size=a.shape)
    side = units(side - (side * a).sum(1, keepdims=True) * a)
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * side
    decoder = Decoder(size, CapCode())
    filters = [set(), set()]
    for k, vectors in enumerate((a, b)):
        row, found = decoder.decode(vectors)
        filters[k] = {(r, f) for r, f in zip(row.tolist(), found.tolist())}
        assert 10 < len(row) / len(a) < 120
    shared = {r for r, _ in filters[0] & filters[1]}
    assert len(shared) >= 0.99 * len(a)


def test_decoding_finds_every_filter_above_the_cap():
    code = CapCode(codes=3, words=6, filters=12)
    vectors = units(np.random.default_rng(8).normal(size=(50, 20)))
    decoder = Decoder(20, code)
    row, found = decoder.decode(vectors)
    wide = np.zeros((50, decoder.width))
    wide[:, :20] = vectors
    hadamard = np.array([[1.0]])
    while len(hadamard) < decoder.width:
        hadamard = np.block([[hadamard, hadamard], [hadamard, -hadamard]])
    plain = set()
    for k in range(3):
        turned = (wide * decoder.signs[k]) @ hadamard.T / math.sqrt(decoder.width)
        for i in range(6):
            for j in range(6):
                direction = np.concatenate([decoder.words[k, 0, i], decoder.words[k, 1, j]])
                assert abs(np.linalg.norm(direction) - 1) < 1e-12
                plain |= {(r, (k * 6 + i) * 6 + j) for r in np.flatnonzero(turned @ direction >= decoder.height).tolist()}
    assert set(zip(row.tolist(), found.tolist())) == plain
