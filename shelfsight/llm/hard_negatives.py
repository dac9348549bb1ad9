"""Hard negatives by angular triangle filtering.

For every row the cosines to a few reference directions are stored. By the triangle inequality of angles, two rows at
angles s and t to a reference are between |s - t| and s + t apart, so each reference bounds their cosine; times both
norms, widened for rounding, it bounds their score. Only pairs whose bounds overlap a window of scores that can still
be among the best are scored, exactly, in integers.

Anchors are a stated part of the rows. Rows and anchors are dealt into tiles of bounded size, and each pair of tiles is
one group of work that returns its best few of each anchor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsight.llm.vectors import finite, matrix, units
from shelfsight.workspace import written

#: Doubles hold integers up to this one exactly.
EXACT = 2**53
#: Scores beyond it are taken as this value, so that a hundred times a score fits a long.
MOST = 2**56


@dataclass(frozen=True)
class NegativeRules:
    """Anchors are rows whose vec_id is divisible by ``anchor_every``. A negative's score lies between ``least_percent``
    and ``most_percent`` of the positive's. ``references`` directions are chosen from ``sample`` rows. A tile holds
    about ``tile_values`` components."""

    anchor_every: int = 100
    positives: int = 5
    negatives: int = 10
    least_percent: int = 30
    most_percent: int = 90
    scale: int = 256
    references: int = 12
    sample: int = 512
    tile_values: int = 1 << 22


def reference_directions(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` unit rows of ``sample``, each the one of least absolute cosine to those before."""
    rows = units(sample)
    rows = rows[np.abs(rows).max(1, initial=0) > 0]
    if not len(rows):
        return np.zeros((0, sample.shape[1]))
    chosen, nearest = [0], np.abs(rows @ rows[0])
    while len(chosen) < min(count, len(rows)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, np.abs(rows @ rows[chosen[-1]]))
    return rows[chosen]


@dataclass
class Side:
    """Rows of a tile by label, nearest reference and angle to it."""

    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray
    norms: np.ndarray
    cosines: np.ndarray
    cell: np.ndarray
    goals: np.ndarray | None = None

    @classmethod
    def read(cls, table: pa.Table, width: int, references: int) -> Side:
        out = cls(
            table.column("vec_id").to_numpy(), table.column("label").to_numpy(), matrix(table.column("z"), width),
            table.column("norm").to_numpy(), matrix(table.column("cosines"), references), table.column("cell").to_numpy(),
        )
        if "goals" in table.schema.names:
            goals = table.column("goals").combine_chunks()
            sizes = np.diff(goals.offsets.to_numpy())
            out.goals = np.full((len(sizes), int(sizes.max(initial=1))), -1, np.int64)
            out.goals[np.arange(out.goals.shape[1]) < sizes[:, None]] = goals.flatten().to_numpy()
        near = out.cosines[np.arange(len(out.ids)), out.cell] if references else out.norms
        return out.part(np.lexsort((out.ids, near, out.cell, out.labels)))

    def part(self, at) -> Side:
        goals = self.goals[at] if self.goals is not None else None
        return Side(
            self.ids[at], self.labels[at], self.values[at], self.norms[at], self.cosines[at], self.cell[at], goals
        )

    def pieces(self, most: int) -> Iterator[Side]:
        """Runs of one label of at most ``most`` rows."""
        for label in np.unique(self.labels):
            rows = np.flatnonzero(self.labels == label)
            for s in range(0, len(rows), most):
                yield self.part(slice(rows[s], rows[min(s + most, len(rows)) - 1] + 1))


def score_bounds(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible scores of every pair, rounded outwards. The references used are those nearest to
    most rows of either side."""
    size = a.norms[:, None] * b.norms
    low, high = -size, size.copy()
    used = {int(np.bincount(side.cell).argmax()) for side in (a, b)} if a.cosines.shape[1] else set()
    for k in used:
        ca, cb = a.cosines[:, k, None], b.cosines[:, k]
        along = ca * cb
        across = np.sqrt(np.maximum(1 - ca * ca, 0)) * np.sqrt(np.maximum(1 - cb * cb, 0))
        np.minimum(high, size * (along + across), out=high)
        np.maximum(low, size * (along - across), out=low)
    # A cosine off by 1e-15 moves the root of 1 - cosine ** 2 by up to 4e-8.
    room = 1e-6 * size + 1e-6
    return low - room, high + room


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of whole numbers."""
    reach = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
    if reach < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in side], dtype=object).reshape(side.shape) for side in (a, b)]
    return np.clip(whole[0].dot(whole[1].T), -MOST, MOST).astype(np.int64)


class Best:
    """The first ``keep`` (score descending, id ascending) seen of each of ``slots`` slots."""

    def __init__(self, slots: int, keep: int):
        self.keep, self.slots = keep, slots
        self.slot = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.floor = np.full(slots, np.iinfo(np.int64).min)

    def add(self, slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        slot, score, vec_id = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, vec_id)))
        order = np.lexsort((vec_id, -score, slot))
        slot, score, vec_id = slot[order], score[order], vec_id[order]
        first = np.searchsorted(slot, slot)
        rank = np.arange(len(slot)) - first
        stay = rank < self.keep
        self.slot, self.score, self.id = slot[stay], score[stay], vec_id[stay]
        last = rank[stay] == self.keep - 1
        self.floor[self.slot[last]] = self.score[last]


def _take_best(best: Best, slots: np.ndarray, score: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
    """Adds the allowed pairs (slots x ids) that can be among the best of their slot."""
    if score.shape[1] > best.keep:
        shown = np.where(allowed, score, np.iinfo(np.int64).min)
        at = score.shape[1] - best.keep
        own = np.partition(shown, at, axis=1)[:, at]
        allowed = allowed & (score >= np.maximum(own, best.floor[slots])[:, None])
    i, j = np.nonzero(allowed)
    best.add(slots[i], score[i, j], ids[j])


def _tiles(rules: NegativeRules, width: int, references: int, work):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return work(Side.read(left, width, references), Side.read(right, width, references), rules)

    return run


def _positives(anchors: Side, rows: Side, rules: NegativeRules) -> pa.Table:
    best = Best(len(anchors.ids), rules.positives)
    at = {label: np.flatnonzero(anchors.labels == label) for label in np.unique(anchors.labels)}
    for piece in rows.pieces(1024):
        own = at.get(piece.labels[0], np.zeros(0, np.int64))
        for s in range(0, len(own), 512):
            slots = own[s : s + 512]
            part = anchors.part(slots)
            _, high = score_bounds(part, piece)
            open_ = high >= best.floor[slots, None]
            i, j = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
            if len(i) and len(j):
                score = scores(part.values[i], piece.values[j])
                _take_best(best, slots[i], score, part.ids[i, None] != piece.ids[j], piece.ids[j])
    return pa.table([anchors.ids[best.slot], best.id, best.score], ["anchor_id", "positive_id", "positive_score"])


def _negatives(anchors: Side, rows: Side, rules: NegativeRules) -> pa.Table:
    many = anchors.goals.shape[1]
    best = Best(len(anchors.ids) * many, rules.negatives)
    top = np.where(anchors.goals >= 0, anchors.goals * rules.most_percent // 100, -1)
    bottom = np.where(anchors.goals >= 0, -(-anchors.goals * rules.least_percent // 100), 0)
    for piece in rows.pieces(1024):
        own = np.flatnonzero((anchors.labels != piece.labels[0]) & (top >= 0).any(1))
        for s in range(0, len(own), 512):
            part = anchors.part(own[s : s + 512])
            low, high = score_bounds(part, piece)
            wide = np.zeros(low.shape, bool)
            for k in range(many):
                slots = own[s : s + 512] * many + k
                floor = np.maximum(bottom.ravel()[slots], best.floor[slots])
                wide |= (high >= floor[:, None]) & (low <= top.ravel()[slots][:, None])
            i, j = np.flatnonzero(wide.any(1)), np.flatnonzero(wide.any(0))
            if not len(i) or not len(j):
                continue
            score = scores(part.values[i], piece.values[j])
            for k in range(many):
                slots = own[s : s + 512][i] * many + k
                allowed = (score >= bottom.ravel()[slots][:, None]) & (score <= top.ravel()[slots][:, None])
                _take_best(best, slots, score, allowed, piece.ids[j])
    return pa.table(
        [anchors.ids[best.slot // many], anchors.goals.ravel()[best.slot], best.slot % many + 1, best.id, best.score],
        ["anchor_id", "positive_score", "place", "negative_id", "negative_score"],
    )


def _placed(rows: DataFrame, directions: np.ndarray, scale: int) -> DataFrame:
    """Whole numbers, norm, cosines to the reference directions and the nearest one of every row."""
    sent = rows.sparkSession.sparkContext.broadcast(directions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                part = batch.slice(s, 4096)
                column = part.column(2)
                sizes = np.diff(column.offsets.to_numpy())
                z = np.floor(matrix(column, sent.value.shape[1]) * scale)
                unit = units(z)
                cosines = np.clip(unit @ sent.value.T, -1, 1)
                cell = np.abs(cosines).argmax(1) if len(sent.value) else np.zeros(len(z), int)
                most = np.abs(z).max(1, initial=0)
                norm = most * np.linalg.norm(z / np.where(most > 0, most, 1)[:, None], axis=1)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                kept = z[np.arange(z.shape[1]) < sizes[:, None]]
                near = pa.array(np.arange(len(z) + 1, dtype=np.int32) * cosines.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, pa.array(kept)), pa.array(norm),
                        pa.ListArray.from_arrays(near, pa.array(cosines.ravel())), pa.array(cell.astype(np.int32)),
                    ],
                    ["vec_id", "label", "z", "norm", "cosines", "cell"],
                )

    return rows.mapInArrow(
        run, "vec_id long, label long, z array<double>, norm double, cosines array<double>, cell int"
    )


def hard_negatives(vectors: DataFrame, rules: NegativeRules = NegativeRules()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score from ``vectors`` (vec_id, embedding,
    label; other columns are not read).

    Rows with a null vec_id, label or vector, or with a null, NaN or infinite component (also after scaling), take no
    part. Of repeated vec_ids the row of least label and vector takes part. A vector shorter than another counts as
    filled up with zeros. Equal scores are in order of vec_id. An anchor without another row of its label, or without
    a negative in the window, has no row; a positive with a score below 0 has an empty window. Scores are exact up to
    2**56 and taken as that beyond. No rows give no rows.
    """
    spark = vectors.sparkSession
    given = (
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
            F.col("embedding").alias("v"),
        )
        .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("v"))
        .where(~F.exists("v", lambda x: F.abs(x.cast("double") * rules.scale) == float("inf")))
        .groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row"))
        .select("vec_id", F.col("row.label").alias("label"), F.col("row.v").alias("v"))
        .withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    )
    sample = given.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rules.sample).select("v").toArrow().column(0)
    width = int(given.agg(F.max(F.size("v"))).first()[0] or 0)
    directions = reference_directions(np.floor(matrix(sample, width) * rules.scale), rules.references)
    placed = written(_placed(given, directions, rules.scale), "angles")

    anchors = written(placed.where(F.col("vec_id") % rules.anchor_every == 0), "anchors")
    rows, firsts = placed.count(), anchors.count()
    in_tile = max(1024, rules.tile_values // max(width, 1))
    tiles = max(2 * spark.sparkContext.defaultParallelism, math.ceil(rows / in_tile))
    groups = max(1, math.ceil(firsts * 4 / in_tile))

    def worked(left: DataFrame, work, schema: str) -> DataFrame:
        dealt = left.withColumn("part", F.expr(f"pmod(xxhash64(vec_id, 1), {groups})")).withColumn(
            "tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
        )
        right = placed.withColumn("tile", F.expr(f"CAST(pmod(xxhash64(vec_id), {tiles}) AS INT)")).withColumn(
            "part", F.explode(F.expr(f"sequence(0L, {groups - 1}L)"))
        )
        run = _tiles(rules, width, len(directions), work)
        return dealt.groupBy("tile", "part").cogroup(right.groupBy("tile", "part")).applyInArrow(run, schema)

    found = worked(anchors, _positives, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    positives = written(
        found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rules.positives), "positives"
    )
    goals = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("g"))
    aimed = anchors.join(
        goals.select(F.col("anchor_id").alias("vec_id"), F.col("g.positive_score").alias("goals")),
        "vec_id",
    )
    hits = worked(
        aimed, _negatives,
        "anchor_id long, positive_score long, place long, negative_id long, negative_score long",
    )
    first = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= rules.negatives)
    return ranked.join(positives.select("anchor_id", "place", "positive_id"), ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
