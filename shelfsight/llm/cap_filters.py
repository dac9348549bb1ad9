"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector belongs to every filter whose direction it meets at a cosine above the cap
height. The directions are structured: each of several random product codes turns the space by signs and a
Hadamard transform and joins one of ``words`` unit vectors in the first half of the coordinates with one of as many
in the second half, so a vector is decoded to all its filters without looking at each. Vectors that share a filter
are compared in double precision. A pair is counted at the least filter that both belong to.

Equal vectors are one class with a count. A filter with many classes is dealt into blocks, and every pair of blocks
is a unit of work of its own: no filter gathers in one task and no list of pairs leaves a unit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.components import connected
from shelfsight.llm.vectors import finite, matrix, units
from shelfsight.workspace import written

#: Units of up to so many classes are compared together, units of one size at once.
SMALL_UNIT = 32


@dataclass(frozen=True)
class CapCode:
    """``codes`` product codes of ``words`` * ``words`` directions. The cap height is such that a vector belongs to
    ``filters`` of them on average. A filter with more than ``block`` classes is dealt into blocks."""

    codes: int = 64
    words: int = 64
    filters: float = 40.0
    block: int = 1024
    seed: int = 13


def cap_height(width: int, share: float) -> float:
    """The cosine that a random direction in ``width`` dimensions exceeds with probability ``share``."""
    t = np.linspace(0, 1, 200_001)
    weight = (1 - t * t) ** ((width - 3) / 2)
    above = np.cumsum(weight[::-1])[::-1] / (2 * weight.sum())
    return float(t[np.searchsorted(-above, -share)])


def _hadamard(rows: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of every row; the width is a power of two."""
    n, width = rows.shape
    half = 1
    while half < width:
        pairs = rows.reshape(n, width // (2 * half), 2, half)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return rows / np.sqrt(width)


class Decoder:
    """Filters of vectors of up to ``size`` components."""

    def __init__(self, size: int, code: CapCode):
        self.code, self.width = code, max(16, 1 << max(size - 1, 0).bit_length())
        draw = np.random.default_rng((code.seed, self.width))
        self.signs = draw.choice([-1.0, 1.0], (code.codes, self.width))
        words = draw.standard_normal((code.codes, 2, code.words, self.width // 2))
        self.words = words / (np.linalg.norm(words, axis=3, keepdims=True) * np.sqrt(2))
        self.height = cap_height(self.width, code.filters / (code.codes * code.words**2))

    def decode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) for every filter of every unit vector, by row and filter."""
        whole = np.zeros((len(vectors), self.width))
        whole[:, : vectors.shape[1]] = vectors
        rows, filters, half, n = [], [], self.width // 2, self.code.words
        for k in range(self.code.codes):
            turned = _hadamard(whole * self.signs[k])
            left, right = turned[:, :half] @ self.words[k, 0].T, turned[:, half:] @ self.words[k, 1].T
            row, i = np.nonzero(left >= self.height - right.max(1, keepdims=True))
            hit, j = np.nonzero(right[row] >= self.height - left[row, i][:, None])
            rows.append(row[hit])
            filters.append((k * n + i[hit]) * n + j)
        row, found = np.concatenate(rows), np.concatenate(filters)
        order = np.lexsort((found, row))
        return row[order], found[order].astype(np.int32)


def _decoded(code: CapCode):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoders: dict[int, Decoder] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                column = part.column(part.schema.get_field_index("v"))
                sizes = np.diff(column.offsets.to_numpy())
                at, found = np.zeros(part.num_rows, np.int64), [np.zeros(0, np.int32)] * part.num_rows
                for size in np.unique(sizes):
                    chosen = np.flatnonzero(sizes == size)
                    if size not in decoders:
                        decoders[size] = Decoder(int(size), code)
                    row, filters = decoders[size].decode(units(matrix(column.take(pa.array(chosen)))))
                    ends = np.searchsorted(row, np.arange(len(chosen) + 1))
                    for k, r in enumerate(chosen):
                        found[r] = filters[ends[k] : ends[k + 1]]
                        at[r] = len(found[r])
                offsets = np.concatenate([[0], np.cumsum(at)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "filters"])

    return run


def _pairs_of_small(rows: np.ndarray, unit: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs of one unit at or above ``cosine``; ``unit`` are row numbers, units x size."""
    inside = rows[unit]
    u, i, j = np.nonzero(np.triu(inside @ inside.transpose(0, 2, 1) >= cosine, 1))
    return unit[u, i], unit[u, j]


def _without_common(a, b, own, lists, chunk: int = 2048) -> np.ndarray:
    """True for pairs (a, b) that share no filter below ``own``; ``lists`` are padded with -1."""
    out = np.ones(len(a), bool)
    for s in range(0, len(a), chunk):
        x, y, f = lists[a[s : s + chunk]], lists[b[s : s + chunk]], own[s : s + chunk]
        lower = (x >= 0) & (x < f[:, None])
        out[s : s + chunk] = ~((x[:, :, None] == y[:, None, :]) & lower[:, :, None]).any((1, 2))
    return out


def _pairs_of_large(rows, members, block, crossed, own, lists, cosine) -> tuple[np.ndarray, np.ndarray]:
    """The same for one unit of any size, by matrix products; filters below ``own`` as columns of 0 and 1. A ``crossed``
    unit compares two blocks, of which either may be empty."""
    linked = np.triu(rows[members] @ rows[members].T >= cosine, 1)
    if crossed:
        linked &= block[:, None] != block[None, :]
    mine = lists[members]
    row, place = np.nonzero((mine >= 0) & (mine < own))
    name, column, times = np.unique(mine[row, place], return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    for s in range(0, len(shared), 512):
        local = np.full(len(name), -1)
        local[shared[s : s + 512]] = np.arange(len(shared[s : s + 512]))
        use = local[column] >= 0
        has = np.zeros((len(members), len(shared[s : s + 512])), np.float32)
        has[row[use], local[column[use]]] = 1
        linked &= has @ has.T == 0
    i, j = np.nonzero(linked)
    return members[i], members[j]


def _compared(cosine: float):
    """Links of sorted units: for a class in a unit its links to classes counted there, and the least class that it
    reaches by them."""

    def links(table: pa.Table) -> pa.RecordBatch:
        column = {name: table.column(name).to_numpy() for name in ("unit", "lo", "hi", "own", "f", "node", "n")}
        rows = units(matrix(table.column("v")))
        filters = table.column("filters").combine_chunks()
        lists = np.full((len(rows), int(np.diff(filters.offsets.to_numpy()).max(initial=1))), -1, np.int32)
        sizes = np.diff(filters.offsets.to_numpy())
        lists[np.arange(lists.shape[1]) < sizes[:, None]] = filters.flatten().to_numpy()
        change = np.ones(len(rows), bool)
        for name in ("unit", "lo", "hi"):
            change[1:] &= column[name][1:] == column[name][:-1]
        change[1:] = ~change[1:]
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], len(rows))
        length = ends - starts
        small = (length <= SMALL_UNIT) & (column["lo"][starts] == column["hi"][starts])
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size in np.unique(length[small & (length > 1)]):
            begin = starts[small & (length == size)]
            step = max(1, 200_000 // (size * rows.shape[1] or 1))
            for s in range(0, len(begin), step):
                a, b = _pairs_of_small(rows, begin[s : s + step, None] + np.arange(size), cosine)
                new = _without_common(a, b, column["f"][a], lists)
                left.append(a[new])
                right.append(b[new])
        for k in np.flatnonzero(~small & (length > 1)):
            members = np.arange(starts[k], ends[k])
            crossed = column["lo"][starts[k]] != column["hi"][starts[k]]
            a, b = _pairs_of_large(
                rows, members, column["own"][members], crossed, column["f"][starts[k]], lists, cosine
            )
            left.append(a)
            right.append(b)
        a, b = np.concatenate(left), np.concatenate(right)
        count = np.zeros(len(rows), np.int64)
        np.add.at(count, a, column["n"][b])
        np.add.at(count, b, column["n"][a])
        least = column["node"].copy()
        while True:
            before = least.copy()
            np.minimum.at(least, a, before[b])
            np.minimum.at(least, b, before[a])
            if (least == before).all():
                break
        hit = count > 0
        return pa.RecordBatch.from_arrays(
            [pa.array(column["node"][hit]), pa.array(count[hit]), pa.array(least[hit])], ["node", "links", "least"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([waiting, table]) if waiting is not None else table
            keys = np.stack([table.column(name).to_numpy() for name in ("unit", "lo", "hi")])
            last = int(np.searchsorted(-(keys == keys[:, -1:]).all(0)[::-1].astype(int), 0)) if table.num_rows else 0
            whole = table.num_rows - last
            if whole:
                yield links(table.slice(0, whole))
            waiting = table.slice(whole)
        if waiting is not None and waiting.num_rows:
            yield links(waiting)

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.93, code: CapCode = CapCode()) -> DataFrame:
    """vec_id, n_links (other rows of the same label at ``cosine`` or more), component_id (the least vec_id reachable by
    links, itself included) and kept (vec_id = component_id) for every row of ``vectors`` (vec_id, embedding, label;
    other columns are not read).

    Rows whose label or vector is null, whose vector is empty or zero or holds a null, NaN or infinite component have
    no links and are their own component. Vectors of different lengths are not linked. Repeated rows are linked with
    each other, and all rows of the component's vec_id are kept. A null vec_id takes part, but names a component only
    if that has no other id; such a row is kept if its component has no id. No rows give no rows. Pairs at the limit
    itself are found with a probability above 0.99 (tests/llm measures it); nothing below the limit is linked.
    """
    given = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").alias("v")
    )
    usable = given.where(F.col("label").isNotNull() & finite("v") & F.exists("v", lambda x: x != 0))
    classes = written(
        usable.groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
        .withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("v")),
        "cap-classes",
    )
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    coded = written(classes.mapInArrow(_decoded(code), f"{fields}, filters array<int>"), "cap-codes")

    slots = coded.select("label", "dim", "node", F.explode("filters").alias("f"))
    key = ["label", "dim", "f"]
    filters = written(
        slots.groupBy(*key).count().where("count > 1")
        .select(
            *key, F.ceil(F.col("count") / code.block).cast("int").alias("blocks"),
            F.monotonically_increasing_id().alias("unit"),
        ),
        "cap-units",
    )
    dealt = (
        slots.join(filters, key).withColumn("own", F.expr("CAST(pmod(xxhash64(node), blocks) AS INT)"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("unit", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "f", "node")
    )
    unit = ["unit", "lo", "hi"]
    work = dealt.join(coded.select("node", "n", "v", "filters"), "node").repartition(*unit).sortWithinPartitions(*unit)
    found = written(work.mapInArrow(_compared(cosine), "node long, links long, least long"), "cap-links")

    total = found.groupBy("node").agg(F.sum("links").alias("links"))
    together = connected(found.select(F.col("node").alias("x"), F.col("least").alias("y")))
    named = written(
        classes.join(total, "node", "left").join(together, "node", "left")
        .select(
            "label", "v", "first", F.coalesce("comp", "node").alias("comp"),
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        ),
        "cap-named",
    )
    component = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    result = named.join(component, "comp").select(
        F.col("label").alias("l"), F.col("v").alias("w"), "n_links", "component_id", F.lit(True).alias("in_class")
    )
    own = F.when(F.col("in_class"), F.col("component_id")).otherwise(F.col("vec_id"))
    return (
        given.join(result, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
