"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find.

Each distinct shingle takes part with a random permutation of the slots, drawn one swap per level; the value
that it leaves in a slot is (level, random fraction), so the levels of one element are a permutation and the
signature has less variance than with independent hashes. A text stops at the first level above all values
in its signature. Bands of slots propose pairs, whose whole shingle sets are then compared.

In a bucket of a band every member is compared with one centre, the member that shares most buckets. Where a
bucket then still holds several groups, their texts go through an exact prefix filter: shingles ordered by
rarity, the necessary first ones joined, size and position bounds applied. Texts that differ from a centre by
shingles of their own drop out there, so a bucket of copies never gives all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsight.llm.bytewords import constants, mix, owners, sliced, text_buffer
from shelfsight.llm.components import connected
from shelfsight.llm.shingles import overlaps, shingle_sets
from shelfsight.workspace import written

BANDS = 42
ROWS = 6
#: Levels for which swaps are kept as a list; later ones, with few elements left, use whole permutations.
LISTED_LEVELS = 10


def signatures(hashes: np.ndarray, first: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash signatures (texts x slots) of hashed sets; sets without elements keep the highest value."""
    texts = len(first) - 1
    out = np.full(texts * slots, np.uint64(2**64 - 1))
    element, text = hashes, owners(first)
    swapped: list[tuple[np.ndarray, np.ndarray]] = []
    table = None
    step_r, step_k = constants(slots, 11), constants(slots, 13)
    for level in range(slots):
        if not len(element):
            break
        drawn = mix(element ^ step_k[level]) >> np.uint64(32)
        k = level + ((drawn * np.uint64(slots - level)) >> np.uint64(32)).astype(np.int32)
        if table is None:
            slot, here = k.copy(), np.full(len(k), level, np.int32)
            for was, value in swapped:
                slot = np.where(was == k, value, slot)
                here = np.where(was == level, value, here)
            swapped.append((k, here))
        else:
            rows = np.arange(len(k))
            slot, here = table[rows, k], table[rows, level]
            table[rows, k] = here
        value = (mix(element + step_r[level]) >> np.uint64(9)) | (np.uint64(level) << np.uint64(55))
        np.minimum.at(out, text * slots + slot, value)
        top = out.reshape(texts, slots).max(1) >> np.uint64(55)
        going = (top > np.uint64(level))[text]
        element, text = element[going], text[going]
        if table is not None:
            table = table[going]
        else:
            swapped = [(was[going], value[going]) for was, value in swapped]
            if level + 1 == LISTED_LEVELS:
                table = np.tile(np.arange(slots, dtype=np.int32), (len(element), 1))
                for was, value in swapped:
                    table[np.arange(len(element)), was] = value
    return out.reshape(texts, slots)


def _node_column(hashes: np.ndarray, first: np.ndarray) -> pa.Array:
    """126-bit name of each set, equal for equal sets; null for an empty one."""
    texts = len(first) - 1
    sums = np.zeros((texts, 2), np.uint64)
    full = np.diff(first) > 0
    for k, seed in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
        if full.any():
            sums[full, k] = mix(np.add.reduceat(mix(hashes ^ np.uint64(seed)), first[:-1][full]))
    sums[:, 1] >>= np.uint64(2)
    names = pa.Array.from_buffers(pa.decimal128(38, 0), texts, [None, pa.py_buffer(np.ascontiguousarray(sums))])
    return pa.compute.if_else(pa.array(full), names, pa.scalar(None, pa.decimal128(38, 0)))


def shingled(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, bands) for each row of ``docs``."""
    odd = constants(rows, 17)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text"):
            hashes, first = shingle_sets(*text_buffer(part.column(2)))
            slots = signatures(hashes, first, bands * rows).reshape(-1, bands, rows)
            keys = mix(np.sum(slots * odd, axis=2, dtype=np.uint64) + constants(bands, 19)).astype(np.int64)
            n = np.diff(first)
            at = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(keys[n > 0].ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n), _node_column(hashes, first), lists],
                ["doc_id", "text_hash", "n_shingles", "node", "bands"],
            )

    given = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return given.mapInArrow(
        run, "doc_id long, text_hash long, n_shingles long, node decimal(38,0), bands array<long>"
    )


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(x, y, both, either) for pairs of nodes: sizes of intersection and union of their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text_x"):
            left = shingle_sets(*text_buffer(part.column(2)))
            right = shingle_sets(*text_buffer(part.column(3)))
            both = overlaps(left, right)
            either = np.diff(left[1]) + np.diff(right[1]) - both
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(both), pa.array(either)], ["x", "y", "both", "either"]
            )

    return (
        pairs.join(texts.select(F.col("node").alias("x"), F.col("text").alias("text_x")), "x")
        .join(texts.select(F.col("node").alias("y"), F.col("text").alias("text_y")), "y")
        .select("x", "y", "text_x", "text_y")
        .mapInArrow(run, "x decimal(38,0), y decimal(38,0), both long, either long")
    )


def central(shared: DataFrame) -> DataFrame:
    """(band, y): of each bucket the member with the largest buckets overall."""
    sizes = shared.groupBy("band").agg(F.count("*").alias("size"))
    degrees = shared.join(sizes, "band").groupBy("node").agg(F.sum("size").alias("degree"))
    return shared.join(degrees, "node").groupBy("band").agg(F.max_by("node", F.struct("degree", "node")).alias("y"))


def prefix_pairs(nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(x, y): pairs of ``nodes`` (node, comp) of different comp that can be linked; no linked pair is missing.

    With shingles ordered by (texts that have it, hash), linked sets share one of their first
    n - ceil(percent * n / 100) + 1, and after the first shared one enough must be left on both sides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text"):
            hashes, first = shingle_sets(*text_buffer(part.column(2)))
            n = np.diff(first)
            rows = pa.array(owners(first))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(rows), part.column(1).take(rows), pa.array(np.repeat(n, n)),
                 pa.array(hashes.astype(np.int64))],
                ["node", "comp", "n", "shingle"],
            )

    given = nodes.join(texts, "node").select("node", "comp", "text")
    all_ = written(
        given.mapInArrow(run, "node decimal(38,0), comp decimal(38,0), n long, shingle long"), "shingles"
    )
    common = all_.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    of_node = Window.partitionBy("node")
    place = F.col("n") - F.count("*").over(of_node) + F.row_number().over(of_node.orderBy("df", "shingle")) - 1
    needed = written(
        all_.join(common, "shingle").withColumn("place", place)
        .where(F.expr(f"place <= n - (({percent} * n + 99) div 100)")).drop("df"),
        "prefixes",
    )
    a = needed.select("shingle", *(F.col(c).alias(f"a_{c}") for c in ("node", "comp", "n", "place")))
    b = needed.select("shingle", *(F.col(c).alias(f"b_{c}") for c in ("node", "comp", "n", "place")))
    enough = F.expr(
        f"{100 + percent} * least(a_n - a_place, b_n - b_place) >= {percent} * (a_n + b_n)"
    )
    pairs = a.join(b, (a["shingle"] == b["shingle"]) & (F.col("a_comp") < F.col("b_comp")) & enough)
    return pairs.select(
        F.greatest("a_node", "b_node").alias("x"), F.least("a_node", "b_node").alias("y")
    ).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """near_duplicate_groups without their names."""
    return near_duplicate_groups(docs, percent, bands, rows).drop("comp")


def near_duplicate_groups(docs: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Groups of texts linked by 100 * intersection >= percent * union of their sets of five-word shingles.

    ``docs`` needs doc_id and text; other columns are ignored. One row per row of ``docs``: doc_id, n_shingles,
    component_id (the least doc_id reachable over links), kept (doc_id = component_id), text_hash and comp, the name
    of the group, which tells groups of one component_id apart and is null for a text without words. A text
    that is null or has no words is linked with nothing and kept. A null doc_id never names a group of others:
    it is kept only if its whole group has no id. Repeated rows give repeated results. Empty input, empty output.
    """
    sets = written(shingled(docs, bands, rows), "sets")
    members = sets.where("n_shingles > 0").select("node", F.explode("bands").alias("band"))
    several = members.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    shared = written(members.join(several.select("band"), "band").distinct(), "shared")
    stars = shared.select("node", "band").join(central(shared), "band").where("node != y")
    stars = written(
        stars.select(F.greatest("node", "y").alias("x"), F.least("node", "y").alias("y")).distinct(), "stars"
    )

    nodes = shared.select("node").distinct()
    one_of = sets.join(nodes, "node").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"))
    one_of = one_of.select("node", F.col("one.doc_id").alias("id"), F.col("one.text_hash").alias("h"))
    whole = docs.select(F.col("doc_id").cast("long"), "text").withColumn("text_hash", F.xxhash64("text"))
    found = whole.join(one_of, F.expr("doc_id <=> id and text_hash = h")).select("node", "text")
    texts = written(found.dropDuplicates(["node"]), "texts")

    linked = F.expr(f"100 * both >= {int(percent)} * either")
    seen = written(compared(stars, texts).select("x", "y", linked.alias("linked")), "compared")
    links = seen.where("linked").select("x", "y")
    groups = written(connected(links), "groups")

    placed = shared.select("band", "node").join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    split = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    open_ = written(placed.join(split.select("band"), "band").select("node", "comp").distinct(), "open")
    rest = prefix_pairs(open_, texts, int(percent)).join(seen.select("x", "y"), ["x", "y"], "left_anti")
    more = written(compared(rest, texts).where(linked).select("x", "y"), "more")
    if not more.isEmpty():
        groups = written(connected(links.union(more)), "groups")

    classes = sets.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    classes = classes.join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    classes = written(classes, "classes")
    heads = classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    names = written(classes.join(heads, "comp").select("node", "comp", "component_id"), "names")
    result = sets.drop("bands").join(names, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return result.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash", "comp",
    )
