"""Removal of long repeated byte strings, by recursive induction from sampled suffixes.

A byte goes if it lies in a string of ``length`` bytes that also starts elsewhere. Suffixes are sampled where
content says so (suffix_sampling), about one in 85. What holds for a sampled suffix is induced for the suffixes
before it that share it, in three levels:

* a run, all windows of one sampled place: equal runs settle all their windows with one row;
* units of 16 windows, for runs that are alone but whose sampled suffix is not: the common prefix of a unit's
  windows decides whether any can repeat, the whole unit whether all do;
* single windows, where a unit's common prefix repeats and the unit does not.

Each level groups tuples of (sampled suffix, content hash) by Spark's external sort and hash aggregation, which
spill to disk; only distinct runs and units descend, with the number of places they stand for. No group is
gathered, so a string that starts at any number of places costs a row per place and level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.bytewords import mix, prefix_sums, ragged_ranges, sliced, span_hashes, text_buffer
from shelfsight.llm.suffix_sampling import second_sums, spans_second, window_runs
from shelfsight.workspace import discard, written

LENGTH = 200
LEVELS = (16, 1)
#: Windows of one text that are sampled at a time.
SEGMENT = 1 << 23


def sampled_runs(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, block, doc_id, text_hash, start, n, lead): runs of windows; ``lead`` is the distance of the
    sampled place from the run's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text"):
            data, at = text_buffer(part.column(2))
            if part.num_rows == 1:
                pieces = [(a, data[a : a + SEGMENT + length - 1]) for a in range(0, max(len(data) - length + 1, 0), SEGMENT)]
                pieces = [(a, piece, np.array([0, len(piece)])) for a, piece in pieces]
            else:
                pieces = [(0, data, at)]
            for base, piece, offsets in pieces:
                text, start, n, lead, anchor, block = window_runs(piece, offsets, length)
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.astype(np.int64)), pa.array(block.astype(np.int64)), part.column(0).take(rows),
                     part.column(1).take(rows), pa.array(start + base), pa.array(n.astype(np.int32)),
                     pa.array(lead.astype(np.int32))],
                    ["anchor", "block", "doc_id", "text_hash", "start", "n", "lead"],
                )

    return docs.mapInArrow(
        run, "anchor long, block long, doc_id long, text_hash long, start long, n int, lead int"
    )


def _contexts(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """(rid, anchor, weight, lead, n, bytes) of ``runs`` (rid, anchor, weight, doc_id, text_hash, start, n, lead)."""
    per_text = runs.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("rid", "anchor", "weight", "lead", "n", "start")).alias("runs")
    ).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("h"), "runs")
    found = docs.join(per_text, F.expr("doc_id <=> id AND text_hash = h")).select("text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text"):
            data, at = text_buffer(part.column(0))
            lists = part.column(1)
            base = at[lists.value_parent_indices().to_numpy()]
            one = lists.flatten()
            start = one.field("start").to_numpy() + base
            size = one.field("n").to_numpy().astype(np.int64) + length - 1
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            taken = np.ascontiguousarray(data[ragged_ranges(start, size)])
            content = pa.Array.from_buffers(
                pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(taken)]
            )
            yield pa.RecordBatch.from_arrays(
                [one.field(c) for c in ("rid", "anchor", "weight", "lead", "n")] + [content],
                ["rid", "anchor", "weight", "lead", "n", "bytes"],
            )

    rows = found.mapInArrow(run, "rid long, anchor long, weight long, lead int, n int, bytes binary")
    return rows.dropDuplicates(["rid"])  # repeated rows of one text


def _units(work: DataFrame, size: int, length: int) -> DataFrame:
    """Units of ``size`` windows of ``work`` (rid, anchor, weight, lead, lo, hi, bytes), windows lo to hi of a run.

    (rid, anchor, core, block, weight, lo, hi): units are counted from the sampled place, so that they match
    between runs. ``core`` names the unit and the bytes that all its windows share, ``block`` its own bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "bytes"):
            data, at = text_buffer(part.column(6))
            lead, lo, hi = (part.column(k).to_numpy().astype(np.int64) for k in (3, 4, 5))
            first, last = (lead - hi) // size, (lead - lo) // size  # units, by distance before the sampled place
            count = last - first + 1
            row = np.repeat(np.arange(part.num_rows), count)
            unit = ragged_ranges(first, count)
            a = np.maximum(lo[row], lead[row] - (unit * size + size - 1))
            b = np.minimum(hi[row], lead[row] - unit * size)
            prefix, second = prefix_sums(data), second_sums(data)
            place = at[row] + lead[row]
            core = span_hashes(prefix, place - unit * size, place - unit * size + length - size + 1)
            block = spans_second(second, at[row] + a, at[row] + b + length)
            block = mix(block + mix((lead[row] - a).astype(np.uint64)))
            core = mix(core + mix(unit.astype(np.uint64)))
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(rows), part.column(1).take(rows), pa.array(core.astype(np.int64)),
                 pa.array(block.astype(np.int64)), part.column(2).take(rows),
                 pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))],
                ["rid", "anchor", "core", "block", "weight", "lo", "hi"],
            )

    given = work.select("rid", "anchor", "weight", "lead", "lo", "hi", "bytes")
    return given.mapInArrow(
        run, "rid long, anchor long, core long, block long, weight long, lo int, hi int"
    )


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, text_hash, spans): of each text the (start, windows) that repeat, in any order. Written; the tables
    on the way are deleted as soon as nothing needs them."""
    all_runs = written(sampled_runs(docs, length), "runs")
    shared = written(all_runs.groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    runs = written(all_runs.join(shared, "anchor"), "shared-runs")
    discard(all_runs, shared)
    kinds = written(
        runs.groupBy("anchor", "block").agg(
            F.count("*").alias("weight"), *(F.first(c).alias(c) for c in ("doc_id", "text_hash", "start", "n", "lead"))
        ),
        "kinds",
    )
    settled = kinds.where("weight > 1").select("anchor", "block")
    spans = runs.join(settled, ["anchor", "block"], "left_semi").select("doc_id", "text_hash", "start", "n")

    open_ = kinds.groupBy("anchor").agg(F.count("*").alias("k"), F.min("weight").alias("m")).where("k > 1 AND m = 1")
    descending = kinds.join(open_.select("anchor"), "anchor").withColumn("rid", F.monotonically_increasing_id())
    descending = written(descending.drop("block"), "descending")
    contexts = written(_contexts(docs, descending, length), "contexts")
    work = contexts.withColumn("lo", F.lit(0)).withColumn("hi", F.col("n") - 1)
    marks, made = None, [runs, kinds, descending, contexts]
    for size in LEVELS:
        units = written(_units(work, size, length), "units")
        alike = written(
            units.groupBy("anchor", "core", "block").agg(
                F.sum("weight").alias("weight"), *(F.first(c).alias(c) for c in ("rid", "lo", "hi"))
            ),
            "alike",
        )
        made += [units, alike]
        settled = alike.where("weight > 1").select("anchor", "core", "block")
        own = units.where("weight = 1").join(settled, ["anchor", "core", "block"], "left_semi")
        own = own.select("rid", "lo", (F.col("hi") - F.col("lo") + 1).alias("n"))
        marks = own if marks is None else marks.union(own)
        if size > 1:
            open_ = alike.groupBy("anchor", "core").agg(F.count("*").alias("k"), F.min("weight").alias("m"))
            open_ = open_.where("k > 1 AND m = 1").select("anchor", "core")
            chosen = alike.join(open_, ["anchor", "core"]).select("rid", "weight", "lo", "hi")
            work = chosen.join(contexts.select("rid", "anchor", "lead", "bytes"), "rid")
    marks = marks.groupBy("rid").agg(F.collect_list(F.struct("lo", "n")).alias("marks"))
    marked = descending.select("rid", "doc_id", "text_hash", "start").join(marks, "rid")
    marked = marked.select("doc_id", "text_hash", "start", F.explode("marks").alias("m")).select(
        "doc_id", "text_hash", (F.col("start") + F.col("m.lo")).alias("start"), F.col("m.n").alias("n")
    )
    both = spans.union(marked)
    out = written(both.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias("spans")), "spans")
    discard(*made)
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) without the bytes inside strings of ``length`` bytes that also start
    elsewhere, in another text, the same text or a repeated row. Strings are judged on the input.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and ``kept`` (the bytes that
    stay) if asked for. Null and empty texts have 0 bytes; texts below ``length`` bytes keep all. Other columns
    are ignored. Empty input, empty output.
    """
    docs = docs.select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text")
    )
    spans = repeated_spans(docs, length)
    spans = spans.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("h"), "spans")
    joined = docs.join(spans, F.expr("doc_id <=> id AND text_hash = h"), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text"):
            data, at = text_buffer(part.column(1))
            lists = part.column(2)
            parent = lists.value_parent_indices().to_numpy()
            one = lists.flatten()
            edge = np.zeros(len(data) + 1, np.int32)
            start = at[parent] + one.field("start").to_numpy()
            np.add.at(edge, start, 1)
            np.add.at(edge, start + one.field("n").to_numpy() + length - 1, -1)
            gone = np.cumsum(edge)[:-1] > 0
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            inner = at[:-1][at[:-1] < len(data)]
            opens[inner] = gone[inner]
            removed, opened = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(opens)])
            kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            out = [
                part.column(0), pa.array(np.diff(at)), pa.array(np.diff(removed[at])), pa.array(np.diff(opened[at])),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
            ]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                out, names = out + [pa.array(kept, pa.binary())], names + ["kept"]
            yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.mapInArrow(run, schema + (", kept binary" if with_text else ""))
