"""Benchmark decontamination as a prefix-filtered containment join.

An item is cut into windows of consecutive words. The words of a window are ordered by rarity over all
documents; as a window must be contained whole, its rarest word alone is the necessary prefix. Document words
equal to a prefix word propose (window, start); length bounds (the text must hold the window at that place) and
the position of the prefix word leave one place per proposal, and the window's words there are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsight.llm.bytewords import (
    ALNUM, owners, ragged_ranges, sliced, text_buffer, word_hashes,
)
from shelfsight.workspace import written

WINDOW = 10
#: Windows of the benchmark that one pass over the documents looks for; a larger benchmark takes more passes.
BLOCK_WINDOWS = 500_000


@dataclass
class Windows:
    """A block of distinct windows with their prefix words, sorted by prefix word."""

    prefix: np.ndarray  # hash of the rarest word
    place: np.ndarray  # its place in the window
    length: np.ndarray
    words: np.ndarray  # window x WINDOW word hashes, 0 beyond the length
    number: np.ndarray


def _window_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for part in sliced(batches, "text"):
        hashes, _, _, first = word_hashes(*text_buffer(part.column(1)), ALNUM, fold=True)
        counts = np.diff(first)
        n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
        item = np.repeat(np.arange(len(counts)), n)
        starts = ragged_ranges(first[:-1], n)
        length = np.minimum(counts, size)[item]
        words = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)),
            pa.array(hashes[ragged_ranges(starts, length)].astype(np.int64)),
        )
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(item)), words], ["item_id", "words"])


def item_windows(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The distinct windows of ``items`` (item_id, text) as (window, words), word hashes numbered as they are written,
    and the items that hold them as (window, item)."""
    rows = written(
        items.select(F.col("item_id").cast("string"), F.col("text")).mapInArrow(
            lambda batches: _window_rows(batches, size), "item_id string, words array<long>"
        ).distinct(),
        "item-windows",
    )
    windows = written(
        rows.select("words").distinct().select(F.monotonically_increasing_id().alias("window"), "words"), "windows"
    )
    holders = rows.where("item_id IS NOT NULL").join(windows, "words").select("window", F.col("item_id").alias("item"))
    return windows, written(holders, "window-items")


def word_counts(docs: DataFrame, vocabulary: DataFrame, block: int = 2_000_000) -> DataFrame:
    """(word, n): occurrences over all of ``docs`` of each word of ``vocabulary`` (word), 0 included. The
    vocabulary is looked up in the tasks, block by block of a bounded number of words."""
    words = vocabulary.select("word").distinct()
    blocks = max(1, -(-words.count() // block))
    found = None
    for b in range(blocks):
        own = words.where(F.pmod("word", F.lit(blocks)) == b).orderBy("word").toArrow().column(0).to_numpy()
        sent = docs.sparkSession.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = sent.value
            total = np.zeros(len(known) + 1, np.int64)
            for part in sliced(batches, "text"):
                hashes = word_hashes(*text_buffer(part.column(0)), ALNUM, fold=True)[0].astype(np.int64)
                at = np.searchsorted(known, hashes)
                at[at == len(known)] = 0
                if len(known):
                    at[known[at] != hashes] = len(known)
                    total += np.bincount(at, minlength=len(known) + 1)
            hit = np.flatnonzero(total[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(known[hit]), pa.array(total[hit])], ["word", "n"])

        counted = docs.select("text").mapInArrow(run, "word long, n long")
        found = counted if found is None else found.union(counted)
    counts = found.groupBy("word").agg(F.sum("n").alias("n"))
    return words.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def _block(windows: DataFrame, counts: DataFrame, blocks: int, b: int, size: int) -> Windows:
    own = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b)
    rarest = (
        own.select("window", "words", F.posexplode("words").alias("place", "word"))
        .join(counts, "word")
        .groupBy("window").agg(F.min(F.struct("n", "word", "place")).alias("prefix"), F.first("words").alias("words"))
        .select("window", "prefix.word", "prefix.place", "words").orderBy("window")
    ).toArrow().combine_chunks()
    lists = rarest.column("words").combine_chunks()
    length = lists.value_lengths().to_numpy().astype(np.int64)
    words = np.zeros((rarest.num_rows, size), np.uint64)
    words[np.arange(size) < length[:, None]] = lists.flatten().to_numpy().astype(np.uint64)
    hashed = rarest.column("word").to_numpy().astype(np.uint64)
    order = np.argsort(hashed, kind="stable")
    place, number = (rarest.column(c).to_numpy().astype(np.int64)[order] for c in ("place", "window"))
    return Windows(hashed[order], place, length[order], words[order], number)


def _found(part_text: pa.Array, block: Windows, size: int):
    """(text, first word of the occurrence within its text, window) of all occurrences; words per text."""
    hashes, _, _, first = word_hashes(*text_buffer(part_text), ALNUM, fold=True)
    counts = np.diff(first)
    lo = np.searchsorted(block.prefix, hashes, "left")
    hit = np.flatnonzero(lo < len(block.prefix))
    hit = hit[block.prefix[lo[hit]] == hashes[hit]]
    n = np.searchsorted(block.prefix, hashes[hit], "right") - lo[hit]
    window = ragged_ranges(lo[hit], n)
    text = np.repeat(owners(first)[hit], n)
    start = np.repeat(hit, n) - block.place[window]
    fits = (start >= first[text]) & (start + block.length[window] <= first[text + 1])
    window, text, start = window[fits], text[fits], start[fits]
    same = np.ones(len(window), bool)
    for k in range(size):
        if len(hashes):
            place = np.minimum(start + k, len(hashes) - 1)
            same &= (k >= block.length[window]) | (hashes[place] == block.words[window, k])
    window, text = window[same], text[same]
    return text, start[same] - first[text], window, counts


def decontaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """Marks the words of ``docs`` (doc_id, text) inside occurrences of windows of ``items`` (item_id, text).

    One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and text_hash.
    Null and empty texts have no words and no hits; so have items, which then have no window. Items of equal
    text count each; repeated rows of one item_id count as one item; an item without an id marks words but is
    not listed. Other columns are ignored. Without items, or without documents, nothing is hit.

    The benchmark's windows are looked for ``block`` at a time, so what a task and the driver hold is bounded. Each
    pass writes its marks, which name windows by number; they are put together by (doc_id, text_hash), and the items
    of a window are joined on after that.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    windows, holders = item_windows(items, size)
    counts = written(word_counts(docs, windows.select(F.explode("words").alias("word"))), "word-counts")
    blocks = max(1, -(-windows.count() // block))
    passes = [
        written(_marked(docs, _block(windows, counts, blocks, b, size), size), "marks") for b in range(blocks)
    ]
    return _merged(passes, holders)


def _marked(docs: DataFrame, block: Windows, size: int) -> DataFrame:
    """(doc_id, text_hash, n_words, marks) of each row, marks being one block's occurrences as (start, length, window)."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(vars(block).values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Windows(*sent.value)
        for part in sliced(batches, "text"):
            text, start, window, counts = _found(part.column(2), block, size)
            order = np.argsort(text, kind="stable")
            ends = np.cumsum(np.bincount(text, minlength=len(counts)))
            marks = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], ends]).astype(np.int32)),
                pa.StructArray.from_arrays(
                    [pa.array(start[order]), pa.array(block.length[window][order]), pa.array(block.number[window][order])],
                    ["start", "length", "window"],
                ),
            )
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(counts), marks], ["doc_id", "text_hash", "n_words", "marks"]
            )

    return docs.mapInArrow(
        run, "doc_id long, text_hash long, n_words long, marks array<struct<start: long, length: long, window: long>>"
    )


def _merged(passes: list[DataFrame], holders: DataFrame) -> DataFrame:
    """The marks of all passes per text: covered words by a running maximum of ends, items by their windows."""
    key = ["doc_id", "text_hash"]
    marks = reduce(DataFrame.union, (p.select(*key, F.explode("marks").alias("m")).select(*key, "m.*") for p in passes))
    before = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = marks.select(*key, "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    reach = F.coalesce(F.max("end").over(before), F.lit(0))
    covered = spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", reach)))
    hits = covered.groupBy(*key).agg(F.sum("new").alias("n_hit"))
    ids = marks.select(*key, "window").distinct().join(holders, "window").groupBy(*key).agg(
        F.sort_array(F.collect_set("item")).alias("ids")
    )
    out = _null_safe(passes[0].drop("marks"), _null_safe(hits, ids, key), key)
    n_hit, ids = F.coalesce("n_hit", F.lit(0)), F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), "text_hash",
    )


def _null_safe(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    renamed = right.select(*(F.col(c).alias(f"r_{c}") if c in key else F.col(c) for c in right.columns))
    same = [left[c].eqNullSafe(renamed[f"r_{c}"]) for c in key]
    return left.join(renamed, same, "left").drop(*(f"r_{c}" for c in key))
