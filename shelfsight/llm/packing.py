"""Best-fit packing of documents into sequences of several permitted lengths.

Pieces are dealt to shards of a bounded number of pieces. In a shard they go, longest first, into the open bin
with the least room that suffices; a new bin is opened where none has. The size to open is chosen bin by bin over all
permitted lengths: each is filled in thought with the longest of the remaining pieces that fit, and the one whose
downsized sequence costs least per packed word is opened. Plans that open one length throughout (a longer piece opens
the least that holds it) are tried beside it. Each bin is downsized to the least permitted length that holds its
contents, and the plan of least cost stays.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.workspace import written


@dataclass(frozen=True)
class Sizes:
    """Permitted lengths, and the cost of a sequence: a fixed part, its length, and a quadratic part."""

    lengths: tuple[int, ...] = (512, 1024, 2048, 4096, 8192)
    fixed: float = 16.0
    quadratic: float = 1 / 32768

    def cost(self, length: int) -> float:
        return self.fixed + length + self.quadratic * length * length

    def least(self, need: int) -> int:
        return min(x for x in self.lengths if x >= need)


class Remaining:
    """Pieces not yet placed, as counts by length."""

    def __init__(self, pieces: list[int]):
        self.count = Counter(pieces)
        self.lengths = sorted(self.count)

    def take(self, piece: int) -> None:
        self.count[piece] -= 1
        if not self.count[piece]:
            self.lengths.pop(bisect_left(self.lengths, piece))

    def fill(self, room: int) -> int:
        """Words that go into ``room`` when the longest remaining piece that fits goes in first."""
        left, end = room, len(self.lengths)
        while left and (end := bisect_right(self.lengths, left, 0, end)):
            end -= 1
            piece = self.lengths[end]
            left -= piece * min(self.count[piece], left // piece)
        return room - left


def cheapest(piece: int, rest: Remaining, sizes: Sizes) -> int:
    """The length whose bin, filled with the piece and what remains, costs least per word; of equals the shortest."""
    best = None
    for length in sorted(x for x in sizes.lengths if x >= piece):
        words = piece + rest.fill(length - piece)
        price = sizes.cost(sizes.least(words)) / words
        if best is None or price < best[0]:
            best = price, length
    return best[1]


def best_fit(pieces: list[int], sizes: Sizes, opened: int | None = None) -> tuple[list[int], list[int]]:
    """Bin of each piece (given longest first) and contents of each bin, opening bins of ``opened`` or more, or of
    the cheapest length for each bin."""
    rooms: list[int] = []  # distinct rooms, ascending
    bins: dict[int, list[int]] = defaultdict(list)  # of each room, last opened on top
    placed, used = [], []
    rest = Remaining(pieces) if opened is None else None
    for piece in pieces:
        if rest is not None:
            rest.take(piece)
        at = bisect_left(rooms, piece)
        if at < len(rooms):
            room = rooms[at]
            number = bins[room].pop()
            if not bins[room]:
                rooms.pop(at)
        else:
            number = len(used)
            room = sizes.least(max(piece, opened)) if rest is None else cheapest(piece, rest, sizes)
            used.append(0)
        placed.append(number)
        used[number] += piece
        if room > piece:
            if not bins[room - piece]:
                insort(rooms, room - piece)
            bins[room - piece].append(number)
    return placed, used


def plan(pieces: list[int], sizes: Sizes) -> tuple[list[int], list[int]]:
    """The bin of each piece and the downsized length of each bin, of least cost over the ways to open bins."""
    best = None
    for opened in (None, *sizes.lengths):
        placed, used = best_fit(pieces, sizes, opened)
        lengths = [sizes.least(u) for u in used]
        cost = sum(map(sizes.cost, lengths))
        if best is None or cost < best[0]:
            best = cost, placed, lengths
    return best[1], best[2]


#: Copies of a row that are listed from one row.
COPIES = 10_000


def packed(
    docs: DataFrame, sizes: Sizes = Sizes(), shard_pieces: int = 20_000, length: Column | None = None
) -> DataFrame:
    """A place for every word of ``docs`` (doc_id, text; other columns are ignored), words being runs without
    white space. With ``length``, a column of counts such as op9's n_tokens, its units take the place of words.

    One row per piece: doc_id, piece, first_word, n_words, bin_id, bin_size, bin_offset. A text longer than the
    greatest permitted length is cut into pieces of that length and a rest. A null text or one without words (a null
    length or one below 1) has one row of 0 words and no bin. Repeated rows are packed each. Of equal pieces the lesser
    doc_id goes first, nulls before. Equal rows are numbered, and pieces dealt by their values and that number, so the
    plan does not depend on how the input is partitioned. Empty input, empty output.
    """
    longest = max(sizes.lengths)
    words = F.expr(r"regexp_count(coalesce(text, ''), r'[^\x20\x09-\x0D]+')")
    counted = docs.select(
        F.col("doc_id").cast("long"), (F.xxhash64("text") if length is None else F.lit(0).cast("long")).alias("text_hash"),
        F.greatest(F.coalesce((words if length is None else length).cast("long"), F.lit(0)), F.lit(0)).alias("total"),
    )
    equal = counted.groupBy("doc_id", "text_hash", "total").agg(F.count("*").alias("copies"))
    blocks = equal.withColumn("block", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")))
    # Written in an even spread, so that many copies of a row are listed by many tasks.
    blocks = written(blocks.repartition("doc_id", "text_hash", "total", "block"), "pieces")
    in_block = f"least(copies - block * {COPIES}, {COPIES})"
    n_pieces = blocks.agg(F.sum(F.expr(f"{in_block} * ((total + {longest - 1}) div {longest})"))).first()[0] or 0
    shards = max(1, -(-n_pieces // shard_pieces))
    pieces = blocks.withColumn(
        "copy", F.explode(F.expr(f"sequence(block * {COPIES}, block * {COPIES} + {in_block} - 1)"))
    ).withColumn("piece", F.explode(F.expr(f"sequence(0L, greatest(total - 1, 0L) div {longest})"))).select(
        "doc_id", "text_hash", "copy", "piece", (F.col("piece") * longest).alias("first_word"),
        F.least(F.col("total") - F.col("piece") * longest, F.lit(longest)).alias("n_words"),
    )

    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(
            ["n_words", "doc_id", "text_hash", "piece", "copy"], ascending=[False, True, True, True, True],
            na_position="first", ignore_index=True,
        )
        placed, lengths = plan(shard["n_words"].tolist(), sizes)
        number = pd.Series(placed)
        shard["bin_id"] = shard["shard"].astype(str) + "-" + number.astype(str)
        shard["bin_size"] = [lengths[b] for b in placed]
        shard["bin_offset"] = shard.groupby(number)["n_words"].cumsum() - shard["n_words"]
        return shard[["doc_id", "piece", "first_word", "n_words", "bin_id", "bin_size", "bin_offset"]]

    schema = (
        "doc_id long, piece long, first_word long, n_words long, bin_id string, bin_size long, bin_offset long"
    )
    dealt = pieces.where("n_words > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_hash", "copy", "piece"), F.lit(shards)))
    full = dealt.groupBy("shard").applyInPandas(pack, schema)
    none = pieces.where("n_words = 0").selectExpr(
        "doc_id", "piece", "first_word", "n_words", "CAST(NULL AS STRING) bin_id", "CAST(NULL AS BIGINT) bin_size",
        "CAST(NULL AS BIGINT) bin_offset",
    )
    return full.union(none)
