"""Token ids in wavelet-matrix files, one matrix per shard and file, documents in order of doc_id.

Texts are tokenized in pieces: white space and the characters after it, cut where the tokenizer's own pattern
always cuts, so a piece has the same ids wherever it stands. Each distinct piece is encoded once per worker as
long as its store has room.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsight.llm.bytewords import prefix_sums, ragged_ranges, sliced, span_hashes, text_buffer
from shelfsight.llm.wavelet import WaveletMatrix
from shelfsight.workspace import new_folder, written

END = 2
#: Tokens after which a shard is closed (at a document's end), which bounds what a task holds.
SHARD_TOKENS = 1 << 22
#: Encoded pieces that a worker keeps, some 60 bytes each.
STORED_PIECES = 1_000_000
TEXT_SLICE = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_GRAPH = np.zeros(256, bool)
_GRAPH[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_BREAK = np.zeros(256, bool)
_BREAK[0x09:0x0E] = True
#: Not ' which may begin a contraction, and not | which stands inside an added token.
_MARK = _GRAPH & ~_LETTER & ~_DIGIT
_MARK[[ord("'"), ord("|")]] = False
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True  # two-byte characters, none of them white space


def piece_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Starts of pieces: text starts, white space after a character known not to be white space, marks after an ASCII
    letter, and ASCII letters after a single line break or tab."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        now, before = data[1:], data[:-1]
        solid = _GRAPH[before]
        solid[1:] |= (before[1:] >= 0x80) & (before[1:] < 0xC0) & _LEAD[data[:-2]]
        cut[1:-1] = (_SPACE[now] & solid) | (_MARK[now] & _LETTER[before])
        cut[2:-1] |= _LETTER[now[1:]] & _BREAK[before[1:]] & solid[:-1]
    cut[at] = True
    return np.flatnonzero(cut[:-1])


#: A number of its own kind: always cut from a piece before it that does not end in white space, and from one behind it
#: that begins with white space or a visible ASCII character other than a digit.
SEPARATOR = " \u2167"
JOINED = 1024


class PieceEncoder:
    """Ids of texts by way of a bounded store of encoded pieces.

    The store is columns in order of the pieces' hashes, looked up for a whole slice at once; the bytes of a piece are
    compared before its ids are used. When it is full, the pieces not used for longest go.
    """

    def __init__(self, path: str, stored: int = STORED_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.stored, self.slices = Tokenizer.from_file(path), stored, 0
        self.separator = np.array(self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids, np.uint32)
        self.names, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.byte_at, self.size, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def ids_of(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of ``raw`` in a row, and the number of each. Pieces that a separator keeps apart are
        encoded many in one text."""
        data = np.frombuffer(raw, np.uint8)
        first, last = data[starts], data[ends - 1]
        solid = _GRAPH[last] | ((last >= 0x80) & (last < 0xC0) & _LEAD[data[np.maximum(ends - 2, starts)]])
        apart = (_SPACE[first] | _GRAPH[first]) & ~_DIGIT[first] & solid
        lists: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(starts)
        together, alone = np.flatnonzero(apart), np.flatnonzero(~apart).tolist()
        groups = [together[k : k + JOINED].tolist() for k in range(0, len(together), JOINED)]
        a, b = starts.tolist(), ends.tolist()
        mark = SEPARATOR.encode()
        texts = [mark.join([raw[a[i] : b[i]] for i in group]).decode() for group in groups]
        for group, one in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids, n = np.array(one.ids, np.uint32), len(self.separator)
            hits = np.ones(max(len(ids) - n + 1, 0), bool)
            for k in range(n):
                hits &= ids[k : k + len(hits)] == self.separator[k]
            cuts = np.flatnonzero(hits)
            if len(cuts) != len(group) - 1:  # a piece holds the separator
                alone += group
                continue
            for i, x, y in zip(group, [0, *(cuts + n).tolist()], [*cuts.tolist(), len(ids)], strict=True):
                lists[i] = ids[x:y]
        for i, one in zip(
            alone, self.tokenizer.encode_batch_fast([raw[a[i] : b[i]].decode() for i in alone], add_special_tokens=False),
            strict=True,
        ):
            lists[i] = np.array(one.ids, np.uint32)
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.concatenate([np.zeros(0, np.uint32), *lists]), lengths

    def _shrink(self) -> None:
        """Drops the pieces not used for longest, down to half of the store."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: self.stored // 2])
        at, length, byte_at, size = self.at[keep], self.length[keep], self.byte_at[keep], self.size[keep]
        self.ids, self.bytes = self.ids[ragged_ranges(at, length)], self.bytes[ragged_ranges(byte_at, size)]
        self.names, self.used, self.length, self.size = self.names[keep], self.used[keep], length, size
        self.at, self.byte_at = np.cumsum(length) - length, np.cumsum(size) - size

    def _learn(self, names: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        """Adds pieces that are not in the store; ``names`` in order."""
        ids, lengths = self.ids_of(raw, starts, ends)
        sizes = ends - starts
        place = np.searchsorted(self.names, names)
        new = {
            "names": names, "used": np.full(len(names), self.slices), "length": lengths, "size": sizes,
            "at": len(self.ids) + np.cumsum(lengths) - lengths, "byte_at": len(self.bytes) + np.cumsum(sizes) - sizes,
        }
        for name, values in new.items():
            setattr(self, name, np.insert(getattr(self, name), place, values))
        self.ids = np.concatenate([self.ids, ids])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(raw, np.uint8)[ragged_ranges(starts, sizes)]])

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids with END after each text, and the number of ids of each."""
        texts = len(at) - 1
        starts = piece_starts(data, at)
        ends = np.append(starts[1:], len(data))
        full = ends > starts
        starts, ends = starts[full], ends[full]
        hashes = span_hashes(prefix_sums(data), starts, ends)
        order = np.argsort(hashes)
        sorted_ = hashes[order]
        new = np.ones(len(order), bool)
        new[1:] = sorted_[1:] != sorted_[:-1]
        names, which = sorted_[new], np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        one = order[new]
        raw, sizes = data.tobytes(), ends - starts
        self.slices += 1
        if len(self.names) > self.stored:
            self._shrink()
        place = np.searchsorted(self.names, names)
        known = place < len(self.names)
        known[known] = self.names[place[known]] == names[known]
        if not known.all():
            self._learn(names[~known], raw, starts[one[~known]], ends[one[~known]])
            place = np.searchsorted(self.names, names)
        self.used[place] = self.slices
        entry = place[which]
        # Equal hashes of different bytes: those pieces are encoded by themselves.
        other = np.flatnonzero(self.size[entry] != sizes)
        if not len(other):
            unlike = self.bytes[ragged_ranges(self.byte_at[entry], sizes)] != data[ragged_ranges(starts, sizes)]
            other = np.unique(np.searchsorted(np.cumsum(sizes), np.flatnonzero(unlike), "right"))
        else:
            other = np.flatnonzero(
                [raw[x:y] != self.bytes[p : p + n].tobytes() for x, y, p, n in zip(starts, ends, self.byte_at[entry], self.size[entry])]
            )
        begin, length, ids = self.at[entry], self.length[entry], self.ids
        if len(other):
            own, lengths = self.ids_of(raw, starts[other], ends[other])
            begin[other], length[other] = len(ids) + np.cumsum(lengths) - lengths, lengths
            ids = np.concatenate([ids, own])
        piece_ends = np.concatenate([[0], np.cumsum(length)])
        text_first = np.searchsorted(starts, at)
        counts = np.diff(piece_ends[text_first])
        out = np.full(int(counts.sum()) + texts, END, np.uint32)
        filled = np.ones(len(out), bool)
        filled[np.cumsum(counts + 1) - 1] = False
        out[filled] = ids[ragged_ranges(begin, length)]
        return out, counts + 1


def _encoder(path: str) -> PieceEncoder:
    """The worker's encoder, kept between tasks: functions are sent anew with each task, modules stay."""
    held = sys.modules.setdefault("shelfsight_worker_state", types.ModuleType("shelfsight_worker_state"))
    encoders = held.__dict__.setdefault("encoders", {})
    if path not in encoders:
        encoders[path] = PieceEncoder(path)
    return encoders[path]


_FILE = (
    "part int, number int, size long, doc_ids array<long>, lengths array<long>, alphabet binary, "
    "planes array<binary>, zeros array<long>, ranks array<binary>"
)


def _shard_row(part: int, number: int, ids: list, docs: list[pa.Array], lengths: list[np.ndarray]) -> pa.RecordBatch:
    matrix = WaveletMatrix.build(np.concatenate(ids))
    binaries = pa.list_(pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([matrix.size], pa.int64()),
            pa.array([pa.concat_arrays(docs).to_pylist()], pa.list_(pa.int64())),
            pa.array([np.concatenate(lengths)], pa.list_(pa.int64())),
            pa.array([matrix.alphabet.tobytes()], pa.binary()),
            pa.array([[p.tobytes() for p in matrix.planes]], binaries),
            pa.array([matrix.zeros], pa.list_(pa.int64())),
            pa.array([[r.tobytes() for r in matrix.ranks]], binaries),
        ],
        ["part", "number", "size", "doc_ids", "lengths", "alphabet", "planes", "zeros", "ranks"],
    )


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the ids of every text of ``docs`` (doc_id, text), END after each, to ``folder``: one file per shard
    with the matrix, and the doc_id and length of each document. Order: doc_id, then text hash; nulls first. Null
    texts are empty. Repeated rows are stored each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, names, lengths, held = [], [], [], 0
        for rows in sliced(batches, "text", TEXT_SLICE):
            got, counts = encoder.encode(*text_buffer(rows.column(1)))
            ids.append(got)
            names.append(rows.column(0))
            lengths.append(counts)
            held += len(got)
            if held >= shard_tokens:
                yield _shard_row(part, number, ids, names, lengths)
                ids, names, lengths, held, number = [], [], [], 0, number + 1
        if held:
            yield _shard_row(part, number, ids, names, lengths)

    given = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = (
        given.withColumn("text_hash", F.xxhash64("text")).repartitionByRange("doc_id", "text_hash")
        .sortWithinPartitions("doc_id", "text_hash").select("doc_id", "text")
    )
    files = ordered.mapInArrow(run, _FILE).write.option("maxRecordsPerFile", 1).option("compression", "zstd")
    files.parquet(folder)


def matrix_of(row: dict) -> WaveletMatrix:
    """The matrix of a row of a token file."""
    return WaveletMatrix(
        row["size"], np.frombuffer(row["alphabet"], np.uint32), [np.frombuffer(p, np.uint8) for p in row["planes"]],
        list(row["zeros"]), [np.frombuffer(r, np.uint32) for r in row["ranks"]],
    )


def read_token_files(files: DataFrame) -> DataFrame:
    """(part, number, doc_id, inner, n_tokens, ids_crc32) of each document of token files; ``inner`` is its start
    in its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
                ids = matrix_of(row).tokens().astype("<u4")
                ends = np.cumsum(np.array(row["lengths"], np.int64))
                starts = np.concatenate([[0], ends[:-1]])
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["number"]] * n, pa.int32()),
                     pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(ends - starts),
                     pa.array(crc, pa.int64())],
                    ["part", "number", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    columns = ["size", "doc_ids", "lengths", "alphabet", "planes", "zeros", "ranks"]
    return files.select("part", "number", *columns).mapInArrow(
        run, "part int, number int, doc_id long, inner long, n_tokens long, ids_crc32 long"
    )


def token_index(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Writes token files and reads them back: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    Every document has END, so an empty or null text has one token. Equal doc_ids follow in order of text hash.
    Other columns are ignored. Empty input, empty output.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    write_token_files(docs, tokenizer, folder)
    files = spark.read.schema(_FILE).parquet(folder)
    read = written(read_token_files(files), "token-index")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.select("part", "number", "size").withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return read.join(shards.drop("size"), ["part", "number"]).select(
        "doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32"
    )
