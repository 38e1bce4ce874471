"""Token-id output: best-fit-decreasing packing into rows of one length, written as id matrices.

Texts are encoded with a public byte-level vocabulary. One longer than a row is split without loss into
full rows and a rest. Pieces go largest first into the open row that they leave least room in; a segment
tree over the rooms 0 to ``length`` finds the smallest that is large enough in a logarithmic number of steps.

Rows are packed in windows of ``window_bytes`` of text as a partition is read: nothing is shuffled, a hot key
does not matter and memory is bounded; a lost task reads its split again and makes the same rows. A row
has its ids as little-endian integers of 16 bits, or 32 where the vocabulary needs them, filled up with
``pad``; cumulative segment lengths; and the places where positions start again at 0.

The vocabulary file's path is a parameter. The driver reads it and sends the ranks to the executors: its
size is that of one vocabulary, whatever the data. A null or empty text has no tokens and no piece.
Repeated rows are packed each on their own. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that goes with this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH = 2048
WINDOW_BYTES = 16 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Rooms:
    """A segment tree that counts the open rows of each room."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def least(self, wanted: int) -> int | None:
        """The smallest room of at least ``wanted`` that a row has."""
        i = wanted + self.size
        if self.count[i]:
            return wanted
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_decreasing(sizes: Sequence[int], length: int) -> list[list[int]]:
    """The pieces of each row, in the order they were put in; no size is 0 or above ``length``."""
    rooms, by_room, rows = Rooms(length), {}, []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        room = rooms.least(sizes[i])
        if room is None:
            row, room = len(rows), length
            rows.append([])
        else:
            row = by_room[room].pop()
            rooms.add(room, -1)
        rows[row].append(i)
        if left := room - sizes[i]:
            by_room.setdefault(left, []).append(row)
            rooms.add(left, 1)
    return rows


def positions(cu_seqlens: Sequence[int], length: int) -> np.ndarray:
    """The position ids of a row: 0, 1, 2, ... from each reset on; 0 in the padding."""
    out = np.zeros(length, np.int32)
    for a, b in zip(cu_seqlens[:-1], cu_seqlens[1:], strict=True):
        out[a:b] = np.arange(b - a)
    return out


RESULT = "row_id long, n_tokens int, n_segments int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, starts array<long>"
SCHEMA = pa.schema([("row_id", pa.int64()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()), ("input_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])


def pack_window(docs: list[np.ndarray], ids: Sequence, length: int, pad: int, kind, first_row: int) -> pa.RecordBatch | None:
    """Rows of one window: ``docs`` are token ids, ``ids`` the documents' ids."""
    pieces = [(d, s) for d, tokens in enumerate(docs) for s in range(0, len(tokens), length)]
    if not pieces:
        return None
    sizes = [min(length, len(docs[d]) - s) for d, s in pieces]
    rows = best_fit_decreasing(sizes, length)
    matrix = np.full((len(rows), length), pad, kind)
    cu, owners, starts = [], [], []
    for r, row in enumerate(rows):
        ends = [0]
        for i in row:
            (d, s), n = pieces[i], sizes[i]
            matrix[r, ends[-1] : ends[-1] + n] = docs[d][s : s + n]
            ends.append(ends[-1] + n)
        cu.append(ends)
        owners.append([ids[pieces[i][0]] for i in row])
        starts.append([pieces[i][1] for i in row])
    width = length * matrix.itemsize
    held = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int64) * width), pa.py_buffer(matrix)]).cast(pa.binary())
    columns = [np.arange(first_row, first_row + len(rows)), [c[-1] for c in cu], [len(r) for r in rows], held, cu, [c[:-1] for c in cu], owners, starts]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)


def pack_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, length: int = LENGTH, pad: int = 0, window_bytes: int = WINDOW_BYTES) -> DataFrame:
    """A row for each packed row; segment i has the tokens of doc_ids[i] from starts[i] on."""
    ranks = read_ranks(vocabulary)
    kind = np.uint16 if max(max(ranks.values()), pad) < 1 << 16 else np.uint32
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        import tiktoken

        encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        row, held, ids, size = TaskContext.get().partitionId() << 33, [], [], 0

        for batch in batches:
            for a, b in slices(batch.column(1), window_bytes):
                texts = batch.column(1).slice(a, b)
                for i, text in zip(batch.column(0).slice(a, b).to_pylist(), texts.to_pylist(), strict=True):
                    if text:
                        held.append(encoder.encode_to_numpy(text, disallowed_special=()).astype(kind))
                        ids.append(i)
                        size += len(text)
                if size >= window_bytes and (made := pack_window(held, ids, length, pad, kind, row)):
                    row, held, ids, size = row + made.num_rows, [], [], 0
                    yield made
        if made := pack_window(held, ids, length, pad, kind, row):
            yield made

    return df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text")).mapInArrow(run, RESULT)


def write_matrices(packed: DataFrame, path: str) -> DataFrame:
    """Write the packed rows as a table under ``path``, in any store that Spark reaches, and read them back.

    input_ids has one width in all rows, so the values of a file, one after the other, are its id matrix:
    see ``matrix``."""
    packed.write.option("compression", "zstd").parquet(path)
    return packed.sparkSession.read.parquet(path)


def matrix(rows: Sequence[bytes], length: int = LENGTH, wide: bool = False) -> np.ndarray:
    """The id matrix of input_ids values."""
    return np.frombuffer(b"".join(rows), "<u4" if wide else "<u2").reshape(-1, length)
