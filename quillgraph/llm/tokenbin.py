"""Token-id output: best-fit-decreasing packing into fixed-length rows of ids.

Each task encodes its documents (ids, then a separator), cuts those longer than a row without loss, and packs runs of
documents into rows: pieces in falling order of length go to the open row with the smallest sufficient room, found by
descending a segment tree over capacities. A row carries its ids as one binary vector of fixed width, the cumulative
lengths of its segments and the positions, which start anew with each segment.

No shuffle and no global state: a run is bounded by RUN_TOKENS, so memory is, and a lost task is redone on its own. Every
document is in the output whole: pieces name their document, number and start.

Nulls and empty texts are a separator alone; repeated rows are packed each; an empty table gives an empty one. Rows of one
document may come several times if the table repeats it; they stay apart by their pieces' own rows. Ids may be of any type and null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, sliced
from .tokens import RankEncoder, Vocabulary

#: Tokens that one packing run gathers before its rows are written.
RUN_TOKENS = 4_000_000


class CapacityTree:
    """Segment tree over rooms 0..capacity; finds the smallest room of at least a size that some open row has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1 - 1).bit_length() if capacity else 1
        while self.leaves < capacity + 1:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """A row with the smallest room of at least ``size``, as (room, row), removed from the tree."""
        at, count = size + self.leaves, self.count
        if size >= len(self.rows):
            return None
        while not count[at]:
            while at & 1:  # a right child: nothing further right below its parent
                at >>= 1
            if at == 0:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.leaves
        row = self.rows[room].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return room, row


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of indexes into ``lengths``, each at most ``capacity`` in all."""
    tree, rows = CapacityTree(capacity), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        size = lengths[k]
        if size > capacity:
            raise ValueError(f"a piece of {size} does not fit a row of {capacity}")
        found = tree.take(size)
        if found is None:
            room, row = capacity, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(k)
        if room > size:
            tree.add(room - size, row)
    return rows


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; the first piece takes what whole rows leave."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def schema(id_type: T.DataType) -> T.StructType:
    ints = T.ArrayType(T.IntegerType())
    return T.StructType(
        [
            T.StructField("partition", T.IntegerType()),
            T.StructField("row", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(id_type)),
            T.StructField("pieces", ints),
            T.StructField("starts", ints),
            T.StructField("cu_seqlens", ints),
            T.StructField("n_tokens", T.IntegerType()),
            T.StructField("input_ids", T.BinaryType()),
            T.StructField("position_ids", T.BinaryType()),
        ]
    )


def pack_token_rows(df: DataFrame, vocabulary_path: str, capacity: int = 2048, separator: int | None = None, pad: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the texts of ``df`` into rows of ``capacity`` ids.

    ``separator`` (the vocabulary's first special token by default) ends each document. ``input_ids`` and ``position_ids`` are
    vectors of ``capacity`` little-endian integers, of 16 bits where the vocabulary allows it, else of 32; unused places hold ``pad`` and
    position 0. ``cu_seqlens`` has 0 and the end of each segment; (partition, row) is unique. Stack rows for a matrix.
    """
    vocabulary = Vocabulary.read(vocabulary_path)
    end = separator if separator is not None else next(iter(vocabulary.specials.values()), 0)
    dtype = "<u2" if len(vocabulary.pieces()) <= 1 << 16 and capacity <= 1 << 16 else "<u4"
    shared = df.sparkSession.sparkContext.broadcast(vocabulary.content)
    work = df.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("__text"))
    out_schema = schema(work.schema["doc"].dataType)

    def rows_of(run: list[tuple], partition: int, first: int, id_type: pa.DataType) -> pa.RecordBatch:
        flat = [(doc, k, start, ids[start : start + size]) for doc, ids in run for k, (start, size) in enumerate(cut(len(ids), capacity))]
        rows = best_fit_decreasing([len(x[3]) for x in flat], capacity)
        matrix, places = np.full((len(rows), capacity), pad, dtype), np.zeros((len(rows), capacity), dtype)
        columns: list[list] = [[], [], [], [], []]
        count = np.arange(capacity, dtype=dtype)
        for r, members in enumerate(rows):
            at, ends = 0, [0]
            for k in members:
                ids = flat[k][3]
                matrix[r, at : at + len(ids)] = ids
                places[r, at : at + len(ids)] = count[: len(ids)]
                at += len(ids)
                ends.append(at)
            for c, values in zip(columns, ([flat[k][0] for k in members], [flat[k][1] for k in members], [flat[k][2] for k in members], ends, at), strict=True):
                c.append(values)
        width = matrix.dtype.itemsize * capacity
        offsets = pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype="<i4").tobytes())
        binary = lambda m: pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(m.tobytes())])
        ints = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([partition] * len(rows), pa.int32()),
                pa.array(range(first, first + len(rows)), pa.int64()),
                pa.array(columns[0], pa.list_(id_type)),
                pa.array(columns[1], ints),
                pa.array(columns[2], ints),
                pa.array(columns[3], ints),
                pa.array(columns[4], pa.int32()),
                binary(matrix),
                binary(places),
            ],
            names=out_schema.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition, first = TaskContext.get().partitionId(), 0
        encoder = RankEncoder(Vocabulary(shared.value))
        held: list[tuple] = []
        held_tokens, id_type = 0, None
        for batch in sliced(batches, "__text"):
            id_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                ids = encoder.encode(text.decode("utf-8", "replace"))
                held.append((doc, np.append(ids, end).astype(dtype)))
                held_tokens += len(ids) + 1
                if held_tokens >= RUN_TOKENS:
                    made = rows_of(held, partition, first, id_type)
                    first += made.num_rows
                    held, held_tokens = [], 0
                    yield from (made.slice(at, 512) for at in range(0, made.num_rows, 512))
        if held:
            made = rows_of(held, partition, first, id_type)
            yield from (made.slice(at, 512) for at in range(0, made.num_rows, 512))

    return work.mapInArrow(run, out_schema)


def write_token_rows(packed: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write packed rows; each Parquet file is a shard whose binary columns stack to id and position matrices."""
    packed.write.mode(mode).parquet(path)


def matrices(shard_path: str, capacity: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Id and position matrices of one written shard."""
    import pyarrow.parquet as pq

    columns = pq.read_table(shard_path, columns=["input_ids", "position_ids"])
    out = []
    for name in ("input_ids", "position_ids"):
        values = columns[name].to_pylist()
        out.append(np.frombuffer(b"".join(values), f"<u{len(values[0]) // capacity}" if values else "<u2").reshape(-1, capacity))
    return out[0], out[1]
