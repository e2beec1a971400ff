"""Best-fit packing by exact-complement hashing.

Documents are encoded and cut into pieces of at most ``capacity`` tokens. What the packing needs of the corpus is how many
pieces have which length, at most ``capacity`` numbers however large the corpus is. Over these counts a plan is made on
the driver: for each open gap, hashes of single lengths, of pair sums and of triple sums give the combinations that fill it
exactly; as many sequences are made of one as the counts allow. What then is left goes by best fit, longest first. A plan
line stands for any number of equal sequences and each step of the plan uses up a length or a kind of gap, so its size
depends on ``capacity`` alone.

Pieces then find their place without meeting in one task: a piece's rank among those of its length comes from its rank
in a cell of (length, salt), plus the sizes of the cells before it. There are enough salts that a length which a third of all
pieces have is spread too. Ranges of ranks of the plan give sequence and offset.

Nulls and empty texts are an end token alone. Repeated rows are packed each. An empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import as_bytes, materialize, sliced
from .tokenbin import cut
from .tokens import RankEncoder, Vocabulary

#: Pieces that a cell of (length, salt) is meant to hold, and the most salts a length gets (so many sizes meet in one window).
CELL_PIECES, MOST_SALTS = 256, 4096


class ComplementIndex:
    """Which combinations of lengths sum to what, by hashing; entries whose lengths are used up are dropped as they are met."""

    def __init__(self, counts: dict[int, int]):
        self.counts = counts
        self.lengths = sorted(counts)
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        self.triples: dict[int, list[int]] = {}

    def left(self, items: tuple[int, ...]) -> int:
        """How many times these lengths can be taken together."""
        return min(self.counts[x] // items.count(x) for x in items)

    # ``taken``: lengths that the combination goes with. One that only clashes with these is passed over, not dropped.
    def single(self, total: int, taken: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        return (total,) if self.counts.get(total) and self.left((*taken, total)) else None

    def pair(self, total: int, taken: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        if total not in self.pairs:
            top = [a for a in self.lengths[: bisect_left(self.lengths, total)] if 2 * a >= total]
            self.pairs[total] = [(a, total - a) for a in top if self.counts[a] and self.counts.get(total - a)]
        found = self.pairs[total]
        for k in range(len(found) - 1, -1, -1):
            if self.left((*taken, *found[k])):
                return found[k]
            if not self.left(found[k]):
                del found[k]
        return None

    def triple(self, total: int, taken: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        if total not in self.triples:
            self.triples[total] = [a for a in self.lengths[: bisect_left(self.lengths, total)] if self.counts[a] and 3 * a >= total]
        found = self.triples[total]
        for k in range(len(found) - 1, -1, -1):
            a = found[k]
            if self.counts[a] and (rest := self.pair(total - a, (*taken, a))):
                return (a, *rest)
            if not (self.counts[a] and self.pair(total - a, (a,))):
                del found[k]
        return None


Plan = list[tuple[int, tuple[int, ...]]]


def plan_sequences(lengths: dict[int, int], capacity: int) -> Plan:
    """(how many, lengths) of the sequences that hold all pieces, given how many pieces have each length.

    Combinations that use up small lengths early can leave large ones without a partner, so plans with exact fills of up to one,
    two and three lengths are made and the one of fewest sequences is taken.
    """
    return min((_plan(lengths, capacity, most) for most in (3, 2, 1)), key=lambda plan: sum(n for n, _ in plan))


def _plan(lengths: dict[int, int], capacity: int, most: int) -> Plan:
    counts = {k: n for k, n in lengths.items() if n}
    plan: Plan = []
    index = ComplementIndex(counts)

    def use(n: int, items: tuple[int, ...]) -> None:
        plan.append((n, items))
        for x in items:
            counts[x] -= n

    for size in sorted(counts, reverse=True):
        if size == capacity and counts[size]:
            use(counts[size], (size,))
        while counts[size]:
            gap = capacity - size
            rest = next((r for find in (index.single, index.pair, index.triple)[:most] if (r := find(gap, (size,)))), None)
            if rest is None:
                break
            use(index.left((size, *rest)), (size, *rest))
    # Best fit for what is left: groups of equal open sequences by room.
    rooms: list[int] = []
    groups: dict[int, list[list]] = {}

    def open_group(room: int, n: int, items: tuple[int, ...]) -> None:
        if room == 0:
            plan.append((n, items))
            return
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append([n, items])

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                if n >= each:
                    open_group(capacity - each * size, n // each, (size,) * each)
                    n -= n // each * each
                else:
                    open_group(capacity - n * size, 1, (size,) * n)
                    n = 0
                continue
            room = rooms[at]
            group = groups[room][-1]
            fits = room // size
            take = min(group[0], n // fits) if n >= fits else 1
            each = fits if n >= fits else n
            group[0] -= take
            items = group[1]
            if not group[0]:
                groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            open_group(room - each * size, take, items + (size,) * each)
            n -= take * each
    for room in rooms:
        plan += [(n, items) for n, items in groups[room]]
    return plan


def ranges(plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces by (length, rank): sorted keys of where ranges begin, and each range's first sequence less its first rank, and offset."""
    key, base, offset = [], [], []
    used: dict[int, int] = {}
    sequence = 0
    for n, items in plan:
        at = 0
        for size in items:
            rank = used.get(size, 0)
            key.append((size << 44) | rank)
            base.append(sequence - rank)
            offset.append(at)
            used[size] = rank + n
            at += size
        sequence += n
    order = np.argsort(np.array(key, "i8"))
    return np.array(key, "i8")[order], np.array(base, "i8")[order], np.array(offset, "i8")[order]


def token_pieces(df: DataFrame, vocabulary_path: str, capacity: int, end_token: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each piece: its document's id, number, start, length and the CRC of its ids."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary_path).content)
    work = df.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("__text"))
    fields = [T.StructField("doc", work.schema["doc"].dataType), T.StructField("piece", T.IntegerType())]
    schema = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = RankEncoder(Vocabulary(shared.value))
        for batch in sliced(batches, "__text"):
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(as_bytes(batch.column(1))):
                ids = np.append(encoder.encode(text.decode("utf-8", "replace")), end_token).astype("<u4")
                for k, (at, size) in enumerate(cut(len(ids), capacity)):
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[at : at + size]))
            long = pa.int64()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, long), pa.array(length, long), pa.array(crc, long)], names=schema.names)

    return work.mapInArrow(run, schema)


def place_pieces(pieces: DataFrame, plan: Plan, n: int) -> DataFrame:
    """Add sequence_id and offset to pieces (any columns beside ``length``; ``n`` rows) under a plan for their lengths."""
    salts = max(1, min(MOST_SALTS, n // CELL_PIECES))
    columns = pieces.columns
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int"))
    cells = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy("length", "__salt").orderBy(*columns)
    ranked = salted.withColumn("__rank", F.row_number().over(within) - 1).join(cells, ["length", "__salt"])
    shared = pieces.sparkSession.sparkContext.broadcast(ranges(plan))
    work = ranked.select(*columns, (F.col("__rank") + F.col("__before")).cast("long").alias("__rank"))
    size_at = columns.index("length")
    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base, offset = shared.value
        for batch in batches:
            rank = batch.column(len(columns)).to_numpy()
            at = np.searchsorted(key, (batch.column(size_at).to_numpy() << 44) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(base[at] + rank), pa.array(offset[at])], names=out.names)

    return work.mapInArrow(run, out)


def best_fit_packing(df: DataFrame, vocabulary_path: str, capacity: int = 2048, end_token: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens; one row for each piece with its place.

    Pieces (about 40 bytes each, no texts) are written to the shared folder once, so that counts and places see the same rows.
    """
    pieces = materialize(token_pieces(df, vocabulary_path, capacity, end_token, id_col, text_col), "pieces")
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    placed = place_pieces(pieces, plan_sequences(lengths, capacity), sum(lengths.values()))
    return placed.withColumnRenamed("doc", id_col)


__all__ = ["best_fit_packing", "place_pieces", "plan_sequences", "ranges", "token_pieces"]
