"""Operator 6: bounded-space online best-fit packing of token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .held import slices
from .storage import materialize
from .wordbpe import encoder

PIECES = "_id long, piece int, start long, length long, ids_crc32 long, seq long, offset long, open boolean"


class BestFit:
    """At most ``bins`` open bins of ``capacity``; bit f of ``free`` is set while an open bin has f tokens left.

    An item goes to the open bin with the least room that still takes it (lowest set bit at or above its
    length).  If none does and all bins are open, the fullest one closes to make room for a new bin.
    """

    def __init__(self, capacity: int, bins: int, first: int):
        self.capacity, self.bins, self.next = capacity, bins, first
        self.free, self.stacks, self.held, self.count = 0, {}, {}, 0
        self.closed: list = []

    def _take(self, room: int) -> int:
        stack = self.stacks[room]
        seq = stack.pop()
        if not stack:
            del self.stacks[room]
            self.free ^= 1 << room
        return seq

    def add(self, length: int, rows: list) -> None:
        """Place ``rows`` (lists whose item 5 and 6 are sequence and offset) as one block of ``length`` tokens."""
        fit = self.free >> length
        if fit:
            room = length + (fit & -fit).bit_length() - 1
            seq = self._take(room)
        else:
            if self.count == self.bins:
                fullest = (self.free & -self.free).bit_length() - 1
                self.closed.append(self.held.pop(self._take(fullest)))
                self.count -= 1
            seq, room = self.next, self.capacity
            self.next += 1
            self.held[seq] = []
            self.count += 1
        base = self.capacity - room
        for r in rows:
            r[5], r[6] = seq, r[6] + base
        self.held[seq] += rows
        room -= length
        if room == 0:
            self.closed.append(self.held.pop(seq))
            self.count -= 1
        else:
            if room not in self.stacks:
                self.stacks[room] = []
                self.free |= 1 << room
            self.stacks[room].append(seq)


def _batch(groups: list, is_open: bool) -> pa.RecordBatch:
    rows = [r for g in groups for r in g]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([*columns, pa.array([is_open] * len(rows), pa.bool_())], names)


def _pack(path: str, capacity: int, bins: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).encode_all, end_id.to_bytes(4, "little")
        packer = BestFit(capacity, bins, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for part in slices(batch):
                for key, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        packer.add(len(cut) // 4, [[key, piece, at // 4, len(cut) // 4, zlib.crc32(cut), 0, 0]])
            if packer.closed:
                yield _batch(packer.closed, False)
                packer.closed = []
        yield _batch(packer.closed, False)
        yield _batch(list(packer.held.values()), True)

    return run


def _merge(capacity: int, bins: int):
    """Open bins of all tasks, each one block, packed again by the same rule; rows come sorted by bin."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = BestFit(capacity, bins, (1 << 61) + (TaskContext.get().partitionId() << 32))
        names = [x.split()[0] for x in PIECES.split(", ")]
        held: list = []

        def place(block: list) -> None:
            packer.add(sum(r[3] for r in block), block)

        def drain(groups: list) -> pd.DataFrame:
            rows = [[*r, False] for g in groups for r in g]
            return pd.DataFrame(rows, columns=names)

        for frame in frames:
            for row in frame[names[:7]].astype(object).to_numpy().tolist():
                if held and held[-1][5] != row[5]:
                    place(held)
                    held = []
                held.append(row)
            if packer.closed:
                yield drain(packer.closed)
                packer.closed = []
        if held:
            place(held)
        if packer.closed or packer.held:
            yield drain([*packer.closed, *packer.held.values()])

    return run


def pack_best_fit(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = 4096, bins: int = 1024, end_id: int = 1,
) -> DataFrame:
    """``docs`` -> one row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids followed by ``end_id``; one longer than ``capacity`` is cut into pieces of
    exactly that many (the last may be shorter).  Every scan task packs its own pieces in one pass with a fixed
    number of open bins, so memory doesn't depend on the input and no text is shuffled.  Bins that are still
    open when a task ends are packed once more, whole, among themselves: their narrow rows are dealt by bin into
    as many tasks as their tokens need.  Null text is empty: a single ``end_id``.  Repeated, null and tied ids
    keep their rows; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    first = materialize(rows.mapInArrow(_pack(tokenizer_path, capacity, bins, end_id), PIECES), "pieces")
    left = first.where("open")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-tokens // (capacity * bins * 4)))
    again = left.repartition(tasks, "seq").sortWithinPartitions("seq", "offset").mapInPandas(_merge(capacity, bins), PIECES)
    return first.where("not open").union(again).select(
        F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), "offset"
    )
