"""Bounded-space online packing of token sequences."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vitrine.llm.common import durable, tokenizer_path
from vitrine.llm.token_counts import encoder, safe_pieces

CAPACITY = 2048
OPEN_WINDOWS = 32
#: A piece is cut to top up a window that is to be emitted only if both parts have at least so many tokens.
LEAST_CUT = 16
#: Leftover windows of so many partitions meet in one task.
FAN_IN = 16
_PIECE = "doc_id long, start long, length long, ids_crc32 long, ids binary, doc_tokens long, part int, sequence long, offset long, open boolean"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("part", pa.int32()), ("sequence", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_()),
])


class Packer:
    """``open_windows`` open windows of ``capacity``; what ``add`` returns is closed for good.

    A piece goes where it leaves least room (best fit). If it fits nowhere, the fullest window is topped up with a cut of the piece,
    unless a part would be shorter than ``least_cut``, and emitted; an empty window takes its place.
    """

    def __init__(self, capacity: int, open_windows: int, least_cut: int):
        self.capacity, self.least_cut = capacity, least_cut
        self.contents: list[list] = [[] for _ in range(open_windows)]
        self.free = [(capacity, i) for i in range(open_windows)]  # sorted by room, then window

    def add(self, doc_id: int, start: int, ids: np.ndarray, doc_tokens: int) -> Iterator[list]:
        while len(ids):
            at = bisect_left(self.free, (len(ids), -1))
            if at < len(self.free):
                self._put(at, doc_id, start, ids, doc_tokens)
                return
            room, window = self.free[0]
            if room >= self.least_cut and len(ids) - room >= self.least_cut:
                self._put(0, doc_id, start, ids[:room], doc_tokens)
                start, ids = start + room, ids[room:]
                room, window = self.free[0]
            yield self.contents[window]
            self.contents[window] = []
            del self.free[0]
            insort(self.free, (self.capacity, window))

    def _put(self, at: int, doc_id: int, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        room, window = self.free.pop(at)
        self.contents[window].append((doc_id, start, ids, doc_tokens, self.capacity - room))
        insort(self.free, (room - len(ids), window))

    def rest(self) -> list[list]:
        return [x for x in self.contents if x]


def _rows(windows: list[tuple[int, list, bool]], part: int, carry: bool) -> pa.RecordBatch:
    """Pieces of (sequence, pieces, open) as Arrow rows; ids of closed windows are kept only with ``carry``."""
    out: list[list] = [[] for _ in _ARROW]
    for sequence, pieces, still_open in windows:
        for doc_id, start, ids, doc_tokens, offset in pieces:
            raw = np.ascontiguousarray(ids, "<u4").tobytes()
            row = (doc_id, start, len(ids), zlib.crc32(raw), raw if carry or still_open else None, doc_tokens, part, sequence, offset, still_open)
            for column, value in zip(out, row, strict=True):
                column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _ARROW, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS, end_id: int = 1,
         least_cut: int = LEAST_CUT, carry_ids: bool = True) -> DataFrame:
    """Pack the tokens of ``doc_id``, ``text``, each document followed by ``end_id``, into sequences of at most ``capacity`` tokens.

    One row per piece: ``doc_id``, ``start`` (the document's tokens before it), ``length``, ``ids`` (little-endian uint32, only with
    ``carry_ids``), ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` (in the sequence). Whole windows of a long document are
    emitted at once; its rest is packed online in its partition. What is open at the end of ``FAN_IN`` partitions is joined end to end
    and cut at the capacity, so each such set leaves one short sequence.

    A null text is an empty document (one ``end_id``). A row with a null id is packed under a null id; repeated rows are packed each;
    other columns are ignored. Partition contents depend on the input's order, so they are written durably once and never packed anew.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(path)
        packer, sequence, closed, held = Packer(capacity, open_windows, least_cut), 0, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([*map(encode, safe_pieces(text.as_py() or "")), np.array([end_id], np.uint32)])
                whole = len(ids) // capacity * capacity
                done = [[(doc_id, at, ids[at:at + capacity], len(ids), 0)] for at in range(0, whole, capacity)]
                for pieces in [*done, *packer.add(doc_id, whole, ids[whole:].copy(), len(ids))]:
                    closed.append((sequence, pieces, False))
                    sequence += 1
                held += len(ids)
                if held > 1 << 20:
                    yield _rows(closed, part, carry_ids)
                    closed, held = [], 0
        rest = [(sequence + i, pieces, True) for i, pieces in enumerate(packer.rest())]
        if closed or rest:
            yield _rows(closed + rest, part, carry_ids)

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("part", "ascending"), ("sequence", "ascending"), ("offset", "ascending")])
        windows: list[list] = [[]]
        filled = 0
        for doc_id, start, raw, doc_tokens in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
            ids = np.frombuffer(raw, "<u4")
            while len(ids):
                if filled == capacity:
                    windows.append([])
                    filled = 0
                now = ids[:capacity - filled]
                windows[-1].append((doc_id, start, now, doc_tokens, filled))
                start, ids, filled = start + len(now), ids[len(now):], filled + len(now)
        return pa.Table.from_batches([_rows([(i, w, False) for i, w in enumerate(windows)], key[0].as_py(), carry_ids)])

    pieces = durable(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECE))
    closed = pieces.filter(~F.col("open"))
    merged = pieces.filter("open").withColumn("_set", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("_set").applyInArrow(merge, _PIECE)
    wanted = ["doc_id", "start", "length", *["ids"] * carry_ids, "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    # 40 bits of sequence below the partition, and one bit that tells merged windows from the others
    number = F.shiftleft(F.col("part").cast("long"), 40) + F.col("sequence")
    return closed.withColumn("sequence_id", number).select(*wanted).unionAll(merged.withColumn("sequence_id", number + F.lit(1 << 62)).select(*wanted))
