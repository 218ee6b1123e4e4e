"""Sum-of-squares online packing of token ids into windows.

Documents come one by one. Full windows are cut off a long one; the rest goes to the fill level at which the sum of
the squared numbers of partially filled windows per level becomes least, an empty window being level 0. The numbers
stand in an array by level, so that a placement looks at every level at once and at no window.
"""

from __future__ import annotations

from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank, small_batches
from .encoding import Encoder, portions

#: Stretches in a generation of a worker's cache of ids: packing holds little else.
KEPT = 1_000_000

SCHEMA = "{key} {type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Levels:
    """Partially filled windows by fill level. put() takes pieces (key, start, ids, doc_tokens) and yields the windows that become full."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]

    def level_for(self, size: int) -> int:
        """The level whose window takes `size`: that of the least sum of squares afterwards, the fullest of equals; 0 opens one.

        Moving a window from h to h + size changes the sum by 2 (counts[h + size] - counts[h]) + 2; an empty window or a
        full one counts nothing.
        """
        here = self.counts[: self.window + 1 - size]
        change = 2 * (self.counts[size:] - here) + 2
        change[0] -= 1
        change[-1] -= 1
        change[1:][here[1:] == 0] = np.iinfo(np.int64).max
        return self.window - size - int(change[::-1].argmin())

    def put(self, piece: tuple):
        size = len(piece[2]) // 4
        h = self.level_for(size)
        if h:
            self.counts[h] -= 1
            pieces = self.open[h].pop()
        else:
            pieces = []
        pieces.append(piece)
        if h + size == self.window:
            yield pieces
        else:
            self.counts[h + size] += 1
            self.open[h + size].append(pieces)

    def close(self):
        """The windows left, filled up: pieces of the emptiest are cut to fill the fullest, so that one stays partly filled."""
        left = [w for level in reversed(self.open) for w in reversed(level)]
        while left:
            window = left.pop(0)
            room = self.window - sum(len(p[2]) // 4 for p in window)
            while room and left:
                source = left[-1]
                key, start, ids, total = source.pop()
                n = min(room, len(ids) // 4)
                window.append((key, start, ids[: 4 * n], total))
                room -= n
                if 4 * n < len(ids):
                    source.append((key, start + n, ids[4 * n :], total))
                if not source:
                    left.pop()
            yield window


def _pack(batches, path: str, end_id: int, window: int, schema: pa.Schema):
    encoder, levels = Encoder.of(path, KEPT), Levels(window)
    first, end = TaskContext.get().partitionId() << 40, end_id.to_bytes(4, "little")
    names, serial = schema.names, 0

    def rows(windows):
        nonlocal serial
        for pieces in windows:
            offset = 0
            for key, start, ids, total in pieces:
                n = len(ids) // 4
                yield key, start, n, crc32(ids), total, first + serial, offset
                offset += n
            serial += 1

    def out(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], names=names)

    def document(key, ids: bytes):
        ids += end
        total, full = len(ids) // 4, len(ids) // 4 // window * window
        for at in range(0, full, window):
            yield [(key, at, ids[4 * at : 4 * (at + window)], total)]
        if full < total:
            yield from levels.put((key, full, ids[4 * full :], total))

    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in portions(texts):
            found = [r for key, ids in zip(keys[a:b], encoder.encode(texts[a:b]), strict=True) for r in rows(document(key, ids))]
            if found:
                yield out(found)
    found = list(rows(levels.close()))
    if found:
        yield out(found)


def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = 1, window: int = 2048) -> DataFrame:
    """Pieces of all rows of `docs`: `key`, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and `end_id`; a null or empty text is that id alone. Every id lies in one piece. Each task
    packs the rows of its input split as they come, without a shuffle, holding the pieces of partly filled windows
    only; at its end it cuts pieces to fill those up, so that a task leaves one window partly filled. Window ids carry
    the partition's number. A task run again after a loss gives the same rows. Repeated rows are packed each; an empty
    table gives no rows. `window` is 2 at least.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), blank(text).alias("_text"))
    schema = SCHEMA.format(key=f"`{key}`", type=kind)
    arrow = pa.schema([(key, pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64())] + [(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    return rows.mapInArrow(partial(_pack, path=tokenizer, end_id=end_id, window=window, schema=arrow), schema)
