"""Packing of documents into sequences of a fixed number of tokens by the sum-of-squares rule, online.

Each task packs its own documents as they come, in one pass without a shuffle. Documents longer than a window give
whole windows first. What is left goes into the fill level that makes the sum of squared counts of partially filled
windows smallest; only the counts per level and the open windows are held. At the end of a task the emptiest open
windows are cut to fill the others, so that one sequence of a task is padded, or none if it ends at a power of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstrata.llm import vocab
from gridstrata.llm.common import as_text
from gridstrata.llm.encode import texts_ids

VOCABULARY = "word_bpe_49k.json"
WINDOW = 4096
END = 2
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

Piece = tuple  # (doc_id, start, ids as bytes, doc_tokens)


class Packer:
    """Open windows by fill level. ``add`` returns the windows that a piece closes, each a list of pieces."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window)]

    def level(self, size: int) -> int:
        """The fill level at which a piece of this size leaves the smallest sum of squares; ties go to the fullest."""
        w, n = self.window, self.count
        # moving one window from level h to h + size changes the sum by 2 · (n[h + size] − n[h]) + 2; a full one leaves
        levels = np.flatnonzero(n[1 : w - size + 1]) + 1
        if not len(levels):
            return 0
        change = 2 * (n[levels + size] - n[levels]) + 2
        change[-1] -= levels[-1] == w - size
        best = len(levels) - 1 - int(np.argmin(change[::-1]))
        return int(levels[best]) if change[best] <= 2 * n[size] + 1 else 0  # a new window leaves no level

    def add(self, piece: Piece, size: int) -> list[Piece] | None:
        h = self.level(size)
        window = self.open[h].pop() if h else []
        self.count[h] -= h > 0
        window.append(piece)
        if h + size == self.window:
            return window
        self.open[h + size].append(window)
        self.count[h + size] += 1
        return None

    def close(self) -> Iterator[list[Piece]]:
        """All open windows: pieces of the emptiest are cut to fill the fullest, so that one of them stays open."""
        full = [w for level in reversed(self.open) for w in level]
        space = [self.window - h for h in range(self.window - 1, -1, -1) for _ in self.open[h]]
        lo, hi = 0, len(full) - 1
        while lo < hi:
            while space[lo] and hi > lo:
                doc, start, ids, total = full[hi].pop()
                n = min(space[lo], len(ids) // 4)
                full[lo].append((doc, start, ids[: 4 * n], total))
                space[lo] -= n
                if 4 * n < len(ids):
                    full[hi].append((doc, start + n, ids[4 * n :], total))
                space[hi] += n
                hi -= not full[hi]
            if not space[lo] or lo < hi:
                yield full[lo]
                lo += 1
        if lo == hi and full[lo]:
            yield full[lo]
        self.__init__(self.window)


def _pack(path: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, end = Packer(window), np.array([END], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        held = 0

        def done(pieces: list[Piece]):
            nonlocal sequence, held
            at = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids) // 4, ids, total, sequence, at))
                at += len(ids) // 4
            sequence += 1
            held += 4 * at

        def out():
            nonlocal held
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            types = [pa.binary() if n == "ids" else pa.int64() for n in names]
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
            rows.clear()
            held = 0
            return batch

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), texts_ids(as_text(batch.column(1)).to_pylist(), path)):
                ids += end
                total = len(ids) // 4
                whole = total - total % window
                for at in range(0, whole, window):
                    done([(doc, at, ids[4 * at : 4 * (at + window)], total)])
                if total > whole and (closed := packer.add((doc, whole, ids[4 * whole :], total), total - whole)):
                    done(closed)
                if held > 1 << 24:
                    yield out()
        for pieces in packer.close():
            done(pieces)
            if held > 1 << 24:
                yield out()
        yield out()

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, start, length, ids, doc_tokens, sequence_id, offset): one per piece of a document in a sequence.

    ``ids`` are little-endian 32-bit numbers: the document's ids from ``start`` on; a document's ids end with id 2, so null
    and empty texts are that id alone. Each row of ``docs`` is a document, also repeated rows and rows with null ids.
    Sequences hold ``window`` ids; one per task may hold fewer. Other columns are not read; an empty table gives no rows.
    """
    path = vocabulary or vocab.vocabulary(VOCABULARY)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pack(path, window), SCHEMA)

