"""Packing documents into training windows by the sum-of-squares rule.

A document is its ids and the end id.  Whole windows are cut off its front; the rest is placed online: of all fill levels
where it fits, and a new window, it goes to the one after which the sum over levels of (number of windows at that level)
squared is smallest, ties to the fullest.  The level array holds those numbers, so a placement looks at no window.
What is still open at the end of a partition, or when the open windows hold more than ``HELD`` ids, is laid end to end and
cut into windows, so there is one window with padding for each HELD ids at most, and memory is bounded whatever the sizes.

One pass over the partitions, no shuffle: a window holds documents of one partition.  A lost task is packed again in the
same way from the same partition, if the input's partitions are stable, as those of a scan are.

Defined results: null or empty text is the end id alone; repeated rows are packed each; an empty table gives no pieces;
of extra columns none is used.  A very long text is tokenized as a whole and its ids leave in whole windows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.vocab import Vocabulary, default_path

WINDOW, END = 2048, 1
#: Ids that open windows hold together.
HELD = 16 << 20
#: Bytes of text that are tokenized at once.
SLICE = 3 << 20


class Packer:
    """Windows of one partition.  A piece is (doc, start, ids, doc_tokens); finished windows are lists of pieces."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)
        self.full: list[list] = []
        self.held = 0

    def _level(self, size: int) -> int:
        """The level to place ``size`` ids at; 0 is a new window."""
        room = self.window - size
        levels = np.flatnonzero(self.count[1 : room + 1]) + 1
        if not len(levels):
            return 0
        change = 2 * (self.count[levels + size] - self.count[levels]) + 2
        if levels[-1] == room:  # a full window is at no level
            change[-1] = 1 - 2 * self.count[room]
        best = len(levels) - 1 - int(np.argmin(change[::-1]))
        return 0 if 2 * self.count[size] + 1 < change[best] else int(levels[best])

    def place(self, piece: tuple) -> None:
        size = len(piece[2])
        level = self._level(size)
        pieces = []
        if level:
            pieces = self.open[level].pop()
            self.count[level] -= 1
        pieces.append(piece)
        self.held += size
        if level + size == self.window:
            self.full.append(pieces)
            self.held -= self.window
        else:
            self.open[level + size].append(pieces)
            self.count[level + size] += 1

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.window
        for start in range(0, whole, self.window):
            self.full.append([(doc, start, ids[start : start + self.window], len(ids))])
        if whole < len(ids):
            self.place((doc, whole, ids[whole:], len(ids)))
            if self.held > HELD:
                self.finish()

    def finish(self) -> None:
        """Closes the open windows, fullest first, cutting pieces where a window ends."""
        room, pieces = self.window, []
        for level in sorted(self.open, reverse=True):
            for doc, start, ids, n in (p for w in self.open[level] for p in w):
                while len(ids):
                    pieces.append((doc, start, ids[:room], n))
                    start, ids, room = start + len(ids[:room]), ids[room:], room - len(ids[:room])
                    if not room:
                        self.full.append(pieces)
                        room, pieces = self.window, []
        if pieces:
            self.full.append(pieces)
        self.open.clear()
        self.count[:] = 0
        self.held = 0


def pack(docs: DataFrame, text: str = "text", vocabulary: str | None = None, window: int = WINDOW, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids."""
    with open(vocabulary or default_path(), encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def rows(windows: list[list], first: int, id_kind: pa.DataType) -> pa.RecordBatch:
        flat = [(p, first + k) for k, w in enumerate(windows) for p in w]
        offsets = [o for w in windows for o in np.cumsum([0] + [len(p[2]) for p in w[:-1]]).tolist()]
        cols = {
            "doc_id": pa.array([p[0] for p, _ in flat], id_kind),
            "start": pa.array([p[1] for p, _ in flat], pa.int64()),
            "length": pa.array([len(p[2]) for p, _ in flat], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(p[2].astype("<u4").tobytes()) for p, _ in flat], pa.int64()),
            "doc_tokens": pa.array([p[3] for p, _ in flat], pa.int64()),
            "sequence_id": pa.array([s for _, s in flat], pa.int64()),
            "offset": pa.array(offsets, pa.int64()),
        }
        if with_ids:
            cols["ids"] = pa.array([p[2].astype(np.int32) for p, _ in flat], pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary.of(source.value)
        packer, number, kind = Packer(window), TaskContext.get().partitionId() << 36, None
        for b in batches:
            kind = b.schema.field("doc_id").type
            texts, sizes = b.column("_text"), np.cumsum(pc.fill_null(pc.binary_length(b.column("_text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(sizes // SLICE)) + 1).tolist(), len(b)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                flat, bounds = vocab.ids(texts.slice(a, z - a))
                for k, doc in enumerate(b.column("doc_id").slice(a, z - a).to_pylist()):
                    packer.add(doc, np.append(flat[bounds[k] : bounds[k + 1]], np.uint32(end)))
                if packer.full:
                    yield rows(packer.full, number, kind)
                    number, packer.full = number + len(packer.full), []
        packer.finish()
        if packer.full:
            yield rows(packer.full, number, kind)

    return docs.select("doc_id", F.col(text).alias("_text")).mapInArrow(run, schema)


def op1(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    return pack(docs, vocabulary=vocabulary, with_ids=False)
