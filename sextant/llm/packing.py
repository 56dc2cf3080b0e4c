"""Packing of token sequences: best-fit decreasing over a segment tree of remaining capacities.

Each task packs its own partition: documents are encoded, overlong ones are cut into full
windows (a sequence each), and the remainders go, longest first, into the tightest open window that still takes them. The pieces are written, and those in windows that a
task left with more than ``SLACK`` per cent of padding are packed again, over all tasks, so padding does not depend on how the input is partitioned.
Only piece lengths are held while packing, at most ``block_pieces`` at a time; ids are dropped as soon as their checksum is known, and only the rows of loose pieces are shuffled.

Defined cases: a null or empty text is the end id alone; an empty table gives no rows; repeated rows are packed one by one;
equal lengths go in the order of doc_id, then text checksum; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm import encoding
from sextant.llm.common import materialize

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
#: Padding of a window (per cent) beyond which a task gives its pieces to the second packing.
SLACK = 1


class CapacityTree:
    """Open windows by remaining capacity; a segment tree of counts finds the smallest capacity that is at least n."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, capacity: int, window_id: int) -> None:
        self.open[capacity].append(window_id)
        self._add(capacity, 1)

    def _add(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest window with room for ``n``; None if there is none."""
        at = n + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        self._add(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window number, offset) for each length, taken in the given order, which should be descending."""
    tree, out, n = CapacityTree(window), [], 0
    for x in lengths:
        got = tree.take(x)
        if got is None:
            got, n = (window, n), n + 1
        left, at = got
        out.append((at, window - left))
        if left > x:
            tree.put(left - x, at)
    return out


def _emit(pieces: list[tuple], first: int, window: int, slack: int | None) -> tuple[pa.RecordBatch, int]:
    """Pack pieces (doc_id, start, length, crc, doc_tokens); window numbers start at ``first``. With ``slack``, pieces in windows that are emptier get none."""
    pieces.sort(key=lambda p: (-p[2], p[0] is None, p[0] or 0, p[3], p[1]))
    places = best_fit_decreasing([p[2] for p in pieces], window)
    n = 1 + max((s for s, _ in places), default=-1)
    filled = [0] * n
    for p, (s, _) in zip(pieces, places, strict=True):
        filled[s] += p[2]
    loose = [slack is not None and 100 * (window - x) > slack * window for x in filled]
    cols = [[p[k] for p in pieces] for k in range(5)] + [[None if loose[s] else first + s for s, _ in places], [None if loose[s] else o for s, o in places]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], NAMES), first + n


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, block_pieces: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document: where it lies in the document and in which sequence.

    Sequence ids are the task's number times 2^33 plus a count, so they are unique and repeat when a lost task is run again; those of the second packing start at 2^61.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        enc, end = encoding.encoder(tokenizer), np.array([end_id], np.uint32)
        at = TaskContext.get().partitionId() << 33
        pieces: list[tuple] = []
        for part in parts:
            keys = part.column(0)
            for first, texts in encoding.batches(part.column(1)):
                for k, ids in enumerate(enc.encode(texts)):
                    ids, doc = np.concatenate([ids, end]), keys[first + k].as_py()
                    pieces += [(doc, s, min(window, len(ids) - s), encoding.crc32(ids[s : s + window]), len(ids)) for s in range(0, len(ids), window)]
                while len(pieces) >= block_pieces:
                    batch, at = _emit(pieces[:block_pieces], at, window, SLACK)
                    pieces = pieces[block_pieces:]
                    yield batch
        if pieces:
            yield _emit(pieces, at, window, SLACK)[0]

    def again(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = (1 << 28) + TaskContext.get().partitionId() << 33
        pieces: list[tuple] = []
        for part in parts:
            pieces += zip(*(c.to_pylist() for c in part.columns[:5]), strict=True)
            while len(pieces) >= block_pieces:
                batch, at = _emit(pieces[:block_pieces], at, window, None)
                pieces = pieces[block_pieces:]
                yield batch
        if pieces:
            yield _emit(pieces, at, window, None)[0]

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    packed = materialize(rows.mapInArrow(run, SCHEMA), "pieces")
    loose = packed.where("sequence_id IS NULL")
    tasks = max(1, -(-loose.count() // block_pieces))
    return packed.where("sequence_id IS NOT NULL").union(loose.repartition(tasks).mapInArrow(again, SCHEMA))
