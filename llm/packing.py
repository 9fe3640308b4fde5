"""Packing of token sequences into near-equal windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.bpe import encoder
from llm.common import map_arrow

WINDOW = 1024
#: Pieces that are packed together; bounds a task's memory whatever its input.
POOL = 512
#: Longest piece of what a document has beyond full windows; shorter pieces balance better.
PIECE = 512
END = 0


#: Texts with an unbroken run of so many characters are encoded by ``llm.bpe``, whose merging is not quadratic.
RUN = 4096
_BLANK = re.compile(rf"\s{{{RUN}}}")


@functools.cache
def _library(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder(path).ranks, special_tokens={})


def tokens(path: str, text: str | None) -> np.ndarray:
    """Ids of a whole text, and id 0; strings of special tokens are ordinary text."""
    text = text or ""
    length = [len(w) for w in text.split()]
    # White space of one kind or several is a piece too, where a text has so much of it.
    if max(length, default=0) >= RUN or len(text) - sum(length) >= RUN and _BLANK.search(text):
        ids = next(encoder(path).encode_batch([text]))[0]
    else:
        ids = _library(path).encode_ordinary(text)
    ids.append(END)
    return np.array(ids, dtype="<u4")


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Items of each of ``ways`` parts with near-equal sums, by Karmarkar-Karp multiway differencing.

    The two partial partitions of the largest spreads are merged, the largest sums of one with the
    smallest of the other, until one is left. A partition is its cells in falling order, less their
    smallest sum; cells that hold nothing are left out.
    """
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, tie, b = heapq.heappop(heap)
        shared = max(0, len(a) + len(b) - ways)
        cells = a[: len(a) - shared] + b[: len(b) - shared]
        meet = zip(a[len(a) - shared :], reversed(b[len(b) - shared :]))
        cells += [(x + y, (left, right)) for (x, left), (y, right) in meet]
        cells.sort(key=lambda cell: -cell[0])
        if len(cells) == ways and (low := cells[-1][0]):
            cells = [(x - low, held) for x, held in cells]
        heapq.heappush(heap, (-cells[0][0], tie, cells))
    parts: list[list[int]] = []
    for _, held in heap[0][2] if heap else []:
        part, pending = [], [held]
        while pending:
            node = pending.pop()
            if isinstance(node, tuple):
                pending += [node[1], node[0]]
            else:
                part.append(node)
        parts.append(part)
    return parts


def pack(sizes: list[int], window: int = WINDOW) -> list[list[int]]:
    """Items of each window. The number of windows rises until no sum exceeds the capacity."""
    ways = max(1, -(-sum(sizes) // window))
    while True:
        parts = differencing(sizes, ways)
        if max((sum(sizes[i] for i in part) for part in parts), default=0) <= window:
            return [sorted(part) for part in parts]
        ways += max(1, ways // 100)


class Packer:
    """Packs documents one after another; holds at most POOL pieces."""

    def __init__(self, first_sequence: int, window: int = WINDOW, pool: int = POOL, piece: int = PIECE):
        self.next, self.window, self.pool, self.piece = first_sequence, window, pool, piece
        self.held: list[tuple] = []

    def add(self, key: object, ids: np.ndarray) -> Iterator[tuple]:
        """Rows (key, start, ids of the piece, tokens of the document, sequence, offset) that are settled by now."""
        total, start = len(ids), 0
        while total - start >= self.window:
            yield key, start, ids[start : start + self.window], total, self.next, 0
            self.next, start = self.next + 1, start + self.window
        while start < total:
            self.held.append((key, start, ids[start : start + self.piece], total))
            start += self.piece
            if len(self.held) >= self.pool:
                yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        for part in pack([len(x[2]) for x in self.held], self.window) if self.held else []:
            offset = 0
            for i in part:
                yield (*self.held[i], self.next, offset)
                offset += len(self.held[i][2])
            self.next += 1
        self.held = []


def _pack(docs: DataFrame, path: str, ident: str, text: str, window: int, with_ids: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 36, window)

        def rows(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array([x[0] for x in found], kind), pa.array([x[1] for x in found], pa.int64()), pa.array([len(x[2]) for x in found], pa.int64()), pa.array([zlib.crc32(x[2].tobytes()) for x in found], pa.int64())]
            columns += [pa.array([x[k] for x in found], pa.int64()) for k in (3, 4, 5)]
            if with_ids:
                columns.append(pa.array([x[2] for x in found], pa.list_(pa.int64())))
            return pa.record_batch(columns, names=NAMES[: len(columns)])

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            found: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found += packer.add(key, tokens(path, text))
            if found:
                yield rows(found, kind)
        if kind is not None:
            yield rows(list(packer.flush()), kind)

    kind = dict(docs.dtypes)[ident]
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    return map_arrow(docs.select(F.col(ident), F.col(text).cast("string")), run, schema).withColumnRenamed("id", ident)


NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def pack_documents(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each piece of each document: (ident, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is the ids of its whole text and id 0; a null text is empty, so that it has one id.
    Its full windows become sequences of their own; the rest, in pieces of at most PIECE ids, is
    packed with that of the documents beside it. Each task packs its own documents, so nothing is
    shuffled; sequence ids begin at the task's number times 2**36. Ids may be null or repeat: each
    row is a document.
    """
    return _pack(docs, path, ident, text, window, False)


def packed_sequences(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """As ``pack_documents``, with the piece's ids as array column ``ids``."""
    return _pack(docs, path, ident, text, window, True)
