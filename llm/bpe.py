"""Byte-level BPE with regex-free, vectorised pre-tokenisation."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import map_arrow

# White_Space code points of the Unicode character database.
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B))

# Classes of a code point in its place: letter, number, other; apostrophe with one or two letters of a
# contraction after it; last of a run of white space before something else (a blank, or another);
# other white space; and the seam between two texts.
LETTER, NUMBER, OTHER, SHORT, LONG, BLANK, BREAK, SPACE, SEAM = range(9)
# States: nothing begun; in letters, numbers, others; after a blank that the next run takes in;
# in white space; one or two letters of a contraction to come.
FRESH, LETTERS, NUMBERS, OTHERS, AFTER_BLANK, SPACES, ONE_LEFT, TWO_LEFT = range(8)

#: Characters of text that are scanned at once, and the length of a block of the scan.
SCAN = 1 << 20
BLOCK = 64
#: Pieces a worker remembers, and the longest piece that it does.
REMEMBERED = 500_000
LONGEST = 256
NONE = 1 << 40


def _step(state: int, kind: int) -> tuple[int, bool]:
    """State after a code point of ``kind``, and whether a piece begins with it."""
    if kind == LETTER:
        if state in (ONE_LEFT, TWO_LEFT):
            return (FRESH if state == ONE_LEFT else ONE_LEFT), False
        return LETTERS, state not in (LETTERS, AFTER_BLANK)
    if kind == NUMBER:
        return NUMBERS, state not in (NUMBERS, AFTER_BLANK)
    if kind in (OTHER, SHORT, LONG):
        if state in (OTHERS, AFTER_BLANK):
            return OTHERS, False
        return {OTHER: OTHERS, SHORT: ONE_LEFT, LONG: TWO_LEFT}[kind], True
    if kind == SPACE:
        return SPACES, state != SPACES
    return {BLANK: AFTER_BLANK, BREAK: FRESH, SEAM: FRESH}[kind], kind != SEAM


@functools.cache
def _machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The transition monoid: number of each class's function, products, images of each state; and where pieces begin."""
    generators = [tuple(_step(s, c)[0] for s in range(8)) for c in range(9)]
    number = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(8)), *generators]))}
    pending = list(number)
    while pending:
        f = pending.pop()
        for g in generators:
            h = tuple(g[x] for x in f)
            if h not in number:
                number[h] = len(number)
                pending.append(h)
    elements = list(number)
    product = np.array([[number[tuple(g[x] for x in f)] for g in elements] for f in elements], dtype=np.uint8)
    assert len(elements) <= 256
    begins = np.array([[_step(s, c)[1] for c in range(9)] for s in range(8)])
    return np.array([number[g] for g in generators], dtype=np.uint8), product, np.array(elements, dtype=np.uint8), begins


@functools.cache
def _class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[list(WHITE_SPACE)] = SPACE
    return table


def states_before(classes: np.ndarray) -> np.ndarray:
    """The state before each position, by an associative scan of transition functions.

    Blocks are reduced side by side, their products are scanned by doubling, and every state is the
    image of FRESH under the product of all functions before it.
    """
    generator, product, image, _ = _machine()
    n = len(classes)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, SEAM, dtype=np.uint8)
    padded[:n] = classes
    done = np.ascontiguousarray(generator[padded].reshape(blocks, BLOCK).T)
    flat, size = product.ravel(), len(product)
    for t in range(1, BLOCK):
        done[t] = flat[done[t - 1].astype(np.intp) * size + done[t]]
    total, width = done[-1].copy(), 1
    while width < blocks:
        total[width:] = flat[total[:-width].astype(np.intp) * size + total[width:]]
        width *= 2
    first = np.full(blocks, FRESH, dtype=np.uint8)
    first[1:] = image[total[:-1], FRESH]
    after = image[done, first[None, :]].T.ravel()[:n]
    before = np.empty(n, dtype=np.uint8)
    before[0:1] = FRESH
    before[1:] = after[:-1]
    return before


def boundaries(texts: list[str]) -> list[tuple[bytes, list[int]]]:
    """Each text's bytes, and the byte offsets at which its pieces begin, followed by its length."""
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(points):
        return [(b"", [0]) for _ in texts]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    seams = np.cumsum(lengths + 1)[:-1] - 1
    classes = _class_table()[points]
    classes[seams] = SEAM
    following = np.append(classes[1:], SEAM)
    space = classes == SPACE
    last = space & (following != SPACE) & (following != SEAM)
    classes[last] = BREAK
    classes[last & (points == 0x20)] = BLANK
    quotes = np.flatnonzero((points == 0x27) & (classes == OTHER))
    if len(quotes):
        ahead = np.append(np.where(classes == SEAM, 0, points), [0, 0])
        one, two = ahead[quotes + 1], ahead[quotes + 2]
        classes[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pair = np.zeros(len(quotes), dtype=bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        classes[quotes[pair]] = LONG
    begin = _machine()[3][states_before(classes), classes]
    size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    at = np.concatenate([[0], np.cumsum(size)])
    whole = joined.encode("utf-8", "surrogatepass")
    starts = np.flatnonzero(begin)
    texts_at = np.concatenate([[0], seams + 1])
    cuts = np.searchsorted(starts, np.append(texts_at, len(points) + 1))
    found = []
    for k in range(len(texts)):
        a, b = int(at[texts_at[k]]), int(at[texts_at[k] + lengths[k]])
        found.append((whole[a:b], [*(at[starts[cuts[k] : cuts[k + 1]]] - a).tolist(), b - a]))
    return found


class Encoder(dict):
    """Byte-pair encoder by ranks; as a dict, it maps the pieces it remembers to their ids."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, file)))}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a << 20 | b] = rank

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        ids = self._merge(piece)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids

    def _merge(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        ids = [self.single[b] for b in piece]
        if len(ids) > LONGEST:
            return self._merge_long(ids)
        pairs = self.pairs
        ranks = [pairs.get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) != NONE:
            i = ranks.index(low)
            ids[i : i + 2] = [low]
            del ranks[i]
            if i:
                ranks[i - 1] = pairs.get(ids[i - 1] << 20 | low, NONE)
            if i < len(ranks):
                ranks[i] = pairs.get(low << 20 | ids[i + 1], NONE)
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same merges with a heap and a linked list, for pieces of any length."""
        pairs, n = self.pairs, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := pairs.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or pairs.get(ids[i] << 20 | ids[j]) != rank:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := pairs.get(ids[a] << 20 | ids[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return tuple(x for x in ids if x >= 0)

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[int], bytes]]:
        """(ids, byte offsets of the pieces, bytes) of each text; a null text is empty."""
        texts = [t or "" for t in texts]
        at = 0
        while at < len(texts):
            until, chars = at, 0
            while until < len(texts) and (until == at or chars + len(texts[until]) <= SCAN):
                chars += len(texts[until])
                until += 1
            for data, offsets in boundaries(texts[at:until]):
                pieces = [data[a:b] for a, b in zip(offsets, offsets[1:])]
                yield list(chain.from_iterable(map(self.__getitem__, pieces))), offsets, data
            at = until

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def token_offsets(self, ids: list[int]) -> list[int]:
        """The byte offset of each token in what ``ids`` decode to, followed by the length."""
        return [0, *np.cumsum([len(self.tokens[i]) for i in ids]).tolist()]


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and worker."""
    return Encoder(path)


def encode(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, ids array<int>, offsets array<long>): token ids of each whole text, and the byte offset of each token.

    A null text is empty and has no ids. One row for each input row; ids may be null or repeat.
    ``path`` names a file of base64 tokens and ranks that every worker can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            ids = [i for i, _, _ in own.encode_batch(batch.column(1).to_pylist())]
            offsets = [own.token_offsets(i)[:-1] for i in ids]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int64()))], names=["id", "ids", "offsets"])

    kind = dict(docs.dtypes)[ident]
    found = map_arrow(docs.select(F.col(ident), F.col(text).cast("string")), run, f"id {kind}, ids array<int>, offsets array<long>", 250)
    return found.withColumnRenamed("id", ident)


def round_trip(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, n_tokens, ids_sha256, decoded_sha256) of each row, without moving the ids themselves.

    ids_sha256 is of the decimal ids joined by blanks, decoded_sha256 of the bytes that the ids
    decode to. A null text is empty. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        names = {i: str(i) for i in own.tokens}
        for batch in batches:
            count, digest, decoded = [], [], []
            for ids, _, _ in own.encode_batch(batch.column(1).to_pylist()):
                count.append(len(ids))
                digest.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)[ident]
    found = map_arrow(docs.select(F.col(ident), F.col(text).cast("string")), run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return found.withColumnRenamed("id", ident)
