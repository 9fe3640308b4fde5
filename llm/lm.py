"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, stored as sorted hash arrays, memory-mapped to score.

The n-grams of a file are those of some words before the last (pivots), so that all a probability
needs but what is known of single words lies in one file: n-grams, their contexts, pairs, pivots.
"""

from __future__ import annotations

import json
import math
import mmap
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import cut, map_arrow, scratch, text_bytes
from llm.words import hashes, mix, spans

#: Bytes of text that are taken apart together.
CHUNK = 10 << 20
#: Files of the vocabulary, as powers of two; a word's file is the top bits of its hash. More input has more files.
WORD_BITS, MOST_WORD_BITS = 6, 12
#: Input partitions whose counts a task merges at once, and at most so many have their texts scored by one task.
FAN_IN = 64
#: Bytes of files that a worker keeps where the store can't be mapped.
KEPT = 256 << 20
#: Words of an n-gram: 3 or 2.
ORDER = 3
#: Training tokens of a file of n-grams, and occurrences beyond which a word's n-grams are dealt over all files.
SHARD_TOKENS = 3_000_000
COMMON = 1_000_000
#: Shares of the shards, as a power of two at most: a task scores texts by all shards of a share, and returns one sum a document.
SHARE_BITS = 6
#: N-grams that are looked up together.
BATCH = 500_000
#: Files that a worker maps at once; before Python 3.13 each takes a file descriptor.
MAPS, UNTRACKED = (16384, {"trackfd": False}) if sys.version_info >= (3, 13) else (512, {})
START, END = mix(np.array([1, 2], dtype=np.uint64))


# --- arrays in rows and in files ------------------------------------------------------------


def packed(**arrays: np.ndarray) -> bytes:
    """Integer arrays as one compressed cell; bytes of like weight lie together."""
    head, planes = {}, []
    for name, values in arrays.items():
        values = np.ascontiguousarray(values)
        head[name] = [values.dtype.str, len(values)]
        planes.append(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())
    text = json.dumps(head).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(text).to_bytes(4, "little") + text + b"".join(planes))


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    at = 4 + int.from_bytes(data[:4], "little")
    found = {}
    for name, (kind, n) in json.loads(data[4:at]).items():
        size = np.dtype(kind).itemsize
        found[name] = np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8, count=n * size, offset=at).reshape(size, n).T).view(kind).reshape(n)
        at += n * size
    return found


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and path of a qualified URI, for the schemes that Hadoop and Arrow name differently too."""
    scheme, _, rest = uri.partition(":")
    if scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    elif scheme == "dbfs":
        uri = f"file:///dbfs/{rest.lstrip('/')}"
    elif scheme == "file":
        uri = f"file:///{rest.lstrip('/')}"
    return fs.FileSystem.from_uri(uri)


def put(uri: str, **arrays: np.ndarray) -> None:
    """Write arrays to a file of the shared folder; a task that runs twice writes the same again."""
    store, path = _store(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    head, at = {}, 0
    for name, values in arrays.items():
        head[name] = [values.dtype.str, len(values), at]
        at += -(-values.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    own = f"{path}.{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(own) as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for values in arrays.values():
            out.write(np.ascontiguousarray(values).tobytes() + b"\0" * (-values.nbytes % 64))
    store.move(own, path)


_MAPPED: dict[str, dict[str, np.ndarray]] = {}
_READ: dict[str, int] = {}


def mapped(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped; from a store that can't be mapped they are read, and the oldest dropped beyond KEPT bytes."""
    if uri not in _MAPPED:
        if len(_MAPPED) > MAPS or not next(iter(_MAPPED), uri).startswith(uri.rsplit("/", 1)[0] + "/"):  # another model's files
            for kept in (_MAPPED, _READ, _KEYS):
                kept.clear()
        store, path = _store(uri)
        if isinstance(store, fs.LocalFileSystem):
            with open(path, "rb") as source:
                data = np.frombuffer(mmap.mmap(source.fileno(), 0, access=mmap.ACCESS_READ, **UNTRACKED), dtype=np.uint8)
        else:
            with store.open_input_stream(path) as source:
                data = np.frombuffer(source.read(), dtype=np.uint8)
            while _READ and sum(_READ.values()) + len(data) > KEPT:
                oldest = next(iter(_READ))
                del _READ[oldest], _MAPPED[oldest]
            _READ[uri] = len(data)
        size = int(data[:8].view(np.uint64)[0])
        head = json.loads(data[8 : 8 + size].tobytes())
        at = 8 + size
        _MAPPED[uri] = {n: data[at + a : at + a + k * np.dtype(t).itemsize].view(t) for n, (t, k, a) in head.items()}
    return _MAPPED[uri]


# --- tokens ---------------------------------------------------------------------------------


def tokenised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and the number of words of each."""
    data = [text_bytes(t) for t in texts]
    joined = b"\n".join(data)
    starts, ends = spans(joined)
    limits = np.cumsum([len(d) + 1 for d in data])
    at = np.searchsorted(starts, limits)
    return hashes(joined, starts, ends), np.diff(at, prepend=0)


def ngrams(words: np.ndarray, counts: np.ndarray, start: int, end: int, order: int) -> tuple[np.ndarray, ...]:
    """(document, the order - 1 words before, word) of each word and of the end of each document; starts stand before it."""
    doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts + 1)
    last = np.cumsum(counts + 1) - 1
    word = np.empty(len(doc), dtype=words.dtype)
    inner = np.ones(len(doc), dtype=bool)
    inner[last] = False
    word[inner], word[last] = words, end
    place = np.arange(len(doc)) - np.repeat(last - counts, counts + 1)
    before = []
    for back in range(order - 1, 0, -1):
        earlier = np.full(len(doc), start, dtype=words.dtype)
        earlier[place >= back] = word[np.flatnonzero(place >= back) - back]
        before.append(earlier)
    return doc, *before, word


@dataclass
class Numbered:
    """The n-grams of some texts: document, numbers of the word two before (0 in a bigram model), of the word before and of the
    word, its training count, and the shard; their order by shard and n-gram, and where in it new ones begin."""

    doc: np.ndarray
    before: np.ndarray
    pivot: np.ndarray
    word: np.ndarray
    seen: np.ndarray
    shard: np.ndarray
    order: np.ndarray
    first: np.ndarray


def numbered(model: Model, texts: list[str | None]) -> Numbered:
    words, counts = tokenised(texts)
    distinct, at = np.unique(np.concatenate([words, [START, END]]), return_inverse=True)
    ids, seen = model.lookup(distinct)
    by = np.argsort(ids, kind="stable")  # words of these texts are few: by their ranks an n-gram is one number
    rank = np.empty(len(by), dtype=np.int64)
    rank[by] = np.arange(len(by))
    ids, seen, at = ids[by].astype(np.uint32), seen[by], rank.astype(np.int32)[at]
    doc, *context, word = ngrams(at[:-2], counts, at[-2], at[-1], model.order)
    pivot = context[-1]
    before = context[-2] if model.order > 2 else np.zeros(len(doc), dtype=np.int32)
    numbers = (ids[before] if model.order > 2 else before), ids[pivot], ids[word]
    shard = model.shard_of(*numbers, seen[pivot])
    bits = len(ids).bit_length()
    if 3 * bits + model.bits < 64:
        key = shard << bits
        for column in (pivot, before, word):
            key |= column
            key <<= bits * (column is not word)
        order = np.argsort(key)
        first = _runs(key[order])
    else:
        order = _sorted_by(shard, pivot, before, word)
        first = _runs(*(x[order] for x in (shard, pivot, before, word)))
    return Numbered(doc, *numbers, seen[word], shard.astype(np.int32), order, first)


def chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list, list]]:
    """(first column, texts) of rows with about CHUNK bytes of text together; a longer text is a chunk of its own."""
    keys: list = []
    texts: list = []
    size = 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(column).to_pylist()):
            keys.append(key)
            texts.append(text)
            size += len(text or "")
            if size >= CHUNK:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each column of values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return (keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values))


#: Classes of words by the binary logarithm of their counts: commoner words have smaller numbers, which are shorter.
CLASSES = 48


def _classes(counts: np.ndarray) -> np.ndarray:
    return CLASSES - 1 - np.minimum(np.log2(counts).astype(np.int64), CLASSES - 1)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns begin to differ from the row before."""
    if not len(columns[0]):
        return np.zeros(0, dtype=np.int64)
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _hash(*words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of word numbers in a row; of two numbers it is a bijection."""
    key = words[0].astype(np.uint64)
    for w in words[1:]:
        key = mix(key << np.uint64(32) ^ key >> np.uint64(32)) + w.astype(np.uint64) if len(words) > 2 else key << np.uint64(32) | w.astype(np.uint64)
    return mix(key)


def _table(name: str, key: np.ndarray, **columns: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of a table sorted by 64-bit hash: the first 16 bits as an index, the next 32, and a byte for the columns.

    The byte names one of the 255 commonest rows of columns; other rows are kept apart, with their places.
    An unknown key is taken for a known one once in 2**48 over the number of entries.
    """
    order = np.argsort(key)
    key = key[order]
    values = np.column_stack([c[order] for c in columns.values()]).astype(np.int64)
    small = (values < 1 << 16).all(axis=1)
    joined = np.zeros(len(values), dtype=np.uint64)
    for c in values.T:
        joined = joined << np.uint64(16) | (c & 0xFFFF).astype(np.uint64)
    kinds, often = np.unique(joined[small], return_counts=True)
    chosen = np.sort(kinds[np.argsort(-often, kind="stable")[:255]])
    at = np.searchsorted(chosen, joined)
    named = small & (at < len(chosen))
    named[named] = chosen[at[named]] == joined[named]
    code = np.where(named, at, 255).astype(np.uint8)
    apart = np.flatnonzero(code == 255)
    rest = values[apart]
    return {
        f"{name}.index": np.searchsorted(key >> np.uint64(48), np.arange((1 << 16) + 1, dtype=np.uint64)).astype(np.uint32),
        f"{name}.rest": (key >> np.uint64(16)).astype(np.uint32),
        f"{name}.code": code,
        f"{name}.rows": np.column_stack([(chosen >> np.uint64(16 * k) & np.uint64(0xFFFF)).astype(np.int64) for k in range(len(columns) - 1, -1, -1)]).ravel(),
        f"{name}.at": apart.astype(np.uint32),
        f"{name}.apart": rest.astype(np.uint32 if not rest.size or rest.max() < 1 << 32 else np.int64).ravel(),
    }


#: Bytes of keys that a worker keeps.
KEYS = 64 << 20
_KEYS: dict[tuple[int, str], tuple[object, np.ndarray]] = {}


def _keys(arrays: dict[str, np.ndarray], name: str) -> np.ndarray:
    """The 48-bit keys of a table, made of index and rest; those of the tables looked at last are kept."""
    own = id(arrays), name
    if own not in _KEYS or _KEYS[own][0] is not arrays:
        index = arrays[f"{name}.index"].astype(np.int64)
        key = np.repeat(np.arange(1 << 16, dtype=np.uint64) << np.uint64(32), np.diff(index)) | arrays[f"{name}.rest"]
        while _KEYS and sum(k.nbytes for _, k in _KEYS.values()) + key.nbytes > KEYS:
            del _KEYS[next(iter(_KEYS))]
        _KEYS[own] = arrays, key
    return _KEYS[own][1]


def _find(arrays: dict[str, np.ndarray], name: str, key: np.ndarray, columns: int) -> list[np.ndarray]:
    """Columns of a table for hashes; zeros where the table has none."""
    found = np.zeros((len(key), columns), dtype=np.int64)
    if len(arrays[f"{name}.rest"]) and len(key):
        known = _keys(arrays, name)
        order = np.argsort(key)  # sorted keys are searched along the table, not across it
        sought = key[order] >> np.uint64(16)
        at = np.minimum(np.searchsorted(known, sought), len(known) - 1)
        hit = known[at] == sought
        at, order = at[hit], order[hit]
        code = arrays[f"{name}.code"][at]
        rows = arrays[f"{name}.rows"].reshape(-1, columns)
        if len(rows):
            found[order] = rows[np.minimum(code, len(rows) - 1)]
        large = code == 255
        found[order[large]] = arrays[f"{name}.apart"].reshape(-1, columns)[np.searchsorted(arrays[f"{name}.at"], at[large])]
    return list(found.T)


def _tallied(group: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each group of sorted rows that begins at ``group``: the sum of counts, and how many are 1, 2 and more."""
    columns = counts, counts == 1, counts == 2, counts > 2
    return tuple(np.add.reduceat(c.astype(np.int64), group) if len(group) else np.zeros(0, dtype=np.int64) for c in columns)


TALLY = ("total", "ones", "twos", "more")


# --- the model ------------------------------------------------------------------------------


@dataclass
class Model:
    """Where the arrays lie, and the numbers that all of it share."""

    folder: str
    #: Words of each vocabulary file and class of frequency, and their first numbers, class by class.
    sizes: np.ndarray
    documents: int
    order: int = ORDER
    often: int = COMMON
    bits: int = 4
    #: Discounts by order: of words by what they follow, of pairs by what they follow (not in a bigram model), of n-grams.
    discounts: list[np.ndarray] = field(default_factory=lambda: [np.array([0.0, 0.5, 1.0, 1.5])] * 3)
    types: int = 0
    lower_mass: float = 0.0
    tokens: int = 0
    word_bits: int = WORD_BITS
    #: Which files of n-grams, and of pairs after common words, were written; a shard that no row fell into has none.
    written: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=bool))
    common_written: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=bool))

    def __post_init__(self) -> None:
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes.T.ravel())])
        self.places = np.cumsum(self.sizes, axis=1) - self.sizes

    @property
    def size(self) -> int:
        """Words of the vocabulary, the start among them."""
        return int(self.offsets[-1])

    @property
    def distinct(self) -> int:
        """Distinct training tokens: words and the end."""
        return max(0, self.size - 1)

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, count) of distinct sorted word hashes; the number of an unknown word is ``size``."""
        ids, counts = np.full(len(words), self.size, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        files = len(self.sizes)
        for v, a, b in _parts(words >> np.uint64(64 - self.word_bits), files):
            if not self.sizes[v].any():
                continue
            arrays = mapped(f"{self.folder}/words-{v}")
            at = np.minimum(np.searchsorted(arrays["hash"], words[a:b]), len(arrays["hash"]) - 1)
            hit = np.flatnonzero(arrays["hash"][at] == words[a:b])
            place = arrays["place"][at[hit]].astype(np.int64)
            n = arrays["count"][place]
            kind = _classes(n)
            ids[a + hit], counts[a + hit] = self.offsets[kind * files + v] + place - self.places[v, kind], n
        return ids, counts

    def located(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(file, which of the sorted known word numbers lie in it, their places there)."""
        files = len(self.sizes)
        slot = np.searchsorted(self.offsets, ids, side="right") - 1
        file, kind = slot % files, slot // files
        place = self.places[file, kind] + ids - self.offsets[slot]
        order = np.argsort(file, kind="stable")
        for v, a, b in _parts(file[order], files):
            yield v, order[a:b], place[order[a:b]]

    def statistics(self, ids: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
        """Columns of the vocabulary for distinct sorted word numbers; an unknown word has zeros."""
        found = [np.zeros(len(ids), dtype=np.int64) for _ in names]
        for v, some, place in self.located(ids[ids < self.size]):
            for column, name in zip(found, names):
                column[some] = mapped(f"{self.folder}/{'words' if name == 'count' else 'stats'}-{v}")[name][place]
        return found

    def shard_of(self, before: np.ndarray, pivot: np.ndarray, word: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """The shard of n-grams, by the word before the last, of which ``seen`` is the count; those of a common one are dealt over all."""
        spread = _hash(before, pivot) if self.order > 2 else _hash(pivot, word)
        own = np.where(self.common(seen), spread, pivot.astype(np.uint64))
        return (mix(mix(own)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def common(self, seen: np.ndarray) -> np.ndarray:
        """Whether words of so many occurrences are dealt over all shards."""
        return seen > self.often

    def pairs_after_common(self, pivot: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Distinct words before each pair that begins with a common word."""
        key = _hash(pivot, word)
        found = np.zeros(len(key), dtype=np.int64)
        shard = (key >> np.uint64(64 - self.word_bits)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        for s, a, b in _parts(shard[order], 1 << self.word_bits):
            if self.common_written[s]:
                some = order[a:b]
                found[some] = _find(mapped(f"{self.folder}/common-{s}"), "pairs", mix(key[some]), 1)[0]
        return found

    def logs(self, shard: int, before: np.ndarray, pivot: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 of the probabilities of n-grams of one shard in any order; those that repeat are looked up once."""
        order = _ngram_order(pivot, before, word, self.size.bit_length())
        pivot, before, word = pivot[order], before[order], word[order]
        first = _runs(pivot, before, word)
        found = np.empty(len(order))
        found[order] = np.repeat(self.log10(shard, *(x[first].astype(np.int64) for x in (before, pivot, word))), np.diff(np.append(first, len(order))))
        return found

    def log10(self, shard: int, before: np.ndarray, pivot: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 of the interpolated probabilities of distinct n-grams of one shard, sorted by pivot and the word before."""
        arrays = mapped(f"{self.folder}/ngrams-{shard}") if self.written[shard] else None
        look = lambda name, key, columns: _find(arrays, name, key, columns) if arrays else [np.zeros(len(key), dtype=np.int64)] * columns
        words, at = np.unique(word, return_inverse=True)
        follows = self.statistics(words, ("before",))[0][at]
        d = self.discounts[0]
        p = self.lower_mass / (self.distinct + 1) if self.types else 1.0 / (self.distinct + 1)
        p = p + np.maximum(follows - d[np.minimum(follows, 3)], 0.0) / max(1, self.types)
        first = _runs(pivot)
        pivots, at = pivot[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pivot))))
        seen = self.statistics(pivots, ("count", *TALLY))
        often = self.common(seen[0])
        common = often[at]
        if self.order > 2:
            counts = np.array(look("pairs", _hash(pivot, word), 1)[0])
            counts[common] = self.pairs_after_common(pivot[common], word[common])
            tally = [np.where(often, after, own)[at] for after, own in zip(seen[1:], look("pivots", mix(pivots.astype(np.uint64)), 4))]
            p = _interpolated(counts, tally, self.discounts[1], p)
        counts = np.array(look("ngrams", _hash(before, pivot, word), 1)[0])
        counts[(before >= self.size) | (pivot >= self.size) | (word >= self.size)] = 0
        first = _runs(pivot, before)
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pivot))))
        tally = [c[of] for c in look("contexts", _hash(before[first], pivot[first]), 4)]
        if self.order == 2:
            tally = [np.where(common, after[at], own) for after, own in zip(seen[1:], tally)]
        return np.log10(_interpolated(counts, tally, self.discounts[2], p))


def _interpolated(counts: np.ndarray, tally: list[np.ndarray], d: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Discounted relative counts and the mass that is left for ``p``; where the context is unknown, ``p`` itself."""
    total, ones, twos, more = tally
    share = np.maximum(total, 1)
    mass = (d[1] * ones + d[2] * twos + d[3] * more) / share
    return np.where(total > 0, np.maximum(counts - d[np.minimum(counts, 3)], 0.0) / share + mass * p, p)


def _parts(values: np.ndarray, number: int) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of the runs of sorted small integers."""
    at = np.searchsorted(values, np.arange(number + 1))
    for v in range(number):
        if at[v] < at[v + 1]:
            yield v, int(at[v]), int(at[v + 1])


def _discounts(n: np.ndarray) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more by the numbers of types with counts 1 to 4."""
    d = np.array([0.0, 0.5, 1.0, 1.5])
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2 * n[1])
        for k in (1, 2, 3):
            if n[k - 1] and n[k]:
                d[k] = min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05 * k), float(k))
    return d


def train(docs: DataFrame, ident: str = "doc_id", text: str = "text", order: int = ORDER) -> Model:
    """Count ``docs`` into a model of n-grams of ``order`` 2 or 3 in the shared folder.

    First the vocabulary, then n-grams by the words' numbers, then what each word has of
    continuations. Lower orders count distinct words before. Every task counts its own texts before anything is moved, as compressed arrays
    keyed by shard; a frequent word or bigram is one entry a chunk. Null texts are empty; rows that
    repeat count as often.
    """
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    folder = scratch(docs.sparkSession, "lm")
    _store(folder)  # a scheme that workers can't write fails here
    docs = docs.select(F.col(f"`{ident}`"), F.col(f"`{text}`").cast("string").alias("text"))
    partitions = docs.rdd.getNumPartitions()
    word_bits = min(MOST_WORD_BITS, max(WORD_BITS, math.ceil(math.log2(max(1, partitions) / FAN_IN)) + WORD_BITS))
    vocabulary = 1 << word_bits

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for _, texts in chunks(batches, 1):
            words, counts = tokenised(texts)
            keys = np.concatenate([words, [START, END]])
            keys, n = _summed(keys, np.concatenate([np.ones(len(words), dtype=np.int64), [len(counts)] * 2]))
            rows = [(v, packed(hash=keys[a:b], count=n[a:b])) for v, a, b in _parts(keys >> np.uint64(64 - word_bits), vocabulary)]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "part", "payload"])

    def merged(table: pa.Table) -> tuple[np.ndarray, ...]:
        parts = [unpacked(p) for p in table["payload"].to_pylist()]
        return _summed(np.concatenate([p["hash"] for p in parts]), np.concatenate([p["count"] for p in parts]))

    def merge_words(table: pa.Table) -> pa.Table:
        keys, n = merged(table)
        return table.slice(0, 1).set_column(2, "payload", pa.array([packed(hash=keys, count=n)], pa.binary()))

    def store_words(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        keys, n = merged(table)
        kind = _classes(n)
        order = np.argsort(kind, kind="stable")
        place = np.empty(len(keys), dtype=np.uint32)
        place[order] = np.arange(len(keys))
        put(f"{folder}/words-{shard}", hash=keys, place=place, count=n[order])
        sizes = np.bincount(kind, minlength=CLASSES).tolist()
        return pa.table({"shard": [shard], "sizes": [sizes], "tokens": [int(n.sum())], "documents": [int(n[keys == START].sum())]}, schema=pa.schema([("shard", pa.int32()), ("sizes", pa.list_(pa.int64())), ("tokens", pa.int64()), ("documents", pa.int64())]))

    counted = map_arrow(docs, words_of, "shard int, part int, payload binary")
    while partitions > FAN_IN:  # a tree, so that no task holds the arrays of all partitions
        counted = counted.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("shard", "part").applyInArrow(merge_words, "shard int, part int, payload binary")
        partitions = -(-partitions // FAN_IN)
    found = counted.groupBy("shard").applyInArrow(store_words, "shard int, sizes array<long>, tokens long, documents long").collect()
    sizes = np.zeros((vocabulary, CLASSES), dtype=np.int64)
    for r in found:
        sizes[r["shard"]] = r["sizes"]
    documents = sum(r["documents"] for r in found)
    model = Model(folder, sizes, documents, order, COMMON, tokens=sum(r["tokens"] for r in found) - documents, word_bits=word_bits)
    if model.size >= 1 << 32:
        raise ValueError(f"{model.size} distinct words; word numbers have 32 bits")
    while model.tokens > SHARD_TOKENS << model.bits:
        model.bits += 1
    _count(docs, model)
    return model


COUNTED = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("payload", pa.binary()), ("types", pa.list_(pa.int64()))])
COUNTED_DDL = "kind string, shard int, payload binary, types array<long>"
SUMS = pa.schema([("kind", pa.string()), ("n", pa.list_(pa.int64()))])


def _sorted_by(*columns: np.ndarray) -> np.ndarray:
    """The order of rows by their columns of 32-bit numbers, the first first, two at a time."""
    keys = [columns[k].astype(np.uint64) << np.uint64(32) | columns[k + 1].astype(np.uint64) for k in range(0, len(columns) - 1, 2)]
    keys += [columns[-1]] * (len(columns) % 2)
    return np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])


def _ngram_order(pivot: np.ndarray, before: np.ndarray, word: np.ndarray, bits: int) -> np.ndarray:
    """The order of n-grams by pivot, word before and word, numbers of so many bits."""
    rank, wide = pivot, bits
    if 3 * bits > 64:
        pivots = np.unique(pivot)
        rank, wide = np.searchsorted(pivots, pivot), len(pivots).bit_length()
    if wide + 2 * bits > 64:
        return _sorted_by(pivot, before, word)
    return np.argsort((rank.astype(np.uint64) << np.uint64(bits) | before) << np.uint64(bits) | word)


def _count(docs: DataFrame, model: Model) -> None:
    """Count n-grams into files by pivots, pairs after common words into files by pairs, continuations by words."""
    vocabulary = 1 << model.word_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches, 1):
            found = numbered(model, texts)
            n = np.diff(np.append(found.first, len(found.order)))
            at = found.order[found.first]
            shard, pivot, before, word = (x[at] for x in (found.shard, found.pivot, found.before, found.word))
            rows = []
            for v, a, b in _parts(shard, 1 << model.bits):
                some = {"step": np.diff(pivot[a:b], prepend=0), "word": word[a:b], "count": n[a:b]} | ({"before": np.diff(before[a:b], prepend=0)} if model.order > 2 else {})
                rows.append((v, packed(**{k: x.astype(np.uint32) for k, x in some.items()})))
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "payload"])

    def deltas(kind: str, ids: np.ndarray, **columns: np.ndarray) -> list[tuple]:
        """Rows of columns of sorted distinct words, for the files of the vocabulary."""
        rows = []
        for v, some, place in model.located(ids):
            arrays = {"step": np.diff(place, prepend=0).astype(np.uint32)} | {c: x[some] for c, x in columns.items()}
            rows.append((kind, v, packed(**arrays), None))
        return rows

    def pair_rows(pivot: np.ndarray, word: np.ndarray, n: np.ndarray, group: np.ndarray, tally: bool) -> list[tuple]:
        """What whole pairs, sorted, add to their words: one before each, and the tally of common pivots."""
        words, follows = np.unique(word, return_counts=True)
        rows = deltas("before", words, before=follows)
        return rows + (deltas("tally", pivot[group], **dict(zip(TALLY, _tallied(group, n)))) if tally else [])

    def types(level: int, n: np.ndarray, shard: int) -> tuple:
        return "types", -1, None, [level, *(int((n == k).sum()) for k in (1, 2, 3, 4)), len(n), shard]

    def store(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        parts = [unpacked(p) for p in table["payload"].to_pylist()]
        pivot = np.concatenate([np.cumsum(p["step"].astype(np.int64)).astype(np.uint32) for p in parts])
        word, n = (np.concatenate([p[c] for p in parts]) for c in ("word", "count"))
        before = np.concatenate([np.cumsum(p["before"], dtype=np.uint32) for p in parts]) if model.order > 2 else np.zeros(len(word), dtype=np.uint32)
        del parts
        order = _ngram_order(pivot, before, word, model.size.bit_length())
        pivot, before, word, n = (x[order] for x in (pivot, before, word, n))
        at = _runs(pivot, before, word)
        n = np.add.reduceat(n.astype(np.int64), at)
        pivot, before, word = (x[at].astype(np.int64) for x in (pivot, before, word))
        group = _runs(pivot)
        common = model.common(model.statistics(pivot[group], ("count",))[0])
        common = np.repeat(common, np.diff(np.append(group, len(pivot))))
        contexts = _runs(pivot, before)
        arrays = _table("ngrams", _hash(before, pivot, word), n=n)
        arrays |= _table("contexts", _hash(before[contexts], pivot[contexts]), **dict(zip(TALLY, _tallied(contexts, n))))
        rows = [types(3, n, shard)]
        if model.order == 2:
            rows += pair_rows(pivot, word, n, contexts, False)
            rows += [r for r in pair_rows(*(x[common] for x in (pivot, word, n)), _runs(pivot[common]), True) if r[0] == "tally"]
        else:
            order = _sorted_by(pivot, word)
            pivot, word, common = pivot[order], word[order], common[order]
            at = _runs(pivot, word)
            n = np.diff(np.append(at, len(pivot)))
            pivot, word, common = pivot[at], word[at], common[at]
            some = ~common
            own = pivot[some], word[some], n[some]
            group = _runs(own[0])
            arrays |= _table("pairs", _hash(own[0], own[1]), n=own[2])
            arrays |= _table("pivots", mix(own[0][group].astype(np.uint64)), **dict(zip(TALLY, _tallied(group, own[2]))))
            rows += [types(2, own[2], -1), *pair_rows(*own, group, False)]
            pivot, word, n = pivot[common], word[common], n[common]
            spread = (_hash(pivot, word) >> np.uint64(64 - model.word_bits)).astype(np.int64)
            order = np.argsort(spread, kind="stable")
            for v, a, b in _parts(spread[order], vocabulary):
                k = order[a:b]
                rows.append(("common", v, packed(step=np.diff(pivot[k], prepend=0).astype(np.uint32), word=word[k].astype(np.uint32), count=n[k].astype(np.uint32)), None))
        put(f"{model.folder}/ngrams-{shard}", **arrays)
        return pa.table([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(COUNTED)], schema=COUNTED)

    def store_common(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        parts = [unpacked(p) for p in table["payload"].to_pylist()]
        pair = np.concatenate([np.cumsum(p["step"].astype(np.uint64)) << np.uint64(32) | p["word"].astype(np.uint64) for p in parts])
        pair, n = _summed(pair, np.concatenate([p["count"].astype(np.int64) for p in parts]))
        pivot, word = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        put(f"{model.folder}/common-{shard}", **_table("pairs", mix(_hash(pivot, word)), n=n))
        rows = [types(2, n, shard), *pair_rows(pivot, word, n, _runs(pivot), True)]
        return pa.table([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(COUNTED)], schema=COUNTED)

    def store_statistics(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        if shard < 0:
            found = np.array(table["types"].to_pylist(), dtype=np.int64)
            levels = [(f"types{k}", found[found[:, 0] == k][:, 1:6].sum(axis=0)) for k in (2, 3)]
            files = [(name, found[(found[:, 0] == k) & (found[:, 6] >= 0)][:, 6]) for name, k in (("common", 2), ("ngrams", 3))]
            return pa.table({"kind": [k for k, _ in levels + files], "n": [v.tolist() for _, v in levels + files]}, schema=SUMS)
        size = int(model.sizes[shard].sum())
        columns = {name: np.zeros(size, dtype=np.int64 if name == "total" else np.uint32) for name in ("before", *TALLY)}
        for payload in table["payload"].to_pylist():
            p = unpacked(payload)
            at = np.cumsum(p.pop("step").astype(np.int64))
            for name, values in p.items():
                columns[name][at] += values.astype(columns[name].dtype)
        put(f"{model.folder}/stats-{shard}", **columns)
        before = columns["before"]
        return pa.table({"kind": ["lower"], "n": [[int((before == k).sum()) for k in (1, 2, 3, 4)] + [int((before > 2).sum())]]}, schema=SUMS)

    counted = map_arrow(docs, count, "shard int, payload binary").groupBy("shard").applyInArrow(store, COUNTED_DDL)
    counted = cut(counted, "lm-counted")
    common = counted.where("kind = 'common'").groupBy("shard").applyInArrow(store_common, COUNTED_DDL)
    none = np.zeros(0, dtype=np.uint32)  # a file for words that follow nothing, as the start
    files = [("before", v, packed(step=none, before=none), None) for v in range(vocabulary) if model.sizes[v].any()]
    common = common.unionAll(docs.sparkSession.createDataFrame(files, COUNTED_DDL))
    sums = {k: np.zeros(5, dtype=np.int64) for k in ("types2", "types3", "lower")}
    model.written, model.common_written = np.zeros(1 << model.bits, dtype=bool), np.zeros(vocabulary, dtype=bool)
    for r in counted.where("kind <> 'common'").unionAll(common).groupBy("shard").applyInArrow(store_statistics, "kind string, n array<long>").collect():
        if r["kind"] == "ngrams":
            model.written[r["n"]] = True
        elif r["kind"] == "common":
            model.common_written[r["n"]] = True
        else:
            sums[r["kind"]] += r["n"]
    pairs = sums["types2" if model.order > 2 else "types3"]
    model.discounts = [_discounts(sums[k]) for k in ("lower", "types2", "types3")]
    model.types = int(pairs[4])
    d, n = model.discounts[0], sums["lower"]
    model.lower_mass = float(d[1] * n[0] + d[2] * n[1] + d[3] * n[4]) / max(1, model.types)


def score(docs: DataFrame, model: Model, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, n_tokens, n_known, train_tokens, base_score, score) for each row.

    A chunk of texts sends each share of the shards its n-grams with the documents they stand in; the
    share's task maps the arrays of one shard after another, looks up each shard's n-grams of all chunks
    together, and returns one sum a document. Shares don't grow in number with the input, as shards do:
    neither do messages or sums of a document. A task has about the n-grams of a shard, of some partitions,
    and texts are not shuffled. A null text is
    empty: its only token is the end. Ids may be null or repeat: each row is scored.
    """
    kind = dict(docs.dtypes)[ident]
    shards, within = 1 << model.bits, max(0, model.bits - SHARE_BITS)
    fan_in = max(1, min(FAN_IN, docs.rdd.getNumPartitions() * (SHARD_TOKENS << SHARE_BITS) // max(1, model.tokens)))
    docs = docs.select(F.col(f"`{ident}`"), F.col(f"`{text}`").cast("string"))
    columns = f"ids array<{kind}>, n_tokens array<long>, n_known array<long>, base array<double>"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        piece = part // fan_in
        key_type = None

        def typed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal key_type
            for batch in source:
                key_type = batch.column(0).type
                yield batch

        for number, (keys, texts) in enumerate(chunks(typed(batches), 1)):
            chunk = part << 32 | number
            found = numbered(model, texts)
            doc, before, pivot, word, seen = found.doc, found.before, found.pivot, found.word, found.seen
            base = np.bincount(doc, weights=np.log10((seen + 1.0) / (model.tokens + model.distinct + 1.0)), minlength=len(keys))
            number_of = np.bincount(doc, minlength=len(keys)), np.bincount(doc, weights=seen > 0, minlength=len(keys)).astype(np.int64)
            shard, order = found.shard, found.order
            rows = []
            limits = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in range(shards >> within):
                own = limits[s << within : (s + 1 << within) + 1]
                some = order[own[0] : own[-1]]
                if not len(some):
                    continue
                arrays = {"sizes": np.diff(own), "step": np.diff(pivot[some], prepend=0), "word": word[some], "doc": doc[some]} | ({"before": np.diff(before[some], prepend=0)} if model.order > 2 else {})
                rows.append((s, packed(**{k: x.astype(np.uint32) for k, x in arrays.items()})))
            whose = [pa.array([v] + [None] * len(rows), pa.list_(t)) for v, t in ((keys, key_type), (number_of[0].tolist(), pa.int64()), (number_of[1].tolist(), pa.int64()), (base.tolist(), pa.float64()))]
            yield pa.record_batch(
                [pa.array([chunk % (shards >> within)] + [r[0] for r in rows], pa.int32()), pa.array([piece] * (len(rows) + 1), pa.int32()), pa.array([chunk] * (len(rows) + 1), pa.int64()), pa.array([len(keys)] * (len(rows) + 1), pa.int32()), pa.array([None] + [r[1] for r in rows], pa.binary()), *whose],
                names=["share", "piece", "chunk", "docs", "payload", "ids", "n_tokens", "n_known", "base"],
            )

    def look(table: pa.Table) -> pa.Table:
        shard = table["share"][0].as_py() << within
        there = table["payload"].is_valid().to_pylist()
        limits = np.cumsum([0] + [n * t for n, t in zip(table["docs"].to_pylist(), there)])
        parts: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(1 << within)]
        for payload, at in zip(table["payload"], limits):
            if not payload.is_valid:
                continue
            p = unpacked(payload.as_py())
            word = p["word"]
            before = np.cumsum(p["before"], dtype=np.uint32) if model.order > 2 else np.zeros(len(word), dtype=np.uint32)
            columns = before, np.cumsum(p["step"], dtype=np.uint32), word, p["doc"] + np.uint32(at)
            own = np.concatenate([[0], np.cumsum(p["sizes"], dtype=np.int64)])
            for some, a, b in zip(parts, own, own[1:]):
                if a < b:
                    some.append(tuple(c[a:b] for c in columns))
        total = np.zeros(limits[-1])
        for k in range(len(parts)):
            some, parts[k] = parts[k], []
            sizes = np.cumsum([0] + [len(x[0]) for x in some])
            for _, a, b in _parts(sizes[:-1] // BATCH, int(sizes[-1] // BATCH) + 1):
                before, pivot, word, doc = (np.concatenate(c) for c in zip(*some[a:b]))
                total += np.bincount(doc, weights=model.logs(shard + k, before, pivot, word), minlength=len(total))
        sums = [total[a:b] if t else None for t, a, b in zip(there, limits, limits[1:])]
        return pa.table([table["chunk"], pa.array(sums, pa.list_(pa.float64())), *(table[c] for c in ("ids", "n_tokens", "n_known", "base"))], names=["chunk", "sums", "ids", "n_tokens", "n_known", "base"])

    def gather(table: pa.Table) -> pa.Table:
        total = 0.0
        for s in table["sums"]:
            if s.is_valid:
                total = total + s.values.to_numpy()
        head = table.filter(table["ids"].is_valid())
        ids, n_tokens, n_known, base = (head[c].combine_chunks().flatten() for c in ("ids", "n_tokens", "n_known", "base"))
        return pa.table([ids, n_tokens, n_known, base, pa.array(np.broadcast_to(total, len(ids)))], names=["id", "n_tokens", "n_known", "base_score", "score"])

    sent = map_arrow(docs, send, f"share int, piece int, chunk long, docs int, payload binary, {columns}")
    looked = sent.groupBy("share", "piece").applyInArrow(look, f"chunk long, sums array<double>, {columns}")
    scored = looked.groupBy("chunk").applyInArrow(gather, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").alias(ident), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
