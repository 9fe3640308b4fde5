"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import Forest, components, cut, map_arrow, segments, shared_buckets, small_pairs, tiles

#: Recall at the threshold that the number of tables is chosen for, by pairs of vectors drawn at just that cosine.
RECALL = 0.97
PAIRS = 300
#: Costs of a hash, of fetching a vector that shares a bucket and of comparing it with another, in units of a moved bucket number.
HASH_COST, FETCH_COST, COMPARE_COST = 0.5, 8.0, 0.05
#: Members of a block; a tile compares two blocks.
BLOCK = 512
SEED = 20240


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows, whose length is a power of two; keeps norms."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def buckets(unit: np.ndarray, tables: int, vertices: int, probes: int, seed: int = SEED) -> np.ndarray:
    """(vectors, tables, probes): bucket numbers by ``vertices`` concatenated cross-polytope hashes.

    Each hash rotates by three rounds of random signs and the Hadamard transform and takes the
    largest coordinate and its sign. The further probes put in the runner-up where it comes closest.
    """
    n, dim = unit.shape
    width = 1 << max(1, (dim - 1).bit_length())
    rng = np.random.default_rng(seed)
    padded = np.zeros((n, width))
    padded[:, :dim] = unit
    found = np.zeros((n, tables, probes), dtype=np.uint64)
    rows = np.arange(n)
    for t in range(tables):
        best, second, gap = [], [], []
        for _ in range(vertices):
            x = padded
            for _ in range(3):
                x = hadamard(x * rng.choice([-1.0, 1.0], width))
            size = np.abs(x)
            top = np.argpartition(-size, 1, axis=1)[:, :2] if width > 2 else np.argsort(-size, axis=1)[:, :2]
            swap = size[rows, top[:, 0]] < size[rows, top[:, 1]]
            first, other = np.where(swap, top[:, 1], top[:, 0]), np.where(swap, top[:, 0], top[:, 1])
            best.append(2 * first + (x[rows, first] < 0))
            second.append(2 * other + (x[rows, other] < 0))
            gap.append(size[rows, first] - size[rows, other])
        base = np.stack(best, axis=1).astype(np.uint64)
        runner = np.stack(second, axis=1).astype(np.uint64)
        order = np.argsort(np.stack(gap, axis=1), axis=1, kind="stable")
        for p in range(probes):
            codes = base.copy()
            if p:
                at = order[:, min(p - 1, vertices - 1)]
                codes[rows, at] = runner[rows, at]
            value = np.full(n, t, dtype=np.uint64)
            for v in range(vertices):
                value = value * np.uint64(2 * width) + codes[:, v]
            found[:, t, p] = value
    return found


@dataclass(frozen=True)
class Scheme:
    """Hashes of a bucket number, tables, and buckets of each table that a vector lies in."""

    vertices: int
    tables: int
    probes: int


def at_cosine(rng: np.random.Generator, n: int, dim: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of random unit vectors at the given cosine."""
    a, b = rng.normal(size=(2, n, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.maximum(np.linalg.norm(b, axis=1), 1e-300)[:, None]
    return a, cosine * a + math.sqrt(max(0.0, 1 - cosine**2)) * b


@functools.cache
def scheme(dim: int, total: int, least: float, recall: float = RECALL, room: int = 44) -> Scheme:
    """The cheapest scheme for ``total`` vectors that finds pairs at cosine ``least`` with the given recall.

    More hashes make buckets smaller and pairs likelier to be parted, which more tables make good: the
    chance that a table brings a pair together is measured on drawn pairs, for each choice. A bucket
    number has ``room`` bits.
    """
    width = 1 << max(1, (dim - 1).bit_length())
    bits = math.log2(2 * width)
    a, b = at_cosine(np.random.default_rng(SEED + dim), PAIRS, dim, least)
    best: tuple[float, Scheme] | None = None
    for vertices in range(1, max(1, int(room / bits)) + 1):
        wide = buckets(a, 4, vertices, vertices + 1), buckets(b, 4, vertices, vertices + 1)
        for probes in range(1, vertices + 2):
            x, y = (w[:, :, :probes] for w in wide)
            met = float((x[:, :, :, None] == y[:, :, None, :]).any(axis=(2, 3)).mean())
            if met == 0:
                continue
            tables = 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log(1 - met))
            others = total * probes / 2.0 ** (bits * vertices)
            cost = tables * vertices * HASH_COST + tables * probes * (1 + FETCH_COST * -math.expm1(-others) + COMPARE_COST * others)
            if tables <= 64 and (best is None or cost < best[0]):
                best = cost, Scheme(vertices, tables, probes)
        if total < 2.0 ** (bits * vertices - 6):
            break
    assert best is not None
    return best[1]


def _read(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, key, dim, vec): a digest of each vector's own values, its width and bytes; null where it can't be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, dims, held = [], [], []
            for value in batch.column(1):
                key = dim = vec = None
                if value.is_valid and not value.values.null_count and len(value.values):
                    x = value.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
                    if np.isfinite(x).all() and x.any():
                        with np.errstate(over="ignore"):
                            short = x.astype("<f4")
                        key, dim = hashlib.blake2b(x.tobytes(), digest_size=16).digest(), len(x)
                        vec = short.tobytes() if (short == x).all() else x.tobytes()
                keys.append(key)
                dims.append(dim)
                held.append(vec)
            yield pa.record_batch([batch.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(held, pa.binary())], names=["id", "key", "dim", "vec"])

    kind = dict(vectors.dtypes)[ident]
    return map_arrow(vectors.select(F.col(f"`{ident}`"), F.col(f"`{vector}`").cast("array<double>")), run, f"id {kind}, key binary, dim int, vec binary", 10_000)


def _units(vecs: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors of bytes in single or double precision."""
    x = np.stack([np.frombuffer(v, dtype="<f4" if len(v) == 4 * dim else "<f8").astype(np.float64) for v in vecs])
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.take(pa.array(np.flatnonzero(dims == dim)))


def _signatures(classes: DataFrame, schemes: dict[int, Scheme], base: int) -> DataFrame:
    """(bucket, num): the buckets of each class, of which each is named once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                if dim not in schemes:
                    continue
                found = np.sort(_buckets(part.column(2).to_pylist(), dim, schemes[dim], base).reshape(part.num_rows, -1), axis=1)
                fresh = np.ones(found.shape, dtype=bool)
                fresh[:, 1:] = found[:, 1:] != found[:, :-1]
                num = np.broadcast_to(part.column(0).to_numpy()[:, None], found.shape)
                yield pa.record_batch([pa.array(found[fresh].view(np.int64)), pa.array(num[fresh])], names=["bucket", "num"])

    return map_arrow(classes.select("num", "dim", "vec"), run, "bucket long, num long", 2000)


def _buckets(vecs: list[bytes], dim: int, own: Scheme, base: int) -> np.ndarray:
    """(vectors, tables, probes): bucket numbers that vectors of other widths don't have."""
    return buckets(_units(vecs, dim), own.tables, own.vertices, own.probes) * np.uint64(base) + np.uint64(dim)


def _members(classes: DataFrame, shared: DataFrame, schemes: dict[int, Scheme], base: int) -> DataFrame:
    """(bucket, members, num, n, dim, vec, held): the classes that share buckets, for each of these; held has all their buckets."""
    wanted = cut(shared.groupBy(F.col("num").alias("_num")).agg(F.collect_list(F.struct("bucket", "members")).alias("places")), "embedding-wanted")
    rows = classes.select("num", "n", "dim", "vec").join(wanted.hint("merge"), F.col("num") == F.col("_num")).select("num", "n", "dim", "vec", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                found = _buckets(part.column(3).to_pylist(), dim, schemes[dim], base)
                held = [np.ascontiguousarray(row).tobytes() for row in found]
                places = part.column(4)
                at = np.repeat(np.arange(part.num_rows), places.value_lengths().to_numpy())
                some, flat = part.take(pa.array(at)), places.flatten()
                columns = [flat.field("bucket"), flat.field("members"), *(some.column(k) for k in range(4)), pa.array([held[k] for k in at.tolist()], pa.binary())]
                yield pa.record_batch(columns, names=["bucket", "members", "num", "n", "dim", "vec", "held"])

    return map_arrow(rows, run, "bucket long, members long, num long, n long, dim int, vec binary, held binary", 500)


def _first_meeting(a: np.ndarray, b: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Of pairs with bucket lists (pairs, tables, probes): whether ``bucket`` is the first that both lie in."""
    none = np.iinfo(np.uint64).max
    first = np.full(len(a), none, dtype=np.uint64)
    for t in range(a.shape[1]):
        here = np.full(len(a), none, dtype=np.uint64)
        for p in range(a.shape[2]):
            for q in range(b.shape[2]):
                same = a[:, t, p] == b[:, t, q]
                here = np.where(same & (a[:, t, p] < here), a[:, t, p], here)
        first = np.where(first == none, here, first)
    return first == bucket


#: Rows of a bucket up to which its pairs are taken with those of other buckets, and pairs that are compared at once.
SMALL, AT_ONCE = 48, 1 << 13


def _close_pairs(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, cross: np.ndarray, block: np.ndarray, tile: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs inside groups [start, end) of rows x whose products reach ``least``.

    Of a group that is ``cross`` only pairs of its two blocks count, the first of which is ``tile``.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    few = ends - starts <= SMALL
    a, b = small_pairs(starts[few], ends[few])
    group = np.repeat(np.flatnonzero(few), (ends - starts)[few] * (ends - starts - 1)[few] // 2)
    some = ~cross[group] | (block[a] != block[b])
    a, b = a[some], b[some]
    for k in range(0, len(a), AT_ONCE):
        p, q = a[k : k + AT_ONCE], b[k : k + AT_ONCE]
        close = np.einsum("ij,ij->i", x[p], x[q]) >= least
        found.append((p[close], q[close]))
    for g in np.flatnonzero(~few).tolist():
        own = np.arange(starts[g], ends[g])
        if cross[g]:
            left, right = own[block[own] == tile[g]], own[block[own] != tile[g]]
            close = x[left] @ x[right].T >= least - 1e-9
        else:
            left = right = own
            close = np.triu(x[own] @ x[own].T >= least - 1e-9, 1)
        p, q = np.nonzero(close)
        p, q = left[p], right[q]
        for k in range(0, len(p), AT_ONCE):
            exact = np.einsum("ij,ij->i", x[p[k : k + AT_ONCE]], x[q[k : k + AT_ONCE]]) >= least
            found.append((p[k : k + AT_ONCE][exact], q[k : k + AT_ONCE][exact]))
    return tuple(np.concatenate([f[k] for f in found] or [np.zeros(0, dtype=np.int64)]) for k in (0, 1))


def _linked(rows: DataFrame, least: float, schemes: dict[int, Scheme]) -> DataFrame:
    """(num, other, links): links of each class counted in the tiles, and edges that connect what they link.

    A pair is counted only in the first bucket that both lie in. Rows with ``other`` null carry counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in segments(batches, ["bucket", "tile_i", "tile_j"], 4000):
            num, n, dims, block = (table[c].to_numpy() for c in ("num", "n", "dim", "block"))
            bucket, i, j = table["bucket"].to_numpy().view(np.uint64), table["tile_i"].to_numpy(), table["tile_j"].to_numpy()
            vecs, lists = table["vec"].to_pylist(), table["held"].to_pylist()
            links = np.zeros(table.num_rows, dtype=np.int64)
            edges: list[tuple[int, int]] = []
            starts, ends = at[:-1], at[1:]
            for dim in np.unique(dims).tolist():  # buckets are of one width
                mine = (dims[starts] == dim) & (ends - starts > 1)
                if not mine.any():
                    continue
                where = np.flatnonzero(dims == dim)
                x = np.zeros((table.num_rows, dim)) if len(where) < table.num_rows else None
                if x is None:
                    x = _units(vecs, dim)
                else:
                    x[where] = _units([vecs[k] for k in where.tolist()], dim)
                a, b = starts[mine], ends[mine]
                p, q = _close_pairs(x, a, b, i[a] != j[a], block, i[a], least)
                if not len(p):
                    continue
                own = schemes[dim]
                some = np.unique(np.concatenate([p, q]))
                held = np.frombuffer(b"".join(lists[k] for k in some.tolist()), dtype=np.uint64).reshape(-1, own.tables, own.probes)
                new = np.concatenate([_first_meeting(held[np.searchsorted(some, p[k : k + AT_ONCE])], held[np.searchsorted(some, q[k : k + AT_ONCE])], bucket[p[k : k + AT_ONCE]]) for k in range(0, len(p), AT_ONCE)])
                p, q = p[new], q[new]
                np.add.at(links, p, n[q])
                np.add.at(links, q, n[p])
                edges += _forest(p, q)
            counted = np.flatnonzero(links)
            yield pa.record_batch(
                [
                    pa.array(num[np.concatenate([counted, np.array([e for e, _ in edges], dtype=np.int64)])], pa.int64()),
                    pa.array([None] * len(counted) + [int(num[e]) for _, e in edges], pa.int64()),
                    pa.array(np.concatenate([links[counted], np.zeros(len(edges), dtype=np.int64)]), pa.int64()),
                ],
                names=["num", "other", "links"],
            )

    return map_arrow(rows, run, "num long, other long, links long", 2000)


def _forest(p: np.ndarray, q: np.ndarray) -> list[tuple[int, int]]:
    """Few of the edges (p, q), which connect what all of them do."""
    nodes, at = np.unique(np.concatenate([p, q]), return_inverse=True)
    forest = Forest(len(nodes))
    return [(int(nodes[a]), int(nodes[b])) for a, b in zip(at[: len(p)].tolist(), at[len(p) :].tolist()) if forest.join(a, b)]


def near_duplicates(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", least: float = 0.95, recall: float = RECALL) -> DataFrame:
    """(ident, n_links, component_id, kept) for each row.

    Vectors whose cosine, in doubles, is at least ``least`` are linked if they share a bucket; the
    number of hashes, tables and probes is chosen for the number of vectors and their width, so that
    pairs just at ``least`` meet with probability ``recall``, closer ones more often.
    Copies are one class from the start: they link with each other and count in full. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing and are kept; so do vectors
    of unlike widths. Rows may repeat; each counts. component_id is the smallest id reachable, null
    if all are null.

    Bucket numbers are shuffled first; vectors are fetched only for classes that share a bucket.
    """
    rows = cut(_read(vectors, ident, vector).select("id", "key"), "embedding-rows")
    found = _read(vectors, ident, vector).where("key is not null").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    classes = cut(found.withColumn("num", F.monotonically_increasing_id()), "embedding-classes")
    totals = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}  # one row for each width
    base = max(totals, default=0) + 1
    schemes = {dim: scheme(dim, 1 << (n - 1).bit_length(), least, recall, min(44, 57 - base.bit_length())) for dim, n in totals.items() if n > 1}
    shared = shared_buckets(cut(_signatures(classes, schemes, base), "embedding-signatures"), "bucket", "embedding-buckets")
    found = cut(_linked(tiles(_members(classes, shared, schemes, base), "bucket", "num", BLOCK), least, schemes), "embedding-links")
    roots = components(found.where("other is not null").select(F.col("num").alias("a"), F.col("other").alias("b")), "embedding-cc")
    links = found.where("other is null").groupBy(F.col("num").alias("_k")).agg(F.sum("links").alias("links"))
    owner = classes.select("num", "key", "first", "n").join(links, F.col("num") == F.col("_k"), "left").drop("_k")
    owner = owner.join(roots, F.col("num") == F.col("node"), "left").withColumn("root", F.coalesce("root", "num"))
    owner = cut(owner.select("key", "root", "first", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "embedding-owner")
    group = cut(owner.groupBy("root").agg(F.min("first").alias("component_id")), "embedding-groups")
    known = cut(owner.join(group, "root").select(F.col("key").alias("_key"), "n_links", "component_id"), "embedding-known")
    joined = rows.select("id", "key").join(known, F.col("key") == F.col("_key"), "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select(F.col("id").alias(ident), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
