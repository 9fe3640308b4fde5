"""SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from llm.common import components, cut, map_arrow, segments, shared_buckets, small_pairs, text_bytes, tiles
from llm.words import mix

BITS = 64
#: Fingerprints looked at (not kept) when bits are grouped and candidates estimated.
SAMPLE = 2000
#: Buckets with more members take the linear path of ``_through_neighbours``.
DENSE = 128
#: Cost of verifying a candidate pair (one vectorised XOR) in units of a shuffled probe row.
PAIR_COST = 0.02


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The unsigned SimHash of a whole text; 0 if it has no words."""
    found = text_bytes(text).split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    length = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    end = np.cumsum(length + 1) - 1
    start = (end - length)[: len(found) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(start, end[words - 1 :].tolist())], dtype="<u8")
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (votes * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(ident, fp): the fingerprint of each row, as a signed long. Null and wordless texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)[ident]
    return map_arrow(docs.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text")), run, f"doc_id {kind}, fp long")


@dataclass(frozen=True)
class Plan:
    """Bit positions of each partition and the Hamming radius that is probed in it (-1: none)."""

    groups: tuple[tuple[int, ...], ...]
    radii: tuple[int, ...]


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _grouped(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Greedy grouping: each partition grows from a free bit by the free bits most correlated with it."""
    centred = bits - bits.mean(axis=0)
    scale = np.sqrt((centred**2).sum(axis=0)) + 1e-9
    close = np.abs(centred.T @ centred) / np.outer(scale, scale)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        width = len(free) // (parts - k)
        group = [free.pop(0)]
        while len(group) < width:
            best = max(free, key=lambda b: (close[b, group].sum(), -b))
            free.remove(best)
            group.append(best)
        groups.append(group)
    return groups


def plan(sample: np.ndarray, total: int, differ: int) -> Plan:
    """Partitions of correlated bits and unequal radii, at the least estimated work.

    By the generalised principle, radii whose sum is ``differ - parts + 1`` miss no pair. For each
    number of partitions a dynamic programme over (partition, sum of radii so far) finds the radii
    whose probes and candidates cost least; candidates are estimated from pairs of ``sample``.
    """
    bits = _bits(sample).astype(np.float64)
    half = len(sample) // 2
    best: tuple[float, Plan] | None = None
    for parts in range(1, differ + 3):
        groups = _grouped(bits, parts) if len(sample) > 1 else [list(range(k, BITS, parts)) for k in range(parts)]
        costs = []
        for group in groups:
            apart = np.zeros(0)
            if half:
                a, b = bits[:half][:, group], bits[half : 2 * half][:, group]
                apart = np.concatenate([(a != np.roll(b, s, axis=0)).sum(axis=1) for s in range(min(half, 64))])
            row = {-1: 0.0}
            for r in range(differ + 1):
                probes = sum(math.comb(len(group), j) for j in range(r + 1))
                chance = max(float((apart <= r).mean()) if len(apart) else 0.0, probes / 2.0 ** len(group))
                # A bucket beyond DENSE costs the neighbours of its members, not its pairs.
                row[r] = total * probes + total * min(PAIR_COST * chance * total, BITS + 1.0)
            costs.append(row)
        best_of: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for row in costs:
            after: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (cost, radii) in best_of.items():
                for r, extra in row.items():
                    if used + r not in after or cost + extra < after[used + r][0]:
                        after[used + r] = (cost + extra, (*radii, r))
            best_of = after
        cost, radii = best_of[differ - parts + 1]
        if best is None or cost < best[0]:
            best = cost, Plan(tuple(tuple(sorted(g)) for g in groups), radii)
    assert best is not None
    return best[1]


def _masks(plan: Plan) -> list[tuple[int, int, np.ndarray]]:
    """Of each probed partition: its number, its bits, and the flips within its radius."""
    found = []
    for k, (group, radius) in enumerate(zip(plan.groups, plan.radii)):
        if radius < 0:
            continue
        flips = [0]
        for bit in group:
            flips += [f | 1 << bit for f in flips if f.bit_count() < radius]
        found.append((k, sum(1 << b for b in group), np.array(sorted(flips, key=lambda f: (f.bit_count(), f)), dtype=np.uint64)))
    return found


def _signatures(distinct: DataFrame, plan: Plan) -> DataFrame:
    """(bucket, fp, own): each fingerprint in its own bucket of every probed partition, and as a probe in those near it."""
    masks = _masks(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for k, mask, flips in masks:
                values = ((fps & np.uint64(mask))[:, None] ^ flips[None, :]).ravel()
                bucket = mix(values + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15))
                yield pa.record_batch(
                    [
                        pa.array(bucket.view(np.int64)),
                        pa.array(np.repeat(fps, len(flips)).view(np.int64)),
                        pa.array(np.tile(np.arange(len(flips)) == 0, len(fps))),
                    ],
                    names=["bucket", "fp", "own"],
                )

    return map_arrow(distinct.select("fp"), run, "bucket long, fp long, own boolean", 10_000)


def _verified(rows: DataFrame, differ: int) -> DataFrame:
    """Edges between fingerprints that share a bucket and differ in few bits. Buckets are bounded by DENSE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in segments(batches, ["bucket", "tile_i", "tile_j"]):
            fps = table["fp"].to_numpy().view(np.uint64)
            own = table["own"].to_numpy()
            a, b = small_pairs(at[:-1], at[1:])
            near = (own[a] | own[b]) & (np.bitwise_count(fps[a] ^ fps[b]) <= differ) & (fps[a] != fps[b])
            yield pa.record_batch([pa.array(fps[a[near]].view(np.int64)), pa.array(fps[b[near]].view(np.int64))], names=["a", "b"])

    return map_arrow(rows, run, "a long, b long", 10_000)


def _through_neighbours(fps: DataFrame, differ: int) -> DataFrame:
    """Edges that link all of ``fps`` within ``differ`` bits, in linear work however dense they lie.

    Every fingerprint names all values within ceil(differ / 2) bits of it; two within ``differ`` bits
    name a common value, and those naming one value are within 2 * ceil(differ / 2) bits. For an even
    ``differ`` that is exact: each is linked with the smallest that names the value.
    """
    if differ % 2:
        raise ValueError("an even number of differing bits is needed")
    flips = [0]
    for bit in range(BITS):
        flips += [f | 1 << bit for f in flips if f.bit_count() < differ // 2]
    masks = np.array(flips, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            value = (own[:, None] ^ masks[None, :]).ravel()
            yield pa.record_batch([pa.array(value.view(np.int64)), pa.array(np.repeat(own, len(masks)).view(np.int64))], names=["value", "fp"])

    named = map_arrow(fps, run, "value long, fp long", 1000)
    # At most len(masks) fingerprints name a value, so these lists are bounded.
    groups = named.groupBy("value").agg(F.collect_list("fp").alias("fps"), F.min("fp").alias("a")).where(F.size("fps") > 1)
    return groups.select("a", F.explode("fps").alias("b")).where("a <> b").distinct()


def link(distinct: DataFrame, differ: int = 2) -> tuple[DataFrame, Plan]:
    """Edges (a, b) that connect all distinct fingerprints (column fp) within ``differ`` bits, and the plan used."""
    total = distinct.count()
    seen = distinct.orderBy(F.xxhash64("fp")).limit(SAMPLE).toPandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    chosen = plan(seen, max(total, 1), differ)
    shared = shared_buckets(_signatures(distinct, chosen), "bucket", "simhash-buckets")
    sparse = _verified(tiles(shared.where(F.col("members") <= DENSE), "bucket", "fp", DENSE), differ)
    dense = _through_neighbours(shared.where(F.col("members") > DENSE).select("fp").distinct(), differ)
    return sparse.unionAll(dense), chosen


def _classes(docs: DataFrame, ident: str, text: str, differ: int, words: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each row, and (fp, root, first, n) of each fingerprint: its class, smallest id and rows."""
    fps = cut(fingerprints(docs, ident, text, words), "simhash-fps")
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-distinct")
    edges, _ = link(distinct, differ)
    roots = components(edges, "simhash-cc")
    owner = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first", "n")
    return fps, cut(owner, "simhash-owner")


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", differ: int = 2, words: int = 3) -> DataFrame:
    """(ident, fingerprint, component_id, copies) for each row.

    Fingerprints that differ in at most ``differ`` bits are linked; component_id is the smallest id
    reachable. A null text is a text without words: fingerprint zero. Rows with a null id take part;
    component_id is null only if all ids of the component are. Repeated rows stay as they are. An
    empty table gives an empty result.
    """
    fps, owner = _classes(docs, ident, text, differ, words)
    group = cut(owner.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("copies")), "simhash-groups")
    known = cut(owner.select("fp", "root").join(group, "root"), "simhash-known")
    return fps.join(known, "fp").select(
        F.col("doc_id").alias(ident), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies", F.lower(F.lpad(F.hex("root"), 16, "0")).alias("class_fingerprint")
    )


def keep_first(docs: DataFrame, ident: str = "doc_id", text: str = "text", differ: int = 2, words: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, ids that are null last.

    Ids may repeat: of the component's rows with that id the one of the smallest fingerprint stays,
    and of rows alike in both the one of the smallest hash over all columns; rows of one id in other
    components have no part in that.
    """
    fps, owner = _classes(docs, ident, text, differ, words)
    best = F.min(F.struct(F.col("first").isNull().alias("nameless"), F.col("first").alias("id"), "fp"))
    kept = cut(owner.groupBy("root").agg(best.alias("best")).select(F.col("best.id").alias("_id"), F.col("best.fp").alias("_fp")), "simhash-kept")
    if not fps.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count():
        return docs.join(kept.hint("merge"), docs[ident] == kept["_id"], "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, F.col(f"`{ident}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["row", "id", "fp"])

    schema = StructType([rows.schema["row"], rows.schema["id"], StructField("fp", LongType())])
    rows = map_arrow(rows, run, schema).join(kept.hint("merge"), (F.col("fp") == F.col("_fp")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    return rows.groupBy("id", "fp").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
