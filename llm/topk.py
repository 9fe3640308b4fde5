"""Exact top-k search by tiled matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import cut, map_arrow

#: Queries of a block and vectors of a shard; a tile is their product.
BLOCK = 1024
SHARD = 4096
#: Query blocks are sent to every task up to so many bytes, joined by their number beyond.
SENT = 64 << 20
#: Partial lists of a query that are merged in one step.
FAN_IN = 64
#: Query blocks whose lists a task holds; it hands on the oldest beyond.
HELD = 256
#: Largest magnitude of a component for which float64 products are exact.
EXACT = float(1 << 53)


def quantised(column: pa.ListArray, factor: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows take part, and floor(factor * x) of each: none that is null or holds null or non-finite components."""
    part, rows = np.zeros(len(column), dtype=bool), []
    for k, value in enumerate(column):
        if not value.is_valid or value.values is None or value.values.null_count:
            continue
        x = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
        if len(x) and np.isfinite(x).all():
            part[k] = True
            rows.append(np.floor(factor * x))
    return part, rows


def _blobs(vectors: DataFrame, ident: str, vector: str, factor: int, most: int) -> DataFrame:
    """(dim, ids, matrix): vectors of one width packed into rows of at most ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def blob(dim: int) -> pa.RecordBatch:
            ids, rows = held.pop(dim)
            return pa.record_batch([pa.array([dim], pa.int32()), pa.array([np.array(ids, dtype="<i8").tobytes()], pa.binary()), pa.array([np.array(rows).astype("<f8").tobytes()], pa.binary())], names=["dim", "ids", "matrix"])

        for batch in batches:
            part, rows = quantised(batch.column(1), factor)
            for key, row in zip(batch.column(0).to_numpy(zero_copy_only=False)[part].tolist(), rows):
                ids, some = held.setdefault(len(row), ([], []))
                ids.append(key)
                some.append(row)
                if len(ids) == most:
                    yield blob(len(row))
        for dim in list(held):
            yield blob(dim)

    found = vectors.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null")
    return map_arrow(found, run, "dim int, ids binary, matrix binary", SHARD)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products, exact: as float64 while they fit its 53 bits, then as int64, held to its range beyond."""
    most = x.shape[1] * float(np.abs(q).max()) * float(np.abs(x).max())
    if most < EXACT:
        return q @ x.T
    if most < 2.0**62:
        return q.astype(np.int64) @ x.T.astype(np.int64)
    limit = (1 << 63) - 1
    columns = [[int(a) for a in v] for v in x.tolist()]
    return np.array([[max(-limit, min(limit, sum(int(a) * b for a, b in zip(u, v)))) for v in columns] for u in q.tolist()], dtype=np.int64)


def _least(scores: np.ndarray) -> float | int:
    """A score below all others, of an entry that is none."""
    return -np.inf if scores.dtype.kind == "f" else np.iinfo(np.int64).min


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k entries of the best scores, ties to smaller ids, in each row; as row numbers and columns."""
    bar = np.full(len(scores), _least(scores), dtype=scores.dtype)
    if scores.shape[1] > 4 * k:  # all above the k-th score, and all at it
        bar = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    rows, columns = np.nonzero((scores >= bar[:, None]) & (scores > _least(scores)))
    order = np.lexsort((ids[columns], _falling(scores[rows, columns]), rows))
    rows, columns = rows[order], columns[order]
    first = np.searchsorted(rows, rows)
    keep = np.arange(len(rows)) - first < k
    return rows[keep], columns[keep]


def _falling(scores: np.ndarray) -> np.ndarray:
    """Numbers that rise as the scores fall."""
    return -scores if scores.dtype.kind == "f" else ~scores


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, ident: str = "vec_id", vector: str = "embedding", factor: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of ``vectors`` by integer inner product of floor(factor * x).

    A row with the query's own id is no candidate. Ties go to the smaller id. Vectors that are null,
    empty or hold null or non-finite components, and rows with a null id, take no part; vectors of
    unlike widths are not compared. Repeated candidate rows each count; a query row that repeats
    is answered once for each of its vectors.

    Queries are packed into blocks, vectors into shards; each tile's partial lists are kept by the
    task, which hands on k entries a query, merged FAN_IN at a time. Blocks are sent to all shards up to
    SENT bytes; more are dealt into groups of about so many, and each group meets the shards of each part.
    """
    blocks = cut(_blobs(queries.select(ident, vector).dropDuplicates(), ident, vector, factor, BLOCK).withColumn("block", F.monotonically_increasing_id()), "topk-queries")
    size = blocks.agg(F.sum(F.length("matrix") + F.length("ids"))).first()[0] or 0
    shards = _blobs(vectors, ident, vector, factor, SHARD)
    parts = shards.rdd.getNumPartitions()
    named = blocks.select("block", F.col("dim").alias("qdim"), F.col("ids").alias("qids"), F.col("matrix").alias("qmatrix"))
    if size <= SENT:
        tiles = shards.join(F.broadcast(named), F.col("dim") == F.col("qdim"))
    else:
        groups = -(-size // SENT)
        named = named.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups))).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        dealt = shards.withColumn("slice", F.pmod(F.spark_partition_id(), F.lit(parts))).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        tiles = dealt.join(named, ["group", "slice"]).where("dim = qdim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, tuple[np.ndarray, ...]] = {}
        part = TaskContext.get().partitionId()

        def rows(block: int) -> pa.RecordBatch:
            at, ids, scores, qids = lists.pop(block)
            columns = [np.full(len(at), block), qids[at], at.astype(np.int32), ids, scores, np.full(len(at), part, dtype=np.int32)]
            return pa.record_batch([pa.array(c) for c in columns], names=["block", "query_id", "entry", "vec_id", "score", "part"])

        for batch in batches:
            for r in batch.to_pylist():
                q, x = (np.frombuffer(r[c], dtype="<f8").reshape(-1, r["dim"]) for c in ("qmatrix", "matrix"))
                qids, ids = (np.frombuffer(r[c], dtype="<i8") for c in ("qids", "ids"))
                scores = _products(q, x)
                scores[qids[:, None] == ids[None, :]] = _least(scores)
                at, columns = _best(ids, scores, k)
                new = (at, ids[columns], scores[at, columns].astype(np.int64))
                if r["block"] in lists:
                    new = tuple(np.concatenate(pair) for pair in zip(lists[r["block"]], new))
                    order = np.lexsort((new[1], _falling(new[2]), new[0]))
                    order = order[np.arange(len(order)) - np.searchsorted(new[0][order], new[0][order]) < k]
                    new = tuple(x[order] for x in new)
                lists[r["block"]] = (*new, qids)
                if len(lists) > HELD:
                    yield rows(next(iter(lists)))
        for block in list(lists):
            yield rows(block)

    found = map_arrow(tiles.select("block", "dim", "ids", "matrix", "qids", "qmatrix"), run, "block long, query_id long, entry int, vec_id long, score long, part int", 4)
    while parts > FAN_IN:  # the tree: FAN_IN tasks' lists of a query at a time
        near = Window.partitionBy("block", "entry", F.floor(F.col("part") / FAN_IN)).orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).drop("rank")
        found = found.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        parts = -(-parts // FAN_IN)
    best = Window.partitionBy("block", "entry").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
