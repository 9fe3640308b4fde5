"""What the operators share: scratch tables, segment-wise tiles, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of text that a function is given at once; bounds a Python worker's memory.
TEXT_ROWS = 1000
#: Bytes of an Arrow batch between the JVM and its workers, where the session keeps Spark's default.
BYTES_SETTING, BYTES_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent (a single machine, as in tests) a temporary folder is made once
    and kept in the session's configuration.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; on a cluster it must name a shared folder")
        found = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", found)
    # Tasks that write by themselves know nothing of the cluster's default file system.
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str, pieces: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives executors.

    ``pieces`` bounds the number of files, where a bound of the rows is known.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    (df if pieces is None else df.coalesce(pieces)).write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more, and let go of the shuffles that made them.

    Spark deletes a shuffle's files when the driver's collector finds that nothing refers to it,
    which in a long row of queries may be late.
    """
    for table in tables:
        _delete(table.sparkSession, table._scratch)
    tables[0].sparkSession._jvm.java.lang.System.gc()


def drop_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application, once their results have been read."""
    _delete(spark, f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}")


def map_arrow(df: DataFrame, fn: Callable, schema: str | StructType, rows: int = TEXT_ROWS) -> DataFrame:
    """``mapInArrow`` whose function gets batches of at most ``rows`` rows.

    Plans run later than they are made, so the session gets one bound that suits all operators, in
    bytes, unless it has its own; the rows are counted here.
    """
    conf = df.sparkSession.conf
    if conf.get(BYTES_SETTING) == BYTES_DEFAULT:
        conf.set(BYTES_SETTING, BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(batch.slice(a, rows) for batch in batches for a in range(0, max(1, batch.num_rows), rows))

    return df.mapInArrow(run, schema)


def text_bytes(value: str | None) -> bytes:
    """A text's bytes with A-Z lower-cased; a null text is empty."""
    return b"" if value is None else value.encode("utf-8", "surrogatepass").lower()


def remainder(column: str, n: int) -> F.Column:
    """crc32 of an id written as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


# --- connected components -------------------------------------------------------------------


#: Edges that a task contracts at once, and rows of a table of a round that a file holds, about.
CONTRACTED = 1 << 18
ROWS_A_FILE = 50_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that connect what the given ones (a, b) do, each to the smallest node of what a chunk connects."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def stars() -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*held))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(nodes))
        for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
            forest.join(x, y)
        root = np.array([forest.find(k) for k in range(len(nodes))], dtype=np.int64)
        far = np.flatnonzero(root != np.arange(len(nodes)))
        held.clear()
        return pa.record_batch([pa.array(nodes[far]), pa.array(nodes[root[far]])], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(a) for a, _ in held) >= CONTRACTED:
            yield stars()
    if held:
        yield stars()


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges`` has columns a, b of long numbers. Returns (node, root), root being the smallest
    node reachable, for every node that has an edge. Tasks first contract the edges of a file. Each
    round is two partial aggregations and two joins whose inputs are both scratch tables, so adaptive
    execution can split a hot node. It ends when all nodes have one edge, to a node that has none to a smaller.
    """
    edges = cut(edges.where("a <> b").select("a", "b").distinct(), name)
    pieces = 8 + edges.count() // ROWS_A_FILE  # rounds make no table of more than twice as many rows
    edges = cut(map_arrow(edges, _contracted, "a long, b long", CONTRACTED).distinct(), name, pieces)
    while True:
        low = edges.groupBy(F.col("a").alias("u")).agg(F.count("*").alias("n"))
        deeper = edges.select(F.col("b").alias("u")).join(low, "u", "left_semi")
        if not low.where("n > 1").select("u").unionAll(deeper).limit(1).count():
            break
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy(F.col("a").alias("u")).agg(F.least(F.first("a"), F.min("b")).alias("m")), name, pieces)
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a <> b").distinct(), name, pieces)
        low = cut(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), name, pieces)
        small = large.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b")
        before, edges = edges, cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name, pieces)
        drop(before, low, large)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


# --- buckets cut into tiles -----------------------------------------------------------------


def shared_buckets(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` of buckets with two members or more, with their number as ``members``; a scratch table."""
    counts = cut(rows.groupBy(key).agg(F.count("*").alias("members")).where("members > 1"), name)
    found = cut(rows.join(counts, key), name)
    drop(counts)
    return found


def tiles(rows: DataFrame, key: str, ident: str, block: int) -> DataFrame:
    """Rows of ``shared_buckets`` dealt into tiles of at most about two blocks.

    A bucket of c members is split into ceil(c / block) blocks by a hash of ``ident``, and each pair
    of blocks is a tile, so that every pair of a bucket's members meets in exactly one tile and no
    task holds a whole hot bucket. Adds tile_i, tile_j and block; sorted by bucket and tile.
    """
    dealt = (
        rows.withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64(F.col(ident), F.lit(7)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("tile_i", F.least("block", "other"))
        .withColumn("tile_j", F.greatest("block", "other"))
        .drop("members", "blocks", "other")
    )
    return dealt.repartition(key, "tile_i", "tile_j").sortWithinPartitions(key, "tile_i", "tile_j")


def segments(batches: Iterator[pa.RecordBatch], by: list[str], most: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of sorted batches, with the offsets at which their groups begin (and the end)."""
    held: list[pa.RecordBatch] = []
    count = 0

    def bounds(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        for column in by:
            values = table[column].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.concatenate([[0], np.flatnonzero(new), [table.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < most:
            continue
        table = pa.Table.from_batches(held)
        at = bounds(table)
        if len(at) > 2:
            yield table.slice(0, at[-2]), at[:-1]
        held = table.slice(at[-2]).to_batches()
        count = table.num_rows - at[-2]
    if held:
        table = pa.Table.from_batches(held)
        yield table, bounds(table)


def small_pairs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs inside the groups [start, end), without a loop over groups."""
    size = ends - starts
    row = np.repeat(np.arange(len(size)), size)
    first = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    later = size[row] - first - 1
    a = np.repeat(starts[row] + first, later)
    b = a + 1 + np.arange(later.sum()) - np.repeat(np.cumsum(later) - later, later)
    return a, b


class Forest:
    """Union-find over small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
