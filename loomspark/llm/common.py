"""What several operators share: input tables, lineage cuts, batches of bounded size and connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python worker handles at once; a longer single document forms a batch of its own.
BATCH_CHARS = 3_000_000


#: Bytes of an Arrow batch between Spark and Python, so that its memory doesn't depend on the length of texts.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by ``BATCH_BYTES`` in a session that has no bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; further columns than those that an operator names are ignored by it."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``. Unset, a local master has a temporary one; others fail."""
    small_batches(spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        found = context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="loomspark-")
        atexit.register(shutil.rmtree, found, True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint: later jobs read the shared folder and never recompute what came before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files that nothing refers to any more, which it does only once the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def trim() -> None:
    """Gives what this process has freed back to the system: Arrow's pool, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def anew(value: Column) -> Column:
    """A long, twice inverted: Spark no longer knows that rows are dealt by it and deals them again for a join, whose
    exchanges adaptive execution can then split where one key is hot."""
    return F.bitwise_not(F.bitwise_not(value))


#: Positions of a bit table: at most 2^19 rows of 64 bits, thus 8 MB whatever the number of keys.
POSITIONS = 1 << 25


def bit_table(keys: DataFrame, key: str) -> DataFrame:
    """Checkpointed (word, bits): a table in which the position of every key of ``keys`` is set."""
    place = F.xxhash64(key).bitwiseAND(F.lit(POSITIONS - 1)).alias("place")
    return cut(keys.select(place).groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits")))


def with_hits(df: DataFrame, key: Column, table_: DataFrame, name: str) -> DataFrame:
    """``df`` and a column ``name``: whether the position of ``key`` is set, which holds of every key of the table and of
    few others while it isn't full. The table is broadcast; its size is bounded. Null keys count as set."""
    place, w, b = F.xxhash64(key).bitwiseAND(F.lit(POSITIONS - 1)), unused(df, "bit_word"), unused(df, "bit_bits")
    words = F.broadcast(table_.select(F.col("word").alias(w), F.col("bits").alias(b)))
    hit = key.isNull() | F.coalesce(F.getbit(F.col(b), place.bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
    return df.join(words, F.shiftright(place, 6) == F.col(w), "left").withColumn(name, hit).drop(w, b)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_batches(rows: Iterable[tuple], of=lambda row: row[1], most: int = BATCH_CHARS) -> Iterator[list[tuple]]:
    """Groups rows into lists whose texts add up to ``most`` characters or little more."""
    batch, chars = [], 0
    for row in rows:
        batch.append(row)
        chars += len(of(row) or "") + 16
        if chars >= most:
            yield batch
            batch, chars = [], 0
    if batch:
        yield batch


def arrow_rows(batch, *names: str) -> Iterator[tuple]:
    """Rows of an Arrow batch, a slice at a time, so that not all of its texts become Python strings at once."""
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    for at in range(0, batch.num_rows, 256):
        yield from zip(*(c.slice(at, 256).to_pylist() for c in columns))


def forest(pairs: Iterable[tuple]) -> list[tuple]:
    """A spanning forest of the given pairs, as (member, root) with the smallest member as root."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in up if root(x) != x]


def union(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``root`` with the sets of x and y united; root[i]: the smallest of i's set."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while len(np.flatnonzero(root != root[root])):
            root = root[root]


#: Links that a task joins at once before they are dealt.
LINKS = 500_000


def contracted(batches):
    """Links (u, v) as stars: of each group that a task's links join, every member with the smallest one."""

    def stars(parts):
        ids, at = np.unique(np.concatenate(parts), return_inverse=True)
        at = at.reshape(-1, 2)
        root = union(np.arange(len(ids)), at[:, 0], at[:, 1])
        moved = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], names=["u", "v"])

    kept, size = [], 0
    for batch in batches:
        kept.append(np.stack([batch.column(i).to_numpy() for i in (0, 1)], 1))
        size += len(kept[-1])
        if size >= LINKS:
            yield stars(kept)
            kept, size = [], 0
    if kept:
        yield stars(kept)


def components(edges: DataFrame, a: str = "a", b: str = "b", limit: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; a component's id is its smallest node.

    Every task first joins the links at hand into stars; then alternating large-star and small-star rounds on distributed edges: each round is two grouped minima and two joins
    on the node and a distinct. The minima are dealt anew for their join, so that adaptive
    execution can split a hub's links. The number of rounds is about the logarithm of the longest chain; only one row of convergence sums reaches the driver.

    Rounds are kept as Parquet in the shared folder until the next is written, not as checkpoints: these inherit Spark's
    estimate of their size, to which each join multiplies, so that a round took it to the fourth power and the driver's
    memory went to numbers of millions of digits. Files are estimated by their size.
    """
    spark = edges.sparkSession
    folder, before, k = f"{shared_dir(spark)}/components-{uuid.uuid4().hex}", None, anew(F.col("u")).alias("k")

    def stored(links: DataFrame, number: int) -> DataFrame:
        links.write.parquet(f"{folder}/{number}")
        if number:
            remove(spark, f"{folder}/{number - 1}")
        return spark.read.schema("u long, v long").parquet(f"{folder}/{number}")

    try:
        e = stored(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().mapInArrow(contracted, "u long, v long"), 0)
        for number in range(1, limit + 1):
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select(k, F.least("u", "m").alias("m"))
            large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m")).select(k, "m")
            joined = large.join(low, F.col("u") == F.col("k"))
            small = joined.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
            e = stored(small, number)
            now = tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) as decimal(38,0)))")).first())
            if now == before:
                break
            before = now
        else:
            raise RuntimeError("components did not converge")
        e = cut(e)
    finally:
        remove(spark, folder)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
