"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z alone; other letters stay as they are."""
    return F.translate(col, UPPER, LOWER)


def fold(col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids count as fold 0."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % folds, F.lit(0))


def workspace(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a folder of this machine only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Rows and bytes of an Arrow batch while tables are written, at most: texts go to Python a few megabytes at a time, however long they are.
ARROW_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


#: Shuffle files of a table go once it is written, not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> None:
    conf = df.sparkSession.conf
    before = {key: conf.get(key) for key in (*ARROW_LIMITS, SHUFFLE_CLEANUP)}
    for key, most in ARROW_LIMITS.items():
        now = before[key].rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            conf.set(key, value)


def small_batches(spark: SparkSession) -> None:
    """Keeps the session's Arrow batches within ARROW_LIMITS from now on: for operators whose result, made of whole texts in Python, is written by others."""
    for key, most in ARROW_LIMITS.items():
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def lean(each: Callable) -> Callable:
    """A map over batches whose worker gives free memory back at its end: idle workers live on beside the next stage's."""

    def run(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow

        yield from each(batches)
        pyarrow.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library keeps its memory
            pass

    return run


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back.

    This cuts the lineage in a way that survives lost executors, lets several
    readers share one computation, and gives later joins a plain scan of known size.
    """
    path = f"{workspace(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that are deleted at the end of a with block; results that are read later must be written outside of it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{workspace(spark)}/scratch-{uuid.uuid4().hex}"
        self.n = 0

    def table(self, df: DataFrame, what: str) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}-{what}"
        _write(df, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Deletes one of the tables, once nothing reads it any more."""
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.split("/scratch-")[-1].startswith(self.path.split("/scratch-")[-1]):
                self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self._delete(self.path)


def window_mix(words: np.ndarray, window: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of ``window`` word hashes."""
    n = max(0, len(words) - window + 1)
    h = np.zeros(n, np.uint64)
    for j, m in enumerate(np.random.default_rng(seed).integers(0, 1 << 63, window, dtype=np.uint64) * np.uint64(2) + np.uint64(1)):
        h += words[j : j + n] * m
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """Hashes of the runs of ``shingle`` words; of the whole sequence, if it is shorter and not empty."""
    w = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    return window_mix(w, min(shingle, len(w)), min(shingle, len(w))) if len(w) else w


def join_on_copy(left: DataFrame, right: DataFrame, key: str, right_key: str, how: str) -> DataFrame:
    """An equi-join that also compares a value made from the key.

    A side that was grouped by its key is otherwise joined without an exchange of
    its own, and adaptive execution can then not split a hot key of the other side.
    The second value asks for an exchange on both sides.
    """
    a = left.withColumn("__copy_l", F.xxhash64(key))
    b = right.withColumn("__copy_r", F.xxhash64(right_key))
    return a.join(b, (a[key] == b[right_key]) & (F.col("__copy_l") == F.col("__copy_r")), how).drop("__copy_l", "__copy_r")


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Smallest node that each node reaches.

    edges: columns a, b (long); order, repeats and self-loops don't matter.
    Returns node, component, for nodes with an edge to another node.
    Alternates large-star and small-star steps until nothing changes; every step
    moves only (node, smaller node) pairs, never neighbour lists, and the degree of
    a hub meets its hot partition only in joins that adaptive execution splits.
    """

    def smallest(e: DataFrame) -> DataFrame:
        return e.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m"))

    def state(e: DataFrame) -> tuple:
        x = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        return x["n"], x["s"]

    e = (
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    with Scratch(edges.sparkSession) as scratch:
        e = scratch.table(e, "edges")
        before = state(e)
        for _ in range(max_rounds):
            if not before[0]:
                break
            # Large star: every higher neighbour of a node moves to the node's smallest neighbour.
            large = join_on_copy(e, smallest(e), "lo", "node", "left").select("hi", F.coalesce("m", "lo").alias("lo"))
            large = scratch.table(large.distinct(), "edges")
            scratch.drop(e)
            # Small star: a node and its lower neighbours move to the smallest of them.
            met = join_on_copy(large, smallest(large), "hi", "node", "inner")
            small = met.select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("x"))
            e = scratch.table(small.select("x.*").where("hi <> lo").distinct(), "edges")
            scratch.drop(large)
            after = state(e)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        roots = e.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
        return materialize(e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots), "components")
