"""Shared pieces: tables in the shared folder, bounded Arrow batches and caches, prefix sums, components."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters that separate words: space and \t \n \v \f \r.
SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACES}]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Where it is unset a folder below the machine's temporary one serves, but only
    for a session whose tasks all run in the driver's process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'credence-scratch')}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, any executor may go."""
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._credence_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote; for tables that no later plan reads."""
    path = getattr(df, "_credence_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        there = jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(conf).delete(there, True)


def bound_batches(spark: SparkSession, rows: int = 256) -> None:
    """Hold Arrow batches to so many rows, so that long texts don't add up in a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def texts(column: pa.Array) -> list[str]:
    """Strings of an Arrow column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


_kept_in_worker: list = []
_at_work: str | None = None


def worker_cache(compute: Callable) -> Callable:
    """``functools.lru_cache`` for what a Python worker keeps from task to task, until ``begin`` of another operator."""
    cached = functools.lru_cache(maxsize=2)(compute)
    _kept_in_worker.append(cached)
    return cached


def begin(operator: str, *caches: Callable) -> None:
    """For the start of a task in a Python worker: empty the caches that aren't this operator's, if another one was at work.

    Workers serve one stage after another, so without this each would hold what all
    operators keep. What is free then goes back to the system.
    """
    global _at_work
    if operator == _at_work:
        return
    _at_work = operator
    for cached in _kept_in_worker:
        if cached not in caches:
            cached.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


class Cache(dict):
    """A dict of bounded size that computes what is missing.

    Two generations: when the young one is full it becomes the old one, and what is
    still in use moves back, so frequent keys stay and memory stays bounded.
    """

    def __init__(self, compute, limit: int, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the least node reachable.

    Alternating large-star and small-star steps on the edge list until it is a forest
    of stars. Each step is one aggregate with map-side combination and one equi-join that
    adaptive execution can split, so a hub with a third of the edges doesn't meet in a
    task. Every round ends in a written table. No edges: an empty result.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            near = pairs.union(pairs.select("b", "a")).toDF("u", "v")
        else:
            near = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        if large:
            least = least.select("u", F.least("u", "m").alias("m"))
        moved = near.join(least, "u")
        moved = moved.where("v > u" if large else "v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            moved = moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return moved.where("a != b").distinct()

    def starry(pairs: DataFrame) -> bool:
        """Whether every node has one smaller neighbour, or larger ones only."""
        ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high"))
        ends = ends.union(pairs.select("b", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
        return ends.where("low + high > 1 and low > 0").isEmpty()

    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    now = materialise(now, label)
    while not starry(now):
        after = materialise(star(star(now, True), False), label)
        release(now)
        now = after
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def exclusive_offsets(df: DataFrame, group: str, bucket: str, order: list[str], size: str, out: str, bits: int = 0) -> DataFrame:
    """Adds ``out``: the sum of ``size`` over the rows of the group that come before a row.

    Rows come by ``bucket``, then by ``order``. Sums inside a bucket and sums over one row
    for each bucket keep every task's share bounded; where buckets are numbers of more
    than ten ``bits``, their sums are made in the same way, a thousand buckets at a time.
    """
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(group, bucket).agg(F.sum(size).alias("_all"))
    if bits > 10:
        coarse = totals.withColumn(f"_wide{bits}", F.shiftright(bucket, 10))
        totals = exclusive_offsets(coarse, group, f"_wide{bits}", [bucket], "_all", "_sum", bits - 10).select(group, bucket, F.col("_sum").alias("_base"))
    else:
        before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select(group, bucket, F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_base"))
    local = df.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return local.join(totals, [group, bucket]).withColumn(out, (F.col("_base") + F.col("_in")).cast("long")).drop("_base", "_in")


def buckets_of(digest: Column, rows: int, each: int = 1024) -> tuple[Column, int]:
    """A number for about so many rows each, from the first digits of a hexadecimal digest, and its bits; it rises with the digest."""
    bits = min(40, (rows // each).bit_length())
    return F.shiftright(F.conv(F.substring(digest, 1, 10), 16, 10).cast("long"), 40 - bits), bits
