"""What the operators of this package share: columns, Arrow streams, written cuts, components."""

from __future__ import annotations

import ctypes
import gc
import weakref
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid.session import scratch_path

#: Bytes that separate words where a contract says ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits
#: at exactly these.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


_kept: list = []


def kept(fn):
    """``fn`` of one argument, its latest value kept by a Python worker for its later tasks."""
    held = lru_cache(maxsize=1)(fn)
    _kept.append(held)
    return held


def forget() -> None:
    """Let go what this Python worker keeps of other operators' tasks, back to the machine."""
    if any(f.cache_info().currsize for f in _kept):
        for f in _kept:
            f.cache_clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass


def slim(spark: SparkSession, most: int = 4 << 20) -> None:
    """Let the session's Arrow batches hold at most ``most`` bytes, so that what a Python worker and
    its executor hold of long texts does not depend on the number of rows in a batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > most:
        spark.conf.set(key, str(most))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table, whole."""
    slim(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so lost executors cost a re-read only.

    The finished job's shuffle files are let go: Spark drops them once the driver has collected the
    objects that name them.
    """
    spark, schema, path = df.sparkSession, df.schema, scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    _written[id(out)] = (weakref.ref(out), path)
    return out


_written: dict[int, tuple[weakref.ref, str]] = {}


def release(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once what was made of them is written itself."""
    for table in tables:
        found = _written.pop(id(table), None)
        if found and found[0]() is table:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(found[1])
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def arrow_map(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """One batch in, one batch out, in parallel; batches are bounded by rows and bytes by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text of an Arrow string column; null gives no bytes."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def crc_fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of unsigned 64-bit integers (wraps around)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Forest:
    """Union-find over the integers below ``n`` of one task; ``roots`` has each one's tree."""

    def __init__(self, n: int):
        self.roots = np.arange(n)

    def join_all(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Join the trees of each pair; the pairs that made two trees one."""
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        joined = []
        for i, j, x, y in zip(a.tolist(), b.tolist(), self.roots[a].tolist(), self.roots[b].tolist()):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                joined.append((i, j))
        if up:
            table = np.arange(len(self.roots))
            table[list(up)] = [find(x) for x in list(up)]
            self.roots = table[self.roots]
        return joined


def components(edges: DataFrame, label: str = "components", rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b; long): rows (node, component), the
    component named by its smallest node. Nodes without an edge are not listed.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): every node hangs its
    larger, then its smaller neighbours below the smallest node it knows. Each step is one grouped
    minimum and one join on node, and every round is written to the shared folder. No edges: no
    rows.
    """

    def step(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.where("b < a")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        kept = both.where("b > a") if large else both
        moved = kept.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.select("a", F.col("m").alias("b"))
        out = moved if large else moved.unionByName(own)
        return out.where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        row = e.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        return row["n"], row["h"]

    now = cut(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b")
        .distinct(),
        label,
    )
    seen = state(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        before, now = now, cut(step(step(now, True), False), label)
        release(before)
        fresh = state(now)
        if fresh == seen:
            break
        seen = fresh
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    down = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return down.unionByName(roots)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
