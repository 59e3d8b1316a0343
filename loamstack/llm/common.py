"""Helpers that the training-data operators share: tables, the shared folder, membership bitmaps, components."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; only where that is unset (tests), a local one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + os.path.join(tempfile.gettempdir(), "loamstack-shared")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Rows and bytes of one batch between the JVM and Python. Texts are long; Spark's default of 10,000 rows takes both sides
#: hundreds of MB.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """The same table; from now on the session hands Python batches of bounded size."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def giving_back(f: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The same function for mapInArrow. Python workers live on between tasks; at a task's end this one returns what it has freed
    to the system, which the allocators would keep."""

    def run(batches: Batches) -> Batches:
        yield from f(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it again, which cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Least and greatest number of bits of a membership bitmap (128 KB to 16 MB); it has eight bits or more for each id as far as
#: the greatest allows. Beyond, more rows pass than need to.
BITMAP_BITS = 1 << 20, 1 << 27
_BITS_PER_ROW = 32768


def id_bitmap(ids: DataFrame, col: str) -> bytes:
    """A bitmap of hashed ids, sized by their number. A clear bit proves absence, a set bit proves nothing. `ids` should be stored."""
    bits = min(BITMAP_BITS[1], max(BITMAP_BITS[0], 1 << (8 * ids.count()).bit_length()))
    slot = F.pmod(F.xxhash64(F.col(col)), F.lit(bits)).alias("slot")
    rows = (
        ids.select(slot)
        .groupBy(F.floor(F.col("slot") / _BITS_PER_ROW).cast("int").alias("block"))
        .agg(F.bitmap_construct_agg(F.col("slot") % _BITS_PER_ROW).alias("bits"))
        .collect()  # at most 4096 rows of 4 KB
    )
    out = bytearray(bits // 8)
    for r in rows:
        at = r["block"] * _BITS_PER_ROW // 8
        out[at : at + len(r["bits"])] = r["bits"]
    return bytes(out)


def fresh(df: DataFrame, name: str) -> str:
    """The name, made longer until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def in_bitmap(df: DataFrame, col: str, bitmap: bytes) -> tuple[DataFrame, DataFrame]:
    """(rows that may be in the bitmap, rows that surely are not); both read only what their plans need."""
    spark = df.sparkSession
    bits, zeros = 8 * len(bitmap), bytes(4096)
    blocks = [(i, bytearray(x)) for i in range(bits // _BITS_PER_ROW) if (x := bitmap[i * 4096 : (i + 1) * 4096]) != zeros]
    slot, block, held, hit = (fresh(df, n) for n in ("_slot", "_block", "_bits", "_hit"))
    small = spark.createDataFrame(blocks, f"{block} int, {held} binary")  # 16 MB at most
    marked = df.withColumn(slot, F.pmod(F.xxhash64(F.col(col)), F.lit(bits)))
    marked = marked.join(F.broadcast(small), F.floor(F.col(slot) / _BITS_PER_ROW).cast("int") == F.col(block), "left")
    at = (F.col(slot) % _BITS_PER_ROW).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(held), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(F.getbit(byte.cast("long"), at % 8), F.lit(0)) == 1
    marked = marked.withColumn(hit, bit).drop(slot, block, held)
    return marked.filter(F.col(hit)).drop(hit), marked.filter(~F.col(hit)).drop(hit)


#: Of all rows, a key with more than one in so many is hot. There are fewer such keys than this.
HOT_SHARE = 1000


def join_counted(big: DataFrame, small: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Inner join with `small`, whose column `count` says how many of `big`'s `total` rows each key has. Rows of `small` for hot
    keys, fewer than HOT_SHARE, are broadcast, so no hot key's rows are brought together. Both sides should be stored."""
    cut = max(total // HOT_SHARE, HOT_SHARE)
    hot, rest = F.broadcast(small.filter(F.col(count) > cut)), small.filter(F.col(count) <= cut)
    return big.join(hot, on).unionByName(big.join(hot.select(*on), on, "left_anti").join(rest, on))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected graph: (id, root), root the least id reachable; vertices without edges are absent.

    Least labels go to neighbours and are then followed twice (pointer jumping), so the rounds grow with the
    logarithm of a component's diameter. Each round's labels are written to the shared folder. Vertices with many
    neighbours and roots of many vertices are hot keys of these joins.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    there, back = F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
    both = materialise(pairs.select(F.inline(F.array(there, back))).distinct(), "edges")  # a union would make the edges twice
    labels = both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("id")).alias("root"), F.count(F.lit(1)).alias("degree"))
    labels = materialise(labels, "labels")
    ends, ids = both.count(), labels.count()
    while True:
        near = join_counted(both, labels.select(F.col("id").alias("v"), "root", "degree"), ["v"], "degree", ends)
        near = near.groupBy(F.col("u").alias("id")).agg(F.min("root").alias("low"))
        step = materialise(labels.join(near, "id").select("id", F.least("root", "low").alias("root"), "degree"), "labels")
        up = step.groupBy("root").agg(F.count(F.lit(1)).alias("size")).join(step.select(F.col("id").alias("root"), F.col("root").alias("up")), "root")
        step = join_counted(step, materialise(up, "roots"), ["root"], "size", ids).select("id", F.col("up").alias("root"), "degree")
        step = materialise(step, "labels")
        old = labels.select("id", F.col("root").alias("was"))
        moved = step.join(old, "id").filter("root <> was").limit(1).count()
        labels = step
        if not moved:
            return labels.drop("degree")
