"""Intermediate tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``. Only a local session (tests) may leave it unset; it then gets a
temporary folder. Writing a table cuts the lineage: whatever comes later survives the loss of any executor.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch, or one row; each task holds a few batches outside the JVM's heap.
BATCH_BYTES = 4 << 20
#: For rows of megabytes: Parquet looks at sizes after 100 rows else, so that pages and the codec's buffers outside the heap
#: hold 200 MB a task, and its readers load whole row groups of them.
LARGE_ROWS = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def spark_hash(values: np.ndarray) -> np.ndarray:
    """The hash by which Spark partitions and buckets a long column: Murmur3, 32 bits, seed 42."""
    h = np.full(len(values), 42, dtype=np.uint32)
    whole = values.astype(np.int64).view(np.uint64)
    for k in ((whole & np.uint64(0xFFFFFFFF)).astype(np.uint32), (whole >> np.uint64(32)).astype(np.uint32)):
        k = _rotated(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = _rotated(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def numbers_in_bucket(first: int, bucket: int, buckets: int) -> Iterator[int]:
    """The numbers from first on that bucketBy(buckets, ...) puts into one bucket, in order."""
    step = 16 * buckets
    while True:
        tried = np.arange(first, first + step, dtype=np.int64)
        yield from tried[spark_hash(tried) % buckets == bucket].tolist()
        first += step


def limit_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on an Arrow batch to BATCH_BYTES; a lower one stays.

    It stays lowered, as plans that an operator returns run later.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, with as many underscores before them as no column begins with."""
    free = "_" * (1 + max([len(c) - len(c.lstrip("_")) for c in columns], default=0))
    return [free + n for n in names]


class Scratch:
    """The intermediate tables of one operator call, below one folder of its own."""

    def __init__(self, spark: SparkSession, label: str):
        limit_batches(spark)
        self.spark = spark
        self.name = f"{label}_{uuid.uuid4().hex[:16]}"
        self.root = f"{shared_dir(spark)}/tracewright/{self.name}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def keep(self, df: DataFrame, table: str) -> DataFrame:
        """Write df and return it as read back."""
        began = time.monotonic()
        df.write.mode("overwrite").parquet(self.path(table))
        back = self.spark.read.schema(df.schema).parquet(self.path(table))
        del df
        if time.monotonic() - began > 2:  # shorter jobs leave little behind
            self.tidy()
        return back

    def keep_bucketed(self, df: DataFrame, table: str, key: str, buckets: int) -> DataFrame:
        """Like keep(), hashed by key on disk, so that later joins by key don't move these rows again. Rows may be large."""
        name = f"{self.name}_{table}"
        df.write.mode("overwrite").options(**LARGE_ROWS).bucketBy(buckets, key).option("path", self.path(table)).saveAsTable(name)
        back = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # of its entry in the catalog alone: back has the files and buckets
        return back

    def drop(self, table: str) -> None:
        """Delete a table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(table))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def tidy(self) -> None:
        """Let the driver notice plans that are no longer referenced, so that their shuffle files go."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
