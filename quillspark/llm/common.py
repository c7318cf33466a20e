"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as all contracts of this subpackage have it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (``spark.checkpoint.dir``); cleanup() deletes all of a session's.

    Where the setting is absent a local session, as in tests on one machine,
    gets a temporary folder as its checkpoint folder; any other is an error, as
    executors would each write to a disk of their own.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", top)
        spark.sparkContext.setCheckpointDir(top)
    modest(spark)
    path = f"{top.rstrip('/')}/{_session_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    for made in _recordings:
        made.append(path)
    return path


_recordings: list[list[str]] = []


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that scratch() gives meanwhile."""
    made: list[str] = []
    _recordings.append(made)
    try:
        yield made
    finally:
        _recordings.remove(made)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that are no longer read."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _session_folder(spark: SparkSession) -> str:
    return f"quillspark-{spark.sparkContext.applicationId}"


def cleanup(spark: SparkSession) -> None:
    """Deletes what this session wrote with scratch() and stored(); results that were not read by then are gone."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{top.rstrip('/')}/{_session_folder(spark)}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


BLOCK_BYTES = 32 * 2**20  # of a stored table's row groups, which writers hold in memory

WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder (in folders of the last column ``by``, if given) and read again: its lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writers = spark.conf.get(WRITERS, "0")
    if by:
        spark.conf.set(WRITERS, "16")  # else each task sorts its rows first
    try:
        df.write.option("parquet.block.size", BLOCK_BYTES).parquet(path, partitionBy=by)
    finally:
        spark.conf.set(WRITERS, writers)
    return spark.read.schema(df.schema).parquet(path)


#: Keys with more than this part of all rows are hot: there can be no more than 10,000 of them.
HOT = 10_000
SALTS = 64


def joined(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "left", most: int = 20_000, size: str | None = None, weight: Column | None = None) -> DataFrame:
    """``rows`` joined to ``side`` (stored, unique by ``keys``) without a task for any hot key.

    A side of up to ``most`` rows (and 64 MB of ``weight``, if given) is
    broadcast. Beyond that rows of hot keys, HOT at most, are salted. ``size``
    names a column of ``side`` that tells how many rows have its key; else the
    rows are counted. Keys are not null.
    """
    total = side.agg(F.count(F.lit(1)), F.sum(weight if weight is not None else F.lit(0))).collect()[0]
    if total[0] <= most and (total[1] or 0) <= 64_000_000:
        return rows.join(F.broadcast(side), keys, how)
    sizes = side.select(*keys, F.col(size).alias("_n")) if size else stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "key-sizes")
    every = sizes.agg(F.sum("_n")).collect()[0][0] or 0
    hot = F.broadcast(stored(sizes.where(F.col("_n") > max(1000, every // HOT)).select(*keys, F.lit(SALTS).alias("_salts")), "hot-keys"))
    spread = F.pmod(F.monotonically_increasing_id(), F.coalesce("_salts", F.lit(1)).cast("long")).cast("int")
    salted = rows.join(hot, keys, "left").withColumn("_salt", spread).drop("_salts")
    each = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    return salted.join(side.join(hot, keys, "left").withColumn("_salt", each).drop("_salts"), [*keys, "_salt"], how).drop("_salt")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def null_safe_key(column: str) -> Column:
    """The column as a string that joins like any value even where it is null."""
    return F.when(F.col(column).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(column).cast("string")))


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``limit`` bytes of ``column`` (or one row)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total + n > limit and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def release() -> None:
    """Gives freed memory back to the system: Python processes of executors outlive the stage that filled them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


ARROW, ROWS_OF_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def modest(spark: SparkSession) -> None:
    """Arrow batches of ROWS_OF_BATCH texts, unless the session has a size of its own: with Spark's ten thousand, batches of long texts
    take hundreds of megabytes of each executor, outside of its heap and in its Python processes."""
    if spark.conf.get(ARROW, "10000") == "10000":
        spark.conf.set(ARROW, str(ROWS_OF_BATCH))


def tidy(run):
    """``run`` over modest() batches, and release() after the last."""
    if spark := SparkSession.getActiveSession():
        modest(spark)

    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped
