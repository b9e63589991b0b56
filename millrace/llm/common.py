"""What the corpus operators share: column rules, session helpers and shared folders."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Rows of text that one Arrow slice holds at most while it is worked on in Python.
SLICE_ROWS = 512


def lower_az(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def remainder(id_col: str, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % k


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or the session's checkpoint folder.

    Without one, only a session on one machine may go on, in Spark's warehouse folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = jdir.get() if jdir.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder for a table that cuts lineage."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Writes in this block delete their shuffle files as they end: the table stands, nobody reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, what: str, gone: list[str] | None = None) -> DataFrame:
    """The rows, written in the shared folder and read again; the path is added to `gone`."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    with shuffles_freed(spark):
        df.write.parquet(path)
    if gone is not None:
        gone.append(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, what: str, by: str, gone: list[str] | None = None) -> DataFrame:
    """The rows, written in the shared folder and bucketed, so that grouping by the column moves none of them; the path is added to `gone`."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, what)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    with shuffles_freed(spark):
        df.repartition(n, by).write.option("path", path).format("parquet").bucketBy(n, by).sortBy(by).saveAsTable(name)
    if gone is not None:
        gone.append(path)
    return spark.table(name)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        spark.sql(f"DROP TABLE IF EXISTS `{path.rsplit('/', 1)[1].replace('-', '_')}`")  # of bucketed ones
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffles of finished jobs now; otherwise they stay until the driver's heap fills."""
    gc.collect()
    spark._jvm.System.gc()


#: What a Python worker keeps from task to task: the table of one operator.
_kept: dict = {}


def kept(key: tuple, build: Callable[[], object]):
    """The worker's table, built once and reused by its later tasks; a worker that comes to another operator lets the one before go."""
    if key not in _kept:
        let_go()
        _kept[key] = build()
    return _kept[key]


def let_go() -> None:
    """A worker of an earlier stage frees what that stage kept."""
    if _kept:
        _kept.clear()
        gc.collect()  # caches and the tables they fill from refer to each other
        pa.default_memory_pool().release_unused()
        with suppress(AttributeError, OSError):  # glibc keeps what is freed; other libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)


def free_name(taken: Iterable[str], base: str) -> str:
    """A column name that no given one equals, in any case."""
    taken = {t.lower() for t in taken}
    while base.lower() in taken:
        base += "_"
    return base


def text_hash(text: Column) -> Column:
    """128 bits of a text; null differs from the empty text."""
    return F.when(text.isNull(), F.lit("null")).otherwise(F.md5(text))


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that few whole texts are Python objects at any time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
