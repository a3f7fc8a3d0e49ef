"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a broadcast table of ids, about 24 bytes each; beyond it the join shuffles.
MAX_BROADCAST_ROWS = 400_000

#: Rows that are sent to Python at once, and about how many bytes: a batch is in memory several times.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

#: Bytes that are worth a file of their own.
FILE_BYTES = 1 << 20

_local_dir: str | None = None

#: What empties the caches that a Python worker holds, by operator.
_caches: dict[str, Callable[[], None]] = {}


def cache(operator: str, empty: Callable[[], None]) -> None:
    _caches[operator] = empty


def task(operator: str, keep: bool = False) -> Callable:
    """Wraps the body of a mapInArrow, as Python workers live on and take tasks of any operator.

    A task first empties the caches that other operators left in its worker, and
    at its end its own (unless the next task of the operator had better
    ``keep`` them), and gives freed memory back to the system.
    """

    def wrapper(body):
        @wraps(body)
        def run(*given, **named):
            for other, empty in _caches.items():
                if other != operator:
                    empty()
            try:
                yield from body(*given, **named)
            finally:
                if not keep and operator in _caches:
                    _caches[operator]()
                _trim()

        return run

    return wrapper


def _trim() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where the session has none, in local mode (as in tests) a temporary folder
    of this machine is made and removed at exit; on a cluster that is an error.
    """
    global _local_dir
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="ballast-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return f"file://{_local_dir}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/ballast/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder, in no more than ``files`` files if given, and returns the written table.

    This cuts lineage and survives the loss of executors.
    """
    path = fresh_path(df.sparkSession, name)
    (df.coalesce(files) if files else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table in the shared folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def few_files(spark: SparkSession, path: str) -> int | None:
    """In how many files tables of about the size of that at ``path`` are written; None if the session makes no more than twice as many.

    For each new file Hadoop's local file system starts a process, for whose
    first moment an executor's memory counts twice.
    """
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
    files = max(2 * spark.sparkContext.defaultParallelism, size // FILE_BYTES)
    return files if int(spark.conf.get("spark.sql.shuffle.partitions")) > 2 * files else None


def row_key() -> Column:
    """A key of a row of ``docs(doc_id, text)`` that is never null: rows of the same key hold the same id and text."""
    return F.xxhash64("doc_id", "text")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def bounded_broadcast(df: DataFrame) -> DataFrame:
    """Marks a table of ids for broadcast if it has no more than MAX_BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else df


def small_batches(spark: SparkSession) -> None:
    """Makes the session send no more than BATCH_ROWS rows and about BATCH_BYTES bytes to Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
