"""What the operators of this package have in common: shared intermediates, readers, Arrow columns."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where the session names none and all runs in one process, as in
    tests, is one made: on a cluster, executors would write to disks of their own."""
    if not (at := spark.conf.get("spark.checkpoint.dir", None)):
        if not (at := spark.sparkContext.getCheckpointDir()):
            if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            at = f"file://{tempfile.mkdtemp(prefix='pagemill-')}"
            spark.sparkContext.setCheckpointDir(at)
    return at


def checkpointed(df: DataFrame) -> DataFrame:
    """Rows written once to the shared folder, for small rows and loops. Spark's cleaner removes them where
    spark.cleaner.referenceTracking.cleanCheckpoints is on."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Removes an execution's shuffle files at its end; what written() wrote needs them no more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_lock, _open = threading.Lock(), {}


@contextlib.contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    """Sets the clean-up while any thread of the session writes; the last one puts back what was set before."""
    with _lock:
        n, before = _open.get(id(spark), (0, spark.conf.get(_CLEANUP, "false")))
        _open[id(spark)] = n + 1, before
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _open.pop(id(spark))
            if n > 1:
                _open[id(spark)] = n - 1, before
            else:
                spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Rows written once as a Parquet table in the shared folder and read back: cuts the lineage so that
    a lost executor costs no more than the tasks it ran, and frees the shuffles it took. forget(), drop_written() or the
    driver's end removes the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/pagemill/{name}-{uuid.uuid4().hex}"
    with _freeing(spark):
        df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing will read again."""
    for t in tables:
        _written.remove((t.sparkSession, t._written_at))
        _delete(t.sparkSession, t._written_at)


def drop_written() -> None:
    """Removes every table that written() left; call it once the results that read them are stored."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001, PERF203  the session is gone, and its JVM with it
            continue


atexit.register(drop_written)


def text_hash(text: Column | str = "text") -> Column:
    """With doc_id, what tells rows apart; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def crc_mod(column: Column | str, n: int) -> Column:
    """crc32 of the number written out in decimal, modulo n."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % n


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """Texts as UTF-8 bytes, without a round trip through str."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many, to bound what a worker holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def starts_of(*arrays: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins in sorted arrays of one length."""
    if not len(arrays[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(arrays[0]), bool)
    new[1:] = False
    for a in arrays:
        new[1:] |= a[1:] != a[:-1]
    return np.flatnonzero(new)
