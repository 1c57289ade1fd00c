"""What the operators share: the scratch folder, written tables, and a per-worker cache."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders of the tables that the innermost ``temporary_tables`` removes.
_TEMPORARY: ContextVar[list[str] | None] = ContextVar("timeweave_temporary", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of this application's intermediate tables.

    It is the one that ``spark.checkpoint.dir`` names.  Where that is unset on a local master
    (tests, a laptop) a temporary folder is made and the setting is filled in, so that later calls
    agree; on a cluster an unset folder is an error, for executors share no other.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="timeweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/timeweave-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str, rows: int | None = None, rows_per_file: int = 100_000, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    Where the caller knows that there are at most ``rows`` rows, the last stage has a task and a
    file for each ``rows_per_file`` of them rather than one for each shuffle partition.  Inside
    ``temporary_tables`` the table goes at its end, unless the caller wants to ``keep`` it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    temporary = _TEMPORARY.get()
    if temporary is not None and not keep:
        temporary.append(path)
    if rows is not None:
        df = df.coalesce(max(2, -(-rows // rows_per_file)))
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(df: DataFrame) -> None:
    """Remove a table that ``materialise`` wrote and that nothing will read again."""
    for file in df.inputFiles()[:1]:
        _remove(df.sparkSession, file.rsplit("/", 1)[0])


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables written inside the block, but those to ``keep``, are removed at its end: nothing lazy may read them later."""
    outer = _TEMPORARY.set([])
    try:
        yield
    finally:
        for path in _TEMPORARY.get() or []:
            _remove(spark, path)
        _TEMPORARY.reset(outer)


def small(df: DataFrame, rows: int, most: int = 500_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows; the caller has counted ``rows``.

    Beyond that Spark chooses a join by itself.
    """
    return F.broadcast(df) if rows <= most else df


def bounded_batches(df: DataFrame, size: int = 2 << 20) -> DataFrame:
    """``df``, after making sure that batches sent to Python are bounded by bytes, not by rows alone.

    Ten thousand long texts would not fit a worker.  A session that sets its own bound keeps it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, None) is None:
        df.sparkSession.conf.set(name, str(size))
    return df


def worker_cache() -> dict:
    """One dict for each Python worker process; it outlives a task."""
    return sys.__dict__.setdefault("_timeweave_cache", {})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32(doc_id as text) mod ``modulus`` is ``remainder``; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))
