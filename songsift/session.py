"""Where intermediate results are kept."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of a settled table that a fit should get in one file.
ROWS_PER_FILE = 25_000

_local_folders: dict[str, str] = {}
_open: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session, where driver and executors share one disk, may fall
    back to a temporary folder, one for each application.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="songsift-")
    return _local_folders[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    path = f"{shared_folder(spark).rstrip('/')}/songsift-{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete at its end whatever was written to the shared folder within.

    Frames that read such a table must be used up or stored before the end.
    """
    paths: list[str] = []
    _open.append(paths)
    try:
        yield
    finally:
        _open.remove(paths)
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Have Spark delete the shuffle files of each query within as soon as it has ended.

    Otherwise they stay until the driver happens to collect its garbage.  For a
    chain of tables that are written once; the setting is put back at the end.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def settle(df: DataFrame, name: str, spread: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Iterative fits read their input many times.  A written table cuts the
    lineage, stays columnar and outlives any executor that is lost on the way.
    With ``spread`` the rows are counted first and dealt over files of about
    ``ROWS_PER_FILE``, so that a fit, which is heavy for each row, has work for
    many tasks.  The number of files follows the rows, not the machine.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if spread:
        df = df.repartition(-(-df.count() // ROWS_PER_FILE) or 1)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
