"""Tables written to the shared folder between steps, and their removal."""

from __future__ import annotations

import atexit
import logging
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from loadlens.session import shared_dir

log = logging.getLogger(__name__)

# Parquet is read by streams: asynchronous reads of a column chunk leave a direct buffer of its
# size with each of their threads, outside the heap and as long as the executor lives.
PLAIN_READS = ("parquet.hadoop.vectored.io.enabled", "false")

# Rows of megabytes are told apart at each of them: else a hundred are one page, and readers and
# writers keep direct buffers of a page's size for each column.
LARGE_ROWS = {f"parquet.{what}.size.row.check.min": "1" for what in ("page", "block")}

# Folders made for each application, by its id.
_FOLDERS: dict[str, list[str]] = {}


def new_folder(spark: SparkSession) -> str:
    """Path of a folder of its own below the shared folder, gone when the session ends."""
    path = f"{shared_dir(spark)}/loadlens-{uuid.uuid4().hex}"
    _FOLDERS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def hadoop_path(spark: SparkSession, path: str):
    """The file system of ``path`` and the path as its functions take it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        fs, target = hadoop_path(spark, path)
        fs.delete(target, True)


def release(spark: SparkSession) -> None:
    """Delete all folders made in this application; results that read them are done with."""
    _delete(spark, _FOLDERS.pop(spark.sparkContext.applicationId, []))


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of :func:`new_folder` that nothing reads any more."""
    made = _FOLDERS.get(spark.sparkContext.applicationId, [])
    if path in made:
        made.remove(path)
    _delete(spark, [path])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders made inside are deleted at the end: write or collect the results before it."""
    made = _FOLDERS.setdefault(spark.sparkContext.applicationId, [])
    kept = len(made)
    try:
        yield
    finally:
        mine = made[kept:]
        del made[kept:]
        _delete(spark, mine)


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _FOLDERS:
        try:
            release(spark)
        except Exception as error:  # the context may be gone already
            log.debug("folders were left: %s", error)


def stored(df: DataFrame, path: str | None = None,
           options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For tables that later steps use several times, such as user bins: what is behind them is
    worked out once, a lost executor costs no recomputation, and the planner knows the true
    size, so it broadcasts them only if they are small.  The folder goes with the session, or
    with the :func:`scratch` it was made in; ``path`` is a folder to be dropped earlier,
    ``options`` are those of the writer.
    """
    path = path or new_folder(df.sparkSession)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).option(*PLAIN_READS).parquet(path)
