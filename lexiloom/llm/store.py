"""Intermediate tables in the folder that all executors share.

Spark recomputes what a lost executor held. A table written here cuts that lineage and, unlike a
local checkpoint, outlives every executor.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Bytes on disk up to which a join broadcasts a table while another is saved.
BROADCAST = 256 * 1024

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode, else an error: executors would not share it."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Within, Python workers get ``rows`` rows at once at most, so that long texts fit in little memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextlib.contextmanager
def small_broadcasts(spark: SparkSession, most: int = BROADCAST) -> Iterator[None]:
    """Within, joins broadcast tables of ``most`` bytes at most.

    The driver builds the hash table of each that is broadcast. Of narrow rows, ids or hashes, it is many times
    what they are on disk: 10 MB, Spark's default, took more than a heap of 750 MB has for them.
    """
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(most, spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet, and read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexiloom/{uuid.uuid4().hex}"
    with small_batches(spark), small_broadcasts(spark):
        df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexiloom_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by :func:`saved` that no later plan reads."""
    for table in tables:
        path = getattr(table, "_lexiloom_path", None)
        if path in _written:
            _delete(table.sparkSession, path)
            _written.remove(path)


def marked() -> int:
    """A mark for :func:`dropped_since`."""
    return len(_written)


def dropped_since(mark: int, *kept: DataFrame) -> None:
    """Delete the tables saved since ``mark`` but for ``kept``, once what was made of them is written."""
    paths = {getattr(table, "_lexiloom_path", None) for table in kept}
    for path in [p for p in _written[mark:] if p not in paths]:
        _delete(kept[0].sparkSession, path)
        _written.remove(path)


def release(spark: SparkSession) -> None:
    """Delete every table that this process has saved. Call it once all results are written."""
    while _written:
        _delete(spark, _written.pop())


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
