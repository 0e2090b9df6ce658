"""Write a derived table once and go on from the written copy.

Copies go to the folder named by ``spark.checkpoint.dir``, which all executors share, so a lost
executor costs no recomputation. Where it is unset they go below ``spark.sql.warehouse.dir`` if all
tasks run on this machine; on a cluster that folder may be local to the driver, so it is refused.

Pinning is eager: the copy is written when the query is built. Copies are deleted at the end of
``pinned_scope``, by ``drop_pinned``, or else when the Python process ends.
"""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager, suppress
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class _Copy:
    app: str
    path: str
    jvm: object
    conf: object
    spark: SparkSession | None = None
    table: str | None = None

    def delete(self) -> None:
        if self.table:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        path = self.jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.conf).delete(path, True)


_copies: list[_Copy] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_pinned").rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted like the pinned copies."""
    context = spark.sparkContext
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _copies.append(_Copy(context.applicationId, path, spark._jvm, context._jsc.hadoopConfiguration()))
    return path


def pin(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of the copy.

    Used where one aggregate feeds several consumers (statistics and the rows they apply to):
    the fact table is then scanned once, and the size of the copy is known to the planner,
    which decides on broadcasts from it.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def held(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """Like :func:`pin`, but the copy is deleted at the end of the block."""
    path = shared_path(df.sparkSession, label)
    try:
        df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        _drop([c for c in _copies if c.path == path])


def pin_bucketed(df: DataFrame, label: str, buckets: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Like :func:`pin`, dealt into ``buckets`` by ``keys`` and sorted in each.

    Windows, groups and joins on columns that begin with ``keys`` then read the copy in place,
    without another exchange of its rows.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    table = f"{label}_{uuid.uuid4().hex}"
    _copies[-1] = replace(_copies[-1], spark=spark, table=table)
    df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*order).option("path", path).saveAsTable(table)
    return spark.table(table)


def drop_pinned(spark: SparkSession) -> int:
    """Delete the copies this application pinned; frames built on them become unusable."""
    return _drop([c for c in _copies if c.app == spark.sparkContext.applicationId])


@contextmanager
def pinned_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what this application pins inside; consume results before."""
    app = spark.sparkContext.applicationId
    before = {c.path for c in _copies}
    try:
        yield
    finally:
        _drop([c for c in _copies if c.app == app and c.path not in before])


def _drop(copies: list[_Copy]) -> int:
    for copy in copies:
        copy.delete()
        _copies.remove(copy)
    return len(copies)


@atexit.register
def _drop_rest() -> None:
    for copy in _copies:
        with suppress(Exception):  # the driver's JVM may be gone already
            copy.delete()
