"""The shared folder and tables written there, which end lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: list[tuple[SparkSession, str]] = []
#: Catalog tables of bucketed folders.
_TABLES: dict[str, str] = {}
#: Each thread has its own scopes, so that queries side by side don't delete one another's tables.
_THREAD = threading.local()


def _scopes() -> list[list[tuple[SparkSession, str]]]:
    if not hasattr(_THREAD, "scopes"):
        _THREAD.scopes = []
    return _THREAD.scopes


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; a local one only where none is named and driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that the driver and all executors see")
        named = "/tmp/checkpoints/sparkweave"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    if table := _TABLES.pop(path, None):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _forget() -> None:
    for spark, path in _OWN:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may have gone already
            return


def _own_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/sparkweave-{name}-{uuid.uuid4().hex}"
    if not _OWN:
        atexit.register(_forget)
    _OWN.append((spark, path))
    if _scopes():
        _scopes()[-1].append((spark, path))
    return path


@contextmanager
def _shuffle_files_go(spark: SparkSession) -> Iterator[None]:
    """While rows are written their shuffle files can go as soon as they are safe in the table; writes side by side share the setting."""
    with _WRITES.lock:
        if not _WRITES.n:
            _WRITES.was = spark.conf.get(_CLEANUP)
            spark.conf.set(_CLEANUP, "true")
        _WRITES.n += 1
    try:
        yield
    finally:
        with _WRITES.lock:
            _WRITES.n -= 1
            if not _WRITES.n:
                spark.conf.set(_CLEANUP, _WRITES.was)


class _Writes:
    lock, n, was = threading.Lock(), 0, "false"


_WRITES = _Writes()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there and any executor can read it again."""
    spark = df.sparkSession
    path = _own_path(spark, name)
    with _shuffle_files_go(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str, n: int) -> DataFrame:
    """The same in n buckets by the hash of a column: tables with as many buckets meet on it without an exchange."""
    spark = df.sparkSession
    path = _own_path(spark, name)
    table = f"sparkweave_{uuid.uuid4().hex}"
    _TABLES[path] = table
    with _shuffle_files_go(spark):
        df.repartition(n, column).write.bucketBy(n, column).sortBy(column).option("path", path).saveAsTable(table)
    return spark.table(table)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables written inside are deleted at the end, but for those written by the function that this gives."""
    scopes = _scopes()
    scopes.append([])
    lasting: set[str] = set()

    def keep(df: DataFrame, name: str) -> DataFrame:
        table = written(df, name)
        lasting.add(scopes[-1][-1][1])
        return table

    try:
        yield keep
    finally:
        for spark, path in scopes.pop():
            if path not in lasting:
                _delete(spark, path)
            elif scopes:
                scopes[-1].append((spark, path))


def dropped(tables: list[DataFrame]) -> None:
    """Deletes written tables that no later step reads."""
    for df in tables:
        for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            if path.rsplit("/", 1)[1].startswith("sparkweave-"):
                _delete(df.sparkSession, path)
