"""Session helpers that every module may use: shared scratch tables and shipping this package to executors."""

from __future__ import annotations

import atexit
import logging
import os
import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path
from weakref import WeakKeyDictionary

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Scratch tables that the application still has, and those of the job that this thread is in.
_written: dict[str, SparkSession] = {}
_own: ContextVar[list[str] | None] = ContextVar("scratch tables", default=None)
_folders: dict[str, str] = {}
#: Names in the catalog of those that have one.
_named: dict[str, str] = {}
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Of sessions whose shuffle files go at once: how many threads ask for it, and the setting before.
_tidying: dict[SparkSession, tuple[int, str | None]] = {}
_tidying_lock = threading.Lock()
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows that a task of :func:`parts` gets, so that its memory stays the same however large the tables are.
ROWS_A_PART = 500_000


def parts(*tables: DataFrame) -> int:
    """In how many parts the rows of these stored tables are dealt; Parquet's footers tell how many there are."""
    rows = sum(t.count() for t in tables)
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_PART))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where that is unset, an application of one machine gets a temporary folder; on a cluster, executors couldn't read
    what others wrote there, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^-]*\])?", context.master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {context.master} share")
    if context.applicationId not in _folders:
        _folders[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-leafmill-", dir="/tmp")
    return _folders[context.applicationId]


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that are made and run inside go when each is over.

    Otherwise they stay until the driver collects its garbage, so those of all steps of a job pile up.  The last thread
    out puts the session's setting back.
    """
    with _tidying_lock:
        n, before = _tidying.get(spark, (0, spark.conf.get(_TIDY, None)))
        _tidying[spark] = n + 1, before
        if not n:
            spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        with _tidying_lock:
            n, before = _tidying.pop(spark)
            if n > 1:
                _tidying[spark] = n - 1, before
            elif before is None:
                spark.conf.unset(_TIDY)
            else:
                spark.conf.set(_TIDY, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends there and survives lost executors.

    The table is removed with its job (:func:`in_job`) or by :func:`drop`, else when the application ends (or by
    :func:`clear_scratch`).
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/leafmill-{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    _written[path] = spark
    own = _own.get()
    if own is not None:
        own.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    _path_of[table] = path
    return table


def drop(*tables: DataFrame) -> None:
    """Remove tables of :func:`materialize` that the rest of their job doesn't read."""
    for table in tables:
        forget_table(_path_of[table])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that goes as scratch tables do, whatever is written there."""
    path = f"{scratch_dir(spark).rstrip('/')}/leafmill-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    own = _own.get()
    if own is not None:
        own.append(path)
    return path


def keep_table(spark: SparkSession, name: str, path: str) -> None:
    """Let a catalog table at ``path`` end as scratch tables do."""
    _written[path] = spark
    _named[path] = name
    own = _own.get()
    if own is not None:
        own.append(path)


def forget_table(path: str) -> None:
    """Remove the scratch table at ``path`` now."""
    own = _own.get()
    if own is not None and path in own:
        own.remove(path)
    if path in _written:
        _delete(path)


def in_job(name: str, work: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``work``, written as a table; the scratch tables that it made are removed, also if it fails.

    Each job keeps its own list, so jobs in several threads or within one another don't remove each other's tables.
    """
    outer = _own.get()
    token = _own.set([])
    try:
        done = materialize(work(), name)
        result = _own.get().pop()
        if outer is not None:
            outer.append(result)
        return done
    finally:
        left = _own.get()
        _own.reset(token)
        for path in left:
            _delete(path)


def clear_scratch() -> None:
    for path in list(_written):
        _delete(path)


atexit.register(clear_scratch)


def _delete(path: str) -> None:
    spark = _written.pop(path)
    if spark.sparkContext._jsc is None:  # stopped: the cluster clears its checkpoint folder
        return
    try:
        if path in _named:
            spark.sql(f"DROP TABLE IF EXISTS {_named.pop(path)}")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except (Py4JError, OSError) as e:  # a table left behind must not fail a finished job
        logging.getLogger(__name__).warning("scratch table %s not removed: %s", path, e)


def ship_code(spark: SparkSession) -> None:
    """Let the executors' Python import this package, wherever the driver found it.

    Where the session has Spark's own default, Arrow batches are made smaller: texts have no size limit, and two
    workers hold two batches each.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-leafmill-code-")) / "leafmill_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, os.path.join(root.name, f.relative_to(root)))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
