"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from uuid import uuid4

from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where none is named, a session of one machine (``local``) gets a temporary folder; on a
    cluster that is an error, as executors do not see each other's disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="darkroom-")
        atexit.register(shutil.rmtree, _LOCAL[context.applicationId], ignore_errors=True)
    return _LOCAL[context.applicationId]


#: Settings while an intermediate table is written.  Bytes of an Arrow batch: what a task and its
#: Python worker hold of rows on their way, where single rows may be large.  And shuffle files go
#: when the table that they were made for is there.
WHILE_WRITING = {
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
_SETTINGS = threading.Lock()
_BEFORE: dict[int, tuple[int, dict[str, str | None]]] = {}


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """``WHILE_WRITING`` in force; the first of several writers sets it, and the last one restores what was there."""
    key = id(spark)
    with _SETTINGS:
        depth, before = _BEFORE.get(key, (0, {}))
        if not depth:
            before = {name: spark.conf.get(name, None) for name in WHILE_WRITING}
            for name, value in WHILE_WRITING.items():
                spark.conf.set(name, value)
        _BEFORE[key] = depth + 1, before
    try:
        yield
    finally:
        with _SETTINGS:
            depth, before = _BEFORE.pop(key)
            if depth > 1:
                _BEFORE[key] = depth - 1, before
            else:
                for name, value in before.items():
                    spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class _Call:
    """What a call of an operator has made and not deleted."""

    def __init__(self) -> None:
        self.tables: dict[str, SparkSession] = {}
        self.broadcasts: list[Broadcast] = []


_CALLS = threading.local()
#: Tables that results read: session, path and a weak reference to what a plan holds of the table.
_READ: list[tuple[SparkSession, str, object]] = []


def _open_calls() -> list[_Call]:
    if not hasattr(_CALLS, "stack"):
        _CALLS.stack = []
    return _CALLS.stack


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write(df: DataFrame, path: str | None = None) -> str:
    """Write ``df`` into the shared folder, or add it to what is at ``path``; returns the path.

    The table belongs to the call of an operator that is under way (see :func:`owned`), and goes
    with the driver's JVM at the latest.
    """
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/darkroom-{uuid4().hex}"
    calls = _open_calls()
    if calls:
        calls[-1].tables[path] = spark
    with _settings(spark):
        df.write.mode("append").parquet(path)
    files, at = _path(spark, path)
    files.deleteOnExit(at)
    return path


def written(spark: SparkSession, schema, path: str) -> DataFrame:
    """The table at a path of :func:`write`."""
    out = spark.read.schema(schema).parquet(path)
    out.written_at = path
    return out


def materialize(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table of the shared folder, which outlives the executors that wrote it.

    The planner knows the size of such a table and reads it in as many tasks as its size asks for.
    """
    return written(df.sparkSession, df.schema, write(df))


def release(*tables: DataFrame | None) -> None:
    """Delete tables of :func:`materialize` that nothing will read again."""
    for df in tables:
        path = getattr(df, "written_at", None)
        if path:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    files, at = _path(spark, path)
    files.delete(at, True)
    files.cancelDeleteOnExit(at)
    for call in _open_calls():
        call.tables.pop(path, None)


def broadcast(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast that goes with the call of an operator that is under way (see :func:`owned`)."""
    held = spark.sparkContext.broadcast(value)
    calls = _open_calls()
    if calls:
        calls[-1].broadcasts.append(held)
    return held


def _frames(value: object) -> list[DataFrame]:
    if isinstance(value, DataFrame):
        return [value]
    if isinstance(value, dict):
        value = list(value.values())
    return [f for v in value for f in _frames(v)] if isinstance(value, (list, tuple)) else []


def _tables_of(df: DataFrame) -> dict[str, object]:
    """The files that a plan reads, as what it holds of them, by path."""
    found: dict[str, object] = {}
    leaves = df._jdf.queryExecution().analyzed().collectLeaves().iterator()
    while leaves.hasNext():
        leaf = leaves.next()
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            location = leaf.relation().location()
            roots = location.rootPaths().iterator()
            while roots.hasNext():
                found[roots.next().toString()] = location
    return found


def owned(function: Callable) -> Callable:
    """An operator whose calls leave no intermediate table behind.

    Tables that a call writes are deleted when it ends, but for those that its result reads (a
    DataFrame, or several).  These belong to the call around it, if there is one; else they go as
    soon as no DataFrame that reads them is left (see :func:`reap`).  Broadcasts go
    too, unless the result has yet to run Python functions, which may use them.
    """

    @wraps(function)
    def call(*args, **kwargs):
        calls = _open_calls()
        if not calls:
            reap()
        mine = _Call()
        calls.append(mine)
        result: object = None
        try:
            result = function(*args, **kwargs)
            return result
        finally:
            calls.pop()
            _close(mine, _frames(result), calls[-1] if calls else None)

    return call


def _close(mine: _Call, results: list[DataFrame], outer: _Call | None) -> None:
    read: dict[str, object] = {}
    pending = False
    for df in results:
        read |= {path.rstrip("/").rsplit("/", 1)[-1]: location for path, location in _tables_of(df).items()}
        if mine.broadcasts:
            plan = df._jdf.queryExecution().analyzed().toString()
            pending = pending or any(mark in plan for mark in ("MapIn", "FlatMap", "pythonUDF"))
    for path, spark in list(mine.tables.items()):
        location = read.get(path.rsplit("/", 1)[-1])
        if location is None:
            delete(spark, path)
        elif outer is not None:
            outer.tables[path] = spark
        else:
            _READ.append((spark, path, spark._jvm.java.lang.ref.WeakReference(location)))
    for held in mine.broadcasts:
        if not pending:
            held.destroy()
        elif outer is not None:
            outer.broadcasts.append(held)


def reap() -> None:
    """Delete the tables of results that the JVM has found nothing to refer to any more."""
    left = []
    for spark, path, reference in _READ:
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            continue  # gone with its JVM
        if reference.get() is None:
            delete(spark, path)
        else:
            left.append((spark, path, reference))
    _READ[:] = left
