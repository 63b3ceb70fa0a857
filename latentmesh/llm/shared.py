"""Helpers shared by the operators: intermediate tables, size-checked broadcasts and column names."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most about this many bytes may be broadcast; beyond it, the join shuffles.
BROADCAST_BYTES = 32 << 20


_made: dict[str, str] = {}
_scope: ContextVar[list[str] | None] = ContextVar("tables of the innermost `temporary`", default=None)


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``; where all run in this process, as in tests, one can be made here."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        if app not in _made:
            _made[app] = "file://" + tempfile.mkdtemp(prefix="latentmesh-")
        return _made[app]
    if "://" not in folder:  # a bare path is one of the cluster's default file system
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        folder = re.sub("^file:/+", "file:///", path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString())
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = _scope.get()
    if made is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables ``written`` inside are deleted at the end; nothing may read them afterwards.

    It gives a function that writes a table which stays.
    """
    made: list[str] = []
    before = _scope.get()
    token = _scope.set(made)

    def lasting(df: DataFrame, name: str) -> DataFrame:
        inner = _scope.set(before)
        try:
            return written(df, name)
        finally:
            _scope.reset(inner)

    try:
        yield lasting
    finally:
        _scope.reset(token)
        for path in made:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_or_not(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its rows take at most ``limit`` bytes, else as it is.

    ``df`` should be a written table: its rows are counted from the files' footers.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df.hint("merge")


def opened(df: DataFrame, *needed: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``df`` with the ``needed`` columns under exactly these names, all others numbered, and how to name them as before.

    A needed column is the one of that name, or else the one that has it but for
    the case of letters.  Numbered names clash with nothing and hold no dots, so
    operators can add columns of their own.  The function returned takes a
    DataFrame that has the columns of the opened one, in any order, and maybe
    others; it gives back the old ones in their order and then those that its
    keywords name, ``new="column of the DataFrame"``, each instead of an old
    column whose name is the same but for case.
    """
    names: list[str] = [f"_{k}" for k in range(len(df.columns))]
    for name in needed:
        at = [k for k, c in enumerate(df.columns) if c == name] or [k for k, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not at:
            raise ValueError(f"there is no column {name!r} among {df.columns}")
        names[at[0]] = name

    def closed(out: DataFrame, **new: str) -> DataFrame:
        taken = {c.lower() for c in new}
        kept = [(n, c) for n, c in zip(names, df.columns) if c.lower() not in taken]
        return out.select(*[n for n, _ in kept], *new.values()).toDF(*[c for _, c in kept], *new)

    return df.toDF(*names), closed


def whole_number(name: str) -> Column:
    """An id as a long; what isn't a whole number, such as a name, is null."""
    return F.col(name).try_cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
