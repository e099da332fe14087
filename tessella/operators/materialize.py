"""Cutting lineage: a written table in the folder that all executors share."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_scopes = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local session (tests, one machine) gets a temporary folder, which
    is then set; any other session an error, since executors do not see each other's temporary folders."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master!r} share")
        where = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def _path(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame) -> DataFrame:
    """`df` written as parquet to the shared folder and read again: it outlives executors and has no lineage.

    Unlike Dataset.checkpoint() the plan runs once only. The files go when the application ends, or earlier by `release` or at
    the end of the `tidied` function that wrote them.
    """
    spark = df.sparkSession
    where = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(where)
    path, fs = _path(spark, where)
    fs.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(where)
    out._written_to = where
    for scope in getattr(_scopes, "open", [])[-1:]:
        scope.append(out)
    return out


def release(df: DataFrame) -> None:
    """Deletes the files of a materialized frame that no later step reads."""
    if where := getattr(df, "_written_to", None):
        path, fs = _path(df.sparkSession, where)
        fs.delete(path, True)


def tidied(f: Callable) -> Callable:
    """A function of frames whose results are written, and whose other written frames are deleted, before it returns.

    Results are a frame or a tuple, of which frames are written and all else is handed on.
    """

    @functools.wraps(f)
    def run(*args, **kwargs):
        stack = _scopes.__dict__.setdefault("open", [])
        stack.append([])
        try:
            out = f(*args, **kwargs)
            many = out if isinstance(out, tuple) else (out,)
            kept = tuple(x if not isinstance(x, DataFrame) or getattr(x, "_written_to", None) else materialize(x) for x in many)
        finally:
            mine = stack.pop()
        for df in mine:
            if not any(df is x for x in kept):
                release(df)
            elif stack:
                stack[-1].append(df)
        return kept if isinstance(out, tuple) else kept[0]

    return run
