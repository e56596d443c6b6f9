"""Lineage cuts: intermediate tables written to the cluster's shared folder.

An iterative operator must not carry its whole history in one plan, and what it
keeps must survive the loss of an executor. ``stash`` writes a DataFrame as a
Parquet table below the folder named by ``spark.checkpoint.dir`` and reads it
back: the lineage ends at replicated files, and the columnar statistics stay
available to the optimizer. Only where that setting is absent (local tests) does
the session get a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, or a local one in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="voxloom-")
        atexit.register(shutil.rmtree, _LOCAL_ROOTS[app], True)
    return _LOCAL_ROOTS[app]


def stash(df: DataFrame, keep: bool = True) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the table read back.

    ``keep=False`` marks a table whose readers all finish inside the calling
    operator, so that ``drop_stash`` may remove it early.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/voxloom-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_drop_at_exit)
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    if not keep:
        out._stash_path = path
    return out


def stash_measured(df: DataFrame, keep: bool = True, **measures: Column) -> tuple[DataFrame, dict]:
    """The same, with aggregates over the rows that the write itself takes."""
    seen = Observation()
    out = stash(df.observe(seen, *[m.alias(k) for k, m in measures.items()]), keep)
    return out, seen.get


def drop_stash(*tables: DataFrame) -> None:
    """Removes tables stashed with ``keep=False`` that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_stash_path", None)
        if path:
            _remove(t.sparkSession, path)


def drop_all() -> None:
    """Removes every stashed table of this process; results built on them become unreadable."""
    while _WRITTEN:
        _remove(*_WRITTEN.pop())


def _drop_at_exit() -> None:
    """Leaves nothing in the shared folder, if the session still runs when the process ends."""
    try:
        drop_all()
    except Exception:  # noqa: BLE001 - the session is gone; its owner clears the folder
        _WRITTEN.clear()


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
