"""Where intermediate and result tables go.

A cluster names its shared folder in ``spark.checkpoint.dir``. Everything written between two jobs goes
there as a Parquet table, so a lost executor never takes a result with it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
#: Of each ``passing`` that is open, outer ones first: paths of the tables to remove at its end.
_passing: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only for a local session that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    app = spark.conf.get("spark.app.id")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tallyframe-")
    return _local_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other job uses; grouped by application for clean-up."""
    return f"{shared_dir(spark)}/tallyframe/{spark.conf.get('spark.app.id')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables settled inside are removed at the end, all but those that ``settle`` is told to keep.

    Frames that read them cannot be used after that. What is kept belongs to the next outer ``passing``, if any.
    """
    paths: list[str] = []
    token = _passing.set((*_passing.get(), paths))
    try:
        yield
    finally:
        _passing.reset(token)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settle(df: DataFrame, name: str = "settled", keep: bool = False) -> DataFrame:
    """Compute ``df`` once, write it as a table in the shared folder and read it back.

    Used for the small frames between two passes over large data. Their file size is known afterwards, so
    a join with them is a broadcast join only while they stay below
    ``spark.sql.autoBroadcastJoinThreshold`` and a sort-merge join with skew splitting beyond it. With ``keep`` the
    table outlives the ``passing`` that it is made in.
    """
    path = new_path(df.sparkSession, name)
    scopes = _passing.get()[:-1] if keep else _passing.get()
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
