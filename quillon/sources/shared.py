"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes a plan's shuffle files when it has run; else they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables derived once per application and input folder: (application, folder, name) to path and schema.
_MADE: dict[tuple[str, str, str], tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, local mode makes one of its own; a cluster is an error."""
    jsc = spark.sparkContext._jsc.sc()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and jsc.getCheckpointDir().isDefined():
        path = jsc.getCheckpointDir().get()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes the shuffle files of a plan once that has run, as nothing but its written result is read again."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


#: Work tables of the scopes that are open, innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def work_tables_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, ``materialize`` writes tables that are deleted at its end, but for those that it is told to keep. What lives on must read none of them."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            drop_table(spark, path)


def drop_table(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write_shared(df: DataFrame, what: str, compression: str = "snappy", keep: bool = False) -> str:
    """Writes ``df`` as a new table in the shared folder; returns its path."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    if _SCOPES and not keep:
        _SCOPES[-1].append(path)
    return path


def materialize(df: DataFrame, what: str, compression: str = "snappy", keep: bool = False) -> DataFrame:
    """``df`` written as a table in the shared folder and read back, which cuts the lineage: a lost executor costs no rebuild.

    ``keep`` tells that the table outlives the scope of ``work_tables_dropped`` around it.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_shared(df, what, compression, keep))


def artifact(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` derived from the tables in ``folder``: built once per application, then rescanned by every query.

    Input tables are taken not to change while an application runs.
    """
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _MADE:
        df = build()
        _MADE[key] = (write_shared(df, name, keep=True), df.schema)
    path, schema = _MADE[key]
    return spark.read.schema(schema).parquet(path)
