"""Session helpers: local sessions for tests, a shared scratch folder, stored tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the local bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("simsift")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.files.minPartitionNum", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder all nodes share: the session's checkpoint folder.

    A cluster has to name one in ``spark.checkpoint.dir``. Only a session whose
    driver and executors are one process (``local[n]``) gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
            configured = tempfile.mkdtemp(prefix="simsift-")
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared folder and read it back.

    Cuts the lineage at files every node can read, and gives the planner the
    table's real size, so that it chooses between broadcast and shuffle by it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if (passing := _PASSING.get()) is not None:
        passing.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths that ``stored`` has written on the way to a result of ``settled``.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that ``make`` returns, stored; what it stored on the way is deleted then."""
    outer = _PASSING.set([])
    try:
        made, paths = make(), _PASSING.get()
    finally:
        _PASSING.reset(outer)
    out = stored(made, name)
    hadoop = out.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
    conf = out.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for path in map(hadoop.Path, paths):
        path.getFileSystem(conf).delete(path, True)
    return out
