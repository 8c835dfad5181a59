"""Session settings and the lineage-cutting helper."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("contrapair")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where none is named and the master is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths written inside each open scope, innermost last.
_SCOPES: list[list[str]] = []


def materialise(df: DataFrame) -> DataFrame:
    """Write a table that several later plans read to the shared folder and read it back.

    Lost executors then cost no recomputation, later plans prune columns and push filters
    into the scan, and its known size lets the optimizer decide whether a join may broadcast it.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task should group at most.
TASK_ROWS = 1 << 18


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows dealt out by keys that hardly repeat, to tasks of about TASK_ROWS, where there are more such tasks than cores.

    Grouping them then needs no tables on the map side, which grow with the input split, and a task's own has a bound.
    """
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


class Scratch:
    """Tables of a scope; ``keep`` writes one that outlives it."""

    def __init__(self, paths: list[str]):
        self._paths = paths

    def keep(self, df: DataFrame) -> DataFrame:
        kept = materialise(df)
        outer = self._paths.pop()
        if len(_SCOPES) > 1:
            _SCOPES[-2].append(outer)
        return kept


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Deletes what ``materialise`` wrote inside when it ends; nothing that leaves the scope may read these tables.

    Whoever returns a DataFrame computes it inside, keeps the tables it reads, and gives the rest of the space back.
    """
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield Scratch(paths)
    finally:
        _SCOPES.pop()
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
