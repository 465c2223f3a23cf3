"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

PARALLEL_FITS = 4
_STAGED: list[str] = []


def build_session(
    app: str = "cohortcast",
    master: str | None = None,
    hive: bool = False,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Session with adaptive execution and UTC days; ``hive`` adds the Hive catalog."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **(conf or {})}.items():
        builder = builder.config(key, value)
    if hive:
        builder = builder.enableHiveSupport()
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    A local session without the setting gets a folder of its own; a cluster session without it is
    an error, because a machine-local folder is lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="cohortcast-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def staging_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the staging folder."""
    path = f"{staging_root(spark)}/cohortcast/{label}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet and read it back.

    Cuts lineage and keeps an expensive input from being computed again by every later pass. The
    files survive the loss of executors; ``drop_staged`` removes them at the end of a job.
    """
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_parts(df: DataFrame, column: str, values: Sequence[str | int], label: str) -> dict[str | int, DataFrame]:
    """Write ``df`` once, dealt to a folder per value of ``column``; a table per asked value.

    The input is read once for all parts, and a part later reads its own folder alone. Rows with
    other values are left out; the parts don't have the column.
    """
    spark, path = df.sparkSession, staging_path(df.sparkSession, label)
    df.filter(df[column].isin(list(values))).write.partitionBy(column).parquet(path)
    schema = df.drop(column).schema
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def part(value: str | int) -> DataFrame:
        name = f"{path}/{column}={value}"
        there = files.exists(spark._jvm.org.apache.hadoop.fs.Path(name))
        return spark.read.schema(schema).parquet(name) if there else spark.createDataFrame([], schema)

    return {value: part(value) for value in values}


def drop_staged(spark: SparkSession) -> int:
    """Remove every path that this process staged, and return how many there were.

    For the end of a job: results that still read staged tables can't be used afterwards.
    """
    count = 0
    while _STAGED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        count += 1
    return count


def in_parallel(spark: SparkSession, jobs: Sequence[Callable[[], object]]) -> list:
    """Run independent fits side by side; each is a series of Spark jobs of its own."""
    with ThreadPool(min(PARALLEL_FITS, max(1, len(jobs)))) as pool:
        return pool.map(lambda job: inheritable_thread_target(spark)(job)(), jobs)

