"""Session helpers and tables staged in the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def build_session(app: str = "lingua-spark", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators count on (AQE, UTC, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would vanish with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="lingua-spark-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    app = spark.sparkContext.applicationId
    return f"{checkpoint_root(spark)}/lingua-{app}/{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    This cuts the lineage, survives lost executors, keeps the columns prunable
    and gives Catalyst the true size, so that a small staged table is broadcast
    by Spark's own size threshold and a large one is not.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_spread(
    df: DataFrame, label: str = "stage", rows_per_task: int = 10_000, bytes_per_task: int = 4 << 20
) -> DataFrame:
    """Stage a table that many passes will scan, cut for parallel work.

    A freshly aggregated table may sit in one partition, which suits a single
    pass but not a loop. The number of tasks follows the true rows and the
    bytes on disk, so that few but long rows are spread as well. Once all cores
    have a few tasks these grow up to twentyfold in rows and fourfold in bytes,
    as every pass starts them anew.
    """
    staged = stage(df, label)
    size, rows = int(str(staged._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), staged.count()
    enough = 4 * df.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-rows // rows_per_task), -(-size // bytes_per_task))
    larger = max(-(-rows // (20 * rows_per_task)), -(-size // (4 * bytes_per_task)))
    return staged.repartition(max(min(tasks, enough), larger)).persist(StorageLevel.MEMORY_AND_DISK)


def stage_parts(staged: DataFrame, bytes_per_task: int = 4 << 20) -> DataFrame:
    """A staged table in files enough for all cores, if it is large enough; it
    is written again only if it has too few."""
    size = int(str(staged._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = staged.sparkSession.sparkContext.defaultParallelism
    tasks = min(-(-size // bytes_per_task), 4 * cores)
    if staged.rdd.getNumPartitions() >= min(tasks, cores):
        return staged
    parts = stage(staged.repartition(tasks), "parts")
    unstage(staged)
    return parts


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read again."""
    root = f"{checkpoint_root(df.sparkSession)}/lingua-{df.sparkSession.sparkContext.applicationId}"
    bare = root.split(":", 1)[-1].lstrip("/")
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        if bare in folder:
            delete(df.sparkSession, folder)


def _on_file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, folder: str) -> None:
    path, files = _on_file_system(spark, folder)
    files.delete(path, True)


def exists(spark: SparkSession, place: str) -> bool:
    path, files = _on_file_system(spark, place)
    return files.exists(path)


def subfolders(spark: SparkSession, folder: str) -> list[str]:
    path, files = _on_file_system(spark, folder)
    return [s.getPath().toString() for s in files.listStatus(path) if s.isDirectory()] if files.exists(path) else []


def clear_stages(spark: SparkSession) -> None:
    """Delete this application's staged tables once their results are written."""
    delete(spark, f"{checkpoint_root(spark)}/lingua-{spark.sparkContext.applicationId}")


def cores(default: str = "8") -> str:
    return os.environ.get("BENCH_CPUS", default)
