"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark then deletes the shuffle files of a query as soon as it ends, not when the driver next collects garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Only a local master may do without: there a folder of our own is as good, while executors
    on other machines would write where no one else can read."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        base = getattr(spark, "_siltstone_dir", None) or tempfile.mkdtemp(prefix="siltstone-")
        spark._siltstone_dir = base
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._siltstone_path = path
    return out


def once(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself if it is a written table, or else written."""
    return df if hasattr(df, "_siltstone_path") else written(df, name)


#: About how many rows a task takes of what is dealt out by keys.
TASK_ROWS = 250_000


def dealt(df: DataFrame, *keys: str, rows: DataFrame | None = None) -> DataFrame:
    """``df`` dealt out by ``keys`` to as many tasks as its rows need, so a task's memory does not grow with the table.  It is a
    written table, or derived from ``rows`` that are: they are counted in the footers of the files."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-(df if rows is None else rows).count() // TASK_ROWS))
    return df.repartition(tasks, *keys)


def dispose(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more; what was derived from them must be written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._siltstone_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
