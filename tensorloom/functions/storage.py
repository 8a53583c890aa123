"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own in local mode where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, **options) -> str:
    """Write df to the shared folder; the path, in a folder of the application's own that can go when it has ended."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors. Results are read lazily, so tables stay."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


#: Rows that a task groups or joins by nearly unique keys; it holds some 700 bytes for each.
TASK_ROWS = 1 << 18


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """df by keys in tasks of some TASK_ROWS of ``rows``, which stay as they are; Spark's own few if that is enough.

    Left alone, adaptive execution makes tasks of so many compressed bytes, and integers compress so well that a
    task of 64 MB groups millions of rows. Later groupings and joins by keys stay in these tasks.
    """
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *keys) if keys and tasks > df.sparkSession.sparkContext.defaultParallelism else df
