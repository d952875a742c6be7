"""Reading tables by name, and writing them: snapshots that replace a table at once, appends, JSON bundles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where it comes in fewer than half as many partitions, for work that is costly for each row; else, and as a stream, as it is."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df


def write_version(df: DataFrame, folder: str) -> str:
    """df as a new version under `folder`; readers see it when its pointer row is appended, all of it or nothing."""
    spark = df.sparkSession
    path = f"{folder}/data-{uuid.uuid4().hex}"
    df.write.parquet(path)
    pointer = spark.range(1).select(F.current_timestamp().alias("at"), F.lit(path).alias("path"))
    pointer.coalesce(1).write.mode("append").parquet(f"{folder}/versions")
    return path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at the path, in whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def has_version(spark: SparkSession, folder: str) -> bool:
    return exists(spark, f"{folder}/versions")


def logged(spark: SparkSession, path: str) -> DataFrame | None:
    """What was appended at the path; None where nothing was yet."""
    return spark.read.parquet(path) if exists(spark, path) else None


def kept(df: DataFrame, path: str) -> DataFrame:
    """df written at the path, whatever was there before, and read again: what several steps read is worked out once."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_version(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version under `folder`."""
    path = spark.read.parquet(f"{folder}/versions").orderBy(F.desc("at"), F.desc("path")).first()["path"]
    return spark.read.parquet(path)


def append(df: DataFrame, path: str, *by: str) -> None:
    """Logs: appended, in folders by the given columns."""
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, in as many files as there are partitions; nulls are written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
