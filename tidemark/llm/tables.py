"""Reading the shared tables, and tables written to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only a local session (tests) may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.startswith("local"):
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named.rstrip("/")


def stored_at(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """df written once to the shared folder and read again, and the new folder that holds it: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written once to the shared folder and read again: lineage ends there.

    A lost executor costs at most a reread; every run writes to a new folder.
    """
    return stored_at(df, what)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of `stored_at` that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def crc_mod(column: str, by: int) -> Column:
    """crc32 of the column as text, modulo `by`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(by))


def with_row(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with a unique long `_row`.

    Where the key is never null and never repeated it is the row itself.
    Otherwise the rows are written once with a number each, so that every later
    pass sees the same numbers.
    """
    seen = docs.select(F.count(F.lit(1)), F.count(key), F.count_distinct(F.col(key))).first()
    if docs.schema[key].dataType.typeName() in ("long", "integer") and seen[0] == seen[1] == seen[2]:
        return docs.withColumn("_row", F.col(key).cast("long"))
    return stored(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")


#: Values that a sample by value knows.
MAX_VALUES = 1000


def smallest_hashes(df: DataFrame, key: str, n: int, by: str | None = None) -> DataFrame:
    """The n rows (of each of the MAX_VALUES most frequent values of `by`) whose key has the smallest hash: a sample that is the same at every layout.

    A first cut by the hash itself leaves about 2 n rows, so that tasks have few to sort and send.
    """
    h = F.pmod(F.xxhash64(key), F.lit(1 << 31))
    if by is None:
        share = min(1.0, 2.0 * n / max(df.count(), 1))
        return df.where(h < int(share * (1 << 31)) + 1).orderBy(h, key).limit(n)
    bound = F.least(F.lit(1.0), 2.0 * n / F.count(F.lit(1))) * (1 << 31) + 1
    counted = df.groupBy(F.col(by).alias("_by")).agg(bound.alias("_bound"), F.count(F.lit(1)).alias("_many"))
    bounds = F.broadcast(counted.orderBy(F.desc("_many"), "_by").limit(MAX_VALUES).drop("_many"))  # a bounded number of rows
    first = Window.partitionBy(by).orderBy(h, key)
    near = df.join(bounds, (F.col(by) == F.col("_by")) & (h < F.col("_bound"))).drop("_by", "_bound")
    return near.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= n).drop("_n")


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with columns of these names (any case) renamed, and the way back, for operators that add such columns."""
    taken = {c: f"_aside_{i}_{uuid.uuid4().hex[:8]}" for i, c in enumerate(docs.columns) if c.lower() in names}
    hidden = docs.withColumnsRenamed(taken)
    return hidden, lambda df: df.withColumnsRenamed({v: k for k, v in taken.items()})
