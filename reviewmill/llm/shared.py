"""Tables and files below the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.session import scratch_path, written

#: The columns of ``documents``.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read as it is."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written below the shared folder and read back, so that no later step computes it again."""
    return written(df)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` written once in buckets of ``key``; later joins on it move only what is joined to it."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"bucketed_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key)
    writer.option("path", folder(spark, "bucketed")).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return scratch_path(spark, name)


def file_system(uri: str):
    """The file system of a shared path and the path in it, for tasks that write or read byte ranges."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def lowest_share(key: str, count: int, wanted: int):
    """Condition that holds for about four times the ``wanted`` lowest of ``count`` 64-bit hashes, and so for all of those.

    A sample of the lowest hashes that filters by it first brings as many rows to the driver at every size.
    """
    if count <= 4 * wanted:
        return F.lit(True)
    return F.col(key) < F.lit((4 * wanted << 64) // count - (1 << 63))


def parallel(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out anew by ``keys`` over the session's shuffle partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[F.col(k) for k in keys])
