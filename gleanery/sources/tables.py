"""Tables between steps: written once, read as often as needed."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A local session without it uses its warehouse; on a cluster it has to be set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when their query ends, and not when the driver's memory is next cleaned: many passes don't pile them up."""
    old = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, old)


def kept(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: no lineage, no executor's memory or disk. It goes when the driver ends."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/gleanery-{uuid.uuid4().hex}"
    with tidied(spark):
        df.write.option("compression", "zstd").parquet(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)
