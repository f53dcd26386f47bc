"""Tables in between, written to the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is set only where none is configured."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        path = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Cut the lineage by a written table in the shared folder, of at most `files` files if that is given.

    The table belongs to the query's result, which is lazy: it stays until the shared folder is cleared.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
