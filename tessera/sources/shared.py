"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset and the session is one local process (tests), a fresh temporary folder
    is used; on a cluster that is an error, as executors would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(spark, "_tessera_folder", None)
    if made is None:
        made = spark._tessera_folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return made


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
