"""Tables between the steps of a query that several steps read, in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a folder under /tmp if driver and tasks are one process, as in tests."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, so that its readers don't each compute it; survives lost executors.

    by: a column of few values; a reader that asks for one of them reads that part only.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)
