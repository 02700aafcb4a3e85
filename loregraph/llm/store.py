"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loregraph.store import shared_dir


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts to a few MB, so that a Python worker's memory follows these and not 10,000 texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


ROWS_PER_TASK = 200_000


def materialize(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts lineage and survives lost executors.

    With ``rows``, about how many narrow rows it has, the last step runs in as many tasks as they need, at least 8, so that
    a small table isn't spread over hundreds of files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(8, rows // ROWS_PER_TASK))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
