"""Tables written to the folder that driver and executors share, to cut a plan where its rows are read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a session on one machine without one takes a folder in its warehouse."""
    context = spark.sparkContext
    held = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not held:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        held = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tokenfold-shared"
    return held.rstrip("/")


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written as Parquet in the shared folder and read again."""
    path = f"{shared_dir(frame.sparkSession)}/tokenfold/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
