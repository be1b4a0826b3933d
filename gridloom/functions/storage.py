"""Cutting the lineage of tables that several later steps use."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def materialize(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the folder that driver and executors share: spark.checkpoint.dir, the session's checkpoint
    folder, or a temporary one of a local session where neither is set.

    Without it a plan that uses a table in several joins repeats all that lies below it, and those uses multiply.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):  # each machine would write to its own disk
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "gridloom-checkpoints")
    path = f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
