"""Tables that cut lineage, in a folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN = "kinfold.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a local master (tests, a single machine) gets a temporary folder for the session; a cluster gets an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if path:
        return path
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="kinfold-")
    spark.conf.set(_OWN, path)
    return path


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to a table of the shared folder and read again: its lineage ends there, and losing executors loses nothing."""
    path = os.path.join(shared_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
