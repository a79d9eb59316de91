"""Intermediate results in the folder that the cluster names in spark.checkpoint.dir.

They are Parquet, so they survive the loss of an executor and cut lineage.  Where the
setting is absent, and the session is one machine's, a folder is made on it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _OWN.get(app) or tempfile.mkdtemp(prefix="attestra-")
        _OWN[app] = base
    return f"{base.rstrip('/')}/{app}"


def kept(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """df, written once to the shared folder and read from there."""
    path = f"{folder or shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
