"""Cut points: an intermediate table written once and read by several later plans.

The folder is the one the session names in ``spark.checkpoint.dir`` (shared storage on a cluster).
Only a local session without that setting gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    known = spark.conf.get("spark.snapledger.localStaging", None)
    if not known:
        known = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.snapledger.localStaging", known)
    return known


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: survives lost executors and prunes columns."""
    path = f"{staging_dir(df.sparkSession)}/snapledger-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt anew by ``keys``, for parsing that costs far more than moving the row.

    A small file is read by one task however many rows it holds, and that task would parse them all.
    """
    return df.repartition(*keys)
