"""Tables written in the folder that driver and executors share, where a lineage ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder is made here only where it is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(f"file://{found}")
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder."""
    path = f"{folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same(df_keys, other_keys):
    """Null-safe equality of keys with those of another table under other names."""
    from pyspark.sql import functions as F

    out = F.lit(True)
    for a, b in zip(df_keys, other_keys, strict=True):
        out &= F.col(a).eqNullSafe(F.col(b))
    return out
