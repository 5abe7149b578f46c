"""Intermediate tables in the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tallyforge-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def persist(df: DataFrame, name: str) -> DataFrame:
    """Write df to the scratch folder as Parquet and read it back: its lineage ends in files that all executors see."""
    path = f"{scratch_dir(df.sparkSession)}/tallyforge/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_persisted(df: DataFrame) -> None:
    """Delete the files behind persist(); nothing may read df afterwards."""
    spark, path = df.sparkSession, df._scratch_path
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
