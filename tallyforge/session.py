"""A session with the settings that the plans here rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, memory: str = "8g", name: str = "tallyforge") -> SparkSession:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(cores))
    for key, value in CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    workers_find(spark, root)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def workers_find(spark: SparkSession, root: str) -> None:
    """Let Python workers on this machine import the package; on a cluster it is shipped with the job."""
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])
