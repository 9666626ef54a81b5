"""SparkSession construction for tests, bench and local runs.

On a cluster the session already exists; ``get_spark`` only fills in
settings that are unset.  ``store_dir`` names the shared folder of the table sets.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "storepulse") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = (SparkSession.builder
         .master(master or f"local[{cpus}]")
         .appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 2 * int(cpus)))
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g")))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def store_dir(spark: SparkSession) -> str:
    """The folder that holds the table sets; driver and executors must share it.

    ``STOREPULSE_STORE`` if set, else the session's ``spark.checkpoint.dir``, else a
    folder in the session's warehouse.  No setting is changed.
    """
    folder = os.environ.get("STOREPULSE_STORE") or spark.conf.get("spark.checkpoint.dir", None) \
        or spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")
