"""Session settings the engine is written for."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # streams with typed states and timers need this state store
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "tidebar", cpus: int | None = None, **extra: str) -> SparkSession:
    """A local session with the settings above; on a cluster the submitter's own session is used instead."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.appName(app).master(f"local[{cpus}]")
    for key, value in {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. It must be named on a cluster; a session of one machine may use one beside its warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
