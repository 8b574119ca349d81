"""Session factory and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "grovespark", cores: str = "*", partitions: int | None = None) -> SparkSession:
    """A local session with the settings the operators assume. On a cluster, pass your own session instead."""
    b = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GROVESPARK_DRIVER_MEMORY", "8g"))
        .config("spark.serializer", "org.apache.spark.serializer.KryoSerializer")
    )
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only a local master without that setting gets a folder of this
    machine; a cluster without it is refused, since other executors could not read such a folder."""
    sc = spark.sparkContext
    set_dir = sc.getCheckpointDir()
    if set_dir:
        return set_dir
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = tempfile.mkdtemp(prefix="grovespark-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Truncate lineage: write a table once to the shared folder and read it back. It survives the loss of executors, later
    passes read only the columns they use, and the planner knows its true size. (A checkpoint keeps the size estimated
    for the plan it replaces; in a loop of joins those estimates grow without end.) The folder's tables may be removed
    when no query runs."""
    at = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)

