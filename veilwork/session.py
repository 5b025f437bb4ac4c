"""Session settings the operators rely on; everything else is left to the cluster."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "veilwork", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC timestamps and adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def local_session(cpus: int | None = None, **conf: str) -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    cpus = cpus or os.cpu_count() or 4
    settings = {
        "spark__sql__shuffle__partitions": str(cpus),
        "spark__ui__enabled": "false",
        "spark__ui__showConsoleProgress": "false",
        "spark__driver__memory": "8g",
    }
    settings.update(conf)
    return build_session(master=f"local[{cpus}]", **settings)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a scratch folder of its own only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="veilwork-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialized(df: DataFrame, name: str = "table") -> DataFrame:
    """The same rows from a table in the shared folder: computed once, removed when the application ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{name}_{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
