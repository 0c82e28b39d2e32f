"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cpus: int = 8, partitions: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("mnemolake").config("spark.driver.memory", memory)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(partitions or cpus))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, read from the session.

    Only where the session names none (tests, one machine) a temporary folder of this machine is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark, "_mnemolake_scratch", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="mnemolake-")
            spark._mnemolake_scratch = base
    return base


def scratch_path(spark: SparkSession, tag: str) -> str:
    return os.path.join(scratch_root(spark), f"{tag}-{uuid.uuid4().hex}")


def clear_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables this session wrote; frames that read them can't be read any more."""
    for path in getattr(spark.sparkContext, "_mnemolake_tables", []):
        h = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        h.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(h, True)
    spark.sparkContext._mnemolake_tables = []


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write a Parquet table to the shared folder and read it back.

    Unlike a cache it survives the loss of executors, and unlike localCheckpoint it has no single copy.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    spark.sparkContext._mnemolake_tables = [*getattr(spark.sparkContext, "_mnemolake_tables", []), path]
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession, least: int = 1) -> int:
    """Tasks of a stage that follows a shuffle, as the session sets it."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package where their path doesn't hold it: a zip of its source goes to every executor."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_mnemolake_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="mnemolake-"), "mnemolake.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "mnemolake")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._mnemolake_shipped = True
