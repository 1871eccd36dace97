"""Session defaults, table access and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(app: str = "thicketry", cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for one machine; on a cluster the caller brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    spark = (
        b.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, else the checkpoint folder the caller has set.

    With neither, a temporary folder of this machine is used under a local master, as in tests, and
    removed when Python ends; under any other master that is an error, since executors would write
    to disks of their own.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().conf().get("spark.checkpoint.dir", "")
    held = sc._jsc.sc().getCheckpointDir()
    if not where and held.isDefined():
        where = held.get()
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="thicketry-", dir=os.environ.get("TMPDIR"))
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        where = "file://" + own
    if not held.isDefined():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and cuts the lineage; survives a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _tables(spark: SparkSession) -> str:
    """The folder of this application's stored tables; Hadoop removes it when the JVM ends."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark)}/tables-{sc.applicationId}"
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return path


def store(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a compressed table in the shared folder: for rows that are read more than once."""
    path = f"{_tables(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of tables that are written; it does so only when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)
