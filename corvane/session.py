"""Session helpers shared by every operator: table access, lineage cuts, shared folders."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LINEAGE_CONF = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir``, or where that is unset
    (local tests only) a fresh temporary folder, which is then used as checkpoint folder too."""
    sc = spark.sparkContext
    configured = spark.conf.get(LINEAGE_CONF, None) or sc.getConf().get(LINEAGE_CONF, None)
    if not configured and not sc.master.startswith("local"):
        raise ValueError(f"set {LINEAGE_CONF} to a folder that all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="corvane-"))
    return configured or sc._jsc.sc().getCheckpointDir().get()


def new_shared_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to a table in the shared folder and read from there. Unlike a checkpoint
    its size is known to the planner, so joins broadcast it only where it is small."""
    path = new_shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, which else stay
    until the driver happens to collect its garbage. For loops of many jobs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system and path object of ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p
