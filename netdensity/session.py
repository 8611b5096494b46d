"""Session helpers: table loading, shared checkpoint folder, lineage cuts."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Partitions that ``fewer`` leaves to each core, and the bytes of source beyond which it leaves more.
WAVES = 6
SHARE = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the dataset folder; a single Parquet file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as named by ``spark.checkpoint.dir``.

    Where the setting is missing in a local session, as in tests, a temporary folder of
    this machine is set once for the session; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="netdensity-checkpoint-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def fewer(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df`` in fewer partitions, if it has more than WAVES for each core and one for each SHARE bytes of the ``source`` that it is made from.

    No row moves. On a file system without native Hadoop each file written costs two processes of the executor (chmod, also of its
    checksum), and each partition of a Python step a run of a worker; many small partitions make thousands of them.
    """
    size = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.coalesce(min(max(WAVES * df.sparkSession.sparkContext.defaultParallelism, size // SHARE), 1 << 20))


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of what is no longer referenced; it acts on the driver's garbage collection only."""
    gc.collect()
    spark._jvm.System.gc()
