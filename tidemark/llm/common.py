"""Helpers that the text operators share."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The repository's own folder, so that Python workers on a machine which has it find the package.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Rows of a batch that a Python worker takes up, where the session has Spark's default of 10,000: texts can be long.
BATCH_ROWS = 1000
#: Rows up to which a table of a few numbers is sent to every task.
HANDED_ROWS = 500_000


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package when the repository lies on their path, and bound what they take up at once."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; on one machine a temporary one is set if it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tidemark-shared-")
        atexit.register(shutil.rmtree, own, True)
        folder = "file://" + own
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder's owner cleans it up
        pass


#: Folders that settle() has written, and no others may be removed.
_SETTLED: set[str] = set()


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage is cut and survives lost executors.

    The table is removed when the driver's process ends.
    """
    spark = df.sparkSession
    own = f"tidemark-{name}-{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{own}"
    df.write.parquet(path)
    _SETTLED.add(own)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Remove the tables behind settled frames that nothing reads any more."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.rsplit("/", 1)[-1] in _SETTLED:
                remove(df.sparkSession, path)


def freed(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that are done with, which else stay until the driver's heap is full.

    A second round takes what the first has set free, and the executors get a moment to remove it.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def handed(rows: DataFrame) -> DataFrame:
    """The same rows of a few numbers each, to be sent to every task if there are few; else joins shuffle."""
    return F.broadcast(rows) if rows.count() <= HANDED_ROWS else rows
