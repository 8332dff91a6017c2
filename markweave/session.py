"""Session helpers shared by the whole library."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Sessions (by application id) that already carry the library's Python files.
_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the path may be a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the shared checkpoint folder the cluster names; set one of our own only where none is and all runs on this machine."""
    sc = spark.sparkContext
    if sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().isDefined():
        return
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="markweave-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)


def release_checkpoints(spark: SparkSession) -> None:
    """Delete what this application has written to its own part of the checkpoint folder; for the end of a run, when all results are stored.

    Sessions that are built here may set ``spark.cleaner.referenceTracking.cleanCheckpoints`` as well, which deletes earlier.
    """
    sc = spark.sparkContext
    place = sc._jsc.sc().getCheckpointDir()
    if place.isDefined():
        path = sc._jvm.org.apache.hadoop.fs.Path(place.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back, so that no later failure recomputes it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """A scanned table over all cores: one that comes in fewer partitions than there are cores, as a small file does, is dealt out anew.

    What has been shuffled keeps the partitions it has; nothing is run to find out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString() or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def ship_library(spark: SparkSession) -> None:
    """Give the executors this package once per application, wherever they were started."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="markweave-py-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "markweave_py.zip")
    with zipfile.ZipFile(path, "w") as z:
        for base, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
