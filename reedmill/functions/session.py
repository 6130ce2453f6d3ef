"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes a DataFrame to the shared checkpoint folder and reads it back from there.

    The folder is the session's ``spark.checkpoint.dir``.  Where none is set, a local session gets a folder of its own,
    which goes when the process ends; on a cluster, where a machine's own folder is not seen by the others, that is an
    error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def pair_hash(*columns: str) -> list:
    """Two columns, together a 128-bit fingerprint of the given columns."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)]


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where the input has fewer parts than those (a small file is one part); else as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
