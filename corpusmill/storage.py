"""What must outlive a stage goes to the folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is configured, a temporary one, and only if all tasks run on this machine."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        path = tempfile.mkdtemp(prefix="corpusmill-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Input for each core up to which a table in few files is spread.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table in fewer files than there are cores, dealt out to all cores; any other as it is.

    A file of one row group is one task however it is split. Beyond the size, moving the rows costs more than it saves.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= cores * SPREAD_BYTES
    return df.repartition(cores) if small and len(df.inputFiles()) < cores else df
