"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, as in tests on one
    machine, a folder of the session's own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = f"file://{tempfile.mkdtemp(prefix='recollect-')}"
        where = _own[app]
    return where.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; its files stay."""
    return f"{shared_dir(spark)}/recollect/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended, and with it the files' use
        pass


def passing_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when the driver's Python ends:
    a returned DataFrame may read it until then."""
    path = fresh_dir(spark, name)
    atexit.register(_remove, spark, path)
    return path


def tidy(spark: SparkSession) -> None:
    """Have files of shuffles and checkpoints removed that nothing refers to any
    more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settle(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint: computed once, and safe from lost executors."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
