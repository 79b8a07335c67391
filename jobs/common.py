"""What the jobs share: settings, counted writes, tables that may not be there yet."""

from __future__ import annotations

import argparse
import logging
import tomllib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("recollect.jobs")


def settings(about: str, config: str, argv: list[str] | None = None) -> dict:
    """The settings of a job's file; each can be given anew as ``--name``."""
    p = argparse.ArgumentParser(description=about)
    p.add_argument("--config", default=config)
    known, rest = p.parse_known_args(argv)
    with open(known.config, "rb") as f:
        said = tomllib.load(f)
    for name, value in said.items():
        p.add_argument("--" + name.replace("_", "-"), default=value, type=type(value))
    got = vars(p.parse_args(rest))
    del got["config"]
    return got


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).getOrCreate()


def existing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``; one without rows if none was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


#: Bytes of Parquet files that a task reads at most, and of their row groups: what a task sorts fits its memory.
SPLIT = 32 << 20


@contextmanager
def small_splits(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(SPLIT))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def counted_write(df: DataFrame, path: str, *by: str, mine: Column | None = None, **counts: Column) -> dict[str, int]:
    """Write ``df`` to folders by ``by`` and count what was written.

    It takes the place of all that was there, or with ``mine``, a condition on
    the folders that holds for its rows, of those that it has rows for.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "static" if mine is None else "dynamic").option("compression", "zstd").option("parquet.block.size", SPLIT).partitionBy(*by).parquet(path)
    told = df.sparkSession.read.schema(df.schema).parquet(path)
    told = told if mine is None else told.where(mine)
    counts = {"rows": F.count(F.lit(1)), **counts}
    got = {n: v or 0 for n, v in told.agg(*(c.alias(n) for n, c in counts.items())).first().asDict().items()}
    log.info("wrote %s: %s", path, ", ".join(f"{v} {n}" for n, v in got.items()))
    return got
