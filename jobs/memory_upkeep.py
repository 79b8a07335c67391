"""Job: memories of conversations, weighed by their use and consolidated.

    python -m jobs.memory_upkeep --config jobs/memory_upkeep.toml

Each turn of ``conversations`` is a memory, of a type by its role.  ``events``
is the log of use: events of a conversation's id count as recalls of its
memories, the last one dates them, the mean value is their importance.  Then
the upkeep: near-duplicates go (the more important one stays), memories
recalled often rise, and idle unimportant ones are pruned.  Written below
``output``, in place of an earlier run's:

* ``kept/type=`` - the memories that stay;
* ``removed/reason=`` - the others: ``duplicate`` or ``pruned``.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import counted_write, existing, log, session, settings
from recollect.functions.embedding import LocalEmbedder
from recollect.functions.text import clamp_importance, trimmed
from recollect.operators import memory

# What a turn of each role is remembered as.
TYPES = {"user": "conversation", "assistant": "insight", "system": "instruction"}
KEPT_DDL = "id long, content string, importance double, recall_count int, last_recalled long, created_at long, type string"
REMOVED_DDL = "id long, content string, reason string"
KEPT = ("id", "content", "importance", "recall_count", "last_recalled", "created_at", "type")


def _ms(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def memories_of(conversations: DataFrame, events: DataFrame, now_ms: int, unused_importance: float = 0.1) -> DataFrame:
    """One memory a turn with text; of repeated turns the first text.

    The first event of a conversation dates its memories.  One without events
    is as old as the log, was never recalled and has ``unused_importance``.
    """
    begun = events.agg(F.min(_ms(F.col("ts")))).first()[0]
    said = conversations.where(trimmed(F.coalesce("text", F.lit(""))) != "").where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    turns = said.groupBy("conv_id", "turn").agg(F.min_by(F.struct("role", "text"), F.struct("text", "role")).alias("said"))
    use = events.where(F.col("user_id").isNotNull()).groupBy(F.col("user_id").alias("conv_id")).agg(
        F.count("*").cast("int").alias("recall_count"), F.max(_ms(F.col("ts"))).alias("last_recalled"), F.min(_ms(F.col("ts"))).alias("created_at"), F.avg("value").alias("value")
    )
    kind = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))
    return turns.join(use, "conv_id", "left").select(
        (F.col("conv_id") * 100_000 + F.col("turn")).alias("id"),
        F.coalesce(F.try_element_at(kind, F.col("said.role")), F.lit("fact")).alias("type"),
        F.col("said.text").alias("content"),
        F.round(clamp_importance(F.coalesce(F.col("value") / 500, F.lit(unused_importance))), 6).alias("importance"),
        F.coalesce("recall_count", F.lit(0)).alias("recall_count"),
        "last_recalled",
        F.coalesce("created_at", F.lit(now_ms if begun is None else begun).cast("long")).alias("created_at"),
    )


def run(spark: SparkSession, conversations: str, events: str, output: str, now: str, min_importance: float = 0.2, age_days: float = 10.0, unused_importance: float = 0.1) -> dict[str, int]:
    """Write the consolidated memories; a rerun writes the same."""
    now_ms = int(datetime.datetime.fromisoformat(now).replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    turns, used = spark.read.parquet(conversations), spark.read.parquet(events)
    found = memory.settle(memories_of(turns, used, now_ms, unused_importance))
    log.info("read %d memories of %s and %s", found.count(), conversations, events)
    twice = memory.duplicates(found, LocalEmbedder())
    risen = memory.promote(memory.among(found, twice, "left_anti"))
    pruned = F.coalesce(memory.prunable(now_ms, min_importance, age_days), F.lit(False))
    kept = counted_write(risen.where(~pruned).select(*KEPT), f"{output}/kept", "type")
    gone = memory.among(found, twice).withColumn("reason", F.lit("duplicate")).unionByName(risen.where(pruned).withColumn("reason", F.lit("pruned")))
    removed = counted_write(gone.select("id", "content", "reason"), f"{output}/removed", "reason")
    told = {"kept": kept["rows"], "removed": removed["rows"]}
    log.info("wrote %s: %s", output, told)
    return told


def read(spark: SparkSession, output: str) -> DataFrame:
    """The whole output: id, type, importance of those kept; reason of the others."""
    none = lambda kind: F.lit(None).cast(kind)
    kept = existing(spark, f"{output}/kept", KEPT_DDL).select("id", "type", "importance", none("string").alias("reason"))
    return kept.unionByName(existing(spark, f"{output}/removed", REMOVED_DDL).select("id", none("string").alias("type"), none("double").alias("importance"), "reason"))


def main(argv: list[str] | None = None) -> None:
    said = settings("Consolidate the memories of conversations", "jobs/memory_upkeep.toml", argv)
    spark = session("memory_upkeep")
    try:
        run(spark, **said)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
