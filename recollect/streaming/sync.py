"""Incremental sync of append-only logs and of chat stores into a store."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recollect.operators.session import entries_to_rows
from recollect.plans.scratch import settle
from recollect.plans.store import Store
from recollect.sources.chattail import ChatTailSource, entries
from recollect.sources.logtail import LogTailSource
from recollect.sources.readers import parse_jsonl


def sync_batch(store: Store, entries: DataFrame, source: str, now_ms: int, **condensing) -> dict[str, int]:
    """Ingest (session_id, ts, content) rows; known ones are duplicates.

    The entries are read once; the rows are counted as they are judged.
    """
    entries = settle(entries)
    messages = entries.count()
    report = store.ingest(entries_to_rows(entries, source, **condensing), now_ms)
    kept, new = report.agg(F.count("*"), F.count_if(~F.col("deduplicated") & F.col("error").isNull())).first()
    return {"messages": messages, "new_docs": new, "deduplicated": kept - new, "skipped": messages - kept}


def sync_logs(store: Store, path: str, checkpoint: str, source: str = "log", now_ms: int | None = None, every: str | None = None) -> StreamingQuery:
    """Follow the logs of a folder, or of a glob in one.

    The checkpoint holds how far each file was read, so lines appended later
    are taken by the next batch or the next query; the hash makes a lost
    checkpoint harmless.  Documents get the time of their batch unless
    ``now_ms`` is given.  Without ``every`` what is there is taken and the
    query ends.
    """
    store.spark.dataSource.register(LogTailSource)
    lines = store.spark.readStream.format("log_tail").option("path", path).load()

    def batch(df: DataFrame, _: int) -> None:
        sync_batch(store, df, source, int(time.time() * 1000) if now_ms is None else now_ms)

    out = parse_jsonl(lines).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def sync_chats(store: Store, path: str, checkpoint: str, source: str = "chat", now_ms: int | None = None, every: str | None = None, **condensing) -> StreamingQuery:
    """Follow the users' messages of a chat store's file.

    The checkpoint holds how far its parts were read; a message that has grown
    is taken again, as a text of its own.  Without ``every`` what is there is
    taken and the query ends.
    """
    store.spark.dataSource.register(ChatTailSource)
    rows = store.spark.readStream.format("chat_tail").option("path", path).load()

    def batch(df: DataFrame, _: int) -> None:
        sync_batch(store, entries(df), source, int(time.time() * 1000) if now_ms is None else now_ms, **condensing)

    out = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()
