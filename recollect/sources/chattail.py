"""A growing chat store as a streaming source.

The offset is the last row of the table of message parts that was read.  A
batch brings, whole, each message that has got a part since: one that was
added to a session read before arrives alone, and one that has grown arrives
again with all its parts.  A table that has become shorter was written anew
and is read from its beginning.  New rows are dealt to tasks by ranges; a
message whose new parts lie in two of them comes from the first.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from recollect.functions.text import trimmed
from recollect.sources.chatdb import ROWS_PER_TASK, RowRange, _open

SCHEMA = "message_id string, session_id string, time_created long, data string, part_id string, part string"


class ChatRange(RowRange):
    def __init__(self, first: int, last: int, begin: int) -> None:
        super().__init__(first, last)
        self.begin = begin  # of the batch


class ChatTail(DataSourceStreamReader):
    def __init__(self, options) -> None:
        self.path, self.rows = options["path"], int(options.get("rows_per_task", ROWS_PER_TASK))

    def initialOffset(self) -> dict:
        return {"part": 0}

    def latestOffset(self) -> dict:
        db = _open(self.path)
        try:
            return {"part": db.execute("SELECT coalesce(max(rowid), 0) FROM part").fetchone()[0]}
        finally:
            db.close()

    def partitions(self, start: dict, end: dict) -> list[ChatRange]:
        begin = (start["part"] if start["part"] <= end["part"] else 0) + 1
        return [ChatRange(x, min(end["part"], x + self.rows - 1), begin) for x in range(begin, end["part"] + 1, self.rows)] or [ChatRange(0, -1, 0)]

    def read(self, partition: ChatRange) -> Iterator[tuple]:
        db = _open(self.path)
        try:
            rows = db.execute(
                """SELECT m.id, m.session_id, m.time_created, CAST(m.data AS TEXT), CAST(p.id AS TEXT), CAST(p.data AS TEXT)
                FROM (SELECT message_id, min(rowid) AS first FROM part WHERE rowid BETWEEN ? AND ? GROUP BY message_id) n
                JOIN message m ON m.id = n.message_id JOIN part p ON p.message_id = m.id
                WHERE n.first >= ?""",
                (partition.begin, partition.last, partition.first),
            )
            while held := rows.fetchmany(4096):
                yield from held
        finally:
            db.close()


class ChatTailSource(DataSource):
    """``readStream.format("chat_tail")``: options path, rows_per_task."""

    @classmethod
    def name(cls) -> str:
        return "chat_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ChatTail:
        return ChatTail(self.options)


def entries(rows: DataFrame) -> DataFrame:
    """(session_id, ts, content) of users' messages with text, from ``SCHEMA``."""
    text = F.get_json_object("part", "$.text")
    said = rows.where((F.get_json_object("data", "$.role") == "user") & (F.get_json_object("part", "$.type") == "text") & (trimmed(text) != ""))
    lines = F.array_sort(F.collect_set(F.struct(F.col("part_id").alias("k"), text.alias("t"))))
    joined = said.groupBy("message_id", "session_id", F.col("time_created").alias("ts")).agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("content"))
    return joined.select("session_id", "ts", "content")
