"""Chat stores: tables of SQLite files as a data source, and where they lie.

A table is read by ranges of its row ids, a task each; only the columns asked
for leave the file.  The file must lie where every worker can open it.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The columns read of each table, with their types.
COLUMNS = {
    "session": {"id": "string", "title": "string", "directory": "string", "time_updated": "long", "time_archived": "long", "parent_id": "string"},
    "message": {"id": "string", "session_id": "string", "time_created": "long", "data": "string"},
    "part": {"id": "string", "message_id": "string", "data": "string"},
}
ROWS_PER_TASK = 200_000


def _open(path: str) -> sqlite3.Connection:
    # a store that is being written to makes readers wait, up to five seconds
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=5.0)


class RowRange(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema, rows_per_task: int) -> None:
        self.path, self.table, self.rows = path, table, rows_per_task
        self.types = [(f.name, f.dataType.typeName() == "string") for f in schema.fields]

    def partitions(self) -> list[RowRange]:
        db = _open(self.path)
        try:
            first, last = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        finally:
            db.close()
        if first is None:
            return [RowRange(0, -1)]
        return [RowRange(x, min(last, x + self.rows - 1)) for x in range(first, last + 1, self.rows)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string() if text else pa.int64() for _, text in self.types]
        names = [n for n, _ in self.types]
        wanted = ", ".join(f'CAST("{n}" AS {"TEXT" if text else "INTEGER"})' for n, text in self.types)
        db = _open(self.path)
        try:
            rows = db.execute(f'SELECT {wanted} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (partition.first, partition.last))
            while held := rows.fetchmany(4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
        finally:
            db.close()


class SqliteTable(DataSource):
    """``format("sqlite_table")``: options path, table, rows_per_task."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], schema, int(self.options.get("rows_per_task", ROWS_PER_TASK)))


def chat_table(spark: SparkSession, path: str, table: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The known columns that the file's table has; none of them if it cannot
    be read, so that ``session.require`` names what is missing."""
    try:
        db = _open(path)
        try:
            have = {r[1] for r in db.execute(f'PRAGMA table_info("{table}")')}
        finally:
            db.close()
    except sqlite3.Error:
        have = set()
    ddl = ", ".join(f"{c} {kind}" for c, kind in COLUMNS[table].items() if c in have)
    if not ddl:
        return spark.createDataFrame([], "unreadable string")
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlite_table").schema(ddl).option("path", path).option("table", table).option("rows_per_task", rows_per_task).load()


def chat_stores(env: dict[str, str] | None = None, home: str | None = None) -> list[str]:
    """Paths of the stores that exist: those named in the environment go first."""
    e = os.environ if env is None else env
    usual = os.path.join(home or os.path.expanduser("~"), ".local", "share", "opencode")
    named = [e.get("OPENCODE_DB"), e.get("OPENCODE_DB_LOCAL"), os.path.join(usual, "opencode.db"), os.path.join(usual, "opencode-local.db")]
    return [p for p in dict.fromkeys(os.path.abspath(p) for p in named if p) if os.path.exists(p)]
