"""Growing JSON-lines logs as a streaming source.

The offset holds, for each file, the bytes whose lines were read, so lines
appended later arrive and no line is read twice.  A file shorter than its
offset was written anew and is read from its beginning.  New bytes are dealt
to tasks by ranges; a line belongs to the range that it starts in.
"""

from __future__ import annotations

import fnmatch
import io
import json
import os
import re
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BYTES_PER_TASK = 32 << 20
_BLOCK = 1 << 16


def _place(path: str) -> tuple[pafs.FileSystem, str, str]:
    """(file system, folder, pattern of names) of a folder or a glob in one."""
    head, _, name = path.rstrip("/").rpartition("/")
    folder, pattern = (head, name) if re.search(r"[*?\[]", name) else (path, "*.jsonl")
    if "://" not in folder:
        folder = os.path.abspath(re.sub(r"^file:", "", folder))
    system, root = pafs.FileSystem.from_uri(folder)
    return system, root, pattern


def log_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a log, or of those of a folder or a glob; none if it is missing."""
    system, root, pattern = _place(path)
    if (one := system.get_file_info(root)).is_file:
        return [(one.path, one.size)]
    found = system.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.is_file and fnmatch.fnmatch(f.base_name, pattern))


def whole_lines(system: pafs.FileSystem, path: str, size: int) -> int:
    """Bytes of the lines that are whole: ended by a newline, or valid JSON."""
    tail, at = b"", size
    with system.open_input_file(path) as f:
        while at > 0 and b"\n" not in tail:
            step = min(max(_BLOCK, len(tail)), at)
            at -= step
            f.seek(at)
            tail = f.read(step) + tail
    last = tail[tail.rfind(b"\n") + 1 :]
    try:
        json.loads(last)
    except ValueError:
        return size - len(last)
    return size


class LogRange(InputPartition):
    def __init__(self, path: str, begin: int, end: int, stop: int, first: bool) -> None:
        self.path, self.begin, self.end, self.stop, self.first = path, begin, end, stop, first


class LogTail(DataSourceStreamReader):
    def __init__(self, options) -> None:
        self.path, self.bytes = options["path"], int(options.get("bytes_per_task", BYTES_PER_TASK))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system = _place(self.path)[0]
        return {path: whole_lines(system, path, size) for path, size in log_files(self.path)}

    def partitions(self, start: dict, end: dict) -> list[LogRange]:
        out = []
        for path, stop in end.items():
            begin = start.get(path, 0)
            begin = begin if begin <= stop else 0
            out += [LogRange(path, x, min(stop, x + self.bytes), stop, x == begin) for x in range(begin, stop, self.bytes)]
        return out or [LogRange("", 0, 0, 0, True)]

    def read(self, partition: LogRange) -> Iterator[tuple[str, str]]:
        at = partition.begin
        if at >= partition.end:
            return
        name = partition.path.rsplit("/", 1)[-1]
        with io.BufferedReader(_place(self.path)[0].open_input_file(partition.path), 1 << 20) as f:
            f.seek(at if partition.first else at - 1)
            if not partition.first:
                at += len(f.readline()) - 1
            while at < partition.end and (line := f.readline(partition.stop - at)):
                at += len(line)
                yield line.decode("utf-8", "replace"), name


class LogTailSource(DataSource):
    """``readStream.format("log_tail")``: options path, bytes_per_task."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "value string, file string"

    def streamReader(self, schema) -> LogTail:
        return LogTail(self.options)
