"""Readers: files, directories, JSON-lines logs."""

from __future__ import annotations

import os
import posixpath
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.text import strip_bom, trimmed
from recollect.operators.ingest import EXTENSIONS, content_type

# Directories that a walk leaves out.
SKIPPED_DIRS = (".git", "dist", "node_modules", ".rag-data", ".test-data", ".venv")
DIR_MAX_FILES, REPORTED = 500, 50
JSONL = "session string, sessionId string, ts string, time string, content string, text string"


def canonical(path: str) -> str:
    """The path without ``.``, ``..`` and, on local disks, links."""
    scheme, host, rest = re.match(r"(?:([A-Za-z][\w+.\-]+):(?=/))?((?<=:)//[^/]*)?(.*)", path, re.S).groups()
    if scheme in (None, "file"):
        return os.path.realpath(rest)
    return f"{scheme}:{host or ''}{posixpath.normpath('/' + rest.lstrip('/'))}"


def allowed(path: str, dirs: tuple[str, ...]) -> bool:
    """Equal to or below an allowed directory, as both really lie; no
    directories allow all."""
    real = canonical(path)
    return not dirs or any(real == d or real.startswith(d.rstrip("/") + "/") for d in map(canonical, dirs))


def _status(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(path)
    return fs.getFileStatus(p)


def _read(spark: SparkSession, paths: list[str], metadata: str | None) -> DataFrame:
    """Rows for ``ingest`` of these files; bytes that are no UTF-8 become U+FFFD."""
    plain = [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in paths]
    if plain:
        files = spark.read.format("binaryFile").load(plain)
    else:
        files = spark.createDataFrame([], "path string, content binary")
    return files.select(
        strip_bom(F.make_valid_utf8(F.col("content").cast("string"))).alias("content"),
        F.element_at(F.split("path", "/"), -1).alias("title"),
        F.col("path").alias("source"),
        content_type(F.col("path")).alias("content_type"),
        (F.lit(metadata) if metadata else F.to_json(F.struct("path"))).alias("metadata"),
        F.lit(None).cast("string").alias("scope"),
    )


def _limit(max_mb: float) -> int:
    return max(1024, int(max_mb * (1 << 20)))


def read_file(spark: SparkSession, path: str, max_mb: float = 10.0, dirs: tuple[str, ...] = (), metadata: str | None = None) -> DataFrame:
    """The row for ``ingest`` of one file, whatever its suffix."""
    status = _status(spark, path)
    if not status.isFile():
        raise IsADirectoryError(f"{path} is not a file")
    if status.getLen() > _limit(max_mb):
        raise ValueError(f"{path} is too large: {status.getLen()} bytes, of {_limit(max_mb)} allowed")
    if not allowed(path, dirs):
        raise PermissionError(f"{path} is outside the allowed directories")
    return _read(spark, [status.getPath().toString()], metadata)


def read_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS, recursive: bool = True, max_mb: float = 10.0, max_files: int = DIR_MAX_FILES, dirs: tuple[str, ...] = (), metadata: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows for ``ingest``, one report row) of a directory tree.

    Files are chosen by suffix and sorted by path; those past ``max_files``,
    larger than ``max_mb`` or linked from outside the allowed directories
    count as skipped, and the report gives the first reasons.  Names and sizes
    are listed first, and contents read of chosen files only.
    """
    status = _status(spark, path)
    if status.isFile():
        raise NotADirectoryError(f"{path} is not a directory")
    if not allowed(path, dirs):
        raise PermissionError(f"{path} is outside the allowed directories")
    if not extensions or not all(e.strip() for e in extensions):
        raise ValueError("extensions must be named")
    ends = tuple(e if e.startswith(".") else f".{e}" for e in (x.lower() for x in extensions))
    name = F.lower("path")
    suffix = F.lit(False)
    for e in ends:
        suffix = suffix | name.endswith(e)
    root = status.getPath().toUri().getPath().rstrip("/")
    below = F.element_at(F.split(F.col("path"), F.lit(f"\\Q{root}\\E"), 2), -1)
    parts = F.slice(F.split(below, "/"), 1, F.greatest(F.size(F.split(below, "/")) - 1, F.lit(0)))
    hidden = F.exists(parts, lambda d: d.startswith(".") | d.isin(*SKIPPED_DIRS))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    listed = listed.where(suffix & ~hidden).select("path", "length")
    files, first = listed.count(), listed.orderBy("path").limit(max_files).collect()
    taken, reasons = [], []
    for f in first:
        if f.length > _limit(max_mb):
            reasons.append(f"{f.path} (too large: {f.length} bytes, of {_limit(max_mb)} allowed)")
        elif not allowed(f.path, dirs):
            reasons.append(f"{f.path} (outside the allowed directories)")
        else:
            taken.append(f.path)
    skipped, beyond = files - len(taken), files - len(first)
    if beyond:
        reasons = [*reasons[: REPORTED - 1], f"{beyond} more files (of {max_files} allowed)"]
    report = spark.createDataFrame([(files, len(first), skipped, reasons[:REPORTED])], "files long, taken long, skipped long, reasons array<string>")
    return _read(spark, taken, metadata), report


def parse_jsonl(lines: DataFrame, default_session: str | None = None) -> DataFrame:
    """(session_id, ts, content) of log lines; blank and malformed ones drop.

    A line without a time gets ``0``: with the time of reading, another run
    would not find it a duplicate.
    """
    r = F.from_json(trimmed(F.col("value")), JSONL, {"mode": "PERMISSIVE"})
    got = lines.where(trimmed(F.col("value")) != "").withColumn("r", r)
    body = trimmed(F.coalesce("r.content", "r.text"))
    file = F.col("file") if "file" in lines.columns else F.col("_metadata.file_name")
    named = F.lit(default_session) if default_session is not None else F.regexp_extract(file, r"^(.*?)(\.jsonl)?$", 1)
    out = got.select(F.coalesce("r.session", "r.sessionId", named).alias("session_id"), F.coalesce("r.ts", "r.time", F.lit("0")).alias("ts"), body.alias("content"))
    return out.where(F.coalesce(F.col("content"), F.lit("")) != "")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A log, or all logs of a glob; lines are split across tasks."""
    return parse_jsonl(spark.read.text(path))
