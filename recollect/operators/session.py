"""Chat sessions: listing, transcripts, condensed ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import condense, trimmed
from recollect.operators.ingest import first_wins

DAY = 86_400_000


def require(df: DataFrame, table: str, columns: tuple[str, ...]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"table {table} has no column {', '.join(missing)}")
    return df


def directory_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\\", "/"), "/+$", "")


def list_sessions(sources: list[DataFrame], limit: int = 15, directory: str | None = None) -> DataFrame:
    """Sessions of all sources, newest first; of one id the first source wins.

    Archived sessions, children and untitled ones are left out; each source
    gives its newest max(limit, 50) before sources meet.
    """
    parts = []
    for i, s in enumerate(sources):
        require(s, "session", ("id", "title", "directory", "time_updated"))
        keep = F.col("title").isNotNull()
        for optional in ("time_archived", "parent_id"):
            if optional in s.columns:
                keep = keep & F.col(optional).isNull()
        top = s.where(keep).select("id", "title", "directory", "time_updated").orderBy(F.desc("time_updated"), "id").limit(max(limit, 50))
        parts.append(top.withColumn("source_index", F.lit(i)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = first_wins(every, "id", "source_index", "time_updated")
    if directory is not None:
        every = every.where(directory_key(F.col("directory")) == directory_key(F.lit(directory)))
    return every.orderBy(F.desc("time_updated"), "id").limit(limit)


def latest_session(sessions: DataFrame, now_ms: int, days: int = 30) -> DataFrame:
    """The newest session; one within the window goes before any other."""
    fresh = (F.col("time_updated") >= now_ms - days * DAY).cast("int")
    return sessions.orderBy(F.desc(fresh), F.desc("time_updated"), "id").limit(1)


def transcript(messages: DataFrame, parts: DataFrame, session_id, limit: int = 500) -> DataFrame:
    """(session_id, ts, content): a session's user messages in order of time.

    The limit counts messages before those without text drop out.
    """
    require(messages, "message", ("id", "session_id", "time_created", "data"))
    require(parts, "part", ("message_id", "data"))
    role = F.get_json_object("data", "$.role")
    mine = messages.where((F.col("session_id") == session_id) & (role == "user")).orderBy("time_created", "id").limit(limit)
    text = F.get_json_object("data", "$.text")
    said = parts.where((F.get_json_object("data", "$.type") == "text") & (trimmed(text) != ""))
    order = F.col("id") if "id" in parts.columns else text
    said = said.select("message_id", order.alias("k"), text.alias("t"))
    joined = said.join(F.broadcast(mine.select(F.col("id").alias("message_id"), "session_id", F.col("time_created").alias("ts"))), "message_id")
    lines = F.array_sort(F.collect_list(F.struct("k", "t")))
    return joined.groupBy("message_id", "session_id", "ts").agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("content")).select("session_id", "ts", "content").orderBy("ts")


def first_transcript(sources: list[tuple[DataFrame, DataFrame]], session_id, limit: int = 500) -> DataFrame:
    """The first source with entries wins; distinct errors when none has."""
    failures, found = [], False
    for messages, parts in sources:
        try:
            t = transcript(messages, parts, session_id, limit)
            found = found or not messages.where(F.col("session_id") == session_id).isEmpty()
            if not t.isEmpty():
                return t
        except ValueError as e:
            failures.append(str(e))
    if failures and len(failures) == len(sources):
        raise ValueError("no source could be read: " + "; ".join(failures))
    raise LookupError("the session has no user text" if found else "no such session")


def entries_to_rows(entries: DataFrame, source: str, min_chars: int = 120, ratio: float = 0.35, condensed: bool = True) -> DataFrame:
    """Rows for ``ingest`` from (session_id, ts, content); blank ones drop out."""
    original = trimmed(F.col("content"))
    short = condense(F.col("content"), min_chars, ratio) if condensed else original
    sid, ts = F.col("session_id").cast("string"), F.col("ts").cast("string")
    rows = entries.where(original != "").select(sid.alias("sid"), ts.alias("t"), original.alias("original"), short.alias("content"))
    meta = F.to_json(F.struct(F.lit(source).alias("source"), F.col("sid").alias("session_id"), F.col("t").alias("ts"), (F.col("content") != F.col("original")).alias("condensed")))
    return rows.select(
        "content",
        F.concat(F.when(F.length("sid") > 12, F.expr("right(sid, 12)")).otherwise(F.col("sid")), F.lit("-"), "t").alias("title"),
        F.lit(source).alias("source"),
        F.lit("text").alias("content_type"),
        meta.alias("metadata"),
        F.concat_ws(":", F.lit(source), "sid", "t").alias("scope"),
    )
