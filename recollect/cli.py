"""Command line: the store's operations, results as JSON."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.config import environment, from_env
from recollect.functions.embedding import LocalEmbedder
from recollect.operators import ingest as ing
from recollect.operators import memory as mem
from recollect.operators import search as sea
from recollect.operators import session as ses
from recollect.plans.indexes import search_indexed
from recollect.plans.pages import document_pages
from recollect.plans.scratch import settle
from recollect.plans.store import Store
from recollect.sources.chatdb import chat_stores, chat_table
from recollect.sources.logtail import log_files
from recollect.sources.readers import REPORTED, read_file, read_files, read_jsonl
from recollect.streaming.sync import sync_batch, sync_chats


#: Shorter names of the same commands.
ALIASES = {
    "list": ("docs",), "document-stats": ("doc-stats",), "delete": ("rm-doc",), "memory-remember": ("remember",), "memory-recall": ("recall",),
    "memory-forget": ("forget",), "memory-consolidate": ("consolidate",), "memory-context": ("mem-context",),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("recollect")
    p.add_argument("--db")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **options):
        s = sub.add_parser(name, aliases=ALIASES.get(name, ()))
        s.set_defaults(op=name)
        for a in args:
            s.add_argument(a)
        for k, v in options.items():
            s.add_argument("--" + k.replace("_", "-"), default=v, type=type(v) if v is not None and not isinstance(v, bool) else None)
        return s

    for name in ("stats", "reindex", "document-stats", "memory-stats", "memory-consolidate", "clean-all"):
        add(name)
    add("backup", "to")
    add("restore", "source")
    add("vacuum", keep_hours=24.0)
    add("ingest-text", "text", "title")
    add("ingest-file", "path")
    add("ingest-dir", "path")
    add("ingest-jsonl", "path", source="log")
    add("sync-logs", dir=".session-logs")
    add("sessions", limit=15, dir=None)
    add("sync-session", "id", limit=0)
    add("sync-latest", limit=0, dir=None)
    add("sync-chats", "checkpoint")
    for name, k in (("search", 10), ("retrieve", 6)):
        s = add(name, "query", top_k=k, min_score=0.08, alpha=None, doc_id=None, source=None)
        s.add_argument("--explain", action="store_true")
        s.add_argument("--indexed", action="store_true", help="through the chunks' indexes, which are brought up to date first")
    s = add("list", limit=100, offset=0)
    s.add_argument("--total", action="store_true")
    s.add_argument("--cursor", nargs="?", const="", help="read by pages that no writer shifts; the next one's cursor comes with each")
    add("delete", "id")
    add("memory-remember", "content", type="fact", importance=0.5, tag=None)
    add("memory-recall", "query", top_k=8, min_score=0.1)
    add("memory-context", "topic", top_k=6)
    add("memory-list", type=None, tag=None, min_importance=None, limit=100)
    add("memory-get", "id")
    add("memory-forget", "id")
    add("memory-update", "id", content=None, type=None, importance=None, tag=None)
    return p


# The most that each command takes, of characters or of hits.
MOST_CHARS = {"query": 2000, "topic": 500, "title": 500, "path": 4096, "id": 200, "doc_id": 200, "source": 200, "tag": 64}
MOST_MEMORY = 20_000
MOST_HITS = {"search": 50, "retrieve": 20, "memory-recall": 30, "memory-context": 20}
#: What ``search`` tells of its legs, if asked to explain.
LEGS = ("rrf_score", "vector_score", "keyword_score", "vector_rank", "keyword_rank", "legs")


def bounded(a: argparse.Namespace) -> argparse.Namespace:
    """The arguments, if none is empty or out of its bounds."""
    for name, most in {**MOST_CHARS, **({"content": MOST_MEMORY} if a.op.startswith("memory") else {})}.items():
        value = getattr(a, name, None)
        if isinstance(value, str) and not (len(value) <= most and (value or name in ("doc_id", "source", "tag"))):
            raise ValueError(f"{name} must have 1 to {most} characters")
    if a.op in MOST_HITS and not 1 <= a.top_k <= MOST_HITS[a.op]:
        raise ValueError(f"top_k must be 1 to {MOST_HITS[a.op]}")
    for name in ("min_score", "alpha", "importance", "min_importance"):
        value = getattr(a, name, None)
        if value is not None and not 0 <= float(value) <= 1:
            raise ValueError(f"{name} must be 0 to 1")
    return a


def _rows(df: DataFrame) -> list:
    return [json.loads(x) for x in df.toJSON().collect()]  # listings are limited


def run(spark: SparkSession, argv: list[str], now_ms: int | None = None):
    a, cfg, e = bounded(parser().parse_args(argv)), from_env(environment()), LocalEmbedder()
    if cfg.embedding_provider != "local":
        raise ValueError(f"no {cfg.embedding_provider} embedder here: pass one to Store, or unset EMBEDDING_PROVIDER")
    now = int(time.time() * 1000) if now_ms is None else now_ms
    store = Store(spark, a.db or cfg.db_dir, e, wait_s=60.0)
    text = "content string, title string, source string, content_type string, metadata string, scope string"

    def take(rows: DataFrame):
        return _rows(store.ingest(rows, now, max_units=cfg.max_text_units))

    def find() -> DataFrame:
        store.check()
        chunks, documents = store.read("chunks"), store.read("documents")
        wanted = None
        if a.source is not None or a.doc_id is not None:
            wanted = documents if a.source is None else documents.where(F.col("source") == a.source)
            wanted = wanted if a.doc_id is None else wanted.where(F.col("id") == a.doc_id)
            wanted = wanted.select(F.col("id").alias("doc_id"))
        alpha = float(a.alpha) if a.alpha is not None else None
        how = (a.query, e.query(a.query), a.top_k, a.min_score, cfg.search_mode, alpha, cfg.rrf_k, wanted)
        hits = search_indexed(store, *how) if a.indexed else sea.search_chunks(chunks, *how)
        return sea.hydrate(hits, chunks, documents)

    def remembered(top_k: int, query: str, min_score: float) -> DataFrame:
        store.check()
        memories = store.read("memories")
        hits = mem.recall(memories, e.query(query), now, top_k, min_score, cfg.memory_half_life_days)
        return hits

    condensing = {"min_chars": cfg.condense_min_chars, "ratio": cfg.condense_ratio, "condensed": cfg.condense}

    def chats() -> list[str]:
        paths = chat_stores()
        if not paths:
            raise FileNotFoundError("no chat store: set OPENCODE_DB to its path")
        return paths

    def listed(limit: int, directory: str | None) -> DataFrame:
        return ses.list_sessions([chat_table(spark, p, "session") for p in chats()], limit, directory)

    def sync_session(id: str) -> dict:
        sources = [(chat_table(spark, p, "message"), chat_table(spark, p, "part")) for p in chats()]
        entries = ses.first_transcript(sources, id, a.limit or cfg.session_max_msgs)
        return {"session_id": id, **sync_batch(store, entries, "chat", now, **condensing)}

    c = a.op
    if c == "stats":
        return store.stats(warn_mb=cfg.vector_cache_warn_mb)
    if c in ("reindex", "backup", "restore"):
        return _rows(getattr(store, c)(*([a.to] if c == "backup" else [a.source] if c == "restore" else [])))
    if c == "vacuum":
        return {"deleted": store.vacuum(a.keep_hours)}
    if c == "clean-all":
        return store.clear()
    if c == "document-stats":
        return _rows(ing.document_stats(store.read("documents"), store.read("chunks")))
    if c == "memory-stats":
        return _rows(mem.memory_stats(store.read("memories")))
    if c == "ingest-text":
        return take(spark.createDataFrame([(a.text, a.title, None, None, None, None)], text))
    if c == "ingest-file":
        return take(read_file(spark, a.path, max_mb=cfg.max_file_mb, dirs=cfg.allowed_dirs))
    if c == "ingest-dir":
        rows, found = read_files(spark, a.path, max_mb=cfg.max_file_mb, dirs=cfg.allowed_dirs)
        got, found = take(rows), found.first()
        good = [r for r in got if not r.get("error")]
        bad = [*found.reasons, *(f"{r['title']} ({r['error']})" for r in got if r.get("error"))]
        return {"ingested": good[:REPORTED], "skipped": bad[:REPORTED], "ingested_count": len(good), "skipped_count": found.skipped + len(got) - len(good)}
    if c in ("ingest-jsonl", "sync-logs"):
        logs = log_files(a.path if c == "ingest-jsonl" else a.dir)
        if large := [f"{p} ({n} bytes)" for p, n in logs if n > cfg.session_max_log_bytes]:
            raise ValueError(f"larger than {cfg.session_max_log_bytes} bytes: {', '.join(large[:REPORTED])}")
        if c == "sync-logs" and not logs:
            return {"messages": 0, "new_docs": 0, "deduplicated": 0, "skipped": 0}
    if c == "ingest-jsonl":
        return sync_batch(store, read_jsonl(spark, a.path), a.source, now, **condensing)
    if c == "sync-logs":
        return sync_batch(store, read_jsonl(spark, f"{a.dir}/*.jsonl"), "log", now, **condensing)
    if c == "sessions":
        return _rows(listed(a.limit, a.dir).drop("source_index"))
    if c == "sync-session":
        return sync_session(a.id)
    if c == "sync-chats":
        before = store.read("documents").count()
        for n, path in enumerate(chats()):
            sync_chats(store, path, f"{a.checkpoint}/{n}", now_ms=now, **condensing).awaitTermination()
        return {"new_docs": store.read("documents").count() - before}
    if c == "sync-latest":
        hit = ses.latest_session(listed(50, a.dir), now).first()
        return {"found": hit is not None, **(sync_session(hit["id"]) if hit else {})}
    if c == "search":
        found = find().orderBy("rank")
        return _rows(found if a.explain else found.drop(*LEGS))
    if c == "retrieve":
        found = settle(find())
        rows = _rows(found.orderBy("rank").select("doc_title", "chunk_index", "content", "score", "token_count"))
        return [{**r, "chunks": rows} for r in _rows(sea.context_block(found))]
    if c == "list" and a.cursor is not None:
        page, more = document_pages(store, a.limit, a.cursor or None)
        return {"documents": page, "cursor": more}
    if c == "list" and a.total:
        page = _rows(ing.list_documents(store.read("documents"), a.limit, a.offset))
        return {"documents": page, "total": store.read("documents").count(), "limit": max(1, min(1000, a.limit)), "offset": max(0, a.offset)}
    if c == "list":
        return _rows(ing.list_documents(store.read("documents"), a.limit, a.offset))
    if c == "delete":
        one = spark.createDataFrame([(a.id, a.id)], "id string, doc_id string")
        return store.change(drop={"documents": one, "chunks": one})["version"]
    if c == "memory-remember":
        row = {"content": a.content, "type": a.type, "importance": a.importance, "tags": [a.tag] if a.tag else []}
        return store.add_memories(mem.remember(spark, [row], now, e))["version"]
    if c == "memory-recall":
        hits = settle(remembered(a.top_k, a.query, a.min_score))  # top_k rows
        out = _rows(hits.withColumns({"recall_count": F.col("recall_count") + 1, "last_recalled": F.lit(now)}))
        store.recalled(hits.select("id"), now)
        return out
    if c == "memory-context":
        return _rows(mem.memory_context(remembered(a.top_k, a.topic, 0.1)))
    if c == "memory-list":
        least = float(a.min_importance) if a.min_importance is not None else None
        return _rows(mem.list_memories(store.read("memories"), a.type, a.tag, least, a.limit))
    if c == "memory-get":
        return _rows(mem.get_memory(store.read("memories"), a.id))
    if c == "memory-forget":
        return store.change(drop={"memories": spark.createDataFrame([(a.id,)], "id string")})["version"]
    if c == "memory-update":
        patch = {"content": a.content, "type": a.type, "importance": a.importance, "tags": [a.tag] if a.tag else None}
        mine = lambda: store.read("memories").where(F.col("id") == a.id)
        return store.change(put=lambda: {"memories": mem.update_memory(mine(), a.id, patch, now, e)})["version"]
    told = {}

    def consolidated() -> dict[str, DataFrame]:
        before = store.read("memories")
        after, told["report"] = mem.consolidate(before, now, cfg.dedup_max_vectors, cfg.prune, cfg.prune_importance, cfg.prune_age_days)
        told["gone"] = before.select("id").join(after.select("id"), "id", "left_anti")
        return {"memories": after.join(before.where(mem.due()).select("id"), "id", "left_semi")}

    # the change to put is asked for first, and what goes is decided with it
    store.change(put=consolidated, drop=lambda: {"memories": told["gone"]})
    return _rows(told["report"])


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("recollect").getOrCreate()
    print(json.dumps(run(spark, sys.argv[1:]), indent=2, default=str))


if __name__ == "__main__":
    main()
