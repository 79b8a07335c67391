"""Ingest texts: validate, deduplicate by content hash, chunk, embed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.chunking import chunks
from recollect.functions.text import content_hash, trimmed, units
from recollect.plans.scratch import settle

# The sixteen extensions read by default, and the content types.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".json", ".md", ".txt", ".py", ".go", ".rs", ".java", ".c", ".h", ".cpp", ".html", ".css")
CONTENT_TYPES = {
    ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "jsx", ".json": "json",
    ".md": "markdown", ".txt": "text", ".py": "python", ".go": "go", ".rs": "rust", ".toml": "toml",
    ".yaml": "yaml", ".yml": "yaml", ".html": "html", ".css": "css", ".sql": "sql", ".jsonl": "jsonl", ".log": "log",
}


def content_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"[^/.](\.[^./]*)$", 1))
    known = F.create_map(*(F.lit(x) for kv in CONTENT_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, ext), F.lit("text"))


def first_wins(rows: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key, by ``order``: one shuffle on the key.

    ``min_by`` over a struct combines map-side, so a hot key costs a row a task.
    """
    rest = [c for c in rows.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("row")
    return rows.groupBy(key).agg(best).select(key, "row.*").select(*rows.columns)


@dataclass(frozen=True)
class Ingested:
    """New rows for the store, and what was turned away."""

    documents: DataFrame
    chunks: DataFrame
    report: DataFrame  # id, title, chunk_count, tokens, deduplicated, error


def ingest(rows: DataFrame, known: DataFrame, embedder, now_ms: int, max_units: int = 1_000_000, max_chars: int = 900, overlap_chars: int = 120, known_chunks: DataFrame | None = None) -> Ingested:
    """``rows``: content, title, source, content_type, metadata, scope (null:
    none).  ``known``: the store's documents.  A blank or too long text is an
    error row; a text whose (scoped) hash is known or came earlier is a
    duplicate.  Ids are hashes of the content's, so a rerun gives the same.
    A known text's tokens are summed from ``known_chunks``, if given.
    """
    h = F.when(F.col("scope").isNull(), content_hash(F.col("content"))).otherwise(content_hash(F.col("content"), F.col("scope")))
    error = F.when(F.col("content").isNull() | (trimmed(F.col("content")) == ""), "empty text").when(units(F.col("content")) > max_units, "text too long")
    rows = rows.withColumns({"content_hash": h, "error": error})
    good = rows.where(F.col("error").isNull())
    one = first_wins(good, "content_hash", "title", "source")
    seen = known.where(F.col("content_hash").isNotNull()).select("content_hash").distinct()
    new = one.join(seen, "content_hash", "left_anti").withColumn("id", F.concat(F.lit("doc-"), F.substring("content_hash", 1, 32)))
    cut = settle(new.withColumn("parts", chunks(F.col("content"), max_chars, overlap_chars)).drop("content"))
    documents = cut.select(
        "id",
        "title",
        "source",
        F.coalesce("content_type", F.lit("text")).alias("content_type"),
        F.coalesce("metadata", F.lit("{}")).alias("metadata"),
        F.size("parts").alias("chunk_count"),
        F.lit(now_ms).cast("long").alias("created_at"),
        F.lit(now_ms).cast("long").alias("updated_at"),
        "content_hash",
    )
    pieces = cut.select(F.col("id").alias("doc_id"), F.inline("parts")).select(
        F.concat("doc_id", F.lit("#"), "idx").alias("id"),
        "doc_id",
        "idx",
        F.col("text").alias("content"),
        embedder.column(F.col("text")).alias("embedding"),
        "token_count",
        F.lit(now_ms).cast("long").alias("created_at"),
    )
    fresh = cut.select("content_hash", "id", F.size("parts").alias("chunk_count"), F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["token_count"]).alias("tokens"))
    have = known.select("content_hash", F.col("id").alias("known_id"), F.col("chunk_count").alias("known_chunks"))
    # the first row of a text is the one that counts: a least row a text, added up before any shuffle
    said = settle(good.select("title", "source", "content_hash").withColumn("row", F.monotonically_increasing_id()))
    first = said.groupBy("content_hash").agg(F.min(F.struct("title", "source", "row"))["row"].alias("first"))
    judged = said.join(first, "content_hash").join(have, "content_hash", "left")
    if known_chunks is not None:
        hits = judged.where(F.col("known_id").isNotNull()).select(F.col("known_id").alias("doc_id")).distinct()
        sums = known_chunks.join(hits, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("known_id")).agg(F.sum("token_count").alias("known_tokens"))
        judged = judged.join(sums, "known_id", "left")
    else:
        judged = judged.withColumn("known_tokens", F.lit(None).cast("long"))
    report = judged.join(fresh, "content_hash", "left").select(
        F.coalesce("known_id", "id").alias("id"),
        "title",
        F.coalesce("known_chunks", "chunk_count").alias("chunk_count"),
        F.coalesce("known_tokens", "tokens").alias("tokens"),
        (F.col("known_id").isNotNull() | (F.col("row") != F.col("first"))).alias("deduplicated"),
        F.lit(None).cast("string").alias("error"),
    )
    bad = rows.where(F.col("error").isNotNull()).select(F.lit(None).cast("string").alias("id"), "title", F.lit(0).alias("chunk_count"), F.lit(0).cast("long").alias("tokens"), F.lit(False).alias("deduplicated"), "error")
    return Ingested(documents, pieces, report.unionByName(bad))


def list_documents(documents: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    page = documents.select("id", "title", "source", "content_type", "chunk_count", "created_at", "updated_at")
    return page.orderBy(F.desc("updated_at"), "id").offset(max(0, offset)).limit(max(1, min(1000, limit)))


def document_page(documents: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of ``list_documents``, each row with the number of all documents."""
    total = documents.agg(F.count("*").alias("total"))
    return list_documents(documents, limit, offset).crossJoin(F.broadcast(total))  # beside one row


def delete_document(documents: DataFrame, chunk_table: DataFrame, id) -> tuple[DataFrame, DataFrame]:
    """Both tables without a document and its chunks."""
    return documents.where(F.col("id") != id), chunk_table.where(F.col("doc_id") != id)


def document_stats(documents: DataFrame, chunk_table: DataFrame) -> DataFrame:
    """One row: documents, chunks, tokens; each side is one aggregate."""
    d = documents.agg(F.count("*").alias("documents"))
    c = chunk_table.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("tokens"))
    return d.crossJoin(F.broadcast(c))  # one row beside one row
