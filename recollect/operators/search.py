"""Keyword, vector and fused search over chunks.

Every leg is a top-k over one scan: ``orderBy().limit()`` is a heap per
partition and never a full sort.  The legs that meet in the fusion hold at
most ``cap`` rows each, so the joins after them are small by construction.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions.text import clamp, query_tokens

K1, B = 1.2, 0.75


def bm25(found: list[tuple[Column, int]], size: Column, n: int, avg: float) -> Column:
    """Score of a text of ``size`` from each token's count in it and the number
    of the ``n`` texts that hold the token."""
    score = F.lit(0.0)
    for count, df in found:
        idf = math.log((n - df + 0.5) / (df + 0.5))
        idf = idf if idf > 0 else 1e-6
        f = count.cast("double")
        score = score + F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / (avg or 1.0)))
    return score


def only(rows: DataFrame, allowed: Column | DataFrame | None) -> DataFrame:
    """The rows that a condition allows, or another table by its column."""
    if allowed is None:
        return rows
    return rows.where(allowed) if isinstance(allowed, Column) else rows.join(allowed, allowed.columns, "left_semi")


def keyword_scores(chunks: DataFrame, query: str, id_col: str = "id", text_col: str = "content", allowed: Column | DataFrame | None = None) -> DataFrame:
    """(id, bm25) of chunks that contain every query token of three or more
    characters; statistics are over all chunks, ``allowed`` filters after them."""
    tokens = [t for t in query_tokens(query) if len(t) >= 3]
    if not tokens:
        return chunks.select(F.col(id_col).alias("id"), F.lit(0.0).alias("bm25")).limit(0)
    low = F.lower(F.col(text_col))
    tf = [F.when(low.contains(t), F.regexp_count(low, F.lit(f"(?=\\Q{t}\\E)"))).otherwise(0) for t in tokens]
    size = F.greatest(F.length(low) - 2, F.lit(0))
    seen = chunks.where(F.col(text_col).isNotNull())
    # statistics are one row; each token is a position, so repeats count twice
    stats = seen.agg(F.count("*").alias("n"), F.avg(size).alias("avg"), *(F.count(F.when(low.contains(t), 1)).alias(f"df{i}") for i, t in enumerate(tokens))).first()
    if not stats["n"]:
        return chunks.select(F.col(id_col).alias("id"), F.lit(0.0).alias("bm25")).limit(0)
    score = bm25([(F.col(f"tf{i}"), stats[f"df{i}"]) for i in range(len(tokens))], F.col("size"), stats["n"], stats["avg"])
    has_all = low.contains(tokens[0])
    for t in tokens[1:]:
        has_all = has_all & low.contains(t)
    hits = only(seen.where(has_all), allowed)
    return hits.select(F.col(id_col).alias("id"), size.alias("size"), *(c.alias(f"tf{i}") for i, c in enumerate(tf))).select("id", score.alias("bm25"))


def keyword_search(chunks: DataFrame, query: str, limit: int = 60, **kw) -> DataFrame:
    return keyword_scores(chunks, query, **kw).orderBy(F.desc("bm25"), "id").limit(limit)


#: Entries of a query vector that are multiplied one by one, at most.
SPARSE = 128


def _dot_literal(vector: Column, query: list[float]) -> Column:
    """Dot product with a literal vector, summed over its non-zero entries if
    these are few and the vector is finite, which makes the same sum."""
    q = F.array(*(F.lit(float(x)) for x in query))
    total = F.aggregate(F.zip_with(vector, q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    told = [(i, float(x)) for i, x in enumerate(query) if x != 0]
    if len(told) <= min(SPARSE, len(query) // 2):
        finite = (F.array_max(vector) < float("inf")) & (F.array_min(vector) > float("-inf")) & F.array_contains(vector.cast("array<double>"), F.lit(2.0)).isNotNull()
        few = F.lit(0.0)
        for i, x in told:
            few = few + F.get(vector, F.lit(i)).cast("double") * F.lit(x)
        total = F.when(finite, few).otherwise(total)
    return F.when(F.size(vector) == len(query), total).otherwise(0.0)


def vector_search(vectors: DataFrame, query: list[float], top_k: int = 10, min_score: float = 0.08, id_col: str = "id", vec_col: str = "embedding", allowed: Column | DataFrame | None = None) -> DataFrame:
    """(id, score) of the vectors nearest to a query: exact, filtered first."""
    rows = only(vectors.where(F.col(vec_col).isNotNull()), allowed)
    scored = rows.select(F.col(id_col).alias("id"), clamp(_dot_literal(F.col(vec_col), query), -1.0, 1.0).alias("score"))
    return scored.where(F.col("score") >= min_score).orderBy(F.desc("score"), "id").limit(top_k)


def ranked(leg: DataFrame, score: str) -> DataFrame:
    """Zero-based rank and size of a leg (at most ``cap`` rows)."""
    return leg.select("*", (F.row_number().over(W.orderBy(F.desc(score), "id")) - 1).alias("rank"), F.count("*").over(W.partitionBy()).alias("n"))


def fuse(
    vector_leg: DataFrame | None,
    keyword_leg: DataFrame | None,
    top_k: int = 10,
    min_score: float = 0.08,
    alpha: float | None = None,
    rrf_k: float = 60.0,
) -> DataFrame:
    """Merge two ranked legs: reciprocal rank fusion, or a blend by ``alpha``.

    Cut to ``top_k`` first, then ``min_score`` on the reported score: the
    blend, or without alpha the larger of cosine and rank-decayed keyword.
    """
    if alpha is not None and not 0 <= alpha <= 1:
        raise ValueError("alpha must be between 0 and 1")
    if vector_leg is None and keyword_leg is None:
        raise ValueError("no leg to search")
    spark = (vector_leg if vector_leg is not None else keyword_leg).sparkSession
    kind = dict((vector_leg if vector_leg is not None else keyword_leg).dtypes)["id"]
    none = lambda score: spark.createDataFrame([], f"id {kind}, {score} double")
    v = ranked(vector_leg if vector_leg is not None else none("score"), "score").select("id", F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    k = ranked(keyword_leg if keyword_leg is not None else none("bm25"), "bm25")
    k = k.select(
        "id",
        (1 - F.col("rank") / (F.col("n") + 1)).alias("keyword_decay"),
        F.col("rank").alias("keyword_rank"),
        (F.col("bm25") / F.max("bm25").over(W.partitionBy())).alias("keyword_score"),
    )
    both = v.join(k, "id", "full_outer")
    part = lambda r: F.coalesce(1 / (F.lit(float(rrf_k)) + F.col(r) + 1), F.lit(0.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    both = both.withColumn("rrf_score", part("vector_rank") + part("keyword_rank"))
    blend = None if alpha is None else alpha * zero("vector_score") + (1 - alpha) * zero("keyword_score")
    both = both.withColumn("score", F.greatest(zero("vector_score"), zero("keyword_decay")) if blend is None else blend)
    order = [F.desc("rrf_score" if alpha is None else "score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank"), F.col("id")]
    legs = F.array_compact(F.array(F.when(F.col("vector_rank").isNotNull(), F.lit("vector")), F.when(F.col("keyword_rank").isNotNull(), F.lit("keyword"))))
    top = both.orderBy(*order).limit(top_k)
    top = top.withColumn("rank", F.row_number().over(W.orderBy(*order)) - 1).where(F.col("score") >= min_score)
    return top.select("rank", "id", "score", "rrf_score", "vector_score", "keyword_score", "vector_rank", "keyword_rank", legs.alias("legs"))


def cap_of(top_k: int) -> int:
    return max(2 * top_k, 60)


def search_chunks(
    chunks: DataFrame,
    query: str,
    query_vector: list[float] | None,
    top_k: int = 10,
    min_score: float = 0.08,
    mode: str = "hybrid",
    alpha: float | None = None,
    rrf_k: float = 60.0,
    allowed: Column | DataFrame | None = None,
) -> DataFrame:
    """Search chunks (id, doc_id, content, embedding, ...): ranked hit ids."""
    cap = cap_of(top_k)
    v = vector_search(chunks, query_vector, cap, min_score, allowed=allowed) if mode != "keyword" and query_vector is not None else None
    k = keyword_search(chunks, query, cap, allowed=allowed) if mode != "vector" else None
    return fuse(v, k, top_k, min_score, alpha, rrf_k)


def hydrate(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with their chunk and document; rows that have vanished drop out."""
    c = chunks.select("id", "doc_id", F.col("idx").alias("chunk_index"), "content", "token_count")
    d = documents.select(F.col("id").alias("doc_id"), F.col("title").alias("doc_title"), "source")
    # hits are at most top_k rows, so they are the side to broadcast, twice
    return F.broadcast(F.broadcast(hits).join(c, "id")).join(d, "doc_id")


def context_block(hits: DataFrame, header: str = "") -> DataFrame:
    """One row: the hits as text, in order of their rank, and their tokens."""
    line = F.format_string("--- [%s#%d] (%s) ---\n%s", F.col("doc_title"), F.col("chunk_index"), F.format_number("score", 3), F.col("content"))
    rows = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    text = F.concat(F.lit(header), F.array_join(F.transform(rows, lambda r: r["line"]), "\n\n"))
    return hits.agg(text.alias("context"), F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("total_tokens"))
