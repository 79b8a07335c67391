"""Indexes of a store's chunks, kept beside its segments.

A segment of rows never changes, so it is a batch of the index, laid down once.
An index belongs to the store's first segment; what was added since comes as
further batches, and of segments that were put together only the new one.  Once
chunks were changed or removed the index is one of the live rows, under the
whole list of segments, until the store is put together again.  A batch counts
as there when the table that is written last has it.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import keyword_index, search, vector_blocks
from recollect.plans.schema import TABLES
from recollect.plans.store import Store


def _name(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def _batches(store: Store) -> tuple[str, dict[int, DataFrame]]:
    """(name of the index, rows by batch) of the current version's chunks."""
    at = store.manifest()["tables"].get("chunks", [])
    if not all(isinstance(x, str) for x in at):
        return _name(str(at)), {0: store.read("chunks")}
    rows = {int(_name(x)[:8], 16): store.spark.read.schema(TABLES["chunks"]).parquet(x) for x in at}
    return _name(at[0] if at else ""), rows or {0: store.read("chunks")}


def _there(spark: SparkSession, path: str) -> set[int]:
    try:
        return {r["batch"] for r in spark.read.parquet(path).select("batch").distinct().collect()}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()


def _current(table: DataFrame, batches) -> DataFrame:
    return table.where(F.col("batch").isin(sorted(batches)))


def keywords_of(store: Store) -> keyword_index.KeywordIndex:
    """The keyword index of the store's chunks; what is missing is added."""
    name, batches = _batches(store)
    path = f"{store.path}/index/keywords-{name}"
    have = _there(store.spark, f"{path}/stats")
    for batch, rows in batches.items():
        if batch not in have:
            keyword_index.add(rows, path, batch)
    index = keyword_index.read(store.spark, path)
    return keyword_index.KeywordIndex(*(_current(t, batches) for t in (index.postings, index.grams, index.stats)))


def vectors_of(store: Store) -> vector_blocks.VectorBlocks:
    """The blocks of the chunks' vectors; centres are those of the first segment."""
    name, batches = _batches(store)
    path = f"{store.path}/index/vectors-{name}-{_name(str(store.manifest()['embed_model']))}"
    have = _there(store.spark, f"{path}/bounds")
    try:
        store.spark.read.parquet(f"{path}/centres")
    except AnalysisException:
        vector_blocks.fit(next(iter(batches.values())), path)
    for batch, rows in batches.items():
        if batch not in have:
            vector_blocks.add(rows, path, batch)
    index = vector_blocks.read(store.spark, path)
    return vector_blocks.VectorBlocks(_current(index.vectors, batches), index.centres, _current(index.bounds, batches))


def search_indexed(store: Store, query: str, query_vector: list[float] | None, top_k: int = 10, min_score: float = 0.08, mode: str = "hybrid", alpha: float | None = None, rrf_k: float = 60.0, allowed: DataFrame | None = None) -> DataFrame:
    """``search.search_chunks`` over the store's chunks, through their indexes.

    ``allowed``: (doc_id) of the documents that may be hits.
    """
    cap = search.cap_of(top_k)
    ids = None if allowed is None else store.read("chunks").select("id", "doc_id").join(allowed, "doc_id", "left_semi").select("id")
    v = vector_blocks.blocked_search(vectors_of(store), query_vector, cap, min_score, ids)[0] if mode != "keyword" and query_vector is not None else None
    k = keyword_index.indexed_search(keywords_of(store), query, cap, allowed=ids) if mode != "vector" else None
    return search.fuse(v, k, top_k, min_score, alpha, rrf_k)
