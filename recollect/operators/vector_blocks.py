"""Exact vector search that leaves out blocks of vectors that cannot win.

Vectors are laid down in blocks by the centre that points most nearly their
way.  Of each block the widest angle to its centre, the largest distance from
it, and the norms are kept.  No vector of a block scores more with a query than
these allow, so a search first reads the most promising blocks, which bounds
the k-th score from below, and then those whose bound reaches it - no others.
The result is that of a scan of all vectors, ties included.

Vectors that have no direction or another length than the centres lie in a
block of their own, which every search reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.text import dot
from recollect.operators.search import vector_search

#: Centres are fitted on so many vectors at most; all vectors are laid down.
SAMPLE = 20_000
#: Blocks of an index at most, and rows of one that are aimed at.
MOST_BLOCKS, BLOCK_ROWS = 1024, 50_000
#: The block that is always read.
ODD = -1
#: What rounding may take from a bound.
SLACK = 1e-9

VECTORS = "id {id}, embedding array<double>, batch long, block int"
CENTRES = "block int, centre array<double>"
BOUNDS = "block int, n long, angle double, reach double, most double, least double, batch long"


@dataclass(frozen=True)
class VectorBlocks:
    vectors: DataFrame
    centres: DataFrame
    bounds: DataFrame


def _norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def _usable(v: Column, dim: int) -> Column:
    """Whether a vector has the length of the centres, and a direction."""
    norm = _norm(v)
    return (F.size(v) == dim) & (norm > 0) & ~F.isnan(norm) & (norm < float("inf"))


def fit(vectors: DataFrame, path: str, blocks: int | None = None, id_col: str = "id", vec_col: str = "embedding") -> None:
    """Write the centres of an index: at most ``MOST_BLOCKS`` directions, by
    cosine k-means over a sample of ``SAMPLE`` vectors, chosen by their ids' hash.

    The commonest length of a vector is the index's.
    """
    have = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    common = have.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim, n = (common["dim"], common["count"]) if common else (0, 0)
    good = have.where(_usable(F.col("v"), dim))
    some = good.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(array_to_vector("v").alias("features"))
    k = min(MOST_BLOCKS, max(1, blocks or max(int(np.sqrt(n)) // 4, n // BLOCK_ROWS)))
    centres = []
    if not good.isEmpty():
        centres = KMeans(k=max(2, k), seed=7, maxIter=8, distanceMeasure="cosine").fit(some).clusterCenters() if k > 1 else [np.ones(dim)]
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    vectors.sparkSession.createDataFrame(rows, CENTRES).coalesce(1).write.mode("errorifexists").parquet(f"{path}/centres")


def _nearest(v: Column, centres: np.ndarray) -> Column:
    """The block whose centre has the largest cosine with each vector."""

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            rows = np.stack(s.to_numpy()) if len(s) else np.empty((0, centres.shape[1]))
            yield pd.Series((rows @ centres.T).argmax(axis=1).astype(np.int32))

    return run(v)


def add(vectors: DataFrame, path: str, batch: int = 0, id_col: str = "id", vec_col: str = "embedding") -> None:
    """Lay down more vectors by the centres at ``path``; null ones are none.

    A batch has folders of its own, so doing it again leaves the same.
    """
    spark = vectors.sparkSession
    held = [r["centre"] for r in spark.read.schema(CENTRES).parquet(f"{path}/centres").orderBy("block").collect()]  # MOST_BLOCKS at most
    rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("embedding"))
    at = f"{path}/vectors/batch={batch}"
    if held:
        centres = np.array(held)
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
        usable = _usable(F.col("embedding"), centres.shape[1])
        laid = rows.where(F.coalesce(usable, F.lit(False))).withColumn("block", _nearest(F.col("embedding"), centres))
        laid = laid.unionByName(rows.where(~F.coalesce(usable, F.lit(False))).withColumn("block", F.lit(ODD)))
    else:
        laid = rows.withColumn("block", F.lit(ODD))
    # rebalanced: one file for a small block, several for a hot one
    laid.hint("rebalance", "block").sortWithinPartitions("block").write.mode("overwrite").partitionBy("block").parquet(at)
    written = spark.read.schema(f"id {dict(rows.dtypes)['id']}, embedding array<double>, block int").parquet(at)
    by = written.join(F.broadcast(spark.read.schema(CENTRES).parquet(f"{path}/centres")), "block", "left")
    norm, c_norm = _norm(F.col("embedding")), _norm(F.col("centre"))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("embedding"), F.col("centre")) / (norm * c_norm)))
    apart = F.zip_with("embedding", "centre", lambda x, y: x - y)
    odd = F.col("block") == ODD
    some = by.select("block", F.when(~odd, F.acos(cosine)).alias("angle"), F.when(~odd, _norm(apart)).alias("reach"), F.when(~odd, norm).alias("norm"))
    bounds = some.groupBy("block").agg(F.count("*").alias("n"), F.max("angle").alias("angle"), F.max("reach").alias("reach"), F.max("norm").alias("most"), F.min("norm").alias("least"))
    bounds.write.mode("overwrite").parquet(f"{path}/bounds/batch={batch}")


def read(spark: SparkSession, path: str, id_type: str = "string") -> VectorBlocks:
    one = lambda name, ddl: spark.read.schema(ddl).parquet(f"{path}/{name}")
    return VectorBlocks(one("vectors", VECTORS.format(id=id_type)), one("centres", CENTRES), one("bounds", BOUNDS))


def block_bounds(index: VectorBlocks, query: list[float]) -> list[tuple[int, int, int, float]]:
    """(batch, block, rows, bound) of every block, best first: no vector in it
    has a larger dot product with the query."""
    q = np.array(query, float)
    length = float(np.linalg.norm(q))
    centres = {r["block"]: np.array(r["centre"]) for r in index.centres.collect()}
    out = []
    for r in index.bounds.collect():  # numbers of each block of each batch
        bound = float("inf")
        c = centres.get(r["block"])
        if c is not None and len(c) != len(q):
            bound = 0.0  # vectors of another length than the query score nothing
        elif c is not None and length > 0:
            cosine = float(np.clip(c @ q / (np.linalg.norm(c) * length), -1, 1))
            nearest = np.cos(max(0.0, np.arccos(cosine) - r["angle"] - SLACK))
            by_angle = length * nearest * (r["most"] if nearest > 0 else r["least"])
            by_reach = float(c @ q) + length * r["reach"]
            bound = min(by_angle, by_reach) + SLACK * (1 + length * r["most"])
        elif c is not None:
            bound = SLACK
        out.append((r["batch"], r["block"], r["n"], bound))
    return sorted(out, key=lambda b: (-b[3], b[0], b[1]))


def _within(blocks: list[tuple]) -> Column:
    """Rows of these blocks, by the folders that they lie in."""
    by: dict[int, list[int]] = {}
    for batch, block, *_ in blocks:
        by.setdefault(batch, []).append(block)
    out = F.lit(False)
    for batch, some in by.items():
        out = out | ((F.col("batch") == batch) & F.col("block").isin(some))
    return out


def blocked_search(index: VectorBlocks, query: list[float], top_k: int = 10, min_score: float = 0.08, allowed: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """(hits as ``search.vector_search`` has them, what was read).

    ``allowed``: (id) of the vectors that may be hits.  The report counts all
    blocks, those read first, and those read in the end.
    """
    rows = index.vectors if allowed is None else index.vectors.join(allowed.select("id"), "id", "left_semi")
    blocks = [b for b in block_bounds(index, query) if b[3] >= min_score or b[1] == ODD]
    first, held = [], 0
    for b in blocks:
        if held >= top_k and b[1] != ODD:
            break
        first.append(b)
        held += b[2] if b[1] != ODD else 0
    floor = min_score
    if first and len(first) < len(blocks):
        best = vector_search(rows.where(_within(first)), query, top_k, min_score)
        seen = best.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        floor = seen["least"] if seen["n"] >= top_k else min_score
    wanted = [b for b in blocks if b[3] >= floor or b[1] == ODD]
    hits = vector_search(rows.where(_within(wanted)), query, top_k, min_score)
    return hits, {"blocks": index.bounds.count(), "read_first": len(first), "read": len(wanted), "rows_read": sum(b[2] for b in wanted)}

