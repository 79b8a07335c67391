"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (or smaller) neighbours on its least one.

    The least neighbour is an aggregate with map-side combining, joined back;
    a hub's rows can be split by the adaptive skew join.
    """
    out = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    if large:
        out = out.unionByName(out.select(F.col("y").alias("x"), F.col("x").alias("y")))
    least = out.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
    hung = out.join(least, "x")
    if large:
        new = hung.where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        new = hung.select(F.col("y").alias("u"), F.col("m").alias("v")).unionByName(hung.select(F.col("x").alias("u"), F.col("m").alias("v")))
    return new.where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node.

    The steps settle in a number of rounds that grows with the logarithm of a
    component's size, whatever its shape.  Each round's edges are a written table, so a lost executor costs a round
    at most; the driver sees two sums a round.  Self-links are ignored.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    now = written(edges.select(u.alias("u"), v.alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == before or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = tuple(seen)
        now = written(_star(_star(now, True), False), "edges")
