"""Search by blocks against the scan of all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import vector_blocks as vb
from recollect.operators.search import vector_search

DIM = 12


def vectors(seed=6, n=1500):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(15, DIM))
    v = middles[rng.integers(15, size=n)] + rng.normal(0, 0.12, (n, DIM))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    rows += [(2000 + i, rows[5][1]) for i in range(40)]  # ties, decided by id
    rows += [(3000, [0.0] * DIM), (3001, [1.0]), (3002, []), (3003, None), (3004, [float("nan")] * DIM), (3005, [3.0 * x for x in rows[7][1]]), (3006, [-x for x in rows[5][1]])]
    return rows


ROWS = vectors()


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, 7) for r in ROWS], "id long, embedding array<double>, block int").repartition(4).cache()


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors") / "blocks")
    vb.fit(table, path, blocks=30)
    for batch in range(2):
        vb.add(table.where(F.col("id") % 2 == batch), path, batch)
    vb.add(table.where(F.col("id") % 2 == 1), path, 1)  # done again after a failure
    return vb.read(spark, path, "long")


def rows(df):
    return [(r["id"], round(r["score"], 9)) for r in df.collect()]


QUERIES = {"own": ROWS[5][1], "far": [-x for x in ROWS[9][1]], "long": [4.0 * x for x in ROWS[30][1]], "none": [0.0] * DIM, "short": [1.0, 2.0], "mixed": [1.0] + [-0.3] * (DIM - 1)}


@pytest.mark.parametrize("name", QUERIES)
def test_blocks_equal_scan(table, index, name):
    for k, floor in ((1, 0.08), (10, 0.08), (45, 0.5), (300, -1.0)):
        hits, report = vb.blocked_search(index, QUERIES[name], k, floor)
        assert rows(hits) == rows(vector_search(table, QUERIES[name], k, floor)), (k, floor)
        assert report["read"] <= report["blocks"]


def test_blocks_that_cannot_win_are_not_read(index):
    hits, report = vb.blocked_search(index, QUERIES["own"], 10)
    assert report["blocks"] > 30 and report["read"] <= report["blocks"] / 3
    read = {(r["batch"], r["block"]) for r in index.vectors.where(vb._within([b for b in vb.block_bounds(index, QUERIES["own"])][:3])).select("batch", "block").distinct().collect()}
    assert len(read) == 3


def test_bounds_hold(index):
    """No vector scores more than its block's bound."""
    q = QUERIES["mixed"]
    bound = {(b[0], b[1]): b[3] for b in vb.block_bounds(index, q)}
    for r in index.vectors.collect():
        if len(r["embedding"]) == DIM and r["block"] != vb.ODD:
            assert sum(x * y for x, y in zip(r["embedding"], q)) <= bound[r["batch"], r["block"]]


def test_allowed_ids(table, index):
    some = table.where(F.col("id") % 10 == 3).select("id")
    hits, _ = vb.blocked_search(index, QUERIES["own"], 20, 0.1, some)
    assert rows(hits) == rows(vector_search(table, QUERIES["own"], 20, 0.1, allowed=F.col("id") % 10 == 3))


def test_no_vectors(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], "id long, embedding array<double>")
    vb.fit(none, str(tmp_path / "v"))
    vb.add(none, str(tmp_path / "v"))
    hits, report = vb.blocked_search(vb.read(spark, str(tmp_path / "v"), "long"), [1.0], 5)
    assert hits.count() == 0 and report["read"] == 0
