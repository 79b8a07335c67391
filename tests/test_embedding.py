"""Batches of texts embedded together, and dot products with queries of few entries."""

import math
import random

import numpy as np

from recollect.functions import embedding
from recollect.operators import search

ODD = ["", "a", "ab", "a b", "the of ab", "İstanbul İ ß", "\ud800x", "日本 語 한국어 カタカナ", "😀 ab😀cd", "\0\0ab\0cd", "ab_cd 0 1 their theirs", "x" * 3000, "to\nbe  or not2be"]


def test_a_batch_counts_as_its_texts_do():
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("ab _1 the\n\0日😀İ.,") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    assert np.array_equal(embedding.all_bucket_counts(texts), [embedding.bucket_counts(t) for t in texts])


def test_features_are_hashed_by_the_batch(spark, monkeypatch):
    """Not one by one: few calls for each batch, however many words it has."""
    calls = []
    one = embedding.fnv1a
    monkeypatch.setattr(embedding, "fnv1a", lambda *a: calls.append(1) or one(*a))
    texts = [" ".join(f"word{i}x{j}" for j in range(50)) for i in range(100)]
    assert embedding.embed(texts[0]).any() and len(calls) < 10
    got = embedding.embed_all(texts)
    assert len(calls) < 20 and np.allclose((got * got).sum(axis=1), 1)


def test_null_texts_have_no_vector(spark):
    rows = spark.createDataFrame([(0, "some text"), (1, None), (2, "")], "id int, text string")
    got = {r.id: r.v for r in rows.select("id", embedding.embed_column(rows["text"]).alias("v")).collect()}
    assert got[1] is None and got[2] == [0.0] * embedding.DIM and got[0] == embedding.embed("some text").tolist()


def test_few_entries_make_the_same_sum(spark):
    rng = random.Random(3)
    query = [rng.choice((0.0, 0.0, 0.0, rng.uniform(-1, 1))) for _ in range(64)]
    some = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(50)]
    zero = query.index(0.0)
    odd = [math.nan, math.inf, -math.inf, None]
    rows = [(i, v) for i, v in enumerate(some)] + [(100 + i, some[0][:zero] + [x] + some[0][zero + 1 :]) for i, x in enumerate(odd)] + [(200, [1.0]), (201, [])]
    for kind in ("double", "float"):
        table = spark.createDataFrame(rows, f"id int, v array<{kind}>")
        few = {r.id: r.s for r in table.select("id", search._dot_literal(table["v"], query).alias("s")).collect()}
        most, search.SPARSE = search.SPARSE, -1
        try:
            plain = search._dot_literal(table["v"], query).alias("s")
        finally:
            search.SPARSE = most
        assert str(few) == str({r.id: r.s for r in table.select("id", plain).collect()})
        assert "get(" in search._dot_literal(table["v"], query)._jc.toString()
