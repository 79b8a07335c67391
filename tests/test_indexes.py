"""Search through a store's indexes against the scan, while the store changes."""

import random

import pytest
from pyspark.sql import functions as F

from recollect.functions.embedding import LocalEmbedder
from recollect.operators import keyword_index, vector_blocks
from recollect.operators.search import search_chunks
from recollect.plans import indexes
from recollect.plans import store as store_module
from recollect.plans.store import Store

ROWS = "content string, title string, source string, content_type string, metadata string, scope string"
E = LocalEmbedder()
QUERIES = ("river stone", "quick brown", "stone-age river", "nothing at all")


def texts(spark, seed, n):
    rng = random.Random(seed)
    words = ["river", "stone", "stone-age", "quick", "brown", "fox", "tree", "house", "of", "riverbank"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(3, 30))) + f" {seed}x{i}.", f"t{seed}-{i}", f"s{i % 3}", None, None, None) for i in range(n)]
    return spark.createDataFrame(rows, ROWS)


def same_hits(store, allowed=None):
    chunks = store.read("chunks")
    for q in QUERIES:
        for mode in ("hybrid", "keyword", "vector"):
            got = indexes.search_indexed(store, q, E.query(q), 8, mode=mode, allowed=allowed).collect()
            want = search_chunks(chunks, q, E.query(q), 8, mode=mode, allowed=allowed).collect()
            assert [(r.id, round(r.score, 9), r.legs) for r in got] == [(r.id, round(r.score, 9), r.legs) for r in want], (q, mode)


def test_indexes_follow_the_store(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store", E)
    added = []
    for module in (keyword_index, vector_blocks):
        add = module.add
        monkeypatch.setattr(module, "add", lambda rows, path, batch, add=add: added.append((path, batch)) or add(rows, path, batch))
    same_hits(store)
    store.ingest(texts(spark, 1, 40), 1)
    same_hits(store)
    store.ingest(texts(spark, 2, 10), 2)
    added.clear()
    same_hits(store)
    assert len(added) == 2  # what was there was not laid down again
    some = store.read("documents").where("source = 's1'").select(F.col("id").alias("doc_id"))
    same_hits(store, some)
    # removed, and put together again
    gone = store.read("documents").limit(5).select(F.col("id"), F.col("id").alias("doc_id"))
    store.change(drop={"documents": gone, "chunks": gone})
    same_hits(store)
    monkeypatch.setattr(store_module, "MOST_SEGMENTS", 2)
    store.ingest(texts(spark, 3, 4), 3)
    same_hits(store)
    added.clear()
    same_hits(store)
    assert not added


def test_a_broken_batch_is_laid_down_again(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store", E)
    store.ingest(texts(spark, 4, 12), 1)

    def fails(*a):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(keyword_index, "text_stats", fails)
        with pytest.raises(OSError):
            indexes.keywords_of(store)
    same_hits(store)
