"""The keyword index against the scan of all texts."""

import random

import pytest
from pyspark.sql import functions as F

from recollect.operators import keyword_index as ki
from recollect.operators.search import keyword_scores


def texts(seed=4, n=120):
    rng = random.Random(seed)
    words = ["alpha", "alphabet", "Beta", "beta-max", "snake_case_name", "naïve", "日本語文", "aaaa", "x", "of", "the", "theory", "42", "2024", "co-op", "ÉTÉ", "o'neil"]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return [*out, None, "", "  ", "the " * 3000, "aaaaaaaaaa", "z" * 20_000 + "alpha", "no-such,thing.else"]


QUERIES = ["alpha", "the", "the the", "aaa", "beta-max alpha", "naïve", "日本語", "ÉTÉ", "case_", "2024 the", "lphab", "nothing-here", "x of", "", "thing else", "(the) !!alpha??"]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(f"d{i}", t, "extra") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "id string, content string, word string").repartition(3).cache()


@pytest.fixture(scope="module")
def index(spark, chunks, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "keywords")
    number = F.substring("id", 2, 9).cast("int")
    for batch in range(2):
        ki.add(chunks.where(number % 2 == batch), path, batch, buckets=16)
    ki.add(chunks.where(number % 2 == 1), path, 1, buckets=16)  # done again after a failure
    return ki.read(spark, path)


def scores(df):
    got = {r["id"]: round(r["bm25"], 9) for r in df.collect()}
    assert len(got) == df.count()
    return got


@pytest.mark.parametrize("query", QUERIES)
def test_index_equals_scan(chunks, index, query):
    assert scores(ki.indexed_scores(index, query, buckets=16)) == scores(keyword_scores(chunks, query))


def test_many_words_are_compared_instead(chunks, index):
    assert scores(ki.indexed_scores(index, "alpha the", buckets=16, most_words=1)) == scores(keyword_scores(chunks, "alpha the"))


def test_allowed_ids(chunks, index):
    some = chunks.where(F.col("id") < "d4").select("id")
    want = scores(keyword_scores(chunks, "alpha", allowed=F.col("id") < "d4"))
    assert want and scores(ki.indexed_scores(index, "alpha", allowed=some, buckets=16)) == want


def scan_metrics(df):
    """Files and folders that the scan of ``df`` opened, as Spark counted them."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    plan.execute().count()
    leaves = plan.collectLeaves()
    assert leaves.size() == 1
    m = leaves.apply(0).metrics()
    return {k: m.apply(k).value() for k in ("numFiles", "numPartitions")}


def test_search_opens_its_buckets_only(index):
    rows = ki._postings(index, "alphabet", 16, 100)
    metrics = scan_metrics(rows)
    whole = scan_metrics(index.postings)
    assert metrics["numPartitions"] <= 4 < whole["numPartitions"] and metrics["numFiles"] < whole["numFiles"] / 2


def test_empty_and_missing_texts(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], "id long, content string")
    ki.add(none, str(tmp_path / "i"))
    got = ki.read(spark, str(tmp_path / "i"), "long")
    assert ki.indexed_scores(got, "alpha").count() == 0
    assert got.stats.collect()[0]["texts"] == 0


def test_texts_are_shuffled_by_id_and_postings_are_not(spark):
    texts = spark.createDataFrame([(i, "some words some more words") for i in range(50)], "id long, content string")
    said = ki.postings_of(texts)
    plan = said._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange") == 1 and "hashpartitioning(id" in plan
    assert {tuple(r) for r in said.select("word", "id", "n").collect()} == {(w, i, n) for i in range(50) for w, n in (("some", 2), ("words", 2), ("more", 1))}
