"""The jobs: two runs over growing input, runs again, and odd rows."""

import logging
from collections import Counter

import pytest
from plain_chunker import chunk_text
from pyspark.sql import functions as F

from jobs import corpus_index, memory_upkeep
from jobs.common import existing, settings
from recollect.operators import keyword_index as ki
from recollect.operators.search import keyword_scores

DOCS = "doc_id long, text string, lang string, source string, n_chars long, content_hash string, batch int"


def put(spark, rows, path):
    spark.createDataFrame([(i, t, "en", s, 1, "x", 9) for i, t, s in rows], DOCS).coalesce(1).write.mode("append").parquet(path)


def said(n, k=400):
    return " ".join(f"w{(n * 7 + i) % 90}." if i % 11 == 0 else f"word{(n + i) % 53}" for i in range(k))


FIRST = [(1, said(1), "a"), (2, said(2), None), (3, said(1), "b"), (None, said(1), "c"), (4, "  ", "a"), (5, None, "a"), (6, "short one", "a"), (None, "no id", "d")]
SECOND = [(0, said(1), "a"), (7, said(3), "a"), (7, said(4), "e"), (8, "short one", "a")]


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture()
def at(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / "corpus"), str(tmp_path / "checkpoint")


def test_corpus_takes_only_what_is_new(spark, at, caplog):
    caplog.set_level(logging.INFO, "recollect.jobs")
    docs, out, checkpoint = at
    put(spark, FIRST, docs)
    corpus_index.run(spark, docs, out, checkpoint)
    one = rows_of(corpus_index.read(spark, out))
    want = {(1, "a"): said(1), (2, None): said(2), (6, "a"): "short one", (None, "d"): "no id"}
    texts = lambda rows: {(r[0], r[1], r[2]): r[3] for r in rows}
    assert texts(one) == {(i, s, n): c for (i, s), t in want.items() for n, c, _ in chunk_text(t)}
    corpus_index.run(spark, docs, out, checkpoint)  # nothing new
    assert rows_of(corpus_index.read(spark, out)) == one
    put(spark, SECOND, docs)
    corpus_index.run(spark, docs, out, checkpoint)
    two = rows_of(corpus_index.read(spark, out))
    fresh = {(7, "a"): said(3), (7, "e"): said(4)}
    assert texts(two) == texts(one) | {(i, s, n): c for (i, s), t in fresh.items() for n, c, _ in chunk_text(t)}
    assert one - two == Counter()
    # the first batch's files were not written again
    held = existing(spark, f"{out}/chunks", corpus_index.CHUNKS)
    assert {r["batch"] for r in held.collect()} == {0, 1}
    assert "nothing new" in caplog.text and "wrote" in caplog.text
    # and the index finds what a scan of the chunks does
    got = {r["id"]: round(r["bm25"], 9) for r in ki.indexed_scores(ki.read(spark, f"{out}/keywords"), "word12 w5").collect()}
    assert got and got == {r["id"]: round(r["bm25"], 9) for r in keyword_scores(held, "word12 w5").collect()}


def test_a_batch_done_again_leaves_the_same(spark, at):
    docs, out, checkpoint = at
    put(spark, FIRST, docs)
    corpus_index.run(spark, docs, out, checkpoint)
    put(spark, SECOND, docs)
    corpus_index.run(spark, docs, out, checkpoint)
    before = rows_of(corpus_index.read(spark, out))
    # as after a failure: the second batch once more, in full
    again = spark.createDataFrame([(i, t, "en", s, 1, "x", 9) for i, t, s in SECOND], DOCS)
    corpus_index.take(spark, again, 1, out)
    assert rows_of(corpus_index.read(spark, out)) == before


def test_corpus_of_one_file_and_of_none(spark, at):
    docs, out, checkpoint = at
    put(spark, [], docs)
    corpus_index.run(spark, docs, out, checkpoint)
    assert corpus_index.read(spark, out).count() == 0
    put(spark, [(1, "one text", "a")], docs + "-one")
    files = spark.read.parquet(docs + "-one").inputFiles()
    corpus_index.run(spark, files[0], out + "-one", checkpoint + "-one")
    assert [r["text"] for r in corpus_index.read(spark, out + "-one").collect()] == ["one text"]


TURNS = "conv_id long, turn long, role string, text string, type string"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, id string"


def test_memory_upkeep(spark, tmp_path):
    base = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew strong coffee " * 3
    turns = [(1, 0, "user", base, "q"), (2, 0, "assistant", base, "q"), (3, 0, "user", base + " again", "q"), (4, 0, "system", "always answer in short sentences", "q"),
             (4, 1, "other", "left alone", "q"), (5, 0, "user", None, "q"), (None, 0, "user", "x", "q"), (6, 0, "user", "faded and idle", "q"), (4, 1, "other", "left alone", "q")]
    events = [(i, f"2024-01-{d:02} 00:00:00", u, "view", v, "q") for i, (d, u, v) in enumerate([(3, 2, 400.0)] * 6 + [(5, 3, 100.0), (2, None, 1.0), (9, 9, 5.0)])]
    c = spark.createDataFrame(turns, TURNS)
    e = spark.createDataFrame(events, EVENTS.replace("timestamp_ntz", "string")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    paths = [str(tmp_path / n) for n in ("turns", "events", "out")]
    c.write.parquet(paths[0])
    e.write.parquet(paths[1])
    told = memory_upkeep.run(spark, *paths, now="2024-02-01")
    got = {r["id"]: (r["type"], r["importance"] and round(r["importance"], 6), r["reason"]) for r in memory_upkeep.read(spark, paths[2]).collect()}
    # the second conversation was used most: its copy stays, risen by its six recalls
    assert got == {
        200000: ("insight", 0.9, None),
        100000: (None, None, "duplicate"),
        300000: (None, None, "duplicate"),
        400000: (None, None, "pruned"),
        400001: (None, None, "pruned"),
        600000: (None, None, "pruned"),
    }
    assert told == {"kept": 1, "removed": 5}
    before = memory_upkeep.read(spark, paths[2]).collect()
    assert memory_upkeep.run(spark, *paths, now="2024-02-01") == told
    assert sorted(map(str, memory_upkeep.read(spark, paths[2]).collect())) == sorted(map(str, before))
    # what a later run no longer writes does not stay behind
    memory_upkeep.run(spark, *paths, now="2024-02-01", min_importance=0.0)
    left = {r["id"]: (r["type"], r["reason"]) for r in memory_upkeep.read(spark, paths[2]).collect()}
    assert left[400000] == ("instruction", None) and left[400001] == ("fact", None) and len(left) == 6


def test_settings(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('output = "/o"\nmax_chars = 900\n')
    assert settings("x", str(f), ["--max-chars", "50"]) == {"output": "/o", "max_chars": 50}


def test_corpus_counts_are_right_where_hashes_of_chunks_clash(spark, at, monkeypatch):
    docs, out, checkpoint = at
    put(spark, FIRST, docs)
    corpus_index.run(spark, docs, out, checkpoint)
    want = rows_of(corpus_index.read(spark, out))
    monkeypatch.setattr(corpus_index, "chunk_key", lambda: F.length("id").cast("long"))
    assert rows_of(corpus_index.read(spark, out)) == want and sum(want.values()) > 5


def test_a_texts_words_are_counted_without_an_aggregate(spark):
    """No task holds the words of all of its texts; counts are those of each spelling."""
    texts = [("a", "one two one-two Two two"), ("b", "x yy"), ("c", None), ("d", ""), ("e", "écho ÉCHO écho_ " + "long " * 300)]
    table = spark.createDataFrame(texts, "id string, content string")
    said = ki.postings_of(table)
    assert "Aggregate" not in said._jdf.queryExecution().executedPlan().toString()
    got = {(r["id"], r["word"]): r["n"] for r in said.collect()}
    assert got == {("a", "one"): 1, ("a", "two"): 3, ("a", "one-two"): 1, ("e", "écho"): 2, ("e", "écho_"): 1, ("e", "long"): 300}
    assert said.schema["n"].dataType.simpleString() == "bigint"
