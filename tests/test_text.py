"""Text, chunk and embedding functions against plain Python."""

import math
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import plain_chunker
from recollect.functions import chunking, embedding, text
from recollect.plans import queries

SAMPLES = [
    "",
    " ",
    "plain words here",
    "日本語のテキスト。これは長い文です！ 한국어 텍스트",
    "emoji 😀😀 and text 𝒜",
    "﻿bom first",
    "Version 24.0.1 works. e.g. this! Really? Yes.",
    "a\n\nb\r\n\r\nc",
    "x" * 3000,
]


def units(s):
    return len(s.encode("utf-16-le")) // 2


def test_token_estimate(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    for r in df.select("i", "s", text.estimate_tokens(F.col("s")).alias("n"), text.units(F.col("s")).alias("u")).collect():
        cjk = len(re.findall("[一-鿿぀-ヿ가-힯]", r.s))
        assert r.u == units(r.s)
        assert r.n == math.ceil(cjk * 1.5) + math.ceil((units(r.s) - cjk) / 4)


def test_fnv_and_hash(spark):
    r = spark.createDataFrame([("foobar", "scope")], "a string, b string").select(text.fnv1a(F.col("a")).alias("h"), text.content_hash(F.col("a"), F.col("b")).alias("s")).first()
    import hashlib

    assert r.h == 0xBF9CF968 == embedding.fnv1a("foobar")
    assert r.s == hashlib.sha256(b"scope\0foobar").hexdigest()


def test_jaccard_and_clamps(spark):
    df = spark.createDataFrame([("The cat, the hat", "cat hat the x", float("nan"))], "a string, b string, c double")
    r = df.select(text.jaccard(text.token_set(F.col("a")), text.token_set(F.col("b"))).alias("j"), text.clamp_importance(F.col("c")).alias("i"), text.jaccard(text.token_set(F.col("a")), text.token_set(F.lit("")))).first()
    assert r.j == 1.0 and r.i == 0.5 and r[2] == 0.0


def condense(t, least=120, ratio=0.35):
    t = t.strip()
    cut = [s.strip() for s in re.split(r"(?<=[.!?…:])\s+|\n+", t) if s.strip()]
    if len(t) <= least or len(cut) <= 1:
        return t
    stop = set(text.CONDENSE_STOPWORDS)

    def score(i, s):
        w = re.findall(r"[^\W_]+", s.lower())
        return len([x for x in w if len(x) >= 4 and x not in stop and not x.isdecimal()]) + min(len(w), 8) / 10 + (i == 0)

    goal, kept, chosen = max(math.floor(len(t) * ratio + 0.5), min(least, len(t))), 0, []
    for i, s in sorted(enumerate(cut), key=lambda x: (-score(*x), x[0])):
        if kept >= goal:
            break
        chosen.append(i)
        kept += len(s)
    return " ".join(cut[i] for i in sorted(chosen))


def test_condense(spark):
    rng = random.Random(2)
    words = ["system", "database", "of", "the", "2024", "ok", "kita", "important", "migrasi", "x"]
    rows = ["  ", "short one."]
    for _ in range(60):
        rows.append("\n".join(". ".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 6))) + "!" for _ in range(3)))
    df = spark.createDataFrame([(r,) for r in rows], "t string").select("t", text.condense(F.col("t")).alias("c"))
    for r in df.collect():
        assert r.c == condense(r.t)


def test_query_tokens():
    assert text.query_tokens('Foo-bar "BAZ" (qux_1) é!') == ["foo-bar", "baz", "qux_1", "é"]
    assert len(text.query_tokens(" ".join("abcdefghijkl"))) == 10
    assert text.query_tokens("a a") == ["a", "a"]


# Chunks


def test_chunk_examples():
    assert plain_chunker.chunk_text("") == [] == plain_chunker.chunk_text(" \n ")
    assert [c[1] for c in plain_chunker.chunk_text("See schema.prisma now. pip 24.0.1 e.g. this")] == ["See schema. prisma now. pip 24.0.1 e. g. this"]
    fenced = "intro\n\n```\na = 1\n\nb = 2\n```\n\nend"
    assert [c[1] for c in plain_chunker.chunk_text(fenced)] == ["intro\n```\na = 1\n\nb = 2\n```\nend"]
    for bad in ({"max_chars": 0}, {"max_chars": float("nan")}, {"overlap_chars": -1}, {"overlap_chars": float("nan")}):
        with pytest.raises(ValueError):
            plain_chunker.chunk_text("x", **bad)


def test_chunk_overlap_zero_repeats_nothing():
    t = " ".join(f"Sentence number {i} is here." for i in range(200))
    got = plain_chunker.chunk_text(t, 100, 0)
    assert " ".join(c[1] for c in got) == t


def test_chunk_overlap_begins_at_words():
    t = "\n\n".join(f"Word{i} follows nicely{i}." for i in range(200))
    got = plain_chunker.chunk_text(t, 120, 40)
    for (_, a, _), (_, b, _) in zip(got, got[1:]):
        assert b.split()[0] in a.split()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab. \n!?,1`~\"')語😀ñ")), max_size=600), st.integers(5, 90), st.integers(0, 60))
def test_chunk_bounds(t, most, overlap):
    got = plain_chunker.chunk_text(t, most, overlap)
    assert [c[0] for c in got] == list(range(len(got)))
    assert all(0 < units(c[1].encode("utf-16-le", "replace").decode("utf-16-le")) <= most for c in got)
    squeezed = lambda s: re.sub(r"\s", "", s)
    if overlap == 0 and "😀" not in t:
        assert squeezed("".join(c[1] for c in got)) == squeezed(t)


def test_chunk_column(spark):
    long = "One sentence here. " * 200
    df = spark.createDataFrame([(1, long), (2, None), (3, "")], "i int, t string")
    got = df.select("i", F.inline(chunking.chunks(F.col("t")))).collect()
    assert [(r.idx, r.text, r.token_count) for r in sorted(got)] == plain_chunker.chunk_text(long)


def odd_texts(seed=1, n=300):
    rng = random.Random(seed)
    parts = list("ab. \n!?,1`~\"')語😀ñ") + ["\n\n", "```\n", "~~~", "3.14", ". ", "\r\n", "\u3000", "_x", "\ufeff", "word ", "\U0001d4b3", "\x0b", "(x!)", "para\n\n"]
    out = [None, "", " \n", "x" * 2000, "😀" * 700, "a" * 599 + "😀" * 400, "```\na\n\nb", "intro\n\n```\na = 1\n\nb = 2\n```\n\nend", "See schema.prisma now. pip 24.0.1 e.g. this"]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 600))) for _ in range(n)]


@pytest.mark.parametrize("most,overlap", [(900, 120), (5, 2), (17, 8), (60, 0), (90, 45), (1, 0)])
def test_chunk_columns_are_the_plain_machine(spark, most, overlap):
    """Fences, blank lines, decimals, closers, astral characters that a cut splits."""
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    got = {r.i: r.c and [tuple(x) for x in r.c] for r in df.select("i", chunking.chunks(F.col("t"), most, overlap).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else plain_chunker.chunk_text(t, most, overlap)), t


def test_chunks_need_no_python(spark):
    df = spark.createDataFrame([(1, "x")], "i int, t string")
    plan = df.select(F.inline(chunking.chunks(F.col("t"))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for bad in ({"max_chars": 0}, {"max_chars": float("nan")}, {"overlap_chars": -1}, {"overlap_chars": float("nan")}):
        with pytest.raises(ValueError):
            chunking.chunks(F.col("t"), **bad)


def test_chunks_are_those_of_sql():
    """Texts of one block each, as SQL cuts them: long ones, long runs without
    a break, decimals, closers, lines and letters of many scripts."""
    rng = random.Random(9)
    words = ["ab", "word", "3.14", "1.2.3", 'he said "no."', "(end!)", "漢字。", "ñandú,", "x" * 70, "z" * 1300, "line\nbreak", "stop.", "why?", "\r\nnext"]
    texts = [" ".join(rng.choices(words, [9, 9, 2, 1, 2, 2, 2, 4, 1, 0.05, 2, 4, 2, 1], k=rng.choice([1, 5, 60, 400]))) for _ in range(150)] + ["", " \n", "  lead", "trail \n "]
    rows = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841
    con = duckdb.connect()
    con.register("documents", rows)
    want = con.execute(f"WITH RECURSIVE {queries.chunks_sql()} SELECT doc_id, idx, text, token_count FROM chunked").fetchall()
    assert sorted(want) == [(i, *c) for i, t in enumerate(texts) for c in plain_chunker.chunk_text(t)]


# Embedder


def brute_features(t):
    low = t.lower()
    w = re.findall(r"[a-z0-9_]+", low)
    out = [x for x in w if len(x) > 1]
    out += [f"w2:{a}:{b}" for a, b in zip(w, w[1:]) if min(len(a), len(b)) > 1 and not {a, b} & embedding.PAIR_STOPWORDS]
    u = low.encode("utf-16-le")
    for n in (2, 3):
        out += [f"g{n}:" + u[2 * i : 2 * i + 2 * n].decode("utf-16-le", "surrogatepass") for i in range(len(u) // 2 - n + 1)]
    return out + [f"cjk:{c}" for c in low if re.match("[一-鿿぀-ヿ가-힯]", c)]


@pytest.mark.parametrize("t", [*SAMPLES, "The client server model of a CLIENT", "a b"])
def test_bucket_counts(t):
    want = np.zeros(1024, int)
    for f in brute_features(t):
        h = 2166136261
        for c in memoryview(f.encode("utf-16-le", "surrogatepass")).cast("H"):
            h = (h ^ c) * 16777619 % 2**32
        want[h % 1024] += 1
    assert (embedding.bucket_counts(t) == want).all()


def test_embed_is_unit_and_ordered(spark):
    a, b = embedding.embed("client server"), embedding.embed("server client")
    assert abs(np.linalg.norm(a) - 1) < 1e-12 and not np.allclose(a, b)
    assert not embedding.embed("").any()
    near = embedding.embed("the database migration plan") @ embedding.embed("plan of database migration")
    assert near > embedding.embed("the database migration plan") @ embedding.embed("a purple sky")
    r = spark.createDataFrame([("client server", "server")], "a string, b string").select(embedding.embed_column(F.col("a")).alias("x"), embedding.embed_column(F.col("b")).alias("y")).select("x", text.cosine(F.col("x"), F.col("y")).alias("c"), text.dot(F.col("x"), F.array(F.lit(1.0))).alias("d")).first()
    assert np.allclose(r.x, a) and abs(r.c - a @ embedding.embed("server")) < 1e-12 and r.d == 0
