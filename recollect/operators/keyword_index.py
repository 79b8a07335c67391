"""Keyword search through an index: BM25 without reading a text.

A query token has letters, numbers, ``_`` and ``-`` only, so each of its places
in a text lies within one maximal run of those (a *word*).  Three tables say
what a scan of the texts would:

* ``postings`` - (bucket, word, id, size, n): how often a text holds a word;
* ``grams`` - (bucket, gram, word): the words that hold three characters in a row;
* ``stats`` - (texts, size): how many texts there are and how long they are.

A token's words are those that its grams share and that contain it; their
postings give the counts of the token.  Rows are dealt into buckets by a hash
of the gram or word, folders of their own on disk, so a search opens the
folders of its grams and words and no others.  More texts are another batch of
rows; texts no longer wanted are left out by ``allowed``, or by a new index.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.text import query_tokens
from recollect.operators.search import bm25

#: A run of token characters that can hold a token of three or more.
RUN = r"[\p{L}\p{N}_-]{3,}"
BUCKETS = 64
#: So many words are looked up by name; beyond them the postings' words are compared.
MOST_WORDS = 10_000

POSTINGS = "word string, id {id}, size int, n long, batch long, bucket int"
GRAMS = "gram string, word string, batch long, bucket int"
STATS = "texts long, size long, batch long"


@dataclass(frozen=True)
class KeywordIndex:
    postings: DataFrame
    grams: DataFrame
    stats: DataFrame


def bucket_of(c: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def text_size(low: Column) -> Column:
    """Grams of a text: what a document's length is to BM25."""
    return F.greatest(F.length(low) - 2, F.lit(0))


def grams_of(word: Column) -> Column:
    """Distinct runs of three characters of a word."""
    c = F.split(word, "")
    at = F.sequence(F.lit(0), F.size(c) - 3)
    return F.array_distinct(F.transform(at, lambda i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2))))


def _counted(words: Column) -> Column:
    """(word, n) of an array of words, by their runs once sorted."""
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def runs(w: Column) -> Column:
        begin = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        return once(begin, lambda b: F.transform(b, lambda i, k: F.struct(F.get(w, i).alias("word"), (F.coalesce(F.get(b, k + 1), F.size(w)) - i).cast("long").alias("n"))))

    return once(F.sort_array(words), lambda w: F.when(F.size(w) > 0, runs(w)))


def postings_of(chunks: DataFrame, id_col: str = "id", text_col: str = "content", buckets: int = BUCKETS) -> DataFrame:
    """(word, id, size, n, bucket) of these texts; null texts are none.

    The texts are shuffled by id, once; a text's words are then counted where
    they are, and no posting is shuffled.
    """
    low = F.lower(F.col(text_col))
    texts = chunks.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), low.alias("low"), text_size(low).cast("int").alias("size"))
    said = texts.repartition("id").select("id", "size", F.inline(_counted(F.regexp_extract_all("low", F.lit(RUN), F.lit(0)))))
    return said.select("word", "id", "size", "n", bucket_of(F.col("word"), buckets).alias("bucket"))


def gram_table(words: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(gram, word, bucket) of (word)."""
    held = words.select("word", F.explode(grams_of(F.col("word"))).alias("gram"))
    return held.select("gram", "word", bucket_of(F.col("gram"), buckets).alias("bucket"))


def text_stats(chunks: DataFrame, text_col: str = "content") -> DataFrame:
    """One row: texts that are not null, and their sizes' sum."""
    size = text_size(F.lower(F.col(text_col)))
    return chunks.agg(F.count(text_col).alias("texts"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("size"))


def _write(rows: DataFrame, path: str, order: str) -> None:
    """A folder a bucket, with a file of each task that has rows for it."""
    rows.sortWithinPartitions("bucket", order).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)


def add(chunks: DataFrame, path: str, batch: int = 0, id_col: str = "id", text_col: str = "content", buckets: int = BUCKETS) -> None:
    """Index more texts below ``path``.

    A batch has folders of its own: doing it again, as after a failure, leaves
    the same, and batches before it stay as they are.
    """
    spark = chunks.sparkSession
    at = lambda name: f"{path}/{name}/batch={batch}"
    said = postings_of(chunks, id_col, text_col, buckets)
    _write(said, at("postings"), "word")
    # the batch's own words, from what was written: texts are read once more for the sizes only
    words = spark.read.schema(said.schema).parquet(at("postings")).select("word").distinct()
    _write(gram_table(words, buckets), at("grams"), "gram")
    text_stats(chunks, text_col).write.mode("overwrite").parquet(at("stats"))


def read(spark: SparkSession, path: str, id_type: str = "string") -> KeywordIndex:
    """The index below ``path``, all of its batches."""
    one = lambda name, ddl: spark.read.schema(ddl).parquet(f"{path}/{name}")
    return KeywordIndex(one("postings", POSTINGS.format(id=id_type)), one("grams", GRAMS), one("stats", STATS))


def in_buckets(keys: list[str], buckets: int, spark: SparkSession) -> list[int]:
    """The buckets of keys, by the function that dealt the rows."""
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select(bucket_of(F.col("k"), buckets).alias("b"))
    return sorted({r["b"] for r in rows.collect()})


def covering_grams(token: str) -> list[str]:
    """Grams of a token that hold all of its characters between them."""
    at = [*range(0, len(token) - 2, 3), len(token) - 3]
    return sorted({token[i : i + 3] for i in at})


def words_with(index: KeywordIndex, token: str, buckets: int = BUCKETS) -> DataFrame:
    """(word) of the index that contain ``token``: those that have all of its
    grams, and hold them in its order."""
    grams = covering_grams(token)
    mine = index.grams.where(F.col("bucket").isin(in_buckets(grams, buckets, index.grams.sparkSession)) & F.col("gram").isin(grams))
    mine = mine.where(F.col("word").contains(token))
    return mine.select("word").distinct()


def _postings(index: KeywordIndex, token: str, buckets: int, most_words: int) -> DataFrame:
    """(id, size, n) of the texts that contain ``token``, a row a word."""
    rows = index.postings.where(F.col("word").contains(token))
    words = [r["word"] for r in words_with(index, token, buckets).limit(most_words + 1).collect()]
    if not words:
        rows = rows.limit(0)
    elif len(words) <= most_words:
        rows = rows.where(F.col("bucket").isin(in_buckets(words, buckets, rows.sparkSession)) & F.col("word").isin(words))
    times = F.regexp_count("word", F.lit(f"(?=\\Q{token}\\E)"))
    return rows.select("id", "size", (F.col("n") * times).alias("n"))


def indexed_scores(index: KeywordIndex, query: str, allowed: DataFrame | None = None, buckets: int = BUCKETS, most_words: int = MOST_WORDS) -> DataFrame:
    """(id, bm25) as ``search.keyword_scores`` has it, from the index alone.

    ``allowed``: (id) of the texts that may be hits; statistics are over all.
    A query with no token of three characters has no hits.
    """
    tokens = [t for t in query_tokens(query) if len(t) >= 3]
    empty = index.postings.select("id", F.lit(0.0).alias("bm25")).limit(0)
    if not tokens:
        return empty
    total = index.stats.agg(F.sum("texts").alias("n"), F.sum("size").alias("size")).first()
    if not total["n"]:
        return empty
    each = None
    for i, token in enumerate(dict.fromkeys(tokens)):
        one = _postings(index, token, buckets, most_words).withColumn("token", F.lit(i))
        each = one if each is None else each.unionByName(one)
    place = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
    held = each.groupBy("id", "size").agg(*(F.sum(F.when(F.col("token") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in place.values()))
    df = held.agg(*(F.count(F.when(F.col(f"n{i}") > 0, 1)).alias(f"df{i}") for i in place.values())).first()
    hits = held
    for i in place.values():
        hits = hits.where(F.col(f"n{i}") > 0)
    if allowed is not None:
        hits = hits.join(allowed.select("id"), "id", "left_semi")
    # a token said twice counts twice
    tf = [(F.col(f"n{place[t]}"), df[f"df{place[t]}"]) for t in tokens]
    return hits.select("id", bm25(tf, F.col("size"), total["n"], total["size"] / total["n"]).alias("bm25"))


def indexed_search(index: KeywordIndex, query: str, limit: int = 60, **kw) -> DataFrame:
    return indexed_scores(index, query, **kw).orderBy(F.desc("bm25"), "id").limit(limit)
