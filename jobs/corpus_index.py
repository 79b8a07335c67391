"""Job: keep a deduplicated, chunked and keyword-indexed corpus up to date.

    python -m jobs.corpus_index --config jobs/corpus_index.toml

Files of documents (doc_id, text, source) that were added since the last run
are taken as a stream: a checkpoint holds which were read.  Of a batch, blank
texts drop out, of equal texts the first document by id stays, and texts that
an earlier batch brought are left out.  What is new is written below
``output``, in folders of the batch:

* ``documents/batch=/source=`` - the new documents;
* ``chunks/batch=`` - their chunks;
* ``keywords/{postings,grams,stats}/batch=`` - the chunks' keyword index.

Each table is written from the one before it as it lies on disk.  A batch that
broke off is done again by the next run, over its own folders, so the output
is the same as if nothing had happened.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import counted_write, existing, log, session, settings, small_splits
from recollect.functions.chunking import chunks
from recollect.functions.text import content_hash, trimmed
from recollect.operators import keyword_index
from recollect.operators.ingest import first_wins
from recollect.plans.scratch import tidy

DOCUMENTS = "id string, doc_id long, text string, content_hash string, batch long, source string"
CHUNKS = "id string, document string, doc_id long, idx int, content string, token_count int, batch long"


def new_documents(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(id, doc_id, source, text, content_hash) of the texts not in ``known``
    (content_hash), each once.  An id is the text's hash."""
    said = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    said = said.where(trimmed(F.coalesce("text", F.lit(""))) != "").withColumn("content_hash", content_hash(F.col("text")))
    one = first_wins(said, "content_hash", F.col("doc_id").isNull(), "doc_id", F.col("source").isNull(), "source")
    new = one.join(known.select("content_hash"), "content_hash", "left_anti")
    return new.withColumn("id", F.concat(F.lit("doc-"), F.substring("content_hash", 1, 32)))


def take(spark: SparkSession, rows: DataFrame, batch: int, output: str, max_chars: int = 900, overlap_chars: int = 120) -> None:
    """Bring one batch of documents into the corpus."""
    known = existing(spark, f"{output}/documents", DOCUMENTS).where(F.col("batch") < batch)
    new = new_documents(rows, known).withColumn("batch", F.lit(batch))
    counted_write(new.select("id", "doc_id", "text", "content_hash", "batch", "source"), f"{output}/documents", "batch", "source", mine=F.col("batch") == batch)

    del new
    tidy(spark)  # the texts that were shuffled

    mine = existing(spark, f"{output}/documents", DOCUMENTS).where(F.col("batch") == batch)
    cut = mine.select(F.col("id").alias("document"), "doc_id", F.inline(chunks(F.col("text"), max_chars, overlap_chars)))
    cut = cut.select(F.concat("document", F.lit("#"), "idx").alias("id"), "document", "doc_id", "idx", F.col("text").alias("content"), "token_count", F.lit(batch).alias("batch"))
    counted_write(cut, f"{output}/chunks", "batch", mine=F.col("batch") == batch, tokens=F.sum("token_count"))

    keyword_index.add(existing(spark, f"{output}/chunks", CHUNKS).where(F.col("batch") == batch), f"{output}/keywords", batch)
    tidy(spark)
    log.info("indexed batch %d below %s/keywords", batch, output)


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, max_chars: int = 900, overlap_chars: int = 120, max_batch_bytes: int = 0) -> None:
    """Take what ``documents`` has that is new, and return when all is written."""
    there = spark.read.parquet(documents)
    files = spark.readStream.schema(there.schema)
    if max_batch_bytes:
        files = files.option("maxBytesPerTrigger", max_batch_bytes)

    taken = []

    def batch(rows: DataFrame, number: int) -> None:
        taken.append(number)
        log.info("batch %d: read %d rows of %s", number, rows.count(), documents)
        with small_splits(rows.sparkSession):
            take(rows.sparkSession, rows, number, output, max_chars, overlap_chars)

    # a stream takes a folder or a pattern: a single file is a pattern of itself
    bare = lambda path: re.sub(r"^[\w+.-]+:/*", "/", path)
    single = [bare(f) for f in there.inputFiles()] == [bare(documents)]
    source = f"{documents[:-1]}[{documents[-1]}]" if single else documents
    stream = files.parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    log.info("%s: %s", documents, f"{len(taken)} batches" if taken else "nothing new")


def chunk_key() -> Column:
    return F.xxhash64("id")


def read(spark: SparkSession, output: str) -> DataFrame:
    """The whole output as one row a chunk: doc_id, source, idx, text,
    token_count, and of its index how many words there are and are said.

    Postings are counted by a hash of their chunk's id, unless two chunks have
    the same; texts are shuffled once, when all else about them is known."""
    documents = existing(spark, f"{output}/documents", DOCUMENTS).select(F.col("id").alias("document"), "source")
    held = existing(spark, f"{output}/chunks", CHUNKS)
    key = chunk_key()
    if not held.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        key = F.col("id")
    held = held.withColumn("key", key)
    postings = keyword_index.read(spark, f"{output}/keywords").postings
    words = postings.groupBy(key.alias("key")).agg(F.count("*").alias("n_words"), F.sum("n").alias("n_said"))
    about = held.select("key", "document").join(documents, "document").select("key", "source").join(words, "key", "left")
    rows = held.drop("document").join(about, "key")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select("doc_id", "source", "idx", F.col("content").alias("text"), "token_count", none("n_words"), none("n_said"))


def main(argv: list[str] | None = None) -> None:
    said = settings("Bring new documents into the corpus", "jobs/corpus_index.toml", argv)
    spark = session("corpus_index")
    try:
        run(spark, **said)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
