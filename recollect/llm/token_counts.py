"""Operator 6, token counts by separator scan.

Flat token files hold the ids of documents end to end, each closed by an
end-of-document id, with no index.  The files are scanned in blocks cut
anywhere: numpy finds the separators of a block, and what a block needs from
those before it (how many documents ended, where the last one did) comes from
a prefix scan over the blocks' summaries, in two levels so that no file's
blocks meet in one task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from recollect.llm.common import bytes_of, in_slices, written
from recollect.llm.packing import Tokens

END_ID = 50256
BLOCK_BYTES = 1 << 20
#: Bytes of a long flat file that a task reads.
TASK_BYTES = 64 << 20
#: Blocks that one window partition of the prefix scan takes at most.
SUPER_BLOCKS = 4096

_FLAT = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("first_ordinal", pa.int64())])
FLAT_DDL = "file long, block long, payload binary, doc_ids array<long>, first_ordinal long"


def width_of(vocabulary: str, end_id: int = END_ID) -> int:
    """Bytes of an id: 2 where all ids of the vocabulary fit, else 4."""
    return 2 if max(Tokens(vocabulary, spelled=True).size, end_id + 1) <= 1 << 16 else 4


def _write_flat(vocabulary: str, end_id: int, block_bytes: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, last = Tokens(vocabulary, spelled=True), np.array([end_id], f"<u{width}").tobytes()
        file = TaskContext.get().partitionId()
        if max(tokens.size, end_id + 1) > 1 << 8 * width:
            raise ValueError(f"the vocabulary's {tokens.size} ids do not fit {width} bytes")

        def rows():
            held, block, ordinal = bytearray(), 0, 0
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                texts = [(b or b"").decode("utf-8", "replace") for b in bytes_of(batch, "text")]
                for got in tokens.of(texts):
                    held += np.frombuffer(got, "<u4").astype(f"<u{width}").tobytes() + last
                    while len(held) >= block_bytes:
                        yield file, block, bytes(held[:block_bytes]), None, None
                        del held[:block_bytes]
                        block += 1
                yield file, None, None, ids, ordinal
                ordinal += len(ids)
            if held:
                yield file, block, bytes(held), None, None

        yield from in_slices(rows(), _FLAT, most=16)

    return run


def flat_token_blocks(docs: DataFrame, vocabulary: str, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES, width: int = 2) -> tuple[DataFrame, DataFrame]:
    """Flat token files of documents, ``width`` bytes an id, as a table of raw blocks.

    Returns (blocks: file, block, payload) and (order: file, ordinal, doc_id),
    the order in which documents were laid down.  Both come from one written
    table, so a rerun of later stages sees the same files.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    flat = written(rows.mapInArrow(_write_flat(vocabulary, end_id, block_bytes, width), FLAT_DDL), "flat")
    order = flat.where(F.col("doc_ids").isNotNull()).select("file", "first_ordinal", F.posexplode("doc_ids").alias("nth", "doc_id"))
    return flat.where(F.col("payload").isNotNull()).select("file", "block", "payload"), order.select("file", (F.col("first_ordinal") + F.col("nth")).alias("ordinal"), "doc_id")


class Blocks(InputPartition):
    def __init__(self, path: str, first: int, end: int) -> None:
        self.path, self.first, self.end = path, first, end


class FlatFileReader(DataSourceReader):
    """Blocks of files, dealt to tasks by ranges of bytes."""

    def __init__(self, options) -> None:
        self.files, self.block = json.loads(options["files"]), int(options["block_bytes"])

    def partitions(self) -> list[Blocks]:
        step = max(1, TASK_BYTES // self.block)
        return [Blocks(path, b, min(-(-size // self.block), b + step)) for path, size in self.files for b in range(0, -(-size // self.block), step)]

    def read(self, partition: Blocks) -> Iterator[tuple[str, int, bytes]]:
        system, path = pafs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", partition.path))
        with system.open_input_file(path) as f:
            f.seek(partition.first * self.block)
            for b in range(partition.first, partition.end):
                yield partition.path, b, f.read(self.block)


class FlatFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flat_tokens"

    def schema(self) -> str:
        return "path string, block long, payload binary"

    def reader(self, schema) -> FlatFileReader:
        return FlatFileReader(self.options)


def read_flat_files(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES, whole: int = 1 << 30, width: int = 2) -> DataFrame:
    """Blocks (file, block, payload) of raw token files at ``path``, of any length.

    Files of up to ``whole`` bytes are read as one and cut; longer ones by
    ranges of blocks, which are split across tasks.  A block is of whole ids:
    ``block_bytes``, less what is over ``width``.  A file that ends within an
    id is an error.  ``file`` is the path's hash.
    """
    block_bytes = max(width, block_bytes - block_bytes % width)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = [(s.getPath().toString(), s.getLen()) for s in at.getFileSystem(conf).globStatus(at) or () if s.isFile()]
    if broken := [name for name, size in found if size % width]:
        raise ValueError(f"no whole number of ids of {width} bytes: {', '.join(broken[:10])}")
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= whole).select(F.xxhash64("path").alias("file"), "content")
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest(F.length("content"), F.lit(1)) - 1) / block_bytes))).alias("block")
    out = files.select("file", "content", cuts).select("file", "block", F.expr(f"substring(content, cast(block * {block_bytes} + 1 as int), {block_bytes})").alias("payload"))
    if long := [x for x in found if x[1] > whole]:
        spark.dataSource.register(FlatFiles)
        ranged = spark.read.format("flat_tokens").option("files", json.dumps(long)).option("block_bytes", block_bytes).load()
        out = out.unionByName(ranged.select(F.xxhash64("path").alias("file"), "block", "payload"))
    return out


_SEEN = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("n_tokens", pa.int64()), ("separators", pa.list_(pa.int64()))])


def _scan(end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for b in bytes_of(batch, "payload"):
                ids = np.frombuffer(b or b"", f"<u{width}")
                sizes.append(len(ids))
                found.append(np.flatnonzero(ids == end_id))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], schema=_SEEN)

    return run


def separator_scan(blocks: DataFrame, end_id: int = END_ID, width: int = 2, tails: bool = True) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document in flat token files.

    ``blocks``: file, block (0, 1, ... in order), payload of whole ids of
    ``width`` bytes.  n_tokens leaves the separator out; documents may be
    empty (two separators in a row) and may span any number of blocks.  Ids
    after a file's last separator are a document of their own if ``tails``.
    A null payload is an empty block; no blocks give no rows.
    """
    seen = blocks.select(F.col("file").cast("long").alias("file"), F.col("block").cast("long").alias("block"), "payload")
    seen = written(seen.mapInArrow(_scan(end_id, width), "file long, block long, n_tokens long, separators array<long>"), "scan")
    part = seen.select("file", "block", "n_tokens", F.size("separators").cast("long").alias("n"), F.expr("try_element_at(separators, -1)").alias("last"))
    part = part.withColumn("super", F.floor(F.col("block") / SUPER_BLOCKS))
    before = W.partitionBy("file", "super").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    part = part.select("*", zero(F.sum("n_tokens").over(before)).alias("at"), zero(F.sum("n").over(before)).alias("done"))
    part = part.select("*", F.max(F.col("at") + F.col("last") + 1).over(before).alias("begun"))
    whole = part.groupBy("file", "super").agg(F.sum("n_tokens").alias("tokens"), F.sum("n").alias("ends"), F.max(F.col("at") + F.col("last") + 1).alias("last_end"))
    up = W.partitionBy("file").orderBy("super").rowsBetween(W.unboundedPreceding, -1)
    whole = whole.select("*", zero(F.sum("tokens").over(up)).alias("base_at"), zero(F.sum("ends").over(up)).alias("base_done"))
    whole = whole.select("file", "super", "base_at", "base_done", zero(F.max(F.col("base_at") + F.col("last_end")).over(up)).alias("base_begun"))
    carried = part.join(whole, ["file", "super"]).select(
        "file",
        "block",
        (F.col("base_at") + F.col("at")).alias("at"),
        (F.col("base_done") + F.col("done")).alias("done"),
        F.coalesce(F.col("base_at") + F.col("begun"), F.col("base_begun")).alias("begun"),
    )
    placed = seen.join(carried, ["file", "block"]).where(F.size("separators") > 0)
    ends = placed.select("file", "done", "at", "begun", "separators", F.posexplode("separators").alias("nth", "end"))
    start = F.when(F.col("nth") == 0, F.col("begun")).otherwise(F.col("at") + F.expr("separators[greatest(nth, 1) - 1]") + 1)
    out = ends.select("file", (F.col("done") + F.col("nth")).alias("ordinal"), start.alias("start"), (F.col("at") + F.col("end") - start).alias("n_tokens"))
    if tails:
        files = seen.groupBy("file").agg(F.sum("n_tokens").alias("total"))
        closed = out.groupBy("file").agg(F.max("ordinal").alias("top"), F.max(F.col("start") + F.col("n_tokens") + 1).alias("begun"))
        rest = files.join(closed, "file", "left").select("file", (zero(F.col("top") + 1)).alias("ordinal"), zero("begun").alias("start"), (F.col("total") - zero("begun")).alias("n_tokens"))
        out = out.unionByName(rest.where("n_tokens > 0"))
    return out


def document_token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens) of every row, by writing flat files and scanning them.

    A special token's name within a text counts as the characters it is
    spelled with.  A null or empty text has no tokens.  Null ids and repeated rows get rows
    of their own; other columns are not read; an empty table gives no rows.
    """
    width = width_of(vocabulary)
    blocks, order = flat_token_blocks(docs, vocabulary, width=width)
    return order.join(separator_scan(blocks, width=width, tails=False), ["file", "ordinal"]).select("doc_id", "n_tokens")
