"""Operator 3, exact dedup: Golomb-coded fingerprint exchange.

Blocks of documents send their sorted, compressed 64-bit fingerprints to
owners and receive duplicate bitmaps; only the documents a bitmap marks
(suspects) send their text, for verification byte by byte.  A second scan
knows them by a Bloom filter, whose false hits send a text in vain and change
no result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import block_of, bytes_of, n_parts, written
from recollect.llm.golomb import exchange, owner_cuts

#: Bits of the suspects' filter at most (64 MB); 16 bits a suspect up to there.
FILTER_BITS = 1 << 29
#: Bits of the filter that one row holds on its way to the driver.
CHUNK_BITS = 1 << 19

_PRINT = pa.schema([("doc_id", pa.int64()), ("block", pa.int32()), ("sha", pa.binary())])
_MARKED = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("block", pa.int32()), ("nth", pa.int64()), ("suspect", pa.bool_())])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shas = [hashlib.sha256((b or b"").lower()).digest() for b in bytes_of(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("block"), pa.array(shas, pa.binary())], schema=_PRINT)


def _mark(owners: int):
    """Replies and documents of the same blocks: which documents are suspects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps: dict[int, dict[int, bytes]] = defaultdict(dict)
        rows: dict[int, list[tuple]] = defaultdict(list)
        for batch in batches:
            for block, owner, reply, doc_id, sha in zip(*(batch.column(n).to_pylist() for n in ("block", "owner", "reply", "doc_id", "sha"))):
                if sha is None:
                    bitmaps[block][owner] = reply
                else:
                    rows[block].append((doc_id, sha))
        for block in sorted(rows):
            docs = sorted(rows.pop(block), key=lambda r: (r[1], r[0] is not None, r[0] or 0))
            prints = np.frombuffer(b"".join(s[:8] for _, s in docs), np.uint64)
            keys, back = np.unique(prints, return_inverse=True)
            own, begin = owner_cuts(keys, owners)
            marks = np.concatenate([np.unpackbits(np.frombuffer(bitmaps[block][int(o)], np.uint8), count=z - a) for o, a, z in zip(own, begin, [*begin[1:], len(keys)])])
            nth, last = [], None
            for row in docs:
                nth.append(nth[-1] + 1 if row == last else 0)
                last = row
            ids, shas = zip(*docs)
            columns = [pa.array(ids, pa.int64()), pa.array(shas, pa.binary()), pa.array([block] * len(docs), pa.int32()), pa.array(nth, pa.int64()), pa.array(marks[back].astype(bool))]
            yield pa.RecordBatch.from_arrays(columns, schema=_MARKED)

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts
    as empty, and all empty texts are one group.  Of a group the largest id
    stays.  A null id is smaller than any other.  Rows that repeat an id are
    separate members of the group, and one of them stays.  Other columns are
    not read.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = n_parts(spark, docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # dealt evenly, whatever repeats; written once, so that every later stage sees the same blocks
    prints = written(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("block", block_of(parts, "row")).drop("row").mapInArrow(_prints, "doc_id long, block int, sha binary"), "prints")
    replies = exchange(prints.select("block", F.expr("substring(sha, 1, 8)").alias("fingerprints")), parts)
    none = lambda kind: F.lit(None).cast(kind)
    both = replies.select("block", "owner", "reply", none("long").alias("doc_id"), none("binary").alias("sha")).unionByName(
        prints.select("block", none("int").alias("owner"), none("binary").alias("reply"), "doc_id", "sha")
    )
    marked = written(both.repartition(parts, "block").mapInArrow(_mark(parts), "doc_id long, sha binary, block int, nth long, suspect boolean"), "marked")

    suspects = suspect_filter(marked.where("suspect").select("sha").distinct())
    hashed = rows.mapInArrow(_with_text(suspects), "sha binary, body binary, doc_id long")
    verified = hashed.groupBy("sha", "body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    clash = F.raise_error(F.lit("two different texts share a SHA-256"))
    classes = verified.groupBy("sha").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("texts"))
    classes = classes.select("sha", F.when(F.col("texts") > 1, clash.cast("long")).otherwise(F.col("keep_id")).alias("keep_id"), "group_size")
    # of the rows with the largest id the first one, by block and place in it; a member's fingerprint is always a suspect
    stays = marked.where("suspect").groupBy("sha").agg(F.max(F.struct("doc_id", -F.col("block"), -F.col("nth"))).alias("stays"))
    out = marked.join(classes.join(stays, "sha"), "sha", "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    first = F.col("stays").eqNullSafe(F.struct("doc_id", -F.col("block"), -F.col("nth")))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | first).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


_TEXT = pa.schema([("sha", pa.binary()), ("body", pa.binary()), ("doc_id", pa.int64())])


def _places(shas: list[bytes], bits: int) -> np.ndarray:
    """The filter's bits of each hash, three of them; ``bits``: a power of two."""
    return np.frombuffer(b"".join(s[8:32] for s in shas), "<u8").reshape(-1, 3) & np.uint64(bits - 1)


def _chunks(bits: int):
    """Bits of a chunk of the filter that occur in this task, or-ed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_places(batch.column("sha").to_pylist(), bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // CHUNK_BITS), pa.array(at % CHUNK_BITS, pa.int32())], ["chunk", "bit"])

    return run


def _packed(chunk_bits: int):
    """Sorted (chunk, bit) rows as one bitmap a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, flags = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(flags).tobytes()], pa.binary())], ["chunk", "bitmap"])

        for batch in batches:
            chunk, bit = batch.column("chunk").to_numpy(), batch.column("bit").to_numpy()
            for c in np.unique(chunk).tolist():
                if c != now:
                    if now is not None:
                        yield out()
                    now, flags = c, np.zeros(chunk_bits, np.uint8)
                flags[bit[chunk == c]] = 1
        if now is not None:
            yield out()

    return run


def suspect_filter(suspects: DataFrame) -> Broadcast:
    """A Bloom filter of distinct hashes ``sha``, at most ``FILTER_BITS`` whatever their number."""
    spark = suspects.sparkSession
    suspects = written(suspects, "suspects")
    bits = min(FILTER_BITS, 1 << max(16, (16 * suspects.count() - 1).bit_length()))
    size = min(bits, CHUNK_BITS)
    dealt = suspects.mapInArrow(_chunks(bits), "chunk long, bit int").repartition(n_parts(spark), "chunk").sortWithinPartitions("chunk")
    whole = np.zeros(bits // 8, np.uint8)
    for row in dealt.mapInArrow(_packed(size), "chunk long, bitmap binary").toLocalIterator():
        whole[row.chunk * size // 8 :][: size // 8] = np.frombuffer(row.bitmap, np.uint8)
    return spark.sparkContext.broadcast(whole.tobytes())


def _with_text(suspects: Broadcast):
    """Hash and lower-cased text of the rows whose hash passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(suspects.value, np.uint8)
        for batch in batches:
            low = [(b or b"").lower() for b in bytes_of(batch, "text")]
            shas = [hashlib.sha256(b).digest() for b in low]
            if not shas:
                continue
            at = _places(shas, 8 * len(bitmap))
            hit = ((bitmap[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)
            keep = np.flatnonzero(hit).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([shas[i] for i in keep], pa.binary()), pa.array([low[i] for i in keep], pa.binary()), batch.column("doc_id").filter(pa.array(hit))], schema=_TEXT)

    return run
