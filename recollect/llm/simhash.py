"""Operator 5, SimHash near-dedup by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most three bits have a half that
differs in at most one.  Each half is indexed under its 32 one-wildcard
variants (one bit blanked); halves at most one bit apart share a variant, so
an equality join on variants meets every link, and the whole fingerprints are
then verified.  Only distinct fingerprints are indexed.  Each bucket hands on
a spanning forest of its links, never its pairs; a bucket above ``HOT``
members is dealt again under variants of the other half's quarters, after
which at most 18 free bits, so 262,144 fingerprints, can meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import bytes_of, n_parts, written
from recollect.llm.components import components

#: A bucket with more members is dealt again by a finer key.
HOT = 2048
_PRINT = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("deeper", pa.bool_()), ("wild", pa.int64())])
LINK_DDL = "a long, b long, deeper boolean, wild long"


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """Bitwise majority of the XXH64 (seed 42) of the lower-cased shingles."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    size = np.fromiter(map(len, w), np.int64, len(w)) + 1
    end = np.cumsum(size) - 1
    first = (end - size + 1)[: len(w) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:z], 42) for a, z in zip(first, end[words - 1 :].tolist())), "<u8", len(first))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(b, words) for b in bytes_of(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], schema=_PRINT)

    return run


def forest(fps: np.ndarray, free: np.ndarray | None = None, limit: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints.

    Index pairs (i, j).  ``free``: the bits in which members can differ at
    all; given for large sets, whose links are found by looking up every
    change of up to ``limit`` of those bits instead of comparing all.
    """
    n = len(fps)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    label = np.arange(n)
    edges_a, edges_b = [], []

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    def link(a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = root(i), root(j)
            if x != y:
                label[max(x, y)] = min(x, y)
                edges_a.append(i)
                edges_b.append(j)

    if free is not None and n > 4 * HOT:
        order = np.argsort(fps)
        ranked = fps[order]
        for size in range(1, limit + 1):
            for bits in combinations(free.tolist(), size):
                mask = np.bitwise_or.reduce(np.left_shift(np.uint64(1), np.array(bits, np.uint64)))
                at = np.minimum(np.searchsorted(ranked, fps ^ mask), n - 1)
                hit = np.flatnonzero((ranked[at] == fps ^ mask) & (fps < fps ^ mask))
                far = _apart(label, hit, order[at[hit]])
                link(hit[far], order[at[hit]][far])
    else:
        for i in range(0, n, 512):
            near = np.bitwise_count(fps[i : i + 512, None] ^ fps[None, i:]) <= limit
            a, b = np.nonzero(near)
            a, b = a + i, b + i
            up = a < b
            a, b = a[up], b[up]
            for k in range(0, len(a), 1 << 16):
                far = _apart(label, a[k : k + (1 << 16)], b[k : k + (1 << 16)])
                link(a[k : k + (1 << 16)][far], b[k : k + (1 << 16)][far])
    return np.array(edges_a, np.int64), np.array(edges_b, np.int64)


def _apart(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Links whose ends aren't known to be in one tree; compresses all paths."""
    while True:
        up = label[label]
        if np.array_equal(up, label):
            break
        label[:] = up
    return np.flatnonzero(label[a] != label[b])


def _buckets(level: int):
    """Sorted (key, fp) rows: links of each bucket, or its members again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, deeper, wild):
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(n, deeper)), pa.array(np.full(n, wild, np.int64))], schema=_LINK)

        def close(wild: int, held: list[np.ndarray]):
            fps = np.unique(np.concatenate(held))
            if len(fps) < 2:
                return
            free = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(fps ^ fps[0]).reshape(1).view(np.uint8), bitorder="little"))
            a, b = forest(fps, free if level else None)
            if len(a):
                yield out(fps[a], fps[b], False, 0)

        key, held, size = None, [], 0
        for batch in batches:
            keys, fps = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            if not len(keys):
                continue
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
            # single rows within the batch have no partner, but for the ends
            many = np.flatnonzero((end - begin > 1) | (begin == 0) | (end == len(keys)))
            for i in many.tolist():
                x, z = int(begin[i]), int(end[i])
                if keys[x] != key:
                    if key is not None and held:
                        yield from close(key, held)
                    key, held, size = keys[x], [], 0
                held.append(fps[x:z])
                size += z - x
                if level == 0 and size > HOT:
                    # members so far, then each later part, go on by finer keys
                    part = np.concatenate(held)
                    yield out(part, part, True, int(key))
                    held = []
        if key is not None and held:
            yield from close(key, held)

    return run


def _variants(fps: DataFrame) -> DataFrame:
    """(key, fp): for each half and bit, the half with that bit blanked."""
    bit = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")
    v = fps.select("fp", bit)
    half = F.when(F.col("bit") < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    return v.select((F.shiftleft(F.col("bit").cast("long"), 32) + half.bitwiseAND(F.expr("~shiftleft(1L, bit % 32)"))).alias("key"), "fp")


def _finer(deeper: DataFrame) -> DataFrame:
    """Members of hot buckets under variants of the other half's quarters."""
    v = deeper.select("fp", "wild", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit"))
    other = F.when(F.shiftrightunsigned("wild", 32) < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    quarter = F.when(F.col("bit") < 16, other.bitwiseAND(F.lit(0xFFFF))).otherwise(F.shiftrightunsigned(other, 16))
    return v.select("wild", (F.col("bit") * 65536 + quarter.bitwiseAND(F.expr("~shiftleft(1L, bit % 16)"))).alias("sub"), "fp")


def fingerprint_links(prints: DataFrame, parts: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` at most 3 bits apart.

    Not all pairs, but enough that their components are those of all links.
    """
    dealt = _variants(prints).repartition(parts, "key").sortWithinPartitions("key")
    first = written(dealt.mapInArrow(_buckets(0), LINK_DDL), "links")
    hot = _finer(first.where("deeper").select(F.col("a").alias("fp"), "wild"))
    # one key for both levels: the finer buckets of different hot keys stay apart
    hot = hot.select(F.struct("wild", "sub").alias("both"), "fp").select(F.xxhash64("both").alias("key"), "fp")
    second = hot.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_buckets(1), LINK_DDL)
    return first.where("not deeper").select("a", "b").unionByName(second.select("a", "b")).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id.

    Words are runs of non-white-space of the text with A-Z lower-cased;
    shingles are ``words`` consecutive words, repeats counted; a shorter text
    is one shingle, a text without words (empty, null) has fingerprint zero.
    Documents link when fingerprints differ in at most three bits, the
    component is named by its smallest id.  A null id gets the component of
    its fingerprint, null only if no member has an id.  Repeated rows stay.
    An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    parts = n_parts(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = written(rows.mapInArrow(_prints(words), "doc_id long, fp long"), "simhash")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    links = fingerprint_links(distinct.select("fp"), parts)
    member = components(links, "a", "b")
    named = distinct.join(member.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = named.join(smallest, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
