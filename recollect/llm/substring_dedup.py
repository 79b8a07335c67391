"""Operator 2, substring dedup with suffix automata of reference shards.

A window is ``k`` consecutive words.  Windows that start at two or more places
of the table are *reference* text; an automaton of the reference passages is
streamed over the documents, and where its matching statistic reaches ``k``
the matched words are removed.

Broadcasting the automata of a whole corpus to every task costs documents
times shards, and the automata of 0.5 GB do not fit an executor.  So shards
are kept by blocks of documents, each holding only the passages its block
needs, which two fingerprint exchanges find (see ``golomb``):

1. anchors - of every window the least hash of its 16-word grams; equal
   windows have equal anchors, and a document has about one in ten words;
2. windows whose anchor occurs twice or more, by 64-bit hash.

Only documents with such a window go through the second exchange and the
automata; the others are final after the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import WordHash, block_of, bytes_of, in_slices, mix, n_parts, sha256_hex, windows, written
from recollect.llm.golomb import decode, exchange

#: Words of reference text an automaton holds before a new shard is begun.
SHARD_WORDS = 200_000


class SuffixAutomaton:
    """Suffix automaton of several sequences (none matches across two)."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.words = 0

    def _new(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A state for the suffixes of ``q`` that end one word after ``p``."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int]) -> None:
        last, nxt, link = 0, self.next, self.link
        self.words += len(sequence)
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                last = self._split(last, q, c)
                continue
            cur, p = self._new(self.length[last] + 1, {}, 0), last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                link[cur] = self._split(p, nxt[p][c], c)
            last = cur

    def matching(self, sequence: list[int]) -> list[int]:
        """For each place, the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.length
        state, size, out = 0, 0, []
        for c in sequence:
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nxt[state].get(c)
            if to is not None:
                state = to
                size += 1
            out.append(size)
        return out


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (minimum or maximum) over every ``w`` consecutive entries."""
    size, n = 1, len(x) - w + 1
    while 2 * size <= w:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[:n], x[w - size : w - size + n])


def anchors(h: np.ndarray, k: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window, and the keys of all anchor places.

    Minima crowd at low values; mixed once more they are even over the owners.
    """
    g, w = windows(h, gram), k - gram + 1
    least = _slide(g, w, np.minimum)
    pad = np.zeros(w - 1, np.uint64)
    return mix(least), mix(g[_slide(np.concatenate([pad, least, pad]), w, np.maximum) == g])


def _runs(flags: np.ndarray) -> np.ndarray:
    """(begin, end) of each run of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge.reshape(-1, 2)


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


_KEYS = pa.schema([("block", pa.int32()), ("fingerprints", pa.binary())])
KEYS_DDL = "block int, fingerprints binary"


def _send_anchors(k: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch in batches:
            rows = ((b, anchors(words.of(t), k, gram)[1].tobytes()) for b, t in zip(batch.column("place").to_pylist(), ((x or b"").split() for x in bytes_of(batch, "text"))) if len(t) >= k)
            yield from in_slices(rows, _KEYS)

    return run


_FIRST = pa.schema([("block", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.binary()), ("runs", pa.binary())])


def _by_block(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[int, np.ndarray, Iterator[tuple]]]:
    """Blocks of sorted rows, each with its place's repeated keys (from the
    replies, which come first)."""
    from itertools import groupby

    flat = (row for batch in batches for row in zip(*(batch.column(n).to_pylist() for n in ("place", "block", "reply", *names))))
    for _, rows in groupby(flat, key=lambda r: r[0]):
        known = np.empty(0, np.uint64)
        for block, group in groupby(rows, key=lambda r: r[1]):
            if block is None:
                known = np.sort(np.concatenate([decode(r[2]) for r in group]))
            else:
                yield block, known, (r[3:] for r in group)


def _nominate(k: int, gram: int):
    """Windows whose anchor is repeated; documents without any are final."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()

        def rows():
            for block, known, docs in _by_block(batches, ("doc_id", "text")):
                for doc_id, text in docs:
                    w = (text or b"").split()
                    runs = _runs(_among(anchors(hashes.of(w), k, gram)[0], known)) if len(w) >= k and len(known) else ()
                    if len(runs):
                        yield block, doc_id, len(w), None, text, runs.astype(np.int64).tobytes()
                    else:
                        yield block, doc_id, len(w), sha256_hex(b" ".join(w)), None, None

        yield from in_slices(rows(), _FIRST)

    return run


def _send_windows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()

        def rows():
            for batch in batches:
                for block, text, runs in zip(*(batch.column(n).to_pylist() for n in ("place", "text", "runs"))):
                    win = windows(hashes.of(text.split()), k)
                    yield block, np.concatenate([win[a:z] for a, z in np.frombuffer(runs, np.int64).reshape(-1, 2)]).tobytes()

        yield from in_slices(rows(), _KEYS)

    return run


_LAST = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
LAST_DDL = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _match(k: int, with_text: bool):
    """Automata of the block's reference passages, streamed over its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()

        def rows():
            for _, known, docs in _by_block(batches, ("doc_id", "text", "runs")):
                shards, held = [SuffixAutomaton()], set()
                for doc_id, text, runs in docs:
                    w = text.split()
                    h = hashes.of(w)
                    win = windows(h, k)
                    mine = np.zeros(len(win), bool)
                    for a, z in np.frombuffer(runs, np.int64).reshape(-1, 2):
                        mine[a:z] = _among(win[a:z], known)
                    covered = np.zeros(len(w), bool)
                    if mine.any():
                        seq = h.tolist()
                        fresh = mine.copy()
                        at = np.flatnonzero(mine)
                        fresh[at] = [x not in held for x in win[at].tolist()]
                        for a, z in _runs(fresh):
                            if shards[-1].words > SHARD_WORDS:
                                shards.append(SuffixAutomaton())
                            shards[-1].add(seq[a : z + k - 1])
                        held.update(win[fresh].tolist())
                        edge = np.zeros(len(w) + 1, np.int64)
                        for shard in shards:
                            size = np.array(shard.matching(seq))
                            end = np.flatnonzero(size >= k)
                            np.add.at(edge, end - size[end] + 1, 1)
                            np.add.at(edge, end + 1, -1)
                        covered = np.cumsum(edge[:-1]) > 0
                    kept = b" ".join([x for x, c in zip(w, covered.tolist()) if not c])
                    yield doc_id, len(w), int(covered.sum()), sha256_hex(kept), kept.decode() if with_text else None

        yield from in_slices(rows(), _LAST)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 35, gram: int = 16, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    Removed is every word in a window of ``k`` consecutive words that also
    starts elsewhere in the table, the same document included.  All copies
    lose it: none is a first one.  Words are runs of non-white-space bytes; a
    null or empty text has none, and its kept text is empty.  Repeated rows
    are separate places, so they remove each other's windows.  Null ids stay
    null.  Other columns are not read; an empty table gives no rows.  With
    ``with_text`` the kept words, joined by one space, come as ``kept_text``
    for documents that lost some (null: nothing was removed).
    """
    spark = docs.sparkSession
    parts = n_parts(spark, docs)
    # a task holds one block's automata at a time, but asks for all of its
    # blocks at once: messages go between tasks, not between blocks
    blocks, place = 4 * parts, F.pmod("block", F.lit(parts)).alias("place")
    none = lambda kind: F.lit(None).cast(kind)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("block", block_of(blocks, "doc_id", "text")).select("*", place)
    twice = exchange(rows.mapInArrow(_send_anchors(k, gram), KEYS_DDL), parts, as_keys=True)

    def joined(replies: DataFrame, texts: DataFrame) -> DataFrame:
        asked = replies.select(F.col("block").alias("place"), none("int").alias("block"), "reply", none("long").alias("doc_id"), none("binary").alias("text"), none("binary").alias("runs"))
        both = asked.unionByName(texts.select("place", "block", none("binary").alias("reply"), "doc_id", F.col("text").cast("binary"), "runs"))
        return both.repartitionById(parts, "place").sortWithinPartitions("place", F.col("block").asc_nulls_first())

    first = joined(twice, rows.withColumn("runs", none("binary"))).mapInArrow(_nominate(k, gram), "block int, doc_id long, n_words long, kept_sha256 string, text binary, runs binary")
    first = written(first, "nominated")
    still = first.where(F.col("runs").isNotNull()).select("block", "doc_id", "text", "runs", place)
    again = exchange(still.mapInArrow(_send_windows(k), KEYS_DDL), parts, as_keys=True)
    last = joined(again, still).mapInArrow(_match(k, with_text), LAST_DDL)
    done = first.where(F.col("runs").isNull()).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", none("string").alias("kept_text"))
    out = done.unionByName(last)
    return out if with_text else out.drop("kept_text")
