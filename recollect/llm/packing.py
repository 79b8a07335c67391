"""Operator 4, best-fit packing with certified bounds.

Documents become byte-level BPE ids; those longer than a sequence are cut.
Each partition packs its pieces best-fit decreasing and compares its bin count
with a lower bound from dual feasible functions.  Partitions that meet their
bound are final but for their emptiest sequence.  Its documents and all those
of the other partitions are dealt anew, to fewer partitions, and packed again,
until nothing is left over or what is left no longer fits fewer partitions.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import bytes_of, in_slices, n_parts, written

END_ID = 0
CAPACITY = 2048
#: Pieces that a partition of a later round gets at most, about (60 bytes each).
ROUND_PIECES = 500_000

# Characters on whose classes all versions of Unicode agree: ASCII and the
# Latin letters of U+00C0..U+017F.  Other texts go through the library.
_PLAIN = re.compile(r"[\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ſ]*")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranks(model: dict) -> dict[bytes, int] | None:
    """Byte strings by merge rank, if the file's ids are in merge order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ids = {w: i for w, i in model["vocab"].items() if all(c in byte for c in w)}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if [ids.get(w) for w in merged] != list(range(256, 256 + len(merged))):
        return None
    keep = {w for w, i in ids.items() if i < 256 + len(merged)}
    return {bytes(byte[c] for c in w): ids[w] for w in keep}


class Tokens:
    """Ids of texts as little-endian 32-bit bytes, as the library gives them.

    Plain texts are encoded by tiktoken from the same vocabulary, three times
    as fast as the library; tests hold the two against each other.  A special
    token's name within a text is that token, as is the library's default, or
    with ``spelled`` ordinary characters.
    """

    def __init__(self, vocabulary: str, spelled: bool = False) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.library.encode_special_tokens = spelled
        with open(vocabulary, encoding="utf-8") as f:
            file = json.load(f)
        self.names = [t["content"] for t in file.get("added_tokens") or () if not (spelled and t.get("special"))]
        #: One more than the largest id.
        self.size = 1 + max([*file["model"]["vocab"].values(), *(t["id"] for t in file.get("added_tokens") or ())])
        self.fast = None
        if not file.get("normalizer") and (ranks := _ranks(file["model"])):
            import tiktoken

            self.fast = tiktoken.Encoding("from-file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def of(self, texts: list[str]) -> Iterator[bytes]:
        for t in texts:
            if self.fast and _PLAIN.fullmatch(t) and not any(n in t for n in self.names):
                ids = self.fast.encode_ordinary(t)
            else:
                ids = self.library.encode(t, add_special_tokens=False).ids
            yield np.array(ids, "<u4").tobytes()


_PIECE = pa.schema([("doc_id", pa.int64()), ("nth", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECE_DDL = "doc_id long, nth long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    starts = [0, *range(first, n, capacity)]
    return list(zip(starts, [first] + [capacity] * (len(starts) - 1)))


def _pieces(vocabulary: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, last = Tokens(vocabulary), np.array([end_id], "<u4").tobytes()
        # a number for each row, so that equal rows are dealt to different partitions
        nth = TaskContext.get().partitionId() << 40

        def rows():
            nonlocal nth
            for batch in batches:
                texts = [(b or b"").decode("utf-8", "replace") for b in bytes_of(batch, "text")]
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokens.of(texts)):
                    ids += last
                    for i, (start, size) in enumerate(cut(len(ids) // 4, capacity)):
                        yield doc_id, nth, i, start, size, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + size)])
                    nth += 1

        yield from in_slices(rows(), _PIECE)

    return run


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each size, and each bin's fill.

    Bins lie on stacks by free room; a bit set of the rooms in use finds the
    smallest that fits.
    """
    order = np.argsort(-sizes, kind="stable")
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, fill = 0, []
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fits = used >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                used ^= 1 << free
        else:
            b, free = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        free -= size
        if free:
            room[free].append(b)
            used |= 1 << free
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Least number of bins, by dual feasible functions.

    For each threshold t up to half the capacity: items above capacity - t
    count whole, those below t not at all, the rest by size; and the rounding
    functions floor((k + 1) x / c) / k.  Each maps feasible bins to sums of at
    most one, so its total is a bound.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)
    s = np.arange(capacity + 1)
    best = -(-int((count * s).sum()) // capacity)
    for t in np.flatnonzero(count[: capacity // 2 + 1]):
        weight = np.where(s > capacity - t, capacity, np.where(s < t, 0, s))
        best = max(best, -(-int((count * weight).sum()) // capacity))
    for k in range(1, 51):
        scaled = (k + 1) * s
        exact = scaled % capacity == 0
        weight = np.where(exact, s * k, scaled // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((count * weight).sum()) // (k * capacity)))
    return best


_PACKED = pa.schema([*_PIECE, ("part", pa.int32()), ("bin", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])
PACKED_DDL = PIECE_DDL + ", part int, bin long, offset long, open boolean"


def _pack(capacity: int, final: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list[pa.Table]] = defaultdict(list)
        for batch in batches:
            t = pa.Table.from_batches([batch])
            parts = t.column("part").to_numpy()
            for p in np.unique(parts).tolist():
                groups[p].append(t.filter(pa.array(parts == p)))
        for p in sorted(groups):
            t = pa.concat_tables(groups.pop(p)).sort_by([(n, "ascending") for n in ("length", "doc_id", "piece", "ids_crc32")]).combine_chunks()
            sizes = t.column("length").to_numpy()
            bins, offsets, fill = best_fit(sizes, capacity)
            certified = len(fill) == lower_bound(sizes, capacity)
            open_ = np.full(len(sizes), not certified and not final)
            if certified and not final and fill.min() < capacity:
                open_ = bins == fill.argmin()
            cols = [t.column(n).combine_chunks() for n in _PIECE.names]
            cols += [pa.array(np.full(len(sizes), p, np.int32)), pa.array(bins), pa.array(offsets), pa.array(open_)]
            yield from pa.Table.from_arrays(cols, schema=_PACKED).to_batches(16384)

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces of at most ``capacity``.

    Equal pieces are told apart by ``nth``.  A round's open pieces go on to a
    quarter of its partitions; the last round is the one in a single
    partition, or the first that could not be dealt to fewer.
    """
    parts = n_parts(pieces.sparkSession, pieces)
    deal = lambda r: F.pmod(F.xxhash64("doc_id", "nth", "piece", "ids_crc32", F.lit(r)), F.lit(parts)).cast("int")
    now, done, r, final = pieces.withColumn("part", deal(0)), [], 0, parts == 1
    while True:
        packed = written(now.repartition(parts, "part").mapInArrow(_pack(capacity, final), PACKED_DDL), f"packed{r}")
        done.append(packed.where("not open").withColumn("round", F.lit(r)))
        left = packed.where("open")
        n = 0 if final else left.count()
        if not n:
            break
        fewer = min(parts, max(1, parts // 4, -(-n // ROUND_PIECES)))
        final, parts, r = fewer == 1 or fewer == parts, fewer, r + 1
        now = left.select(*_PIECE.names, deal(r).alias("part"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    sequence = F.shiftleft(F.col("round").cast("long"), 56) + F.shiftleft(F.col("part").cast("long"), 32) + F.col("bin")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset")


def best_fit_packing(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; one of more than ``capacity`` ids is
    cut into pieces of ``capacity``, of which the first may be shorter.  A null
    or empty text is the end id alone.  Null ids and repeated rows are packed
    like any other row.  The vocabulary file is read on every worker, so it
    must lie at the same path on all.  An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = written(rows.mapInArrow(_pieces(vocabulary, capacity, end_id), PIECE_DDL), "pieces")
    return pack_pieces(pieces, capacity)
