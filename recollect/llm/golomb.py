"""Golomb-coded exchange of 64-bit fingerprints between blocks and owners.

Every block of rows sends its sorted distinct fingerprints to the owners of
their value ranges, as Golomb-Rice coded gaps.  An owner merges what it gets
and answers each message: a bitmap over the message's fingerprints (or, if
asked, the coded fingerprints themselves) telling which of them occur more
than once in the whole table.  A fingerprint that any number of rows of one
block share is sent once, so a hot value costs an owner one entry a block.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_HEAD = struct.Struct("<QQBQ")


def encode(keys: np.ndarray) -> bytes:
    """Sorted distinct unsigned 64-bit keys as Golomb-Rice coded gaps."""
    n = len(keys)
    if not n:
        return b""
    gaps = np.diff(keys)
    mean = max(1, int(gaps.sum(dtype=np.float64) / max(1, n - 1)))
    k = max(0, mean.bit_length() - 1)
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if n > 1 else 0, np.uint8)
    unary[ends] = 1
    low = np.ascontiguousarray(gaps.astype("<u8")).view(np.uint8).reshape(-1, 8)
    whole, rest = divmod(k, 8)
    tail = b""
    if rest:
        high = low[:, whole]
        tail = np.packbits((high[:, None] >> np.arange(rest, dtype=np.uint8)) & 1).tobytes()
    packed = np.packbits(unary).tobytes()
    return _HEAD.pack(n, int(keys[0]), k, len(unary)) + packed + low[:, :whole].tobytes() + tail


def decode(b: bytes) -> np.ndarray:
    if not b:
        return np.empty(0, np.uint64)
    n, first, k, bits = _HEAD.unpack_from(b)
    m, at = n - 1, _HEAD.size
    unary = np.unpackbits(np.frombuffer(b, np.uint8, (bits + 7) // 8, at), count=bits)
    at += (bits + 7) // 8
    quotient = np.diff(np.flatnonzero(unary), prepend=-1) - 1
    whole, rest = divmod(k, 8)
    low = np.zeros((m, 8), np.uint8)
    low[:, :whole] = np.frombuffer(b, np.uint8, m * whole, at).reshape(m, whole)
    at += m * whole
    if rest:
        bit = np.unpackbits(np.frombuffer(b, np.uint8, offset=at), count=m * rest).reshape(m, rest)
        low[:, whole] = (bit << np.arange(rest, dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    gaps = low.view("<u8").reshape(-1) + (quotient.astype(np.uint64) << np.uint64(k))
    with np.errstate(over="ignore"):
        return np.concatenate([np.array([first], np.uint64), np.uint64(first) + np.cumsum(gaps, dtype=np.uint64)])


def owner_cuts(keys: np.ndarray, owners: int, low: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Owners of sorted keys: the owners that occur, and where each begins.
    ``low``: bits that were left out of the keys."""
    own = (((keys << np.uint64(low)) >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
    return np.unique(own, return_index=True)


MESSAGE = pa.schema([("owner", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("twice", pa.binary())])
REPLY = pa.schema([("block", pa.int32()), ("owner", pa.int32()), ("reply", pa.binary())])
MESSAGE_DDL = "owner int, block int, keys binary, twice binary"
REPLY_DDL = "block int, owner int, reply binary"
COUNTED = REPLY.append(pa.field("often", pa.binary()))


def _messages(owners: int, low: int = 0, ordered: bool = False):
    """With ``ordered`` a block is sent as soon as another one begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = defaultdict(list)

        def send() -> Iterator[pa.RecordBatch]:
            for block in sorted(held):
                keys, count = np.unique(np.concatenate(held.pop(block)) >> np.uint64(low), return_counts=True)
                own, begin = owner_cuts(keys, owners, low)
                ends = [*begin[1:], len(keys)]
                rows = [(int(o), block, encode(keys[a:z]), np.packbits(count[a:z] > 1).tobytes()) for o, a, z in zip(own, begin, ends)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), MESSAGE)], schema=MESSAGE)

        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("fingerprints").to_pylist()):
                if ordered and held and block not in held:
                    yield from send()
                held[block].append(np.frombuffer(raw, np.uint64))
        yield from send()

    return run


def _answers(as_keys: bool, counts: bool = False):
    schema = COUNTED if counts else REPLY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes, bytes]]] = defaultdict(list)
        for batch in batches:
            for owner, *rest in zip(*(batch.column(n).to_pylist() for n in ("owner", "block", "keys", "twice"))):
                held[owner].append(tuple(rest))
        for owner in sorted(held):
            got = held.pop(owner)
            sent = [decode(keys) for _, keys, _ in got]
            inside = [k[np.unpackbits(np.frombuffer(t, np.uint8), count=len(k)).astype(bool)] for k, (_, _, t) in zip(sent, got)]
            merged = np.concatenate([*sent, *inside])
            merged.sort()
            begin = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
            times = np.diff(begin, append=len(merged))
            again, times = merged[begin[times > 1]], times[times > 1]
            rows = []
            for keys, (block, _, _) in zip(sent, got):
                at = np.minimum(np.searchsorted(again, keys), max(0, len(again) - 1))
                is_twice = again[at] == keys if len(again) else np.zeros(len(keys), bool)
                if as_keys and is_twice.any():
                    often = [np.log2(times[at[is_twice]]).astype(np.uint8).tobytes()] if counts else []
                    rows.append((block, owner, encode(keys[is_twice]), *often))
                elif not as_keys:
                    rows.append((block, owner, np.packbits(is_twice).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def exchange(keyed: DataFrame, parts: int, as_keys: bool = False, counts: bool = False, low: int = 0, prints=None) -> DataFrame:
    """Which fingerprints occur more than once.

    ``keyed``: ``block`` int and ``fingerprints`` binary (unsigned 64-bit,
    native order; any number of rows a block).  Returns ``block, owner,
    reply``: a bitmap over the block's sorted distinct fingerprints in the
    owner's range, or with ``as_keys`` the repeated ones, coded.  With
    ``counts`` these come with ``often``: a byte each, the logarithm of how
    many blocks sent it (one more for a block that holds it twice).  ``low``
    bits of the fingerprints are left out, also of replies, which makes
    messages shorter and some fingerprints repeated that are not.

    With ``prints``, a function of record batches, the fingerprints are made
    where the messages are, from ``keyed`` as it lies: a block's rows stand
    together, and each task that has some sends messages of its own.
    """
    if prints is None:
        sent = keyed.repartitionById(parts, "block").mapInArrow(_messages(parts, low), MESSAGE_DDL)
    else:
        message = _messages(parts, low, ordered=True)
        sent = keyed.mapInArrow(lambda batches: message(prints(batches)), MESSAGE_DDL)
    return sent.repartitionById(parts, "owner").mapInArrow(_answers(as_keys, counts), REPLY_DDL + (", often binary" if counts else ""))
