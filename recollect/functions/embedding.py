"""The local hashing embedder: word, word-pair and character-gram buckets."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 1024
MODEL = "local-lexical-v2"
# FNV-1a's offset and prime, and the words that form no pairs.
OFFSET, PRIME = 2166136261, 16777619
PAIR_STOPWORDS = frozenset(
    "a an the and or of to in on at by for with from as is are was were be been this that it its i you we they he she my your our their".split()
)
_WORD = re.compile(r"[a-z0-9_]+")
_CJK = re.compile(r"[一-鿿぀-ヿ가-힯]")


@lru_cache(1 << 16)
def fnv1a(s: str, h: int = OFFSET) -> int:
    for c in memoryview(s.encode("utf-16-le", "surrogatepass")).cast("H"):
        h = (h ^ c) * PRIME & 0xFFFFFFFF
    return h


_GRAM_START = {n: np.uint32(fnv1a(f"g{n}:")) for n in (2, 3)}


def bucket_counts(text: str) -> np.ndarray:
    """Features per bucket.  A bucket's parity fixes its sign, so none cancel."""
    low = text.lower()
    words = _WORD.findall(low)
    said = [w for w in words if len(w) >= 2]
    said += [f"w2:{a}:{b}" for a, b in zip(words, words[1:]) if len(a) >= 2 and len(b) >= 2 and a not in PAIR_STOPWORDS and b not in PAIR_STOPWORDS]
    said += [f"cjk:{c}" for c in _CJK.findall(low)]
    count = np.zeros(DIM, np.int64)
    for feature, n in Counter(said).items():
        count[fnv1a(feature) % DIM] += n
    units = np.frombuffer(low.encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint32)
    with np.errstate(over="ignore"):
        for n, start in _GRAM_START.items():
            h = np.full(max(0, len(units) - n + 1), start, np.uint32)
            for i in range(n):
                h = (h ^ units[i : i + len(h)]) * np.uint32(PRIME)
            count += np.bincount(h % DIM, minlength=DIM)
    return count


def _from(h: np.ndarray, units: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """FNV-1a of words of the units, going on from ``h``."""
    h, left = h.copy(), np.arange(len(h))
    with np.errstate(over="ignore"):
        for i in range(size.max(initial=0)):
            left = left[size[left] > i]
            h[left] = (h[left] ^ units[start[left] + i]) * np.uint32(PRIME)
    return h


def _short(units: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Words of up to eight ASCII characters as numbers; 0 for longer ones."""
    code = np.zeros(len(start), np.uint64)
    for i in range(8):
        at = np.flatnonzero((size > i) & (size <= 8))
        code[at] = code[at] << np.uint64(8) | units[start[at] + i].astype(np.uint64)
    return code


def all_bucket_counts(texts: list[str]) -> np.ndarray:
    """``bucket_counts`` of each text, a row each; all texts' features at a time."""
    parts = [t.lower().encode("utf-16-le", "surrogatepass") for t in texts]
    size = np.array([len(p) // 2 for p in parts], np.int64)
    units = np.frombuffer(b"".join(p + b"\0\0" for p in parts), "<u2").astype(np.uint32)
    row = np.repeat(np.arange(len(texts)), size + 1)
    own = np.ones(len(units), bool)
    own[np.cumsum(size + 1) - 1] = False
    start_of = lambda s, n: np.full(n, fnv1a(s), np.uint32)
    found = []
    wordy = own & ((units >= 97) & (units <= 122) | (units >= 48) & (units <= 57) | (units == 95))
    edges = np.flatnonzero(np.diff(wordy, prepend=False, append=False))
    begin, length = edges[::2], edges[1::2] - edges[::2]
    said = length >= 2
    found.append((row[begin[said]], _from(start_of("", said.sum()), units, begin[said], length[said])))
    telling = said & ~np.isin(_short(units, begin, length), _STOP_CODES)
    first = np.flatnonzero(telling[:-1] & telling[1:] & (row[begin[:-1]] == row[begin[1:]]))
    with np.errstate(over="ignore"):
        h = _from(start_of("w2:", len(first)), units, begin[first], length[first])
        found.append((row[begin[first]], _from((h ^ np.uint32(ord(":"))) * np.uint32(PRIME), units, begin[first + 1], length[first + 1])))
        cjk = np.flatnonzero(own & ((units >= 0x4E00) & (units <= 0x9FFF) | (units >= 0x3040) & (units <= 0x30FF) | (units >= 0xAC00) & (units <= 0xD7AF)))
        found.append((row[cjk], (start_of("cjk:", len(cjk)) ^ units[cjk]) * np.uint32(PRIME)))
        for n, start in _GRAM_START.items():
            h = np.full(max(0, len(units) - n + 1), start, np.uint32)
            for i in range(n):
                h = (h ^ units[i : i + len(h)]) * np.uint32(PRIME)
            # a gram lies in one text if its last character is of the text of its first
            whole = np.flatnonzero(own[n - 1 :] & (row[n - 1 :] == row[: len(h)]))
            found.append((row[whole], h[whole]))
    place = np.concatenate([r * DIM + (h % DIM).astype(np.int64) for r, h in found])
    return np.bincount(place, minlength=len(texts) * DIM).reshape(len(texts), DIM)


_STOP_CODES = np.array([int.from_bytes(w.encode()) for w in PAIR_STOPWORDS], np.uint64)


def embed_all(texts: list[str]) -> np.ndarray:
    """Signed square roots of the counts, at unit length; zeros without features."""
    v = np.sqrt(all_bucket_counts(texts)) * np.where(np.arange(DIM) % 2 == 1, 1.0, -1.0)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def embed(text: str) -> np.ndarray:
    return embed_all([text])[0]


def embed_column(text: Column) -> Column:
    """array<double> of each text; a null text gives null."""

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.to_pylist()
            values = np.zeros((len(texts), DIM))
            for i in range(0, len(texts), 128):
                values[i : i + 128] = embed_all([t or "" for t in texts[i : i + 128]])
            ends = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * DIM)
            yield pa.ListArray.from_arrays(ends, pa.array(values.ravel()), mask=batch.is_null())

    return run(text)


def bucket_column(text: Column) -> Column:
    """array<struct<bucket, count>> of the buckets in use."""

    @F.pandas_udf("array<struct<bucket:int,count:long>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if t is None else [{"bucket": int(b), "count": int(c[b])} for b in np.flatnonzero(c)] for t in s for c in [bucket_counts(t or "")]])

    return run(text)


class Embedder(Protocol):
    """An embedding provider: its model's name, its dimension, its columns."""

    model: str
    dim: int

    def column(self, text: Column) -> Column: ...

    def query(self, text: str) -> list[float]: ...


class LocalEmbedder:
    model, dim = MODEL, DIM

    def column(self, text: Column) -> Column:
        return embed_column(text)

    def query(self, text: str) -> list[float]:
        return embed(text).tolist()
