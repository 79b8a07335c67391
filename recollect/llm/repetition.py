"""Operator 10, quality rules: repeated substrings by suffix arrays.

A suffix array over the words of each document (many documents at a time, by
prefix doubling in numpy) brings equal beginnings side by side; the longest
common prefix of neighbours gives the longest repeat at each place.  The union
of the maximal repeats' spans is the covered text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import WordHash, bytes_of

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
#: Words of documents that share one suffix array.
ARRAY_WORDS = 1 << 20

_OUT = pa.schema(
    [("row", pa.int64())]
    + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")]
)
OUT_DDL = "row long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long"


def _dense(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Ranks from a sorted order and the marks of where a new value begins."""
    rank = np.empty(len(order), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return rank


def suffix_order(h: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Suffixes of all documents in lexicographic order, documents apart.

    ``h``: word hashes of documents laid end to end; ``end[i]``: where the
    document of word i ends.  Prefix doubling; only suffixes that still tie
    are sorted again, and a rank is the place of the first of its ties.
    """
    n = len(h)
    order = np.lexsort((h, end))
    new = np.ones(n, bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (end[order[1:]] != end[order[:-1]])
    rank, size = _dense(order, new), 1
    while True:
        last = np.ones(n, bool)
        last[:-1] = new[1:]
        tied = np.flatnonzero(~(new & last))
        if not len(tied):
            return order
        at = order[tied]
        after = at + size
        inside = after < end[at]
        key = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        sort = np.lexsort((key, rank[at]))
        at, key = at[sort], key[sort]
        order[tied] = at
        group = rank[at]
        begins = np.ones(len(at), bool)
        begins[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        new[tied] = begins
        rank[at] = np.maximum.accumulate(np.where(begins, tied, 0))
        size *= 2


#: Moduli and bases of the prefix hashes: primes, as sums modulo a power of two
#: are equal for different spans of texts like Thue and Morse's.
MODULI = ((2147483647, 1290021943), (2147483629, 852731659))


def _prefix_sums(h: np.ndarray, prime: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and sums of h[i] * base**i, modulo ``prime``."""
    n, p = len(h), np.uint64(prime)
    power = np.ones(n + 1, np.uint64)
    size = 1
    while size <= n:
        part = power[size : 2 * size]
        part[:] = power[: len(part)] * np.uint64(pow(base, size, prime)) % p
        size *= 2
    total = np.zeros(n + 1, np.uint64)
    # a block's sum of terms below 2**31 stays below 2**64
    np.cumsum(h % p * power[:-1] % p, out=total[1:])
    return power, total % p


def common_prefix(h: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common prefix of the suffixes a and b of one document each.

    A binary search over the length for all pairs at once, by hashes of spans.
    """
    sums = [(np.uint64(p), *_prefix_sums(h, p, base)) for p, base in MODULI]
    low = np.zeros(len(a), np.int64)
    high = np.minimum(end[a] - a, end[b] - b)
    x, y = np.minimum(a, b), np.maximum(a, b)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        i, j = x[open_], y[open_]
        mid = (low[open_] + high[open_] + 1) // 2
        same = np.ones(len(open_), bool)
        for p, power, total in sums:
            # equal spans agree after scaling to one offset
            left = (total[i + mid] + p - total[i]) % p * power[j - i] % p
            same &= left == (total[j + mid] + p - total[j]) % p
        low[open_] = np.where(same, mid, low[open_])
        high[open_] = np.where(same, high[open_], mid - 1)


def longest_repeats(h: np.ndarray, end: np.ndarray, least: int) -> np.ndarray:
    """For each place, the longest repeat that begins there, 0 below ``least``."""
    n = len(h)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    order = suffix_order(h, end)
    a, b = order[:-1], order[1:]
    # a cheap test first: do the first and last of `least` words agree?
    fits = np.flatnonzero((end[a] == end[b]) & (a + least <= end[a]) & (b + least <= end[b]))
    a, b = a[fits], b[fits]
    for step in (0, least - 1):
        same = h[a + step] == h[b + step]
        a, b = a[same], b[same]
    size = common_prefix(h, end, a, b) if len(a) else np.empty(0, np.int64)
    long = size >= least
    np.maximum.at(out, a[long], size[long])
    np.maximum.at(out, b[long], size[long])
    return out


def _covered(n: int, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + size, -1)
    return np.cumsum(edge[:-1]) > 0


def repeats(texts: list[np.ndarray], least: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: words in repeated windows, words covered, longest repeat."""
    sizes = np.array([len(t) for t in texts], np.int64)
    h = np.concatenate([*texts, np.empty(0, np.uint64)])
    doc = np.repeat(np.arange(len(texts)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    size = longest_repeats(h, end, min(least, window))
    many = lambda flags: np.bincount(doc[flags], minlength=len(texts))
    at = np.flatnonzero(size >= window)
    in_window = _covered(len(h), at, np.full(len(at), window))
    at = np.flatnonzero(size >= least)
    covered = _covered(len(h), at, size[at])
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc[at], size[at])
    return many(in_window), many(covered), longest


def _measure(least: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()

        def close(held: list[tuple]) -> pa.RecordBatch:
            rep = repeats([t for *_, t in held], least, window)
            cols = list(zip(*(x[:5] for x in held)))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*cols, *rep)], schema=_OUT)

        held, size = [], 0
        for batch in batches:
            for row, b in zip(batch.column("row").to_pylist(), bytes_of(batch, "text")):
                b = b or b""
                w = b.split()
                blanks = len(b) - len(b.translate(None, SPACES))
                lines = [x for x in b.split(b"\n") if x.strip()]
                codes = len(b.decode("utf-8", "replace"))
                held.append((row, len(w), codes - blanks, len(b) - len(b.translate(None, SYMBOLS)), len(lines) - len(set(lines)), hashes.of(w)))
                size += len(w)
                if size >= ARRAY_WORDS or len(held) >= 8192:
                    yield close(held)
                    held, size = [], 0
        if held:
            yield close(held)

    return run


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = 4,
    window: int = 8,
    most_covered: float = 0.3,
    most_longest: float = 0.2,
) -> DataFrame:
    """One row per row of ``docs`` with its measures and verdict.

    Base: n_words, word_chars (code points in words), n_symbols, n_dup_lines,
    n_repeat_words (words in ``window``-word windows found twice or more), and
    base_failed (n_words < 20, or more than 30% repeat words).  Method:
    covered_words (union of all repeats of ``least`` or more words) and
    longest_repeat (words).  A document that passed the base is kept unless
    more than ``most_covered`` of its words are covered or its longest repeat
    has more than ``most_longest`` of its words.

    Null and empty texts have zero words and fail.  Null ids and repeated rows
    give rows of their own; other columns are not read; an empty table gives
    no rows.  Very long texts are whole: one document is one suffix array.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_measure(least, window), OUT_DDL)
    return judged(out.withColumnRenamed("row", "doc_id"), most_covered, most_longest)


def judged(measures: DataFrame, most_covered: float, most_longest: float) -> DataFrame:
    n = F.col("n_words")
    failed = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    fine = (F.col("covered_words") <= most_covered * n) & (F.col("longest_repeat") <= most_longest * n)
    return measures.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)


def passing(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all their columns.

    Judged beside the rows themselves: no join, so ids need not be unique.
    """
    limit = {"least": 4, "window": 8, "most_covered": 0.3, "most_longest": 0.2} | limits
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = _measure(limit["least"], limit["window"])
        for batch in batches:
            text = batch.column(text_col).cast(pa.string())
            asked = pa.RecordBatch.from_arrays([pa.array(range(len(text)), pa.int64()), text], ["row", "text"])
            got = pa.Table.from_batches(list(measure(iter([asked]))), schema=_OUT).sort_by("row").to_pydict()
            n, rep, cov, top = (np.array(got[k], np.int64) for k in ("n_words", "n_repeat_words", "covered_words", "longest_repeat"))
            keep = (n >= 20) & (100 * rep <= 30 * n) & (cov <= limit["most_covered"] * n) & (top <= limit["most_longest"] * n)
            yield batch.filter(pa.array(keep))

    return docs.select(*names).mapInArrow(run, docs.schema)
