"""Operator 8, quality classifier by compression.

Two zstandard dictionaries are trained, on good and on bad labelled text.
Every piece of a text is compressed with both; the normalised difference of
the sizes, calibrated by logistic regression on labelled texts that neither
dictionary saw, is the score.

What is compressed is a text's outline: each letter becomes ``a`` or ``A``,
each digit ``9``, a word equal to the one before it ``=``.  Words of four
languages would need dictionaries of megabytes; their outlines, in which
shouting, symbols, tables and stuttering show, fit in 110 KB.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.llm.common import bytes_of, in_slices, written

#: Outlines are compressed in pieces of this many bytes, so that a dictionary
#: matters as much at the end of a long text as at its beginning.
PIECE = 128
DICTIONARY = 110 << 10
LEVEL = 3
#: Bytes added to both sizes together: a text of a few words says little.
SHRINK = 64

_SHAPE = bytes(
    ord("a") if 97 <= c < 123 or c >= 0x80 else ord("A") if 65 <= c < 91 else ord("9") if 48 <= c < 58 else c for c in range(256)
)
_FOLLOWING = bytes(range(0x80, 0xC0))


def outline(text: bytes) -> bytes:
    """The shapes of a text's words; a character beyond ASCII is one ``a``."""
    lines = []
    for line in text.split(b"\n"):
        w = line.split()
        lines.append(b" ".join([b"=" if x == y else x for x, y in zip(w, [b"", *w])]))
    return b"\n".join(lines).translate(_SHAPE, _FOLLOWING)


@dataclass(frozen=True)
class CompressionModel:
    """What scoring needs: two dictionaries and the calibration."""

    good: bytes
    bad: bytes
    slope: float
    shift: float
    empty: float


class Sizes:
    """Compressed size of texts under a dictionary, without frame overhead."""

    def __init__(self, dictionary: bytes) -> None:
        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_AUTO)
        d.precompute_compress(level=LEVEL)
        self.one = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def of(self, text: bytes) -> int:
        return sum(len(self.one(text[i : i + PIECE])) for i in range(0, len(text), PIECE))


def difference(shape: bytes, good: Sizes, bad: Sizes) -> float:
    """(bad - good) / (bad + good): positive when the good dictionary fits."""
    a, b = good.of(shape), bad.of(shape)
    return (b - a) / (a + b + SHRINK)


#: Bytes of the pieces of outlines that dictionaries are made of, and the
#: pieces of a class that the driver gets at most (4 MB).
SAMPLE_PIECE, SAMPLE_PIECES = 512, 8192


def _cut(quality_col: str):
    """(quality, place, hash, piece) of whole outlines; a text's pieces in the order of a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for b, q in zip(bytes_of(batch, "text"), batch.column(quality_col).to_pylist()):
                    shape = outline(b)
                    if half(shape):
                        continue
                    pieces = [shape[i : i + SAMPLE_PIECE] for i in range(0, len(shape), SAMPLE_PIECE)]
                    for place, (h, i) in enumerate(sorted((zlib.crc32(x, i), i) for i, x in enumerate(pieces))):
                        yield q, place, h, pieces[i]

        yield from in_slices(rows(), _PIECES)

    return run


_PIECES = pa.schema([("quality", pa.int32()), ("place", pa.int64()), ("h", pa.int64()), ("piece", pa.binary())])


def half(shape: bytes) -> int:
    """0: the text's outline goes into a dictionary, 1: into the calibration."""
    return zlib.crc32(shape) & 1


def _dictionary(pieces: list[bytes], size: int, trained: bool) -> bytes:
    """A dictionary trained on a class's pieces, or the first of them as they are."""
    if trained:
        try:
            return zstandard.train_dictionary(size, pieces).as_bytes()
        except zstandard.ZstdError:  # too few to train on
            pass
    out, used = [], 0
    for p in pieces:
        if used + len(p) > size:
            break
        out.append(p)
        used += len(p)
    return b"".join(reversed(out))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method with a little ridge."""
    scale = float(x.std()) or 1.0
    x, a, b = x / scale, 0.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = weight * p * (1 - p)
        g = np.array([(weight * (y - p) * x).sum() - 1e-3 * a, (weight * (y - p)).sum() - 1e-3 * b])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + float(step[0]), b + float(step[1])
        if np.abs(step).max() < 1e-9:
            break
    return a / scale, b


def labelled_sample(docs: DataFrame, labels: DataFrame, rows_per_class: int) -> tuple[DataFrame, float]:
    """(text, quality) of up to ``rows_per_class`` labelled rows of each class, by hash order.

    ``docs``: doc_id, text; ``labels``: doc_id, quality.  Rows without an id, a
    text or a label are not taken.  The second value is the share of good
    labels, over all.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality").distinct()
    count = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    share = (count.get(1, 0) + 1) / (sum(count.values()) + 2)
    if count:
        # the lowest hashes only, some twice as many as are taken, meet in a class's task; that a
        # range holds too few has a chance below 1e-100 at the shipped rows, and costs a few rows
        reach = F.create_map(*(F.lit(x) for q, n in count.items() for x in (q, min(1.0, (2 * rows_per_class + 100) / n))))
        known = known.where((F.xxhash64("doc_id", F.lit(8)) / 2.0**64 + 0.5) <= F.element_at(reach, F.col("quality")))
    place = F.row_number().over(W.partitionBy("quality").orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id"))
    picked = known.withColumn("place", place).where(F.col("place") <= rows_per_class).select("doc_id", "quality")
    # at most two classes of rows_per_class ids
    rows = docs.where(F.col("text") != "").join(F.broadcast(picked), "doc_id").select("text", "quality")
    return written(rows, "quality-labels"), share


def train(sample: DataFrame, share: float, dictionary: int = DICTIONARY, trained: bool = True) -> CompressionModel:
    """Dictionaries from one half of the labelled texts, calibration on the other.

    ``share``: of good labels in the whole table, to which the calibration is
    weighted.  Without both classes every score is that share.  The driver
    gets at most ``SAMPLE_PIECES`` pieces of a class, of as many texts as
    there are, and two numbers of each labelled text of the other half.
    """
    pieces = written(sample.mapInArrow(_cut("quality"), "quality int, place long, h long, piece binary"), "pieces")
    part = {q: [bytes(r.piece) for r in pieces.where(F.col("quality") == q).orderBy("place", "h", "piece").limit(SAMPLE_PIECES).collect()] for q in (0, 1)}
    if not part[0] or not part[1]:
        return CompressionModel(b"", b"", 0.0, math.log(share / (1 - share)), share)
    good, bad = (_dictionary(part[q], dictionary, trained) for q in (1, 0))
    plain = CompressionModel(good, bad, 1.0, 0.0, share)
    scored = sample.select(F.col("quality").cast("long").alias("doc_id"), "text").mapInArrow(_score(plain, calibrating=True), "doc_id long, difference double, score double")
    got = sorted((r.difference, r.doc_id, r.score) for r in scored.collect())
    held = [(x, q) for x, q, side in got if side == 1]
    if len({q for _, q in held}) < 2:
        held = [(x, q) for x, q, _ in got]
    x, y = np.array([x for x, _ in held]), np.array([q for _, q in held], float)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    slope, shift = _logistic(x, y, weight)
    return CompressionModel(good, bad, slope, shift, share)


_SCORED = pa.schema([("doc_id", pa.int64()), ("difference", pa.float64()), ("score", pa.float64())])


def _score(model: CompressionModel, calibrating: bool = False):
    """Differences and scores; ``calibrating``: a text's half in place of its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = (Sizes(model.good), Sizes(model.bad)) if model.good else (None, None)
        for batch in batches:
            diff, score = [], []
            for b in bytes_of(batch, "text"):
                if not b or good is None:
                    diff.append(0.0)
                    score.append(model.empty)
                    continue
                shape = outline(b)
                x = difference(shape, good, bad)
                diff.append(x)
                score.append(float(half(shape)) if calibrating else 1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * x + model.shift)))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(diff, pa.float64()), pa.array(score, pa.float64())], schema=_SCORED)

    return run


def quality_scores(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, difference, score.

    Whole texts are scored.  Empty and null texts get the share of good labels;
    null ids and repeated rows get rows of their own; other columns are not
    read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_score(model), "doc_id long, difference double, score double")


def held_out() -> F.Column:
    """Rows whose crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, rows_per_class: int = 1500, trained: bool = True) -> DataFrame:
    """Train on labels of rows that are not held out, score every document."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(~held_out())
    model = train(*labelled_sample(text, known, rows_per_class), trained=trained)
    return quality_scores(text, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "difference")
