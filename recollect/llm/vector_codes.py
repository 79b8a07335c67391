"""Operator 11, vector code compression: product codes by filtering Lloyd.

Vectors become integers, are cut into equal parts, and each part position has
a codebook.  A task lays its rows down in blocks; each block has a kd-tree per
part position, whose nodes hold a bounding box and the cached sum of their
parts.  Lloyd's rounds send the codebooks down these trees: a box drops the
entries that lie farther from all of it than the entry nearest its middle, and
where one entry is left the whole subtree is assigned at once.  All arithmetic
is on integers, so ties and rounds come out the same wherever rows lie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from recollect.llm.common import written

#: Rows of a block at most, and bytes of its integers, about.
BLOCK_ROWS, BLOCK_BYTES = 8192, 8 << 20
#: Parts that a leaf of a tree holds at most.
LEAF = 32
#: Squared distances must fit a long; those of doubles are exact below 2**53.
MOST, EXACT = 1 << 62, 1 << 53


def ranges(n: int) -> list[list[tuple[int, int]]]:
    """Row ranges of a tree's nodes by level: halves of their parents, so the
    children of node i of a level are, in order, those of its inner nodes."""
    levels = [[(0, n)]]
    while any(z - a > LEAF for a, z in levels[-1]):
        levels.append([half for a, z in levels[-1] if z - a > LEAF for half in ((a, (a + z) // 2), ((a + z) // 2, z))])
    return levels


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """kd-tree of (n, d) integers: order of rows, and low, high, sum of every
    node, level by level.  A node is cut at the median of its box's longest side."""
    order, low, high, total = np.arange(len(points)), [], [], []
    for level in ranges(len(points)):
        for a, z in level:
            mine = points[order[a:z]]
            low.append(mine.min(axis=0))
            high.append(mine.max(axis=0))
            total.append(mine.sum(axis=0))
            if z - a > LEAF:
                side = mine[:, np.argmax(high[-1] - low[-1])]
                order[a:z] = order[a:z][np.argpartition(side, (a + z) // 2 - a)]
    return order, np.array(low), np.array(high), np.array(total)


def bound(width: int, reach: int) -> int:
    """What no number of a comparison exceeds: (low + high) and differences of
    entries reach twice as far each as components do."""
    return 8 * max(1, width) * max(1, reach) ** 2


class Book:
    """A codebook, ready to be sent down trees."""

    def __init__(self, entries: np.ndarray, reach: int) -> None:
        """``reach``: the largest magnitude of a component of any vector."""
        self.kind = np.float64 if bound(entries.shape[1], reach) < EXACT else np.int64
        self.at = entries.astype(self.kind)
        self.norm = (self.at * self.at).sum(axis=1)
        self._apart: dict[int, np.ndarray] = {}

    def apart(self, z: int) -> np.ndarray:
        """Componentwise distance of every entry to entry ``z``."""
        if z not in self._apart:
            self._apart[z] = np.abs(self.at - self.at[z]).T.copy()
        return self._apart[z]

    def left(self, low: np.ndarray, high: np.ndarray, may: np.ndarray) -> np.ndarray:
        """Which of the entries ``may`` (nodes x entries) can be nearest to a
        place of each box; an entry as far as a lower one everywhere cannot."""
        both, side = (low + high).astype(self.kind), (high - low).astype(self.kind)
        # four squared distances to the middle, less what all entries share
        far = self.norm - both @ self.at.T
        best = np.where(may, far, np.inf if self.kind is np.float64 else np.iinfo(np.int64).max).argmin(axis=1)
        out = may.copy()
        for z in np.unique(best).tolist():
            rows = np.flatnonzero(best == z)
            # how much nearer z is, at the box's corner that favours the other entry most
            lead = far[rows] - far[rows, z][:, None] - side[rows] @ self.apart(z)
            gone = lead > 0
            gone[:, z + 1 :] |= lead[:, z + 1 :] == 0
            gone[:, z] = False
            out[rows] &= ~gone
        return out

    def nearest(self, points: np.ndarray, among: np.ndarray) -> np.ndarray:
        """For each point the nearest of the entries ``among`` (ascending)."""
        far = self.norm[among] - 2 * (points.astype(self.kind) @ self.at[among].T)
        return among[far.argmin(axis=1)]


def send_down(book: Book, points: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int, int, int | np.ndarray]]:
    """(node, begin, end, entry or the entries of its points): a partition of
    the tree's rows.  ``points`` are in the tree's order."""
    may = np.ones((1, len(book.at)), bool)
    first = 0
    for level in ranges(len(points)):
        here = np.arange(first, first + len(level))
        first += len(level)
        # nodes of settled subtrees came down without entries
        live = may.any(axis=1)
        if live.any():
            may[live] = book.left(low[here[live]], high[here[live]], may[live])
        n_left, below = may.sum(axis=1), []
        for i, (a, z) in enumerate(level):
            if n_left[i] == 1:
                yield here[i], a, z, int(may[i].argmax())
            elif n_left[i] and z - a <= LEAF:
                yield here[i], a, z, book.nearest(points[a:z], np.flatnonzero(may[i]))
            if z - a > LEAF:
                below += [may[i] if n_left[i] > 1 else np.zeros(len(book.at), bool)] * 2
        may = np.array(below).reshape(-1, len(book.at))


_TREE = pa.struct([("order", pa.binary()), ("points", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("total", pa.binary())])
_TREES = ArrayType(StructType([StructField(f.name, BinaryType()) for f in _TREE]))


def _blocks(dim: int, parts: int, label_type: pa.DataType):
    """Rows of a task as blocks with a tree per part position."""
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(label_type)), ("trees", pa.list_(_TREE))])

    def one(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        column = t.column("v").combine_chunks()
        sizes = np.diff(column.offsets.to_numpy())
        held = np.zeros((len(column), dim), np.int64)
        held[np.arange(dim) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        trees = []
        for p in np.split(held, parts, axis=1):
            order, low, high, total = build(p)
            trees.append({"order": order.astype("<i4").tobytes(), "points": p[order].tobytes(), "low": low.tobytes(), "high": high.tobytes(), "total": total.tobytes()})
        whole = lambda name, kind: pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t.column(name).combine_chunks().cast(kind))
        return pa.RecordBatch.from_arrays([whole("vec_id", pa.int64()), whole("label", label_type), pa.array([trees], pa.list_(_TREE))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while len(batch):
                some = batch.slice(0, most - n)
                batch = batch.slice(len(some))
                held.append(some)
                n += len(some)
                if n == most:
                    yield one(held)
                    held, n = [], 0
        if n:
            yield one(held)

    return run


def _trees(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, list[tuple]]]:
    """Row number and (order, points, low, high, total) of each tree of a block."""
    for row, trees in enumerate(batch.column("trees").to_pylist()):
        read = lambda b: np.frombuffer(b, np.int64).reshape(-1, width)
        yield row, [(np.frombuffer(t["order"], "<i4"), *(read(t[k]) for k in ("points", "low", "high", "total"))) for t in trees]


_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("v", pa.int64())])


def _sums(books: np.ndarray, reach: int):
    """Sum of each component (``at``) and count (``at`` -1) of every entry's
    parts in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [Book(b, reach) for b in books]
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for _, trees in _trees(batch, books.shape[2]):
                for p, (_, points, low, high, total) in enumerate(trees):
                    for node, a, z, entry in send_down(ready[p], points, low, high):
                        if isinstance(entry, int):
                            sums[p, entry] += total[node]
                            counts[p, entry] += z - a
                        else:
                            np.add.at(sums[p], entry, points[a:z])
                            np.add.at(counts[p], entry, 1)
        part, entry = np.nonzero(counts)
        if len(part):
            width = books.shape[2] + 1
            v = np.concatenate([counts[part, entry][:, None], sums[part, entry]], axis=1)
            flat = [np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(-1, width - 1), len(part)), v.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(flat, _SUMS)], schema=_SUMS)

    return run


def _codes(books: np.ndarray, reach: int, label_type: pa.DataType):
    schema = pa.schema([("vec_id", pa.int64()), ("label", label_type), ("code", pa.string()), ("error", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [Book(b, reach) for b in books]
        for batch in batches:
            for row, trees in _trees(batch, books.shape[2]):
                ids, labels = (batch.column(c).slice(row, 1).flatten() for c in ("ids", "labels"))
                code, error = np.zeros((len(ids), len(books)), np.uint8), np.zeros(len(ids), np.int64)
                for p, (order, points, low, high, _) in enumerate(trees):
                    mine = np.zeros(len(ids), np.int64)
                    for _, a, z, entry in send_down(ready[p], points, low, high):
                        mine[a:z] = entry
                    off = points - books[p][mine]
                    code[order, p] = mine
                    error[order] += (off * off).sum(axis=1)
                text = pa.array([c.tobytes().hex() for c in code], pa.string())
                yield pa.RecordBatch.from_arrays([ids, labels, text, pa.array(error)], schema=schema)

    return run


def _quantised(vector: Column) -> tuple[Column, Column]:
    """Whether all components are finite, and floor(1024 x) of them."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite, F.transform(vector, lambda x: F.floor(x * 1024))


def compress_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
) -> DataFrame:
    """One row per kept row: vec_id, code, error, label_error, codebooks_sha256.

    A null vector, or one with a null, infinite or NaN component, is dropped.
    Component x becomes floor(1024 x).  A codebook starts as the parts of the
    ``entries`` rows of smallest id (null ids come last; rows of one id in the
    order of their vectors) and takes ``rounds`` rounds of Lloyd's algorithm;
    ties go to the lower entry, unused entries stay.  Fewer rows give smaller
    codebooks.  Vectors shorter than the longest, or than the next multiple of
    ``parts``, count as filled up with zeros.  Repeated rows count each; null
    labels are one label.  Components are so small that squared distances fit
    a long (below 2**26 for 64 components), else an error says so.  Other
    columns are not read; an empty table gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    fine, ints = _quantised(F.col(vec_col).cast("array<double>"))
    rows = vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), ints.alias("v"))
    label = rows.schema["label"].dataType
    reach = F.array_max(F.transform("v", lambda x: F.abs(x)))
    seen = rows.agg(F.max(F.size("v")).alias("longest"), F.max(reach).alias("reach")).first()
    width = max(1, -(-(seen["longest"] or 0) // parts))
    dim, reach = width * parts, int(seen["reach"] or 0)
    if bound(width, reach) >= MOST:
        raise ValueError("vector components are too large: squared distances do not fit a long")

    # written first: a collected top list would come to the driver once a task
    first = written(rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries), "first")
    first = first.orderBy(F.asc_nulls_last("vec_id"), "v").collect()
    held = np.zeros((len(first), dim), np.int64)
    for i, r in enumerate(first):
        held[i, : len(r["v"])] = r["v"]
    books = np.stack(np.split(held, parts, axis=1))

    schema = StructType([StructField("ids", ArrayType(LongType())), StructField("labels", ArrayType(label)), StructField("trees", _TREES)])
    kind = to_arrow_type(label)
    trees = written(rows.mapInArrow(_blocks(dim, parts, kind), schema), "trees")
    for _ in range(rounds if len(first) else 0):
        sums = trees.select("trees").mapInArrow(_sums(books, reach), "part int, entry int, at int, v long").groupBy("part", "entry", "at").agg(F.sum("v").alias("v"))
        got = {(r["part"], r["entry"], r["at"]): r["v"] for r in sums.collect()}  # as many as the codebooks have numbers
        books = books.copy()
        for part, entry in {k[:2] for k in got}:
            n = got[part, entry, -1]
            books[part, entry] = [got[part, entry, i] // n for i in range(width)]

    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = StructType([StructField("vec_id", LongType()), StructField("label", label)])
    out = out.add("code", "string").add("error", "long")
    coded = written(trees.mapInArrow(_codes(books, reach, kind), out), "codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
