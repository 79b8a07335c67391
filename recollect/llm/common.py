"""What the operators of this folder share: word splitting, hashing and files.

Words are the maximal runs of bytes other than space and the five ASCII
white-space controls; ``bytes.split()`` splits at exactly those bytes, so a
word is never decoded on the way.
"""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the rolling word-window hashes (arithmetic modulo 2**64).
BASE = np.uint64(0x9E3779B97F4A7C15)

_shared: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    On a cluster this is ``spark.checkpoint.dir``; a folder of our own is made
    only where that setting is empty, as in tests on one machine.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir")
    if not where:
        where = _shared.get(sc.applicationId)
        if where is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
            where = _shared[sc.applicationId] = f"file://{tempfile.mkdtemp(prefix='recollect-')}"
    return where.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session has ended, and with it the files' use
        pass


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The table outlives lost executors.  It is removed when the driver's Python
    ends, as a returned DataFrame may still read it until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/recollect/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Stored bytes of input that a block of documents holds at most, about.
BLOCK_INPUT = 256 << 20


def n_parts(spark: SparkSession, over: DataFrame | None = None) -> int:
    """Partitions for a shuffle: the session's number, and for the blocks of
    ``over`` as many more as its size in bytes asks for, since a task holds
    the fingerprints of a whole block."""
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if over is None:
        return parts
    leaves = over._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    # a leaf without statistics says nearly 2**63
    return max(parts, -(-sum(x for x in sizes if x < 1 << 60) // BLOCK_INPUT))


def block_of(blocks: int, *cols: str) -> Column:
    """A block number that depends on the columns alone, so a rerun gives the same."""
    return F.pmod(F.xxhash64(*cols), F.lit(blocks)).cast("int")


def bytes_of(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string or binary column as UTF-8 bytes, nulls as None."""
    return batch.column(name).cast(pa.binary()).to_pylist()


class WordHash(dict):
    """64-bit hash of a word, remembered while the dictionary is small."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of ``k`` consecutive entries, by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    res, off, power, g, size = np.zeros(n, np.uint64), 0, BASE, h, 1
    with np.errstate(over="ignore"):
        while True:
            if k & 1:
                res = res * power + g[off : off + n]
                off += size
            k >>= 1
            if not k:
                return mix(res)
            g = g[:-size] * power + g[size:]
            size, power = 2 * size, power * power


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def sha256_hex(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def in_slices(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size from tuples in the order of ``schema``."""
    held, held_bytes = [], 0
    for row in rows:
        held.append(row)
        held_bytes += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(held) >= most or held_bytes >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, held_bytes = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
