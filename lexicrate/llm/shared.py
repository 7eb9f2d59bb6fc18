"""Helpers that the operators of this subpackage share.

* ``staged`` cuts lineage through a Parquet table in the folder that the
  session names in ``spark.checkpoint.dir`` (shared by driver and executors).
* ``TextChunks`` and ``WordHasher`` turn Arrow string columns into numpy
  arrays, a few MB at a time, so that memory follows the chunk and not the
  partition.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, ``spark.checkpoint.dir``.

    Where that is unset, a folder in the warehouse, which a cluster shares too;
    in local mode, as in tests, a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"
    return base.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._staged_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of ``staged`` tables that are no longer read."""
    for df in tables:
        spark, path = df.sparkSession, df._staged_path
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


UNKNOWN_BYTES = 1 << 52
MOST_BUCKETS = 1 << 22


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's own estimate of the input's size, which costs no job.

    Where it knows none, as for local rows, the texts are summed up.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < UNKNOWN_BYTES:
        return size
    return df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def buckets_for(df: DataFrame, bytes_each: int, least: int = 64) -> int:
    """A number of hash buckets that grows with the input, so that each stays small."""
    return min(MOST_BUCKETS, max(least, math.ceil(estimated_bytes(df) / bytes_each)))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII rows take the built-in's fast path."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, lower)
    )


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


class TextChunks:
    """Whole documents of an Arrow string column, about ``limit`` bytes at a time.

    Iterating gives ``(lo, hi, data, offsets)``: rows ``lo..hi`` of the column,
    their UTF-8 bytes and ``hi - lo + 1`` offsets into them.  Null is empty.
    A document longer than ``limit`` makes a chunk of its own.
    """

    def __init__(self, column, limit: int = CHUNK_BYTES):
        import pyarrow as pa

        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = column.fill_null("")
        wide = pa.types.is_large_string(column.type)
        buffers = column.buffers()
        kind = np.int64 if wide else np.int32
        n = len(column)
        if n and buffers[1] is not None:
            raw = np.frombuffer(buffers[1], dtype=kind)
            self.offsets = raw[column.offset : column.offset + n + 1].astype(np.int64)
        else:
            self.offsets = np.zeros(n + 1, np.int64)
        self.data = (
            np.frombuffer(buffers[2], dtype=np.uint8)
            if buffers[2] is not None
            else np.zeros(0, np.uint8)
        )
        self.limit = limit

    def __iter__(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        offsets, lo, n = self.offsets, 0, len(self.offsets) - 1
        while lo < n:
            hi = int(np.searchsorted(offsets, offsets[lo] + self.limit, side="right")) - 1
            hi = min(n, max(hi, lo + 1))
            base = offsets[lo]
            yield lo, hi, self.data[base : offsets[hi]], offsets[lo : hi + 1] - base
            lo = hi


def byte_class(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Words are runs of bytes outside these: space and \t \n \v \f \r.
NOT_SPACE = ~byte_class(b" \t\n\x0b\x0c\r")


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Chunks that one task may number, and items that one chunk may number.
CHUNK_BITS, ITEM_BITS = 17, 20


def chunk_numbers() -> Iterator[int]:
    """Numbers for the chunks of this task, apart from those of all other tasks.

    They follow from the partition and the order of its rows.  Where a lost task
    may read its rows in another order (below a shuffle), stage the input first.
    """
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << CHUNK_BITS
    for k in range(1 << CHUNK_BITS):
        yield base + k
    raise OverflowError(f"more than {1 << CHUNK_BITS} chunks in one task: use smaller partitions")


def item_numbers(chunk: int, n: int) -> np.ndarray:
    """Numbers for the ``n`` items of a chunk, apart from those of all other chunks."""
    if n > 1 << ITEM_BITS or chunk >> (63 - ITEM_BITS):
        raise OverflowError(f"{n} items in chunk {chunk} are more than numbers")
    return (chunk << ITEM_BITS) + np.arange(n, dtype=np.int64)


def own_group(chunk: int) -> int:
    """The group of a chunk's own row: one for each chunk, beside the buckets (0 and up)."""
    return -1 - chunk


def fresh_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names like the wanted ones that clash with none of ``taken``."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


class WordHasher:
    """64-bit hashes of all words of a chunk by one prefix sum.

    A word's hash is the polynomial sum of random byte values, read off as a
    difference of prefix sums, so the cost is per byte of numpy and there is no
    Python loop over words.  Every process computes the same values.
    """

    BASE = 0x9E3779B97F4A7C17 | 2  # congruent to 3 modulo 4

    def __init__(self, lower: bool = True, word_bytes: np.ndarray = NOT_SPACE):
        rng = np.random.default_rng(20240229)
        values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if lower:
            values[65:91] = values[97:123]
        self.values, self.word_bytes = values, word_bytes
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) >= n:
            return
        n = max(n, 1 << 16)
        base = self.BASE | 1
        with np.errstate(over="ignore"):
            self.power = np.full(n, base, np.uint64)
            self.power[0] = 1
            np.multiply.accumulate(self.power, out=self.power)
            self.inverse = np.full(n, pow(base, -1, 1 << 64), np.uint64)
            self.inverse[0] = 1
            np.multiply.accumulate(self.inverse, out=self.inverse)

    def spans(self, data: np.ndarray, offsets: np.ndarray):
        """Starts and ends of the words, and the number of words of each row."""
        inside = self.word_bytes[data]
        n = len(data)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(offsets) - 1, np.int64)
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        edges = offsets[1:-1]
        edges = edges[edges < n]
        before[edges] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        after[edges[edges > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        counts = np.diff(np.searchsorted(starts, offsets))
        return starts, ends, counts

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data)
        self._powers(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.values[data] * self.power[:n], out=sums[1:])
            return mix64((sums[ends] - sums[starts]) * self.inverse[starts])


def combine(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive values (ordered)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(width):
            out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n])
    return out
