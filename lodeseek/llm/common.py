"""Shared pieces: written intermediate tables, byte-level word hashing with numpy, mergeable counters."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

U64 = np.uint64


# ---------------------------------------------------------------- shared storage


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own in local mode; on a cluster that is an error."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lodeseek-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def written(df: DataFrame, name: str, within: Scratch | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{within.path if within else shared_root(spark) + '/lodeseek'}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder for the tables of one run of an operator that its result no longer reads; they go when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_root(spark)}/lodeseek/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, name, self)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a row number of its own for each row, in row_no: written, so that every reading gives a row the same one."""
    return written(docs.withColumn("row_no", F.monotonically_increasing_id()), "rows")


def ranged(rows: DataFrame, order: list[str], within: Scratch | None = None) -> DataFrame:
    """rows with the number of their range in that order, in part: written, so that every reading agrees. Ranges hold about equally many rows, whatever the keys, if no two rows are equal in the order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranged", within)


def so_far(order: list[str]) -> WindowSpec:
    """Up to each row of a range, itself included."""
    return Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def parts_before(column: Column) -> Column:
    """An aggregate over the ranges before each, of a table of one row for each range."""
    return column.over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))


def running(rows: DataFrame, order: list[str], sums: dict[str, str], within: Scratch | None = None) -> DataFrame:
    """rows with, for each name in sums, the sum of its column over the rows up to and with this one: within ranges, and over the ranges before."""
    kept = ranged(rows, order, within)
    per = kept.groupBy("part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    # a row for each range
    above = per.select("part", *[F.coalesce(parts_before(F.sum(n)), F.lit(0)).alias(f"__{n}") for n in sums])
    summed = kept.join(F.broadcast(above), "part").withColumns({n: F.sum(c).over(so_far(order)) + F.col(f"__{n}") for n, c in sums.items()})
    return summed.drop("part", *[f"__{n}" for n in sums])


#: A key with more than one row in so many is broadcast by looked_up; there are at most so many.
HOT = 1024


def looked_up(rows: DataFrame, names: DataFrame, keys: list[str], total: int, hot: int = HOT) -> DataFrame:
    """rows with what names(*keys, n, ...) says of their keys; n is the number of a key's rows, total their sum. Rows of keys without a name go."""
    large = F.col("n") * hot > total
    # fewer than `hot` keys can have more than a part of 1 in `hot` of all rows
    often = F.broadcast(names.where(large).drop("n"))
    rest = rows.join(F.broadcast(names.where(large).select(*keys)), keys, "left_anti").join(names.where(~large).drop("n"), keys)
    return rows.join(often, keys).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_like(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that other columns with any name cannot clash."""
    return df.select(*columns)


# ---------------------------------------------------------------- byte buffers


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, end to end, and n + 1 offsets. Null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1].copy()
    if column.null_count:
        return text_buffer(column.fill_null(""))
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


@lru_cache(maxsize=1)
def _trim():
    """The C library's call that gives freed memory back; where there is none, nothing."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers for the stages to come, beside the JVM that then needs it."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about most_bytes of text, or one row that is longer. At the end of a task its memory is given back."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        i = batch.schema.get_field_index(text)
        _, off = text_buffer(batch.column(i))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most_bytes, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
    give_back()


def byte_table(separators: bytes) -> np.ndarray:
    """True for the bytes that stand between words."""
    t = np.zeros(256, bool)
    t[list(separators)] = True
    return t


#: White space that separates words: space and \t \n \v \f \r.
SPACE = byte_table(b" \t\n\x0b\x0c\r")
#: Everything in ASCII but 0-9 and a-z; bytes of other characters belong to words.
NOT_ALNUM = byte_table(bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122)))
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the buffer, and for each row the index of its first word (n + 1 entries)."""
    n = len(data)
    if n == 0:
        e = np.empty(0, np.int64)
        return e, e, np.zeros(len(offsets), np.int64)
    word = ~separators[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


# ---------------------------------------------------------------- hashing


def splitmix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_BYTE_VALUES = splitmix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=U64)
    return _POWERS[0], _POWERS[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each span of bytes: a polynomial over byte values, read off prefix sums, then mixed with the length."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, side="right")))
        base = int(starts[i])
        seg = data[base : int(ends[j - 1])]
        up, down = _powers(len(seg) + 1)
        sums = np.zeros(len(seg) + 1, U64)
        np.cumsum(_BYTE_VALUES[seg] * up[: len(seg)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = splitmix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * U64(0xA0761D6478BD642F))
        i = j
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions of the buffer are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    h = np.zeros(n, U64)
    for j in range(k):
        h += words[j : j + n] * U64((0x9E3779B97F4A7C15 * (2 * j + 3) ** 5) & 0xFFFFFFFFFFFFFFFF | 1)
    return splitmix(h)


# ---------------------------------------------------------------- counters that merge


def pack(counts: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(counts, dtype=np.int64).tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), np.int64)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for blob in batch.column(batch.schema.get_field_index("blob")).to_pylist():
            x = unpack(blob)
            total = x.copy() if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_pydict({"blob": pa.array([pack(total)], pa.binary())})


def summed(blobs: DataFrame, width: int, fan_in: int = 16) -> np.ndarray:
    """Sum of packed counters of equal length, one or more for each task: two rounds of partial sums on executors, then at most fan_in blobs to the driver."""
    tasks = max(1, blobs.rdd.getNumPartitions())
    merged = blobs.select("blob")
    for n in (max(1, tasks // fan_in), fan_in):
        if n < tasks:
            merged = merged.repartition(n).mapInArrow(_merged, "blob binary")
            tasks = n
    total = np.zeros(width, np.int64)
    for row in merged.toLocalIterator():
        total += unpack(bytes(row["blob"]))
    return total


def sample_share(key: list, share: float):
    """A predicate that keeps about that share of the rows, the same ones in every run."""
    return F.pmod(F.xxhash64(*key), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) if share < 1 else 1_000_000)
