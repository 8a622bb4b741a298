"""What the corpus operators share: scratch tables, sizes of inputs, and bytes, words and hashes of Arrow texts."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
SALTS = 16  # tasks that share a hot key
MULTIPLIERS = np.random.Generator(np.random.PCG64(20240117)).integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where a local session names none (tests)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="regimelab-scratch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, and survives the loss of any executor."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unclashed(rows: DataFrame) -> DataFrame:
    """rows with a node of its own for each pair of node and check, the halves of a 128-bit hash: nodes that stand for two pairs, if ever, are hashed anew with their checks."""
    twice = written(rows.where("node is not null").select("node", "check").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("pairs")).where("pairs > 1").select("node"), "clashes")
    if twice.isEmpty():
        return rows
    mark = twice.withColumn("clash", F.lit(True))
    return rows.join(mark, "node", "left").withColumn("node", F.when(F.col("clash"), F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("clash")


def replaced(old: DataFrame, df: DataFrame, name: str) -> DataFrame:
    """df, which reads the written table old, as a table of its own; old goes."""
    out = written(df, name)
    for file in {f.rsplit("/", 1)[0] for f in old.inputFiles()[:1]}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    return out


def placed(df: DataFrame, name: str, salts: int = 1024) -> DataFrame:
    """df with a column 0 to salts - 1, each row's place in its input partition, which tells equal rows apart.

    Places must not change when a partition is computed anew, so a plan that shuffles is written first.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        df = written(df, "placed")
    return df.withColumn(name, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))


@functools.cache
def _heap():
    """The C library's trim, after asking it to map blocks of 2 MB or more on their own, so that they go back when freed."""
    try:
        library = ctypes.CDLL(None)
        library.mallopt(-3, 2 << 20)  # M_MMAP_THRESHOLD
        return library.malloc_trim
    except AttributeError:  # a C library without them
        return lambda _: 0


def trim() -> None:
    """Gives memory that earlier batches and tasks left free in this worker back to the system."""
    pa.default_memory_pool().release_unused()
    _heap()(0)


def column_name(df: DataFrame, base: str) -> str:
    """A name that no column of df has, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the rows of a batch sent to Python, as Spark counts rows and not bytes and texts are long; for the session, and never raised."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(key))
    if held <= 0 or held > rows:
        spark.conf.set(key, str(rows))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts; it sets numbers of partitions and buckets, never what a result holds."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0]


def parts(total: int, each: int, least: int = 1) -> int:
    return max(least, -(-total // each))


def with_totals(rows: DataFrame, key: str, spread: str, partial: list, final: list, having: str = "true") -> DataFrame:
    """rows, each with aggregates over all rows of its key: `final` aggregates what `partial` gives for each part of a key.

    A key that holds a third of the rows is dealt over SALTS tasks by a hash of `spread`: aggregates are taken by key and
    salt, then by key, and each salt that a key holds meets its key's totals.
    """
    salt, salts = column_name(rows, "salt"), column_name(rows, "salts")
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    totals = salted.groupBy(key, salt).agg(*partial).groupBy(key).agg(*final, F.collect_set(salt).alias(salts)).where(having)
    return salted.join(totals.withColumn(salt, F.explode(salts)).drop(salts), [key, salt]).drop(salt)


def raw(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as one large_binary array; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return pc.fill_null(column.cast(pa.binary()).cast(pa.large_binary()), b"")


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column one after another, and where each row starts (one more offset than rows)."""
    array = raw(column)
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch | pa.Table, column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch | pa.Table]:
    """Runs of rows with at most so many bytes of text each (one row at least), so that arrays stay small."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) if batch.num_rows else np.zeros(0, np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (two multiply and shift rounds)."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(29))) * U64(0xA0761D6478BD642F)
    return x ^ (x >> U64(32))


def words(column: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words `[^\\x20\\x09-\\x0D]+` of every row, one after another: the words, a 64-bit hash of each, and where each row's words start."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    split = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
    offsets, values = split.offsets.to_numpy().astype(np.int64), split.values
    values, offsets = values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]
    filled = pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(bool)
    if not filled.all():
        offsets = np.concatenate([[0], np.cumsum(filled)])[offsets]
        values = values.filter(pa.array(filled))
    coded = values.dictionary_encode()
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    codes = coded.indices.to_numpy()
    return values, (each[codes] if len(each) else np.zeros(0, np.uint64)), offsets


def gram_hashes(word_hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each n consecutive words; the caller leaves out those that cross a row's end."""
    count = max(0, len(word_hashes) - n + 1)
    out = np.full(count, U64(salt + 1))
    for j in range(n):
        out += word_hashes[j : j + count] * MULTIPLIERS[(j + 16 * salt) % 64]
    return mix(out)


def complete(offsets: np.ndarray, n: int) -> np.ndarray:
    """Which starts 0, 1, ... of n consecutive items lie in one row, for as many starts as gram_hashes returns."""
    total = int(offsets[-1])
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(total)
    return (room >= n)[: max(0, total - n + 1)]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after another."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts.astype(np.int64) - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
