"""Shared folder, sampling and hashed text features used by the operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
import zlib
from contextlib import contextmanager, suppress

import numpy as np
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries kept in a worker's word cache before it starts anew.
CACHE_WORDS = 100_000
#: Rows that travel to a Python worker at once, at most.
BATCH_ROWS = 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="meshlake-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = f"file://{base}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Let at most BATCH_ROWS rows travel to Python at once, in this session from now on.

    Texts may be long: the default of 10,000 rows can be gigabytes in a worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


_scopes: list[list[str]] = []


def scratch(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path below the shared folder; it goes with the innermost ``temporary`` unless kept."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes and not keep:
        _scopes[-1].append(path)
    return path


@contextmanager
def temporary(spark: SparkSession):
    """Delete at the end what was written down inside, but for what was kept."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)
        free_shuffles(spark)


def unused(name: str, taken: list[str]) -> str:
    """A column name that is not among those taken, in any case of letters."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there."""
    spark, schema = df.sparkSession, df.schema
    bound_batches(spark)
    path = scratch(spark, name, keep)
    df.write.parquet(path)
    trim_jvm(spark)
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialise`` wrote down for these frames: nothing reads them any more."""
    for df in frames:
        delete(df.sparkSession, df.written_to)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now.

    It drops them when the driver collects garbage, which a long job with a small
    driver may not do before its executors' disks are full.
    """
    gc.collect()
    with suppress(OSError, AttributeError):  # what Python has freed goes back to the system, where the C library can do that
        ctypes.CDLL(None).malloc_trim(0)
    spark.sparkContext._jvm.System.gc()
    trim_jvm(spark)


def trim_jvm(spark: SparkSession) -> None:
    """Let the driver's JVM give freed native memory back to the system, where it can do that.

    Its compiler and buffers take and free such memory in many threads, and the C library
    keeps what is free between what is in use: hundreds of MB beside the heap in a long job.
    """
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    with suppress(Py4JError):
        # the server's own class is not open to reflection, its interface is
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        given = new(jvm.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        given[2], given[3] = new(jvm.Object, 0), new(jvm.String, 0)
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)


def trim_python(batches):
    """The batches as they come, after this process has given memory that it has freed back to the system."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    yield from batches


def trim_executors(spark: SparkSession) -> None:
    """Let executors and their Python workers give memory that nothing uses any more back to the system.

    A heap that one step has filled stays as large in the next, beside the Python workers of that;
    over many steps the parts reach their largest sizes together. A full collection shrinks it.
    A task a core, so that idle executors get one each; in local mode the driver is the executor.
    """
    context = spark.sparkContext
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        return
    n = context.defaultParallelism
    spark.range(0, n, 1, n).mapInArrow(trim_python, "id long").selectExpr("reflect('java.lang.System', 'gc') as done").collect()


def crc_mod(column: str, n: int):
    """crc32 of the column as text, modulo n (null stays null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def below_fraction(columns: list[str], fraction: float, seed: int):
    """A repeatable choice of about ``fraction`` of the rows, by a 63-bit hash of some columns.

    The threshold has 63 bits, so that a fraction far below one in a million still draws.
    """
    if fraction >= 1:
        return F.lit(True)
    hashed = F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit((1 << 63) - 1).cast("long"))
    return hashed < F.lit(int(max(0.0, fraction) * (1 << 63))).cast("long")


def bounded_rows(rows: DataFrame, limit: int, seed: int) -> DataFrame:
    """About ``limit`` of the distinct rows (doc_id, text, ...) at most.

    Rows are drawn by id and text, so the many rows of one repeated id are drawn like
    any others, and equal rows count once.
    """
    n = rows.select("doc_id").count()
    return rows.where(below_fraction(["doc_id", "text"], limit / max(1, n), seed)).dropDuplicates(["doc_id", "text"])


BASE = 0x9E3779B97F4A7C15  #: odd, so that it has an inverse modulo 2 ** 64
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 18)
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(x), np.uint64)]), dtype=np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: list, table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts (bytes, str or None), one after another, and the offsets of the texts.

    ``table`` translates bytes; what it makes a blank separates words. A word's hash is
    a polynomial of its bytes, from running sums over all bytes at once.
    """
    plain = [((t.encode() if isinstance(t, str) else t) or b"").translate(table) if t else b"" for t in texts]
    letters = np.frombuffer(b" ".join(plain) + b" ", np.uint8)
    sizes = np.array([len(t) + 1 for t in plain], np.int64)
    border = np.flatnonzero(np.diff(letters != 32, prepend=False, append=False))
    start, end = border[::2], border[1::2]
    up, down = powers(len(letters) + 1)
    run = np.concatenate([[np.uint64(0)], np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * up[: len(letters)], dtype=np.uint64)])
    h = (run[end] - run[start]) * down[start]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h, np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))


def texts_of(batch) -> list:
    """The texts of an Arrow batch, as bytes."""
    import pyarrow as pa

    column = batch.column("text")
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def portions(texts: list, size: int):
    """Runs (first, last) of texts of about ``size`` bytes."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or b"")
        if total >= size:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


class WordIds(dict):
    """Bytes of a word to a feature number below ``1 << bits``, kept in a bounded cache."""

    def __init__(self, bits: int):
        self.mask = (1 << bits) - 1

    def __missing__(self, word: bytes) -> int:
        number = self[word] = zlib.crc32(word) & self.mask
        return number

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Remembers:
    """A cache that lives and goes with its object, and does not travel with it."""

    def cache(self, make):
        """What ``make`` made the first time, in this process."""
        if "_cache" not in self.__dict__:
            self.__dict__["_cache"] = make()
        return self.__dict__["_cache"]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_cache"}


def add_counts(parts: DataFrame, size: int, column: str = "counts") -> np.ndarray:
    """Sum of int64 vectors, one from each partition, by way of combining tasks.

    ``parts`` has one binary row for each input partition. Where there are many shuffle
    partitions they meet in as many tasks first; then in eight, so the driver gets at
    most eight rows of ``8 * size`` bytes, whatever the input.
    """

    def combine(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for blob in batch[column]:
                total += np.frombuffer(blob, np.int64)
        import pandas as pd

        yield pd.DataFrame({column: [total.tobytes()]})

    bound_batches(parts.sparkSession)
    first = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if first > 64:
        parts = parts.repartition(first).mapInPandas(combine, f"{column} binary")
    total = np.zeros(size, np.int64)
    for r in parts.repartition(8).mapInPandas(combine, f"{column} binary").toLocalIterator():
        total += np.frombuffer(r[0], np.int64)
    return total


def csr(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated entries and the offsets of each row."""
    sizes = np.array([len(r) for r in rows], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    return (np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)), at


def sum_rows(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values[at[i]:at[i + 1]]``; zero for empty rows."""
    n = len(at) - 1
    out = np.zeros((n, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, at[full], axis=0)
    return out
