"""Helpers shared by the training-data operators: hashing of words and numbers in numpy, Arrow
batch sizing, materialised side tables and gapless global positions."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickspark.session import ensure_checkpoint_dir

#: Words of the raw contracts: runs of anything but the six ASCII blanks. bytes.split() on UTF-8 does the same.
RAW_WORDS = r"[^\x20\x09-\x0D]+"
#: Rows in one Arrow batch of whole texts: keeps a batch of very long documents within a worker's memory.
TEXT_BATCH_ROWS = 512

_U = np.uint64
#: The folder that holds this library.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective) over a uint64 array."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform doubles in (0, 1) from the top 53 bits of uint64 hashes."""
    return ((x >> _U(11)).astype(np.float64) + 0.5) * (1.0 / 9007199254740992.0)


class WordHashes(dict):
    """bytes -> 64-bit hash, remembered per task; ``trim`` bounds its size."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        v = self[word] = xxhash.xxh64_intdigest(word)
        return v

    def array(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        if len(self) > self.LIMIT:
            self.clear()
        return out


def rolling(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Mixed hash of every k consecutive values (length n - k + 1, empty when n < k)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    odd = mix64(np.arange(1, k + 1, dtype=np.uint64) + _U(seed * 1000)) | _U(1)
    acc = h[:n] * odd[0]
    for j in range(1, k):
        acc += h[j:j + n] * odd[j]
    return mix64(acc)


def as_long(x: np.ndarray) -> np.ndarray:
    """uint64 hashes as Spark longs (same bits)."""
    return np.ascontiguousarray(x).view(np.int64)


def text_batches(spark: SparkSession) -> None:
    """Settings of the Python passes: small Arrow batches of whole texts, and this library's folder on
    the workers' path (a cluster that ships the library itself is not affected)."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [ROOT])
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > TEXT_BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))


def gathered(batches, column: int, size: int):
    """The batches, joined until their texts in ``column`` have ``size`` bytes."""
    held, have = [], 0
    for b in batches:
        held.append(b)
        have += b.column(column).nbytes
        if have >= size:
            yield pa.concat_batches(held)
            held, have = [], 0
    if held:
        yield pa.concat_batches(held)


#: Spark's own setting: the shuffle files of a finished write go at once, not when the driver next collects garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders that ``stored`` writes while someone records them; None: nobody does.
_recorded: list[str] | None = None


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Writes in this block need their shuffles no more once they are done: what they wrote ends the lineage."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


@contextmanager
def recorded(folders: list[str]):
    """Adds the folders that ``stored`` writes in this block to ``folders``."""
    global _recorded
    before, _recorded = _recorded, folders
    try:
        yield
    finally:
        _recorded = before


def release(spark: SparkSession, folders: list[str], reader: DataFrame) -> None:
    """Deletes the tables in ``folders``, but for those that ``reader`` reads, and takes them off the list."""
    read_by = {os.path.basename(os.path.dirname(f)) for f in reader.inputFiles()}
    for folder in [f for f in folders if os.path.basename(f) not in read_by]:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        folders.remove(folder)


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write as Parquet into the session's shared checkpoint folder and read back: ends the lineage as a
    checkpoint does, in fewer bytes and without what the optimiser has inferred so far, which would
    grow from round to round in iterative operators. The shuffle files of the write are freed."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    if _recorded is not None:
        _recorded.append(path)
    with freed_shuffles(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``stored`` for narrow tables of numbers, which are not worth much packing."""
    return stored(df, "lz4")


#: Bytes of a bitmap of Spark's, and the most that the bitmaps of one table may have to be broadcast.
BITMAP_BYTES = 4096
BROADCAST_BYTES = 32 << 20


def flagged(rows: DataFrame, key: str, flags: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with the boolean columns ``names`` of the row of ``flags`` that has the same ``key`` (false where there is
    none). Keys are what monotonically_increasing_id gave out, a row each.

    The flags are kept as bitmaps, a bit a row and name, and while those have no more than BROADCAST_BYTES they
    are sent to ``rows``, which stay where they are, however wide; beyond that Spark joins the two as it sees fit."""
    lot, bit = (f(F.col(key) + 1) for f in (F.bitmap_bucket_number, F.bitmap_bit_position))
    bits = cut(flags.groupBy(lot.alias("_lot")).agg(*[F.bitmap_construct_agg(F.when(F.col(c), bit)).alias(f"_bits{k}")
                                                      for k, c in enumerate(names)]))
    if bits.count() * BITMAP_BYTES * len(names) <= BROADCAST_BYTES:
        bits = F.broadcast(bits)
    out = rows.withColumns({"_at": lot, "_bit": bit.cast("int")}).join(bits, F.col("_at") == F.col("_lot"), "left")
    of_byte = [F.conv(F.hex(F.substring(f"_bits{k}", F.shiftright("_bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
               for k in range(len(names))]
    return out.select(*rows.columns, *[F.coalesce(F.getbit(x, F.col("_bit") % 8) == 1, F.lit(False)).alias(c)
                                       for x, c in zip(of_byte, names, strict=True)])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dense_index(df: DataFrame, part: str, order: list, out: str) -> DataFrame:
    """Gapless index from 0 over all rows: rows are numbered inside each value of ``part`` (an int
    column that orders the parts, spread evenly) and shifted by the sizes of the parts before. Only
    the table of part sizes (one row a part) meets in one task."""
    sizes = df.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    shift = sizes.select(F.col(part).alias("_p"), (F.sum("_n").over(
        Window.orderBy(part).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1)
    return (ranked.join(F.broadcast(shift), F.col(part) == F.col("_p"))
            .withColumn(out, F.col("_before") + F.col("_r")).drop("_p", "_before", "_r"))
