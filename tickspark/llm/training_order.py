"""Training-order materialisation: token sequences at a keyed pseudo-random global slot, in shards of
fixed-stride records.

Texts become token ids, an end token, and records of equal length (the last one of a document filled
up with the end token). Records get a gapless index, and a keyed Feistel network over the smallest
even-bit domain that holds them all, walked along its cycle until it lands inside, gives each index
its slot: a permutation that anyone can invert or resume from the key and the count alone. Shards are
ranges of as many slots each; a task gets one shard and writes it in slot order, as one Parquet file of
records of a fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickspark.llm.common import freed_shuffles, gathered, mix64, stored, text_batches
from tickspark.llm.word_bpe import ID, TOGETHER, WordBpe, worker_bpe

#: Tokens a record; ids are two bytes, little endian.
TOKENS = 512
#: Records a shard: 64 MB, a task's work. Shards are the partitions of the one shuffle, so very large tables take more.
SHARD_RECORDS = 65_536
KEY = 20_240_131
ROUNDS = 6
COLUMNS = ["slot", "shard", "position", "doc_id", "part", "n_tokens", "record"]
_SHARDS = "slot long, position long, doc_id long, part long, n_tokens int, record binary, shard long"


def feistel(index: np.ndarray, count: int, key: int = KEY) -> np.ndarray:
    """Slot in [0, count) of each index in [0, count): a bijection for every key."""
    half = max(1, (max(1, count - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix64(np.arange(ROUNDS, dtype=np.uint64) + np.uint64(key % (1 << 63)))
    out = np.asarray(index, np.int64).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= np.uint64(count)]
    return out.astype(np.int64)


def _records(path: str, tokens: int, end: int):
    def run(batches):
        bpe = worker_bpe(path)
        for b in gathered(batches, 1, TOGETHER):
            packed = bpe.encode_packed([t or "" for t in b.column(1).to_pylist()])
            n = np.array([len(ids) // ID.itemsize + 1 for ids in packed], np.int64)
            many = -(-n // tokens)
            first = np.cumsum(many) - many
            flat = np.full(int(many.sum()) * tokens, end, "<u2")
            for at, ids in zip((first * tokens).tolist(), packed, strict=True):
                flat[at:at + len(ids) // ID.itemsize] = np.frombuffer(ids, ID)
            of = np.repeat(np.arange(len(n)), many)
            part = np.arange(len(of)) - first[of]
            record = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * tokens), len(of), [None, pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), pa.array(part),
                                              pa.array(np.minimum(tokens, n[of] - part * tokens).astype(np.int32)),
                                              record.cast(pa.binary())], names=["doc_id", "part", "n_tokens", "record"])
    return run


def training_order(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokens: int = TOKENS,
                   shard_records: int = SHARD_RECORDS, key: int = KEY, end: str = "<|endoftext|>") -> DataFrame:
    """One row a record, a partition a shard, in slot order: slot (gapless from 0), shard, position in its shard, doc_id,
    part (from 0 in its document), n_tokens (before filling), record (binary, 2 * tokens bytes).

    Null and empty texts give one record of end tokens. Null and repeated ids are kept as they are;
    each row of the input gives its own records. An empty table gives no rows. Other columns play no
    role. Vocabularies of more than 65,536 ids do not fit and are refused.
    """
    spark = docs.sparkSession
    text_batches(spark)
    bpe = WordBpe(path)
    if max(bpe.tokens) >= 1 << 16:
        raise ValueError("ids need more than two bytes")
    made = docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(
        _records(path, tokens, bpe.special[end]), "doc_id long, part long, n_tokens int, record binary")
    # where a record stands in its own file; the stored files no longer change, so neither does that
    made = stored(made.select("doc_id", "part", "n_tokens", "record", F.spark_partition_id().alias("_file"),
                              F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")))
    sizes = made.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    before = sizes.select("_file", (F.sum("_n").over(
        Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(feistel(index.to_numpy(), total, key))

    placed = (made.join(F.broadcast(before), "_file").withColumn("slot", slot(F.col("_before") + F.col("_at")))
              .select("slot", F.floor(F.col("slot") / shard_records).cast("long").alias("shard"),
                      (F.col("slot") % shard_records).alias("position"), "doc_id", "part", "n_tokens", "record"))
    # the shard is the partition: no sampling pass, no two shards on one hash
    return (placed.repartitionById(max(1, -(-total // shard_records)), F.col("shard").cast("int"))
            .sortWithinPartitions("shard", "slot"))


def write_shards(ordered: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of ``training_order``, a folder and one file a shard, records in slot order, and reads them
    back. A lost task is written again by itself: its shard is a partition of its own."""
    with freed_shuffles(ordered.sparkSession):
        ordered.write.option("compression", "zstd").partitionBy("shard").parquet(folder)
    return read_shards(ordered.sparkSession, folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All records, in no given order."""
    return spark.read.schema(_SHARDS).parquet(folder).select(*COLUMNS)


def resume(spark: SparkSession, folder: str, slot: int = 0, shard_records: int = SHARD_RECORDS) -> Iterator[DataFrame]:
    """The records from ``slot`` on, a DataFrame a shard, one after the other. A shard is one file in slot order,
    so nothing is sorted; shards before the slot are not opened."""
    shards = {int(re.search(r"/shard=(\d+)/", f)[1]) for f in read_shards(spark, folder).inputFiles()}
    for shard in sorted(s for s in shards if s >= slot // shard_records):
        yield read_shards(spark, folder).where((F.col("shard") == shard) & (F.col("slot") >= slot))
