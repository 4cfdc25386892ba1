"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows each input partition sends to each shard is drawn exactly as a uniform shuffle would
(a multivariate hypergeometric matrix with the partitions' row counts and the shards' sizes as
margins). Rows are permuted inside their partition by a hash, the first m go to shard 0, the next
to shard 1 and so on; each shard permutes what it got by a second hash. Only the matrix, one row a
partition, is made by the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickspark.llm.common import cut

SHARDS = 8
#: Rows that a shard orders in one task.
BLOCK_ROWS = 50_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """An exact draw of good items among n without replacement, by inverting the distribution around
    its mode; one way for all sizes."""
    lo, hi = max(0, n - bad), min(n, good)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (good + bad + 2)))
    sd = math.sqrt(max(1.0, n * (good / (good + bad)) * (bad / (good + bad))))
    a, b = max(lo, int(mode - 40 * sd) - 40), min(hi, int(mode + 40 * sd) + 40)
    up = np.arange(mode, b, dtype=np.float64)
    down = np.arange(mode, a, -1, dtype=np.float64)
    right = np.cumprod((good - up) / (up + 1) * (n - up) / (bad - n + up + 1))
    left = np.cumprod(down / (good - down + 1) * (bad - n + down) / (n - down + 1))
    weights = np.concatenate([left[::-1], [1.0], right])
    total = np.cumsum(weights)
    return a + int(np.searchsorted(total, rng.random() * total[-1], side="right"))


def matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each partition sends to each shard. Shard sizes differ by one at most."""
    rng = np.random.default_rng(seed)
    rows = sum(counts)
    left = [rows // shards + (1 if s < rows % shards else 0) for s in range(shards)]
    out = []
    for n in counts:
        line, rest = [], sum(left)
        for s in range(shards):
            take = hypergeometric(rng, left[s], rest - left[s], n)
            rest -= left[s]
            left[s] -= take
            n -= take
            line.append(take)
        out.append(line)
    return out


def shuffle_into_shards(rows: DataFrame, identity: list[str], shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """``rows`` with shard (0 to shards - 1, sizes at most one apart) and slot (gapless from 0 in its
    shard, a uniform order). ``identity`` names the columns that tell rows apart.

    Nulls in them are hashed like values; rows equal in all of them are interchangeable and each gets
    its own slot. An empty table gives no rows; with fewer rows than shards some shards are empty.
    """
    spark = rows.sparkSession
    held = cut(rows.withColumn("_part", F.spark_partition_id())
               .withColumn("_one", F.xxhash64(F.lit(seed), *identity))
               .withColumn("_two", F.xxhash64(F.lit(seed + 1), *identity)))
    counts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()  # one row a partition
    if not counts:
        return held.drop("_part", "_one", "_two").withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    sends = matrix([c.n for c in counts], shards, seed)
    bounds = spark.createDataFrame(
        [(c._part, [int(x) for x in np.cumsum(line)]) for c, line in zip(counts, sends, strict=True)],
        "_part int, _ends array<long>")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_one", "_two", *identity)) - 1
    dealt = (held.withColumn("_r", rank).join(F.broadcast(bounds), "_part")
             .withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_r")))))
    blocks = max(1, math.ceil(sum(c.n for c in counts) / shards / BLOCK_ROWS))
    # the second permutation: a block by the top of the second hash, an order inside it by the whole
    dealt = cut(dealt.withColumn("_block", F.floor(F.shiftrightunsigned("_two", 32) * blocks / float(1 << 32)).cast("int"))
                .drop("_ends", "_r", "_part"))
    sizes = dealt.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("shard", "_block", (F.sum("_n").over(
        Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_two", "_one", *identity)) - 1
    return (dealt.withColumn("_i", inner).join(before, ["shard", "_block"])
            .withColumn("slot", (F.col("_before") + F.col("_i")).cast("long"))
            .drop("_before", "_i", "_block", "_one", "_two"))


def write_shards(placed: DataFrame, path: str) -> None:
    """The rows of ``shuffle_into_shards``, whatever columns they carry, as one folder a shard, in slot
    order inside each file. Every row is written at its own place; no identity is looked up."""
    (placed.repartition("shard", F.floor(F.col("slot") / BLOCK_ROWS)).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
