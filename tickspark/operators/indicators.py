"""Moving averages and market-hours flags.

EMA(period) as the chart computes it: the seed is the mean of the first
min(period, n) closes and is held for the first ``period`` rows; afterwards
``ema = (close - ema) * 2/(period+1) + ema``.

Two forms:

* ``ema_series`` folds a bounded series (the newest N candles a chart
  loads) per symbol with ``aggregate`` over the sorted array.
* ``ema_rolling`` handles unbounded history. A step is the affine map ``e -> b * e + a * close``, so any
  stretch of rows is one pair (A, B): ``e -> B * e + A``. Rows are cut into (key, time chunk) groups
  and these into blocks of a bounded number of rows. Inside a block the sum of ``a * close / b**j``
  is a running window sum; blocks compose to chunks and chunks, one row each, to the value every
  chunk starts from. Each row's EMA is then ``b**r * (start + sum)``: exact, no warm-up, no
  sequential pass over a key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickspark.operators.rolling import CHUNK_COL, OWN_COL, TARGET_CHUNK_ROWS, halo_window, with_halo
from tickspark.schemas import EMA_PERIOD

#: Rows of a block at most. Weights grow by 1/b a row inside a block; the bound keeps them below 1e150.
BLOCK_ROWS = 4096


def ema_series(series: DataFrame, keys: Sequence[str], pos_col: str, value_col: str = "close",
               period: int = EMA_PERIOD, carry: Sequence[str] = ()) -> DataFrame:
    """EMA of a bounded per-key series ordered by ``pos_col`` (0-based).
    ``carry`` columns ride along in the sorted array, so callers need no join
    back to the series."""
    keys = list(keys)
    mult = 2.0 / (period + 1)
    g = series.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        F.col(pos_col).alias("p"), F.col(value_col).alias("v"), *[F.col(c) for c in carry]))).alias("s"))
    head = F.slice("s", 1, period)
    seed = F.aggregate(head, F.lit(0.0), lambda acc, x: acc + x["v"]) / F.least(F.size("s"), F.lit(period))
    fold = F.aggregate(
        "s", F.struct(seed.alias("e"), F.array().cast("array<double>").alias("out")),
        lambda acc, x: F.when(x["p"] < period, F.struct(acc["e"].alias("e"), F.concat(acc["out"], F.array(acc["e"])).alias("out")))
        .otherwise(F.struct(((x["v"] - acc["e"]) * mult + acc["e"]).alias("e"),
                            F.concat(acc["out"], F.array((x["v"] - acc["e"]) * mult + acc["e"])).alias("out"))))
    z = g.select(*keys, F.arrays_zip(F.col("s"), fold["out"].alias("o")).alias("z"))
    return z.select(*keys, F.inline("z")).select(*keys, F.col("s.p").alias(pos_col), F.col("s.v").alias(value_col),
                                                 *[F.col(f"s.{c}").alias(c) for c in carry], F.col("o").alias("ema"))


def _averages(df: DataFrame, keys: list[str], time_col: str, value_col: str, period: int, chunk_seconds: int | None,
              target_rows: int, with_sma: bool) -> DataFrame:
    """Rows of ``df`` with ``pos`` (0-based in the key), ``ema`` and, if asked for, ``sma`` (null until
    ``period`` rows), from one shuffle of the rows by (key, chunk)."""
    part = keys + [CHUNK_COL]
    cols = df.columns
    h = with_halo(df, keys, [time_col], time_col, period - 1 if with_sma else 0, chunk_seconds, with_offsets=True,
                  target_rows=target_rows)
    w = halo_window(keys, [time_col])
    if with_sma:
        last = w.rowsBetween(-(period - 1), 0)
        h = h.withColumn("sma", F.when(F.count(F.lit(1)).over(last) == period, F.avg(value_col).over(last)))
        cols = cols + ["sma"]
    own = h.withColumn("_i", F.sum(F.col(OWN_COL).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1) \
           .filter(F.col(OWN_COL)).withColumn("pos", (F.col("_off") + F.col("_i")).cast("long"))
    a = 2.0 / (period + 1)
    b = 1.0 - a
    block = BLOCK_ROWS if b == 0 else max(1, min(BLOCK_ROWS, int(math.log(1e150) / -math.log(b))))
    # rows inside the first period hold the seed: no step, weight 1
    steps = (F.col("pos") >= period).cast("int")
    own = own.withColumn("_b", F.floor(F.col("_i") / block))
    so_far = Window.partitionBy(*part, "_b").orderBy(time_col).rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_step", steps).withColumn("_r", F.sum("_step").over(so_far).cast("double"))
    weight = F.when(F.col("_step") == 1, F.lit(a) * F.col(value_col) * F.pow(F.lit(b), -F.col("_r"))).otherwise(F.lit(0.0))
    if b == 0:
        weight = F.when(F.col("_step") == 1, F.col(value_col)).otherwise(F.lit(0.0))
    own = own.withColumn("_p", F.sum(weight).over(so_far))
    seeds = (own.filter(F.col("pos") < period).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.col(value_col).alias("v")))).alias("_h"))
        .select(*keys, (F.aggregate("_h", F.lit(0.0), lambda acc, x: acc + x["v"]) / F.size("_h")).alias("_seed")))
    if b == 0:  # an average over one row is that row
        out = own.withColumn("ema", F.col(value_col))
        return out.select(*cols, "pos", "ema")
    starts = _chunk_starts(own, seeds, keys, b)
    block_start = F.element_at("_starts", (F.col("_b") + 1).cast("int"))
    out = own.join(starts, part).withColumn("ema", F.pow(F.lit(b), F.col("_r")) * (block_start + F.col("_p")))
    return out.select(*cols, "pos", "ema")


def _chunk_starts(own: DataFrame, seeds: DataFrame, keys: list[str], b: float) -> DataFrame:
    """(keys, chunk, _starts): the EMA before each block of the chunk, from the blocks' affine pairs."""
    part = keys + [CHUNK_COL]
    gain = F.pow(F.lit(b), F.col("_n"))
    # the block's last row has its running sum: (B, A) = (b**n, b**n * sum)
    blocks = (own.groupBy(*part, "_b").agg(F.max("_r").alias("_n"), F.max_by("_p", "pos").alias("_p"))
              .select(*part, "_b", gain.alias("_g"), (gain * F.col("_p")).alias("_a")))
    pairs = blocks.groupBy(*part).agg(F.array_sort(F.collect_list(F.struct("_b", "_g", "_a"))).alias("_blocks"))
    pairs = pairs.withColumn("_chunk_map", F.aggregate(
        "_blocks", F.struct(F.lit(1.0).alias("g"), F.lit(0.0).alias("a")),
        lambda m, x: F.struct((m["g"] * x["_g"]).alias("g"), (m["a"] * x["_g"] + x["_a"]).alias("a"))))
    # chunks of a key, one row each, composed in order
    by_key = (pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(CHUNK_COL).alias("c"), "_chunk_map"))).alias("_chunks"))
              .join(seeds, keys))
    starts = F.aggregate(
        "_chunks", F.struct(F.col("_seed").alias("e"), F.array().cast("array<double>").alias("out")),
        lambda s, x: F.struct((s["e"] * x["_chunk_map"]["g"] + x["_chunk_map"]["a"]).alias("e"),
                              F.concat(s["out"], F.array(s["e"])).alias("out")))
    chunk_start = by_key.select(*keys, F.explode(F.arrays_zip(F.col("_chunks"), starts["out"].alias("_e"))).alias("z")) \
                        .select(*keys, F.col("z._chunks.c").alias(CHUNK_COL), F.col("z._e").alias("_e"))
    inner = F.aggregate(
        "_blocks", F.struct(F.col("_e").alias("e"), F.array().cast("array<double>").alias("out")),
        lambda s, x: F.struct((s["e"] * x["_g"] + x["_a"]).alias("e"), F.concat(s["out"], F.array(s["e"])).alias("out")))
    return pairs.join(chunk_start, part).select(*part, inner["out"].alias("_starts"))


def ema_rolling(df: DataFrame, keys: Sequence[str], time_col: str = "time", value_col: str = "close",
                period: int = EMA_PERIOD, chunk_seconds: int | None = None,
                target_rows: int = TARGET_CHUNK_ROWS) -> DataFrame:
    """EMA over the whole history of every key (see module doc): the input columns plus ``pos`` (0-based
    row index within the key) and ``ema``. Times are unique in a key."""
    return _averages(df, list(keys), time_col, value_col, period, chunk_seconds, target_rows, with_sma=False)


def sma_rolling(df: DataFrame, keys: Sequence[str], time_col: str = "time", value_col: str = "close",
                period: int = 20, chunk_seconds: int | None = None) -> DataFrame:
    """Simple moving average of the last ``period`` rows (null until full)."""
    keys = list(keys)
    h = with_halo(df, keys, [time_col], time_col, period - 1, chunk_seconds)
    w = halo_window(keys, [time_col]).rowsBetween(-(period - 1), 0)
    h = h.withColumn("sma", F.when(F.count(F.lit(1)).over(w) == period, F.avg(value_col).over(w)))
    return h.filter(F.col(OWN_COL)).drop(OWN_COL, CHUNK_COL)


def moving_averages(candles_df: DataFrame, period: int = 20, chunk_seconds: int | None = None,
                    target_rows: int = TARGET_CHUNK_ROWS) -> DataFrame:
    """Long-form moving_averages table: SMA and EMA of the close per
    (symbol, window_sec, time), both from one pass over the candles."""
    keys = ["symbol", "window_sec"]
    both = _averages(candles_df.select("symbol", "window_sec", "time", "close"), keys, "time", "close", period,
                     chunk_seconds, target_rows, with_sma=True)
    kinds = F.array(F.struct(F.lit("SMA").alias("ma_type"), F.col("sma").alias("ma_value")),
                    F.struct(F.lit("EMA").alias("ma_type"), F.col("ema").alias("ma_value")))
    out = both.select("time", "symbol", "window_sec", F.inline(kinds)).filter(F.col("ma_value").isNotNull())
    return out.withColumn("event_id", F.sha2(F.concat_ws("_", "symbol", F.col("window_sec").cast("string"),
                                                         "ma_type", F.col("time").cast("string")), 256))
