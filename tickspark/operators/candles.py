"""Tumbling OHLCV/VWAP candles, rollups and candle-level flags.

Grouping key is (symbol, window_sec, bucket start): even a hot symbol spreads
over many buckets, and the aggregate is algebraic (min/max/sum/count plus
min_by/max_by keyed by one ``long``), so Spark plans a HashAggregate that
combines map-side before the shuffle: one partial row per key and map task
moves, and nothing is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickspark.functions.timefn import bucket_start, epoch_micros, event_order_key, plus_seconds
from tickspark.schemas import CANDLE_WINDOWS

CANDLE_COLUMNS = ["time", "symbol", "window_sec", "open", "high", "low", "close",
                  "volume", "vwap", "trade_count", "window_end"]


def candle_input(ticks: DataFrame) -> DataFrame:
    """Ticks usable for candles: a symbol and a non-zero timestamp are required;
    missing price/volume count as 0 (the processor's defaults)."""
    return (ticks
            .filter(F.col("symbol").isNotNull() & (F.col("symbol") != "")
                    & F.col("time").isNotNull() & (epoch_micros("time") != 0))
            .select("symbol", "time", "event_id",
                    F.coalesce(F.col("price").cast("double"), F.lit(0.0)).alias("price"),
                    F.coalesce(F.col("volume").cast("long"), F.lit(0)).alias("volume")))


def _ohlcv(grouped_src: DataFrame, keys: list[str]) -> DataFrame:
    order_key = event_order_key("time", "event_id")
    agg = grouped_src.groupBy(*keys).agg(
        F.min_by("price", order_key).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order_key).alias("close"),
        F.sum("volume").alias("volume"),
        F.sum(F.col("price") * F.col("volume")).alias("_pv"),
        F.count(F.lit(1)).alias("trade_count"),
    )
    return agg.withColumn(
        "vwap", F.when(F.col("volume") > 0, F.col("_pv") / F.col("volume")).otherwise(F.col("open")))


def candles(ticks: DataFrame, window_sec: int, keep_pv: bool = False) -> DataFrame:
    """OHLCV + VWAP + trade_count for one tumbling window size. ``keep_pv``
    keeps the exact sum of price*volume (``_pv``) for later rollups."""
    src = candle_input(ticks).withColumn("bucket", bucket_start("time", window_sec))
    out = _ohlcv(src, ["symbol", "bucket"])
    extra = ["_pv"] if keep_pv else []
    return (out.withColumn("window_sec", F.lit(window_sec).cast("int"))
            .withColumn("time", F.col("bucket"))
            .withColumn("window_end", plus_seconds("bucket", window_sec))
            .select(*CANDLE_COLUMNS, *extra))


def candles_exploded(ticks: DataFrame, windows: Sequence[int] = CANDLE_WINDOWS) -> DataFrame:
    """All window sizes in one aggregation (fan-out by ``explode``)."""
    src = (candle_input(ticks)
           .withColumn("window_sec", F.explode(F.array(*[F.lit(int(w)) for w in windows])))
           .withColumn("bucket", bucket_start("time", F.col("window_sec"))))
    out = _ohlcv(src, ["symbol", "window_sec", "bucket"])
    return (out.withColumn("time", F.col("bucket"))
            .withColumn("window_end", plus_seconds("bucket", F.col("window_sec")))
            .select(*CANDLE_COLUMNS))


def rollup(candles_df: DataFrame, target_sec: int) -> DataFrame:
    """Re-aggregate candles into a coarser window: open of the first candle,
    close of the last, high/low extremes, volume and count summed, vwap
    volume-weighted (falls back to the rolled open when volume is 0). Uses
    the carried ``_pv`` when present, else vwap * volume."""
    pv = F.col("_pv") if "_pv" in candles_df.columns else F.col("vwap") * F.col("volume")
    src = candles_df.withColumn("bucket", bucket_start("time", target_sec)).withColumn("_pv_in", pv)
    agg = src.groupBy("symbol", "bucket").agg(
        F.min_by("open", F.col("time")).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", F.col("time")).alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("_pv_in").alias("_pv"),
        F.sum("trade_count").alias("trade_count"),
    )
    return (agg
            .withColumn("vwap", F.when(F.col("volume") > 0, F.col("_pv") / F.col("volume")).otherwise(F.col("open")))
            .withColumn("window_sec", F.lit(target_sec).cast("int"))
            .withColumn("time", F.col("bucket"))
            .withColumn("window_end", plus_seconds("bucket", target_sec))
            .select(*CANDLE_COLUMNS))


def candles_multi(ticks: DataFrame, windows: Sequence[int] = CANDLE_WINDOWS) -> DataFrame:
    """Several window sizes in one aggregation over the ticks.

    Each tick is fanned out once per window size before a single
    HashAggregate keyed by (symbol, window_sec, bucket). The map-side partial
    aggregate collapses every window's buckets before the shuffle, so the
    shuffle carries about sum(1/w) of the finest window's partial rows
    (1.27x for 60/300/900 s) in one stage, and every sum is taken over the
    ticks themselves (same values as a per-window aggregation). Coarser
    candles from already stored ones: ``rollup``."""
    return candles_exploded(ticks, windows)


def volume_direction(candles_df: DataFrame) -> DataFrame:
    """Bar colour of the volume chart: up when close >= open."""
    return candles_df.withColumn(
        "direction", F.when(F.col("close") >= F.col("open"), F.lit("up")).otherwise(F.lit("down")))


def candle_update_log(ticks: DataFrame, windows: Sequence[int] = CANDLE_WINDOWS) -> DataFrame:
    """What a continuous candle job appends per micro-batch (``batch_id``
    column on the ticks): for every candle a batch touches, the candle's
    state over all ticks up to and including that batch. The running state
    is a window over the batches of one candle (few rows per key)."""
    src = (ticks.filter(F.col("symbol").isNotNull() & (F.col("symbol") != "") & (epoch_micros("time") != 0))
           .select("symbol", "time", "event_id", "batch_id",
                   F.coalesce(F.col("price").cast("double"), F.lit(0.0)).alias("price"),
                   F.coalesce(F.col("volume").cast("long"), F.lit(0)).alias("volume"))
           .withColumn("window_sec", F.explode(F.array(*[F.lit(int(w)) for w in windows])))
           .withColumn("bucket", bucket_start("time", F.col("window_sec"))))
    key = event_order_key("time", "event_id")
    per = src.groupBy("symbol", "window_sec", "bucket", "batch_id").agg(
        F.min(key).alias("_first_key"), F.min_by("price", key).alias("_first"),
        F.max(key).alias("_last_key"), F.max_by("price", key).alias("_last"),
        F.max("price").alias("_high"), F.min("price").alias("_low"),
        F.sum("volume").alias("_vol"), F.sum(F.col("price") * F.col("volume")).alias("_pv"),
        F.count(F.lit(1)).alias("_n"))
    w = (Window.partitionBy("symbol", "window_sec", "bucket").orderBy("batch_id")
         .rowsBetween(Window.unboundedPreceding, 0))
    cum = per.select(
        "symbol", "window_sec", "batch_id", F.col("bucket").alias("time"),
        F.min_by("_first", "_first_key").over(w).alias("open"), F.max("_high").over(w).alias("high"),
        F.min("_low").over(w).alias("low"), F.max_by("_last", "_last_key").over(w).alias("close"),
        F.sum("_vol").over(w).alias("volume"), F.sum("_pv").over(w).alias("_pv"),
        F.sum("_n").over(w).alias("trade_count"))
    return (cum.withColumn("vwap", F.when(F.col("volume") > 0, F.col("_pv") / F.col("volume")).otherwise(F.col("open")))
            .withColumn("window_sec", F.col("window_sec").cast("int"))
            .withColumn("window_end", plus_seconds("time", F.col("window_sec")))
            .drop("_pv"))
