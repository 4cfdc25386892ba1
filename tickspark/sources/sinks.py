"""Table-side sources and sinks: persistence defaults, alert dedup and
enrichment, the candle upsert log, bar backfill, retention and the
day-partitioned layout that replaces hypertable chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.functions.timefn import epoch_micros, parse_epoch_or_iso
from tickspark.functions.values import truthy_coalesce, wire_number
from tickspark.schemas import BACKFILL_SOURCE, LIVE_SOURCE


def persist_ticks(parsed: DataFrame, now: Column) -> DataFrame:
    """Rows as the tick sink stores them, from fields as sent (``codec.parse_ticks``): missing price/volume
    -> 0, source -> 'unknown', event_id -> 'none'; a timestamp that is no number -> ``now``. A price or
    volume that is there but no number leaves the message out; volumes lose their fraction. bid/ask
    are not stored. Plain append (no unique key, no dedup)."""
    ts, price, volume = wire_number("timestamp"), wire_number("price"), wire_number("volume")
    ok = (F.col("price").isNull() | price.isNotNull()) & (F.col("volume").isNull() | volume.isNotNull())
    return parsed.filter(ok).select(
        F.coalesce(F.timestamp_micros(F.round(ts * F.lit(1e6)).cast("long")), now).alias("time"),
        F.col("symbol"),
        F.coalesce(price, F.lit(0.0)).alias("price"),
        F.coalesce(volume.cast("int"), F.lit(0)).alias("volume"),
        F.coalesce(F.col("source"), F.lit("unknown")).alias("source"),
        F.coalesce(F.col("event_id"), F.lit("none")).alias("event_id"))


def dedup_ticks(ticks: DataFrame) -> DataFrame:
    """Optional exactly-once view of ticks: one row per event_id."""
    return ticks.dropDuplicates(["event_id"])


def alert_time(raw_ts, now: Column) -> Column:
    """Alert time on the wire: epoch number, else ISO string ('Z' allowed),
    else ``now``."""
    return parse_epoch_or_iso(raw_ts, now)


def dedup_alerts(alerts: DataFrame, order_col: str = "_ingest") -> DataFrame:
    """First write wins on (event_id, time): ``row_number() == 1`` per key in
    arrival order (``order_col``), a partial-aggregate-free but key-local
    shuffle. Streams use ``dropDuplicatesWithinWatermark`` instead."""
    w = Window.partitionBy("event_id", "time").orderBy(F.col(order_col).asc())
    return alerts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def enrich_alerts(alerts: DataFrame) -> DataFrame:
    """Fill the typed alert columns from the metadata map, with Python
    truthiness (0, 0.0 and '' fall through):

    zscore <- zscore | z_score | std; reference_value <- reference_value |
    upper_band | lower_band | rolling_mean_volume; trigger_volume <-
    trigger_volume | current_volume; window_sec <- window_sec | window_sec.
    The last alternative is taken as is."""
    meta = lambda k: F.col("metadata").getItem(k).try_cast("double")
    return alerts.select(
        "time", "symbol", "alert_type", "severity", "message", "trigger_price",
        truthy_coalesce(F.col("trigger_volume").cast("double"), meta("current_volume")).alias("trigger_volume"),
        truthy_coalesce(F.col("zscore"), meta("z_score"), meta("std")).alias("zscore"),
        truthy_coalesce(F.col("reference_value"), meta("upper_band"), meta("lower_band"),
                        meta("rolling_mean_volume")).alias("reference_value"),
        truthy_coalesce(F.col("window_sec").cast("double"), meta("window_sec")).alias("window_sec"),
        "event_id")


def upsert_log_view(log: DataFrame) -> DataFrame:
    """Read side of the candle upsert log. Each micro-batch appends the
    current state of the candles it touched under its ``batch_id``; the
    table view keeps, per (time, symbol, window_sec), the newest batch's
    values and the first batch's open (the reference's ON CONFLICT update
    list); all numeric min_by/max_by keyed by batch_id, so a HashAggregate.
    The row id is derived from the candle key (stable across retries)."""
    b = F.col("batch_id")
    g = log.groupBy("time", "symbol", "window_sec").agg(
        F.min_by("open", b).alias("open"),
        *[F.max_by(c, b).alias(c) for c in ("high", "low", "close", "volume", "vwap", "trade_count", "window_end")])
    key = F.concat_ws("_", "symbol", F.col("window_sec").cast("string"), epoch_micros("time").cast("string"))
    return g.select("time", "symbol", "window_sec", "open", "high", "low", "close", "volume", "vwap",
                    "trade_count", "window_end", F.sha2(key, 256).alias("event_id"))


def backfill_ticks(bars: DataFrame, n: int = 60) -> DataFrame:
    """The last ``n`` one-minute bars per symbol as backfill ticks; bars with
    a non-positive close are dropped *after* taking the tail."""
    w = Window.partitionBy("symbol").orderBy(F.col("time").desc())
    tail = bars.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    return tail.filter(F.col("close") > 0).select(
        "time", "symbol", F.col("close").alias("price"), F.col("volume").cast("long").alias("volume"),
        F.lit(BACKFILL_SOURCE).alias("source"),
        F.sha2(F.concat_ws("_", "symbol", F.col("time").cast("string"), F.lit(BACKFILL_SOURCE)), 256).alias("event_id"))


def latest_bar_ticks(bars: DataFrame, now: Column) -> DataFrame:
    """Newest bar per symbol as a live tick (missing close/volume -> 0,
    dropped unless price > 0); the tick time is the poll time ``now``."""
    key = epoch_micros("time")
    g = bars.groupBy("symbol").agg(F.max_by("close", key).alias("close"), F.max_by("volume", key).alias("volume"),
                                   F.max("time").alias("bar_time"))
    return g.select(
        now.alias("time"), "symbol",
        F.coalesce(F.col("close"), F.lit(0.0)).alias("price"),
        F.coalesce(F.col("volume").cast("long"), F.lit(0)).alias("volume"),
        F.lit(LIVE_SOURCE).alias("source"), "bar_time").filter(F.col("price") > 0)


def retain(df: DataFrame, hours: int, as_of: Column, time_col: str = "time") -> DataFrame:
    """Rows younger than ``hours`` at ``as_of`` (a time-range filter that
    prunes day partitions and parquet row groups)."""
    cutoff = as_of - F.make_dt_interval(F.lit(0), F.lit(int(hours)))
    rows = df.filter(F.col(time_col) >= cutoff)
    return rows.filter(F.col("date") >= F.to_date(cutoff)) if "date" in df.columns else rows


def in_range(df: DataFrame, start: Column | None = None, end: Column | None = None, time_col: str = "time") -> DataFrame:
    """Rows of a day-partitioned table with ``start <= time < end``. The bounds on ``date`` follow from
    them, so other day folders are not listed into the scan (partition filters)."""
    if start is not None:
        df = df.filter((F.col(time_col) >= start) & (F.col("date") >= F.to_date(start)))
    if end is not None:
        df = df.filter((F.col(time_col) < end) & (F.col("date") <= F.to_date(end)))
    return df


def read_range(spark, path: str, start: Column | None = None, end: Column | None = None, symbols=None) -> DataFrame:
    """Reader of ``write_partitioned``: a time range and, by the files' (symbol, time) statistics, symbols."""
    out = in_range(spark.read.parquet(path), start, end)
    return (out if symbols is None else out.filter(F.col("symbol").isin(list(symbols)))).drop("date")


def write_bucketed(df: DataFrame, table: str, path: str, cols, buckets: int = 64) -> None:
    """A table of ``buckets`` files by the hash of ``cols``, sorted by them. Tables bucketed alike on their join
    columns join without a shuffle; with a time column among them a hot symbol spreads over all buckets.
    Rows are dealt by the same hash first, so each bucket is written by one task as one file."""
    cols = list(cols)
    (df.repartition(buckets, *cols).write.mode("overwrite").option("path", path)
       .bucketBy(buckets, *cols).sortBy(*cols).saveAsTable(table))


def read_jdbc(spark, url: str, table: str, partition_column: str, lower: int, upper: int,
              num_partitions: int, properties: dict | None = None) -> DataFrame:
    """Relational source read in parallel ranges of ``partition_column``
    (needs the database's JDBC driver on the classpath)."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                           numPartitions=num_partitions, properties=properties or {})


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch_size: int = 10_000,
               properties: dict | None = None) -> None:
    """Relational sink; ``batchsize`` rows per insert batch, one connection per task."""
    (df.write.mode(mode).option("batchsize", batch_size)
       .jdbc(url, table, properties=properties or {}))


def write_partitioned(df: DataFrame, path: str, time_col: str = "time", sort_cols=("symbol", "time"),
                      mode: str = "append") -> None:
    """Day-partitioned parquet, sorted within files by (symbol, time) so
    parquet min/max statistics skip row groups for symbol/time predicates."""
    out = df.withColumn("date", F.to_date(F.col(time_col)))
    # range partitioning balances a hot day or symbol over many tasks
    (out.repartitionByRange("date", *sort_cols).sortWithinPartitions("date", *sort_cols)
        .write.mode(mode).partitionBy("date").parquet(path))
