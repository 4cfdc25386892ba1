"""Serving queries: latest prices, candles joined with alerts, heatmap, deep
dive, alert history, per-symbol summaries, and service health.

The reference answers these one symbol at a time; here every query handles
the whole universe in one job (``symbols=None``) or a chosen subset (pushed
down as an ``isin`` filter). Top-N per symbol uses ``row_number() <= N``,
which Spark plans as a partial ``WindowGroupLimit`` before the shuffle, so a
hot symbol ships only N rows per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickspark.functions.timefn import bucket_start, epoch_micros, event_order_key
from tickspark.functions.values import is_truthy, truthy_coalesce
from tickspark.plans.joins import broadcast_if_small
from tickspark.schemas import LIVENESS_MS
from tickspark.session import ensure_checkpoint_dir
from tickspark.sources import sinks

#: Candle keys that a serving join sends to every task at most.
MAX_BROADCAST_KEYS = 1_000_000

CANDLE_OUT = ["symbol", "time", "open", "high", "low", "close", "volume", "vwap", "trade_count",
              "anomaly_type", "severity", "anomaly_value"]


def joined_desc() -> list[Column]:
    """Order of joined rows, newest first (candle time, then the alert): total over stored alerts, whose
    (event id, time) is unique. ``_rank`` numbers the rows by it; frames and cuts use that number."""
    return [F.col("time").desc(), F.col("_al_time").desc_nulls_last(),
            F.col("anomaly_type").desc_nulls_last(), F.col("_al_event_id").desc_nulls_last()]


def _in_symbols(df: DataFrame, symbols: Sequence[str] | None) -> DataFrame:
    return df if symbols is None else df.filter(F.col("symbol").isin(list(symbols)))


def latest_price(ticks: DataFrame, symbols: Sequence[str] | None = None) -> DataFrame:
    """Newest tick per symbol (ties by event_id), as one partial aggregate."""
    t = _in_symbols(ticks, symbols)
    key = event_order_key("time", "event_id")
    return t.groupBy("symbol").agg(F.max_by("price", key).alias("price"), F.max("time").alias("time"))


def join_alerts(candles_df: DataFrame, alerts: DataFrame, window_sec: int,
                symbols: Sequence[str] | None = None) -> DataFrame:
    """Candles LEFT JOIN alerts with ``candle.time <= alert.time < candle.time + w``.

    Candle times are epoch-aligned bucket starts, so the interval predicate is
    the equi-join on (symbol, bucket(alert.time)): no range join, and the
    bucket splits a hot symbol over many join keys.
    """
    c = _in_symbols(candles_df.filter(F.col("window_sec") == window_sec), symbols)
    return _joined(c, alert_side(_in_symbols(alerts, symbols), window_sec))


def alert_side(alerts: DataFrame, window_sec: int) -> DataFrame:
    """Alerts as the candle join reads them, with the start of the candle they fall into."""
    return alerts.select(
        F.col("symbol").alias("_al_symbol"), F.col("time").alias("_al_time"),
        F.col("alert_type").alias("anomaly_type"), F.col("severity").alias("_al_severity"),
        F.col("trigger_price").alias("anomaly_value"), F.col("event_id").alias("_al_event_id"),
        bucket_start("time", window_sec).alias("_al_bucket"))


def _joined(c: DataFrame, al: DataFrame) -> DataFrame:
    j = c.join(al, (c.symbol == al._al_symbol) & (c.time == al._al_bucket), "left")
    return j.withColumn("severity", F.coalesce(F.col("_al_severity"), F.lit("normal")))


class JoinedHistory:
    """Candles of one window with their alerts over the whole history, from two stored tables bucketed by
    (symbol, candle start): stored once, joined any number of times without a shuffle."""

    def __init__(self, name: str, path: str, window_sec: int, buckets: int = 64):
        self.candles, self.alerts = f"{name}_candles", f"{name}_alerts"
        self.path, self.window_sec, self.buckets = path, window_sec, buckets

    def store(self, candles_df: DataFrame, alerts: DataFrame) -> None:
        sinks.write_bucketed(candles_df.filter(F.col("window_sec") == self.window_sec), self.candles,
                             f"{self.path}/{self.candles}", ["symbol", "time"], self.buckets)
        sinks.write_bucketed(alert_side(alerts, self.window_sec), self.alerts, f"{self.path}/{self.alerts}",
                             ["_al_symbol", "_al_bucket"], self.buckets)

    def read(self, spark: SparkSession) -> DataFrame:
        return _joined(spark.table(self.candles), spark.table(self.alerts)).select(*CANDLE_OUT)


def newest_joined(candles_df: DataFrame, alerts: DataFrame, window_sec: int, limit: int,
                  symbols: Sequence[str] | None = None) -> DataFrame:
    """The newest ``limit`` joined rows per symbol (a candle with several
    alerts counts once per alert), with ``_rank`` 1 = newest.

    A left join gives every candle at least one row, so those rows all come
    from the newest ``limit`` candles of the symbol: the top-N is pushed below
    the join (partial ``WindowGroupLimit``), and the join sees at most
    ``limit`` candles per symbol instead of the whole candle table."""
    c = _in_symbols(candles_df.filter(F.col("window_sec") == window_sec), symbols)
    newest = Window.partitionBy("symbol").orderBy(F.col("time").desc())
    # at most ``limit`` rows a symbol, read twice below: materialised, which also sizes them
    ensure_checkpoint_dir(c.sparkSession)
    c = c.withColumn("_cr", F.row_number().over(newest)).filter(F.col("_cr") <= limit).drop("_cr").checkpoint()
    # only alerts inside those candles can join: a semi-join drops the rest before any shuffle of alerts
    # (map-side while the keys are few)
    keys = broadcast_if_small(c.select(F.col("symbol").alias("_ks"), F.col("time").alias("_kt")), MAX_BROADCAST_KEYS)
    al = alerts.join(keys, (alerts.symbol == keys._ks)
                     & (bucket_start(alerts.time, window_sec) == keys._kt), "left_semi")
    j = join_alerts(c, al, window_sec, symbols)
    w = Window.partitionBy("symbol").orderBy(*joined_desc())
    return j.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= limit)


def candlesticks(candles_df: DataFrame, alerts: DataFrame, window_sec: int, limit: int = 100,
                 symbols: Sequence[str] | None = None) -> DataFrame:
    """The newest ``limit`` joined rows per symbol, ascending."""
    rows = newest_joined(candles_df, alerts, window_sec, limit, symbols)
    return rows.orderBy("symbol", F.col("_rank").desc()).select(*CANDLE_OUT)


def recent_alerts(alerts: DataFrame, symbol: str | None = None, limit: int = 50) -> DataFrame:
    """Newest ``limit`` alerts, optionally of one symbol ('ALL'/None = all)."""
    a = alerts if symbol in (None, "ALL") else alerts.filter(F.col("symbol") == symbol)
    return (a.orderBy(F.col("time").desc(), F.col("event_id").desc()).limit(limit)
            .select("time", "symbol", "alert_type", "severity", "message", "trigger_price",
                    F.col("trigger_price").alias("actual_value")))


def first_symbols(ticks: DataFrame, n: int) -> DataFrame:
    """First ``n`` symbols of the sorted universe (distinct symbols only)."""
    return ticks.select("symbol").distinct().orderBy("symbol").limit(n)


def heatmap_long(candles_df: DataFrame, alerts: DataFrame, universe: DataFrame, limit: int = 20) -> DataFrame:
    """Heatmap rows: per symbol of ``universe`` the newest ``limit`` joined
    one-minute rows (symbol, time, severity)."""
    c = candles_df.join(universe.select("symbol"), "symbol", "left_semi")
    return newest_joined(c, alerts, 60, limit).select("symbol", "time", "severity")


def heatmap(candles_df: DataFrame, alerts: DataFrame, universe: DataFrame, limit: int = 20) -> DataFrame:
    """Nested heatmap: one row per symbol with an ascending timeline of
    {time, severity}; symbols without candles are omitted. Each list holds at
    most ``limit`` entries."""
    rows = newest_joined(candles_df.join(universe.select("symbol"), "symbol", "left_semi"),
                         alerts, 60, limit)
    entry = F.struct(F.col("_rank"), F.struct(
        F.concat(F.date_format("time", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")).alias("time"),
        F.col("severity")).alias("e"))
    return (rows.groupBy("symbol")
            .agg(F.sort_array(F.collect_list(entry), asc=False).alias("_l"))
            .select("symbol", F.transform("_l", lambda x: x["e"]).alias("timeline")))


def deep_dive(candles_df: DataFrame, alerts: DataFrame, symbols: Sequence[str] | None = None,
              limit: int = 100, period: int = 20) -> DataFrame:
    """Five-minute candles with alerts, newest ``limit`` rows, ascending, with
    a ``period``-row rolling mean, *sample* std, +-2 std bands and z-score
    (null until ``period`` rows are available; x/0 gives null)."""
    rows = newest_joined(candles_df, alerts, 300, limit, symbols)
    w = Window.partitionBy("symbol").orderBy(F.col("_rank").desc()).rowsBetween(-(period - 1), 0)
    n = F.count(F.lit(1)).over(w)
    ma = F.when(n == period, F.avg("close").over(w))
    std = F.when(n == period, F.stddev_samp("close").over(w))
    out = rows.select(
        "symbol", "time", "open", "high", "low", "close", "volume", "anomaly_type", "severity",
        "anomaly_value", "_rank", "_al_time", "_al_event_id",
        ma.alias("ma"), std.alias("std"))
    out = (out.withColumn("upper", F.col("ma") + F.col("std") * 2)
           .withColumn("lower", F.col("ma") - F.col("std") * 2)
           .withColumn("z_score", F.try_divide(F.col("close") - F.col("ma"), F.col("std"))))
    return out.orderBy("symbol", F.col("_rank").desc())


DEEP_DIVE_OUT = ["symbol", "time", "open", "high", "low", "close", "volume", "anomaly_type", "severity",
                 "anomaly_value", "ma", "std", "upper", "lower", "z_score"]


def deep_dive_history(deep: DataFrame, n: int = 5) -> DataFrame:
    """Last ``n`` non-normal rows of each symbol's deep dive."""
    w = Window.partitionBy("symbol").orderBy("_rank")
    return (deep.filter(F.col("severity") != "normal")
            .withColumn("_h", F.row_number().over(w)).filter(F.col("_h") <= n)
            .select(*DEEP_DIVE_OUT))


def alerts_history(alerts: DataFrame, symbol: str = "ALL", severity: str = "ALL", fetch: int = 200) -> DataFrame:
    """The history page: the newest ``fetch`` alerts are loaded first, then
    filtered by symbol and severity (order matters), with the match count."""
    page = alerts.orderBy(F.col("time").desc(), F.col("event_id").desc()).limit(fetch)
    if symbol != "ALL":
        page = page.filter(F.col("symbol") == symbol)
    if severity != "ALL":
        page = page.filter(F.col("severity") == severity)
    return page.select("time", "symbol", "alert_type", "severity", "message", "trigger_price",
                       F.count(F.lit(1)).over(Window.partitionBy()).alias("total"))


def alerts_feed(alerts: DataFrame, show: int = 10, fetch: int = 50) -> DataFrame:
    """The live feed shows the newest ``show`` of the ``fetch`` loaded alerts
    (same total order: time, then alert id)."""
    return recent_alerts(alerts, None, fetch).limit(show)


def loaded_series(candles_df: DataFrame, alerts: DataFrame, limit: int = 300,
                  symbols: Sequence[str] | None = None) -> DataFrame:
    """What the stock page loads: newest ``limit`` joined one-minute rows per
    symbol, with ``_pos`` 0 = oldest."""
    rows = newest_joined(candles_df, alerts, 60, limit, symbols)
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    return rows.withColumn("_pos", n - F.col("_rank"))


def price_change(ticks: DataFrame, series: DataFrame) -> DataFrame:
    """Change of the latest price against the open of the first loaded candle."""
    base = series.groupBy("symbol").agg(F.min_by("open", "_pos").alias("base_price"))
    last = latest_price(ticks)
    j = last.join(base, "symbol")
    change = F.col("price") - F.col("base_price")
    return j.select("symbol", "price", "base_price", change.alias("change"),
                    (F.try_divide(change, F.col("base_price")) * 100).alias("change_pct"))


def recent_trades(series: DataFrame, n: int = 10) -> DataFrame:
    """Newest ``n`` loaded candles as trades: price = close, volume = volume,
    else trade_count, else 0 (zero falls through)."""
    return (series.filter(F.col("_rank") <= n)
            .select("symbol", (F.col("_rank") - 1).alias("idx"), "time", F.col("close").alias("price"),
                    truthy_coalesce("volume", "trade_count", F.lit(0).cast("long")).alias("volume")))


def anomaly_markers(series: DataFrame) -> DataFrame:
    """Chart markers: rows with a non-normal severity; y = anomaly value if
    truthy else close; the newest marker of each symbol is flagged."""
    w = Window.partitionBy("symbol").orderBy(F.col("_pos").desc())
    m = series.filter(F.col("severity").isNotNull() & (F.col("severity") != "normal"))
    return m.select("symbol", "time", "anomaly_type", "severity",
                    F.when(is_truthy("anomaly_value"), F.col("anomaly_value")).otherwise(F.col("close")).alias("y"),
                    (F.row_number().over(w) == 1).alias("is_latest"))


def heartbeat_log(messages: DataFrame, interval_sec: int = 10, metrics: dict[str, Column] | None = None) -> DataFrame:
    """Heartbeats from processed messages ``(service_name, time)``: one beat
    per service and interval with mps = round(count / interval, 2). ``metrics`` are further
    aggregates of a beat's messages, by name."""
    extra = metrics or {}
    b = messages.withColumn("_b", bucket_start("time", interval_sec))
    g = b.groupBy("service_name", "_b").agg(F.count(F.lit(1)).alias("total_processed"), *[c.alias(n) for n, c in extra.items()])
    return g.select(
        "service_name",
        F.timestamp_micros(epoch_micros("_b") + F.lit(interval_sec * 1_000_000)).alias("last_heartbeat"),
        F.when(F.col("total_processed") > 0, F.lit("running")).otherwise(F.lit("idle")).alias("status"),
        F.round(F.col("total_processed") / F.lit(float(interval_sec)), 2).alias("mps"),
        F.col("total_processed"), *extra)


def health_latest(beats: DataFrame) -> DataFrame:
    """Upsert semantics of the health table: newest beat per service,
    ordered by service name; ``metrics`` is every metric of the beat as JSON."""
    key = epoch_micros("last_heartbeat")
    metrics = [c for c in beats.columns if c not in ("service_name", "last_heartbeat", "status")]
    g = beats.groupBy("service_name").agg(
        F.max("last_heartbeat").alias("last_heartbeat"), *[F.max_by(c, key).alias(c) for c in ("status", *metrics)])
    return g.select("service_name", "last_heartbeat", "status", "mps", "total_processed",
                    F.to_json(F.struct(*metrics)).alias("metrics")).orderBy("service_name")


def health_liveness(health: DataFrame, now: Column) -> DataFrame:
    """healthy if the last beat is younger than 30 s, else dead; the rate is
    shown only for healthy services."""
    age_ms = F.floor((epoch_micros(now) - epoch_micros("last_heartbeat")) / 1000)
    healthy = age_ms < LIVENESS_MS
    return health.select("service_name", "last_heartbeat", age_ms.cast("long").alias("age_ms"),
                         F.when(healthy, F.lit("healthy")).otherwise(F.lit("dead")).alias("liveness"),
                         F.when(healthy, F.col("mps")).alias("mps_shown"))


def throughput(messages: DataFrame, interval_sec: int = 10) -> DataFrame:
    """Messages per second and totals per service and interval."""
    return heartbeat_log(messages, interval_sec).select(
        "service_name", F.col("last_heartbeat").alias("interval_end"), "mps", "total_processed", "status")


def throughput_grid(messages: DataFrame, interval_sec: int = 10, tracked: DataFrame | None = None) -> DataFrame:
    """``throughput`` with the idle intervals: every interval between a service's first and last beat has a row,
    idle ones with 0 messages, and ``symbols_tracked``, the size of the tracked universe (``tracked``: one
    row a symbol; null without it).

    A service's grid is exploded by day first, so a long history is many small explosions."""
    beats = heartbeat_log(messages, interval_sec)
    us, day = interval_sec * 1_000_000, 86_400 * 1_000_000
    end = epoch_micros("last_heartbeat")
    span = beats.groupBy("service_name").agg(F.min(end).alias("_lo"), F.max(end).alias("_hi"))
    days = span.select("service_name", "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") / day), F.floor(F.col("_hi") / day))).alias("_d"))
    lo = F.greatest(F.col("_lo"), F.ceil(F.col("_d") * day / us) * us)
    hi = F.least(F.col("_hi"), (F.col("_d") + 1) * day - 1)
    grid = (days.repartition("service_name", "_d").filter(lo <= hi)
            .select("service_name", F.explode(F.sequence(lo, hi, F.lit(us).cast("long"))).alias("_e"))
            .select("service_name", F.timestamp_micros("_e").alias("last_heartbeat")))
    out = grid.join(beats, ["service_name", "last_heartbeat"], "left")
    size = F.lit(None).cast("long")
    if tracked is not None:
        size = tracked.agg(F.count(F.lit(1))).scalar()
    return out.select("service_name", F.col("last_heartbeat").alias("interval_end"), F.coalesce("mps", F.lit(0.0)).alias("mps"),
                      F.coalesce("total_processed", F.lit(0).cast("long")).alias("total_processed"),
                      F.coalesce("status", F.lit("idle")).alias("status"), size.alias("symbols_tracked"))
