"""Structured Streaming jobs built from the batch operators.

* ``candle_stream``: continuous candles (one query per window size) with an
  event-time watermark. Spark drops a window's state once its *end* falls
  behind ``max event time - delay``; the reference evicts on bucket *start*
  older than 3600 s, so ``delay = 3600 - w`` reproduces that cutoff. Late
  rows are counted by Spark (``numRowsDroppedByWatermark``).
* ``CandleStore``: foreachBatch sink that appends the touched candles of a
  micro-batch under ``batch_id=N`` (overwrite per batch id => a retried batch
  is idempotent), compacts them into a base and reads base plus newer batches.
* ``LateTicks``: foreachBatch sink that stores the ticks behind the watermark.
* ``detector`` (own module): detection with keyed state; its alerts go to ``sources.alert_store``.
* ``alert_consumer_stream``: decode, validate, dedup within the watermark,
  enrich; routing/outbox run per batch.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tickspark.functions.timefn import bucket_start, epoch_micros, event_order_key
from tickspark.operators import route, validate
from tickspark.operators.candles import CANDLE_COLUMNS, candle_input
from tickspark.sources import codec, sinks


def candle_stream(ticks: DataFrame, window_sec: int, delay_sec: int | None = None) -> DataFrame:
    """Streaming OHLCV/VWAP for one window size (``ticks.time`` must be a
    ``timestamp``). Windows are epoch aligned like the batch buckets."""
    delay = (3600 - window_sec) if delay_sec is None else delay_sec
    src = candle_input(ticks.withWatermark("time", f"{max(delay, 0)} seconds"))
    key = event_order_key("time", "event_id")
    g = src.groupBy("symbol", F.window("time", f"{window_sec} seconds").alias("w")).agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", key).alias("close"), F.sum("volume").alias("volume"),
        F.sum(F.col("price") * F.col("volume")).alias("_pv"), F.count(F.lit(1)).alias("trade_count"))
    return g.select(
        F.col("w.start").alias("time"), "symbol", F.lit(window_sec).cast("int").alias("window_sec"),
        "open", "high", "low", "close", "volume",
        F.when(F.col("volume") > 0, F.col("_pv") / F.col("volume")).otherwise(F.col("open")).alias("vwap"),
        "trade_count", F.col("w.end").alias("window_end"))


class CandleStore:
    """Stored candles: ``path/log/batch_id=N`` holds the candles that micro-batch N touched, ``path/base/v=K`` all
    candles up to a batch, and ``path/manifest/v=K`` (written last) says which batch that is. Use as a
    ``foreachBatch`` target; ``read`` merges the newest base with the batches after it."""

    def __init__(self, path: str):
        self.log, self.base, self.manifest = (os.path.join(path, n) for n in ("log", "base", "manifest"))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        (batch.select(*CANDLE_COLUMNS).write.mode("overwrite").parquet(os.path.join(self.log, f"batch_id={batch_id}")))

    def _compacted(self, spark: SparkSession) -> tuple[int, int]:
        """(version, last batch) of the newest complete base; (-1, -1) without one."""
        try:
            done = spark.read.parquet(self.manifest).agg(F.max(F.struct("v", "upto")).alias("m")).first().m
        except AnalysisException:
            return -1, -1
        return int(done.v), int(done.upto)

    def _newer(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.log).filter(F.col("batch_id") > self._compacted(spark)[1])

    def parts(self, spark: SparkSession) -> DataFrame:
        """The candle states to merge: the base under its last batch, and the log behind it (batches in the
        base are not read)."""
        version, upto = self._compacted(spark)
        newer = self._newer(spark).select(*CANDLE_COLUMNS, "batch_id")
        if version < 0:
            return newer
        base = spark.read.parquet(os.path.join(self.base, f"v={version}")).select(*CANDLE_COLUMNS, F.lit(upto).alias("batch_id"))
        return base.unionByName(newer)

    def read(self, spark: SparkSession) -> DataFrame:
        return sinks.upsert_log_view(self.parts(spark))

    def compact(self, spark: SparkSession) -> None:
        """Write the view as a new base. The batches it covers are fixed before it is read, so ones that arrive
        meanwhile stay in the log; a base without a manifest entry (a job cut off) is never read."""
        version, upto = self._compacted(spark)
        last = spark.read.parquet(self.log).agg(F.max("batch_id")).first()[0]
        if last is None or last <= upto:
            return
        view = sinks.upsert_log_view(self.parts(spark).filter(F.col("batch_id") <= last))
        sinks.write_partitioned(view, os.path.join(self.base, f"v={version + 1}"), mode="overwrite")
        spark.range(1).select(F.lit(int(last)).alias("upto")).write.mode("overwrite").parquet(
            os.path.join(self.manifest, f"v={version + 1}"))


def _latest_version(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """Newest state version written by an earlier batch (``path/v=N``), read
    through Spark's partition discovery, so any shared file system works."""
    try:
        versions = spark.read.parquet(path)
    except AnalysisException:
        return None
    versions = versions.filter(F.col("v") < before)
    latest = versions.agg(F.max("v")).first()[0]  # one scalar: the version number
    if latest is None:
        return None
    return versions.filter(F.col("v") == latest).drop("v")


class LateTicks:
    """foreachBatch sink: the ticks behind the watermark that ``candle_stream`` (same window and delay, same
    micro-batches) drops, stored under ``path/late/batch_id=N``.

    The watermark of a batch is the largest time of the batches before it less the delay; a tick is late
    when its window ends at or before it. The largest time is kept per batch id, so a retried
    batch judges by the same watermark."""

    def __init__(self, path: str, window_sec: int, delay_sec: int | None = None):
        self.path, self.window_sec = path, window_sec
        self.delay_sec = max((3600 - window_sec) if delay_sec is None else delay_sec, 0)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = _latest_version(spark, os.path.join(self.path, "seen"), batch_id)
        top = seen.first()[0] if seen is not None else None
        newest = candle_input(batch).agg(F.max(epoch_micros("time")).alias("top")).select(F.greatest("top", F.lit(top).cast("long")).alias("top"))
        newest.write.mode("overwrite").parquet(os.path.join(self.path, "seen", f"v={batch_id}"))
        if top is not None:
            end = epoch_micros(bucket_start("time", self.window_sec)) + self.window_sec * 1_000_000
            late = batch.filter(end <= top - self.delay_sec * 1_000_000)
            late.write.mode("overwrite").parquet(os.path.join(self.path, "late", f"batch_id={batch_id}"))

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(os.path.join(self.path, "late"))


def dedup_alert_stream(alerts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First write wins on the alert id within the watermark (W7)."""
    return alerts.withWatermark("time", delay).dropDuplicatesWithinWatermark(["event_id"])


def alert_consumer_stream(messages: DataFrame, now: Column, delay: str = "1 hour") -> DataFrame:
    """W6: JSON alerts -> typed rows (epoch or ISO time) -> validation ->
    dedup -> enrichment. Invalid rows are filtered here; ``alert_rejects`` is the other side."""
    good = _judged_alerts(messages, now).filter(F.col("is_valid")).drop("reasons", "is_valid")
    return sinks.enrich_alerts(dedup_alert_stream(good, delay))


def _judged_alerts(messages: DataFrame, now: Column) -> DataFrame:
    a = codec.decode_alerts(messages)
    a = a.withColumn("time", sinks.alert_time(F.col("timestamp"), now)).drop("timestamp")
    return validate.validate_alerts(a.withColumn("message", F.coalesce(F.col("message"), F.lit("Anomaly detected"))))


def alert_rejects(messages: DataFrame, now: Column, value_col: str = "value") -> DataFrame:
    """(value, reason): alert messages that are no JSON, and alerts that break a rule (as JSON text)."""
    broken = codec.decode_alerts_with_rejects(messages, value_col)[1].select(F.col(value_col).alias("value"), "reason")
    invalid = _judged_alerts(messages, now).filter(~F.col("is_valid"))
    return broken.unionByName(invalid.select(F.to_json(F.struct(*[c for c in invalid.columns if c not in ("reasons", "is_valid")])).alias("value"),
                                             F.col("reasons").alias("reason")))


class OutboxSink:
    """foreachBatch: route a micro-batch of alerts into chat and mail outbox
    tables (one parquet folder per batch id, idempotent on retry)."""

    def __init__(self, path: str, recipients: str = ""):
        self.path = path
        self.recipients = recipients

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        routed = route.route(batch)
        route.chat_outbox(routed.filter(F.col("channel") == "chat")).write.mode("overwrite").parquet(
            os.path.join(self.path, "chat", f"batch_id={batch_id}"))
        mail = route.mail_outbox(routed.filter(F.col("channel") == "mail"))
        mail.write.mode("overwrite").parquet(os.path.join(self.path, "mail", f"batch_id={batch_id}"))
        if self.recipients:
            route.recipients(mail, self.recipients).write.mode("overwrite").parquet(
                os.path.join(self.path, "recipients", f"batch_id={batch_id}"))


def tick_stream_with_rejects(messages: DataFrame, rejects_path: str, checkpoint: str):
    """W8: malformed or incomplete messages go to a reject table instead of
    failing the batch; returns (good stream, started reject query)."""
    good, bad = codec.decode_ticks_with_rejects(messages)
    q = (bad.writeStream.format("parquet").option("path", rejects_path)
         .option("checkpointLocation", checkpoint).outputMode("append").start())
    return good, q


class HeartbeatListener(StreamingQueryListener):
    """C6/H1 live: every micro-batch progress of a streaming query becomes a
    heartbeat row (service = query name, mps = processed rows per second,
    total_processed = input rows of the batch, status running/idle).

    Rows are kept in memory on the driver only as the last beat per service
    (bounded by the number of queries); ``frame`` turns them into a
    DataFrame that ``serve.health_latest``/``health_liveness`` accept."""

    def __init__(self):
        self.beats: dict[str, tuple] = {}

    def onQueryStarted(self, event):  # noqa: N802 - listener API
        pass

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        name = p.name or str(p.id)
        rows = int(p.numInputRows)
        mps = round(float(p.processedRowsPerSecond or 0.0), 2)
        ts = dt.datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")).replace(tzinfo=None)
        self.beats[name] = (name, ts, "running" if rows > 0 else "idle", mps, rows)

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        pass

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            list(self.beats.values()),
            "service_name string, last_heartbeat timestamp, status string, mps double, total_processed long")
