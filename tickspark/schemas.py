"""Schemas and fixed values of the tick data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference behaviour (stated once, here).
# ---------------------------------------------------------------------------
HEATMAP_SYMBOL_COUNT = 6
CANDLE_WINDOWS = [60, 300, 900]
BOLLINGER_WINDOW = 20
BOLLINGER_STD_MULT = 2.0
VOLUME_WINDOW = 30
VOLUME_Z_THRESHOLD = 3.0
JUMP_WINDOW = 20
JUMP_STD_THRESHOLD = 3.0
RULE_COOLDOWN_SECONDS = 300
STALE_AFTER_SECONDS = 300
EMA_PERIOD = 20
DEEP_DIVE_PERIOD = 20
LIVENESS_MS = 30000
BACKFILL_SOURCE = "yfinance-backfill"
LIVE_SOURCE = "yfinance"
SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2}
SEVERITY_COLOR = {"low": "#36a64f", "medium": "#ffb347", "high": "#ff4c4c"}
DEFAULT_COLOR = "#aaaaaa"
RETENTION_HOURS = {"ticks": 24, "aggregates": 7 * 24, "alerts": 30 * 24}
# Alert type names as emitted by the detector.
BOLLINGER_BREACH = "BOLLINGER_BREACH"
VOLUME_SPIKE = "VOLUME_SPIKE"
PRICE_JUMP = "PRICE_JUMP"
USER_RULE = "USER_RULE"

# Wire form of a tick (JSON on the stream): epoch seconds as a double.
TICK_WIRE_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("volume", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("bid", T.DoubleType()),
    T.StructField("ask", T.DoubleType()),
])

# Table form of a tick.
TICK_SCHEMA = T.StructType([
    T.StructField("time", T.TimestampType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("volume", T.IntegerType()),
    T.StructField("bid", T.DoubleType()),
    T.StructField("ask", T.DoubleType()),
    T.StructField("source", T.StringType()),
    T.StructField("event_id", T.StringType()),
])

CANDLE_SCHEMA = T.StructType([
    T.StructField("time", T.TimestampType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("window_sec", T.IntegerType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.LongType()),
    T.StructField("vwap", T.DoubleType()),
    T.StructField("trade_count", T.LongType()),
    T.StructField("window_end", T.TimestampType()),
])

ALERT_WIRE_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("alert_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("trigger_price", T.DoubleType()),
    T.StructField("trigger_volume", T.LongType()),
    T.StructField("zscore", T.DoubleType()),
    T.StructField("reference_value", T.DoubleType()),
    T.StructField("window_sec", T.IntegerType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

RULE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("rule_type", T.StringType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("window_sec", T.IntegerType()),
    T.StructField("created_at", T.TimestampType()),
])
