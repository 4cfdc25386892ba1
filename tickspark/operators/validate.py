"""Record validation: every failed rule becomes a reason string; valid rows
have none. Nothing raises, so one bad message never fails a batch; the
rejects side keeps the reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.functions.timefn import epoch_micros


def _reasons(checks: list[tuple[str, Column]]) -> Column:
    """Comma-joined names of failed checks ('' when all pass). A check whose
    input is null counts as passed unless the rule says otherwise."""
    return F.concat_ws(",", *[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks])


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def normalize_symbol(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.upper(F.trim(c))


def tick_reasons() -> Column:
    bid, ask = F.col("bid"), F.col("ask")
    return _reasons([
        ("event_id", _blank(F.col("event_id"))),
        ("timestamp", F.col("time").isNull() | (epoch_micros("time") <= 0)),
        ("symbol", _blank(F.col("symbol"))),
        ("price", F.col("price").isNull() | (F.col("price") <= 0)),
        ("volume", F.col("volume").isNull() | (F.col("volume") < 0)),
        ("source", F.col("source").isNull() | (F.col("source") == "")),
        ("bid", bid.isNotNull() & (bid <= 0)),
        ("ask", ask.isNotNull() & (ask <= 0)),
        ("bid_gt_ask", bid.isNotNull() & ask.isNotNull() & (bid > ask)),
    ])


def validate_ticks(ticks: DataFrame) -> DataFrame:
    """All ticks with ``reasons`` and ``is_valid``; the symbol is normalised
    (trim + upper) as the tick constructor does."""
    return (ticks.withColumn("reasons", tick_reasons())
            .withColumn("is_valid", F.col("reasons") == "")
            .withColumn("symbol", normalize_symbol("symbol")))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of a validated frame."""
    return df.filter(F.col("is_valid")).drop("reasons", "is_valid"), df.filter(~F.col("is_valid"))


def candle_reasons() -> Column:
    o, h, l, c = F.col("open"), F.col("high"), F.col("low"), F.col("close")

    def off(col: Column, bad: Column) -> Column:
        return col.isNull() | bad

    return _reasons([
        ("symbol", _blank(F.col("symbol"))),
        ("open", off(o, o <= 0)), ("high", off(h, h <= 0)), ("low", off(l, l <= 0)), ("close", off(c, c <= 0)),
        ("vwap", off(F.col("vwap"), F.col("vwap") <= 0)),
        ("volume", off(F.col("volume"), F.col("volume") < 0)),
        ("trade_count", off(F.col("trade_count"), F.col("trade_count") < 0)),
        ("window_sec", off(F.col("window_sec"), F.col("window_sec") <= 0)),
        ("time", F.col("time").isNull() | F.col("window_end").isNull()),
        ("low_gt_high", l > h),
        ("open_range", (o < l) | (o > h)),
        ("close_range", (c < l) | (c > h)),
        ("window_order", epoch_micros("time") >= epoch_micros("window_end")),
    ])


def validate_candles(candles_df: DataFrame) -> DataFrame:
    return candles_df.withColumn("reasons", candle_reasons()).withColumn("is_valid", F.col("reasons") == "")


def alert_reasons() -> Column:
    return _reasons([
        ("event_id", _blank(F.col("event_id"))),
        ("timestamp", F.col("time").isNull() | (epoch_micros("time") <= 0)),
        ("symbol", _blank(F.col("symbol"))),
        ("alert_type", F.col("alert_type").isNull() | (F.col("alert_type") == "")),
        ("severity", F.col("severity").isNull() | (F.col("severity") == "")),
        ("message", F.col("message").isNull() | (F.col("message") == "")),
        ("trigger_price", F.col("trigger_price").isNotNull() & (F.col("trigger_price") <= 0)),
        ("trigger_volume", F.col("trigger_volume").isNotNull() & (F.col("trigger_volume") < 0)),
        ("window_sec", F.col("window_sec").isNotNull() & (F.col("window_sec") <= 0)),
    ])


def validate_alerts(alerts: DataFrame) -> DataFrame:
    """All alerts with ``reasons`` and ``is_valid``; the symbol is normalised as in ticks."""
    return (alerts.withColumn("reasons", alert_reasons()).withColumn("is_valid", F.col("reasons") == "")
            .withColumn("symbol", normalize_symbol("symbol")))
