"""Views over the driver's parquet tables that stand in for the tick tables.

``events`` becomes a tick stream: symbol = upper(trim(event_type)), time = ts,
price = value, volume = props.k, source tags every 10th event as backfill.
The same derivations exist as SQL in ``tickspark.plans.oracle`` so both
engines read identical inputs. All views are lazy DataFrames over the full
tables; nothing is sampled.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickspark.functions.timefn import epoch_seconds_double, ts_literal
from tickspark.schemas import BACKFILL_SOURCE, LIVE_SOURCE
from tickspark.session import pin_utc

# Fixed parameters of the fixtures.
AS_OF = dt.datetime(2024, 1, 31, 0, 0, 0)
AS_OF_TEXT = "2024-01-31 00:00:00"
RULES_EPOCH_US = 1704067200000000  # 2024-01-01 00:00:00 UTC
DIRTY_MOD = 97
RULE_TEMPLATES = [
    (0, "price_above", 100.0),
    (1, "price_below", 1.0),
    (2, "volume_above", 90.0),
    (3, "volume_spike", 3.0),
    (4, "price_above", 100.0),
    (5, "price_above", 250.125),
]
JSON_MOD = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _volume_k() -> F.Column:
    """``props.k`` of the flat ``{"k": N}`` props object. A regex pull of one
    numeric member is about three times cheaper than a JSON parse per row."""
    return F.regexp_extract("props", r'"k"\s*:\s*(-?[0-9]+)', 1).try_cast("int")


def _ticks_from(ev: DataFrame, volume: F.Column) -> DataFrame:
    return ev.select(
        F.col("ts").cast("timestamp").alias("time"),
        F.upper(F.trim("event_type")).alias("symbol"),
        F.col("value").alias("price"),
        volume.alias("volume"),
        F.lit(None).cast("double").alias("bid"),
        F.lit(None).cast("double").alias("ask"),
        F.when(F.col("event_id") % 10 == 0, F.lit(BACKFILL_SOURCE)).otherwise(F.lit(LIVE_SOURCE)).alias("source"),
        F.col("event_id").cast("string").alias("event_id"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ticks_from(table(spark, sf_dir, "events"), _volume_k())


def ticks_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume = floor(value * (k + 1)): heavy-tailed volumes for spike tests."""
    ev = table(spark, sf_dir, "events")
    return _ticks_from(ev, F.floor(F.col("value") * (_volume_k() + 1)).cast("int"))


def ticks_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price = 500 - value: turns upper-band breaches into lower-band ones."""
    return ticks(spark, sf_dir).withColumn("price", F.lit(500.0) - F.col("price"))


def ticks_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with chosen rows spoiled (by event_id modulo 97) for validation.

    1: price 0, 2: volume -1, 3: blank symbol, 4: bid > ask, 5: bid <= 0,
    6: empty source, 7: empty event_id, 8: epoch-0 timestamp, 9: symbol in
    lower case with padding (valid after normalisation); all other rows get a
    one-cent spread around the price."""
    ev = table(spark, sf_dir, "events")
    m = F.col("event_id") % DIRTY_MOD
    price = F.when(m == 1, F.lit(0.0)).otherwise(F.col("value"))
    return ev.select(
        F.when(m == 8, F.lit("1970-01-01 00:00:00").cast("timestamp")).otherwise(F.col("ts").cast("timestamp")).alias("time"),
        F.when(m == 3, F.lit("  ")).when(m == 9, F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")))
         .otherwise(F.upper(F.trim("event_type"))).alias("symbol"),
        price.alias("price"),
        F.when(m == 2, F.lit(-1)).otherwise(_volume_k()).alias("volume"),
        F.when(m == 4, price + 1.0).when(m == 5, F.lit(-1.0)).otherwise(price - 0.01).alias("bid"),
        (price + 0.01).alias("ask"),
        F.when(m == 6, F.lit("")).when(F.col("event_id") % 10 == 0, F.lit(BACKFILL_SOURCE))
         .otherwise(F.lit(LIVE_SOURCE)).alias("source"),
        F.when(m == 7, F.lit("")).otherwise(F.col("event_id").cast("string")).alias("event_id"),
    )


def ticks_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wire messages (``value`` JSON text, ``key`` symbol) in the forms senders use, by event_id % 50.

    7: cut short, 11: price null, 13: ISO time, 17: volume with a fraction, 19: price as text, 23: price
    'n/a', 29: no event_id, 31: no timestamp, 37: epoch as text, 41: unreadable time, 43: volume as text,
    47: volume 'many'."""
    ev = table(spark, sf_dir, "events")
    m = F.col("event_id") % JSON_MOD
    ts = F.col("ts").cast("timestamp")
    epoch, value, k = epoch_seconds_double(ts).cast("string"), F.col("value").cast("string"), _volume_k().cast("string")
    time = (F.when(m == 13, _text(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))).when(m == 37, _text(epoch))
            .when(m == 41, _text(F.lit("soon"))).when(m != 31, epoch))
    price = F.when(m == 11, F.lit("null")).when(m == 19, _text(value)).when(m == 23, _text(F.lit("n/a"))).otherwise(value)
    volume = F.when(m == 17, F.concat(k, F.lit(".5"))).when(m == 43, _text(k)).when(m == 47, _text(F.lit("many"))).otherwise(k)
    source = F.when(F.col("event_id") % 10 == 0, F.lit(BACKFILL_SOURCE)).otherwise(F.lit(LIVE_SOURCE))
    body = _object([("event_id", F.when(m != 29, _text(F.col("event_id").cast("string")))), ("timestamp", time),
                    ("symbol", _text(F.col("event_type"))), ("price", price), ("volume", volume), ("source", _text(source))])
    value = F.when(m == 7, F.substring(body, 1, 20)).otherwise(body)
    return ev.select(F.col("event_id").alias("offset"), F.upper(F.trim("event_type")).alias("key"), value.alias("value"))


def _text(c: F.Column) -> F.Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _object(fields: list[tuple[str, F.Column]]) -> F.Column:
    """JSON text of the fields that are there."""
    return F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{n}": '), v) for n, v in fields]), F.lit("}"))


def alerts_json(alerts: DataFrame) -> DataFrame:
    """Alert messages by source_event_id % 11. 1: ISO time, 2: volume with a fraction, 3: no event_id, 4: cut
    short, 5: epoch as text, 6: unreadable time, 7: no message, 8: price as text, 9: volume as text."""
    n = F.col("source_event_id").cast("long")
    m = n % 11
    epoch, price = epoch_seconds_double("time").cast("string"), F.col("trigger_price").cast("string")
    time = (F.when(m == 1, _text(F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))).when(m == 5, _text(epoch))
            .when(m == 6, _text(F.lit("soon"))).otherwise(epoch))
    body = _object([("event_id", F.when(m != 3, _text(F.col("event_id")))), ("timestamp", time), ("symbol", _text(F.col("symbol"))),
                    ("alert_type", _text(F.col("alert_type"))), ("severity", _text(F.col("severity"))),
                    ("message", F.when(m != 7, _text(F.col("message")))),
                    ("trigger_price", F.when(m == 8, _text(price)).otherwise(price)),
                    ("trigger_volume", F.when(m == 2, F.lit("12.5")).when(m == 9, _text(F.lit("34"))))])
    return alerts.select(n.alias("offset"), F.when(m == 4, F.substring(body, 1, 30)).otherwise(body).alias("value"))


def alerts_dirty(alerts: DataFrame) -> DataFrame:
    """Alerts spoiled by source_event_id % 13. 1: no id, 2: epoch 0, 3: blank symbol, 4: no type, 5: null severity,
    6: no message, 7: price -1, 8: volume -1, 9: window 0, 10: symbol in lower case with padding (valid)."""
    m = F.col("source_event_id").cast("long") % 13
    return alerts.withColumns({
        "event_id": F.when(m == 1, F.lit("")).otherwise(F.col("event_id")),
        "time": F.when(m == 2, F.lit("1970-01-01 00:00:00").cast("timestamp")).otherwise(F.col("time")),
        "symbol": F.when(m == 3, F.lit("  ")).when(m == 10, F.concat(F.lit(" "), F.lower("symbol"), F.lit(" "))).otherwise(F.col("symbol")),
        "alert_type": F.when(m == 4, F.lit("")).otherwise(F.col("alert_type")),
        "severity": F.when(m != 5, F.col("severity")),
        "message": F.when(m == 6, F.lit("")).otherwise(F.col("message")),
        "trigger_price": F.when(m == 7, F.lit(-1.0)).otherwise(F.col("trigger_price")),
        "trigger_volume": F.when(m == 8, F.lit(-1).cast("long")).otherwise(F.col("trigger_volume")),
        "window_sec": F.when(m == 9, F.lit(0)).otherwise(F.col("window_sec"))})


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-minute bars (time, symbol, close, volume) built from the ticks."""
    from tickspark.operators.candles import candles
    c = candles(ticks(spark, sf_dir), 60)
    return c.select("time", "symbol", "close", "volume")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User rules for every symbol seen in the data: price_above 100,
    price_below 1, volume_above 90; the first symbol also has an unknown rule
    type, a duplicate price_above 100 (same cooldown key) and a threshold whose cents are a tie (250.125). The ordering
    window runs over the distinct symbols only (the tracked universe)."""
    syms = ticks(spark, sf_dir).select("symbol").distinct()
    ranked = syms.withColumn("_rank", F.dense_rank().over(Window.orderBy("symbol")))
    templates = F.array(*[
        F.struct(F.lit(pos).alias("pos"), F.lit(rt).alias("rule_type"), F.lit(th).alias("threshold"))
        for pos, rt, th in RULE_TEMPLATES])
    rows = (ranked.select("symbol", "_rank", F.explode(templates).alias("t"))
            .filter((F.col("t.pos") < 3) | (F.col("_rank") == 1)))
    rule_id = (F.col("_rank") * 10 + F.col("t.pos")).cast("long")
    return rows.select(
        rule_id.alias("id"),
        F.col("symbol"),
        F.col("t.rule_type").alias("rule_type"),
        F.col("t.threshold").alias("threshold"),
        F.lit(60).alias("window_sec"),
        F.timestamp_micros(F.lit(RULES_EPOCH_US) + rule_id * F.lit(1_000_000)).alias("created_at"),
    )


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service heartbeats: every event is a processed message of the service
    named by its event type; one beat per service and 10-second bucket."""
    from tickspark.operators.serve import heartbeat_log
    ev = table(spark, sf_dir, "events")
    return heartbeat_log(ev.select(F.col("event_type").alias("service_name"),
                                   F.col("ts").cast("timestamp").alias("time"), "user_id"),
                         metrics={"users": F.countDistinct("user_id"), "last_user": F.max("user_id")})


def as_of() -> F.Column:
    return ts_literal(AS_OF_TEXT)
