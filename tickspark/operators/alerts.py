"""Alert records built from detections (automatic and user rules)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.functions.values import py_float
from tickspark.operators import detect, rules as rules_op
from tickspark.operators.detect import DETAIL_FIELDS

ALERT_COLUMNS = ["event_id", "time", "symbol", "alert_type", "severity", "message", "trigger_price",
                 "trigger_volume", "zscore", "reference_value", "window_sec", "metadata"]


def alert_id(symbol: Column, alert_type: Column, source_event: Column, rule_key: Column) -> Column:
    """Deterministic alert id: a retried or recomputed task emits the same id,
    so downstream dedup on (event_id, time) is idempotent. The rule key (null for
    automatic alerts) tells apart the user rules that fire on one tick."""
    return F.sha2(F.concat_ws("_", symbol, alert_type, source_event, rule_key), 256)


#: Columns of unified detections before the detail fields.
DETECTION_COLUMNS = ["symbol", "time", "event_id", "price", "seq", "alert_type", "severity", "message", "value", "rule_key"]


def unified_detections(ticks: DataFrame, rules: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """User-rule detections (after cooldown) first, then the automatic ones
    (gated), in one long frame: symbol, time, event_id (of the tick), price,
    alert_type, severity, message, value, rule_key, ``seq`` (0 user, 1-3 detectors)
    and the detector detail columns."""
    auto = auto_rows(detect.detections(ticks, now=now))
    return auto if rules is None else user_rows(rules_op.user_detections(ticks, rules)).unionByName(auto)


def auto_rows(dets: DataFrame) -> DataFrame:
    none = {"message": "string", "value": "double", "rule_key": "string"}
    return dets.withColumns({n: F.lit(None).cast(t) for n, t in none.items()}).select(
        *DETECTION_COLUMNS, *[n for n, _ in DETAIL_FIELDS])


def user_rows(fired: DataFrame) -> DataFrame:
    return fired.withColumn("seq", F.lit(0)).select(
        *DETECTION_COLUMNS, *[F.lit(None).cast(t).alias(n) for n, t in DETAIL_FIELDS])


def _detail_text(name: str, typ: str) -> Column:
    return py_float(name) if typ == "double" else F.col(name)


def build_alerts(dets: DataFrame, now: Column | None = None) -> DataFrame:
    """Alert rows: id, alert time (``now`` when given, else the tick time:
    replay), type, severity, message (default 'Threshold breached'),
    trigger_price = the tick price, metadata = every other detection field."""
    fields = [*DETAIL_FIELDS, ("value", "double")]
    entries = [F.struct(F.lit(n).alias("k"), _detail_text(n, t).alias("v")) for n, t in fields]
    meta = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"].isNotNull()))
    return dets.select(
        alert_id(F.col("symbol"), F.col("alert_type"), F.col("event_id"), F.col("rule_key")).alias("event_id"),
        (now if now is not None else F.col("time")).alias("time"),
        "symbol", "alert_type", "severity",
        F.coalesce(F.col("message"), F.lit("Threshold breached")).alias("message"),
        F.col("price").alias("trigger_price"),
        F.lit(None).cast("long").alias("trigger_volume"),
        F.lit(None).cast("double").alias("zscore"),
        F.lit(None).cast("double").alias("reference_value"),
        F.lit(None).cast("int").alias("window_sec"),
        meta.alias("metadata"),
        F.col("event_id").alias("source_event_id"))


def alert_envelope(dets: DataFrame, published_at: Column) -> DataFrame:
    """Publisher envelope: alert_id = ticker_type_timestamp, detected_at,
    published_at, anomaly_type, severity and ``details``, the detection as JSON text (numbers as
    a Python float prints, absent fields left out)."""
    detected = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    quoted = lambda n: F.concat(F.lit(f'"{n}": "'), F.col(n), F.lit('"'))
    parts = [F.concat(F.lit('"type": "'), F.col("alert_type"), F.lit('"')), quoted("severity")]
    parts += [F.when(F.col(n).isNotNull(), quoted(n) if t == "string" else F.concat(F.lit(f'"{n}": '), py_float(n)))
              for n, t in DETAIL_FIELDS]
    return dets.select(
        F.concat_ws("_", "symbol", "alert_type", detected).alias("alert_id"),
        F.col("symbol").alias("ticker"),
        detected.alias("detected_at"),
        F.date_format(published_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("published_at"),
        F.col("alert_type").alias("anomaly_type"),
        "severity",
        F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("details"))


#: Arrival numbers of second deliveries start here.
REDELIVERED = 1_000_000_000_000


def deliveries(alerts: DataFrame, repeat_mod: int = 7) -> DataFrame:
    """Alerts as they arrive: at-least-once delivery with an ``arrival`` number. Every alert whose tick id
    is divisible by ``repeat_mod`` arrives again later, with another message and severity, so it
    matters which copy a store keeps."""
    tick = F.col("source_event_id").cast("long")
    copies = F.when(tick % repeat_mod == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    out = alerts.withColumn("_again", F.explode(copies))  # one pass over the detections, not a union of two
    again = F.col("_again")
    return (out.withColumn("arrival", tick + F.when(again, F.lit(REDELIVERED)).otherwise(F.lit(0)))
            .withColumn("message", F.when(again, F.concat(F.lit("again: "), F.col("message"))).otherwise(F.col("message")))
            .withColumn("severity", F.when(again, F.lit("low")).otherwise(F.col("severity"))).drop("_again"))


def alerts_table(ticks: DataFrame, rules: DataFrame | None = None, repeat_mod: int = 7) -> DataFrame:
    """Detections on the ticks as delivered alerts, second deliveries included."""
    return deliveries(build_alerts(unified_detections(ticks, rules)), repeat_mod).drop("arrival")
