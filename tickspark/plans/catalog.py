"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame
over the full driver tables. Names and output columns match
``tickspark.plans.oracle``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickspark.functions.timefn import market_open, ts_literal
from tickspark.functions.values import fmt_fixed, fmt_money, nan_to_null, py_float, py_float_commas, truthy_coalesce
from tickspark.operators import alerts as alerts_op
from tickspark.operators import candles as candles_op
from tickspark.operators import detect, indicators, route, rules, serve, validate
from tickspark.plans import oracle
from tickspark.schemas import HEATMAP_SYMBOL_COUNT
from tickspark.session import ensure_checkpoint_dir
from tickspark.sources import codec, fixtures as fx, sinks
from tickspark.sources.alert_store import AlertStore
from tickspark.streaming.jobs import CandleStore

CANDLE_COLS = candles_op.CANDLE_COLUMNS


def finalize(df: DataFrame) -> DataFrame:
    """Timestamps leave as ``timestamp_ntz`` (UTC wall clock), so collected
    values do not depend on the reader's time zone."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampType):
            out.append(F.col(f.name).cast("timestamp_ntz").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def _as_of():
    return ts_literal(fx.AS_OF_TEXT)


def _deliveries(spark, d):
    return alerts_op.deliveries(alerts_op.build_alerts(
        alerts_op.unified_detections(fx.ticks_burst(spark, d), fx.rules(spark, d))))


#: (application, data folder) -> the alert table stored there.
_STORES: dict[tuple[str, str], AlertStore] = {}


def _alerts(spark, d):
    """The stored alert table that serving reads: detection runs once a session and data folder, when the
    deliveries are inserted into the shared folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORES:
        store = AlertStore(f"{ensure_checkpoint_dir(spark).rstrip('/')}/alert-table-{uuid.uuid4().hex}")
        store.insert(_deliveries(spark, d), 0)
        _STORES[key] = store
    return _STORES[key].read(spark).drop("arrival")


def _candles_multi(spark, d):
    return candles_op.candles_multi(fx.ticks(spark, d), [60, 300, 900])


def _series(spark, d):
    t = fx.ticks(spark, d)
    return serve.loaded_series(candles_op.candles(t, 60), _alerts(spark, d), limit=300)


def q_candles(w: int):
    def run(spark, d):
        return candles_op.candles(fx.ticks(spark, d), w)
    return run


def q_candles_exploded(spark, d):
    return candles_op.candles_exploded(fx.ticks(spark, d), [60, 300, 900])


def q_candle_rollup(spark, d):
    """3600 s candles rolled up from 60 s candles that carry their exact
    price*volume sums."""
    return candles_op.rollup(candles_op.candles(fx.ticks(spark, d), 60, keep_pv=True), 3600)


def q_candle_upsert(spark, d):
    """Replays the ticks as micro-batches of 1,000 arrivals, logs the state of
    every touched candle per batch, and reads the log back."""
    t = fx.ticks(spark, d).withColumn("batch_id", (F.col("event_id").cast("long") / 1000).cast("long"))
    log = candles_op.candle_update_log(t, [60, 300, 900])
    return sinks.upsert_log_view(log).select(*CANDLE_COLS)


def q_candle_store(spark, d):
    """Three thirds of the arrivals stored as candle batches, compacted after the second, the last one tried
    twice, and the store read: base plus the newer batch."""
    t = fx.ticks(spark, d)
    n = F.col("event_id").cast("long")
    last = t.agg(F.max(n)).first()[0] or 0
    log = candles_op.candle_update_log(t.withColumn("batch_id", F.floor(n * 3 / (last + 1)).cast("long")), [60, 300, 900])
    store = CandleStore(f"{ensure_checkpoint_dir(spark).rstrip('/')}/candles-{uuid.uuid4().hex}")
    for b in (0, 1, 2, 2):
        store(log.filter(F.col("batch_id") == b), b)
        if b == 1:
            store.compact(spark)
    return store.read(spark).select(*CANDLE_COLS)


def q_volume_direction(spark, d):
    return candles_op.volume_direction(candles_op.candles(fx.ticks(spark, d), 60))


def q_throughput(spark, d):
    ev = fx.table(spark, d, "events")
    return serve.throughput(ev.select(F.col("event_type").alias("service_name"),
                                      F.col("ts").cast("timestamp").alias("time")))


def q_throughput_grid(spark, d):
    """Quarter hours of every service, idle ones included."""
    ev = fx.table(spark, d, "events")
    return serve.throughput_grid(ev.select(F.col("event_type").alias("service_name"), F.col("ts").cast("timestamp").alias("time")),
                                 900, fx.ticks(spark, d).select("symbol").distinct())


def q_normalize_symbol(spark, d):
    t = fx.ticks_dirty(spark, d)
    return t.select("event_id", F.col("symbol").alias("raw_symbol"), validate.normalize_symbol("symbol").alias("symbol"))


def q_validate_ticks(spark, d):
    v = validate.validate_ticks(fx.ticks_dirty(spark, d))
    return v.select("event_id", "time", "symbol", "price", "volume", "reasons", "is_valid")


def q_validate_candles(spark, d):
    return validate.validate_candles(_candles_multi(spark, d)).select(
        "time", "symbol", "window_sec", "reasons", "is_valid")


def q_validate_alerts(spark, d):
    return validate.validate_alerts(fx.alerts_dirty(_alerts(spark, d))).select(
        "event_id", "time", "symbol", "alert_type", "severity", "reasons", "is_valid")


def q_stale_flag(spark, d):
    return detect.stale_flag(fx.ticks(spark, d), _as_of()).select("event_id", "symbol", "time", "source", "is_stale")


def q_detect_gate(spark, d):
    dets = detect.detections(fx.ticks(spark, d), now=ts_literal("2024-01-30 00:00:00"))
    return dets.select("symbol", "time", "event_id", "seq", "alert_type", "severity")


def q_bollinger(spark, d):
    return detect.bollinger(fx.ticks(spark, d))


def q_bollinger_lower(spark, d):
    return detect.bollinger(fx.ticks_inverted(spark, d))


def q_volume_spike(spark, d):
    return detect.volume_spikes(fx.ticks_burst(spark, d))


def q_price_jump(spark, d):
    return detect.price_jumps(fx.ticks(spark, d))


def q_bollinger_chunked(spark, d):
    """The same as ``bollinger`` with chunks of at most 500 rows, each with a halo."""
    return detect.bollinger(fx.ticks(spark, d), target_rows=500)


def q_rule_cooldown_chunked(spark, d):
    c = rules.cooldown(rules.rule_matches(fx.ticks_burst(spark, d), fx.rules(spark, d)), 7200, target_rows=200)
    return c.select("event_id", "symbol", "time", "rule_id", "rule_key")


def q_detections_all(spark, d):
    u = alerts_op.unified_detections(fx.ticks_burst(spark, d), fx.rules(spark, d))
    return u.select("symbol", "time", "event_id", "seq", "alert_type", "severity", "message", "value")


def q_build_alerts(spark, d):
    return _alerts(spark, d).select("event_id", "time", "symbol", "alert_type", "severity", "message",
                                         "trigger_price")


def q_alert_metadata(spark, d):
    """One row per metadata entry."""
    return _alerts(spark, d).select("event_id", F.explode("metadata").alias("key", "value"))


def q_alert_envelope(spark, d):
    dets = detect.detections(fx.ticks_burst(spark, d))
    return alerts_op.alert_envelope(dets, _as_of())


def q_rule_match(spark, d):
    m = rules.rule_matches(fx.ticks(spark, d), fx.rules(spark, d))
    return m.select("event_id", "symbol", "time", "rule_id", "rule_type", "threshold", "value", "rule_key")


def q_rule_messages(spark, d):
    m = rules.rule_messages(rules.rule_matches(fx.ticks(spark, d), fx.rules(spark, d)))
    return m.select("event_id", "rule_id", "alert_type", "severity", "message")


def q_rule_cooldown(spark, d):
    c = rules.cooldown(rules.rule_matches(fx.ticks(spark, d), fx.rules(spark, d)))
    return c.select("event_id", "symbol", "time", "rule_id", "rule_key")


def rule_log(spark, d) -> DataFrame:
    """Rule change-log derived from the events: each event is a rule edit of
    user ``user_id`` (the rule id); 'error' events delete the rule."""
    ev = fx.table(spark, d, "events")
    rt = F.element_at(F.array(*[F.lit(x) for x in ["price_above", "price_below", "volume_above"]]),
                      (F.col("event_id") % 3 + 1).cast("int"))
    return ev.select(F.col("user_id").alias("id"),
                     F.when(F.col("event_type") == "error", F.lit("delete")).otherwise(F.lit("add")).alias("op"),
                     F.upper(F.trim("event_type")).alias("symbol"), rt.alias("rule_type"),
                     F.col("value").alias("threshold"), F.lit(60).alias("window_sec"),
                     F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


def q_rules_current(spark, d):
    return rules.current_rules(rule_log(spark, d))


def q_latest_price(spark, d):
    return serve.latest_price(fx.ticks(spark, d))


def q_candlesticks_alerts(spark, d):
    t = fx.ticks(spark, d)
    return serve.candlesticks(candles_op.candles(t, 60), _alerts(spark, d), 60, limit=100)


def q_candle_alert_history(spark, d):
    """Every one-minute candle with its alerts, from tables bucketed alike."""
    name = f"history_{uuid.uuid4().hex}"
    history = serve.JoinedHistory(name, ensure_checkpoint_dir(spark).rstrip("/"), 60, buckets=8)
    history.store(candles_op.candles(fx.ticks(spark, d), 60), _alerts(spark, d))
    return history.read(spark)


def q_recent_alerts(spark, d):
    return serve.recent_alerts(_alerts(spark, d), None, 50)


def q_recent_alerts_symbol(spark, d):
    return serve.recent_alerts(_alerts(spark, d), oracle.FOCUS_SYMBOL, 50)


def q_heatmap_long(spark, d):
    t = fx.ticks(spark, d)
    return serve.heatmap_long(candles_op.candles(t, 60), _alerts(spark, d), serve.first_symbols(t, HEATMAP_SYMBOL_COUNT), 20)


def q_heatmap(spark, d):
    t = fx.ticks(spark, d)
    return serve.heatmap(candles_op.candles(t, 60), _alerts(spark, d), serve.first_symbols(t, HEATMAP_SYMBOL_COUNT), 20)


def q_heatmap_json(spark, d):
    """The nested heatmap as the text a client receives."""
    return q_heatmap(spark, d).select("symbol", F.to_json("timeline").alias("timeline"))


def _deep(spark, d):
    t = fx.ticks(spark, d)
    return serve.deep_dive(candles_op.candles(t, 300), _alerts(spark, d))


def q_deep_dive(spark, d):
    return _deep(spark, d).select(*serve.DEEP_DIVE_OUT)


def q_deep_dive_history(spark, d):
    return serve.deep_dive_history(_deep(spark, d))


def q_alerts_history(spark, d):
    return serve.alerts_history(_alerts(spark, d), oracle.FOCUS_SYMBOL, "high", 200)


def q_alerts_feed(spark, d):
    return serve.alerts_feed(_alerts(spark, d))


def q_price_change(spark, d):
    return serve.price_change(fx.ticks(spark, d), _series(spark, d))


def q_recent_trades(spark, d):
    return serve.recent_trades(_series(spark, d))


def q_ema(spark, d):
    e = indicators.ema_series(_series(spark, d), ["symbol"], "_pos", carry=["time"])
    return e.select("symbol", F.col("_pos").cast("long").alias("pos"), "time", "close", "ema")


def q_symbol_summary(spark, d):
    e = indicators.ema_series(_series(spark, d), ["symbol"], "_pos", carry=["_rank", "vwap", "low", "high"])
    last = e.filter(F.col("_rank") == 1)
    return last.select("symbol", truthy_coalesce("vwap", F.lit(0.0)).alias("vwap"),
                       truthy_coalesce("ema", F.lit(0.0)).alias("ema"),
                       F.col("low").alias("day_low"), F.col("high").alias("day_high"))


def q_anomaly_markers(spark, d):
    return serve.anomaly_markers(_series(spark, d))


def q_moving_averages(spark, d):
    return indicators.moving_averages(_candles_multi(spark, d)).drop("event_id")


def q_moving_averages_chunked(spark, d):
    """The same with chunks of at most 200 candles: averages and values carried from chunk to chunk."""
    return indicators.moving_averages(_candles_multi(spark, d), target_rows=200).drop("event_id")


def q_number_formats(spark, d):
    """Values whose cents are ties, near ties, large and tiny ones, as notifications print them."""
    v = F.col("value")
    out = fx.table(spark, d, "events").select("event_id", *[x.alias(n) for n, x in [
        ("eighth", F.round(v) / 8), ("near", v + 0.005), ("large", v * 1234567.0), ("tiny", -v / 1e7)]])
    return out.select("event_id", *[fmt_money(c).alias(f"{c}_money") for c in ("eighth", "near", "large", "tiny")],
                      *[fmt_fixed(c, 4).alias(f"{c}_fixed") for c in ("eighth", "near", "large", "tiny")],
                      *[py_float(c).alias(f"{c}_repr") for c in ("eighth", "near", "large", "tiny")],
                      py_float_commas("large").alias("large_commas"), py_float_commas("eighth").alias("eighth_commas"))


def q_nan_to_null(spark, d):
    v = F.col("value")
    return nan_to_null(fx.table(spark, d, "events").select(
        "event_id", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 != 0, v).alias("value"),
        "event_type"))


def q_market_open(spark, d):
    return fx.ticks(spark, d).select("event_id", "time", market_open("time").alias("is_open"))


def q_route_alerts(spark, d):
    return route.route(_alerts(spark, d)).select("event_id", "channel", "severity")


def q_chat_outbox(spark, d):
    return route.chat_outbox(route.route(_alerts(spark, d)).filter(F.col("channel") == "chat"))


def q_mail_outbox(spark, d):
    m = route.mail_outbox(route.route(_alerts(spark, d)).filter(F.col("channel") == "mail"))
    return m.select("event_id", "symbol", "severity", "subject", "text", "html")


def q_recipients(spark, d):
    m = route.mail_outbox(route.route(_alerts(spark, d)).filter(F.col("channel") == "mail"))
    return route.recipients(m, oracle.RECIPIENTS)


def q_decode_ticks(spark, d):
    return codec.decode_ticks(fx.ticks_json(spark, d), now=_as_of()).select(
        "event_id", "timestamp", "time", "symbol", "price", "volume", "source")


def q_decode_rejects(spark, d):
    return codec.decode_ticks_with_rejects(fx.ticks_json(spark, d))[1].select("offset", "reason")


def q_decode_alerts(spark, d):
    a = codec.decode_alerts(fx.alerts_json(_alerts(spark, d)))
    return a.select("event_id", sinks.alert_time(F.col("timestamp"), _as_of()).alias("time"), "symbol", "alert_type", "severity",
                    F.coalesce("message", F.lit("Anomaly detected")).alias("message"), "trigger_price", "trigger_volume")


def q_encode_decode(spark, d):
    """Ticks written as messages and read back."""
    return codec.decode_ticks(codec.encode_events(fx.ticks(spark, d))).select(
        "event_id", "time", "symbol", "price", "volume", "source", "bid")


def q_ticks_persist(spark, d):
    return sinks.persist_ticks(codec.parse_ticks(fx.ticks_json(spark, d)), _as_of())


def q_alert_dedup(spark, d):
    return sinks.dedup_alerts(_deliveries(spark, d), "arrival").select(
        "event_id", "time", "symbol", "alert_type", "severity", "message", "trigger_price")


def q_alert_insert(spark, d):
    """The deliveries inserted in three batches by arrival, the second one tried twice, and the table read back."""
    store = AlertStore(f"{ensure_checkpoint_dir(spark).rstrip('/')}/alert-inserts-{uuid.uuid4().hex}")
    arrived = _deliveries(spark, d).checkpoint()
    batch = F.when(F.col("arrival") >= alerts_op.REDELIVERED, 2).otherwise(F.col("arrival") % 2)
    for n in (0, 1, 1, 2):
        store.insert(arrived.filter(batch == n), n)
    return store.read(spark).select("event_id", "time", "symbol", "alert_type", "severity", "message", "arrival")


def q_alert_enrich(spark, d):
    return sinks.enrich_alerts(_alerts(spark, d)).select(
        "event_id", "time", "trigger_volume", "zscore", "reference_value", "window_sec")


def q_backfill_tail(spark, d):
    return sinks.backfill_ticks(fx.bars(spark, d), 60).select("time", "symbol", "price", "volume", "source")


def q_latest_bar(spark, d):
    return sinks.latest_bar_ticks(fx.bars(spark, d), _as_of())


def q_health_latest(spark, d):
    return serve.health_latest(fx.heartbeats(spark, d))


def q_health_liveness(spark, d):
    return serve.health_liveness(serve.health_latest(fx.heartbeats(spark, d)), _as_of())


def q_encode_ticks(spark, d):
    return codec.encode_events(fx.ticks(spark, d))


def q_retention(spark, d):
    return sinks.retain(fx.ticks(spark, d), 24, _as_of()).select("event_id", "time", "symbol")


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "candles_60": q_candles(60),
    "candles_300": q_candles(300),
    "candles_900": q_candles(900),
    "candles_multi": _candles_multi,
    "candles_exploded": q_candles_exploded,
    "candle_rollup": q_candle_rollup,
    "candle_upsert": q_candle_upsert,
    "candle_store": q_candle_store,
    "volume_direction": q_volume_direction,
    "throughput": q_throughput,
    "throughput_grid": q_throughput_grid,
    "normalize_symbol": q_normalize_symbol,
    "validate_ticks": q_validate_ticks,
    "validate_candles": q_validate_candles,
    "validate_alerts": q_validate_alerts,
    "stale_flag": q_stale_flag,
    "detect_gate": q_detect_gate,
    "bollinger": q_bollinger,
    "bollinger_lower": q_bollinger_lower,
    "bollinger_chunked": q_bollinger_chunked,
    "volume_spike": q_volume_spike,
    "price_jump": q_price_jump,
    "detections_all": q_detections_all,
    "build_alerts": q_build_alerts,
    "alert_metadata": q_alert_metadata,
    "alert_envelope": q_alert_envelope,
    "rule_match": q_rule_match,
    "rule_messages": q_rule_messages,
    "rule_cooldown": q_rule_cooldown,
    "rule_cooldown_chunked": q_rule_cooldown_chunked,
    "rules_current": q_rules_current,
    "latest_price": q_latest_price,
    "candlesticks_alerts": q_candlesticks_alerts,
    "candle_alert_history": q_candle_alert_history,
    "recent_alerts": q_recent_alerts,
    "recent_alerts_symbol": q_recent_alerts_symbol,
    "heatmap_long": q_heatmap_long,
    "heatmap": q_heatmap,
    "heatmap_json": q_heatmap_json,
    "deep_dive": q_deep_dive,
    "deep_dive_history": q_deep_dive_history,
    "alerts_history": q_alerts_history,
    "alerts_feed": q_alerts_feed,
    "price_change": q_price_change,
    "recent_trades": q_recent_trades,
    "ema": q_ema,
    "symbol_summary": q_symbol_summary,
    "anomaly_markers": q_anomaly_markers,
    "moving_averages": q_moving_averages,
    "moving_averages_chunked": q_moving_averages_chunked,
    "market_open": q_market_open,
    "number_formats": q_number_formats,
    "route_alerts": q_route_alerts,
    "chat_outbox": q_chat_outbox,
    "mail_outbox": q_mail_outbox,
    "recipients": q_recipients,
    "decode_ticks": q_decode_ticks,
    "ticks_persist": q_ticks_persist,
    "decode_rejects": q_decode_rejects,
    "alert_dedup": q_alert_dedup,
    "alert_insert": q_alert_insert,
    "alert_enrich": q_alert_enrich,
    "decode_alerts": q_decode_alerts,
    "backfill_tail": q_backfill_tail,
    "latest_bar": q_latest_bar,
    "retention": q_retention,
    "nan_to_null": q_nan_to_null,
    "health_latest": q_health_latest,
    "health_liveness": q_health_liveness,
    "encode_ticks": q_encode_ticks,
    "encode_decode": q_encode_decode,
}

# Queries without a SQL oracle (nested or JSON-text output): rows-only check.
ROWS_ONLY = {"heatmap", "encode_ticks"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finalize(fn(spark, sf_dir))
        run.__name__ = getattr(fn, "__name__", "query")
        return run
    return {name: wrap(fn) for name, fn in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    sql = oracle.queries_sql()
    return {k: v for k, v in sql.items() if k in REGISTRY and k not in ROWS_ONLY}
