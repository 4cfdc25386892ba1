"""DuckDB oracle SQL for every registered query.

Each query is self-contained: it re-derives the fixture views (ticks,
candles, alerts, rules, ...) from the driver's base tables with the same
rules as ``tickspark.sources.fixtures`` and then states the operator
semantics in plain SQL (windows, recursive CTE for the cooldown fold,
list_reduce for the EMA). Column names and types match the Spark queries.
"""

from __future__ import annotations

from tickspark.schemas import HEATMAP_SYMBOL_COUNT

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
GATE_NOW = "TIMESTAMP '2024-01-30 00:00:00'"
FOCUS_SYMBOL = "CLICK"
RECIPIENTS = "ops@example.com, ,risk@example.com,  "

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
SOURCE = "CASE WHEN event_id % 10 = 0 THEN 'yfinance-backfill' ELSE 'yfinance' END"


def _ticks_from(volume: str, price: str = "value") -> str:
    return f"""SELECT CAST(ts AS TIMESTAMP) AS time, upper(trim(event_type)) AS symbol, {price} AS price,
           {volume} AS volume, CAST(NULL AS DOUBLE) AS bid, CAST(NULL AS DOUBLE) AS ask,
           {SOURCE} AS source, CAST(event_id AS VARCHAR) AS event_id
    FROM events"""


def _candles(src: str, w: int) -> str:
    w_us = w * 1_000_000
    return f"""SELECT make_timestamp(b) AS time, symbol, CAST({w} AS INTEGER) AS window_sec, open, high, low, close,
           volume, CASE WHEN volume > 0 THEN pv / volume ELSE open END AS vwap, trade_count,
           make_timestamp(b + {w_us}) AS window_end
    FROM (SELECT symbol, (epoch_us(time) // {w_us}) * {w_us} AS b,
                 arg_min(price, {{'t': time, 'e': event_id}}) AS open, max(price) AS high, min(price) AS low,
                 arg_max(price, {{'t': time, 'e': event_id}}) AS close,
                 CAST(sum(volume) AS BIGINT) AS volume, sum(price * volume) AS pv, count(*) AS trade_count
          FROM {src}
          WHERE symbol IS NOT NULL AND symbol <> '' AND epoch_us(time) <> 0
          GROUP BY symbol, b)"""


def _stats(src: str) -> str:
    win = "PARTITION BY symbol ORDER BY time, event_id"
    return f"""SELECT *,
        count(*) OVER ({win} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS bb_n,
        avg(price) OVER ({win} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS bb_mean,
        stddev_pop(price) OVER ({win} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS bb_std,
        count(*) OVER ({win} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS vol_n,
        avg(CAST(volume AS DOUBLE)) OVER ({win} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS vol_mean,
        stddev_pop(CAST(volume AS DOUBLE)) OVER ({win} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS vol_std,
        count(*) OVER ({win} ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING) AS jump_n,
        avg(price) OVER ({win} ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING) AS jump_mean,
        stddev_pop(price) OVER ({win} ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING) AS jump_std
    FROM {src}"""


def _sev_z(z: str) -> str:
    return f"CASE WHEN {z} > 4 THEN 'high' WHEN {z} > 3 THEN 'medium' ELSE 'low' END"


BB_UP = "bb_mean + 2.0 * bb_std"
BB_DN = "bb_mean - 2.0 * bb_std"
BB_READY = "bb_n = 20 AND bb_std > 0"
VOL_Z = "(CAST(volume AS DOUBLE) - vol_mean) / vol_std"
VOL_READY = "vol_n = 30 AND vol_std > 0"
JUMP_DEV = "abs(price - jump_mean) / jump_std"
JUMP_READY = "bb_n = 20 AND jump_n = 19 AND jump_std > 0"


def _bb_severity() -> str:
    beyond = f"(CASE WHEN price > {BB_UP} THEN price - ({BB_UP}) ELSE ({BB_DN}) - price END)"
    return f"CASE WHEN {beyond} / bb_std > 1 THEN 'high' ELSE 'medium' END"


#: Detail columns of a detection, in the order of its JSON text.
DETAILS = ["direction", "upper_band", "lower_band", "middle_band", "std", "z_score", "current_volume", "rolling_mean_volume",
           "rolling_std_volume", "threshold", "prior_mean", "prior_std", "deviation_sigmas", "threshold_sigmas"]


def _details(**given: str) -> str:
    types = {"direction": "VARCHAR"}
    return ", ".join(f"CAST({given.get(n, 'NULL')} AS {types.get(n, 'DOUBLE')}) AS {n}" for n in DETAILS)


def _dets(stats: str, gate: str) -> str:
    """Automatic detections, long form (seq 1..3), gate applied."""
    bb = _details(direction=f"CASE WHEN price > {BB_UP} THEN 'above upper band' ELSE 'below lower band' END",
                  upper_band=f"round({BB_UP}, 4)", lower_band=f"round({BB_DN}, 4)", middle_band="round(bb_mean, 4)",
                  std="round(bb_std, 4)")
    vol = _details(z_score=f"round({VOL_Z}, 3)", current_volume="volume", rolling_mean_volume="round(vol_mean, 2)",
                   rolling_std_volume="round(vol_std, 2)", threshold="3.0")
    jump = _details(prior_mean="round(jump_mean, 4)", prior_std="round(jump_std, 4)", deviation_sigmas=f"round({JUMP_DEV}, 3)",
                    threshold_sigmas="3.0")
    return f"""SELECT symbol, time, event_id, price, 1 AS seq, 'BOLLINGER_BREACH' AS alert_type, {_bb_severity()} AS severity, {bb}
    FROM {stats} WHERE {gate} AND {BB_READY} AND (price > {BB_UP} OR price < {BB_DN})
    UNION ALL
    SELECT symbol, time, event_id, price, 2, 'VOLUME_SPIKE', {_sev_z(f'abs({VOL_Z})')}, {vol}
    FROM {stats} WHERE {gate} AND {VOL_READY} AND abs({VOL_Z}) >= 3.0
    UNION ALL
    SELECT symbol, time, event_id, price, 3, 'PRICE_JUMP', {_sev_z(JUMP_DEV)}, {jump}
    FROM {stats} WHERE {gate} AND {JUMP_READY} AND {JUMP_DEV} >= 3.0"""


def _rules(src: str = "ticks") -> str:
    return f"""syms AS (SELECT DISTINCT symbol FROM {src}),
ranked AS (SELECT symbol, dense_rank() OVER (ORDER BY symbol) AS rk FROM syms),
tmpl AS (SELECT * FROM (VALUES (0, 'price_above', 100.0), (1, 'price_below', 1.0), (2, 'volume_above', 90.0),
                               (3, 'volume_spike', 3.0), (4, 'price_above', 100.0), (5, 'price_above', 250.125))
         v(pos, rule_type, threshold)),
rules AS (SELECT CAST(rk * 10 + pos AS BIGINT) AS id, symbol, rule_type, CAST(threshold AS DOUBLE) AS threshold,
                 60 AS window_sec, make_timestamp(1704067200000000 + (rk * 10 + pos) * 1000000) AS created_at
          FROM ranked, tmpl WHERE pos < 3 OR rk = 1),
hits AS (SELECT t.event_id, t.symbol, t.time, t.source, t.price, t.volume, r.id AS rule_id, r.rule_type, r.threshold,
                r.window_sec, concat_ws('_', t.symbol, r.rule_type, CAST(r.threshold AS VARCHAR)) AS rule_key,
                CASE WHEN contains(r.rule_type, 'volume') THEN CAST(t.volume AS DOUBLE) ELSE t.price END AS value
         FROM {src} t JOIN rules r ON t.symbol = r.symbol
         WHERE (r.rule_type = 'price_above' AND t.price > r.threshold)
            OR (r.rule_type = 'price_below' AND t.price < r.threshold)
            OR (r.rule_type = 'volume_above' AND t.volume > r.threshold))"""


RULES = _rules()


def _cooldown(seconds: int = 300) -> str:
    us = seconds * 1_000_000
    return f"""seqd AS (SELECT *, epoch_us(time) AS t_us,
                 row_number() OVER (PARTITION BY rule_key ORDER BY time, rule_id, event_id) AS rn FROM hits),
fold(rule_key, rn, last_us, fired) AS (
    SELECT rule_key, rn, t_us, true FROM seqd WHERE rn = 1
    UNION ALL
    SELECT s.rule_key, s.rn, CASE WHEN s.t_us - f.last_us > {us} THEN s.t_us ELSE f.last_us END,
           s.t_us - f.last_us > {us}
    FROM fold f JOIN seqd s ON s.rule_key = f.rule_key AND s.rn = f.rn + 1),
fired AS (SELECT s.* FROM seqd s JOIN fold f USING (rule_key, rn) WHERE f.fired)"""


COOLDOWN = _cooldown()


def _py_commas(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN format('{{:,.1f}}', {x}) ELSE format('{{:,}}', {x}) END"


MESSAGE = ("CASE WHEN rule_type = 'price_above' THEN '\U0001F6A8 ' || symbol || ' PRICE ALERT: Current $' || printf('%.2f', price) "
           "|| ' is above your threshold of $' || printf('%.2f', threshold) "
           "WHEN rule_type = 'price_below' THEN '\U0001F4C9 ' || symbol || ' PRICE ALERT: Current $' || printf('%.2f', price) "
           "|| ' is below your threshold of $' || printf('%.2f', threshold) "
           "WHEN rule_type = 'volume_above' THEN '\U0001F4CA ' || symbol || ' VOLUME ALERT: Current volume ' || "
           + _py_commas("CAST(volume AS DOUBLE)") + " || ' is above your threshold of ' || " + _py_commas("threshold")
           + " END")

_NO_DETAILS = ", ".join("NULL" for _ in DETAILS)
ALERTS = f"""all_dets AS (
    SELECT symbol, time, event_id, price, alert_type, severity, CAST(NULL AS VARCHAR) AS message, CAST(NULL AS DOUBLE) AS value,
           CAST(NULL AS VARCHAR) AS rule_key, {", ".join(DETAILS)} FROM dets
    UNION ALL
    SELECT symbol, time, event_id, price, 'USER_RULE', 'high', {MESSAGE}, value, rule_key, {_NO_DETAILS} FROM fired),
alerts_once AS (
    SELECT sha256(concat_ws('_', symbol, alert_type, event_id, rule_key)) AS event_id, time, symbol, alert_type, severity,
           coalesce(message, 'Threshold breached') AS message, price AS trigger_price, CAST(NULL AS BIGINT) AS trigger_volume,
           CAST(NULL AS DOUBLE) AS zscore, CAST(NULL AS DOUBLE) AS reference_value, CAST(NULL AS INTEGER) AS window_sec,
           event_id AS source_event_id, value, {", ".join(DETAILS)}
    FROM all_dets),
deliveries AS (SELECT *, CAST(source_event_id AS BIGINT) AS arrival FROM alerts_once
    UNION ALL
    SELECT * REPLACE ('again: ' || message AS message, 'low' AS severity), CAST(source_event_id AS BIGINT) + 1000000000000
    FROM alerts_once WHERE CAST(source_event_id AS BIGINT) % 7 = 0),
alerts AS (SELECT * FROM deliveries QUALIFY row_number() OVER (PARTITION BY event_id, time ORDER BY arrival) = 1)"""

# Fragment library: name -> SQL body. Order matters (dependencies first).
BASE = {
    "ticks": _ticks_from(K),
    "ticks_burst": _ticks_from(f"CAST(floor(value * ({K} + 1)) AS INTEGER)"),
    "ticks_inverted": _ticks_from(K, price="500.0 - value"),
}


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def cte(name: str, body: str) -> str:
    return f"{name} AS (\n{body})"


def ticks_cte(name: str = "ticks") -> str:
    return cte(name, BASE[name])


def candles_cte(w: int, src: str = "ticks", name: str | None = None) -> str:
    return cte(name or f"candles_{w}", _candles(src, w))


def dets_ctes() -> list[str]:
    return [ticks_cte("ticks_burst"), cte("stats", _stats("ticks_burst")),
            cte("dets", _dets("stats", "source <> 'yfinance-backfill'"))]


def alerts_ctes() -> list[str]:
    """The alert history: detections on the bursting ticks, delivered with repeats, first arrivals kept."""
    return [ticks_cte(), *dets_ctes(), _rules("ticks_burst"), COOLDOWN, ALERTS]


JOINED_DESC = "time DESC, al_time DESC NULLS LAST, anomaly_type DESC NULLS LAST, al_event_id DESC NULLS LAST"
def joined_cte(w: int, limit: int, name: str, symbol_filter: str = "") -> str:
    w_us = w * 1_000_000
    return cte(name, f"""SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY {JOINED_DESC}) AS rk FROM (
        SELECT c.symbol, c.time, c.open, c.high, c.low, c.close, c.volume, c.vwap, c.trade_count,
               a.alert_type AS anomaly_type, coalesce(a.severity, 'normal') AS severity,
               a.trigger_price AS anomaly_value, a.time AS al_time, a.event_id AS al_event_id
        FROM candles_{w} c LEFT JOIN alerts a
          ON c.symbol = a.symbol AND a.time >= c.time AND a.time < c.time + INTERVAL '{w} seconds'
        {symbol_filter})
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY {JOINED_DESC}) <= {limit}""")


CANDLE_OUT = ("symbol, time, open, high, low, close, volume, vwap, trade_count, anomaly_type, severity, "
              "anomaly_value")


def _dirty() -> str:
    m = "event_id % 97"
    price = f"CASE WHEN {m} = 1 THEN 0.0 ELSE value END"
    return f"""SELECT CASE WHEN {m} = 8 THEN TIMESTAMP '1970-01-01 00:00:00' ELSE CAST(ts AS TIMESTAMP) END AS time,
           CASE WHEN {m} = 3 THEN '  ' WHEN {m} = 9 THEN ' ' || event_type || ' ' ELSE upper(trim(event_type)) END AS symbol,
           {price} AS price,
           CASE WHEN {m} = 2 THEN -1 ELSE {K} END AS volume,
           CASE WHEN {m} = 4 THEN ({price}) + 1.0 WHEN {m} = 5 THEN -1.0 ELSE ({price}) - 0.01 END AS bid,
           ({price}) + 0.01 AS ask,
           CASE WHEN {m} = 6 THEN '' ELSE {SOURCE} END AS source,
           CASE WHEN {m} = 7 THEN '' ELSE CAST(event_id AS VARCHAR) END AS event_id
    FROM events"""


TICK_REASONS = """concat_ws(',',
    CASE WHEN event_id IS NULL OR trim(event_id) = '' THEN 'event_id' END,
    CASE WHEN time IS NULL OR epoch_us(time) <= 0 THEN 'timestamp' END,
    CASE WHEN symbol IS NULL OR trim(symbol) = '' THEN 'symbol' END,
    CASE WHEN price IS NULL OR price <= 0 THEN 'price' END,
    CASE WHEN volume IS NULL OR volume < 0 THEN 'volume' END,
    CASE WHEN source IS NULL OR source = '' THEN 'source' END,
    CASE WHEN bid IS NOT NULL AND bid <= 0 THEN 'bid' END,
    CASE WHEN ask IS NOT NULL AND ask <= 0 THEN 'ask' END,
    CASE WHEN bid IS NOT NULL AND ask IS NOT NULL AND bid > ask THEN 'bid_gt_ask' END)"""

CANDLE_REASONS = """concat_ws(',',
    CASE WHEN open <= 0 THEN 'open' END, CASE WHEN high <= 0 THEN 'high' END, CASE WHEN low <= 0 THEN 'low' END,
    CASE WHEN close <= 0 THEN 'close' END, CASE WHEN vwap <= 0 THEN 'vwap' END,
    CASE WHEN volume < 0 THEN 'volume' END, CASE WHEN trade_count < 0 THEN 'trade_count' END,
    CASE WHEN window_sec <= 0 THEN 'window_sec' END, CASE WHEN low > high THEN 'low_gt_high' END,
    CASE WHEN open < low OR open > high THEN 'open_range' END,
    CASE WHEN close < low OR close > high THEN 'close_range' END,
    CASE WHEN epoch_us(time) >= epoch_us(window_end) THEN 'window_order' END)"""

ALERT_REASONS = """concat_ws(',',
    CASE WHEN event_id IS NULL OR trim(event_id) = '' THEN 'event_id' END,
    CASE WHEN time IS NULL OR epoch_us(time) <= 0 THEN 'timestamp' END,
    CASE WHEN symbol IS NULL OR trim(symbol) = '' THEN 'symbol' END,
    CASE WHEN alert_type IS NULL OR alert_type = '' THEN 'alert_type' END,
    CASE WHEN severity IS NULL OR severity = '' THEN 'severity' END,
    CASE WHEN message IS NULL OR message = '' THEN 'message' END,
    CASE WHEN trigger_price IS NOT NULL AND trigger_price <= 0 THEN 'trigger_price' END,
    CASE WHEN trigger_volume IS NOT NULL AND trigger_volume < 0 THEN 'trigger_volume' END,
    CASE WHEN window_sec IS NOT NULL AND window_sec <= 0 THEN 'window_sec' END)"""


def _json_object(fields: list[tuple[str, str]]) -> str:
    return "'{' || concat_ws(', ', " + ", ".join(f"""'"{n}": ' || ({v})""" for n, v in fields) + ") || '}'"


def _quoted(v: str) -> str:
    return f"""'"' || ({v}) || '"'"""


def _json_msgs() -> str:
    m = "event_id % 50"
    epoch, value, k = "CAST(epoch_us(ts) / 1e6 AS VARCHAR)", "CAST(value AS VARCHAR)", f"CAST({K} AS VARCHAR)"
    iso = "strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%fZ')"
    time = (f"CASE WHEN {m} = 13 THEN {_quoted(iso)} WHEN {m} = 37 THEN {_quoted(epoch)} WHEN {m} = 41 THEN '\"soon\"' "
            f"WHEN {m} <> 31 THEN {epoch} END")
    price = f"CASE WHEN {m} = 11 THEN 'null' WHEN {m} = 19 THEN {_quoted(value)} WHEN {m} = 23 THEN '\"n/a\"' ELSE {value} END"
    volume = f"CASE WHEN {m} = 17 THEN {k} || '.5' WHEN {m} = 43 THEN {_quoted(k)} WHEN {m} = 47 THEN '\"many\"' ELSE {k} END"
    ident = f"CASE WHEN {m} <> 29 THEN {_quoted('CAST(event_id AS VARCHAR)')} END"
    body = _json_object([("event_id", ident), ("timestamp", time), ("symbol", _quoted("event_type")), ("price", price),
                         ("volume", volume), ("source", _quoted(SOURCE))])
    return f"""SELECT event_id AS "offset", CASE WHEN {m} = 7 THEN substr({body}, 1, 20) ELSE {body} END AS value FROM events"""


def _number(x: str) -> str:
    """A number sent as such or as text."""
    return (f"CASE WHEN regexp_full_match(trim({x}), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') "
            f"THEN TRY_CAST(trim({x}) AS DOUBLE) END")


def _wire_time(x: str) -> str:
    return (f"coalesce(make_timestamp(CAST(round(({_number(x)}) * 1e6) AS BIGINT)), "
            f"TRY_CAST(CASE WHEN {x} LIKE '%Z' THEN replace({x}, 'Z', '') END AS TIMESTAMP), {AS_OF})")


def _sent(*names: str) -> str:
    """Fields of the well-formed messages, as text."""
    return ("SELECT *, " + ", ".join(f"CASE WHEN json_valid(value) THEN json_extract_string(value, '$.{n}') END AS {n}" for n in names)
            + ", json_valid(value) AS ok FROM msgs")


PARSED = (_sent("event_id", "timestamp", "symbol", "price", "volume", "source"))
REASON = (f"CASE WHEN NOT ok THEN 'json' ELSE concat_ws(',', CASE WHEN symbol IS NULL THEN 'symbol' END, "
          f"CASE WHEN ({_number('price')}) IS NULL THEN 'price' END, CASE WHEN ({_number('volume')}) IS NULL THEN 'volume' END) END")


def _alert_msgs() -> str:
    m = "CAST(source_event_id AS BIGINT) % 11"
    epoch, price = "CAST(epoch_us(time) / 1e6 AS VARCHAR)", "CAST(trigger_price AS VARCHAR)"
    when = (f"CASE WHEN {m} = 1 THEN {_quoted("strftime(time, '%Y-%m-%dT%H:%M:%S.%fZ')")} "
            f"WHEN {m} = 5 THEN {_quoted(epoch)} WHEN {m} = 6 THEN '\"soon\"' ELSE {epoch} END")
    body = _json_object([("event_id", f"CASE WHEN {m} <> 3 THEN {_quoted('event_id')} END"), ("timestamp", when),
                         ("symbol", _quoted("symbol")), ("alert_type", _quoted("alert_type")), ("severity", _quoted("severity")),
                         ("message", f"CASE WHEN {m} <> 7 THEN {_quoted('message')} END"),
                         ("trigger_price", f"CASE WHEN {m} = 8 THEN {_quoted(price)} ELSE {price} END"),
                         ("trigger_volume", f"CASE WHEN {m} = 2 THEN '12.5' WHEN {m} = 9 THEN '\"34\"' END")])
    return f"SELECT CASE WHEN {m} = 4 THEN substr({body}, 1, 30) ELSE {body} END AS value FROM alerts"


def _ema_sql(src: str, keys: str) -> str:
    """EMA(20) per key over ``src`` ordered by ``pos`` (0-based)."""
    return f"""SELECT *, CASE WHEN pos < 20 THEN seed
                   ELSE list_reduce(list_slice(hist, 21, pos + 1), lambda acc, x: (x - acc) * (2.0 / 21.0) + acc, seed)
              END AS ema
    FROM (SELECT s.*, list(close) OVER (PARTITION BY {keys} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hist,
                 sd.seed
          FROM {src} s JOIN (SELECT {keys}, list_reduce(list(close ORDER BY pos), lambda a, x: a + x, 0.0) / count(*) AS seed
                             FROM {src} WHERE pos < 20 GROUP BY {keys}) sd USING ({keys}))"""


def _chat_field(title: str, value: str, present: str | None = None) -> str:
    """One attachment field object; optional fields are NULL when absent."""
    obj = f"json_object('title', {title}, 'value', {value}, 'short', true)"
    return obj if present is None else f"CASE WHEN {present} IS NOT NULL THEN {obj} END"


def queries_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    cols = "time, symbol, window_sec, open, high, low, close, volume, vwap, trade_count, window_end"
    for w in (60, 300, 900):
        q[f"candles_{w}"] = _with(ticks_cte(), candles_cte(w)) + f"SELECT {cols} FROM candles_{w}"
    multi = _with(ticks_cte(), candles_cte(60), candles_cte(300), candles_cte(900)) + \
        f"SELECT {cols} FROM candles_60 UNION ALL SELECT {cols} FROM candles_300 UNION ALL SELECT {cols} FROM candles_900"
    q["candles_multi"] = multi
    q["candles_exploded"] = multi
    q["candle_rollup"] = _with(ticks_cte(), candles_cte(3600)) + f"SELECT {cols} FROM candles_3600"
    q["candle_upsert"] = multi
    q["candle_store"] = multi
    q["volume_direction"] = _with(ticks_cte(), candles_cte(60)) + \
        f"SELECT {cols}, CASE WHEN close >= open THEN 'up' ELSE 'down' END AS direction FROM candles_60"
    q["throughput"] = """SELECT event_type AS service_name,
           make_timestamp((epoch_us(CAST(ts AS TIMESTAMP)) // 10000000) * 10000000 + 10000000) AS interval_end,
           round(count(*) / 10.0, 2) AS mps, count(*) AS total_processed, 'running' AS status
    FROM events GROUP BY event_type, epoch_us(CAST(ts AS TIMESTAMP)) // 10000000"""

    q["throughput_grid"] = """WITH beats AS (
            SELECT event_type AS service_name, (epoch_us(CAST(ts AS TIMESTAMP)) // 900000000 + 1) * 900000000 AS e, count(*) AS n
            FROM events GROUP BY 1, 2),
        grid AS (SELECT service_name, unnest(range(lo, hi + 1, 900000000)) AS e
                 FROM (SELECT service_name, min(e) AS lo, max(e) AS hi FROM beats GROUP BY 1))
    SELECT service_name, make_timestamp(CAST(e AS BIGINT)) AS interval_end, round(coalesce(n, 0) / 900.0, 2) AS mps,
           coalesce(n, 0) AS total_processed, CASE WHEN n IS NULL THEN 'idle' ELSE 'running' END AS status,
           (SELECT count(DISTINCT upper(trim(event_type))) FROM events) AS symbols_tracked
    FROM grid LEFT JOIN beats USING (service_name, e)"""
    q["nan_to_null"] = "SELECT event_id, CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 THEN value END AS value, event_type FROM events"
    kinds = {"eighth": "round(value) / 8", "near": "value + 0.005", "large": "value * 1234567.0", "tiny": "-value / 1e7"}
    shown = [f"'$' || printf('%.2f', {x}) AS {n}_money, printf('%.4f', {x}) AS {n}_fixed" for n, x in kinds.items()]
    shown += [f"CAST({x} AS VARCHAR) AS {n}_repr" for n, x in kinds.items()]
    shown += [f"format('{{:,}}', {kinds[n]}) AS {n}_commas" for n in ("large", "eighth")]
    q["number_formats"] = (f"SELECT event_id, {', '.join(shown)} FROM events")

    dirty = cte("dirty", _dirty())
    q["normalize_symbol"] = _with(dirty) + "SELECT event_id, symbol AS raw_symbol, upper(trim(symbol)) AS symbol FROM dirty"
    q["validate_ticks"] = _with(dirty) + \
        f"SELECT event_id, time, upper(trim(symbol)) AS symbol, price, volume, {TICK_REASONS} AS reasons, " \
        f"{TICK_REASONS} = '' AS is_valid FROM dirty"
    q["validate_candles"] = _with(ticks_cte(), candles_cte(60), candles_cte(300), candles_cte(900),
                                  cte("c", "SELECT * FROM candles_60 UNION ALL SELECT * FROM candles_300 "
                                           "UNION ALL SELECT * FROM candles_900")) + \
        f"SELECT time, symbol, window_sec, {CANDLE_REASONS} AS reasons, {CANDLE_REASONS} = '' AS is_valid FROM c"
    m = "CAST(source_event_id AS BIGINT) % 13"
    q["validate_alerts"] = _with(*alerts_ctes(), cte("dirty_alerts", f"""SELECT * REPLACE (
            CASE WHEN {m} = 1 THEN '' ELSE event_id END AS event_id,
            CASE WHEN {m} = 2 THEN TIMESTAMP '1970-01-01 00:00:00' ELSE time END AS time,
            CASE WHEN {m} = 3 THEN '  ' WHEN {m} = 10 THEN ' ' || lower(symbol) || ' ' ELSE symbol END AS symbol,
            CASE WHEN {m} = 4 THEN '' ELSE alert_type END AS alert_type,
            CASE WHEN {m} <> 5 THEN severity END AS severity,
            CASE WHEN {m} = 6 THEN '' ELSE message END AS message,
            CASE WHEN {m} = 7 THEN -1.0 ELSE trigger_price END AS trigger_price,
            CASE WHEN {m} = 8 THEN -1 ELSE trigger_volume END AS trigger_volume,
            CASE WHEN {m} = 9 THEN 0 ELSE window_sec END AS window_sec) FROM alerts""")) + \
        f"""SELECT event_id, time, upper(trim(symbol)) AS symbol, alert_type, severity, {ALERT_REASONS} AS reasons,
                   {ALERT_REASONS} = '' AS is_valid FROM dirty_alerts"""
    q["stale_flag"] = _with(ticks_cte()) + \
        f"SELECT event_id, symbol, time, source, (epoch_us({AS_OF}) - epoch_us(time)) > 300000000 " \
        "AND source <> 'yfinance-backfill' AS is_stale FROM ticks"
    gate = (f"source <> 'yfinance-backfill' AND NOT ((epoch_us({GATE_NOW}) - epoch_us(time)) > 300000000)")
    q["detect_gate"] = _with(ticks_cte(), cte("stats", _stats("ticks")), cte("dets", _dets("stats", gate))) + \
        "SELECT symbol, time, event_id, seq, alert_type, severity FROM dets"

    for name, src in (("bollinger", "ticks"), ("bollinger_lower", "ticks_inverted")):
        q[name] = _with(ticks_cte(src), cte("stats", _stats(src))) + f"""SELECT event_id, symbol, time, price,
            {_bb_severity()} AS severity,
            CASE WHEN price > {BB_UP} THEN 'above upper band' ELSE 'below lower band' END AS direction,
            round({BB_UP}, 4) AS upper_band, round({BB_DN}, 4) AS lower_band, round(bb_mean, 4) AS middle_band,
            round(bb_std, 4) AS std
        FROM stats WHERE {BB_READY} AND (price > {BB_UP} OR price < {BB_DN})"""
    q["volume_spike"] = _with(ticks_cte("ticks_burst"), cte("stats", _stats("ticks_burst"))) + f"""SELECT event_id, symbol,
            time, volume, {_sev_z(f'abs({VOL_Z})')} AS severity, round({VOL_Z}, 3) AS z_score,
            CAST(volume AS DOUBLE) AS current_volume, round(vol_mean, 2) AS rolling_mean_volume,
            round(vol_std, 2) AS rolling_std_volume, CAST(3.0 AS DOUBLE) AS threshold
        FROM stats WHERE {VOL_READY} AND abs({VOL_Z}) >= 3.0"""
    q["price_jump"] = _with(ticks_cte(), cte("stats", _stats("ticks"))) + f"""SELECT event_id, symbol, time, price,
            {_sev_z(JUMP_DEV)} AS severity, round(jump_mean, 4) AS prior_mean, round(jump_std, 4) AS prior_std,
            round({JUMP_DEV}, 3) AS deviation_sigmas, CAST(3.0 AS DOUBLE) AS threshold_sigmas
        FROM stats WHERE {JUMP_READY} AND {JUMP_DEV} >= 3.0"""

    q["bollinger_chunked"] = q["bollinger"]
    q["detections_all"] = _with(*dets_ctes(), _rules("ticks_burst"), COOLDOWN) + \
        f"""SELECT symbol, time, event_id, 0 AS seq, 'USER_RULE' AS alert_type, 'high' AS severity, {MESSAGE} AS message,
                  value FROM fired
            UNION ALL
            SELECT symbol, time, event_id, seq, alert_type, severity, NULL, NULL FROM dets"""
    q["build_alerts"] = _with(*alerts_ctes()) + \
        "SELECT event_id, time, symbol, alert_type, severity, message, trigger_price FROM alerts"
    q["alert_metadata"] = _with(*alerts_ctes()) + " UNION ALL ".join(
        f"SELECT event_id, '{n}' AS key, CAST({n} AS VARCHAR) AS value FROM alerts WHERE {n} IS NOT NULL" for n in [*DETAILS, "value"])
    parts = ["'\"type\": \"' || alert_type || '\"'", "'\"severity\": \"' || severity || '\"'"]
    parts += [f"""'"{n}": ' || {_quoted(n) if n == "direction" else f"CAST({n} AS VARCHAR)"}""" for n in DETAILS]
    q["alert_envelope"] = _with(*dets_ctes()) + \
        f"""SELECT concat_ws('_', symbol, alert_type, strftime(time, '%Y-%m-%dT%H:%M:%S.%f')) AS alert_id,
                  symbol AS ticker, strftime(time, '%Y-%m-%dT%H:%M:%S.%f') AS detected_at,
                  strftime({AS_OF}, '%Y-%m-%dT%H:%M:%S.%f') AS published_at, alert_type AS anomaly_type, severity,
                  '{{' || concat_ws(', ', {", ".join(parts)}) || '}}' AS details
           FROM dets"""
    q["rule_match"] = _with(ticks_cte(), RULES) + \
        "SELECT event_id, symbol, time, rule_id, rule_type, threshold, value, rule_key FROM hits"
    q["rule_messages"] = _with(ticks_cte(), RULES) + \
        f"SELECT event_id, rule_id, 'USER_RULE' AS alert_type, 'high' AS severity, {MESSAGE} AS message FROM hits"
    q["rule_cooldown"] = _with(ticks_cte(), RULES, COOLDOWN) + \
        "SELECT event_id, symbol, time, rule_id, rule_key FROM fired"
    q["rule_cooldown_chunked"] = _with(ticks_cte("ticks_burst"), _rules("ticks_burst"), _cooldown(7200)) + \
        "SELECT event_id, symbol, time, rule_id, rule_key FROM fired"
    q["rules_current"] = """WITH log AS (
        SELECT user_id AS id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'add' END AS op,
               upper(trim(event_type)) AS symbol,
               CASE event_id % 3 WHEN 0 THEN 'price_above' WHEN 1 THEN 'price_below' ELSE 'volume_above' END AS rule_type,
               value AS threshold, 60 AS window_sec, CAST(ts AS TIMESTAMP) AS ts, event_id AS seq
        FROM events)
    SELECT id, symbol, rule_type, threshold, window_sec, ts AS created_at FROM log
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) = 1 AND op <> 'delete'"""

    q["latest_price"] = _with(ticks_cte()) + """SELECT symbol, price, time FROM ticks
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC, event_id DESC) = 1"""
    serve60 = [*alerts_ctes(), candles_cte(60)]
    q["candlesticks_alerts"] = _with(*serve60, joined_cte(60, 100, "j")) + f"SELECT {CANDLE_OUT} FROM j"
    q["candle_alert_history"] = _with(*serve60, joined_cte(60, 1 << 40, "j")) + f"SELECT {CANDLE_OUT} FROM j"
    recent = "SELECT time, symbol, alert_type, severity, message, trigger_price, trigger_price AS actual_value FROM alerts"
    q["recent_alerts"] = _with(*alerts_ctes()) + f"{recent} ORDER BY time DESC, event_id DESC LIMIT 50"
    q["recent_alerts_symbol"] = _with(*alerts_ctes()) + \
        f"{recent} WHERE symbol = '{FOCUS_SYMBOL}' ORDER BY time DESC, event_id DESC LIMIT 50"
    universe = cte("universe", f"SELECT symbol FROM (SELECT DISTINCT symbol FROM ticks) ORDER BY symbol LIMIT {HEATMAP_SYMBOL_COUNT}")
    q["heatmap_long"] = _with(*serve60, universe,
                              joined_cte(60, 20, "j", "WHERE c.symbol IN (SELECT symbol FROM universe)")) + \
        "SELECT symbol, time, severity FROM j"
    q["heatmap_json"] = _with(*serve60, universe, joined_cte(60, 20, "j", "WHERE c.symbol IN (SELECT symbol FROM universe)")) + \
        """SELECT symbol, '[' || string_agg('{"time":"' || strftime(time, '%Y-%m-%d %H:%M:%S') || '+00:00","severity":"' || severity || '"}',
                  ',' ORDER BY rk DESC) || ']' AS timeline FROM j GROUP BY symbol"""
    dd = [*alerts_ctes(), candles_cte(300), joined_cte(300, 100, "j"),
          cte("dd", f"""SELECT *,
                CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END AS ma,
                CASE WHEN count(*) OVER w = 20 THEN stddev_samp(close) OVER w END AS std
            FROM j WINDOW w AS (PARTITION BY symbol ORDER BY rk DESC ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""),
          cte("dd2", """SELECT *, ma + std * 2 AS upper, ma - std * 2 AS lower,
                CASE WHEN std = 0 THEN NULL ELSE (close - ma) / std END AS z_score FROM dd""")]
    dd_cols = ("symbol, time, open, high, low, close, volume, anomaly_type, severity, anomaly_value, ma, std, upper, "
               "lower, z_score")
    q["deep_dive"] = _with(*dd) + f"SELECT {dd_cols} FROM dd2"
    q["deep_dive_history"] = _with(*dd) + f"""SELECT {dd_cols} FROM dd2 WHERE severity <> 'normal'
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rk) <= 5"""
    q["alerts_history"] = _with(*alerts_ctes(), cte("page", "SELECT * FROM alerts ORDER BY time DESC, event_id DESC LIMIT 200")) + \
        f"""SELECT time, symbol, alert_type, severity, message, trigger_price, count(*) OVER () AS total
           FROM page WHERE symbol = '{FOCUS_SYMBOL}' AND severity = 'high'"""
    q["alerts_feed"] = _with(*alerts_ctes()) + f"{recent} ORDER BY time DESC, event_id DESC LIMIT 10"
    series = [*serve60, joined_cte(60, 300, "j"),
              cte("series", "SELECT *, count(*) OVER (PARTITION BY symbol) - row_number() OVER "
                            f"(PARTITION BY symbol ORDER BY {JOINED_DESC}) AS pos FROM j")]
    q["price_change"] = _with(*series, cte("last", """SELECT symbol, price FROM ticks
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC, event_id DESC) = 1"""),
                              cte("base", "SELECT symbol, arg_min(open, pos) AS base_price FROM series GROUP BY symbol")) + \
        """SELECT symbol, price, base_price, price - base_price AS change,
                  CASE WHEN base_price = 0 THEN NULL ELSE (price - base_price) / base_price END * 100 AS change_pct
           FROM last JOIN base USING (symbol)"""
    q["recent_trades"] = _with(*series) + """SELECT symbol, CAST(count(*) OVER (PARTITION BY symbol) - pos - 1 AS INTEGER) AS idx,
            time, close AS price, coalesce(nullif(volume, 0), nullif(trade_count, 0), 0) AS volume
        FROM series QUALIFY count(*) OVER (PARTITION BY symbol) - pos <= 10"""
    q["ema"] = _with(*series, cte("e", _ema_sql("series", "symbol"))) + \
        "SELECT symbol, CAST(pos AS BIGINT) AS pos, time, close, ema FROM e"
    q["symbol_summary"] = _with(*series, cte("e", _ema_sql("series", "symbol"))) + """SELECT symbol,
            coalesce(nullif(vwap, 0), 0.0) AS vwap, coalesce(nullif(ema, 0), 0.0) AS ema, low AS day_low, high AS day_high
        FROM e QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY pos DESC) = 1"""
    q["anomaly_markers"] = _with(*series) + """SELECT symbol, time, anomaly_type, severity,
            CASE WHEN anomaly_value IS NOT NULL AND anomaly_value <> 0 THEN anomaly_value ELSE close END AS y,
            row_number() OVER (PARTITION BY symbol ORDER BY pos DESC) = 1 AS is_latest
        FROM series WHERE severity IS NOT NULL AND severity <> 'normal'"""
    ma_src = cte("ma_src", "SELECT symbol, window_sec, time, close, row_number() OVER (PARTITION BY symbol, window_sec "
                           "ORDER BY time) - 1 AS pos FROM (SELECT * FROM candles_60 UNION ALL SELECT * FROM candles_300 "
                           "UNION ALL SELECT * FROM candles_900)")
    q["moving_averages"] = _with(ticks_cte(), candles_cte(60), candles_cte(300), candles_cte(900), ma_src,
                                 cte("e", _ema_sql("ma_src", "symbol, window_sec"))) + \
        """SELECT time, symbol, window_sec, 'SMA' AS ma_type, avg(close) OVER w AS ma_value FROM ma_src
           WINDOW w AS (PARTITION BY symbol, window_sec ORDER BY time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
           QUALIFY count(*) OVER w = 20
           UNION ALL
           SELECT time, symbol, window_sec, 'EMA', ema FROM e"""
    q["moving_averages_chunked"] = q["moving_averages"]
    ny = "timezone('America/New_York', time AT TIME ZONE 'UTC')"
    q["market_open"] = _with(ticks_cte()) + f"""SELECT event_id, time,
            isodow({ny}) <= 5 AND hour({ny}) * 60 + minute({ny}) >= 570 AND hour({ny}) * 60 + minute({ny}) < 960 AS is_open
        FROM ticks"""

    rank = "CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0 ELSE 0 END"
    routed = cte("routed", f"""SELECT a.*, ch.channel FROM alerts a,
            (VALUES ('chat', 0), ('mail', 2)) ch(channel, min_rank) WHERE {rank} >= ch.min_rank""")
    q["route_alerts"] = _with(*alerts_ctes(), routed) + "SELECT event_id, channel, severity FROM routed"
    color = ("CASE severity WHEN 'low' THEN '#36a64f' WHEN 'medium' THEN '#ffb347' WHEN 'high' THEN '#ff4c4c' "
             "ELSE '#aaaaaa' END")
    fields = "list_filter([" + ", ".join([
        _chat_field("'Symbol'", "symbol"),
        _chat_field("'Alert Type'", "alert_type"),
        _chat_field("'Severity'", "upper(severity)"),
        _chat_field("'Trigger Price'", "'$' || printf('%.4f', trigger_price)", "trigger_price"),
        _chat_field("'Trigger Volume'", "format('{:,}', trigger_volume)", "trigger_volume"),
        _chat_field("'Z-Score'", "printf('%.2f', zscore)", "zscore"),
        _chat_field("'Reference Value'", "printf('%.4f', reference_value)", "reference_value"),
        _chat_field("'Window'", "CAST(window_sec AS VARCHAR) || 's'", "window_sec"),
    ]) + "], lambda x: x IS NOT NULL)"
    q["chat_outbox"] = _with(*alerts_ctes(), routed) + f"""SELECT event_id, symbol, severity,
            CAST(json_object('attachments', [json_object('color', {color},
                'title', ':rotating_light: Market Alert — ' || symbol, 'text', message,
                'fields', {fields}, 'footer', 'event_id: ' || event_id,
                'ts', CAST(floor(epoch_us(time) / 1000000) AS BIGINT))]) AS VARCHAR) AS payload
        FROM routed WHERE channel = 'chat'"""
    subject = "'[' || upper(severity) || '] Market Alert — ' || symbol || ' / ' || alert_type"
    cell = lambda k, v: (f"""'<tr><td style=''padding:4px 12px;font-weight:bold''>{k}</td><td style=''padding:4px 12px''>' """  # noqa: E731
                         f"""|| {v} || '</td></tr>'""")
    html_rows = [cell("Symbol", "symbol"), cell("Alert Type", "alert_type"), cell("Severity", "upper(severity)"), cell("Message", "message"),
                 cell("Trigger Price", "'$' || printf('%.4f', trigger_price)"), cell("Trigger Volume", "format('{:,}', trigger_volume)"),
                 cell("Z-Score", "printf('%.2f', zscore)"), cell("Reference Value", "printf('%.4f', reference_value)"),
                 cell("Window", "CAST(window_sec AS VARCHAR) || 's'"), cell("Event ID", "event_id")]
    q["mail_outbox"] = _with(*alerts_ctes(), routed) + f"""SELECT event_id, symbol, severity, {subject} AS subject,
            'Market Alert: ' || {subject} || chr(10) || chr(10) || message AS text,
            chr(10) || '<html><body>' || chr(10) || '<h2 style=''color:#cc0000''>Market Alert — ' || symbol || '</h2>' || chr(10)
                || '<table border=''0'' cellpadding=''0'' cellspacing=''0''>' || chr(10) || concat_ws('', {", ".join(html_rows)})
                || chr(10) || '</table>' || chr(10) || '</body></html>' || chr(10) AS html
        FROM routed WHERE channel = 'mail'"""
    q["recipients"] = _with(*alerts_ctes(), routed) + f"""SELECT event_id, {subject} AS subject, r AS recipient
        FROM routed, unnest(string_split('{RECIPIENTS}', ',')) t(r)
        WHERE channel = 'mail' AND trim(r) <> ''"""

    msgs = cte("msgs", _json_msgs())
    q["decode_ticks"] = _with(msgs, cte("parsed", PARSED)) + f"""SELECT event_id, epoch_us(time) / 1e6 AS timestamp, time, symbol,
            price, volume, source
        FROM (SELECT event_id, {_wire_time('timestamp')} AS time, symbol, {_number('price')} AS price, {_number('volume')} AS volume,
                     source FROM parsed WHERE {REASON} = '')"""
    q["decode_rejects"] = _with(msgs, cte("parsed", PARSED)) + f"SELECT \"offset\", {REASON} AS reason FROM parsed WHERE {REASON} <> ''"
    q["encode_decode"] = _with(ticks_cte()) + \
        "SELECT event_id, time, symbol, price, CAST(volume AS DOUBLE) AS volume, source, bid FROM ticks"
    q["ticks_persist"] = _with(msgs, cte("parsed", PARSED)) + f"""SELECT
            coalesce(make_timestamp(CAST(round(({_number('timestamp')}) * 1e6) AS BIGINT)), {AS_OF}) AS time, symbol,
            coalesce({_number('price')}, 0.0) AS price, CAST(trunc(coalesce({_number('volume')}, 0)) AS INTEGER) AS volume,
            coalesce(source, 'unknown') AS source, coalesce(event_id, 'none') AS event_id
        FROM parsed WHERE ok AND (price IS NULL OR ({_number('price')}) IS NOT NULL)
                         AND (volume IS NULL OR ({_number('volume')}) IS NOT NULL)"""
    q["decode_alerts"] = _with(*alerts_ctes(), cte("msgs", _alert_msgs()), cte("parsed", _sent(
        "event_id", "timestamp", "symbol", "alert_type", "severity", "message", "trigger_price", "trigger_volume"))) + \
        f"""SELECT coalesce(event_id, 'none') AS event_id, {_wire_time('timestamp')} AS time, symbol, alert_type, severity,
                  coalesce(message, 'Anomaly detected') AS message, {_number('trigger_price')} AS trigger_price,
                  CAST(trunc({_number('trigger_volume')}) AS BIGINT) AS trigger_volume
           FROM parsed WHERE ok"""
    kept = "event_id, time, symbol, alert_type, severity, message"
    q["alert_dedup"] = _with(*alerts_ctes()) + f"SELECT {kept}, trigger_price FROM alerts"
    q["alert_insert"] = _with(*alerts_ctes()) + f"SELECT {kept}, arrival FROM alerts"
    q["alert_enrich"] = _with(*alerts_ctes()) + """SELECT event_id, time,
            coalesce(nullif(trigger_volume, 0), current_volume) AS trigger_volume,
            coalesce(nullif(zscore, 0), nullif(z_score, 0), std) AS zscore,
            coalesce(nullif(reference_value, 0), nullif(upper_band, 0), nullif(lower_band, 0), rolling_mean_volume)
                AS reference_value,
            CAST(window_sec AS DOUBLE) AS window_sec
        FROM alerts"""
    bars = cte("bars", "SELECT time, symbol, close, volume FROM candles_60")
    q["backfill_tail"] = _with(ticks_cte(), candles_cte(60), bars) + """SELECT time, symbol, close AS price, volume,
            'yfinance-backfill' AS source FROM (SELECT * FROM bars
            QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= 60) WHERE close > 0"""
    q["latest_bar"] = _with(ticks_cte(), candles_cte(60), bars) + f"""SELECT {AS_OF} AS time, symbol,
            coalesce(close, 0.0) AS price, coalesce(volume, 0) AS volume, 'yfinance' AS source, time AS bar_time
        FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) = 1)
        WHERE coalesce(close, 0.0) > 0"""
    beats = cte("beats", """SELECT event_type AS service_name,
            make_timestamp((epoch_us(CAST(ts AS TIMESTAMP)) // 10000000) * 10000000 + 10000000) AS last_heartbeat,
            'running' AS status, round(count(*) / 10.0, 2) AS mps, count(*) AS total_processed,
            count(DISTINCT user_id) AS users, max(user_id) AS last_user
        FROM events GROUP BY 1, 2""")
    latest = cte("latest", """SELECT service_name, last_heartbeat, status, mps, total_processed,
            CAST(json_object('mps', mps, 'total_processed', total_processed, 'users', users, 'last_user', last_user) AS VARCHAR) AS metrics
        FROM beats QUALIFY row_number() OVER (PARTITION BY service_name ORDER BY last_heartbeat DESC) = 1""")
    q["health_latest"] = _with(beats, latest) + "SELECT * FROM latest"
    q["health_liveness"] = _with(beats, latest) + f"""SELECT service_name, last_heartbeat,
            (epoch_us({AS_OF}) - epoch_us(last_heartbeat)) // 1000 AS age_ms,
            CASE WHEN (epoch_us({AS_OF}) - epoch_us(last_heartbeat)) // 1000 < 30000 THEN 'healthy' ELSE 'dead' END
                AS liveness,
            CASE WHEN (epoch_us({AS_OF}) - epoch_us(last_heartbeat)) // 1000 < 30000 THEN mps END AS mps_shown
        FROM latest"""
    q["retention"] = _with(ticks_cte()) + \
        f"SELECT event_id, time, symbol FROM ticks WHERE epoch_us(time) >= epoch_us({AS_OF}) - 86400000000"
    return q
