"""Continuous detection with keyed state in Spark's state store.

``detect_stream`` keeps, per symbol, the last 29 ticks, the rules in force and when each rule last
fired. A micro-batch's ticks of a symbol are taken in (time, event id) order behind the stored ones;
each leaves with the rolling statistics that ``detect.rolling_stats`` gives it in a batch, and with the
rules that fire on it. Thresholds, severities, gate, messages and metadata come after it and are the
batch operators' own expressions, so a stream and a batch over the same ticks give the same alerts.

Rules arrive as a change-log stream: a change counts from the micro-batch that brings it. The
state of a symbol is bounded by 29 ticks and its rules.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickspark.functions.timefn import epoch_micros
from tickspark.functions.values import py_float
from tickspark.operators import alerts as alerts_op
from tickspark.operators import detect, rules as rules_op
from tickspark.schemas import BOLLINGER_WINDOW, JUMP_WINDOW, RULE_COOLDOWN_SECONDS, USER_RULE, VOLUME_WINDOW

TAIL_ROWS = max(BOLLINGER_WINDOW, JUMP_WINDOW, VOLUME_WINDOW) - 1
STATE = "times array<long>, ids array<string>, prices array<double>, volumes array<double>, rules string, fired string"
#: (name of the row count, of mean and std, column, rows before the current one, whether it counts itself)
FRAMES = [("bb", "price", BOLLINGER_WINDOW - 1, True), ("vol", "volume", VOLUME_WINDOW - 1, True), ("jump", "price", JUMP_WINDOW - 1, False)]
OUT = ("symbol string, time_us long, event_id string, price double, volume double, source string, "
       + ", ".join(f"{n}_n long, {n}_mean double, {n}_std double" for n, *_ in FRAMES) + ", fired string")
FIRED = "array<struct<rule_id:long,rule_type:string,rule_threshold:double,rule_window:int,rule_key:string,value:double>>"
INPUT = {"kind": "int", "symbol": "string", "time_us": "long", "event_id": "string", "price": "double", "volume": "double",
         "source": "string", "op": "string", "rule_id": "long", "rule_type": "string", "threshold": "double", "window_sec": "int",
         "rule_key": "string", "seq": "long"}


def _frame(values: np.ndarray, old: int, before: int, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and population std of each new value's frame. Values are taken relative to a frame's first
    one, so a constant frame has a std of exactly 0. Frames at the start of the history are short: mean
    and std stay null there, as no detector reads them."""
    n = len(values) - old
    size = before + 1 if own else before
    at = np.arange(old, len(values))
    count = np.minimum(at + 1, before + 1) - (0 if own else 1)
    mean, std = np.full(n, np.nan), np.full(n, np.nan)
    first = at - before
    full = np.flatnonzero(first >= 0)
    if len(full):
        frames = np.lib.stride_tricks.sliding_window_view(values, size)[first[full]]
        rel = frames - frames[:, :1]
        centre = rel.mean(axis=1, keepdims=True)
        mean[full] = frames[:, 0] + centre[:, 0]
        std[full] = np.sqrt(((rel - centre) ** 2).mean(axis=1))
    return count, mean, std


def _fires(new: pd.DataFrame, rules: dict, fired: dict, cooldown_us: int) -> list[list[dict]]:
    """The rules that fire on each new tick; ``fired`` (rule key -> micros) is brought up to date."""
    out: list[list[dict]] = [[] for _ in range(len(new))]
    t, price, volume = (new[c].to_numpy() for c in ("time_us", "price", "volume"))
    hits: dict[str, list[tuple[int, int, int]]] = {}
    for rule_id, r in sorted((int(k), v) for k, v in rules.items()):
        on = {"price_above": lambda: price > r["threshold"], "price_below": lambda: price < r["threshold"],
              "volume_above": lambda: volume > r["threshold"]}.get(r["rule_type"])
        if on is not None:
            hits.setdefault(r["rule_key"], []).extend((int(t[i]), rule_id, int(i)) for i in np.flatnonzero(on()))
    for key, found in hits.items():
        for at, rule_id, i in sorted(found):
            if key in fired and at - fired[key] <= cooldown_us:
                continue
            fired[key] = at
            r = rules[str(rule_id)]
            out[i].append({"rule_id": rule_id, "rule_type": r["rule_type"], "rule_threshold": r["threshold"], "rule_window": r["window_sec"],
                           "rule_key": key, "value": float(volume[i] if "volume" in r["rule_type"] else price[i])})
    return out


def _step(cooldown_us: int):
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True)
        times, ids, prices, volumes, rules, fired = state.get if state.exists else ([], [], [], [], "{}", "{}")
        rules, fired = json.loads(rules), json.loads(fired)
        for r in rows[rows.kind == 0].sort_values(["time_us", "seq"]).itertuples():
            if r.op == "delete":
                rules.pop(str(int(r.rule_id)), None)
            else:
                rules[str(int(r.rule_id))] = {"rule_type": r.rule_type, "threshold": float(r.threshold),
                                              "window_sec": 60 if pd.isna(r.window_sec) else int(r.window_sec), "rule_key": r.rule_key}
        new = rows[rows.kind == 1].sort_values(["time_us", "event_id"]).reset_index(drop=True)
        series = {"price": np.concatenate([np.array(prices, float), new.price.to_numpy(float)]),
                  "volume": np.concatenate([np.array(volumes, float), new.volume.to_numpy(float)])}
        out = new[["symbol", "time_us", "event_id", "price", "volume", "source"]].copy()
        for name, column, before, own in FRAMES:
            out[f"{name}_n"], out[f"{name}_mean"], out[f"{name}_std"] = _frame(series[column], len(times), before, own)
        out["fired"] = [json.dumps(f) for f in _fires(new, rules, fired, cooldown_us)]
        kept = slice(-TAIL_ROWS, None)
        # a tick older than stored ones is judged behind them; the tail stays the newest by (time, id)
        last = sorted(zip([*times, *(int(x) for x in new.time_us)], [*ids, *new.event_id], series["price"].tolist(),
                          series["volume"].tolist()), key=lambda x: (x[0], str(x[1])))[kept]
        state.update(([x[0] for x in last], [x[1] for x in last], [x[2] for x in last], [x[3] for x in last],
                      json.dumps(rules), json.dumps(fired)))
        if len(out):
            yield out
    return step


def _typed(df: DataFrame, **given: Column) -> DataFrame:
    return df.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in INPUT.items()])


def detect_stream(ticks: DataFrame, rule_log: DataFrame | None = None, cooldown_seconds: int = RULE_COOLDOWN_SECONDS) -> DataFrame:
    """Per tick of the stream: the columns of ``detect.rolling_stats`` and ``fired``, the rules firing on it.

    ``ticks``: symbol, time, event_id, price, volume, source; ``rule_log``: op ('add' or 'delete'), id, symbol,
    rule_type, threshold, window_sec, ts, seq. Ticks without symbol, time, price or volume are left out.
    """
    names = ["symbol", "price", "volume", "source", "event_id"]
    rows = _typed(ticks.filter("symbol is not null and time is not null and price is not null and volume is not null"),
                  kind=F.lit(1), time_us=epoch_micros("time"), **{n: F.col(n) for n in names})
    if rule_log is not None:
        key = F.concat_ws("_", "symbol", "rule_type", py_float("threshold"))
        same = ["symbol", "op", "rule_type", "threshold", "window_sec", "seq"]
        rows = rows.unionByName(_typed(rule_log, kind=F.lit(0), time_us=epoch_micros("ts"), rule_id=F.col("id"), rule_key=key,
                                       **{n: F.col(n) for n in same}))
    seen = rows.groupBy("symbol").applyInPandasWithState(_step(cooldown_seconds * 1_000_000), OUT, STATE, "append", GroupStateTimeout.NoTimeout)
    none = [F.when(~F.isnan(c), F.col(c)).alias(c) for n, *_ in FRAMES for c in (f"{n}_mean", f"{n}_std")]
    return seen.select("symbol", F.timestamp_micros("time_us").alias("time"), "event_id", "price", "volume", F.col("volume").alias("_vol"), "source",
                       *[f"{n}_n" for n, *_ in FRAMES], *none, F.from_json("fired", FIRED).alias("fired"))


def alert_stream(stats: DataFrame, now: Column | None = None) -> DataFrame:
    """Alerts (``alerts.build_alerts``) of a ``detect_stream``: firing rules on every tick, detectors on those
    that ``detect.fresh`` lets through (``now``: the clock to judge staleness by; None replays). One
    narrow pass: each tick's detections become rows."""
    details = detect.DETAIL_FIELDS
    rule = [("rule_type", "string"), ("rule_threshold", "double"), ("rule_key", "string"), ("value", "double")]

    def entry(seq: int, alert_type: Column, severity: Column, detail=None, fired=None) -> Column:
        cells = [F.lit(seq).alias("seq"), alert_type.alias("alert_type"), severity.alias("severity")]
        cells += [(detail[n] if detail is not None else F.lit(None)).cast(t).alias(n) for n, t in details]
        cells += [(fired[n] if fired is not None else F.lit(None)).cast(t).alias(n) for n, t in rule]
        return F.struct(*cells)

    auto = [F.when(d.isNotNull() & detect.fresh(now), entry(i, d["alert_type"], d["severity"], detail=d))
            for i, d in enumerate([detect.bollinger_struct(), detect.volume_spike_struct(), detect.price_jump_struct()], start=1)]
    user = F.transform(F.coalesce("fired", F.array().cast(FIRED)), lambda r: entry(0, F.lit(USER_RULE), F.lit("high"), fired=r))
    rows = stats.select("symbol", "time", "event_id", "price", "volume", F.inline(F.concat(user, F.array_compact(F.array(*auto)))))
    return alerts_op.build_alerts(rows.withColumn("message", rules_op.message_text("rule_type", "rule_threshold")))
