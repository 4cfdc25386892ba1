"""Hand-computed cases per operator (fixed parameters, never the wall clock)."""

import datetime as dt

import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from tickspark.functions.timefn import market_open, ts_literal
from tickspark.operators import candles as C
from tickspark.operators import detect, indicators, route, rules, serve, validate
from tickspark.sources import sinks

T0 = dt.datetime(2024, 1, 2, 15, 0, 0)


def tick_df(spark, rows):
    """rows: (seconds after T0, symbol, price, volume, source, event_id)."""
    data = [Row(time=T0 + dt.timedelta(seconds=s), symbol=sym, price=float(p), volume=int(v), bid=None, ask=None,
                source=src, event_id=eid) for s, sym, p, v, src, eid in rows]
    return spark.createDataFrame(data, "time timestamp, symbol string, price double, volume int, bid double, "
                                       "ask double, source string, event_id string")


def test_candle_ohlcv_vwap_and_order(spark):
    t = tick_df(spark, [(5, "A", 10, 2, "x", "1"), (1, "A", 12, 1, "x", "2"), (59, "A", 11, 3, "x", "3"),
                        (61, "A", 9, 0, "x", "4")])
    out = {r["time"]: r for r in C.candles(t, 60).collect()}
    first = out[T0]
    # open/close follow event time, not input order
    assert (first.open, first.high, first.low, first.close) == (12.0, 12.0, 10.0, 11.0)
    assert first.volume == 6 and first.trade_count == 3
    assert abs(first.vwap - (12 * 1 + 10 * 2 + 11 * 3) / 6) < 1e-12
    second = out[T0 + dt.timedelta(seconds=60)]
    assert second.vwap == second.open == 9.0  # zero volume -> vwap = open
    assert second.window_end == T0 + dt.timedelta(seconds=120)


def test_rollup_equals_direct(spark):
    from tickspark.sources import fixtures as fx
    t = fx.ticks(spark, "/root/testdata/sf0.001")
    direct = C.candles(t, 3600)
    rolled = C.rollup(C.candles(t, 60, keep_pv=True), 3600)
    cols = ["time", "symbol", "open", "high", "low", "close", "volume", "trade_count"]
    assert direct.select(*cols).exceptAll(rolled.select(*cols)).count() == 0
    assert rolled.select(*cols).exceptAll(direct.select(*cols)).count() == 0
    j = direct.alias("d").join(rolled.alias("r"), ["time", "symbol"])
    assert j.filter(F.abs(F.col("d.vwap") - F.col("r.vwap")) > 1e-9).count() == 0


def test_candle_invariants(spark):
    from tickspark.sources import fixtures as fx
    c = C.candles_multi(fx.ticks(spark, "/root/testdata/sf0.001"))
    v = validate.validate_candles(c)
    bad = v.filter(F.col("reasons").rlike("low_gt_high|open_range|close_range|window_order")).count()
    assert bad == 0


def test_bollinger_constant_window_never_breaches(spark):
    rows = [(i, "A", 0.1, 1, "x", f"{i:03d}") for i in range(25)]
    assert detect.bollinger(tick_df(spark, rows)).count() == 0


def test_bollinger_needs_twenty_rows(spark):
    base = [(i, "A", 10.0 + (i % 2) * 0.01, 1, "x", f"{i:03d}") for i in range(19)]
    spike19 = base[:18] + [(18, "A", 50.0, 1, "x", "018")]
    assert detect.bollinger(tick_df(spark, spike19)).count() == 0  # 19 rows only
    spike20 = base + [(19, "A", 50.0, 1, "x", "019")]
    out = detect.bollinger(tick_df(spark, spike20)).collect()
    assert len(out) == 1 and out[0].direction == "above upper band"


def test_price_jump_uses_prior_nineteen(spark):
    rows = [(i, "A", 10.0 + (i % 2), 1, "x", f"{i:03d}") for i in range(19)] + [(19, "A", 20.0, 1, "x", "019")]
    out = detect.price_jumps(tick_df(spark, rows)).collect()
    assert len(out) == 1
    # prior 19 values: ten 10s and nine 11s
    prior = [10.0 + (i % 2) for i in range(19)]
    mean = sum(prior) / 19
    std = (sum((x - mean) ** 2 for x in prior) / 19) ** 0.5
    assert abs(out[0].deviation_sigmas - round(abs(20 - mean) / std, 3)) < 1e-9
    assert out[0].severity == "high"


def test_severity_thresholds(spark):
    df = spark.createDataFrame([(3.0,), (3.5,), (4.0,), (4.5,), (6.0,)], "z double")
    got = [r[0] for r in df.select(detect._severity_z(F.col("z"))).collect()]
    assert got == ["low", "medium", "medium", "high", "high"]


def test_gate_keeps_history_from_backfill(spark):
    # 19 backfill ticks feed the window; the live 20th tick still sees them
    rows = [(i, "A", 10.0 + (i % 2) * 0.01, 1, "yfinance-backfill", f"{i:03d}") for i in range(19)]
    rows.append((19, "A", 50.0, 1, "yfinance", "019"))
    dets = detect.detections(tick_df(spark, rows)).collect()
    assert {d.alert_type for d in dets} >= {"BOLLINGER_BREACH"}
    assert all(d.event_id == "019" for d in dets)


def test_stale_flag(spark):
    t = tick_df(spark, [(0, "A", 1, 1, "yfinance", "1"), (0, "A", 1, 1, "yfinance-backfill", "2"),
                        (250, "A", 1, 1, "yfinance", "3")])
    now = ts_literal("2024-01-02 15:05:00.000001")
    got = {r.event_id: r.is_stale for r in detect.stale_flag(t, now).collect()}
    assert got == {"1": True, "2": False, "3": False}


def rule_df(spark, rows):
    return spark.createDataFrame(rows, "id long, symbol string, rule_type string, threshold double, window_sec int")


def test_rule_match_strictness_and_unknown(spark):
    t = tick_df(spark, [(0, "A", 100.0, 90, "x", "1"), (1, "A", 100.01, 91, "x", "2"), (2, "A", 0.5, 1, "x", "3")])
    r = rule_df(spark, [(1, "A", "price_above", 100.0, 60), (2, "A", "price_below", 1.0, 60),
                        (3, "A", "volume_above", 90.0, 60), (4, "A", "volume_spike", 3.0, 60)])
    got = sorted((m.event_id, m.rule_id) for m in rules.rule_matches(t, r).collect())
    assert got == [("2", 1), ("2", 3), ("3", 2)]


def test_rule_messages_format(spark):
    t = tick_df(spark, [(0, "A", 123.456, 1234, "x", "1")])
    r = rule_df(spark, [(1, "A", "price_above", 100.0, 60), (3, "A", "volume_above", 1000.0, 60)])
    msgs = {m.rule_id: m.message for m in rules.rule_messages(rules.rule_matches(t, r)).collect()}
    assert msgs[1] == "\U0001F6A8 A PRICE ALERT: Current $123.46 is above your threshold of $100.00"
    assert msgs[3] == "\U0001F4CA A VOLUME ALERT: Current volume 1,234.0 is above your threshold of 1,000.0"


def py_fold(times, c):
    last, out = None, []
    for t in times:
        if last is None or t - last > c:
            out.append(t)
            last = t
    return out


def hit_df(spark, rows):
    """rows: (rule key, seconds after T0, rule id, event id)."""
    return spark.createDataFrame(
        [(e, k, T0 + dt.timedelta(seconds=s), "x", 1.0, 1, r, "price_above", 0.0, 60, k, 1.0) for k, s, r, e in rows],
        "event_id string, symbol string, time timestamp, source string, price double, volume int, rule_id long, rule_type string, "
        "threshold double, window_sec int, rule_key string, value double")


CHUNKINGS = [{}, {"chunk_seconds": 100}, {"chunk_seconds": 3600}, {"target_rows": 3}]


@pytest.mark.parametrize("chunks", CHUNKINGS)
def test_cooldown_boundaries(spark, chunks):
    # 0 fires; 300 exactly is suppressed; 300.000001 is not (relative to 0);
    # suppressed hits do not extend the cooldown
    secs = [0, 100, 200, 300, 300.000001, 500, 601, 1000]
    t = tick_df(spark, [(s, "A", 200.0, 1, "x", f"{i}") for i, s in enumerate(secs)])
    r = rule_df(spark, [(1, "A", "price_above", 100.0, 60)])
    fired = sorted((f.time - T0).total_seconds() for f in rules.cooldown(rules.rule_matches(t, r), **chunks).collect())
    assert fired == py_fold(secs, 300) == [0, 300.000001, 601, 1000]


@pytest.mark.parametrize("cool,chunks", [(300, {}), (300, {"chunk_seconds": 3600}), (7200, {"chunk_seconds": 3600}),
                                         (7200, {"target_rows": 20})])
def test_cooldown_by_composition_equals_sequential(spark, cool, chunks):
    from tickspark.sources import fixtures as fx
    d = "/root/testdata/sf0.001"
    t, r = fx.ticks(spark, d), fx.rules(spark, d)
    m = rules.rule_matches(t, r)
    got = sorted((x.rule_key, x.time, x.rule_id) for x in rules.cooldown(m, cool, **chunks).collect())
    exp = []
    by_key = {}
    for x in m.collect():
        by_key.setdefault(x.rule_key, []).append((x.time, x.rule_id, x.event_id))
    for k, lst in by_key.items():
        last = None
        for tm, rid, eid in sorted(lst):
            if last is None or (tm - last).total_seconds() > cool:
                exp.append((k, tm, rid))
                last = tm
    assert got == sorted(exp)


@pytest.mark.parametrize("chunks", CHUNKINGS[1:])
def test_cooldown_of_a_long_island_repeats_and_gaps(spark, chunks):
    """10,000 hits with gaps below the cooldown in one key, every hit delivered twice, beside keys with gaps of
    days; the first (rule id, event id) of a time fires."""
    import random
    rng = random.Random(4)
    rows, want = [], []
    for k, n, gap in (("hot", 10_000 if "target_rows" not in chunks else 400, 290), ("gaps", 60, 90_000), ("one", 1, 1)):
        at, last = 0.0, None
        for i in range(n):
            at += rng.uniform(0.5, gap)
            at = round(at, 3)
            rows += [(k, at, 2, f"{i}b"), (k, at, 2, f"{i}a"), (k, at, 2, f"{i}a"), (k, at, 3, f"{i}0")]
            if last is None or at - last > 300:
                want.append((k, at, 2, f"{i}a"))
                last = at
    got = [(x.rule_key, round((x.time - T0).total_seconds(), 3), x.rule_id, x.event_id)
           for x in rules.cooldown(hit_df(spark, rows), **chunks).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("chunks", CHUNKINGS)
def test_cooldown_carries_earlier_fires(spark, chunks):
    rows = [("a", s, 1, str(s)) for s in (0, 100, 250, 500, 800)] + [("b", s, 1, str(s)) for s in (10, 400)] + [("c", 5, 1, "5")]
    carried = spark.createDataFrame([("a", T0 - dt.timedelta(seconds=100)), ("c", T0), ("unseen", T0)], "rule_key string, last_fired timestamp")
    got = {(x.rule_key, int((x.time - T0).total_seconds())) for x in rules.cooldown(hit_df(spark, rows), carried=carried, **chunks).collect()}
    assert got == {("a", 250), ("a", 800), ("b", 10), ("b", 400)}


def test_cooldown_without_hits(spark):
    assert rules.cooldown(hit_df(spark, []), chunk_seconds=60).count() == 0


def test_current_rules_tombstones(spark):
    log = spark.createDataFrame([
        ("add", 1, "A", "price_above", 10.0, None, T0, 1),
        ("add", 2, "B", "price_below", 1.0, 60, T0, 2),
        ("delete", 1, None, None, None, None, T0 + dt.timedelta(seconds=5), 3),
        ("add", 3, "C", "volume_above", 5.0, None, T0, 4),
        ("add", 3, "C", "volume_above", 6.0, None, T0 + dt.timedelta(seconds=9), 5),
    ], "op string, id long, symbol string, rule_type string, threshold double, window_sec int, ts timestamp, seq long")
    got = sorted((r.id, r.threshold, r.window_sec) for r in rules.current_rules(log).collect())
    assert got == [(2, 1.0, 60), (3, 6.0, 60)]


def test_interval_join_equals_equi_join(spark):
    from tickspark.operators import alerts as A
    from tickspark.sources import fixtures as fx
    t = fx.ticks(spark, "/root/testdata/sf0.01")
    c, a = C.candles(t, 300), A.alerts_table(t)
    equi = serve.join_alerts(c, a, 300).select("symbol", "time", "_al_time", "anomaly_type")
    cc, aa = c.alias("c"), a.alias("a")
    rng = cc.join(aa, (F.col("c.symbol") == F.col("a.symbol")) & (F.col("a.time") >= F.col("c.time"))
                  & (F.col("a.time") < F.col("c.window_end")), "left").select(
        F.col("c.symbol").alias("symbol"), F.col("c.time").alias("time"), F.col("a.time").alias("_al_time"),
        F.col("a.alert_type").alias("anomaly_type"))
    assert equi.exceptAll(rng).count() == 0 and rng.exceptAll(equi).count() == 0


def test_recent_trades_truthiness(spark):
    s = spark.createDataFrame([("A", 1, T0, 5.0, 0, 0), ("A", 2, T0, 6.0, 0, 7), ("A", 3, T0, 7.0, 4, 9)],
                              "symbol string, _rank int, time timestamp, close double, volume long, trade_count long")
    got = {r.idx: r.volume for r in serve.recent_trades(s).collect()}
    assert got == {0: 0, 1: 7, 2: 4}


def test_ema_series_matches_reference_formula(spark):
    closes = [float(x) for x in [5, 7, 6, 9, 11, 10, 12, 15, 14, 13, 16, 18, 17, 19, 21, 20, 22, 25, 24, 23,
                                 26, 28, 27, 30, 29]]
    df = spark.createDataFrame([("A", i, c) for i, c in enumerate(closes)], "symbol string, pos int, close double")
    got = [r.ema for r in indicators.ema_series(df, ["symbol"], "pos").orderBy("pos").collect()]
    mult = 2 / 21
    ema = sum(closes[:20]) / 20
    exp = []
    for i, c in enumerate(closes):
        if i >= 20:
            ema = (c - ema) * mult + ema
        exp.append(ema)
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, exp))


@pytest.mark.parametrize("chunk,block,period", [(3600 * 3, 4096, 20), (600, 4, 20), (None, 7, 20), (3600, 50, 2), (3600, 50, 1)])
def test_ema_rolling_equals_exact_fold(spark, monkeypatch, chunk, block, period):
    """Every row, from chunk to chunk and block to block; keys shorter than the seed hold it."""
    monkeypatch.setattr(indicators, "BLOCK_ROWS", block)
    series = {"A": [100 + ((i * 37) % 23) - 11 + i * 0.01 for i in range(900)], "B": [5.0, 7.0, 9.0], "C": [1e-3 * i * i for i in range(45)]}
    df = spark.createDataFrame([(k, T0 + dt.timedelta(minutes=i), c) for k, closes in series.items() for i, c in enumerate(closes)],
                               "symbol string, time timestamp, close double")
    rows = indicators.ema_rolling(df, ["symbol"], chunk_seconds=chunk, period=period, target_rows=100).collect()
    got = {(r.symbol, r.pos): r.ema for r in rows}
    assert len(rows) == sum(map(len, series.values()))
    for k, closes in series.items():
        ema = sum(closes[:period]) / min(period, len(closes))
        for i, c in enumerate(closes):
            if i >= period:
                ema = (c - ema) * 2 / (period + 1) + ema
            assert abs(got[k, i] - ema) <= 1e-9 * abs(ema) + 1e-12, (k, i)


def test_moving_averages_in_short_chunks_equal_whole_keys(spark):
    from tickspark.sources import fixtures as fx
    c = C.candles(fx.ticks(spark, "/root/testdata/sf0.001"), 60)
    one = {(r.symbol, r.time, r.ma_type): r.ma_value for r in indicators.moving_averages(c).collect()}
    many = {(r.symbol, r.time, r.ma_type): r.ma_value for r in indicators.moving_averages(c, chunk_seconds=7200).collect()}
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-9 * abs(one[k]) for k in one)


def test_market_open_new_york(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 14, 29),), (dt.datetime(2024, 1, 2, 14, 30),),
                                (dt.datetime(2024, 1, 2, 20, 59),), (dt.datetime(2024, 1, 2, 21, 0),),
                                (dt.datetime(2024, 1, 6, 15, 0),), (dt.datetime(2024, 7, 2, 13, 30),)], "t timestamp")
    assert [r[0] for r in df.select(market_open("t")).collect()] == [False, True, True, False, False, True]


def test_route_minimums(spark):
    a = spark.createDataFrame([("1", "low"), ("2", "medium"), ("3", "high"), ("4", "weird")],
                              "event_id string, severity string")
    got = sorted((r.event_id, r.channel) for r in route.route(a).collect())
    assert got == [("1", "chat"), ("2", "chat"), ("3", "chat"), ("3", "mail"), ("4", "chat")]
    got = sorted((r.event_id, r.channel) for r in route.route(a, {"chat": "medium", "mail": "bogus"}).collect())
    assert got == [("2", "chat"), ("3", "chat"), ("3", "mail")]


def test_enrich_truthiness(spark):
    a = spark.createDataFrame([
        ("1", T0, "A", "X", "high", "m", 1.0, None, 0.0, None, None, {"z_score": "0", "std": "2.5", "upper_band": "9"}),
        ("2", T0, "A", "X", "high", "m", 1.0, 7, 1.5, 3.0, 60, {"z_score": "4"}),
    ], "event_id string, time timestamp, symbol string, alert_type string, severity string, message string, "
       "trigger_price double, trigger_volume long, zscore double, reference_value double, window_sec int, "
       "metadata map<string,string>")
    got = {r.event_id: r for r in sinks.enrich_alerts(a).collect()}
    assert got["1"].zscore == 2.5 and got["1"].reference_value == 9.0 and got["1"].trigger_volume is None
    assert got["2"].zscore == 1.5 and got["2"].reference_value == 3.0 and got["2"].trigger_volume == 7.0


def test_validate_ticks_reasons(spark):
    df = spark.createDataFrame([
        ("1", T0, " aapl ", 1.0, 1, 0.9, 1.1, "s"),
        ("", T0, "  ", 0.0, -1, 2.0, 1.0, ""),
    ], "event_id string, time timestamp, symbol string, price double, volume int, bid double, ask double, "
       "source string")
    got = {r.event_id: (r.symbol, r.reasons, r.is_valid) for r in validate.validate_ticks(df).collect()}
    assert got["1"] == ("AAPL", "", True)
    assert got[""][1] == "event_id,symbol,price,volume,source,bid_gt_ask" and not got[""][2]


def test_halo_window_equals_single_partition(spark):
    from tickspark.operators.rolling import own_rows, rows_frame, with_halo
    from tickspark.sources import fixtures as fx
    t = fx.ticks(spark, "/root/testdata/sf0.001").select("symbol", "time", "event_id", "price")
    plain = t.withColumn("s", F.sum("price").over(
        Window.partitionBy("symbol").orderBy("time", "event_id").rowsBetween(-29, 0)))
    for chunk, target in ((600, None), (3600, None), (86400, None), (None, 50), (None, 10_000_000)):
        kw = {"target_rows": target} if target else {}
        h = with_halo(t, ["symbol"], ["time", "event_id"], "time", 29, chunk, **kw)
        got = own_rows(h.withColumn("s", F.sum("price").over(rows_frame(["symbol"], ["time", "event_id"], -29, 0))))
        diff = got.alias("g").join(plain.alias("p"), "event_id").filter(F.abs(F.col("g.s") - F.col("p.s")) > 1e-6)
        assert got.count() == plain.count() and diff.count() == 0, (chunk, target)


def test_alert_time_epoch_iso_or_now(spark):
    from tickspark.functions.timefn import parse_epoch_or_iso
    df = spark.createDataFrame([("1704207600.25",), ("2024-01-02T15:00:00Z",), ("2024-01-02T15:00:00+02:00",),
                                ("garbage",), (None,)], "s string")
    now = ts_literal("2024-01-03 00:00:00")
    got = [r[0] for r in df.select(parse_epoch_or_iso("s", now)).collect()]
    assert got == [dt.datetime(2024, 1, 2, 15, 0, 0, 250000), dt.datetime(2024, 1, 2, 15, 0),
                   dt.datetime(2024, 1, 2, 13, 0), dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 3)]


def test_nan_to_null(spark):
    from tickspark.functions.values import nan_to_null
    df = spark.createDataFrame([(float("nan"), 1.0, "x")], "a double, b double, c string")
    r = nan_to_null(df).first()
    assert r.a is None and r.b == 1.0 and r.c == "x"


def test_detections_chunked_equal_whole_key(spark):
    """Small data takes the one-chunk-per-key path; short fixed chunks (many
    halos) must give the same detections."""
    from tickspark.sources import fixtures as fx
    t = fx.ticks(spark, "/root/testdata/sf0.01")
    whole = detect.detections(t)
    chunked = detect.detections(t, chunk_seconds=1800)
    assert whole.count() == chunked.count() > 0
    assert whole.exceptAll(chunked).count() == 0


def test_formats_are_those_of_the_exact_binary_value(spark):
    import random

    from tickspark.functions.values import fmt_fixed, py_float, py_float_commas, wire_number
    rng = random.Random(2)
    values = [0.0, -0.0, 2.675, 0.125, 0.375, -2.5, 1e7, 1e15, 123456789.125, 0.07500000000000001, 1e-5, 9.5e-5, 0.00005, 1e16, 1.5e22, 0.995,
              999.995, 999.9950000000001, 4503599627370495.5, -1234.5, 1e-300, 5e-324, float("inf"), float("-inf"), float("nan")]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-6, 9) for _ in range(300)] + [rng.randint(0, 10**6) / 8 for _ in range(100)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None)], "i int, v double").select(
        "i", fmt_fixed("v", 2).alias("two"), fmt_fixed("v", 4).alias("four"), fmt_fixed("v", 0).alias("none"),
        py_float("v").alias("r"), py_float_commas("v").alias("c")).collect()
    for r in rows:
        if r.i < 0:
            assert r[1:] == (None,) * 5
            continue
        v = values[r.i]
        if abs(v) < 2**53 or v != v or abs(v) == float("inf"):
            assert (r.two, r.four, r.none) == (f"{v:.2f}", f"{v:.4f}", f"{v:.0f}"), v
        if float(f"{v:.16g}") == v and v != 5e-324:  # the JVM prints a few doubles with one digit more than needed
            assert r.r == repr(v), v
            assert r.c == (f"{v:,}" if "e" not in repr(v) else repr(v)), v
    texts = ["12", " 1.5 ", "-3e2", ".5", "1.", "12d", "NaN", "", "n/a", "1_0", None, "Infinity", "0x1p3", "1e999", "+7", "5f", "."]
    got = [x.n for x in spark.createDataFrame([(t,) for t in texts], "t string").select(wire_number("t").alias("n")).collect()]
    assert got == [12.0, 1.5, -300.0, 0.5, 1.0, None, None, None, None, None, None, None, None, None, 7.0, None, None]


def test_alert_store_keeps_the_first_arrival_and_prunes_days(spark, tmp_path):
    from tickspark.sources.alert_store import AlertStore
    rows = [("a", 0, "first", 1), ("a", 0, "copy in the batch", 2), ("b", 0, "b", 3), ("a", 86400, "same id, other time", 4), ("c", 86400 * 40, "late", 5)]
    df = spark.createDataFrame([(e, T0 + dt.timedelta(seconds=s), "S", m, n, {"k": m}) for e, s, m, n in rows],
                               "event_id string, time timestamp, symbol string, message string, arrival long, metadata map<string,string>")
    store = AlertStore(str(tmp_path / "alerts"))
    store.insert(df.filter("arrival <= 3"), 0)
    again = df.filter("arrival <= 3").withColumn("message", F.lit("again")).withColumn("arrival", F.col("arrival") + 100)
    for _ in range(2):  # a retried batch writes the same rows
        store.insert(again.unionByName(df.filter("arrival > 3")), 1)
    got = sorted((r.event_id, r.message, r.arrival, r.metadata["k"]) for r in store.read(spark).collect())
    assert got == [("a", "first", 1, "first"), ("a", "same id, other time", 4, "same id, other time"), ("b", "b", 3, "b"), ("c", "late", 5, "late")]
    day = store.read(spark, ts_literal("2024-01-03 00:00:00"), ts_literal("2024-01-04 00:00:00"))
    assert [r.arrival for r in day.collect()] == [4]
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "date" in plan.split("PartitionFilters")[1][:200]


def test_alert_store_without_alerts(spark, tmp_path):
    from tickspark.operators import alerts as A
    from tickspark.sources import fixtures as fx
    from tickspark.sources.alert_store import AlertStore
    t = fx.ticks(spark, "/root/testdata/sf0.001").limit(0)
    store = AlertStore(str(tmp_path / "none"))
    store.insert(A.deliveries(A.build_alerts(A.unified_detections(t, fx.rules(spark, "/root/testdata/sf0.001")))), 0)
    assert store.read(spark).count() == 0
    assert serve.candlesticks(C.candles(t, 60), store.read(spark), 60).count() == 0


def test_tables_bucketed_alike_join_without_a_shuffle(spark, tmp_path):
    from tickspark.sources import fixtures as fx
    t = fx.ticks(spark, "/root/testdata/sf0.001")
    c = C.candles(t, 60)
    alerts = t.filter("price > 200").select("time", "symbol", F.lit("X").alias("alert_type"), F.lit("high").alias("severity"),
                                            F.col("price").alias("trigger_price"), "event_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        history = serve.JoinedHistory("joined_history_test", str(tmp_path), 60, buckets=4)
        history.store(c, alerts)
        got = history.read(spark)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "SelectedBucketsCount: 4 out of 4" in plan
        want = serve.join_alerts(c, alerts, 60).select(*serve.CANDLE_OUT)
        assert got.count() == want.count() > c.count() - 1 and got.exceptAll(want).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS joined_history_test_candles")
        spark.sql("DROP TABLE IF EXISTS joined_history_test_alerts")


def test_read_range_derives_the_day(spark, tmp_path):
    from tickspark.sources import fixtures as fx
    t = fx.ticks(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "ticks")
    sinks.write_partitioned(t, path)
    lo, hi = ts_literal("2024-01-05 06:00:00"), ts_literal("2024-01-06 12:00:00")
    back = sinks.read_range(spark, path, lo, hi, ["CLICK"])
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "(date#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "PushedFilters: [" in plan
    want = t.filter((F.col("time") >= lo) & (F.col("time") < hi) & (F.col("symbol") == "CLICK"))
    assert back.count() == want.count() > 0


def test_halo_rows_come_from_the_one_shuffle_of_the_input(spark):
    from tickspark.sources import fixtures as fx
    d = detect.rolling_stats(fx.ticks(spark, "/root/testdata/sf0.001"), chunk_seconds=3600)
    d.collect()
    plan = d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet") == 1 and "ReusedExchange" in plan
    assert plan.count("REPARTITION_BY_COL") == 3  # the rows', the reuse of it, the halo's


def test_throughput_grid_fills_idle_intervals(spark):
    rows = [("a", 5), ("a", 8), ("a", 47), ("b", 86395), ("b", 86400 + 25)]
    m = spark.createDataFrame([(s, dt.datetime(2024, 1, 2) + dt.timedelta(seconds=x)) for s, x in rows], "service_name string, time timestamp")
    tracked = spark.createDataFrame([("X",), ("Y",)], "symbol string")
    got = sorted((r.service_name, (r.interval_end - dt.datetime(2024, 1, 2)).total_seconds(), r.total_processed, r.status, r.symbols_tracked)
                 for r in serve.throughput_grid(m, 10, tracked).collect())
    assert got == [("a", 10.0, 2, "running", 2), ("a", 20.0, 0, "idle", 2), ("a", 30.0, 0, "idle", 2), ("a", 40.0, 0, "idle", 2),
                   ("a", 50.0, 1, "running", 2), ("b", 86400.0, 1, "running", 2), ("b", 86410.0, 0, "idle", 2), ("b", 86420.0, 0, "idle", 2),
                   ("b", 86430.0, 1, "running", 2)]
