"""Streaming = batch: file streams over time-ranged parquet files of the
events table (modification times set in order), compared to the batch
operators on the same rows."""

import os
import tempfile
import time

from pyspark.sql import functions as F

from tickspark.operators import candles as C
from tickspark.operators import detect
from tickspark.sources import fixtures as fx
from tickspark.streaming import jobs

SF = "/root/testdata/sf0.001"


def _split_ticks(spark, n_files=6):
    """Write the ticks as n time-ranged parquet files with increasing mtimes."""
    root = tempfile.mkdtemp(prefix="tick-stream-")
    ticks = fx.ticks(spark, SF)
    bounds = ticks.agg(F.min("time").alias("a"), F.max("time").alias("b")).first()
    lo, hi = bounds.a.timestamp(), bounds.b.timestamp() + 1
    step = (hi - lo) / n_files
    base = time.time() - 1000
    for i in range(n_files):
        part = ticks.filter((F.unix_micros("time") >= int((lo + i * step) * 1e6))
                            & (F.unix_micros("time") < int((lo + (i + 1) * step) * 1e6)))
        d = os.path.join(root, f"part{i:02d}")
        part.coalesce(1).write.parquet(d)
        for f in os.listdir(d):
            os.utime(os.path.join(d, f), (base + i, base + i))
    return root, ticks.schema


def _stream(spark, root, schema):
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(root))


def test_candle_stream_update_mode_equals_batch(spark):
    root, schema = _split_ticks(spark)
    chk = tempfile.mkdtemp(prefix="chk-")
    log_path = tempfile.mkdtemp(prefix="candle-log-")
    sink = jobs.CandleStore(log_path)
    q = (jobs.candle_stream(_stream(spark, root, schema), 300).writeStream.outputMode("update")
         .option("checkpointLocation", chk).foreachBatch(sink).start())
    q.processAllAvailable()
    q.stop()
    got = sink.read(spark).drop("event_id")
    exp = C.candles(fx.ticks(spark, SF), 300)
    cols = ["time", "symbol", "open", "high", "low", "close", "volume", "trade_count"]
    assert got.select(*cols).exceptAll(exp.select(*cols)).count() == 0
    assert exp.select(*cols).exceptAll(got.select(*cols)).count() == 0


def test_candle_stream_append_emits_closed_windows(spark):
    root, schema = _split_ticks(spark)
    chk = tempfile.mkdtemp(prefix="chk-")
    name = "candles_append_test"
    q = (jobs.candle_stream(_stream(spark, root, schema), 60, delay_sec=0).writeStream.outputMode("append")
         .format("memory").queryName(name).option("checkpointLocation", chk).start())
    q.processAllAvailable()
    q.stop()
    got = spark.table(name)
    exp = C.candles(fx.ticks(spark, SF), 60)
    cols = ["time", "symbol", "open", "close", "volume", "trade_count"]
    assert got.count() > 0
    assert got.select(*cols).exceptAll(exp.select(*cols)).count() == 0  # every emitted window is final


def test_detector_stream_equals_batch(spark):
    """Detection with keyed state: alerts stored from the stream equal the batch's, metadata and enrichment included; few
    jobs a micro-batch; at most 29 ticks of state a symbol."""
    from tickspark.operators import alerts as A
    from tickspark.sources.alert_store import AlertStore
    from tickspark.streaming import detector
    root = tempfile.mkdtemp(prefix="tick-stream-")
    ticks = fx.ticks_burst(spark, SF)
    days = [r[0] for r in ticks.select(F.to_date("time")).distinct().orderBy(F.to_date("time")).collect()]
    t0 = time.time() - 1000
    for i in range(4):
        own = days[i * len(days) // 4:(i + 1) * len(days) // 4]
        d = os.path.join(root, f"part{i}")
        ticks.filter(F.to_date("time").isin(own)).repartition(3).write.parquet(d)
        for f in os.listdir(d):
            os.utime(os.path.join(d, f), (t0 + i, t0 + i))
    # a file a symbol's ticks may be spread over: all of a part come in one micro-batch
    source = (spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 3).option("recursiveFileLookup", "true").parquet(root))
    rules_dir = tempfile.mkdtemp(prefix="rules-")
    log = fx.rules(spark, SF).select(F.lit("add").alias("op"), "id", "symbol", "rule_type", "threshold", "window_sec",
                                     F.col("created_at").alias("ts"), F.col("id").alias("seq"))
    log.unionByName(log.limit(1).withColumn("id", F.lit(999).cast("long"))).unionByName(
        log.limit(1).withColumn("id", F.lit(999).cast("long")).withColumn("op", F.lit("delete")).withColumn("seq", F.lit(10**6).cast("long"))
    ).coalesce(1).write.mode("overwrite").parquet(rules_dir)
    rules = spark.readStream.schema(log.schema).parquet(rules_dir)
    chk = tempfile.mkdtemp(prefix="chk-")
    store = AlertStore(os.path.join(tempfile.mkdtemp(prefix="alerts-"), "t"))
    alerts = detector.alert_stream(detector.detect_stream(source, rules)).withColumn("arrival", F.col("source_event_id").cast("long"))
    q = alerts.writeStream.option("checkpointLocation", chk).foreachBatch(store).start()
    q.processAllAvailable()
    batches = sum(1 for p in q.recentProgress if p["numInputRows"] > 0)
    jobs_run = len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(q.runId)))
    q.stop()
    exp = A.build_alerts(A.unified_detections(ticks, fx.rules(spark, SF)))
    flat = lambda df: {(r.event_id, r.time, r.symbol, r.alert_type, r.severity, r.message, r.trigger_price, tuple(sorted(r.metadata.items())))
                       for r in df.collect()}
    want = flat(exp)
    assert flat(store.read(spark)) == want and len(want) > 100
    assert {"VOLUME_SPIKE", "BOLLINGER_BREACH", "USER_RULE"} <= {w[3] for w in want}
    enriched = lambda df: {tuple(r) for r in jobs.sinks.enrich_alerts(df).collect()}
    assert enriched(store.read(spark)) == enriched(exp)
    assert batches == 4 and 0 < jobs_run < 10 * batches, jobs_run
    kept = spark.read.format("statestore").load(chk).select("value.*")
    first = kept.columns[0]
    sizes = kept.select(F.size(F.col(f"{first}.times")) if first == "groupState" else F.size("times")).collect()
    assert sizes and max(r[0] for r in sizes) <= detector.TAIL_ROWS


def test_stale_ticks_pass_rules_but_no_detector(spark):
    from tickspark.functions.timefn import ts_literal
    from tickspark.streaming import detector
    stats = detect.rolling_stats(fx.ticks(spark, SF)).withColumn("fired", F.array(F.struct(
        F.lit(1).cast("long").alias("rule_id"), F.lit("price_above").alias("rule_type"), F.lit(0.5).alias("rule_threshold"),
        F.lit(60).alias("rule_window"), F.lit("k").alias("rule_key"), F.col("price").alias("value"))))
    stats = stats.filter("bb_n = 20 and price > bb_mean + 2 * bb_std and source = 'yfinance'")
    old = detector.alert_stream(stats, ts_literal("2030-01-01 00:00:00")).collect()
    assert {r.alert_type for r in old} == {"USER_RULE"} and len(old) == stats.count() > 0
    assert "BOLLINGER_BREACH" in {r.alert_type for r in detector.alert_stream(stats).collect()}


def test_alert_dedup_stream(spark):
    from tickspark.operators import alerts as A
    root = tempfile.mkdtemp(prefix="alert-stream-")
    a = A.alerts_table(fx.ticks(spark, SF)).drop("metadata")
    a.coalesce(1).write.parquet(os.path.join(root, "p0"))
    chk = tempfile.mkdtemp(prefix="chk-")
    s = spark.readStream.schema(a.schema).option("recursiveFileLookup", "true").parquet(root)
    q = (jobs.dedup_alert_stream(s).writeStream.format("memory").queryName("dedup_test")
         .option("checkpointLocation", chk).start())
    q.processAllAvailable()
    q.stop()
    got = spark.table("dedup_test")
    assert got.count() == a.select("event_id").distinct().count() < a.count()


def test_decode_rejects_isolated(spark):
    good, bad = jobs.codec.decode_ticks_with_rejects(fx.ticks_json(spark, SF))
    total = fx.ticks_json(spark, SF).count()
    assert good.count() + bad.count() == total
    reasons = {(r.offset % 50, r.reason) for r in bad.collect()}
    assert reasons == {(7, "json"), (11, "price"), (23, "price"), (47, "volume")}


def test_detector_state_carries_history(spark):
    """Batch of one tick after 19 carried ticks still sees a full window."""
    t = fx.ticks(spark, SF)
    stats = detect.rolling_stats(t)
    assert stats.filter(F.col("bb_n") == 20).count() > 0


def test_alert_consumer_stream_decodes_dedups_enriches(spark):
    """W6: JSON alerts (epoch and ISO times, one malformed, one duplicate,
    one invalid) -> typed, validated, deduplicated, enriched rows."""
    root = tempfile.mkdtemp(prefix="alert-json-")
    msgs = [
        '{"event_id": "a1", "timestamp": 1704207600.5, "symbol": "AAPL", "alert_type": "VOLUME_SPIKE", '
        '"severity": "high", "message": "m", "trigger_price": 10.0, "metadata": {"z_score": "4.2", '
        '"current_volume": "900", "rolling_mean_volume": "100"}}',
        '{"event_id": "a1", "timestamp": 1704207600.5, "symbol": "AAPL", "alert_type": "VOLUME_SPIKE", '
        '"severity": "high", "message": "m", "trigger_price": 10.0}',
        '{"event_id": "a2", "timestamp": "2024-01-02T15:00:01Z", "symbol": "MSFT", "alert_type": "PRICE_JUMP", '
        '"severity": "low", "message": "x", "trigger_price": 5.0}',
        '{"event_id": "a3", "timestamp": 1704207602, "symbol": "MSFT", "alert_type": "PRICE_JUMP", '
        '"severity": "low", "message": "x", "trigger_price": -5.0}',
        '{"event_id": "a4", "timesta',
    ]
    spark.createDataFrame([(m,) for m in msgs], "value string").coalesce(1).write.text(os.path.join(root, "p0"))
    chk = tempfile.mkdtemp(prefix="chk-")
    s = spark.readStream.schema("value string").option("recursiveFileLookup", "true").text(root)
    from tickspark.functions.timefn import ts_literal
    out = jobs.alert_consumer_stream(s, ts_literal("2024-01-03 00:00:00"))
    q = out.writeStream.format("memory").queryName("consumer_test").option("checkpointLocation", chk).start()
    q.processAllAvailable()
    q.stop()
    rows = {r.event_id: r for r in spark.table("consumer_test").collect()}
    assert set(rows) == {"a1", "a2"}
    assert rows["a1"].zscore == 4.2 and rows["a1"].trigger_volume == 900.0 and rows["a1"].reference_value == 100.0
    assert str(rows["a2"].time) == "2024-01-02 15:00:01"


def test_partitioned_layout_prunes(spark):
    """S14: day partitions + sorted files; a time filter prunes partitions."""
    path = os.path.join(tempfile.mkdtemp(prefix="ticks-table-"), "ticks")
    jobs.sinks.write_partitioned(fx.ticks(spark, SF), path)
    back = spark.read.parquet(path).filter(F.col("date") == "2024-01-05")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert back.count() == fx.ticks(spark, SF).filter(F.to_date("time") == "2024-01-05").count()


def test_late_file_dropped_by_watermark(spark):
    """W3: a late file (old event times, newest mtime) arrives after the
    watermark passed its windows; its rows are dropped and counted, and the
    emitted candles equal the batch candles of the in-order rows."""
    root, schema = _split_ticks(spark)
    ticks = fx.ticks(spark, SF)
    first_day = ticks.filter(F.to_date("time") == "2024-01-01").withColumn("event_id", F.concat(F.lit("late-"), "event_id"))
    late_dir = os.path.join(root, "part99")
    first_day.coalesce(1).write.parquet(late_dir)
    t = time.time()
    for f in os.listdir(late_dir):
        os.utime(os.path.join(late_dir, f), (t, t))
    sink = jobs.LateTicks(tempfile.mkdtemp(prefix="late-"), 300)
    side = (_stream(spark, root, schema).writeStream.option("checkpointLocation", tempfile.mkdtemp(prefix="chk-")).foreachBatch(sink).start())
    side.processAllAvailable()
    side.stop()
    late = sink.read(spark)
    assert late.count() == first_day.count() and late.filter(~F.col("event_id").startswith("late-")).count() == 0
    chk = tempfile.mkdtemp(prefix="chk-")
    q = (jobs.candle_stream(_stream(spark, root, schema), 300).writeStream.outputMode("append")
         .format("memory").queryName("late_test").option("checkpointLocation", chk).start())
    q.processAllAvailable()
    dropped = sum(p["stateOperators"][0].get("numRowsDroppedByWatermark", 0) for p in q.recentProgress
                  if p.get("stateOperators"))
    q.stop()
    assert dropped == first_day.count() > 0
    got = spark.table("late_test")
    exp = C.candles(ticks, 300)
    cols = ["time", "symbol", "open", "high", "low", "close", "volume", "trade_count"]
    assert got.count() > 0
    assert got.select(*cols).exceptAll(exp.select(*cols)).count() == 0


def test_compaction_and_heartbeat_listener(spark):
    """S8 compaction equals the log view; C6/H1 live heartbeats from query
    progress feed the health queries."""
    from tickspark.functions.timefn import ts_literal
    from tickspark.operators import serve
    root, schema = _split_ticks(spark)
    listener = jobs.HeartbeatListener()
    spark.streams.addListener(listener)
    try:
        chk = tempfile.mkdtemp(prefix="chk-")
        store = jobs.CandleStore(tempfile.mkdtemp(prefix="candle-log-"))
        q = (jobs.candle_stream(_stream(spark, root, schema), 900).writeStream.outputMode("update")
             .queryName("processor").option("checkpointLocation", chk)
             .foreachBatch(store).start())
        q.processAllAvailable()
        q.stop()
    finally:
        spark.streams.removeListener(listener)
    before = {tuple(r) for r in store.read(spark).collect()}
    store.compact(spark)
    assert {tuple(r) for r in store.read(spark).collect()} == before
    later = spark.createDataFrame(C.candles(fx.ticks(spark, SF), 900).limit(3).withColumn("close", F.lit(-1.0)).collect(), C.candles(fx.ticks(spark, SF), 900).schema)
    store(later, 100)
    after = {tuple(r) for r in store.read(spark).collect()}
    assert len(after) == len(before) and sum(r[6] == -1.0 for r in after) == 3
    store.compact(spark)
    store.compact(spark)  # nothing new: no further base
    assert {tuple(r) for r in store.read(spark).collect()} == after
    assert store._compacted(spark) == (1, 100)
    log = store._newer(spark).select("_metadata.file_path").distinct().count()
    assert log == 0  # no file of a compacted batch is read
    beats = listener.frame(spark)
    assert [r.service_name for r in beats.collect()] == ["processor"]
    live = serve.health_liveness(serve.health_latest(beats), ts_literal("2100-01-01 00:00:00")).first()
    assert live.liveness == "dead" and live.mps_shown is None


def test_outbox_sink_routes_batch(spark):
    """W6 outbox: one micro-batch of alerts routed into chat/mail/recipient
    tables (idempotent per batch id: a retried batch overwrites its folder)."""
    from tickspark.operators import alerts as A
    from tickspark.operators import route
    a = A.alerts_table(fx.ticks(spark, SF))
    path = tempfile.mkdtemp(prefix="outbox-")
    sink = jobs.OutboxSink(path, "ops@example.com, ,risk@example.com")
    sink(a, 3)
    sink(a, 3)  # retry of the same batch
    chat = spark.read.parquet(os.path.join(path, "chat"))
    mail = spark.read.parquet(os.path.join(path, "mail"))
    rcpt = spark.read.parquet(os.path.join(path, "recipients"))
    routed = route.route(a)
    assert chat.count() == routed.filter(F.col("channel") == "chat").count() == a.count()
    assert mail.count() == routed.filter(F.col("channel") == "mail").count() == a.filter(F.col("severity") == "high").count()
    assert rcpt.count() == 2 * mail.count()
