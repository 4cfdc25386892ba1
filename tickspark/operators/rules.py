"""User threshold rules: match, messages, cooldown and the rule change-log."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.functions.timefn import epoch_micros
from tickspark.functions.values import fmt_money, py_float, py_float_commas
from tickspark.operators.pointers import follow
from tickspark.operators.rolling import CHUNK_COL, DEFAULT_CHUNK_SECONDS, TARGET_CHUNK_ROWS, with_chunk
from tickspark.plans.joins import broadcast_if_small
from tickspark.schemas import RULE_COOLDOWN_SECONDS, USER_RULE
from tickspark.session import ensure_checkpoint_dir

MATCH_COLUMNS = ["event_id", "symbol", "time", "source", "price", "volume", "rule_id", "rule_type",
                 "threshold", "window_sec", "rule_key", "value"]


def rule_matches(ticks: DataFrame, rules: DataFrame, max_broadcast_rows: int | None = None) -> DataFrame:
    """Ticks that hit a rule of their symbol. ``price_above``/``volume_above``
    are strict >, ``price_below`` strict <; unknown rule types never match.

    By default AQE sizes the rule side at runtime and broadcasts it when it
    is below the broadcast threshold (a hash join on symbol otherwise).
    ``max_broadcast_rows`` forces an explicit row-count check first."""
    r = rules.select(F.col("id").alias("rule_id"), "symbol", "rule_type", "threshold",
                     F.coalesce(F.col("window_sec"), F.lit(60)).alias("window_sec"))
    if max_broadcast_rows is not None:
        r = broadcast_if_small(r, max_broadcast_rows)
    j = ticks.select("event_id", "symbol", "time", "source", "price", "volume").join(r, "symbol")
    rt, th = F.col("rule_type"), F.col("threshold")
    hit = (((rt == "price_above") & (F.col("price") > th))
           | ((rt == "price_below") & (F.col("price") < th))
           | ((rt == "volume_above") & (F.col("volume") > th)))
    return j.filter(hit).select(
        "event_id", "symbol", "time", "source", "price", "volume", "rule_id", "rule_type", "threshold",
        "window_sec",
        F.concat_ws("_", "symbol", "rule_type", py_float("threshold")).alias("rule_key"),
        F.when(F.instr(rt, "volume") > 0, F.col("volume").cast("double")).otherwise(F.col("price")).alias("value"),
    )


def message_text(rule_type: str = "rule_type", threshold: str = "threshold") -> Column:
    """Message of a rule hit from its columns and the tick's; null for other rule types."""
    rt, sym, th = F.col(rule_type), F.col("symbol"), F.col(threshold)
    vol = F.col("volume").cast("double")
    return (F.when(rt == "price_above", F.concat(F.lit("\U0001F6A8 "), sym, F.lit(" PRICE ALERT: Current "),
                                                 fmt_money("price"), F.lit(" is above your threshold of "), fmt_money(th)))
            .when(rt == "price_below", F.concat(F.lit("\U0001F4C9 "), sym, F.lit(" PRICE ALERT: Current "),
                                                fmt_money("price"), F.lit(" is below your threshold of "), fmt_money(th)))
            .when(rt == "volume_above", F.concat(F.lit("\U0001F4CA "), sym, F.lit(" VOLUME ALERT: Current volume "),
                                                 py_float_commas(vol), F.lit(" is above your threshold of "),
                                                 py_float_commas(th))))


def rule_messages(matches: DataFrame) -> DataFrame:
    """Message text of a rule hit (severity high, type USER_RULE)."""
    return matches.withColumn("alert_type", F.lit(USER_RULE)).withColumn("severity", F.lit("high")) \
                  .withColumn("message", message_text())


SPAN = "rule_key string, _chunk long, _len long, entry long, exit long"


def _chain_ends(t: np.ndarray, cooldown_us: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted distinct hit times: the index of the next hit that may fire after each (n: none), and the
    last hit that fires in a chain begun at each, by doubling."""
    n = len(t)
    after = np.searchsorted(t, t + cooldown_us, side="right")
    jump, last = after.copy(), np.arange(n)
    while True:
        on = np.flatnonzero(jump < n)
        if not len(on):
            return after, last
        # both sides are read before either is written: last covers one step less than jump
        last[on], jump[on] = last[jump[on]], jump[jump[on]]


def _spans_fn(cooldown_us: int):
    """Per (rule key, chunk): the hits at which the chunk's first fire can be, whatever was carried in (those
    within a cooldown of its first hit, and the one after), and the last fire each leads to."""
    def spans(group: pa.Table) -> pa.Table:
        t = np.sort(group.column("_t").to_numpy())
        _, last = _chain_ends(t, cooldown_us)
        m = min(len(t), int(np.searchsorted(t, t[0] + cooldown_us, side="left")) + 1)
        head = group.select(["rule_key", "_chunk", "_len"]).slice(0, 1).take(pa.array(np.zeros(m, np.int64)))
        return head.append_column("entry", pa.array(t[:m])).append_column("exit", pa.array(t[last[:m]]))
    return spans


def _fires_fn(cooldown_us: int):
    """Per (rule key, chunk): the hits that fire, from the known first one on."""
    def fires(group: pa.Table) -> pa.Table:
        t = np.sort(group.column("_t").to_numpy())
        after, _ = _chain_ends(t, cooldown_us)
        at, chain = int(np.searchsorted(t, group.column("entry")[0].as_py())), []
        while at < len(t):  # one step a fire, not a hit
            chain.append(at)
            at = int(after[at])
        head = group.select(["rule_key"]).slice(0, 1).take(pa.array(np.zeros(len(chain), np.int64)))
        return head.append_column("_t", pa.array(t[chain]))
    return fires


def cooldown(matches: DataFrame, cooldown_seconds: int = RULE_COOLDOWN_SECONDS,
             chunk_seconds: int | None = DEFAULT_CHUNK_SECONDS, target_rows: int = TARGET_CHUNK_ROWS,
             carried: DataFrame | None = None) -> DataFrame:
    """Keep the rule hits that fire: per ``rule_key`` a hit fires when more
    than ``cooldown_seconds`` passed since the last *fired* hit; suppressed
    hits do not extend the cooldown. Of hits at one time the smallest (rule_id, event_id) counts, so
    a hit delivered twice fires once. ``carried`` (rule_key, last_fired) are fires before these hits.

    Hits are cut into (rule key, time chunk) groups of bounded size. A chunk maps the last fire carried
    into it to the last fire at its end; the map has a row for each hit that can fire first (those
    within one cooldown of the chunk's first hit). The maps are composed over the chunks of a key by
    doubling pointers from each row's exit to the next chunk's entry; the rows reached are
    the true first fires, and one pass per chunk follows the chain from there. No task holds
    more than the times of one chunk, and a key of one chunk needs no composition round.
    """
    c_us = int(cooldown_seconds) * 1_000_000
    spark = matches.sparkSession
    payload = list(matches.columns)
    rest = [c for c in payload if c != "rule_key"]
    ensure_checkpoint_dir(spark)
    # one row a (rule key, time): it is read by the passes below, the matches only here
    hits = (matches.filter("time is not null").withColumn("_t", epoch_micros("time")).groupBy("rule_key", "_t")
            .agg(F.min_by(F.struct(*rest), F.struct("rule_id", "event_id")).alias("_hit")).checkpoint())
    times = with_chunk(hits.select("rule_key", "_t", F.timestamp_micros("_t").alias("time")), ["rule_key"], "time",
                       chunk_seconds, target_rows, keep_length=True).select("rule_key", CHUNK_COL, F.col("_chunk_sec").alias("_len"), "_t")
    spans = times.groupBy("rule_key", CHUNK_COL).applyInArrow(_spans_fn(c_us), SPAN).checkpoint()
    entry = _next_entries(spans, c_us, carried)
    reached = follow(entry, ["rule_key"], "entry", "_to", "_start")
    first = spans.join(reached, ["rule_key", "entry"]).select("rule_key", CHUNK_COL, "entry")
    fired = (times.join(first, ["rule_key", CHUNK_COL]).groupBy("rule_key", CHUNK_COL)
             .applyInArrow(_fires_fn(c_us), "rule_key string, _t long"))
    return hits.join(fired, ["rule_key", "_t"]).select("rule_key", "_hit.*").select(*payload)


def _next_entries(spans: DataFrame, c_us: int, carried: DataFrame | None) -> DataFrame:
    """(rule_key, entry, _to, _start): each span row with the first entry of a later chunk more than a
    cooldown behind its exit, and the rows where chains start (behind what is carried in, else a
    key's first hit). A chunk's next hit behind any time is an entry of its chunk, so only entries
    are searched: those of the time's own chunk, then the first of the next chunk that has any."""
    lengths = spans.groupBy("rule_key").agg(F.first("_len").alias("_len"), F.min("entry").alias("_first"))
    asks = spans.select("rule_key", "entry", "_len", (F.col("exit") + c_us).alias("_at"))
    if carried is not None:
        seeds = carried.select("rule_key", epoch_micros("last_fired").alias("_l"))
        asks = asks.unionByName(lengths.join(seeds, "rule_key").select(
            "rule_key", F.lit(None).cast("long").alias("entry"), "_len", (F.col("_l") + c_us).alias("_at")))
    asks = asks.withColumn(CHUNK_COL, F.floor(F.col("_at") / (F.col("_len") * 1_000_000)).cast("long"))
    marks = spans.select("rule_key", CHUNK_COL, F.col("entry").alias("_at"), F.lit(0).alias("_kind"), F.col("entry").alias("_found"))
    both = marks.unionByName(asks.select("rule_key", CHUNK_COL, "_at", F.lit(1).alias("_kind"), "entry"), allowMissingColumns=True)
    later = Window.partitionBy("rule_key", CHUNK_COL).orderBy("_at", "_kind").rowsBetween(1, Window.unboundedFollowing)
    near = both.withColumn("_near", F.first("_found", ignorenulls=True).over(later)).filter("_kind = 1")
    # one row a chunk that has entries or is asked for
    chunks = both.groupBy("rule_key", CHUNK_COL).agg(F.min("_found").alias("_head"))
    chunks = chunks.select("rule_key", CHUNK_COL, F.first("_head", ignorenulls=True).over(
        Window.partitionBy("rule_key").orderBy(CHUNK_COL).rowsBetween(1, Window.unboundedFollowing)).alias("_next"))
    found = near.join(chunks, ["rule_key", CHUNK_COL]).select("rule_key", "entry", F.coalesce("_near", "_next").alias("_to"))
    start = lengths.select("rule_key", F.col("_first").alias("_begin"))
    if carried is not None:
        given = found.filter("entry is null").select("rule_key", F.col("_to").alias("_begin"))
        start = start.join(seeds, "rule_key", "left_anti").unionByName(given)
    return (found.filter("entry is not null").join(start, "rule_key", "left")
            .select("rule_key", "entry", "_to", F.coalesce(F.col("entry") == F.col("_begin"), F.lit(False)).alias("_start")))


def user_detections(ticks: DataFrame, rules: DataFrame, cooldown_seconds: int = RULE_COOLDOWN_SECONDS) -> DataFrame:
    """Rule hits after cooldown, with message, type and severity."""
    return rule_messages(cooldown(rule_matches(ticks, rules), cooldown_seconds))


def current_rules(rule_log: DataFrame) -> DataFrame:
    """Rules in force from a change-log ``(op, id, symbol, rule_type,
    threshold, window_sec, ts)``: the last operation per id wins, deletes are
    tombstones; ``created_at`` is the time of the winning add. ``max_by`` is a partial
    aggregate, so a rule with many edits never gathers in one task."""
    latest = rule_log.groupBy("id").agg(
        F.max_by(F.struct("op", "symbol", "rule_type", "threshold", "window_sec", "ts"),
                 F.struct("ts", "seq")).alias("last"))
    return (latest.filter(F.col("last.op") != "delete")
            .select("id", "last.symbol", "last.rule_type", "last.threshold",
                    F.coalesce(F.col("last.window_sec"), F.lit(60)).alias("window_sec"),
                    F.col("last.ts").alias("created_at"))
            .orderBy(F.desc("created_at"), F.desc("id")))
