"""tickspark: market-tick analytics on Spark DataFrames.

Decode and validate ticks, build tumbling OHLCV/VWAP candles and rollups,
detect anomalies with rolling statistics, evaluate user threshold rules with
cooldowns, route alerts into outbox tables and answer the serving queries on
top. Every operator is DataFrame-in / DataFrame-out, so the same code runs in
batch jobs and inside ``foreachBatch`` of a streaming query.
"""

from tickspark.session import build_session, ensure_checkpoint_dir, pin_utc

__all__ = ["build_session", "ensure_checkpoint_dir", "pin_utc"]
