"""Wire codec: JSON messages <-> tick/alert rows, and stream endpoints.

No Kafka connector jar is bundled here, so the Kafka helpers only build the
reader/writer with the right options; tests drive the same transformations
from file streams and batch frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickspark.functions.timefn import parse_epoch_or_iso
from tickspark.functions.values import wire_number
from tickspark.schemas import ALERT_WIRE_SCHEMA, TICK_WIRE_SCHEMA


def read_stream(spark: SparkSession, topic: str, bootstrap: str, starting: str = "latest",
                fail_on_data_loss: bool = True) -> DataFrame:
    """Kafka source (``starting`` = latest for detector/processor/sink,
    earliest for the alert consumer). Requires the Kafka connector package."""
    return (spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", bootstrap)
            .option("subscribe", topic)
            .option("startingOffsets", starting)
            .option("failOnDataLoss", str(fail_on_data_loss).lower())
            .load()
            .select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
                    "topic", "partition", "offset"))


def write_stream(df: DataFrame, topic: str, bootstrap: str, checkpoint: str):
    """Kafka sink with the producer settings of the reference (acks all,
    retries, linger 5 ms, snappy). ``df`` must carry ``key``/``value``."""
    return (df.writeStream.format("kafka")
            .option("kafka.bootstrap.servers", bootstrap)
            .option("topic", topic)
            .option("kafka.acks", "all")
            .option("kafka.retries", "5")
            .option("kafka.linger.ms", "5")
            .option("kafka.compression.type", "snappy")
            .option("checkpointLocation", checkpoint)
            .start())


def decode_ticks(messages: DataFrame, value_col: str = "value", now: Column | None = None) -> DataFrame:
    """Parse JSON ticks. Unparsable messages and messages without symbol,
    price or volume are dropped (see ``decode_ticks_with_rejects`` to keep
    them)."""
    return decode_ticks_with_rejects(messages, value_col, now)[0]


def _parsed(messages: DataFrame, value_col: str, schema: T.StructType) -> DataFrame:
    """PERMISSIVE parse with every scalar as text, as it was sent, so that no field's type can lose the
    message; malformed text sets ``_m._corrupt``."""
    fields = [T.StructField(f.name, f.dataType if isinstance(f.dataType, T.MapType) else T.StringType()) for f in schema.fields]
    typed = T.StructType(fields + [T.StructField("_corrupt", T.StringType())])
    return messages.withColumn("_m", F.from_json(F.col(value_col), typed,
                                                 {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))


def _malformed() -> Column:
    return F.col("_m").isNull() | F.col("_m._corrupt").isNotNull()


def parse_ticks(messages: DataFrame, value_col: str = "value") -> DataFrame:
    """Every well-formed JSON tick with its fields as sent (text; missing -> null);
    malformed messages are left out (the sink logs and skips them)."""
    p = _parsed(messages, value_col, TICK_WIRE_SCHEMA)
    return p.filter(~_malformed()).select(*[F.col(f"_m.{f.name}").alias(f.name) for f in TICK_WIRE_SCHEMA.fields])


def decode_ticks_with_rejects(messages: DataFrame, value_col: str = "value",
                              now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(ticks, rejects). Numbers may come as numbers or text, volumes with a fraction, times as epoch seconds
    or ISO text; a missing or unreadable time is ``now`` (null without one). Rejects are the messages
    as they came with ``reason``: 'json', or the fields missing or unreadable."""
    p = _parsed(messages, value_col, TICK_WIRE_SCHEMA)
    p = p.withColumns({"_price": wire_number("_m.price"), "_volume": wire_number("_m.volume")})
    faults = F.concat_ws(",", F.when(F.col("_m.symbol").isNull(), F.lit("symbol")), F.when(F.col("_price").isNull(), F.lit("price")),
                         F.when(F.col("_volume").isNull(), F.lit("volume")))
    p = p.withColumn("reason", F.when(_malformed(), F.lit("json")).otherwise(faults))
    good = p.filter(~_malformed() & F.col("_m.symbol").isNotNull() & F.col("_price").isNotNull() & F.col("_volume").isNotNull())
    good = good.withColumn("_time", parse_epoch_or_iso("_m.timestamp", now)).select(
        F.col("_m.event_id").alias("event_id"),
        (F.unix_micros("_time") / F.lit(1e6)).alias("timestamp"),
        F.col("_time").alias("time"),
        F.col("_m.symbol").alias("symbol"),
        F.col("_price").alias("price"),
        F.col("_volume").alias("volume"),
        F.col("_m.source").alias("source"),
        wire_number("_m.bid").alias("bid"),
        wire_number("_m.ask").alias("ask"))
    return good, p.filter(F.col("reason") != "").drop("_m", "_price", "_volume")


def decode_alerts(messages: DataFrame, value_col: str = "value") -> DataFrame:
    return decode_alerts_with_rejects(messages, value_col)[0]


def decode_alerts_with_rejects(messages: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(alerts, rejects). Every well-formed message is an alert: numbers as in ticks (unreadable ones are null),
    whole-number fields lose a fraction, a missing id is 'none', ``timestamp`` stays text for
    ``sinks.alert_time``. Rejects carry ``reason`` 'json'."""
    p = _parsed(messages, value_col, ALERT_WIRE_SCHEMA)
    cols = []
    for f in ALERT_WIRE_SCHEMA.fields:
        c = F.col(f"_m.{f.name}")
        if f.name == "event_id":
            c = F.coalesce(c, F.lit("none"))
        elif isinstance(f.dataType, (T.DoubleType, T.LongType, T.IntegerType)):
            c = wire_number(f"_m.{f.name}").try_cast(f.dataType)
        cols.append(c.alias(f.name))
    return p.filter(~_malformed()).select(*cols), p.filter(_malformed()).drop("_m").withColumn("reason", F.lit("json"))


def encode_events(df: DataFrame, key_col: str = "symbol", time_col: str | None = "time") -> DataFrame:
    """Keyed JSON messages: ``key`` = symbol (per-symbol ordering), ``value``
    = the row as JSON with the time as epoch seconds (``timestamp``); missing fields are
    written as null."""
    cols: list[Column] = []
    for c in df.columns:
        if c == time_col:
            cols.append((F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6)).alias("timestamp"))
        else:
            cols.append(F.col(c))
    return df.select(F.col(key_col).cast("string").alias("key"), F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))
