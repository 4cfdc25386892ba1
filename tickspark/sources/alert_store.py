"""The stored alert table: idempotent inserts where the first arrival wins, day folders, range reads."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickspark.sources import sinks


class AlertStore:
    """Parquet under ``path/batch_id=N/date=D``.

    ``insert`` writes the alerts of a batch whose (event_id, time) no earlier batch stored; of copies inside
    the batch the smallest ``arrival`` stays (ties: by the row itself). A key's date follows from its
    time, so only the batch's days of the table are read. A retried batch overwrites its own folder
    and compares with the batches before it only, so it writes the same rows again. Use as a
    ``foreachBatch`` target, or call it for batch tables.
    """

    def __init__(self, path: str):
        self.path = path
        self._schema = None  # of what this object wrote: a table without rows has no files to tell

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.insert(batch, batch_id)

    def insert(self, batch: DataFrame, batch_id: int) -> None:
        seen = self._stored(batch.sparkSession)
        if seen is None:
            return self._write(self._first(batch), batch_id)
        batch = batch.persist()  # read for its days and for its rows; a lost executor's part is computed again
        try:
            days = [r[0] for r in batch.select(F.to_date("time")).distinct().collect()]  # calendar days of one batch
            seen = seen.filter((F.col("batch_id") < batch_id) & F.col("date").isin(days)).select("event_id", "time")
            self._write(self._first(batch).join(seen, ["event_id", "time"], "left_anti"), batch_id)
        finally:
            batch.unpersist()

    @staticmethod
    def _first(batch: DataFrame) -> DataFrame:
        rest = [c for c in batch.columns if c not in ("event_id", "time")]
        sortable = [c for c in rest if c not in ("arrival", "metadata")]
        return (batch.groupBy("event_id", "time")
                .agg(F.min_by(F.struct(*rest), F.struct("arrival", *sortable)).alias("_a"))
                .select("event_id", "time", "_a.*").withColumn("date", F.to_date("time")))

    def _write(self, rows: DataFrame, batch_id: int) -> None:
        self._schema = T.StructType([*rows.schema.fields, T.StructField("batch_id", T.IntegerType())])
        # a rebalance by day: few files a day, a crowded day split by its size, no sampling pass
        (rows.hint("rebalance", "date").sortWithinPartitions("date", "symbol", "time")
         .write.mode("overwrite").partitionBy("date").parquet(os.path.join(self.path, f"batch_id={batch_id}")))

    def _stored(self, spark: SparkSession) -> DataFrame | None:
        try:
            return spark.read.parquet(self.path)
        except AnalysisException:  # nothing stored yet
            return None

    def read(self, spark: SparkSession, start: Column | None = None, end: Column | None = None) -> DataFrame:
        """The stored alerts with ``start <= time < end``; other days are not read."""
        reader = spark.read if self._schema is None else spark.read.schema(self._schema)
        return sinks.in_range(reader.parquet(self.path), start, end).drop("batch_id", "date")
