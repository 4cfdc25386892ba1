"""Following pointers in a table: which rows does a start lead to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.session import ensure_checkpoint_dir


def follow(nodes: DataFrame, keys: Sequence[str], node: str, to: str, start: str) -> DataFrame:
    """The rows (keys, node) of ``nodes`` that pointers lead to from rows flagged ``start``.

    ``to`` is the node a row points to in the same key (null at an end); ``keys + [node]`` is unique.
    Each round doubles the steps that a pointer stands for, so a chain of n rows takes log2(n) rounds, one
    join and one aggregate each; rounds are cut by reliable checkpoints. Without any pointer no
    round runs.
    """
    keys = list(keys)
    ensure_checkpoint_dir(nodes.sparkSession)
    state = nodes.select(*keys, F.col(node).alias("n"), F.col(to).alias("to"), F.col(start).alias("hit")).checkpoint()
    while not state.filter("to is not null").isEmpty():
        far = state.select(*keys, F.col("n").alias("to"), F.col("to").alias("_far"))
        hop = state.filter("to is not null").join(far, keys + ["to"])
        step = F.explode(F.array(F.struct("n", F.col("_far").alias("to"), "hit"),
                                 F.struct(F.col("to").alias("n"), F.lit(None).cast(nodes.schema[to].dataType).alias("to"), "hit")))
        moved = hop.select(*keys, step.alias("s")).select(*keys, "s.*")
        state = (moved.unionByName(state.withColumn("to", F.lit(None).cast(nodes.schema[to].dataType)))
                 .groupBy(*keys, "n").agg(F.max("to").alias("to"), F.max("hit").alias("hit")).checkpoint())
    return state.filter("hit").select(*keys, F.col("n").alias(node))
