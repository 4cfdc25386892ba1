"""Connected components of a link table by contraction to minimum neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable over the links (a, b), for every id that has one.

    Each round points every id to the smallest id next to it (map-side combined, so a hub costs one row
    a task), follows the pointers twice, and keeps only the distinct links between the ids pointed to.
    A link is read in few rounds: a star or group of copies is gone after one. The smallest id of a
    component points to itself in every round, so it is the one left. The rounds' pointers, one row
    an id, are composed at the end. Tables between rounds go through the reliable checkpoint folder.
    """
    edges = cut(links.select(F.col("a").alias("u"), F.col("b").alias("v"))
                .union(links.select(F.col("b"), F.col("a"))).where("u <> v").distinct())
    rounds = []
    while not rounds or not edges.isEmpty():
        up = cut(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("label")))
        for _ in range(2):
            up = cut(_follow(up, up))
        rounds.append(up)
        half = edges.join(up, edges.v == up.id).select("u", F.col("label").alias("v")).distinct()
        edges = cut(half.join(up, half.u == up.id).select(F.col("label").alias("u"), "v").where("u <> v").distinct())
    labels = rounds.pop()
    while rounds:
        labels = cut(_follow(rounds.pop(), labels))
    return labels


def _follow(first: DataFrame, then: DataFrame) -> DataFrame:
    """(id, label): the label that ``then`` gives to the label of ``first``, where it gives one."""
    to = then.select(F.col("id").alias("_i"), F.col("label").alias("_l"))
    return first.join(to, first.label == to._i, "left").select("id", F.coalesce("_l", "label").alias("label"))
