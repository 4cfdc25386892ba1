"""Approximate nearest neighbours: a forest of random-projection trees, leaves taken from one
priority queue over all trees, exact reranking of their rows.

The split planes are fitted on a bounded sample; every row is then put into a leaf of every tree.
A query pops nodes, nearest first by the largest margin on the wrong side of its path, from one
queue that holds the roots of all trees, until its leaves hold ``share`` of all rows. Queries meet
the rows of a leaf in blocks; each block returns a query's best rows, exactly scored in doubles.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickspark.llm.common import cut, text_batches

TREES = 4
#: Vectors that the planes are fitted on (the smallest hashes of their ids), and of those in a leaf.
SAMPLE = 16_384
LEAF_SAMPLE = 64
#: Part of all rows that a query's leaves hold, counted over all trees: measured recall in the README.
SHARE = 1.4
BLOCK_ROWS = 4096
QUERY_ROWS = 8192


def fit(sample: np.ndarray, trees: int = TREES, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Balanced trees as heaps: (unit normals, offsets) of the inner nodes, root first. A plane runs
    between two random vectors of its node, at the median of the node's projections."""
    rng = np.random.default_rng(seed)
    depth = max(0, int(np.log2(max(1, len(sample)) / LEAF_SAMPLE)))
    out = []
    for _ in range(trees):
        normals = np.zeros(((1 << depth) - 1, sample.shape[1] if len(sample) else 0))
        offsets = np.zeros((1 << depth) - 1)
        members = {0: np.arange(len(sample))}
        for node in range((1 << depth) - 1):
            own = members.pop(node)
            a, b = rng.choice(own, 2, replace=False) if len(own) > 1 else (own[0], own[0])
            normal = sample[a] - sample[b]
            if not np.any(normal):
                normal = rng.normal(size=sample.shape[1])
            normal = normal / np.linalg.norm(normal)
            at = sample[own] @ normal
            order = np.argsort(at, kind="stable")
            half = len(own) // 2
            normals[node], offsets[node] = normal, at[order[half]] if len(own) else 0.0
            members[2 * node + 1], members[2 * node + 2] = own[order[:half]], own[order[half:]]
        out.append((normals, offsets))
    return out


def leaves(forest, vectors: np.ndarray) -> np.ndarray:
    """Leaf of each vector in each tree, shape (rows, trees)."""
    out = np.zeros((len(vectors), len(forest)), np.int64)
    for t, (normals, offsets) in enumerate(forest):
        node = np.zeros(len(vectors), np.int64)
        for _ in range(int(np.log2(len(offsets) + 1))):
            side = np.einsum("ij,ij->i", vectors, normals[node]) >= offsets[node]
            node = 2 * node + 1 + side
        out[:, t] = node - len(offsets)
    return out


def probe(forest, counts: np.ndarray, vector: np.ndarray, want: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of the shared queue until the leaves hold ``want`` rows."""
    margins = [normals @ vector - offsets for normals, offsets in forest]
    queue = [(0.0, t, 0) for t in range(len(forest))]
    found, held = [], 0
    while queue and held < want:
        worst, t, node = heapq.heappop(queue)
        inner = len(margins[t])
        if node >= inner:
            if counts[t, node - inner]:
                found.append((t, node - inner))
                held += counts[t, node - inner]
            continue
        m = margins[t][node]
        heapq.heappush(queue, (max(worst, -m if m < 0 else 0.0), t, 2 * node + 2))
        heapq.heappush(queue, (max(worst, m if m > 0 else 0.0), t, 2 * node + 1))
    return found


def _units(column) -> np.ndarray:
    v = np.stack([np.asarray(x, np.float64) for x in column])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def neighbours(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", top: int = 5,
               every: int = 50, share: float = SHARE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the ``top`` nearest rows found by cosine for each
    query (rows whose id is divisible by ``every``), nearest first, ties to the smaller id.

    Vectors that are null, empty, zero, of another length than the first in id order, or that hold a
    null or non-finite component take no part, and neither do null ids. Repeated ids count once (the
    smallest vector). Of equal vectors the ``top`` + 1 smallest ids enter the index: no other can be
    among the nearest. Fewer than ``top`` candidates give them all. Other columns play no role.
    """
    spark = vectors.sparkSession
    text_batches(spark)
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where("vec_id is not null and v is not null").where(~bad).where(F.exists("v", lambda x: x != 0))
    v = v.groupBy("vec_id").agg(F.min("v").alias("v"))
    head = v.orderBy("vec_id").select(F.size("v").alias("d")).first()
    dim = head.d if head else 0
    v = cut(v.where(F.size("v") == dim))
    same = Window.partitionBy("v").orderBy("vec_id")
    rows = cut(v.withColumn("_k", F.row_number().over(same)).where(F.col("_k") <= top + 1).drop("_k"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    forest = spark.sparkContext.broadcast(fit(_units(sample)))

    def place(batches):
        for b in batches:
            if len(b):
                at = leaves(forest.value, _units(b["v"]))
                yield pd.DataFrame({"vec_id": b["vec_id"], "v": b["v"], "leaf": list(at)})

    placed = cut(rows.mapInPandas(place, "vec_id long, v array<double>, leaf array<long>"))
    index = placed.select("vec_id", "v", F.posexplode("leaf").alias("tree", "leaf"))
    sizes = index.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).collect()  # trees * leaves rows at most
    width = len(forest.value[0][1]) + 1
    counts = np.zeros((len(forest.value), width), np.int64)
    for s in sizes:
        counts[s.tree, s.leaf] = s.n
    want = share * counts[0].sum()
    counts_b = spark.sparkContext.broadcast(counts)
    queries = v.where(F.col("vec_id") % every == 0)
    lots = max(1, -(-queries.count() // QUERY_ROWS))

    def search(batches):
        for b in batches:
            if not len(b):
                continue
            unit = _units(b["v"])
            hits = [probe(forest.value, counts_b.value, x, want) for x in unit]
            reps = np.array([len(h) for h in hits])
            flat = np.array([p for h in hits for p in h], np.int64).reshape(-1, 2)
            yield pd.DataFrame({"query_id": np.repeat(b["vec_id"].to_numpy(), reps),
                                "q": [x for x, n in zip(b["v"], reps, strict=True) for _ in range(n)],
                                "tree": flat[:, 0], "leaf": flat[:, 1]})

    probes = queries.mapInPandas(search, "query_id long, q array<double>, tree long, leaf long")
    blocks = spark.createDataFrame([(int(s.tree), int(s.leaf), -(-int(s.n) // BLOCK_ROWS)) for s in sizes],
                                   "tree long, leaf long, parts long")
    probes = (probes.join(F.broadcast(blocks), ["tree", "leaf"])
              .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
              .withColumn("lot", F.pmod(F.xxhash64("query_id"), F.lit(lots))).drop("parts"))
    index = (index.withColumn("tree", F.col("tree").cast("long")).join(F.broadcast(blocks), ["tree", "leaf"])
             .withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
             .withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long")))).drop("parts"))

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": []}, dtype="int64")
        right = right.sort_values("vec_id", kind="stable")
        ids, qs = right["vec_id"].to_numpy(), left["query_id"].to_numpy()
        a = np.stack(left["q"].to_numpy())
        b = np.stack(right["v"].to_numpy())
        score = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)[None, :]
        score[qs[:, None] == ids[None, :]] = -np.inf
        k = min(top, len(ids))
        # ties at the cut: all rows as good as the k-th stay, then the smaller ids win
        kth = -np.partition(-score, k - 1, axis=1)[:, k - 1] - 1e-12
        i, j = np.nonzero((score >= kth[:, None]) & np.isfinite(score))
        return pd.DataFrame({"query_id": qs[i], "vec_id": ids[j]})

    key = ["tree", "leaf", "part", "lot"]
    near = (probes.groupBy(*key).cogroup(index.groupBy(*key)).applyInPandas(rank, "query_id long, vec_id long")
            .distinct())
    pairs = (near.join(v.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id").join(v, "vec_id"))

    def exact(batches):
        for b in batches:
            if len(b):
                q, w = np.stack(b["q"].to_numpy()), np.stack(b["v"].to_numpy())
                dot = np.array([float(np.dot(x, y)) for x, y in zip(q, w, strict=True)])
                norm = np.array([float(np.sqrt(np.dot(x, x)) * np.sqrt(np.dot(y, y))) for x, y in zip(q, w, strict=True)])
                yield pd.DataFrame({"query_id": b["query_id"], "vec_id": b["vec_id"], "score": dot / norm})

    scored = pairs.select("query_id", "vec_id", "q", "v").mapInPandas(exact, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("query_id", "rank", "vec_id", "score"))
