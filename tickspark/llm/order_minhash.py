"""Order MinHash fingerprints, sensitive to edit distance.

The items of a text are its k-mers of code points, each numbered by its occurrence. For each of M
labels the L items of smallest hash are taken, put back into text order, and the tuple is hashed.
Two texts share a label's tuple with a probability that falls with their edit distance. The hashes
are exponential waiting times: an item's points arrive at rate M and each carries a uniform label,
so the few points below a bound, given by the text's length, hold every label's L smallest ones.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickspark.llm.common import cut, mix64, text_batches, unit

K = 8
L = 2
M = 64
#: Rows that a range holds on average: the fewest, and the most where there are ranges enough for all tasks.
RANGE_ROWS = 500
MOST_ROWS = 50_000
#: Keys looked at for each range when its bounds are chosen (that moves bounds, not results).
KEYS_A_RANGE = 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ODD = mix64(np.arange(1, K + 1, dtype=np.uint64)) | np.uint64(1)


def _items(codes: np.ndarray) -> np.ndarray:
    """Hash of every k-mer with its occurrence number, in text order."""
    k = min(K, len(codes))
    n = len(codes) - k + 1
    c = codes.astype(np.uint64)
    kmer = c[:n] * _ODD[0]
    for j in range(1, k):
        kmer += c[j:j + n] * _ODD[j]
    kmer = mix64(kmer)
    bits = np.uint64(max(1, (n - 1).bit_length()))
    by = np.sort((kmer >> bits << bits) | np.arange(n, dtype=np.uint64))
    at = (by & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    same = by >> bits
    again = np.flatnonzero(same[1:] == same[:-1]) + 1
    if len(again):
        first = np.arange(n)
        first[again] = 0
        number = np.arange(n) - np.maximum.accumulate(first)
        kmer[at[again]] = mix64(kmer[at[again]] + number[again].astype(np.uint64) * _GOLD)
    return kmer


def signature(text: str) -> np.ndarray:
    """M 32-bit tuple hashes. A text shorter than k is one item, the empty text has none; where a text
    has fewer than L items, all of them make the tuple."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(M, np.uint32)
    items = _items(codes)
    n, need = len(items), min(L, len(items))
    slack = 6.0
    while True:
        bound = min((math.log(M) + slack) / n, 1e9)
        pos, r = np.arange(n), mix64(items ^ np.uint64(0xA0761D6478BD642F))
        t = np.zeros(n)
        got = []
        quick = np.uint64(min(2**64 - 1, int(math.exp(-bound * M) * 2.0**64)))
        keep = r >= quick  # a first waiting time below the bound, before any logarithm
        pos, r, t = pos[keep], r[keep], t[keep]
        while len(pos):
            t = t - np.log(unit(r)) / M
            keep = t < bound
            pos, r, t = pos[keep], r[keep], t[keep]
            if not len(pos):
                break
            got.append((pos, (mix64(r + _GOLD) % np.uint64(M)).astype(np.int64), t))
            r = mix64(r ^ np.uint64(0xE7037ED1A0B428DB))
        if got:
            pos, label, t = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.lexsort((t, label))
            pos, label = pos[order], label[order]
            if need > 1:  # an item counts once in a label, at its first point
                pair = label * n + pos
                _, first = np.unique(pair, return_index=True)
                first.sort()
                pos, label = pos[first], label[first]
            start = np.searchsorted(label, np.arange(M + 1))
            if (np.diff(start) >= need).all():
                pick = np.sort(pos[start[:-1, None] + np.arange(need)], axis=1)
                acc = np.arange(1, M + 1, dtype=np.uint64) * _GOLD
                for j in range(need):
                    acc = mix64(acc + items[pick[:, j]])
                return (acc >> np.uint64(32)).astype(np.uint32)
        slack = 2 * slack + 4


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / M


def _hex(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as many first code points of ``following``, or all it has."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k] if k else text


_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def _chain(batches):
    """Rows sorted by descending key within their range, the first row of the next range at the end."""
    last = None
    for b in batches:
        rows = []
        for lot, own, doc, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            text = text or ""
            same = last is not None and last[3] == text  # repeated rows stand side by side
            now = (lot, own, doc, text, last[4] if same else signature(text))
            if last is not None and last[1] and last[0] == lot:
                new = edited(last[3], text)
                esig = last[4] if new == last[3] else signature(new)
                rows.append((last[2], len(last[3]), hashlib.sha256(new.encode()).hexdigest(), _hex(last[4]), _hex(esig),
                             likeness(last[4], esig), likeness(last[4], now[4])))
            last = now
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)],
                                         names=[f.split(" ")[0] for f in _OUT.split(", ")])


_HASH_BITS = 33  # a text's hash, the negated crc32, lies above -2^32


class Ranges:
    """Ranges of (key, hash) pairs in descending order; range 0 has the largest pairs."""

    def __init__(self, bounds: list[tuple[int, int]]):
        self.keys = np.unique(np.array([k for k, _ in bounds], np.int64))
        self.codes = np.array([], np.int64)
        self.codes = np.unique(self._code(*(np.array([b[i] for b in bounds], np.int64) for i in range(2))))

    def _code(self, key: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Numbers in the order of the pairs, as far as the bounds tell pairs apart."""
        at = np.searchsorted(self.keys, key)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == key[known]
        return (at << (_HASH_BITS + 1)) + np.where(known, c + (1 << (_HASH_BITS - 1)), 0)

    def of(self, key: np.ndarray, c: np.ndarray) -> np.ndarray:
        return len(self.codes) - np.searchsorted(self.codes, self._code(key, c), "right")


def _ranges(rows: DataFrame, count: int) -> Ranges:
    """Bounds from a sample of (key, c) that grows with the ranges: many rows of one key are parted by hash."""
    tasks = 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lots = max(1, count // MOST_ROWS, min(count // RANGE_ROWS, tasks))
    if lots == 1:
        return Ranges([])
    step = max(1, count // (lots * KEYS_A_RANGE))
    seen = rows.select("key", "c").where(F.pmod(F.xxhash64("key", "c"), F.lit(step)) == 0).distinct().toPandas()
    seen = seen.sort_values(["key", "c"])
    at = np.unique(np.arange(1, lots) * len(seen) // lots) if len(seen) else []
    return Ranges([tuple(x) for x in seen.iloc[at].itertuples(index=False)])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_chars (code points), edited_sha256, fingerprint and
    edited_fingerprint (hex of M tuple hashes), near_edited, near_next.

    Documents follow each other by descending id, null ids last, equal ids by text hash; after the
    last comes the first again. Documents are cut into ranges of (id, text hash), so many rows of one id, or
    without one, are parted too; a range also gets the first row of the next one, so texts move once. Null
    texts count as empty; two empty texts are alike (1.0). A single document follows itself; an empty table
    gives no rows. Other columns play no role.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    rows = (rows.withColumn("key", F.coalesce("doc", F.lit(-(1 << 63))))
            .withColumn("c", -F.crc32(F.coalesce("text", F.lit("")))))
    count = rows.count()
    if not count:
        return spark.createDataFrame([], _OUT)
    ranges = spark.sparkContext.broadcast(_ranges(rows, count))

    @F.pandas_udf("int")
    def lot(key: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(ranges.value.of(key.to_numpy(), c.to_numpy()))

    rows = rows.withColumn("lot", lot("key", "c"))
    # the first row of each range, also wanted by the range before it that has rows (the last by the first)
    heads = rows.groupBy("lot").agg(F.max(F.struct("key", "c")).alias("h"))  # one row a range
    order = Window.orderBy("lot")
    all_ = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = heads.select(F.coalesce(F.lead("h").over(order), F.first("h").over(all_)).alias("n"), F.col("lot").alias("before"))
    wanted = cut(wanted.select(F.col("n.key").alias("hk"), F.col("n.c").alias("hc"), "before"))
    halo = (rows.drop("lot").join(wanted, (F.col("key") == F.col("hk")) & (F.col("c") == F.col("hc")))
            .groupBy("before", "key", "c").agg(F.first("doc").alias("doc"), F.first("text").alias("text"))
            .select(F.col("before").alias("lot"), F.lit(False).alias("own"), "doc", "text", "key", "c"))
    own = rows.select("lot", F.lit(True).alias("own"), "doc", "text", "key", "c")
    return (own.unionByName(halo).repartition("lot")
            .sortWithinPartitions("lot", F.desc("own"), F.desc("key"), F.desc("c"))
            .select("lot", "own", "doc", "text").mapInArrow(_chain, _OUT))
