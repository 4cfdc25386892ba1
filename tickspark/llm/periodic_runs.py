"""Periodic runs of words: tiles per period octave, boundary extensions, fragments stitched by Spark.

A stretch has period q where words q apart are equal. Octave k holds the periods from 2**k to below
2**(k + 1). Its tiles (``Tile``) have boundaries every 2**k words. A stretch of at least four
periods covers two boundaries next to each other, at which the 2**k words to the right equal those
q further on; hashes of 2**k words, doubled from octave to octave, name the boundaries and periods
where that may be. From the outer ones of such a row of boundaries the common extension to the left
and right (the Z-value of the tile at that shift) gives the fragment, which is then compared word
by word. Tiles overlap by more than three of their longest periods, so what a tile edge cuts is seen
by the next tile as well; fragments meet by (document, period) in a Spark shuffle, where overlapping
ones become one run.

Texts of a batch lie behind each other in one stream, parted by values equal to nothing else, so short
documents share a tile and long ones span many. Work is the words times their octaves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickspark.llm.common import mix64, stored, text_batches

#: A run holds at least so many periods and so many words.
LEAST_PERIODS, LEAST_WORDS = 4, 6
#: Words of a tile's own part; tiles of long periods are longer.
TILE_WORDS = 1 << 16
RUN = "array<struct<start:long,length:long,period:long>>"
FRAGMENT = "array<struct<period:long,lo:long,hi:long>>"


class Numbers(dict):
    """word -> its number in the batch (exact: no hash decides equality)."""

    def __missing__(self, word: bytes) -> int:
        v = self[word] = len(self)
        return v


@dataclass
class Tile:
    """Words ``at`` onwards of a stream for octave ``k``: their numbers, and hashes of 2**k words from each."""

    at: int
    k: int
    words: np.ndarray
    hashes: np.ndarray


def least_equal(q: int) -> int:
    """Equalities (of words q apart) in the shortest run of period q."""
    return max(LEAST_WORDS, LEAST_PERIODS * q) - q


def tiles(words: np.ndarray, longest: int) -> Iterator[Tile]:
    """The overlapping tiles of a stream, octave by octave, up to the periods that fit ``longest`` words
    four times."""
    n, k, hashes = len(words), 0, mix64(words.astype(np.uint64))
    while LEAST_PERIODS << k <= longest:
        step = 1 << k
        core, over = max(TILE_WORDS, 16 * step), 10 * step
        for at in range(0, max(1, n), core):
            end = min(n, at + core + over)
            yield Tile(at, k, words[at:end], hashes[at:end])
            if end == n:
                break
        if n <= 2 * step:
            break
        with np.errstate(over="ignore"):
            ahead = np.concatenate([hashes[step:], mix64(np.arange(n - step, n, dtype=np.uint64) + np.uint64(1 << 60))])
            hashes = mix64(hashes * np.uint64(0x9E3779B97F4A7C15) + ahead)
        k += 1


def solve(tile: Tile) -> Iterator[tuple[int, int, int]]:
    """(period, lo, hi) in stream positions: words lo to hi - 1 equal those a period further, maximal inside
    the tile, long enough for a run, no shorter period."""
    x, step = tile.words, 1 << tile.k
    rows = len(x) // step
    if rows < 3:
        return
    grid = tile.hashes[:rows * step].reshape(rows, step)
    same = grid[1:] == grid[:-1, :1]  # [j, r]: boundary j against period step + r
    pair = same[:-1] & same[1:]
    r, j = np.nonzero(pair.T)  # by period, boundaries ascending
    if not len(j):
        return
    new = np.ones(len(j), bool)
    new[1:] = (np.diff(r) != 0) | (np.diff(j) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(j)) - 1
    for a, b in zip(first, last):
        q = step + int(r[a])
        lo, hi = int(j[a]) * step, (int(j[b]) + 2) * step  # boundaries whose hashes agree, the pair's second included
        lo -= _backward(x, lo, q, step)
        hi += _forward(x, min(hi, len(x) - q), q, step)
        hi = min(hi, len(x) - q)
        if hi - lo >= least_equal(q) and _shortest(x[lo:lo + q]) and np.array_equal(x[lo:hi], x[lo + q:hi + q]):
            yield q, tile.at + lo, tile.at + hi


def _forward(x: np.ndarray, at: int, q: int, reach: int) -> int:
    """Words from ``at`` on that equal those q further, at most ``reach``."""
    end = min(at + reach, len(x) - q)
    differ = x[at:end] != x[at + q:end + q]
    return int(differ.argmax()) if differ.any() else max(0, end - at)


def _backward(x: np.ndarray, at: int, q: int, reach: int) -> int:
    start = max(0, at - reach)
    differ = (x[start:at] != x[start + q:at + q])[::-1]
    return int(differ.argmax()) if differ.any() else at - start


def _shortest(block: np.ndarray) -> bool:
    """Whether the block is no repetition of a shorter one."""
    q, rest, p = len(block), len(block), 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            d = q // p
            if np.array_equal(block[d:], block[:-d]):
                return False
            while rest % p == 0:
                rest //= p
        p += 1
    return True


def fragments(texts: Iterable[str | None]) -> tuple[list[bytes], list[int], list[list[tuple[int, int, int]]]]:
    """Per text: its words joined by one space, their number, and the fragments (period, lo, hi) of its runs."""
    number, joined, counts, parts = Numbers(), [], [], []
    for text in texts:
        words = (text or "").encode().split()
        joined.append(b" ".join(words))
        counts.append(len(words))
        parts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        parts.append(np.array([-len(counts)], np.int64))  # equal to no word and no other end
    out: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    if not counts:
        return joined, counts, out
    starts = np.concatenate([[0], np.cumsum(np.array(counts) + 1)])
    for tile in tiles(np.concatenate(parts), max(counts)):
        for q, lo, hi in solve(tile):
            doc = int(np.searchsorted(starts, lo, side="right")) - 1
            base = int(starts[doc])
            out[doc].append((q, lo - base, hi - base))
    return joined, counts, out


def _scan(fields: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined, counts, found = fragments(batch.column("text").to_pylist())
            cols = [batch.column(f) for f in fields]
            cols += [pa.array(counts, pa.int64()), pa.array(joined, pa.binary()).cast(pa.string()),
                     pa.array([[{"period": q, "lo": lo, "hi": hi} for q, lo, hi in f] for f in found],
                              pa.list_(pa.struct([("period", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(cols, names=[f"k{i}" for i in range(len(fields))] + ["n_words", "words", "fragments"])
    return scan


def stitch(pieces: DataFrame) -> DataFrame:
    """(key, period, lo, hi) fragments -> (key, runs): overlapping or touching ones of one period joined,
    those long enough kept, sorted by start, then period."""
    by = Window.partitionBy("key", "period").orderBy("lo", "hi")
    reach = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = pieces.withColumn("_new", (reach.isNull() | (F.col("lo") > reach)).cast("int"))
    island = marked.withColumn("_i", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = (island.groupBy("key", "period", "_i").agg(F.min("lo").alias("start"), F.max("hi").alias("_hi"))
             .withColumn("length", F.col("_hi") - F.col("start") + F.col("period"))
             .where(F.col("length") >= F.greatest(F.lit(LEAST_WORDS), F.col("period") * LEAST_PERIODS)))
    return whole.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period")))
                                    .cast(RUN).alias("runs"))


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, runs in zip(batch.column("words").to_pylist(), batch.column("runs").to_pylist()):
            words = text.split(" ")
            keep = np.ones(len(words), bool)
            for run in runs:
                keep[run["start"] + run["period"]:run["start"] + run["length"]] = False
            out.append(" ".join(words[i] for i in np.flatnonzero(keep)))
        yield batch.set_column(batch.schema.get_field_index("words"), "words", pa.array(out, pa.string()))


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a row of ``docs``: the ``keep`` columns, n_words, ``runs`` (start, length, period; by start,
    then period) and ``collapsed_text``: the words left, joined by one space, when every run keeps only its
    first period.

    Words are stretches of anything but the six ASCII blanks. A run is a stretch whose shortest period q
    fits at least four times, of at least six words, that no neighbouring word extends. Null and empty
    texts have no words, no runs and an empty collapsed text. Rows are told apart by a number written
    once, so repeated or null ids and equal texts each get their own answer; other columns of ``docs``
    do not matter. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text_batches(spark)
    keep = list(keep)
    named = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], "text")
    out = T.StructType([T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in out.fields]
                       + ["n_words long", "words string", f"fragments {FRAGMENT}"])
    scanned = stored(named.mapInArrow(_scan([f"k{i}" for i in range(len(keep))]), schema)
                     .withColumn("key", F.monotonically_increasing_id()))
    runs = stitch(scanned.where(F.size("fragments") > 0).select("key", F.inline("fragments")))
    found = scanned.where(F.size("fragments") > 0).drop("fragments").join(runs, "key", "left")
    found = found.withColumn("runs", F.coalesce("runs", F.array().cast(RUN)))
    plain = scanned.where(F.size("fragments") == 0).drop("fragments").withColumn("runs", F.array().cast(RUN))
    both = found.mapInArrow(_collapse, found.schema).unionByName(plain)
    return both.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "runs",
                       F.col("words").alias("collapsed_text"))


def longest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly (ties: smallest start, then period); null
    without one. ``runs`` is sorted by start, then period."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda best, run: F.when(
        best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best))
