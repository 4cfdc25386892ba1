"""Row-count windows that do not put a whole key into one task.

A ``ROWS BETWEEN n PRECEDING AND CURRENT ROW`` frame partitioned only by
symbol sends every tick of a symbol to a single task; one hot symbol can hold
a third of all rows. Instead rows are split into (key, time chunk) partitions
and each chunk receives a *halo*: copies of the ``n`` rows that precede it in
the key's global order. The window then runs per (key, chunk) and the halo
rows are dropped afterwards. The result is identical to the single-partition
window.

The rows are shuffled once, by (key, chunk), and the halo is cut from that shuffle (the plan reuses
its exchange, so the input is read once): the last ``n`` rows of each chunk are numbered in the key's
order, which needs only the chunks' row counts, and a row is copied into every chunk that starts at
most ``n`` positions behind it. A halo row may come from several chunks back when chunks are sparse; it
always lies in the last n rows of its own chunk, so tails suffice.

Halo rows are laid out by (key, chunk) too, so the union of rows and halo keeps that partitioning
and the windows need no further shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.functions.timefn import epoch_micros
from tickspark.session import ensure_checkpoint_dir

CHUNK_COL = "_chunk"
OWN_COL = "_own"
DEFAULT_CHUNK_SECONDS = None  # adaptive per key
TARGET_CHUNK_ROWS = 2_000_000
MAX_BROADCAST_KEYS = 1_000_000
CHUNK_LADDER = [60, 300, 900, 3600, 4 * 3600, 86400, 7 * 86400, 28 * 86400]
WHOLE_KEY_SECONDS = 1 << 40  # a chunk longer than any data span: the key is one chunk


def adaptive_chunk_seconds(df: DataFrame, keys: Sequence[str], time_col: str,
                           target_rows: int = TARGET_CHUNK_ROWS) -> DataFrame:
    """One row per key: the chunk length (seconds) for that key.

    The length is the largest ladder step whose row count at the key's
    busiest-hour rate stays under ``target_rows``, so a hot key is cut into
    short chunks and a quiet key into long ones (few halo copies). A key
    whose rows all fit under ``target_rows`` is one chunk (no halo at all).
    Hourly counts are a partial aggregate; the result has one row per key.
    """
    keys = list(keys)
    hour = F.floor(epoch_micros(time_col) / F.lit(3_600_000_000)).cast("long")
    hourly = df.groupBy(*keys, hour.alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    peak = hourly.groupBy(*keys).agg(F.max("_n").alias("_peak"), F.sum("_n").alias("_tot"))
    length = F.lit(CHUNK_LADDER[0])
    for step in CHUNK_LADDER[1:]:
        length = F.when(F.col("_peak") * F.lit(step / 3600.0) <= F.lit(float(target_rows)), F.lit(step)) \
                  .otherwise(length)
    length = F.when(F.col("_tot") <= F.lit(target_rows), F.lit(WHOLE_KEY_SECONDS)).otherwise(length)
    return peak.select(*keys, length.cast("long").alias("_chunk_sec"))


def with_chunk(df: DataFrame, keys: list[str], time_col: str, chunk_seconds: int | None = DEFAULT_CHUNK_SECONDS,
               target_rows: int = TARGET_CHUNK_ROWS, keep_length: bool = False) -> DataFrame:
    """Add ``_chunk``: fixed-length time chunks, or per-key lengths when
    ``chunk_seconds`` is None (``adaptive_chunk_seconds``). ``keep_length`` keeps the length
    of the row's chunks (``_chunk_sec``, seconds)."""
    out = _chunking(df, keys, time_col, chunk_seconds, target_rows)[0]
    return out if keep_length else out.drop("_chunk_sec")


def _chunking(df: DataFrame, keys: list[str], time_col: str, chunk_seconds: int | None,
              target_rows: int) -> tuple[DataFrame, bool]:
    """(rows with ``_chunk`` and ``_chunk_sec``, True when every key is a single chunk)."""
    whole = False
    if chunk_seconds is not None:
        base = df.withColumn("_chunk_sec", F.lit(int(chunk_seconds)).cast("long"))
    else:
        # one row per key: materialised once; one tiny aggregate over the materialised table gives its
        # row count (broadcast check) and whether any key needs more than one chunk
        ensure_checkpoint_dir(df.sparkSession)
        per_key = adaptive_chunk_seconds(df, keys, time_col, target_rows).checkpoint()
        n_keys, shortest = per_key.agg(F.count(F.lit(1)), F.min("_chunk_sec")).first()
        whole = shortest is None or shortest >= WHOLE_KEY_SECONDS
        base = df.join(F.broadcast(per_key) if n_keys <= MAX_BROADCAST_KEYS else per_key, keys)
    return base.withColumn(CHUNK_COL, F.floor(epoch_micros(time_col) / (F.col("_chunk_sec") * F.lit(1_000_000)))
                           .cast("long")), whole


def _order_cols(order: Sequence[str], descending: bool = False) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


def with_halo(df: DataFrame, keys: Sequence[str], order: Sequence[str], time_col: str,
              n_prev: int, chunk_seconds: int | None = DEFAULT_CHUNK_SECONDS,
              with_offsets: bool = False, target_rows: int = TARGET_CHUNK_ROWS) -> DataFrame:
    """Add ``_chunk`` and ``_own`` columns and the halo rows (``_own`` false).

    Windows over the result must be partitioned by ``keys + [_chunk]`` and
    ordered by ``order`` (a total order within a key, time first); keep only
    ``_own`` rows afterwards. ``n_prev`` is the largest number of preceding
    rows any frame needs. ``with_offsets`` adds ``_off``: the number of rows of the key in earlier
    chunks (at least one halo row comes with it). ``chunk_seconds=None``
    sizes chunks per key (``adaptive_chunk_seconds``).
    """
    keys = list(keys)
    order = list(order)
    base, whole = _chunking(df, keys, time_col, chunk_seconds, target_rows)
    base = base.drop("_chunk_sec")
    part = keys + [CHUNK_COL]
    if whole:
        # every key is one chunk: no row precedes a chunk, nothing to copy
        own = base.withColumn(OWN_COL, F.lit(True))
        return own.withColumn("_off", F.lit(0).cast("long")) if with_offsets else own
    if n_prev <= 0 and not with_offsets:
        return base.withColumn(OWN_COL, F.lit(True))

    laid = base.repartition(*part)
    own = laid.withColumn(OWN_COL, F.lit(True))
    n = max(n_prev, 1)
    # every column stays and no join is near, so that the tails read the very exchange the rows come from
    chunk_w = Window.partitionBy(*part)
    tails = (laid.withColumn("_rd", F.row_number().over(chunk_w.orderBy(*_order_cols(order, descending=True))))
             .withColumn("_cnt", F.count(F.lit(1)).over(chunk_w)).filter(F.col("_rd") <= n))
    key_w = Window.partitionBy(*keys)
    earlier = key_w.orderBy(CHUNK_COL).rangeBetween(Window.unboundedPreceding, -1)
    tails = tails.withColumn("_pos", F.coalesce(F.sum(F.when(F.col("_rd") == 1, F.col("_cnt"))).over(earlier), F.lit(0).cast("long"))
                             + F.col("_cnt") - F.col("_rd"))
    # the last row of a chunk knows the chunk that starts right behind it
    tails = tails.withColumn("_next", F.when(F.col("_rd") == 1, F.lead(CHUNK_COL).over(key_w.orderBy("_pos"))))
    starts = F.when(F.col("_next").isNotNull(), F.struct(F.col("_next").alias("chunk"), (F.col("_pos") + 1).alias("off")))
    into = F.collect_list(starts).over(key_w.orderBy("_pos").rangeBetween(0, n - 1))
    halo = (tails.withColumn("_into", into).withColumn("_to", F.explode("_into")).withColumn(CHUNK_COL, F.col("_to.chunk"))
            .withColumn(OWN_COL, F.lit(False)).withColumn("_off", F.col("_to.off")))
    if not with_offsets:
        return own.unionByName(halo.select(*own.columns).repartition(*part))
    own = own.withColumn("_off", F.lit(None).cast("long"))
    both = own.unionByName(halo.select(*own.columns).repartition(*part))
    return both.withColumn("_off", F.coalesce(F.max("_off").over(chunk_w), F.lit(0).cast("long")))


def halo_window(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*keys, CHUNK_COL).orderBy(*_order_cols(order))


def rows_frame(keys: Sequence[str], order: Sequence[str], start: int, end: int = 0):
    return halo_window(keys, order).rowsBetween(start, end)


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col(OWN_COL)).drop(OWN_COL, CHUNK_COL)
