"""Mixing sources to target weights by entropy balancing.

Every document gets the rate closest in relative entropy to 1 (and at most 3) whose words meet its
source's target: min(3, exp(lambda * size / mean size)), lambda being the source's dual variable.
Newton steps on the convex dual run for all sources at once; each is one aggregation over the
(source, size) histogram joined with the sources' current lambda. Rates are then rounded into
whole copies: copy c of a document is taken when c - rate - u < tau, u a hash of the id in [0, 1),
and tau, near 0, is solved for each source by three rounds of integer histograms. The copy that does not
fit there is passed over and the search goes on behind it among those no larger than what is left, until
none fits: the words then miss the target by less than the smallest document with copies to give. A few
documents a source then gain copies to close what is left. All counting is in integers or rounded duals: reruns agree.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickspark.llm.common import RAW_WORDS, cut, text_batches

CYCLE = (5.0, 2.0, 1.0)
MAX_COPIES = 3
NEWTON_STEPS = 40
TOLERANCE = 1e-7
#: Documents of a source (those with the smallest hashes) that may change by a copy to close what is left.
CLOSING = 512
_BINS = 12  # bits a round; keys have 36 bits below the point's unit of 2^-33 over the range [-4, 4)


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(RAW_WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``sizes`` (source, source_size) with weight and target. Sources in code-point order, null
    last, weigh CYCLE in turn and share all words; a target stops at MAX_COPIES times its source and
    the excess is shared again by weight among the others until none is above."""
    ranked = sizes.withColumn("_r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    pick = F.element_at(F.array(*[F.lit(w) for w in CYCLE]), (F.col("_r") % len(CYCLE) + 1).cast("int"))
    ranked = cut(ranked.withColumn("weight", pick).withColumn("cap", F.col("source_size") * float(MAX_COPIES)).drop("_r"))
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:  # the level only rises, and each round caps at least one more source
        free = F.col("weight") * level < F.col("cap")
        row = ranked.agg(F.sum(F.when(free, F.col("weight"))).alias("w"), F.sum(F.when(~free, F.col("cap"))).alias("c"),
                         F.sum((~free).cast("int")).alias("n")).first()
        if row.n == capped or not row.w:
            break
        capped, level = row.n, (total - (row.c or 0.0)) / row.w
    if row.w is None or not row.w:
        return ranked.withColumn("target", F.col("cap")).drop("cap")
    return ranked.withColumn("target", F.least(F.col("cap"), F.col("weight") * level)).drop("cap")


def duals(hist: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, target, mean, lam, full): the dual variable of each source, by guarded Newton steps.
    ``hist`` has (sid, size, n); sources whose target is all their copies are ``full``."""
    state = (goals.select("sid", "source_size", "target", "mean")
             .withColumn("full", F.col("target") >= F.col("source_size") * float(MAX_COPIES) * (1 - 1e-12))
             .withColumn("lam", F.lit(0.0)).withColumn("lo", F.lit(-1e9)).withColumn("hi", F.lit(1e9)))
    state = cut(state)
    for _ in range(NEWTON_STEPS):
        z = F.col("size") / F.col("mean")
        raw = F.exp(F.least(F.col("lam") * z, F.lit(50.0)))
        words = F.col("n") * F.col("size")
        sums = (hist.join(state.where("not full and target > 0").select("sid", "lam", "mean"), "sid")
                .groupBy("sid").agg(F.sum(words * F.least(raw, F.lit(float(MAX_COPIES)))).alias("got"),
                                    F.sum(F.when(raw < MAX_COPIES, words * raw * z).otherwise(0.0)).alias("slope")))
        step = state.join(sums, "sid", "left")
        gap = F.col("got") - F.col("target")
        step = (step.withColumn("lo", F.when(gap < 0, F.greatest("lo", "lam")).otherwise(F.col("lo")))
                .withColumn("hi", F.when(gap > 0, F.least("hi", "lam")).otherwise(F.col("hi"))))
        newton = F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope"))
        # outside the bracket, or too far for one step: halve the bracket, or double the step while it is open
        open_hi, open_lo = F.col("hi") >= 1e9, F.col("lo") <= -1e9
        bisect = (F.when(open_hi, F.col("lam") + F.greatest(F.abs("lam"), F.lit(1.0)))
                  .when(open_lo, F.col("lam") - F.greatest(F.abs("lam"), F.lit(1.0)))
                  .otherwise((F.col("lo") + F.col("hi")) / 2))
        inside = newton.isNotNull() & (newton > F.col("lo")) & (newton < F.col("hi")) & (F.abs(newton - F.col("lam")) <= 4)
        done = F.col("got").isNull() | (F.abs(gap) <= F.col("target") * TOLERANCE) | (F.col("hi") - F.col("lo") < 1e-13)
        step = (step.withColumn("_done", done)
                .withColumn("lam", F.when(F.col("_done"), F.col("lam")).otherwise(F.when(inside, newton).otherwise(bisect))))
        step = cut(step.drop("got", "slope"))
        state = step.drop("_done")
        if step.where("not _done").isEmpty():
            break
    return state.select("sid", "target", "source_size", "mean", "full", F.round("lam", 9).alias("lam"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        keep: list[str] | None = None) -> DataFrame:
    """One row a document: doc_id, size (its words), source_size, target (its source's), rate, copies
    (0 to 3), taken (copies * size); ``keep`` names further columns carried along.

    Null and empty texts have size 0 and rate 0, copies 0. A null source is one source, last in the
    order. Rows with equal ids and sizes get equal copies; a null id is hashed as such. Tables
    without words have all targets 0. Other columns play no role.
    """
    text_batches(docs.sparkSession)
    keep = keep or []
    names = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"),
                       *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    rows = cut(rows)
    hist0 = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    hist0 = cut(hist0)
    sizes = hist0.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"),
                                        F.sum("n").alias("docs"))
    goals = targets(sizes).withColumn("sid", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()))
    goals = cut(goals.withColumn("mean", F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9))))
    sid = F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())
    hist = cut(hist0.select(sid.alias("sid"), "size", "n").where("size > 0"))
    dual = cut(duals(hist, goals))

    rows = rows.withColumn("sid", sid).join(dual, "sid")
    rate = (F.when(F.col("size") == 0, 0.0).when(F.col("full"), float(MAX_COPIES))
            .otherwise(F.least(F.lit(float(MAX_COPIES)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0))))))
    rows = rows.withColumn("rate", F.when(F.col("target") <= 0, 0.0).otherwise(rate))
    # u and the rate in units of 2^-32: the keys are integers, so their histograms are exact
    unit = float(1 << 32)
    rows = (rows.withColumn("_u", F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id", "size"), 32))
            .withColumn("_q", F.round(F.col("rate") * unit).cast("long")))
    rows = cut(rows.select("doc_id", "sid", "size", "source_size", "target", "rate", "_u", "_q", *names,
                           F.monotonically_increasing_id().alias("_row")))
    units = (rows.where("size > 0")
             .select("sid", "size", "_q", "_u", F.explode(F.array(*[F.lit(c) for c in range(1, MAX_COPIES + 1)])).alias("c"))
             .select("sid", "size", (F.col("c") * int(unit) - F.col("_q") - F.col("_u") + 4 * int(unit)).alias("key")))
    state = cut(dual.select("sid", F.round("target").cast("long").alias("left"), F.lit(0).cast("long").alias("floor"),
                            F.lit(None).cast("long").alias("cap")))
    steps = []
    while True:
        step = _fit(units, state)
        if step is None:
            break
        steps.append(step.select("sid", "floor", "base", "cap"))
        # what did not fit is passed over; behind it only copies no larger than what is left can fit
        state = step.where("left > 0 and not last").select("sid", "left", (F.col("base") + 1).alias("floor"), F.col("left").alias("cap"))
    if steps:
        steps = reduce(DataFrame.unionByName, steps).groupBy("sid").agg(F.collect_list(F.struct("floor", "base", "cap")).alias("_steps"))
        rows = rows.join(steps, "sid", "left")
    else:
        rows = rows.withColumn("_steps", F.lit(None).cast("array<struct<floor:bigint,base:bigint,cap:bigint>>"))

    def takes(key: F.Column) -> F.Column:
        return F.coalesce(F.exists("_steps", lambda s: (key >= s["floor"]) & (key < s["base"])
                                   & (s["cap"].isNull() | (F.col("size") <= s["cap"]))), F.lit(False))

    taken = sum(F.when(takes(F.lit((c + 4) * int(unit)) - F.col("_q") - F.col("_u")), 1).otherwise(0)
                for c in range(1, MAX_COPIES + 1))
    rows = rows.withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(taken).cast("long"))
    rows = cut(rows.drop("_steps", "_q"))
    gap = rows.groupBy("sid").agg((F.round(F.max("target")).cast("long") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    few = (rows.where("size > 0").withColumn("_k", F.row_number().over(Window.partitionBy("sid").orderBy("_u", "doc_id", "size")))
           .where(F.col("_k") <= CLOSING).select("sid", "_row", "size", "copies", "_k"))
    change = few.join(gap, "sid").groupBy("sid").applyInPandas(_close, "_row long, _more long")
    out = rows.join(change, "_row", "left").withColumn("copies", F.col("copies") + F.coalesce("_more", F.lit(0)))
    return out.select("doc_id", "size", "source_size", "target", "rate", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"),
                      *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)])


def _fit(units: DataFrame, state: DataFrame) -> DataFrame | None:
    """For each source of ``state`` (sid, left, floor, cap) that still has units (sid, size, key) with keys
    from floor on and sizes up to cap (any if null): sid, left (less the words of those below base), floor,
    base (the first key that does not fit), cap, last (all fit). None where no source has any.

    Keys lie in [0, 2^35): three rounds of 12, 12 and 11 bits find the base."""
    now = state.withColumn("base", F.col("floor")).withColumn("last", F.lit(False))
    for shift in (23, 11, 0):
        bins = (units.join(F.broadcast(now.where("not last").select("sid", "base", "cap")), "sid")
                .where((F.col("key") >= F.col("base")) & (F.col("key") < F.col("base") + (1 << (shift + _BINS)))
                       & (F.col("cap").isNull() | (F.col("size") <= F.col("cap"))))
                .groupBy("sid", F.shiftright(F.col("key") - F.col("base"), shift).alias("bin")).agg(F.sum("size").alias("w")))
        run = bins.withColumn("cum", F.sum("w").over(Window.partitionBy("sid").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
        # the last bin that still fits whole; the next one is searched more finely
        found = (run.join(now.select("sid", "left"), "sid").groupBy("sid")
                 .agg(F.max(F.when(F.col("cum") <= F.col("left"), F.col("cum"))).alias("cum"),
                      F.min(F.when(F.col("cum") > F.col("left"), F.col("bin"))).alias("nbin")))
        # a source without units left drops out in the first round; in later ones only those that fit wholly have none
        now = now.join(found.withColumn("_some", F.lit(True)), "sid", "inner" if shift == 23 else "left")
        end = F.col("nbin").isNull() & F.col("_some")
        now = cut(now.select("sid", (F.col("left") - F.coalesce("cum", F.lit(0))).alias("left"), "floor", "cap",
                             F.when(F.col("_some").isNull(), F.col("base"))
                             .when(end, F.col("base") + (1 << (shift + _BINS)))
                             .otherwise(F.col("base") + F.col("nbin") * (1 << shift)).alias("base"),
                             (F.col("last") | F.coalesce(end, F.lit(False))).alias("last")))
        if shift == 23 and now.isEmpty():
            return None
    return now


def _close(few: pd.DataFrame) -> pd.DataFrame:
    """Copies that a source's CLOSING documents gain or lose, the largest first; the last step may
    overshoot where that is nearer."""
    few = few.sort_values(["size", "_k"], ascending=[False, True])
    gap, more = int(few["gap"].iloc[0]), []
    for size, copies in zip(few["size"].tolist(), few["copies"].tolist(), strict=True):
        step = min(MAX_COPIES - copies, gap // size) if gap > 0 else -min(copies, -gap // size)
        gap -= step * size
        more.append(step)
    size, copies = int(few["size"].iloc[-1]), int(few["copies"].iloc[-1]) + more[-1]
    if 2 * abs(gap) > size and 0 <= copies + (1 if gap > 0 else -1) <= MAX_COPIES:
        more[-1] += 1 if gap > 0 else -1
    return pd.DataFrame({"_row": few["_row"].to_numpy(), "_more": more})
