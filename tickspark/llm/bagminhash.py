"""Weighted near-duplicate classes: BagMinHash signatures, bands, exact multiset verification.

Items are the five-word shingles of a document, weighted by how often they occur. For each item a
random process over the weight axis is fixed by the item's hash: the axis is cut at 1, 2, 4, 8, ...
into independent Poisson processes, and inside a cut the process is split in halves, the half that
does not hold the parent's first point continuing behind it (the waiting time has no memory). A
document sees the points below its weights; the earliest point of each of M uniform labels is its
signature, and two documents agree in a label with probability equal to their weighted Jaccard
similarity. Points later than a bound that the document's total weight gives are never made.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickspark.llm.common import WordHashes, as_long, cut, mix64, rolling, stored, text_batches, unit
from tickspark.llm.components import components

SHINGLE = 5
BANDS = 32
ROWS = 5
LABELS = BANDS * ROWS  # chance to miss a pair at similarity 0.8: (1 - 0.8^5)^32 = 3e-6
THRESHOLD = 0.8
#: Copies of a pivot's text: its members are dealt over so many tasks.
SALTS = 16
#: Pivot rounds before the rest is compared in blocks, and the pivots a bucket has in each.
PIVOTS = (1, 4)
#: Documents of a block.
BLOCK = 512
#: Labels that must agree before a pair in blocks is compared: six standard deviations below a pair at 0.8.
LEAST_AGREEMENT = int(LABELS * THRESHOLD - 6 * math.sqrt(LABELS * THRESHOLD * (1 - THRESHOLD)))
#: Documents whose points are made together.
DOCS = 64

_WORD = bytes((c + 32 if 65 <= c <= 90 else c) if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128)
              else 32 for c in range(256))
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, seen: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes and their counts. Words are lower-cased runs of letters, digits and
    non-ASCII characters; a text of one to four words is one shingle, an empty one has none."""
    words = seen.array((text or "").lower().encode().translate(_WORD).split())
    if not len(words):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.unique(rolling(words, min(SHINGLE, len(words)), 7), return_counts=True)


def _points(doc, item, weight, bound):
    """Points of the items below their weights and the documents' bounds: (doc, label, time)."""
    top = int(weight.max()).bit_length() if len(weight) else 0
    found, leaves = [], []
    for octave in range(top + 1):
        lo0, width0 = (0, 1) if octave == 0 else (1 << (octave - 1), 1 << (octave - 1))
        use = weight > lo0
        if not use.any():
            break
        d, w = doc[use], weight[use]
        r = mix64(item[use] + np.uint64((int(_GOLD) * (octave + 1)) % 2**64))
        t = -np.log(unit(r)) / (LABELS * width0)
        lo, width = np.full(len(d), lo0, np.int64), width0
        while True:
            on = (t < bound[d]) & (lo < w)
            d, w, r, t, lo = d[on], w[on], r[on], t[on], lo[on]
            if width == 1 or not len(d):
                leaves.append((d, r, t))
                break
            inside = lo + width <= w
            found.append((d[inside], _label(r[inside]), t[inside]))
            # split: the half that the point falls into keeps it, the other goes on behind it
            level = np.uint64((int(_GOLD) * width) % 2**64)  # a point that is handed down draws anew at each width
            width //= 2
            other = mix64((r ^ np.uint64(0xD6E8FEB86659FD93)) + level)
            later = t - np.log(unit(other)) / (LABELS * width)
            high = (mix64((r ^ np.uint64(0x2545F4914F6CDD1D)) + level) >> np.uint64(63)).astype(bool)
            lo = np.concatenate([lo + np.where(high, width, 0), lo + np.where(high, 0, width)])
            d, w, r, t = (np.concatenate(x) for x in ((d, d), (w, w), (r, other), (t, later)))
    d, r, t = (np.concatenate(x) for x in zip(*leaves, strict=True)) if leaves else (doc[:0], item[:0], np.empty(0))
    found.append((d, _label(r), t))
    # a unit of weight goes on point by point: twice as many in each round as in the one before
    done, many = 1, 1
    while len(d):
        seed = mix64(r[:, None] + np.arange(done, done + many, dtype=np.uint64)[None, :] * _GOLD)
        times = t[:, None] + np.cumsum(-np.log(unit(seed)) / LABELS, axis=1)
        on = times < bound[d][:, None]
        found.append((np.repeat(d, on.sum(axis=1)), _label(seed[on]), times[on]))
        go = on[:, -1]
        d, r, t = d[go], r[go], times[go, -1]
        done, many = done + many, many * 2
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _label(r: np.ndarray) -> np.ndarray:
    return (mix64(r + np.uint64(0x5851F42D4C957F2D)) % np.uint64(LABELS)).astype(np.int64)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row of LABELS times for each bag (all infinite for an empty one)."""
    out = np.full((len(bags), LABELS), np.inf)
    total = np.array([c.sum() for _, c in bags], float)
    todo, slack = np.flatnonzero(total > 0), 4.0
    while len(todo):
        bound = (math.log(LABELS) + slack) / total[todo]
        sizes = [len(bags[i][0]) for i in todo]
        doc = np.repeat(np.arange(len(todo)), sizes)
        item = np.concatenate([bags[i][0] for i in todo])
        weight = np.concatenate([bags[i][1] for i in todo]).astype(np.int64)
        d, label, t = _points(doc, item, weight, bound)
        sig = np.full(len(todo) * LABELS, np.inf)
        np.minimum.at(sig, d * LABELS + label, t)
        sig = sig.reshape(len(todo), LABELS)
        done = np.isfinite(sig).all(axis=1)
        out[todo[done]] = sig[done]
        todo, slack = todo[~done], slack * 2 + 5
    return out


_SIGNED = "doc long, hash long, one long, two long, bands array<long>, marks binary"


def _sign(batches):
    seen = WordHashes()
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for k in range(0, len(ids), DOCS):
            bags = [shingles(t, seen) for t in texts[k:k + DOCS]]
            sig = mix64(signatures(bags).view(np.uint64)).reshape(len(bags), BANDS, ROWS)
            odd = mix64(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
            band = mix64((sig * odd).sum(axis=2, dtype=np.uint64)
                         + np.arange(BANDS, dtype=np.uint64) * _GOLD)
            ones = [int(mix64(i * _GOLD + c.astype(np.uint64)).sum(dtype=np.uint64)) for i, c in bags]
            twos = [int(mix64(i + _GOLD * c.astype(np.uint64) + np.uint64(11)).sum(dtype=np.uint64)) for i, c in bags]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[k:k + DOCS], pa.int64()), b.column(2).slice(k, DOCS), pa.array(as_long(np.array(ones, np.uint64))),
                pa.array(as_long(np.array(twos, np.uint64))),
                pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(bags) + 1, BANDS, dtype=np.int32)),
                                         pa.array(as_long(band.reshape(-1)))),
                pa.array([m.tobytes() for m in (sig.reshape(len(bags), LABELS) >> np.uint64(56)).astype(np.uint8)], pa.binary())],
                names=["doc", "hash", "one", "two", "bands", "marks"])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two shingle bags; two empty ones are equal."""
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][ia], b[1][ib]).sum()
    union = a[1].sum() + b[1].sum() - both
    return float(both / union) if union else 1.0


def _verify(batches):
    """Rows sorted by (pivot, salt, the pivot's own row first): overlap of each member with the pivot."""
    seen = WordHashes()
    held, bag = None, None
    for b in batches:
        a, m, s = [], [], []
        for pivot, salt, own, doc, text in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if own == 0:
                held, bag = (pivot, salt), shingles(text, seen)
            elif held == (pivot, salt):
                sim = similarity(bag, shingles(text, seen))
                if sim >= THRESHOLD:
                    a.append(pivot)
                    m.append(doc)
                    s.append(sim)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(m, pa.int64()),
                                          pa.array(s, pa.float64())], names=["a", "b", "similarity"])


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) of the pairs (a pivot, b member) at or above THRESHOLD, by exact overlap of
    their shingle bags. Members of a pivot are dealt over SALTS tasks and streamed past its bag."""
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    members = (dealt.join(texts, dealt.b == texts.doc)
               .select(F.col("a").alias("pivot"), "salt", F.lit(1).alias("own"), "doc", "text"))
    heads = cut(dealt.select("a", "salt").distinct())
    heads = (heads.join(texts, heads.a == texts.doc)
             .select(F.col("a").alias("pivot"), "salt", F.lit(0).alias("own"), "doc", "text"))
    return (heads.unionByName(members).repartition("pivot", "salt")
            .sortWithinPartitions("pivot", "salt", "own")
            .mapInArrow(_verify, "a long, b long, similarity double"))


def _blocks(batches):
    """Rows sorted by (group, lo, hi): links between documents of block lo and block hi that are not in
    one class. Pairs whose marks agree too little for THRESHOLD are passed over, the likeliest go
    first, and pairs that links found here already connect are not needed."""
    seen = WordHashes()
    key, rows = None, []

    def links():
        side = np.array([r[0] for r in rows])
        a, b = np.flatnonzero(side == key[1]), np.flatnonzero(side == key[2])
        marks = np.stack([np.frombuffer(r[3], np.uint8) for r in rows])
        cls = [r[2] for r in rows]
        agree = np.zeros((len(a), len(b)), np.int16)
        for k in range(LABELS):
            agree += marks[a, k][:, None] == marks[b, k][None, :]
        x, y = np.nonzero(agree >= LEAST_AGREEMENT)
        order = np.argsort(-agree[x, y], kind="stable")
        root = {c: c for c in cls}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        bags = {}
        for i, j in zip(a[x[order]].tolist(), b[y[order]].tolist(), strict=True):
            if i == j or (key[1] == key[2] and i > j) or find(cls[i]) == find(cls[j]):
                continue
            for k in (i, j):
                if k not in bags:
                    bags[k] = shingles(rows[k][4], seen)
            sim = similarity(bags[i], bags[j])
            if sim >= THRESHOLD:
                root[find(cls[i])] = find(cls[j])
                yield rows[i][1], rows[j][1], sim

    def batch(found):
        cols = list(zip(*found, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(list(cols[0]), pa.int64()), pa.array(list(cols[1]), pa.int64()),
                                           pa.array(list(cols[2]), pa.float64())], names=["a", "b", "similarity"])

    for b in batches:
        for group, lo, hi, *row in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
            if key != (group, lo, hi):
                if rows:
                    yield batch(list(links()))
                key, rows = (group, lo, hi), []
            rows.append(row)
    if rows:
        yield batch(list(links()))


def finish(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """Links still to be found among the buckets of ``rest`` (bucket, doc, class). Documents that buckets
    connect form a group; a group is cut into blocks of about BLOCK documents, and each two blocks
    meet in one task, which holds both and emits only links."""
    low = rest.groupBy("bucket").agg(F.min("doc").alias("a"))
    group = components(rest.join(low, "bucket").select("a", F.col("doc").alias("b")))
    group = group.select(F.col("id").alias("doc"), F.col("label").alias("group"))
    parts = group.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    docs = cut(rest.select("doc", "class").distinct().join(group, "doc").join(parts, "group")
            .withColumn("block", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("doc", "class", "group", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block"))
    return (docs.join(texts, "doc").select("group", "lo", "hi", "block", "doc", "class", "marks", "text")
            .repartition("group", "lo", "hi").sortWithinPartitions("group", "lo", "hi")
            .mapInArrow(_blocks, "a long, b long, similarity double"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each id and bag of it (one a document where ids do not repeat): doc_id, class_id (the smallest id of its class), copy_of (the
    smallest id whose shingle bag is equal), n_links (the links to other bags that hold its class together).

    Documents are linked when the weighted Jaccard similarity of their five-word shingle bags is 0.8
    or more; classes are the connected components of the links. Bags that share a band are
    candidates. Two rounds compare the pivots of each bucket (members that meet most others) with
    all members of other classes; what still shares a bucket but no class is compared in blocks.

    Null texts count as empty; all empty texts are copies of each other. Rows with a null id are
    left out. Texts that share an id are compared each for itself: an id has a row for each bag its texts have,
    and equal ones give one row. Where one id is the smallest of several classes, the class of its smallest text hash
    has that class_id, and the others a negative number from id and hash. Other columns play no role.
    """
    spark = docs.sparkSession
    text_batches(spark)
    narrow = (docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
              .where(F.col("doc").isNotNull()).withColumn("hash", F.xxhash64("text")))
    signed = stored(narrow.mapInArrow(_sign, _SIGNED))
    first = signed.groupBy("one", "two").agg(F.min(F.struct("doc", "hash")).alias("f")).select("f.doc", "f.hash")
    # bands depend on the bag alone, so one row of each bag stands for all its copies; a bag goes by a number of its
    # own from here on, as an id may have several texts. ``head`` is the smallest id of the bag
    bags = (signed.join(first, ["doc", "hash"], "left_semi").dropDuplicates(["doc", "hash"])
            .withColumnRenamed("doc", "head").withColumn("doc", F.monotonically_increasing_id()))
    bags = cut(bags)
    entries = bags.select("doc", F.explode("bands").alias("bucket"))
    # narrow tables are written before they meet wide ones: their size is known then, and where they are small
    # enough to be broadcast the wide side is not shuffled
    many = cut(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    entries = cut(entries.join(many, "bucket").select("bucket", "doc", "n"))
    # a document that meets many others lies in the middle of its group: it is the better pivot
    hubs = entries.groupBy("doc").agg(F.sum("n").alias("hub"))
    entries = cut(entries.join(hubs, "doc").select("bucket", "doc", "hub"))
    ids = cut(entries.select("doc").distinct())
    named = cut(bags.join(ids, "doc", "left_semi").select("doc", F.col("head").alias("_id"), F.col("hash").alias("_hash"), "marks"))
    texts = (narrow.withColumnsRenamed({"doc": "_id", "hash": "_hash"}).join(named, ["_id", "_hash"])
             .dropDuplicates(["_id", "_hash"]).select("doc", "text", "marks"))
    texts = stored(texts)

    links = spark.createDataFrame([], "a long, b long, similarity double")
    classes = None
    rest = entries
    for pivots in (*PIVOTS, None):
        named = rest if classes is None else rest.join(classes, "doc", "left")
        named = named.withColumn("class", F.col("doc") if classes is None else F.coalesce("class", "doc"))
        split = named.groupBy("bucket").agg(F.min("class").alias("_a"), F.max("class").alias("_b")).where("_a < _b")
        rest = cut(named.join(split.select("bucket"), "bucket").select("bucket", "doc", "hub", "class"))
        if rest.isEmpty():
            break
        if pivots is None:
            found = cut(finish(rest, texts))
        else:
            first = (rest.withColumn("_r", F.row_number().over(
                Window.partitionBy("bucket").orderBy(F.desc("hub"), F.xxhash64("doc"), "doc"))).where(F.col("_r") <= pivots)
                .select("bucket", F.col("doc").alias("a"), F.col("class").alias("_ca")))
            pairs = cut(rest.join(first, "bucket").where("class <> _ca")
                        .select("a", F.col("doc").alias("b")).distinct())
            found = cut(verify(pairs, texts.drop("marks")))
            # a pivot has met all of its bucket
            rest = (rest.join(first, (rest.bucket == first.bucket) & (rest.doc == first.a), "left_anti")
                    .select("bucket", "doc", "hub"))
        links = links.unionByName(found)
        classes = components(links.select("a", "b")).withColumnRenamed("id", "doc").withColumnRenamed("label", "class")
    degree = (links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
              .select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count(F.lit(1)).alias("n_links")))
    if classes is None:
        classes = spark.createDataFrame([], "doc long, class long")
    least = (classes.join(bags.select("doc", F.struct("head", "hash").alias("f")), "doc").groupBy("class").agg(F.min("f").alias("f")))
    least = cut(least)
    of = classes.join(least, "class").join(degree, "doc", "left").select(F.col("doc").alias("bag"), "f", "n_links")
    # an id that begins several classes names one of them only; few ids do, and one row stands for each
    firsts = least.select("f.*").unionByName(bags.join(classes, "doc", "left_anti").select("head", "hash"))
    shared = firsts.groupBy("head").agg(F.min("hash").alias("_own"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    shared = cut(shared.select(F.col("head").alias("_head"), "_own"))
    member = (signed.select(F.col("doc").alias("doc_id"), "one", "two")
              .join(bags.select("one", "two", F.col("doc").alias("bag"), "head", "hash"), ["one", "two"])
              .select("doc_id", "bag", "head", "hash").distinct())
    member = member.join(of, "bag", "left").withColumn("f", F.coalesce("f", F.struct("head", "hash")))
    return (member.join(shared, F.col("f.head") == F.col("_head"), "left")
            .select("doc_id", F.when(F.col("f.hash") != F.col("_own"), F.xxhash64("f").bitwiseOR(F.lit(-(1 << 63))))
                    .otherwise(F.col("f.head")).alias("class_id"), F.col("head").alias("copy_of"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
