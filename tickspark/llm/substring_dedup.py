"""Removal of repeated 20-word passages by a compacted De Bruijn graph of token k-mers.

Edges of the graph are k-mers of five words. Every window of 20 words picks one of its sixteen
k-mers by content alone (the smallest hash, leftmost on ties), so equal windows pick equal edges.
Consecutive windows that pick the same edge form one compacted path (a segment of 20 to 35 words).
Through the shuffle on the edge, segments of equal content meet: where an edge carries one content
only the path does not branch and the segment is decided as a whole; where it branches, one
occurrence of each content is cut into its windows and those are decided one by one. Source
coordinates (doc_id, text hash, start) say which occurrence is the first; an equality needs two
independent 64-bit hashes to agree, each over all words of the window or segment.

Hot passages: each task collapses the equal segments it holds to their first one and emits the
others as decided, under a spread key, so a key reaches the shuffle once a task at most.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickspark.llm.common import WordHashes, as_long, cut, mix64, rolling, text_batches

WINDOW = 20
KMER = 5
STEP = WINDOW - KMER + 1  # k-mers in a window: sixteen, a power of two for the sliding minimum
#: Segments that a task gathers before it collapses equal ones.
FLUSH_ROWS = 500_000

_POS = 30  # bits of a position: Spark strings hold less than 2^30 words
_SEGMENT = "key long, check long, also long, doc long, twin long, start long, span int, decided boolean"


def _hashes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k-mer hashes and two independent window hashes of a run of word hashes."""
    km = rolling(words, KMER, 1)
    n = len(words) - WINDOW + 1
    four = [km[j:j + n] for j in range(0, WINDOW, KMER)]
    one = mix64(four[0] * np.uint64(0x9E3779B97F4A7C15) + four[1] * np.uint64(0xC2B2AE3D27D4EB4F)
                + four[2] * np.uint64(0x165667B19E3779F9) + four[3] * np.uint64(0xD6E8FEB86659FD93))
    km2 = rolling(words, KMER, 2)
    four = [km2[j:j + n] for j in range(0, WINDOW, KMER)]
    two = mix64(four[0] * np.uint64(0xA0761D6478BD642F) + four[1] * np.uint64(0xE7037ED1A0B428DB)
                + four[2] * np.uint64(0x8EBC6AF09C88C6E3) + four[3] * np.uint64(0x589965CC75374CC3))
    return km, one, two


def _segments(words: np.ndarray):
    """Compacted paths of one document: (edge hash, content hash, a second content hash, first window,
    windows). A segment is its first and its last window, which meet or overlap: each content hash is made
    of one of the two window hashes at both."""
    km, one, two = _hashes(words)
    n = len(one)
    at = (km >> np.uint64(_POS) << np.uint64(_POS)) | np.arange(len(km), dtype=np.uint64)
    s = 1
    while s < STEP:
        at = np.minimum(at[:-s], at[s:])
        s *= 2
    edge = (at & np.uint64((1 << _POS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], edge[1:] != edge[:-1])))
    span = np.diff(np.append(first, n))
    last = first + span - 1
    place = span.astype(np.uint64) + np.uint64(32) * (edge[first] - first).astype(np.uint64)
    content = mix64(mix64(one[first] + place) * np.uint64(0xD1342543DE82EF95) + one[last])
    second = mix64(mix64(two[first] + place) * np.uint64(0xA24BAED4963EE407) + two[last])
    return km[edge[first]], content, second, first, span


def _collapse(key, check, also, doc, twin, start, span) -> pa.RecordBatch:
    """First occurrence of each (key, check, also) as undecided; the others decided, under a spread key."""
    order = np.lexsort((start, twin, doc, also, check, key))
    new = np.zeros(len(order), bool)
    new[0] = True
    for x in (key, check, also):
        x = x[order]
        new[1:] |= x[1:] != x[:-1]
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    again = (doc[order] != doc[first]) | (twin[order] != twin[first]) | (start[order] != start[first])
    use = new | again  # a repeated row meets itself at the same place: that is one occurrence
    order, again = order[use], again[use]
    del new, first, use
    doc, twin, start = doc[order], twin[order], start[order]
    spread = mix64(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + twin.astype(np.uint64) + start.astype(np.uint64))
    key = np.where(again, spread, key[order])
    return pa.RecordBatch.from_arrays(
        [pa.array(as_long(key)), pa.array(as_long(check[order])), pa.array(as_long(also[order])), pa.array(doc), pa.array(twin),
         pa.array(start.astype(np.int64)), pa.array(span[order].astype(np.int32)), pa.array(again)],
        names=["key", "check", "also", "doc", "twin", "start", "span", "decided"])


def _gathered(parts):
    """Collapse what a task makes every FLUSH_ROWS rows. parts: tuples (doc, twin, key, check, also, start,
    span), the first two numbers and the rest arrays; held narrow, the numbers spread at the end."""
    def flush():
        doc, twin, *cols = zip(*held, strict=True)
        held.clear()
        n = [len(x) for x in cols[0]]
        key, check, also, start, span = map(np.concatenate, cols)
        del cols
        return _collapse(key, check, also, np.repeat(np.array(doc, np.int64), n), np.repeat(np.array(twin, np.int64), n), start, span)

    held, rows = [], 0
    for doc, twin, key, check, also, start, span in parts:
        held.append((doc, twin, key, check, also, start.astype(np.int32), span.astype(np.int8)))
        rows += len(key)
        if rows >= FLUSH_ROWS:
            yield flush()
            rows = 0
    if rows:
        yield flush()


def _paths(batches):
    seen = WordHashes()

    def parts():
        for b in batches:
            for doc, twin, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words = text.encode().split()
                if len(words) >= WINDOW:
                    yield doc, twin, *_segments(seen.array(words))

    yield from _gathered(parts())


def _windows(batches):
    """Every window of the listed segments: (doc, twin, one window hash, the other, nothing more, start, 1)."""
    seen = WordHashes()

    def parts():
        for b in batches:
            for doc, twin, text, spans in zip(*(b.column(c).to_pylist() for c in ("doc", "twin", "_text", "_spans")), strict=True):
                words = seen.array(text.encode().split())
                _, one, two = _hashes(words)
                at = np.concatenate([np.arange(s["start"], s["start"] + s["span"]) for s in spans])
                yield doc, twin, one[at], two[at], np.zeros(len(at), np.uint64), at, np.ones(len(at), np.int8)

    yield from _gathered(parts())


def _judged(rows: DataFrame) -> DataFrame:
    """Brings equal keys together and marks what is not the first occurrence of its content."""
    same = Window.partitionBy("key", "check", "also").orderBy("doc", "twin", "start")
    return (rows.repartition("key")
            .withColumn("later", F.col("decided") | (F.rank().over(same) > 1)))


def _spans(texts: DataFrame, moved: DataFrame) -> DataFrame:
    """(doc, twin, start, words): word spans covered by a window whose sequence also starts earlier. Spans
    of a document may touch or overlap. texts: (doc, twin, _text); moved: rows with all three, dealt by
    doc and twin."""
    edge = Window.partitionBy("key")
    paths = (_judged(texts.mapInArrow(_paths, _SEGMENT))
             .withColumn("branches", (F.min("check").over(edge) != F.max("check").over(edge))
                         | (F.min("also").over(edge) != F.max("also").over(edge)))
             .where("later or branches").select("doc", "twin", "start", "span", "later"))
    paths = cut(paths)
    whole = paths.where("later").select("doc", "twin", "start", (F.col("span") + (WINDOW - 1)).alias("words"))
    open_ = paths.where("not later").groupBy("doc", "twin").agg(F.collect_list(F.struct("start", "span")).alias("_spans"))
    single = (_judged(moved.join(open_, ["doc", "twin"]).mapInArrow(_windows, _SEGMENT))
              .where("later").select("doc", "twin", "start", F.lit(WINDOW).alias("words")))
    return whole.unionByName(single)


def _strip(batches):
    for b in batches:
        n_words, n_removed, sha, kept = [], [], [], []
        for text, spans in zip(b.column("_text").to_pylist(), b.column("_spans").to_pylist(), strict=True):
            words = (text or "").encode().split()
            left = words
            if spans:
                drop = np.zeros(len(words) + 1, np.int32)
                at = np.array([(s["start"], s["words"]) for s in spans], np.int64)
                np.add.at(drop, at[:, 0], 1)
                np.add.at(drop, at[:, 0] + at[:, 1], -1)
                gone = np.cumsum(drop[:-1]) > 0
                left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            joined = b" ".join(left)
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            sha.append(hashlib.sha256(joined).hexdigest())
            kept.append(joined.decode() if len(left) < len(words) else text)
        out = [b.column(i) for i in range(b.num_columns - 2)]
        names = b.schema.names[:-2]
        yield pa.RecordBatch.from_arrays(
            [*out, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()),
             pa.array(kept, pa.string())], names=[*names, "n_words", "n_removed", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with n_words, n_removed, kept_sha256 (of the kept words joined by one
    space) and kept_text (the text itself where nothing went, else the kept words joined by one
    space); ``keep`` names the columns carried along (default: the id).

    Null and empty texts have no words. Texts under 20 words lose nothing. Rows with a null id take
    no part and lose nothing. A document is an id with a text (told by its 64-bit hash): rows that repeat
    both are one document and lose the same words; different texts of one id are documents of their own,
    ordered by that hash. Other columns, whatever their names, play no role.
    """
    text_batches(docs.sparkSession)
    keep = keep or [doc_id]
    names = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("twin"), F.col(text).alias("_text"),
                       *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    known = rows.where("doc is not null")
    moved = known.repartition("doc", "twin")  # one exchange of the texts serves the windows and the result
    spans = (_spans(known.where("_text is not null").select("doc", "twin", "_text"), moved).groupBy("doc", "twin")
             .agg(F.collect_list(F.struct("start", "words")).alias("_spans")))
    joined = moved.join(spans, ["doc", "twin"], "left")
    nothing = F.lit(None).cast(joined.schema["_spans"].dataType)
    joined = joined.unionByName(rows.where("doc is null").withColumn("_spans", nothing)).select(*names, "_text", "_spans")
    types = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
    schema = ", ".join([f"{n} {types[n]}" for n in names]
                       + ["n_words long", "n_removed long", "kept_sha256 string", "kept_text string"])
    out = joined.mapInArrow(_strip, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)],
                      "n_words", "n_removed", "kept_sha256", "kept_text")
