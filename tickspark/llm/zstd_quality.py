"""Quality by compression: how much better a text packs with a dictionary of good text than with one
of bad text, calibrated to a probability.

Two zstandard dictionaries are trained on a bounded sample of labelled texts, one a class. A text is
packed whole, in blocks, with each of them; the score's only input is the difference of the packed
sizes over the text's size. The calibration is a logistic curve fitted on other labelled texts of
the same bounded sample.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import cut, text_batches

#: Labelled texts that a class gives to its dictionary, and as many again to the calibration: those
#: with the smallest hashes of their ids.
SAMPLE_TEXTS = 600
#: Bytes of one text that a fit reads: texts above it stand in the sample by evenly spread blocks.
SAMPLE_BYTES = 32_768
#: Texts are packed in blocks, so that a long text leans on the dictionary as a short one does.
BLOCK = 512
DICT_BYTES = 48 * 1024
LEVEL = 3
#: Short texts lean towards the mean difference of the fitted texts as if they held so many more bytes.
PRIOR_BYTES = 64
CUT = 0.3


class CompressionModel:
    """Two dictionaries and a logistic curve; plain bytes and floats, so it pickles."""

    def __init__(self, good: bytes, bad: bytes, slope: float = 0.0, offset: float = 0.0, mean: float = 0.0):
        self.good, self.bad, self.slope, self.offset, self.mean = good, bad, slope, offset, mean
        self._packers = None

    def __reduce__(self):
        return CompressionModel, (self.good, self.bad, self.slope, self.offset, self.mean)

    def _packs(self):
        if self._packers is None:
            def packer(raw):
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO) if raw else None
                if d is not None:
                    d.precompute_compress(level=LEVEL)
                return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False,
                                                write_dict_id=False, **({} if d else {"level": LEVEL}))
            self._packers = packer(self.good), packer(self.bad)
        return self._packers

    def saved(self, raw: bytes) -> int:
        """Bytes that the good dictionary saves against the bad one."""
        good, bad = self._packs()
        blocks = [raw[i:i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return sum(len(bad.compress(b)) for b in blocks) - sum(len(good.compress(b)) for b in blocks)

    def difference(self, raw: bytes) -> float:
        """Bytes saved over the text's size, drawn to the mean for short texts (the mean for an empty one)."""
        return (self.saved(raw) + PRIOR_BYTES * self.mean) / (len(raw) + PRIOR_BYTES)

    def score(self, raw: bytes) -> float:
        z = self.slope * self.difference(raw) + self.offset
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _blocks(raw: bytes) -> list[bytes]:
    parts = [raw[i:i + BLOCK] for i in range(0, len(raw), BLOCK)]
    most = SAMPLE_BYTES // BLOCK
    return parts if len(parts) <= most else [parts[i * len(parts) // most] for i in range(most)]


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the texts' own end where there is too little to train on."""
    blocks = [b for t in texts for b in _blocks(t)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICT_BYTES:]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a slightly damped logistic fit, by Newton steps."""
    scale = float(np.std(x)) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -40, 40)))
        grad = a.T @ (weight * (y - p)) - 1e-3 * beta
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> CompressionModel:
    """Learns from at most 2 * SAMPLE_TEXTS labelled texts a class whose id is not held out. Null or
    contradicting labels, null ids and empty texts are passed over. Without both classes every text
    scores the share of label 1 (one half without labels). The bound counts labels whose text is here, so labels
    of other tables do not use it up; the driver gets at most SAMPLE_BYTES of a text."""
    marks = (labels.select(F.col(doc_id).alias("id"), F.col(label).alias("y")).where("id is not null and y in (0, 1)")
             .groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("_y")).where("y = _y").drop("_y")
             .where(~held_out(F.col("id"))))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).where(F.length("t") > 0)
    share = marks.groupBy("y").count().collect()  # two rows
    n = {r.y: r["count"] for r in share}
    prior = n.get(1, 0) / max(1, sum(n.values())) if n else 0.5
    known = cut(marks.join(texts.select("id"), "id", "left_semi"))
    raw = F.encode(F.col("t"), "UTF-8")
    n_blocks, most = F.ceil(F.octet_length("t") / BLOCK), SAMPLE_BYTES // BLOCK
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.substr(
        raw, (F.floor(i * n_blocks / most) * BLOCK + 1).cast("int"), F.lit(BLOCK)))
    rows = []
    for y in (0, 1):
        ids = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(4 * SAMPLE_TEXTS).select("id")
        got = (texts.join(F.broadcast(ids), "id").orderBy(F.xxhash64("id"), "id").limit(2 * SAMPLE_TEXTS)
               .select(F.when(n_blocks > most, spread).otherwise(F.array(raw)).alias("t")).collect())
        rows.append([b"".join(map(bytes, r.t)) for r in got])
    bad, good = rows
    if min(len(good), len(bad)) < 2:
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return CompressionModel(b"", b"", 0.0, math.log(p / (1 - p)))
    model = CompressionModel(_dictionary(good[::2]), _dictionary(bad[::2]))
    held = [b"".join(_blocks(t)) for t in good[1::2] + bad[1::2]]
    k = len(good[1::2])
    rates = np.array([model.saved(t) / len(t) for t in held])
    model.mean = float(prior * rates[:k].mean() + (1 - prior) * rates[k:].mean())
    x = [model.difference(t) for t in held]
    y = np.array([1.0] * k + [0.0] * len(bad[1::2]))
    # classes weigh as in the labels, so that the score is a probability there
    weight = np.where(y == 1, prior / max(1, k), (1 - prior) / max(1, len(y) - k)) * len(y)
    return CompressionModel(model.good, model.bad, *logistic(np.array(x), y, weight), model.mean)


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def score(docs: DataFrame, model: CompressionModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row's ``keep`` columns (default: all) with score (0 to 1, higher: better) and predicted
    (1 from CUT on). Null texts count as empty; empty ones get the curve's value at the mean."""
    spark = docs.sparkSession
    text_batches(spark)
    keep = docs.columns if keep is None else keep
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"))
    shared = spark.sparkContext.broadcast(model.__reduce__()[1])

    def run(batches):
        own = CompressionModel(*shared.value)
        for b in batches:
            s = [own.score((t or "").encode()) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(s, pa.float64())],
                                             names=[*b.schema.names[:-1], "score"])

    types = [rows.schema[i].dataType.simpleString() for i in range(len(keep))]
    schema = ", ".join([f"c{i} {t}" for i, t in enumerate(types)] + ["score double"])
    return (rows.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "score")
            .withColumn("predicted", (F.col("score") >= CUT).cast("int")))
