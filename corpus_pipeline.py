"""The corpus pipeline: quality, near-duplicates, repeated passages, source mix, token ids.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the
columns of ``documents`` (the last one token ids). What a stage keeps for itself goes when the next one
starts, so a result is to be written before another stage is called on anything else. ``run`` writes each stage's rows as Parquet into
the shared folder and reads them again for the next.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.llm import bagminhash, entropy_mix, substring_dedup, word_bpe, zstd_quality
from tickspark.llm.common import flagged, read, recorded, release, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "word_bpe_49k.json"


def keyed(docs: DataFrame) -> DataFrame:
    """A stage's rows with a number of their own each, written once: every later read finds the same one."""
    return stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_key")))


#: Side tables and results of earlier stages that still lie in the shared folder.
_left: list[str] = []


def frees(stage):
    """The stage, after deleting what earlier stages left behind and ``docs`` does not read."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _left, docs)
        with recorded(_left):
            return stage(spark, docs, sf_dir)
    return run_stage


@frees
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts, learnt from the labels of documents still here."""
    model = zstd_quality.fit(docs, read(spark, sf_dir, "labels"))
    return zstd_quality.score(docs, model, keep=COLUMNS).where("predicted = 1").select(COLUMNS)


@frees
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest id of each near-duplicate class (of equal ids, that of smallest text hash); rows
    without an id stay. Rows are compared one by one, so texts that share an id may both stay; rows equal
    in id and text are in one class and give one row."""
    rows = keyed(docs)
    known = rows.where("doc_id is not null")
    classes = bagminhash.near_duplicates(known, doc_id="_key").select(F.col("doc_id").alias("_key"), "class_id")
    heads = (known.select("_key", "doc_id", F.xxhash64("text").alias("_hash")).join(classes, "_key")
             .groupBy("class_id").agg(F.min(F.struct("doc_id", "_hash", "_key")).alias("_first")).select("_first._key"))
    return flagged(rows, "_key", heads.withColumn("_kept", F.lit(True)), ["_kept"]).where("_kept or doc_id is null").select(COLUMNS)


@frees
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that start earlier elsewhere: the kept words joined by one space where
    any went, the text unchanged elsewhere; n_chars follows. Documents left without a word stay, empty."""
    out = substring_dedup.remove_repeats(docs, keep=["doc_id", "lang", "source", "n_chars"])
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source",
                      F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


@frees
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it (0 to 3); documents without words do not count and
    stay out."""
    rows = keyed(docs)
    copies = [f"_copy{c}" for c in range(1, entropy_mix.MAX_COPIES + 1)]
    taken = entropy_mix.mix(rows, keep=["_key"]).select("_key", *[(F.col("copies") >= c).alias(n) for c, n in enumerate(copies, 1)])
    rows = flagged(rows, "_key", taken, copies)
    return rows.withColumn("_copy", F.explode(F.array_compact(F.array(*[F.when(F.col(n), 1) for n in copies])))).select(COLUMNS)


@frees
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the token ids of each row."""
    return word_bpe.encode(docs, public_tokenizers.path(TOKENIZER), keep=["doc_id", "source"]).select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", passages), ("mix", mix), ("bpe", tokens)]
#: Hash draws, trained models and subword merges have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            with recorded(_left):
                docs = stored(docs)
    return docs
