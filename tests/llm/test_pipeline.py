"""The corpus pipeline, stage by stage against brute force on each stage's own input."""

import hashlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_operators import MID, ODD, PATH, brute_classes, brute_repeats, table
from tickspark.llm import common, entropy_mix, zstd_quality
from tickspark.llm.common import stored


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{MID}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(stored(stage(spark, docs[-1], MID)))
    return docs


def as_dict(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "mix", "bpe"]
    assert all(d.columns == corpus_pipeline.COLUMNS for d in steps[:5])
    assert corpus_pipeline.ORACLE_SQL is None and entry.queries()["pipeline"] is corpus_pipeline.run


def test_quality_keeps_what_it_predicts_good(spark, steps):
    model = zstd_quality.fit(steps[0], spark.read.parquet(f"{MID}/labels.parquet"))
    assert as_dict(steps[1]) == {r.doc_id: r.text for r in steps[0].collect() if model.score(r.text.encode()) >= 0.3}
    good = {r.doc_id for r in spark.read.parquet(f"{MID}/labels.parquet").where("quality = 1").collect()}
    assert len(good & as_dict(steps[1]).keys()) >= 0.99 * len(good & as_dict(steps[0]).keys())


def test_near_dedup_keeps_one_of_each_class(steps):
    before = as_dict(steps[1])
    classes, _ = brute_classes(before)
    assert as_dict(steps[2]) == {i: before[i] for i, c in classes.items() if i == c}


def test_passages(steps):
    before, after = as_dict(steps[2]), as_dict(steps[3])
    want = brute_repeats(before)
    assert after.keys() == before.keys()
    for i, (_, gone, sha) in want.items():
        assert (after[i] == before[i]) if not gone else hashlib.sha256(after[i].encode()).hexdigest() == sha
    assert all(r.n_chars == len(r.text) for r in steps[3].collect() if want[r.doc_id][1])


def test_mix_repeats_rows(steps):
    copies = {r.doc_id: r.copies for r in entropy_mix.mix(steps[3]).collect()}
    got = {r.doc_id: r["count"] for r in steps[4].groupBy("doc_id").count().collect()}
    assert got == {i: c for i, c in copies.items() if c}


def test_tokens(steps):
    tok, texts = Tokenizer.from_file(PATH), as_dict(steps[4])
    assert steps[5].count() == steps[4].count()
    for r in steps[5].collect():
        assert r.ids == tok.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_odd_rows_pass_every_stage(spark):
    for docs in (table(spark, ODD), table(spark, []).limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, MID))
        docs.count()


def test_texts_that_share_an_id_are_compared_and_kept_by_row(spark):
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(60)) for w in "abcd")
    # 2 has a copy of 1 and a text of its own; 3 has two texts of its own, one of them twice; 4 has the same text twice
    docs = [(1, a), (2, a), (2, b), (3, c), (3, c), (3, d), (4, a + " x y"), (4, a + " x y"), (None, a)]
    got = corpus_pipeline.near_dedup(spark, table(spark, docs), MID).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, a), (2, b), (3, c), (3, d), (None, a)], key=str)


def test_mix_takes_each_row_its_own_copies(spark):
    docs = [(None, f"{s} " + "w " * 9, s) for s in ("s0", "s1", "s2") for _ in range(1 if s == "s0" else 12)]
    docs += [(7, f"{k} " + "v " * 9, "s0") for k in range(2)]
    rows = corpus_pipeline.mix(spark, table(spark, docs), MID).collect()
    want = {r.source: r.n for r in entropy_mix.mix(table(spark, docs), keep=["source"]).groupBy("source")
            .agg({"copies": "sum"}).withColumnRenamed("sum(copies)", "n").collect()}
    assert {s: sum(r.source == s for r in rows) for s in want} == want
    assert sum(r.source == "s0" and r.doc_id is None for r in rows) <= 3


@pytest.mark.parametrize("stage", [corpus_pipeline.near_dedup, corpus_pipeline.mix])
def test_texts_stay_where_they_are_when_rows_are_picked(spark, stage):
    docs = table(spark, [(k, " ".join(f"{w}{k}" for w in "abcdefgh"), f"s{k % 3}") for k in range(300)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of many rows
    try:
        picked = stage(spark, docs, MID)
        assert picked.count()
        assert "hashpartitioning" not in picked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("most", [common.BROADCAST_BYTES, 0])
def test_flags_meet_their_rows(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_BYTES", most)
    # partitions of more keys than a bitmap has bits, and rows without a flag
    rows = stored(spark.range(0, 150_000, 1, 3).withColumn("_key", F.monotonically_increasing_id()))
    flags = rows.where("id % 11 > 0").select("_key", (F.col("id") % 3 == 0).alias("a"), (F.col("id") % 7 == 0).alias("b"))
    got = common.flagged(rows, "_key", flags, ["a", "b"])
    assert got.columns == ["id", "_key", "a", "b"] and got.count() == 150_000
    assert not got.where("a <> (id % 11 > 0 and id % 3 = 0) or b <> (id % 11 > 0 and id % 7 = 0)").count()
    assert not common.flagged(rows, "_key", flags.limit(0), ["a"]).where("a").count()
