"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.llm import (bagminhash, entropy_mix, license_scan, order_minhash, periodic_runs, rp_forest, shard_shuffle,
                           substring_dedup, training_order, variants, warc, word_bpe, zstd_quality)
from tickspark.llm.common import RAW_WORDS, read
from tickspark.session import ensure_checkpoint_dir

WORD_BPE = "word_bpe_49k.json"


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.neighbours(read(spark, sf_dir, "embeddings"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix.mix(read(spark, sf_dir, "documents"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return (shard_shuffle.shuffle_into_shards(rows, ["doc_id", "size", "text_crc32"])
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = zstd_quality.fit(docs, read(spark, sf_dir, "labels"))
    return (zstd_quality.score(docs, model, keep=["doc_id"])
            .select("doc_id", F.coalesce(zstd_quality.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
                    "score", "predicted"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(read(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "n_removed", "kept_sha256"))


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    return training_order.write_shards(
        training_order.training_order(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE)), folder)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents")).drop("places")


def op10_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = word_bpe.encode(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), keep=["doc_id"])
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.folder(spark)
    warc.write_archives(read(spark, sf_dir, "pages"), path)
    back = warc.read_records(spark, path)
    return back.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.when(F.col("record_type") == "revisit", warc.page_of("refers_to")).alias("refers_to"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with the repetition that the op12 query asks for in the tenth of texts whose id's crc32 ends in 0
    (rows without an id have none)."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.withColumn("_g", F.when(h % 10 == 0, F.floor(h / 10)))
    rows = rows.withColumn("_w", F.when(F.col("_g").isNotNull(), F.regexp_extract_all("text", F.lit(RAW_WORDS), F.lit(0))))
    n = F.nullif(F.size("_w"), F.lit(0))
    rows = rows.withColumn("_a", (F.col("_g") % n).cast("int"))
    rows = rows.withColumn("_p", (F.lit(1) + F.floor((n - F.col("_a")) / (F.lit(3) + F.col("_g") % 8))).cast("int"))
    planted = F.array_join(F.concat(F.slice("_w", 1, F.col("_a")), F.transform(
        F.sequence(F.lit(0), n - F.col("_a") - 1), lambda i: F.get("_w", F.col("_a") + i % F.col("_p")))), " ")
    return rows.withColumn("text", F.when(F.col("_a").isNotNull(), planted).otherwise(F.col("text"))).drop("_g", "_w", "_a", "_p")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_runs(read(spark, sf_dir, "documents")))
    best = periodic_runs.longest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                                            r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.floor(F.lit(1000) * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = variants.runs(read(spark, sf_dir, "documents"))
    words = variants.word_counts(runs.select(variants.misspelt(runs).alias("word")))
    return variants.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def queries() -> dict:
    return {f.__name__: f for f in (op1_near_duplicates, op2_nearest_vectors, op3_mix_sources, op4_shards, op5_quality,
                                    op6_fingerprints, op7_substring_dedup, op8_training_order, op9_licenses, op10_word_bpe,
                                    op11_warc, op12_periodic_runs, op13_variants)}


OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, s, list_slice(ws, s, s + 19) AS seq
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY md5(array_to_string(seq, ' '))
          ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n
         FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


OP11_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS digest FROM pages),
best AS (SELECT *, max(page_id) OVER (PARTITION BY size, digest) AS answer FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN size >= 1000 AND page_id < answer THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 1000 AND page_id < answer THEN answer END AS refers_to
FROM best
"""

# crc32 over the UTF-8 bytes (two hex digits each), by the table of its polynomial; near words share what is left after a
# letter is taken out: at the same place of both (replaced), or of one only, which then equals the other
OP13_SQL = r"""
WITH RECURSIVE poly AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY ALL),
bytes AS (SELECT run, n, hex(encode(doc_id || ':' || run)) AS x FROM runs),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2),
    lambda i: ((instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)::BIGINT)),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS h FROM bytes, poly),
spelt AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
    FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS k
    FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
longer AS (SELECT DISTINCT cuts.word AS a, words.word AS b FROM cuts JOIN words ON cuts.k = words.word),
near AS (SELECT a, b FROM longer UNION SELECT b, a FROM longer
    UNION SELECT x.word, y.word FROM cuts x JOIN cuts y ON x.i = y.i AND x.k = y.k AND x.word <> y.word),
ranked AS (SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r, count(*) OVER (PARTITION BY a) AS n_near
    FROM near JOIN words ON words.word = near.b),
formed AS (SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN ranked.n >= 10 * words.n THEN b END AS form,
    CASE WHEN ranked.n >= 10 * words.n THEN ranked.n END AS form_n FROM words LEFT JOIN ranked ON a = word AND r = 1),
walk AS (SELECT word, form, word AS at FROM formed
    UNION ALL SELECT walk.word, f.form, f.word FROM walk JOIN formed f ON f.word = walk.form)
SELECT formed.word, formed.form, walk.at AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n
FROM formed JOIN walk ON walk.word = formed.word AND walk.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_substring_dedup": OP7_SQL, "op11_warc": OP11_SQL, "op13_variants": OP13_SQL}
