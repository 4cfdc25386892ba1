"""The training-data operators against brute force, exact round trips or held-out accuracy."""

import binascii
import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickspark.llm import (bagminhash, common, components, entropy_mix, license_scan, order_minhash, queries, rp_forest,
                           shard_shuffle, substring_dedup, training_order, word_bpe, zstd_quality)
from tickspark.llm.common import WordHashes

SF = "/root/testdata/sf0.001"
MID = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "text").collect()}


def table(spark, pairs):
    """documents with odd columns beside the usual ones, whose names clash with the operators' own."""
    rows = [(i, t, "en", s, len(t) if t is not None else None, 1, "x", 0.5, i)
            for i, t, s in [(*p, "src0")[:3] for p in pairs]]
    return spark.createDataFrame(rows, DOCS + ", doc int, key string, rate double, slot long")


ODD = [(1, None, None), (2, "", "b"), (3, "a", "b"), (4, "a b c d", "b"), (5, "w " * 30, "b"), (5, "w " * 30, "b"),
       (None, "x y z " * 12, "c"), (7, " \t\n", None), (8, "é́ Σ ΑΣ <|endoftext|>'s İ ß \x85 \x1c", ""), (9, "z" * 40000, "c"),
       (10, "one two three four five " * 3000, "c")]


# 1 ---------------------------------------------------------------------------------------------

def bag(text):
    words = re.findall("[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute_classes(texts):
    bags = {i: bag(t) for i, t in texts.items()}
    where = defaultdict(set)
    for i, b in bags.items():
        for s in b or [()]:
            where[s].add(i)
    root = {i: i for i in bags}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = set()
    for i, b in bags.items():
        for j in set().union(*(where[s] for s in b or [()])):
            if i < j:
                both, all_ = sum((b & bags[j]).values()), sum((b | bags[j]).values())
                if not all_ or both / all_ >= 0.8:
                    links.add((i, j))
                    a, c = sorted((find(i), find(j)))
                    root[c] = a
    return {i: find(i) for i in bags}, links


def test_near_duplicate_classes_equal_brute_force(spark, texts):
    got = {r.doc_id: r.class_id for r in queries.op1_near_duplicates(spark, MID).collect()}
    want, _ = brute_classes(texts)
    assert got == want
    assert len(set(got.values())) < len(got)


def test_a_chain_of_edits_is_one_class(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 400)]
    chain = []
    for i in range(60):  # one more word changes each time: neighbours are near, the ends are not
        words[int(rng.integers(0, 400))] = f"n{i}"
        chain.append((i, " ".join(words)))
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(table(spark, chain)).collect()}
    want, _ = brute_classes(dict(chain))
    assert got == want == {i: 0 for i in range(60)}


def test_signature_agreement_estimates_weighted_jaccard():
    rng = np.random.default_rng(5)
    got, want = [], []
    for _ in range(12):
        items = rng.integers(0, 2**63, 60).astype(np.uint64)
        items.sort()
        a, b = rng.integers(1, 40, 60), rng.integers(1, 40, 60)
        b[rng.random(60) < 0.5] = a[0]
        sig = bagminhash.signatures([(items, a), (items, b)])
        got.append((sig[0] == sig[1]).mean())
        want.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(np.array(got) - want)) < 0.03
    assert np.isfinite(sig).all() and np.abs(np.array(got) - want).max() < 0.16


def test_near_duplicates_odd_rows(spark):
    got = {r.doc_id: r for r in bagminhash.near_duplicates(table(spark, ODD)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 7, 8, 9, 10}
    assert got[2].class_id == got[7].class_id == got[1].class_id == 1
    assert bagminhash.near_duplicates(table(spark, []).limit(0)).count() == 0


def test_texts_that_share_an_id_are_compared_each_for_itself(spark):
    a, b, near = (" ".join(f"{w}{i}" for i in range(200)) for w in "abc")
    near = a.replace("a77 ", "zz ")
    docs = [(1, a), (1, b), (2, b), (3, a), (3, a), (4, near), (4, "other words of its own"), (4, "other words of its own")]
    rows = bagminhash.near_duplicates(table(spark, docs)).collect()
    classes = defaultdict(list)
    for r in rows:
        classes[r.class_id].append(r.doc_id)
    # the texts a and b both begin at id 1, but 2 and 3 share no word and are not one class through it
    assert sorted(map(sorted, classes.values())) == [[1, 2], [1, 3, 4], [4]] and {1, 4} < classes.keys()
    assert sorted((r.doc_id, r.copy_of) for r in rows) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4)]


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 103), (103, 101)] + [(200, 200 + i) for i in range(1, 40)]
    got = {r.id: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(51)} == {0} and {got[i] for i in (100, 101, 103)} == {100}
    assert all(got[200 + i] == 200 for i in range(40))


# 2 ---------------------------------------------------------------------------------------------

def test_nearest_vectors_recall_and_order(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, e = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)
    unit = e / np.linalg.norm(e, axis=1, keepdims=True)
    got = queries.op2_nearest_vectors(spark, sf).toPandas()
    hit = 0
    for q in ids[ids % 50 == 0]:
        s = unit @ unit[ids == q][0]
        s[ids == q] = -9
        want = ids[np.argsort(-s, kind="stable")[:5]]
        own = got[got.query_id == q].sort_values("rank")
        assert list(own["rank"]) == [1, 2, 3, 4, 5]
        assert np.allclose(own.score, s[np.searchsorted(ids, own.vec_id)], atol=1e-12)
        hit += len(set(want) & set(own.vec_id))
    assert hit / len(got) >= 0.9


def test_nearest_vectors_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 0.0], 1), (3, None, 1), (4, [1.0, None], 1),
            (5, [float("nan"), 1.0], 1), (6, [1.0, 1.0], 1), (100, [float("inf"), 1.0], 1), (None, [1.0, 0.5], 1), (7, [], 1),
            *((i, [1.0, 0.0], 1) for i in range(8, 30))]
    got = rp_forest.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")).toPandas()
    assert {q: list(g.sort_values("rank").vec_id) for q, g in got.groupby("query_id")} == {0: [1, 8, 9, 10, 11], 50: [0, 1, 8, 9, 10]}
    two = rp_forest.neighbours(spark.createDataFrame(rows[:2], "vec_id long, embedding array<float>, rank int")).toPandas()
    assert sorted(zip(two.query_id, two.vec_id)) == [(0, 50), (50, 0)]
    assert rp_forest.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# 3 ---------------------------------------------------------------------------------------------

def water_fill(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total >= 3 * sizes[s]]
        if not over:
            out.update({s: left * weight[s] / total for s in free})
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def test_mix_meets_targets(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    rows = entropy_mix.mix(docs).join(docs.select("doc_id", "source", "text"), "doc_id").toPandas()
    assert (rows["size"] == [len(re.findall("[^\x20\x09-\x0D]+", t)) for t in rows.text]).all()
    sizes = rows.groupby("source")["size"].sum().to_dict()
    want = water_fill(sizes)
    assert np.allclose(rows.target, rows.source.map(want)) and (rows.source_size == rows.source.map(sizes)).all()
    assert (rows.taken <= 3 * rows["size"]).all() and (rows.taken == rows.copies * rows["size"]).all()
    for s, g in rows.groupby("source"):
        assert abs(g.taken.sum() - want[s]) <= 0.01 * want[s], s
        assert abs((g.rate * g["size"]).sum() - want[s]) <= 1e-4 * want[s], s
    again = entropy_mix.mix(docs).toPandas()
    assert again.sort_values("doc_id").copies.tolist() == rows.sort_values("doc_id").copies.tolist()


def test_mix_fills_what_one_long_document_leaves(spark):
    """A document that does not fit at the threshold leaves a gap for many small ones, more than CLOSING."""
    docs = [(i, "w " * 5, f"s{i % 3}") for i in range(9000)] + [(10**6 + i, "w " * 40_000, f"s{i}") for i in range(3)]
    rows = entropy_mix.mix(table(spark, docs), keep=["source"]).toPandas()
    for s, g in rows.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 5, s
    assert rows.copies.between(0, 3).all()


def test_mix_odd_rows(spark):
    rows = entropy_mix.mix(table(spark, ODD)).toPandas()
    assert len(rows) == len(ODD) and (rows.taken <= 3 * rows["size"]).all()
    assert entropy_mix.mix(table(spark, ODD[:2])).toPandas().taken.tolist() == [0, 0]
    assert entropy_mix.mix(table(spark, []).limit(0)).count() == 0


# 4 ---------------------------------------------------------------------------------------------

def test_shards_are_exact_and_gapless(spark):
    rows = queries.op4_shards(spark, MID).toPandas()
    sizes = rows.groupby("shard").size()
    assert len(rows) == 1000 and sizes.max() - sizes.min() <= 1 and list(sizes.index) == list(range(8))
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    again = queries.op4_shards(spark, MID).toPandas()
    assert rows.sort_values("doc_id").slot.tolist() == again.sort_values("doc_id").slot.tolist()


def test_hypergeometric_law():
    rng = np.random.default_rng(1)
    draws = np.array([shard_shuffle.hypergeometric(rng, 30, 50, 20) for _ in range(20000)])
    assert abs(draws.mean() - 7.5) < 0.05 and abs(draws.var() - 20 * 30 / 80 * 50 / 80 * 60 / 79) < 0.1
    big = shard_shuffle.hypergeometric(rng, 10**12, 7 * 10**12, 10**6)
    assert abs(big - 125_000) < 3000
    lines = np.array(shard_shuffle.matrix([5, 0, 17, 3], 8, 1))
    assert lines.sum(axis=1).tolist() == [5, 0, 17, 3] and sorted(lines.sum(axis=0)) == [3] * 7 + [4]


def test_shards_odd_rows(spark):
    for n in (0, 1, 3):
        rows = shard_shuffle.shuffle_into_shards(table(spark, ODD[:n]).limit(n).select("doc_id", "text"), ["doc_id"])
        assert rows.count() == n and {"shard", "slot"} <= set(rows.columns)
    same = spark.createDataFrame([(1,)] * 40, "doc_id long")
    got = shard_shuffle.shuffle_into_shards(same, ["doc_id"]).toPandas()
    assert got.groupby("shard").size().tolist() == [5] * 8


def test_shard_files_hold_every_row(spark, tmp_path):
    """Null ids and repeated ids, with equal and with different texts, are all written, at gapless slots."""
    pairs = [*ODD, *[(None, f"null {i}") for i in range(9)], *[(11, f"t{i % 4}") for i in range(20)]]
    docs = table(spark, [(*p, "src0")[:3] for p in pairs]).select("doc_id", "text")
    shard_shuffle.write_shards(shard_shuffle.shuffle_into_shards(docs, ["doc_id", "text"]), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s")).toPandas()
    want = Counter((r.doc_id, r.text) for r in docs.collect())
    assert Counter((None if pd.isna(i) else int(i), t) for i, t in zip(back.doc_id, back.text, strict=True)) == want
    sizes = back.groupby("shard").size()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in back.groupby("shard"))


# 5 ---------------------------------------------------------------------------------------------

def test_quality_on_held_out_rows(spark):
    rows = queries.op5_quality(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    both = rows[rows.held_out].merge(labels, on="doc_id")
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.3) == (rows.predicted == 1)).all()
    good, bad = both[both.quality == 1].score.to_numpy(), both[both.quality == 0].score.to_numpy()
    auc = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    assert auc > 0.97, auc
    assert ((both.predicted == both.quality).mean()) > 0.95
    assert (both[both.quality == 1].predicted == 1).mean() > 0.99


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    docs = table(spark, ODD)
    rows = zstd_quality.score(docs, zstd_quality.fit(docs, labels), keep=["doc_id"]).toPandas()
    assert len(rows) == len(ODD) and rows.score.between(0, 1).all()
    assert zstd_quality.score(docs.limit(0), zstd_quality.fit(docs, labels)).count() == 0


def test_quality_learns_from_the_labels_whose_texts_are_here(spark):
    good, bad = ("a fine sentence about the sea and the hills number %d", "buy now cheap $$$ click click %d !!!")
    texts = [(i, ((good if i % 2 else bad) % i + " ") * 20) for i in range(400)]
    labels = spark.range(200_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    rows = zstd_quality.score(table(spark, texts), zstd_quality.fit(table(spark, texts), labels), keep=["doc_id"]).collect()
    assert all(r.predicted == r.doc_id % 2 for r in rows)


def test_quality_sample_of_long_texts_is_spread_evenly(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(zstd_quality, "_dictionary", lambda texts: seen.extend(texts) or b"")
    whole = ["".join(chr(97 + (i * k) % 26) for i in range(n)) + "é" for k, n in ((3, 33_500), (7, 90_000), (5, 900), (9, 32_768))]
    ids = [i for i in range(1, 40) if binascii.crc32(str(i).encode()) % 5][:8]
    zstd_quality.fit(table(spark, zip(ids, whole * 2, strict=True)),
                     spark.createDataFrame([(i, int(k >= 4)) for k, i in enumerate(ids)], "doc_id long, quality int"))
    want = {b"".join(zstd_quality._blocks(t.encode())) for t in whole}
    assert len(seen) == 4 and set(seen) <= want and all(len(t) <= zstd_quality.SAMPLE_BYTES for t in seen)


# 6 ---------------------------------------------------------------------------------------------

def brute_items(text):
    """Each k-mer's hash with its occurrence number, counted by the k-mers' own letters."""
    k, seen, out = min(order_minhash.K, len(text)), Counter(), []
    for i in range(len(text) - k + 1):
        kmer = text[i:i + k]
        with np.errstate(over="ignore"):
            h = order_minhash.mix64(sum(np.array([ord(c)], np.uint64) * order_minhash._ODD[j] for j, c in enumerate(kmer)))
            out.append((order_minhash.mix64(h + np.uint64(seen[kmer]) * order_minhash._GOLD) if seen[kmer] else h)[0])
        seen[kmer] += 1
    return out


def brute_signature(text):
    """Each label's items by sorting all their points, without bounds."""
    items = brute_items(text) if text else []
    best = [{} for _ in range(order_minhash.M)]
    gold = order_minhash._GOLD
    for i, item in enumerate(items):
        r, t = order_minhash.mix64(np.array([item ^ np.uint64(0xA0761D6478BD642F)])), 0.0
        for _ in range(3000):
            t -= float(np.log(order_minhash.unit(r))[0]) / order_minhash.M
            label = int(order_minhash.mix64(r + gold)[0] % np.uint64(order_minhash.M))
            best[label].setdefault(i, t)
            r = order_minhash.mix64(r ^ np.uint64(0xE7037ED1A0B428DB))
    out = []
    for j, b in enumerate(best):
        pick = sorted(sorted(b, key=b.get)[:order_minhash.L])
        with np.errstate(over="ignore"):
            acc = np.array([j + 1], np.uint64) * gold
            for i in pick:
                acc = order_minhash.mix64(acc + items[i])
        out.append(int(acc[0] >> np.uint64(32)))
    return out


def test_order_minhash_equals_brute_force():
    for text in ("abcdefgh", "abcdefghi", "abababababababababab", "the quick brown fox"):
        assert order_minhash.signature(text).tolist() == brute_signature(text), text


def test_order_minhash_feels_order():
    a = "".join(np.random.default_rng(1).choice(list("abcdefghij"), 600))
    moved = a[300:] + a[:300]
    near = order_minhash.likeness(order_minhash.signature(a), order_minhash.signature(a[:300] + "x" + a[300:]))
    assert near > 0.9 > order_minhash.likeness(order_minhash.signature(a), order_minhash.signature(moved)) + 0.2


def check_fingerprints(rows, pairs):
    order = sorted(pairs, key=lambda p: (p[0] is None, -(p[0] or 0)))
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(pairs)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        t, n = t or "", n or ""
        k = len(t) // 3
        e = t[:len(t) - k] + n[:k]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        sig, esig = order_minhash.signature(t), order_minhash.signature(e)
        assert got[i].fingerprint == order_minhash._hex(sig) and got[i].edited_fingerprint == order_minhash._hex(esig)
        assert got[i].near_edited == order_minhash.likeness(sig, esig)
        assert got[i].near_next == order_minhash.likeness(sig, order_minhash.signature(n))


def test_fingerprints_follow_descending_ids(spark, texts, monkeypatch):
    monkeypatch.setattr(order_minhash, "RANGE_ROWS", 90)
    check_fingerprints(queries.op6_fingerprints(spark, MID).collect(), list(texts.items()))


def test_ranges_part_pairs_in_descending_order():
    rng = np.random.default_rng(3)
    pairs = [(int(k), -int(c)) for k, c in zip(rng.integers(-4, 5, 400), rng.integers(0, 2**32, 400), strict=True)]
    pairs += [(-(1 << 63), -int(c)) for c in rng.integers(0, 2**32, 50)] + [((1 << 63) - 1, 0), (0, 0), (0, 1 - 2**32)]
    for bounds in ([], pairs[:1], pairs[:20] + pairs[400:410], sorted(pairs)[-3:]):
        got = order_minhash.Ranges(bounds).of(*(np.array(x, np.int64) for x in zip(*pairs, strict=True)))
        assert got.tolist() == [sum(b > p for b in set(bounds)) for p in pairs]


def test_many_rows_without_an_id_are_parted_by_hash(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "RANGE_ROWS", 40)
    rows = [(None, f"text number {i} of many") for i in range(1500)] + [(7, "seven")] * 300 + [(3, "")]
    got = order_minhash.fingerprints(table(spark, rows)).collect()
    # descending: the rows of id 7, then 3, then the others by falling hash; equal rows follow each other
    order = [t for _, t in rows[1500:]] + sorted((t for i, t in rows if i is None), key=lambda t: binascii.crc32(t.encode()))
    want = Counter()
    for t, n in zip(order, order[1:] + order[:1], strict=True):
        want[len(t), hashlib.sha256(order_minhash.edited(t, n).encode()).hexdigest(),
             order_minhash.likeness(order_minhash.signature(t), order_minhash.signature(n))] += 1
    assert Counter((r.n_chars, r.edited_sha256, r.near_next) for r in got) == want
    ranges = order_minhash._ranges(
        table(spark, rows).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), (-F.crc32("text")).alias("c")), len(rows))
    assert (ranges.codes >> (order_minhash._HASH_BITS + 1) == 0).sum() > 10  # bounds among the rows without an id


def test_fingerprints_odd_rows(spark):
    odd = [(i, t) for i, t, _ in ODD if i != 5]
    check_fingerprints(order_minhash.fingerprints(table(spark, odd)).collect(), odd)
    check_fingerprints(order_minhash.fingerprints(table(spark, odd[:1])).collect(), odd[:1])
    assert order_minhash.fingerprints(table(spark, ODD)).count() == len(ODD)
    assert order_minhash.fingerprints(table(spark, []).limit(0)).count() == 0


# 7 ---------------------------------------------------------------------------------------------

def brute_repeats(texts):
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        words = re.findall("[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            w = tuple(words[s:s + 20])
            if w in seen:
                gone[s:s + 20] = [True] * 20
            seen.add(w)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[i] = (len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("flush", [500_000, 700])
def test_repeated_passages_equal_brute_force(spark, texts, monkeypatch, flush):
    monkeypatch.setattr(substring_dedup, "FLUSH_ROWS", flush)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op7_substring_dedup(spark, MID).collect()}
    assert got == brute_repeats(texts)
    assert sum(v[1] > 0 for v in got.values()) > 50


def test_repeats_inside_few_words(spark):
    """Few different words: edges branch everywhere and windows overlap themselves."""
    rng = np.random.default_rng(2)
    docs = {i: " ".join(rng.choice(["a", "b"], p=[0.97, 0.03], size=int(n))) for i, n in enumerate(rng.integers(0, 160, 40))}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256)
           for r in substring_dedup.remove_repeats(table(spark, list(docs.items()))).collect()}
    assert got == brute_repeats(docs)


def test_repeats_odd_rows(spark):
    got = substring_dedup.remove_repeats(table(spark, ODD), keep=["doc_id", "doc", "key"]).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert (by[5].n_words, by[5].n_removed) == (30, 29) and by[None].n_removed == 0 and by[1].n_words == 0
    assert substring_dedup.remove_repeats(table(spark, []).limit(0)).count() == 0


def test_segments_are_told_apart_by_either_window_hash(monkeypatch):
    """One window hash that calls all windows equal does not make different segments one."""
    seen = WordHashes()
    runs = [seen.array([b"%d" % i for i in range(k, k + 400)]) for k in (0, 1000)]
    hashes = substring_dedup._hashes
    for blind in (1, 2):
        def half(words, blind=blind):
            return tuple(np.zeros_like(x) if i == blind else x for i, x in enumerate(hashes(words)))
        monkeypatch.setattr(substring_dedup, "_hashes", half)
        keys = [set(zip(content.tolist(), second.tolist())) for _, content, second, _, _ in map(substring_dedup._segments, runs)]
        _, content, second, first, span = substring_dedup._segments(runs[0])
        assert not keys[0] & keys[1] and len(keys[0]) == len(first) and (span <= 16).all()


def test_two_texts_of_one_id_are_two_documents(spark):
    """Spans found in one text of an id are not cut from the other, whatever their lengths."""
    def w(c, n):
        return " ".join(f"{c}{i}" for i in range(n))
    pairs = [(1, w("a", 40)), (2, w("b", 60) + " " + w("a", 40)), (2, w("c", 25)), (2, w("d", 120)), (2, w("d", 120)),
             (3, w("d", 30)), (3, w("e", 30))]
    got = substring_dedup.remove_repeats(table(spark, pairs)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [
        (1, 40, 0), (2, 25, 0), (2, 100, 40), (2, 120, 0), (2, 120, 0), (3, 30, 0), (3, 30, 30)]
    same = F.xxhash64("t")
    ends = {r.t: r.h for r in spark.createDataFrame([(w("f", 30) + " x",), (w("f", 30) + " y z",)], "t string").select("t", same.alias("h")).collect()}
    first, second = sorted(ends, key=ends.get)
    got = {r.kept_text: r.n_removed for r in substring_dedup.remove_repeats(table(spark, [(5, first), (5, second)])).collect()}
    assert got[first] == 0 and sorted(got.values()) == [0, 30]


def test_repeats_match_sql(spark, texts):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = sorted(con.execute(queries.oracle_sql()["op7_substring_dedup"]).fetchall())
    assert sorted(tuple(r) for r in queries.op7_substring_dedup(spark, SF).collect()) == want


# 8 ---------------------------------------------------------------------------------------------

def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(training_order.feistel(np.arange(n), n).tolist()) == list(range(n))
    assert (training_order.feistel(np.arange(1000), 1000, 1) != training_order.feistel(np.arange(1000), 1000, 2)).any()


def test_training_order_round_trip(spark, texts, tmp_path):
    tok = Tokenizer.from_file(PATH)
    docs, folder = spark.read.parquet(f"{MID}/documents.parquet"), str(tmp_path / "s")
    training_order.write_shards(training_order.training_order(docs, PATH, shard_records=100), folder)
    shards = list(training_order.resume(spark, folder, 0, 100))
    back = pd.concat([s.toPandas() for s in shards])
    assert back.slot.tolist() == list(range(len(back))) and len(shards) == -(-len(back) // 100)
    assert (back.shard == back.slot // 100).all() and (back.position == back.slot % 100).all()
    assert all(len(list((tmp_path / "s" / f"shard={k}").glob("*.parquet"))) == 1 for k in range(len(shards)))
    plan = shards[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "PartitionFilters: [isnotnull(shard" in plan
    whole = queries.op8_training_order(spark, MID).toPandas()
    assert sorted(whole.slot) == list(range(len(back)))
    assert sorted(zip(whole.doc_id, whole.part, whole.record)) == sorted(zip(back.doc_id, back.part, back.record))
    for i, g in back.groupby("doc_id"):
        g = g.sort_values("part")
        ids = np.concatenate([np.frombuffer(r, "<u2")[:n] for r, n in zip(g.record, g.n_tokens, strict=True)])
        assert ids.tolist() == [*tok.encode(texts[i], add_special_tokens=False).ids, 49407]
    late = [r.slot for s in training_order.resume(spark, folder, 950, 100) for r in s.collect()]
    assert late == list(range(950, len(back)))


def test_training_order_odd_rows(spark, tmp_path):
    rows = training_order.training_order(table(spark, ODD), PATH).toPandas()
    assert sorted(rows.slot) == list(range(len(rows))) and set(map(len, rows.record)) == {2 * training_order.TOKENS}
    assert training_order.training_order(table(spark, []).limit(0), PATH).count() == 0
    none = training_order.write_shards(training_order.training_order(table(spark, []).limit(0), PATH), str(tmp_path / "none"))
    assert none.count() == 0 and list(training_order.resume(spark, str(tmp_path / "none"))) == []


# 9 ---------------------------------------------------------------------------------------------

def brute_licences(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        for s in range(len(words) - len(p) + 1):
            if words[s:s + len(p)] == p:
                at.append(s)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licences_equal_brute_force(spark, texts):
    rows = queries.op9_licenses(spark, MID).collect()
    assert len(rows) == len(texts) and any(r.n_base for r in rows)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licences(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_licence_expressions():
    def of(e):
        names, value = license_scan.evaluate(license_scan.postfix(e))
        return ",".join(sorted(names)), round(value, 3)
    assert of("MIT") == ("mit", 0.1)
    assert of("GPL-2.0-only OR MIT") == ("gpl,mit", 0.1)
    assert of("(GPL-2.0-or-later WITH Classpath-exception-2.0) AND Apache-2.0 */ end") == ("apache,gpl", 0.4)
    assert of("MIT OR GPL-3.0 AND Apache-2.0") == ("apache,gpl,mit", 0.1)
    assert of("(MIT OR GPL-3.0) AND Apache-2.0") == ("apache,gpl,mit", 0.2)
    assert of("the tag names a licence") == of("see file LICENSE") == of("NONE") == ("", 0.0)
    assert of("MIT or see COPYING") == ("mit", 0.1) and of("GPL-2.0 WITH some exception") == ("gpl", 0.4)
    assert of("LicenseRef-Own-1 OR WTFPL AND EUPL-1.2+") == ("eupl-1.2,licenseref-own-1,wtfpl", 0.7)
    assert of("OR AND") == ("", 0.0) and of("((MIT") == ("mit", 0.1) and of("MIT AND") == ("mit", 0.1)
    found = license_scan.automaton()
    text = "Mit  LICENSE.mit license\n// SPDX-License-Identifier: LGPL-2.1+ OR BSD-3-Clause\ncc-by cc by 4.0 é"
    n, base, first, last, labels, every, score, places = license_scan.scan(text, found)
    assert (n, base, first, last, labels) == brute_licences(text)
    assert every == "bsd,cc-by,lgpl,mit" and score == 0.2 and len(places) == 5


def test_licences_odd_rows(spark):
    rows = license_scan.scan_licenses(table(spark, ODD)).collect()
    assert len(rows) == len(ODD) and all(r.labels == "" and r.score == 0 for r in rows)
    assert license_scan.scan_licenses(table(spark, []).limit(0)).count() == 0


# 10 --------------------------------------------------------------------------------------------

def test_word_bpe_equals_the_library(spark, texts):
    tok = Tokenizer.from_file(PATH)
    rows = queries.op10_word_bpe(spark, MID).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_word_bpe_over_all_code_points():
    tok, own = Tokenizer.from_file(PATH), word_bpe.WordBpe(PATH)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    odd = [f"a{c}b{c}{c} 1{c}" for c in chars[:0x3400]] + ["".join(chars[k:k + 3]) for k in range(0x3000, len(chars) - 3, 97)]
    odd += ["ΑΣ ΑΣΑ", "It's THE'RE 'Sx <|endoftext|><|startoftext|>x<|endoftext", "a" * 500, "", "ab" * 3000, "é İİ"]
    for text, ids in zip(odd, own.encode_all(odd), strict=True):
        want = tok.encode(text, add_special_tokens=False).ids
        assert ids == want, (text, [hex(ord(c)) for c in text])
        assert own.decode(ids) == tok.decode(want, skip_special_tokens=False)


def test_latin_texts_equal_the_general_way_and_the_library(monkeypatch):
    tok, own = Tokenizer.from_file(PATH), word_bpe.WordBpe(PATH)
    latin = re.compile(word_bpe.LATIN)
    signs = [c for c in map(chr, range(0x3000)) if latin.fullmatch(c)]
    rng = np.random.default_rng(5)
    texts = [x for c in signs for x in (c, f"a{c}b", f".{c}.", f"1{c}'s", f"{c}{c.upper()}'LL")]
    texts += ["".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(500)]
    texts += ["".join(rng.choice(list("ab 's'll'Re12.,\n\t\xa0\xc9\xdf<|"), rng.integers(0, 60))) for _ in range(2000)]
    monkeypatch.setattr(word_bpe, "REMEMBERED", 500)
    got = own.encode_packed(texts)
    assert got == own._by_pieces(texts)
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert own.encode_all(texts) == want
    # texts of both kinds in one batch keep their places
    mixed = [t + "\u4e2d" * (i % 2) for i, t in enumerate(texts[:200])]
    assert own.encode_all(mixed) == [tok.encode(t, add_special_tokens=False).ids for t in mixed]


def test_latin_pieces_seen_before_are_not_cut_again(monkeypatch):
    tok, own = Tokenizer.from_file(PATH), word_bpe.WordBpe(PATH)
    texts = [f"Le caf\xe9 no{k % 5}, isn't it?\xa0 \u201c{'x' * (k % 7 * 20)}\u201d\n" for k in range(40)] + ["", " \t", "a"]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    words, cut = [], own._ids
    monkeypatch.setattr(own, "_ids", lambda some: words.extend(w for x in some for w in x) or cut(some))
    assert own.encode_all(texts) == want
    assert len(words) < 200
    words.clear()
    assert own.encode_all(texts) == want and not words
    # few texts at a time, and a table of pieces that starts again and again
    monkeypatch.setattr(word_bpe, "TOGETHER", 100)
    monkeypatch.setattr(word_bpe, "PIECES", 3)
    assert own.encode_all(texts) == want and own.encode_all([]) == []


def test_batches_are_gathered_whole():
    batches = [pa.RecordBatch.from_pydict({"k": [k, k], "t": ["x" * 10, None]}) for k in range(5)]
    got = list(common.gathered(iter(batches), 1, 3 * batches[0].column(1).nbytes))
    assert [len(b) for b in got] == [6, 4] and pa.Table.from_batches(got).equals(pa.Table.from_batches(batches).combine_chunks())
    assert not list(common.gathered(iter([]), 1, 10))


def test_word_bpe_odd_rows(spark):
    tok = Tokenizer.from_file(PATH)
    rows = word_bpe.encode(table(spark, ODD), PATH, keep=["doc_id", "text", "key"]).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        want = tok.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == tok.decode(want, skip_special_tokens=False)
    assert word_bpe.encode(table(spark, []).limit(0), PATH).count() == 0


def test_word_hashes_stay_bounded(monkeypatch):
    monkeypatch.setattr(WordHashes, "LIMIT", 10)
    seen = WordHashes()
    a = seen.array([b"%d" % i for i in range(50)])
    assert len(seen) == 0 and (seen.array([b"7"]) == a[7]).all()
