"""WARC archives, periodic runs and spelling variants against brute force on whole tables and odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import MID, ODD, table
from tickspark.llm import periodic_runs, queries, variants, warc

PAGES = "page_id long, url string, html string, off long, head string, file string"


# 11 --------------------------------------------------------------------------------------------

def pages(spark, rows):
    """pages with columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, 1, "WARC/1.1", "f") for r in rows], PAGES)


def brute_pages(rows):
    last = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 1000 and i is not None:
            last[body] = max(i, last.get(body, i))
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        head = last.get(body)
        again = head is not None and i != head
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", head if again else None))
    return out


def key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


def round_trip(spark, rows, path):
    warc.write_archives(pages(spark, rows), path)
    back = warc.read_records(spark, path)
    return back, [tuple(r) for r in back.select(
        warc.page_of("record_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("record_type") == "revisit", warc.page_of("refers_to"))).collect()]


def test_archives_equal_brute_force_on_all_pages(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{MID}/pages.parquet").collect()]
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op11_warc(spark, MID).collect()]
    assert sorted(got, key=key) == sorted(brute_pages(rows), key=key)


FAKE = "\r\n\r\nWARC/1.1\r\nContent-Length: 4\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666:0>\r\n\r\nevil\r\n\r\n"
BIG = "x" * 1200
TRICKY = [(1, "http://a/", "text" + FAKE + "WARC/1.0\r\nContent-Length: 0\r\n\r\n" + FAKE), (2, "b", FAKE), (3, None, None), (4, "", ""),
          (5, "u\r\nContent-Length: 3\r\n\r\nWARC/1.1", "ends in a line end\r\n"), (6, "u", "\r\n\r\n\r\n"), (7, "u", "\r\n"), (8, "u", "a\r\n\r\n"),
          (9, "u", "\r"), (10, "u", "é" * 600), (11, "u", "é" * 600), (12, "u", BIG + FAKE), (13, "u", BIG + FAKE), (14, "u", "small"),
          (15, "u", "small"), (None, None, BIG), (None, "n", BIG), (16, "u", BIG), (17, "u", "y" * 999), (18, "u", "y" * 999),
          (19, "u", "z" * 1000), (19, "u", "z" * 1000), (-20, "u", "z" * 1000), (21, "u", "line\r\n\r\nline\r\n\r\n" * 80000),
          (None, "only", "null ids " * 200), (None, "only", "null ids " * 200)]


@pytest.mark.parametrize("split", ["134217728", "600"])
def test_magic_inside_payloads_odd_rows_and_small_splits(spark, tmp_path, split):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split if split != "600" else "65536")
    rows = TRICKY if split != "600" else TRICKY + [(100 + i, "u", FAKE * (i % 7) + "w" * i + "\r\n" * (i % 5)) for i in range(600)]
    try:
        back, got = round_trip(spark, rows, str(tmp_path / "w"))
        assert sorted(got, key=key) == sorted(brute_pages(rows), key=key)
        whole = back.where("record_type = 'response' and stored_bytes > 0").select("file", "start", (F.col("start") + F.col("stored_bytes")).alias("end"))
        texts = warc.payloads(spark, str(tmp_path / "w"), warc.pieces(spark, str(tmp_path / "w")), whole).collect()
        assert {bytes(t.payload).decode() for t in texts} == {h for i, _, h in rows if h}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_files_are_plain_warc_and_offsets_point_at_records(spark, tmp_path):
    back, _ = round_trip(spark, TRICKY, str(tmp_path / "w"))
    for r in back.collect():
        data = open(r.file.replace("file://", "").replace("file:", ""), "rb").read()
        assert data[r.off:r.off + 10] == b"WARC/1.1\r\n" and data.endswith(b"\r\n\r\n")
        head = data[r.off:data.index(b"\r\n\r\n", r.off)].decode()
        size = int(re.search(r"Content-Length: (\d+)", head)[1])
        end = r.off + len(head.encode()) + 4 + size
        assert data[end:end + 4] == b"\r\n\r\n" and r.start + r.stored_bytes == end


def test_a_record_cut_off_and_an_empty_table(spark, tmp_path):
    (tmp_path / "cut").mkdir()
    one = "WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:1>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "cut" / "a.warc").write_bytes((one + one.replace("x:1", "x:2").replace(": 5", ": 500")).encode())
    got = warc.read_records(spark, str(tmp_path / "cut")).collect()
    assert [(r.record_id, r.payload_bytes, r.payload_digest) for r in got] == [("<urn:x:1>", 5, hashlib.sha1(b"hello").hexdigest())]
    _, none = round_trip(spark, [], str(tmp_path / "none"))
    assert none == []


def test_pointers_reach_only_what_the_start_leads_to(spark):
    chain = [("f", 10 * i, 10 * i + 10) for i in range(1000)] + [("f", 10 * i + 5, 10 * i + 20) for i in range(50)] + [("g", 3, 7), ("g", 7, 9)]
    got = {(r.file, r.off) for r in warc.reachable(spark.createDataFrame(chain, "file string, off long, next long")).collect()}
    assert got == {("f", 10 * i) for i in range(1000)}


# 12 --------------------------------------------------------------------------------------------

def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                block = words[i:i + length]
                if not any(all(block[t] == block[t + d] for t in range(length - d)) for d in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is None or not words or zlib.crc32(str(doc_id).encode()) % 10:
        return words
    g, n = zlib.crc32(str(doc_id).encode()) // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(doc_id, text):
    words = planted(doc_id, text)
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def test_periodic_runs_equal_brute_force_on_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    want = [digest(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in queries.op12_periodic_runs(spark, sf).collect()]
    assert sorted(got) == sorted(want) if all(w[2] is not None for w in want) else sorted(got, key=key) == sorted(want, key=key)
    assert sum(w[1] > 0 for w in want) > 10


@pytest.mark.parametrize("core", [8, 32, 1 << 16])
def test_fragments_of_overlapping_tiles_stitch_to_the_runs(spark, monkeypatch, core):
    monkeypatch.setattr(periodic_runs, "TILE_WORDS", core)
    rng, texts = np.random.default_rng(core), []
    for _ in range(150):
        parts = []
        for _ in range(int(rng.integers(1, 6))):
            block = rng.integers(0, int(rng.choice([1, 2, 3, 40])), int(rng.integers(1, 30)))
            parts.append(np.tile(block, int(rng.integers(1, 12)))[:int(rng.integers(1, 200))])
        texts.append(" ".join(map(str, np.concatenate(parts))))
    texts += ["a " * 3000, "a b " * 1500, "", None, "x", ("p q r s t u v w " * 300) + "z " + ("p q r s t u v w " * 300)]
    _, counts, found = periodic_runs.fragments(texts)
    pieces = spark.createDataFrame([(d, q, lo, hi) for d, f in enumerate(found) for q, lo, hi in f], "key long, period long, lo long, hi long")
    got = {r.key: [(x["start"], x["length"], x["period"]) for x in r.runs] for r in periodic_runs.stitch(pieces).collect()}
    for d, text in enumerate(texts):
        assert got.get(d, []) == brute_runs((text or "").split()), text


def test_periodic_runs_odd_rows(spark):
    got = periodic_runs.periodic_runs(table(spark, ODD), keep=("doc_id", "text")).collect()
    assert len(got) == len(ODD)
    for r in got:
        words = (r.text or "").encode().split()
        runs = brute_runs(words) if len(words) < 5000 else [(0, 15000, 5)]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == runs
        assert r.collapsed_text.encode() == b" ".join(w for i, w in enumerate(words) if i not in gone)
    assert periodic_runs.periodic_runs(table(spark, ODD).limit(0)).count() == 0


def test_longest_run_is_exact(spark):
    rows = [([(0, 40, 10), (5, 41, 10), (50, 8, 2)],), ([(3, 8, 2), (9, 4 * 10**9 + 1, 10**9), (20, 12, 3)],), ([],)]
    got = spark.createDataFrame(rows, f"runs {periodic_runs.RUN}").select(periodic_runs.longest(F.col("runs")).alias("b")).collect()
    assert [tuple(r.b) if r.b else None for r in got] == [(5, 41, 10), (9, 4 * 10**9 + 1, 10**9), None]


# 13 --------------------------------------------------------------------------------------------

def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_variants(counts):
    near = defaultdict(set)
    holes = defaultdict(set)  # words that share a word with a letter out or blanked are the only ones to compare
    for w in counts:
        for i in range(len(w)):
            holes[w[:i] + w[i + 1:]].add(w)
        holes[w].add(w)
    for group in holes.values():
        for a in group:
            near[a].update(b for b in group if b > a and one_edit(a, b))
    for a in list(near):
        for b in list(near[a]):
            near[b].add(a)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda b: (-counts[b], b), default=None)
        form[w] = best if best and counts[best] >= 10 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


def brute_words(rows):
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            seen[run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def test_variants_equal_brute_force_on_all_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{MID}/documents.parquet").collect()]
    want = brute_variants(brute_words(rows))
    got = [tuple(r) for r in queries.op13_variants(spark, MID).collect()]
    assert len(got) == len(want) and set(got) == want
    assert sum(w[1] is not None for w in want) > 50


def test_neighbours_of_close_words_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    words = {"".join(rng.choice(list("abé"), int(rng.integers(7, 10)))) for _ in range(900)}
    words |= {"a" * n for n in range(7, 40)} | {"z" * 6000, "z" * 6001, "z" * 5999 + "y", "y" + "z" * 5999, "abababab" * 500, "bababab" + "abababab" * 500}
    counts = {w: int(10 ** rng.integers(0, 5)) * 2 for w in words}
    got = [tuple(r) for r in variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
           .select("word", "form", "root", "n", "n_near", "form_n").collect()]
    small = {w: n for w, n in counts.items() if len(w) < 1000}
    assert {r for r in got if len(r[0]) < 1000} == brute_variants(small) and len(got) == len(counts)
    near = {r[0]: r[4] for r in got}
    assert near["z" * 6000] == 3 and near["z" * 6001] == 1 and near["y" + "z" * 5999] == 1


def test_variants_odd_rows(spark):
    docs = table(spark, ODD + [(20, "Straße STRASSE überall ÜBERALL überall x×÷ÿÿÿÿ"), (None, "überall überall Xxxxxxxx"), (21, "xxxxxxxx")])
    runs = variants.runs(docs)
    words = variants.word_counts(runs.select(variants.misspelt(runs).alias("word")))
    got = {tuple(r) for r in variants.variants(words).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == brute_variants(brute_words([(r.doc_id, r.text) for r in docs.collect()]))
    assert variants.variants(words.limit(0)).count() == 0


@pytest.mark.parametrize(("name", "tab"), [("op11_warc", "pages"), ("op13_variants", "documents")])
def test_queries_match_their_sql(spark, name, tab):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {tab} AS SELECT * FROM read_parquet('{MID}/{tab}.parquet')")
    found = queries.queries()[name](spark, MID)
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert Counter(tuple(r) for r in found.collect()) == Counter(want) and want
