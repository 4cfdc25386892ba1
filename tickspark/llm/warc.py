"""WARC archives written by Spark and read back by verified record chains.

Writing is the text sink with ``\\r\\n\\r\\n`` behind each record, which is what the format asks for, so
files go through Spark's own committer to any store. Reading cuts files at every ``\\r\\n\\r\\n``
(the text source splits large files over tasks), and the sizes of the pieces, summed by split, give each
one's byte offset. A piece that starts with the magic line is a candidate record; its Content-Length
gives the offset where its successor must start. Payloads may hold the magic too, so candidates
count only if they can be reached from the start of the file: pointers of candidates are doubled by joins,
and a candidate that a reached one points to is reached.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickspark.llm.common import cut
from tickspark.session import ensure_checkpoint_dir

CRLF = "\r\n"
GAP = CRLF + CRLF
#: Payloads from this size on are stored once; repeats become revisit records.
LEAST_PAYLOAD = 1000
#: Records in one file at most; bounds the rounds of the reader.
FILE_RECORDS = 50_000
#: Payload bytes that one task lines up when pieces of a payload are put together.
BLOCK = 1 << 20
#: Parts into which the rows that refer to one record are split.
SALTS = 64
DATE = "1970-01-01T00:00:00Z"


def folder(spark: SparkSession) -> str:
    """A new folder for archives in the session's shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value, F.lit(CRLF))


def _payload(pages: DataFrame) -> Column:
    return F.coalesce(pages.html, F.lit(""))


def repeated(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """(digest, head): payloads of at least ``least`` bytes that occur in several rows, with the largest
    page_id. Combined map-side by digest; no payload is shuffled."""
    body = _payload(pages)
    return (pages.where(F.octet_length(body) >= least).groupBy(F.sha2(body, 256).alias("digest"))
            .agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("digest", "head"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST_PAYLOAD, date: str = DATE) -> None:
    """``pages`` (page_id, url, html) as WARC/1.1 files under ``path``: a response record a row, or a revisit
    of the record with the same payload and the largest page_id.

    A null html is an empty payload, a null url has no target line, line ends in urls are escaped, a null
    id is written as nothing and never a head. Rows that share the largest id of equal payloads are
    all responses. Empty payloads and those below ``least`` bytes never revisit.
    """
    body = _payload(pages)
    heads = cut(repeated(pages, least))
    known = F.coalesce(pages.page_id.cast("string"), F.lit(""))
    ident = lambda i, digest: F.concat(F.lit("<urn:page:"), i, F.lit(":"), F.substring(digest, 1, 16), F.lit(">"))
    rows = (pages.select(known.alias("_id"), pages.page_id.alias("_page"), pages.url.alias("_url"), body.alias("_body"),
                         F.sha2(body, 256).alias("digest"))
            .join(heads, "digest", "left"))
    again = F.col("head").isNotNull() & ~F.col("_page").eqNullSafe(F.col("head"))
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    stored_body = F.when(again, F.lit("")).otherwise(F.col("_body"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.octet_length("_body").cast("string"))
    size = F.octet_length(http) + len(GAP) + F.octet_length(stored_body)
    url = F.regexp_replace(F.regexp_replace("_url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit("WARC/1.1" + CRLF), _line("Content-Length", size.cast("string")), _line("WARC-Type", kind),
        _line("WARC-Record-ID", ident(F.col("_id"), F.col("digest"))), _line("WARC-Date", F.lit(date)),
        F.when(F.col("_url").isNotNull(), _line("WARC-Target-URI", url)).otherwise(F.lit("")),
        F.when(again, F.concat(_line("WARC-Refers-To", ident(F.col("head").cast("string"), F.col("digest"))),
                               _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))))
        .otherwise(F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("_body"))),
        F.lit("Content-Type: application/http;msgtype=response"))
    (rows.select(F.concat(head, F.lit(GAP), http, F.lit(GAP), stored_body).alias("value"))
     .write.option("lineSep", GAP).option("maxRecordsPerFile", FILE_RECORDS).text(path))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, off, size, sha1, head): the bytes between gaps. ``head`` is the piece's text where it may be a
    record header, else null; ``off`` counts bytes of the (unpacked) file."""
    raw = spark.read.option("lineSep", GAP).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("i"), F.octet_length("value").cast("long").alias("size"),
        F.sha1(F.col("value").cast("binary")).alias("sha1"),
        # a payload that ends in a line end leaves that line end before the next magic
        F.when(F.col("value").rlike(r"\A(\r\n)?WARC/1\.[01]\r\n"), F.col("value")).alias("head"))
    raw = cut(raw)
    step = F.col("size") + len(GAP)
    inside = Window.partitionBy("file", "split").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = (raw.groupBy("file", "split").agg(F.sum(step).alias("_s"))
             .withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s"))
    zero = F.lit(0).cast("long")
    return cut(raw.withColumn("_in", F.coalesce(F.sum(step).over(inside), zero)).join(bases, ["file", "split"])
               .select("file", (F.col("_base") + F.col("_in")).alias("off"), "size", "sha1", "head"))


def _field(name: str) -> Column:
    found = F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(found != "", found)


def candidates(parts: DataFrame) -> DataFrame:
    """(file, off, block, length, next, head): pieces that look like record headers, the offset of their
    block, its length and the offset where the next record must start."""
    lead = F.when(F.col("head").startswith(CRLF), len(CRLF)).otherwise(0)
    length = _field("Content-Length").try_cast("long")
    block = F.col("off") + F.col("size") + len(GAP)
    return (parts.where("head is not null").select("file", (F.col("off") + lead).alias("off"), block.alias("block"),
                                                    length.alias("length"), "head")
            .where("length >= 0").withColumn("next", F.col("block") + F.col("length") + len(GAP)))


def reachable(chain: DataFrame) -> DataFrame:
    """(file, off) of the rows of ``chain`` (file, off, next) that pointers lead to from offset 0. Each round
    doubles the steps a pointer stands for, so a file of n records takes log2(n) rounds; a row left
    without a pointer is done."""
    state = cut(chain.select("file", "off", F.col("next").alias("to"), (F.col("off") == 0).alias("hit")))
    while not state.where("to is not null").isEmpty():
        far = state.select("file", F.col("off").alias("to"), F.col("to").alias("_far"))
        hop = state.where("to is not null").join(far, ["file", "to"])
        seen = F.explode(F.array(F.struct("off", F.col("_far").alias("to"), "hit"),
                                 F.struct(F.col("to").alias("off"), F.lit(None).cast("long").alias("to"), F.col("hit").alias("hit"))))
        moved = hop.select("file", seen.alias("s")).select("file", "s.*")
        state = cut(moved.unionByName(state.withColumn("to", F.lit(None).cast("long")))
                    .groupBy("file", "off").agg(F.max("to").alias("to"), F.max("hit").alias("hit")))
    return state.where("hit").select("file", "off")


def _spans(parts: DataFrame, spans: DataFrame) -> DataFrame:
    """``parts`` (file, off, ...) inside ``spans`` (file, start, end), each with its span's ``start``.
    Spans mark every block they touch, and inside a block the last mark before a piece is its span."""
    blocks = spans.select("file", "start", "end", F.explode(F.sequence(
        F.floor(F.col("start") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))).alias("_b"))
    mark = blocks.select("file", "_b", F.greatest(F.col("start"), F.col("_b") * BLOCK).alias("_at"), F.lit(0).alias("_kind"),
                         F.struct("start", "end").alias("_span"))
    rows = parts.select("file", F.floor(F.col("off") / BLOCK).alias("_b"), F.col("off").alias("_at"), F.lit(1).alias("_kind"),
                        F.struct(*parts.columns).alias("_row"))
    by = Window.partitionBy("file", "_b").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    lined = mark.unionByName(rows, allowMissingColumns=True).withColumn("_span", F.last("_span", ignorenulls=True).over(by))
    return lined.where("_kind = 1 and _at < _span.end").select(F.col("_span.start").alias("start"), "_row.*")


def payloads(spark: SparkSession, path: str, parts: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, start, payload binary): the bytes of ``spans`` (file, start, end: starts lie behind a gap),
    put together from their pieces. Only pieces inside spans are fetched."""
    inside = cut(_spans(parts.select("file", "off"), spans.where("end > start")))
    step = F.octet_length("value") + len(GAP)
    raw = spark.read.option("lineSep", GAP).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("i"), "value")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = (raw.groupBy("file", "split").agg(F.sum(step).alias("_s"))
             .withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s"))
    own = Window.partitionBy("file", "split").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = (raw.withColumn("_in", F.coalesce(F.sum(step).over(own), F.lit(0).cast("long"))).join(bases, ["file", "split"])
              .select("file", (F.col("_base") + F.col("_in")).alias("off"), "value"))
    held = placed.join(inside, ["file", "off"]).groupBy("file", "start").agg(
        F.sort_array(F.collect_list(F.struct("off", "value"))).alias("_p"))
    whole = F.concat(F.array_join(F.transform("_p", lambda p: p["value"]), GAP), F.lit(GAP)).cast("binary")
    return held.join(spans, ["file", "start"]).select("file", "start", F.expr("end - start").alias("_n"), whole.alias("_w")) \
               .select("file", "start", F.expr("substring(_w, 1, cast(_n as int))").alias("payload"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row a verified record under ``path``: file, off, record_id, record_type, target_uri, refers_to (the
    record id a revisit names), start and stored_bytes (place and size of the stored payload),
    payload_bytes and payload_digest (SHA-1, lower-case hex) of the full payload.

    A revisit's full payload is that of the record it names; where that is missing its size is null and its
    digest the one its own header states. A record cut off at the end of its file is left out, as is
    all behind a broken record. HTTP blocks carry their payload behind the HTTP header, others are
    payload as a whole. An empty folder of archives gives no rows.
    """
    parts = pieces(spark, path)
    ends = parts.groupBy("file").agg(F.max(F.col("off") + F.col("size") + len(GAP)).alias("_end"))
    found = cut(candidates(parts))
    reached = reachable(found)
    http = F.coalesce(F.lower(_field("Content-Type")).startswith("application/http"), F.lit(False))
    records = (found.join(reached, ["file", "off"]).join(ends, "file").where("next <= _end")
               .select("file", "off", "block", "length", _field("WARC-Record-ID").alias("record_id"),
                       _field("WARC-Type").alias("record_type"), _field("WARC-Target-URI").alias("target_uri"),
                       _field("WARC-Refers-To").alias("refers_to"), _field("WARC-Payload-Digest").alias("_stated"), http.alias("_http")))
    front = parts.select("file", F.col("off").alias("block"), F.col("size").alias("_front"))
    skip = F.when(F.col("_http"), F.least(F.col("_front") + len(GAP), F.col("length"))).otherwise(F.lit(0))
    records = (records.join(front, ["file", "block"], "left")
               .withColumn("start", F.col("block") + skip).withColumn("stored_bytes", F.col("length") - skip)
               .drop("block", "length", "_front", "_http"))
    body = parts.select("file", F.col("off").alias("start"), F.col("size").alias("_size"), F.col("sha1").alias("_sha1"))
    records = cut(records.join(body, ["file", "start"], "left"))
    whole = F.when(F.col("stored_bytes") == 0, F.sha1(F.lit("").cast("binary"))).when(F.col("_size") == F.col("stored_bytes"), F.col("_sha1"))
    records = records.withColumn("_digest", whole)
    split = records.where("_digest is null").select("file", "start", (F.col("start") + F.col("stored_bytes")).alias("end"))
    if not split.isEmpty():  # payloads that hold a gap, or end in a part of one
        joined = payloads(spark, path, parts, split).select("file", "start", F.sha1("payload").alias("_late"))
        records = records.join(joined, ["file", "start"], "left").withColumn("_digest", F.coalesce("_digest", "_late")).drop("_late")
    records = cut(records.drop("_size", "_sha1"))
    stated = F.lower(F.regexp_replace("_stated", "^(?i)sha1:", ""))
    plain = records.where("not (record_type <=> 'revisit')").withColumn("payload_bytes", F.col("stored_bytes")) \
                   .withColumn("payload_digest", F.col("_digest"))
    again = records.where("record_type <=> 'revisit'")
    named = again.select("refers_to").distinct()
    heads = (plain.select(F.col("record_id").alias("refers_to"), "payload_bytes", "payload_digest").join(named, "refers_to")
             .dropDuplicates(["refers_to"])
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    again = (again.withColumn("_salt", F.pmod(F.xxhash64("file", "off"), F.lit(SALTS)).cast("int"))
             .join(heads, ["refers_to", "_salt"], "left").withColumn("payload_digest", F.coalesce("payload_digest", stated)))
    cols = ["file", "off", "record_id", "record_type", "target_uri", "refers_to", "start", "stored_bytes", "payload_bytes", "payload_digest"]
    return plain.select(cols).unionByName(again.select(cols))


def page_of(record_id: Column | str) -> Column:
    """The page_id in a record id of ``write_archives`` (null where it holds none)."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d*):", 1).try_cast("long")
