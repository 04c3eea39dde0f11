"""WARC: a content-addressed archive that stores each payload once.

``archive`` splits records into a payload store (one row per strong digest,
SHA-256) and a header table (one row per record with its exact header block).
``restore`` joins them back: header + payload are the original record, byte for
byte, and a payload whose digest doesn't fit its name fails the query.
``write_warc`` writes records as WARC 1.1 files with Spark's own text writer
(header, blank line, payload; the writer's line separator is the blank line
pair that ends a record) and ``read_warc`` parses files by Content-Length.

A payload of at least ``revisit_from`` bytes that several records share has one
response record, that with the largest page_id; the others are revisits without
payload that name it.

Edge cases: a null payload is empty. Null page_ids come after all others: such
a record is the response only if no other record has its payload. Of repeated
rows (same id, same payload) the first is the response, the others revisit it.
Payloads may hold blank lines or WARC headers of their own. Urls lose line
breaks. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, scratch_dir

REVISIT_FROM = 1000
END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _bytes(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def plan_records(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """One row per record: page_id, url, sha256, sha1, payload_bytes, ord, response (whether it holds the payload), refers_to.

    Digests only travel: sums by (digest, page_id) first, then by digest, with
    map-side partials, so thousands of copies of one page are one small row a task.
    """
    raw = _bytes(F.col("html"))
    ids = pages.select("page_id", F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "[\\r\\n]", "").alias("url"), F.sha2(raw, 256).alias("sha256"), F.sha1(raw).alias("sha1"), F.octet_length(raw).cast("long").alias("payload_bytes"))
    ids = materialise(ids, "page-digests")
    same = ids.groupBy("sha256", "page_id").agg(F.count("*").alias("n"), F.min("sha1").alias("sha1"), F.min("payload_bytes").alias("payload_bytes"), F.array_sort(F.collect_list("url")).alias("urls"))
    best = ids.groupBy("sha256").agg(F.max("page_id").alias("best"), F.min("sha1").alias("a"), F.max("sha1").alias("b"), F.min("payload_bytes").alias("c"), F.max("payload_bytes").alias("d"))
    # A strong digest is trusted only where length and second digest agree too.
    # The check stands in a column that every record's header is made of, so it can't be pruned.
    one = (F.col("a") == F.col("b")) & (F.col("c") == F.col("d"))
    best = best.select("sha256", F.when(one, F.col("best")).otherwise(F.raise_error(F.concat(F.lit("two payloads share the digest "), F.col("sha256"))).cast(best.schema["best"].dataType)).alias("best"))
    rows = same.join(best, "sha256").select("*", F.posexplode("urls").alias("ord", "url"))
    leads = F.col("page_id").eqNullSafe(F.col("best")) & (F.col("ord") == 0)
    large = F.col("payload_bytes") >= revisit_from
    return rows.select(
        "page_id", "url", "sha256", "sha1", "payload_bytes", "ord",
        (leads | ~large).alias("response"), F.when(large & ~leads, F.col("best")).alias("refers_to"),
    )


def header_block(date: str) -> Column:
    """The exact header lines of a record, without the blank line after them."""
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("response"), F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:x-record:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), F.col("ord").cast("string"), F.lit(">"))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.when(F.col("response"), F.col("sha256")).otherwise(F.sha2(F.lit("").cast("binary"), 256)))),
        F.when(F.col("response"), F.lit("")).otherwise(F.concat(line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", urn(F.col("refers_to"))))),
        line("Content-Type", F.lit("text/html; charset=UTF-8")),
        F.concat(F.lit("Content-Length: "), F.when(F.col("response"), F.col("payload_bytes")).otherwise(F.lit(0)).cast("string")),
    )


def archive(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``path/headers`` (page_id, ord, header, sha256, stored) and ``path/payloads`` (sha256, payload: once a digest)."""
    plan_records(pages, revisit_from).select("page_id", "ord", header_block(date).alias("header"), "sha256", F.col("response").alias("stored")).write.parquet(f"{path}/headers")
    text = F.coalesce("html", F.lit(""))
    pages.select(F.sha2(_bytes(F.col("html")), 256).alias("sha256"), text.alias("payload")).dropDuplicates(["sha256"]).write.option("compression", "zstd").parquet(f"{path}/payloads")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """page_id, ord, record (string): the original records, header and payload joined on the verified digest."""
    heads, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    checked = F.when(F.sha2(_bytes(F.col("payload")), 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))))
    full = heads.where("stored").join(payloads.select("sha256", checked.alias("payload")), "sha256")
    record = lambda payload: F.concat("header", F.lit(END), payload).alias("record")
    return full.select("page_id", "ord", record(F.col("payload"))).unionByName(heads.where("not stored").select("page_id", "ord", record(F.lit(""))))


def write_warc(records: DataFrame, path: str, per_file: int = 4000) -> None:
    """Write ``records(record)`` as gzip-compressed WARC files of at most ``per_file`` records, one or more a partition.

    Records are written where the join left them, spread by digest, so they
    aren't shuffled once more.
    """
    records.select("record").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse_warc(raw: bytes):
    """(headers, payload) of each record, by Content-Length."""
    at = 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        head = dict(line.split(b": ", 1) for line in raw[at:stop].split(b"\r\n")[1:])
        size = int(head[b"Content-Length"])
        yield head, raw[stop + 4 : stop + 4 + size]
        at = stop + 4 + size
        if raw[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} doesn't end where its length says")
        at += 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id (long), ord, record_type, refers_to (long), payload_digest, payload (binary) of each record of the files in ``path``.

    A file is one row of Spark's binary reader; the writer bounds its size.
    """

    def run(batches):
        import zlib

        number = lambda v: None if v is None or v == b"null" else int(v)
        for b in batches:
            for raw in b["content"]:
                out = []
                for h, payload in parse_warc(zlib.decompress(raw.as_buffer(), 31)):
                    page, ord_ = h[b"WARC-Record-ID"][len("<urn:x-record:") : -1].split(b":")
                    refers = h.get(b"WARC-Refers-To", b"<urn:x-page:null>")[len("<urn:x-page:") : -1]
                    out.append((number(page), int(ord_), h[b"WARC-Type"].decode(), number(refers), h[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode(), payload))
                for k in range(0, len(out), 2000):
                    cols = list(zip(*out[k : k + 2000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2]), pa.array(cols[3], pa.int64()), pa.array(cols[4]), pa.array(cols[5], pa.binary())], names=["page_id", "ord", "record_type", "refers_to", "payload_digest", "payload"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("content")
    return files.mapInArrow(run, "page_id long, ord int, record_type string, refers_to long, payload_digest string, payload binary")


def round_trip(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Archive, write WARC files, read them again: page_id, payload_bytes, payload_digest, record_type, refers_to per page.

    Bytes and digest of a response are those of the payload read from its file;
    a revisit has those of the response that it is joined to by digest.
    """
    spark = pages.sparkSession
    archive(pages, f"{path}/store", revisit_from)
    write_warc(restore(spark, f"{path}/store"), f"{path}/warc")
    read = read_warc(spark, f"{path}/warc")
    got = materialise(read.select("page_id", "ord", "record_type", "refers_to", F.col("payload_digest").alias("named"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n")), "warc-records")
    right = F.when(F.col("sha1") == F.col("named"), F.col("sha1")).otherwise(F.raise_error(F.lit("damaged payload in the archive")))
    responses = got.where("record_type = 'response'").select("page_id", "record_type", "refers_to", F.col("n").alias("payload_bytes"), right.alias("payload_digest"))
    stored = responses.groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = got.where("record_type = 'revisit'").join(stored, F.col("named") == F.col("payload_digest")).select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest")
    return responses.unionByName(revisits).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "pages"), f"{scratch_dir(spark)}/archive-{uuid.uuid4().hex}")


ARCHIVE_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
 b as (select *, max(page_id) over (partition by payload_digest) as best from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes < 1000 or page_id = best then 'response' else 'revisit' end as record_type,
  case when payload_bytes >= 1000 and page_id <> best then best end as refers_to from b
"""
