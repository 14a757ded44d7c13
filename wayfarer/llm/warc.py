"""WARC archives with revisit resolution.

Headers (id, digest, size) are shuffled by payload digest; of equal payloads of MIN_BYTES or more the record of the
least page_id (null last) is a response and the others are revisits of it. Archives are written by Spark's text writer with fresh
headers, the records' end "\\r\\n\\r\\n" as line separator, so that lost tasks are redone by its commit protocol; files
are gzip streams of whole records. Reading puts records together by Content-Length, whatever the payload holds,
and resolves revisits by a join on record ids. Null html is an empty payload; rows of one page_id and payload
are one capture and get records of one type. Keys are of any type that has a text and an order. Line breaks in addresses are percent-encoded. Empty tables make empty archives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, scratch_path, table, text_of

MIN_BYTES, DATE, PER_FILE = 100, "2024-01-01T00:00:00Z", 20_000
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = ("page_id", "record_id", "record_type", "url", "date", "payload_digest", "payload_bytes", "refers_to_id", "payload")
RECORD = T.StructType([T.StructField(x, T.LongType() if x == "payload_bytes" else T.StringType()) for x in FIELDS])
#: What stands for characters that a header's value can't hold.
ESCAPED = (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"))


def _record_id(key: Column, digest: Column) -> Column:
    name = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(" "), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def resolve(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url", min_bytes: int = MIN_BYTES) -> DataFrame:
    """pages with digest, size, record_id and, for revisits, the original's original_id, original_key and original_url."""
    body = text_of(html)
    named = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), body.alias("html"), F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    headers = named.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first"))
    originals = materialize(headers.where("n > 1").select("digest", F.col("first.page_id").alias("original_key"), F.col("first.url").alias("original_url"), F.lit(True).alias("repeated")), "originals")
    joined = named.join(originals, "digest", "left").withColumn("record_id", _record_id(F.col("page_id"), F.col("digest")))
    revisit = F.coalesce(F.col("repeated"), F.lit(False)) & (F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("original_key"))
    return joined.withColumn("revisit", revisit).withColumn("original_id", F.when(revisit, _record_id(F.col("original_key"), F.col("digest"))))


def records(resolved: DataFrame, date: str = DATE) -> DataFrame:
    """One column, value: each record's header and block, without the end mark."""
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    if_any = lambda c: F.coalesce(c, F.lit(""))
    address = lambda c: F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    def escaped(c: Column) -> Column:
        for plain, code in ESCAPED:
            c = F.replace(c, F.lit(plain), F.lit(code))
        return c

    revisit = F.col("revisit")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.lit(date)),
        if_any(line("WARC-Target-URI", address(F.col("url")))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        if_any(line("X-Page-Id", escaped(F.col("page_id").cast("string")))),
        if_any(F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.col("original_id")), if_any(line("WARC-Refers-To-Target-URI", address(F.col("original_url"))))))),
        F.lit("\r\nContent-Type: application/http;msgtype=response"),
        line("Content-Length", length.cast("string")),
    )
    return resolved.select(F.concat(header, F.lit(END), block).alias("value"))


def write_archives(pages: DataFrame, path: str, date: str = DATE, per_file: int = PER_FILE, **names) -> None:
    """Write pages as gzipped WARC files under path."""
    records(resolve(pages, **names), date).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(fragments: Iterator[str | None], payloads: bool = True) -> Iterator[tuple]:
    """Records of the pieces between end marks, in file order.

    A payload that ends in line breaks makes the reader cut before the record's end: what a record doesn't take of its last
    piece is the head of the next one.
    """
    end, rest = END.encode(), ""
    while (head := rest or next(fragments, None)) is not None:
        rest = ""
        if not head:
            continue
        if not head.startswith("WARC/"):
            raise ValueError(f"not a record: {head[:80]!r}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.split("\r\n")[1:])
        length, block, held = int(fields["Content-Length"]), [], 0
        while held < length + len(end):
            piece = next(fragments, None)
            if piece is None:
                break
            block += [piece.encode("utf-8", "surrogatepass"), end]
            held += len(block[-2]) + len(end)
        raw = b"".join(block)
        if length <= held < length + len(end):  # a file's last, incomplete piece may be missing
            raw += end[held - length :]
        if raw[length : length + len(end)] != end:
            raise ValueError(f"a record of {length} bytes has {held}")
        rest = raw[length + len(end) : -len(end)].decode("utf-8", "surrogatepass")
        data = raw[:length].split(end, 1)[1]
        payload = data.decode("utf-8", "surrogatepass")
        whole = fields["WARC-Type"] == "response"
        digest = hashlib.sha256(data).hexdigest() if whole else fields["WARC-Payload-Digest"].removeprefix("sha256:")
        if whole and fields["WARC-Payload-Digest"] != f"sha256:{digest}":
            raise ValueError(f"payload and digest of {fields['WARC-Record-ID']} differ")
        key = fields.get("X-Page-Id")
        for plain, code in reversed(ESCAPED):
            key = key and key.replace(code, plain)
        yield (key, fields["WARC-Record-ID"], fields["WARC-Type"], fields.get("WARC-Target-URI"), fields["WARC-Date"], digest, len(data) if whole else None, fields.get("WARC-Refers-To"), payload if payloads and whole else None)


def read_archives(spark: SparkSession, path: str, payloads: bool = True, batch: int = 512, key_type: str = "bigint") -> DataFrame:
    """The records under path; those of revisits have the size, digest and key (refers_to) of their originals. key_type is the type that keys had.

    Gzip files are read by one task each, in order, so that pieces of a record stay together.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for row in parse((x for f in frames for x in f["value"]), payloads):
            rows.append(row)
            if len(rows) == batch:
                yield frame(rows)
                rows = []
        yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=RECORD.names, dtype=object)
        return out.astype({"payload_bytes": "Int64"})

    pieces = spark.read.option("lineSep", END).text(path)
    found = pieces.mapInPandas(read, RECORD)
    found = materialize(found.withColumn("page_id", F.col("page_id").cast(key_type)), "records")
    originals = found.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.first("page_id").alias("refers_to"), F.first("payload_bytes").alias("original_bytes"))
    joined = found.join(originals, "refers_to_id", "left")
    return joined.withColumn("payload_bytes", F.coalesce("payload_bytes", "original_bytes")).drop("original_bytes")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    found = read_archives(spark, path, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN f.first_id IS DISTINCT FROM p.page_id AND f.payload_digest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id IS DISTINCT FROM p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

QUERIES = {"op8_warc": op8_warc}
ORACLES = {"op8_warc": OP8}
