"""WARC archives with revisit records.

Digests of all payloads are shuffled (never the payloads themselves); of equal payloads of at least `least` bytes the row
with the largest id keeps the payload as a response record, the others become revisit records that refer to it. Rows
whose payload occurs once go straight from the scan to the archive; a bitmap tells them, and all others take part in a
join by digest. Spark's text writer lays the records down (gzip, CRLF CRLF between them), so archives can
lie in any file system that Spark writes.

Null payloads count as empty. A record's name comes from page id and digest, so rows that repeat an id with another
payload are other records. Rows that repeat the largest id of their payload are all responses; a null id is never
referred to as long as there is another. Null urls give an empty target; control characters and blanks in them are
percent-encoded. An empty table gives an empty archive and no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Shelf, bit_words, flagged, shared_dir, stored

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id, sha1) -> F.Column:
    """A stable urn:uuid for a page and its payload: rows that repeat an id with another payload are other records."""
    name = F.concat(F.lit("page "), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(" "), sha1)
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(name), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def uri(url) -> F.Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7F]", "%20")


def resolve(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000, bits: int | None = None, shelf: Shelf | None = None) -> DataFrame:
    """(page_id, url, payload, n_bytes, sha1, original, original_url): original is null for responses.

    The result reads tables on the shelf, until its owner drops them.
    """
    shelf = shelf or Shelf(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload"), "sha256": F.sha2("payload", 256), "key": F.xxhash64("payload")})
    digests = rows.filter(F.col("n_bytes") >= least).select("sha256", "key", "page_id", "url")
    groups = digests.groupBy("sha256", "key").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("first")).filter("n > 1")
    groups = shelf.put(groups.select("sha256", "key", F.col("first.page_id").alias("original"), F.col("first.url").alias("original_url")), "groups")
    told = flagged(rows, "key", shelf.put(bit_words(groups, "key", bits), "bits"), "again")
    keep = ["page_id", "url", "payload", "n_bytes", "sha1", "original", "original_url"]
    alone = told.filter(~F.col("again") | (F.col("n_bytes") < least)).withColumns({"original": F.lit(None).cast("long"), "original_url": F.lit(None).cast("string")})
    # AQE splits the partition of a payload that many pages share.
    joined = told.filter(F.col("again") & (F.col("n_bytes") >= least)).join(groups.drop("key"), "sha256", "left")
    other = F.col("original").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("original")))
    joined = joined.withColumns({"original": F.when(other, F.col("original")), "original_url": F.when(other, F.col("original_url"))})
    return alone.select(keep).unionByName(joined.select(keep))


def write(resolved: DataFrame, path: str, records_per_file: int = 20_000) -> None:
    """Archives under path: a response or revisit record for each row, with fresh headers."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes"), F.lit(CRLF * 2))
    revisit = F.col("original").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("sha1"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", uri(F.col("url"))),
        line("X-Page-Id", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("original"), F.col("sha1"))), line("WARC-Refers-To-Target-URI", uri(F.col("original_url"))), line("WARC-Refers-To-Date", F.lit(DATE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
    )
    resolved.select(F.concat(head, block).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


#: What ends a record and begins the next one; payloads may hold it too.
BETWEEN = f"{CRLF * 2}WARC/1.1{CRLF}"


def record(content: bytes) -> tuple[dict[str, str], bytes] | None:
    """(headers, block) of a record from its first header on; None if its block isn't complete."""
    head, _, rest = content.partition(b"\r\n\r\n")
    headers = dict(line.decode().split(": ", 1) for line in head.split(b"\r\n"))
    n = int(headers["Content-Length"])
    if len(rest) < n:
        return None
    if rest[n:] not in (b"", b"\r\n\r\n"):
        raise ValueError("a record doesn't end where its length says")
    return headers, rest[:n]


def records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of archives cut at BETWEEN. A payload that was cut too is put together again."""
    between, start = BETWEEN.encode(), BETWEEN.encode()[4:]
    pending: list[bytes] = []
    size = need = 0
    for part in parts:
        pending.append(part if pending else part.removeprefix(start))
        size += len(part) + len(between)
        if size < need:
            continue
        content = between.join(pending)
        found = record(content)
        if found is None:
            need = content.index(b"\r\n\r\n") + int(re.search(rb"Content-Length: (\d+)", content)[1])
            continue
        yield found
        pending, size, need = [], 0, 0
    if pending:
        raise ValueError("an archive ends within a record")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, page_id, record_type, refers, payload_bytes, payload_digest) of every record.

    Archives are read as streams of records, so a task holds one batch of records, whatever the size of a file. The
    digest of a response is computed from its payload and checked against the header.
    """
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for h, block in records(x.as_buffer().to_pybytes() for batch in batches for x in batch.column(0)):
            kind, digest, n = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:"), None
            if kind == "response":
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                n = len(payload)
                if hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"{h['WARC-Record-ID']}: the payload doesn't have its digest")
            rows.append((h["WARC-Record-ID"], int(h["X-Page-Id"]) if h["X-Page-Id"] else None, kind, h.get("WARC-Refers-To"), n, digest))
            if len(rows) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    parts = spark.read.option("lineSep", BETWEEN).option("pathGlobFilter", "*.gz").text(path).select(F.col("value").cast("binary"))
    return parts.mapInArrow(run, "record_id string, page_id long, record_type string, refers string, payload_bytes long, payload_digest string")


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """A row per record, revisits resolved by a join with the responses that they refer to; one without its response is an error."""
    found = stored(read(spark, path), "records")[0]
    responses = found.filter("record_type = 'response'")
    # Records of one name have one page id and payload.
    targets = responses.groupBy(F.col("record_id").alias("refers")).agg(F.first("page_id").alias("refers_to"), F.first("payload_bytes").alias("bytes"))
    revisits = found.filter("record_type = 'revisit'").select("page_id", "record_type", "refers", "payload_digest").join(targets, "refers", "left")
    lost = F.raise_error(F.concat(F.lit("no response "), F.col("refers"))).cast("long")
    revisits = revisits.withColumn("payload_bytes", F.coalesce("bytes", lost))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(names).unionByName(revisits.select(names))


def op9_warc_revisits(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/plumbline-{uuid.uuid4().hex}/warc"
    shelf = Shelf(spark)
    write(resolve(spark.read.parquet(f"{sf_dir}/pages.parquet"), shelf=shelf), path)
    shelf.keep()
    return read_back(spark, path)


#: Equality of payloads is judged on the payloads themselves.
OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
o AS (SELECT html, max(page_id) AS original FROM p WHERE strlen(html) >= 1000 GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM p LEFT JOIN o USING (html)
"""
