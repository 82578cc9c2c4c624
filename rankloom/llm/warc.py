"""WARC archives without repeated payloads.

Revisit resolution: only headers (identifier, payload digest and size) are shuffled by digest to
find payloads that occur more than once; the capture with the largest identifier stays a response,
the others become revisits that refer to it. Revisits are written from their headers alone. Payloads are read by the pass that writes
the responses, which only has to know the record identifiers of the revisits: up to `SENT` of them are sent to every executor,
more are joined. Archives are written with fresh headers by Spark's text writer, whose line separator is the blank line that ends a record,
so that each part file is a sequence of WARC/1.1 records, compressed as a whole. Responses are written in a pass for each class of sizes that
occurs, so that a file holds no more than about `FILE_BYTES` before that, or one record, whatever the tail of the sizes. Reading takes each file apart by its
Content-Length headers, once, and joins revisits back to their responses by record identifier.

A response holds an HTTP head and the payload, a revisit the head alone; a payload digest is that of the payload.
Records of other kinds (warcinfo, request and so on) are read as they are; what a record has no header for is null, and only
digests written in hexadecimal SHA-1 are checked.

Null payload: empty. Null URL: no target header. Payloads under `least` bytes are always
responses. Rows that share the largest identifier and payload are all responses; the revisits then
refer to that one identifier. A null identifier comes before all others. Control characters of a
URL are percent-encoded. Record identifiers follow from identifier, URL and payload, so a task that
runs again writes the same archive. Other columns of the table play no part.
"""

from __future__ import annotations

import gzip
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.lineage import checked_broadcast, new_path, written

DATE = "2024-01-01T00:00:00Z"
LEAST = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: Bytes of records in one archive file at the most (or one record), of a record's own lines, about, and the bounds of the classes of payload sizes.
FILE_BYTES, HEAD_BYTES = 32 << 20, 500
SIZES = tuple(1 << k for k in range(12, 25, 3))
#: Record identifiers that are sent to every executor at the most.
SENT = 500_000
#: The head of every response. The lines that end it and a record.
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("\x01")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def captured(df: DataFrame, *, key: str, url: str, payload: str) -> DataFrame:
    """(key, url, payload, size, class): the class bounds a payload's size by SIZES."""
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long"))
    return rows.withColumn("class", sum(((F.col("size") > n).cast("int") for n in SIZES), F.lit(0)))


def identified(rows: DataFrame) -> DataFrame:
    """`rows` with digest and record identifier."""
    digest = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    return digest.withColumn("id", record_id(F.col("key"), F.col("url"), F.col("digest")))


def revisits_of(heads: DataFrame, least: int = LEAST) -> DataFrame:
    """(id, refers_key, refers_id) of the captures (key, id, digest, size) that are revisits."""
    headers = heads.where(F.col("size") >= least).select("key", "id", "digest", "size")
    first = headers.groupBy("digest", "size").agg(F.count("*").alias("n"), F.max(F.struct("key", "id")).alias("top")).where("n > 1")
    winners = first.select("digest", "size", F.col("top.key").alias("refers_key"), F.col("top.id").alias("refers_id"))
    return headers.join(winners, ["digest", "size"]).where(~F.col("key").eqNullSafe(F.col("refers_key"))).select("id", "refers_key", "refers_id").dropDuplicates(["id"])


def records(found: DataFrame, date: str = DATE) -> DataFrame:
    """One string for each record, without the blank line that ends it."""
    uri = F.col("url").cast("string")
    for code in (*range(32), 127):
        uri = F.replace(uri, F.lit(chr(code)), F.lit(f"%{code:02X}")) if code in (0, 9, 10, 13, 127) else uri
    is_revisit = F.col("refers_id").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.col("id")),
        line("WARC-Date", F.lit(date)),
        optional("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        optional("WARC-Refers-To", F.col("refers_id")),
        F.when(is_revisit, line("WARC-Profile", F.lit(PROFILE))).otherwise(""),
        optional("X-Capture-Key", F.col("key")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", len(HTTP) + F.when(is_revisit, 0).otherwise(F.col("size"))),
        F.lit("\r\n" + HTTP),
    )
    return found.select(F.concat(head, F.when(is_revisit, "").otherwise(F.col("payload"))).alias("value"))


def write(df: DataFrame, path: str, *, key: str, url: str, payload: str, least: int = LEAST, date: str = DATE) -> None:
    """Write `df` as archives under `path`: `revisits`, and a folder of responses for each class of sizes that occurs."""
    rows = captured(df, key=key, url=url, payload=payload)
    heads = written(identified(rows).select("key", "url", "id", "digest", "size", "class"))
    revisits = written(revisits_of(heads, least))

    def save(found: DataFrame, name: str, bytes_each: int) -> None:
        records(found, date).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(1, FILE_BYTES // (bytes_each + HEAD_BYTES))).text(f"{path}/{name}")

    save(heads.join(revisits, "id").withColumn("payload", F.lit("")), "revisits", 0)
    gone = checked_broadcast(revisits.select("id"), SENT)
    for c in sorted(r["class"] for r in heads.select("class").distinct().collect()):  # at most one more than SIZES
        found = identified(rows.where(F.col("class") == c)).join(gone, "id", "left_anti").withColumn("refers_id", F.lit(None).cast("string"))
        save(found, f"responses-{c}", SIZES[c] if c < len(SIZES) else FILE_BYTES)


def opened(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def parsed(data: bytes):
    """(headers, payload) of each record of one archive."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)}
        begin = stop + 4
        end = begin + int(headers["content-length"])
        block = data[begin:end]
        yield headers, block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
        at = end + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, key, uri, digest, refers_id, payload) of every record of the archives in `path`."""
    import hashlib

    names = {"id": "WARC-Record-ID", "type": "WARC-Type", "key": "X-Capture-Key", "uri": "WARC-Target-URI", "digest": "WARC-Payload-Digest", "refers_id": "WARC-Refers-To"}

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                found = []
                for headers, payload in parsed(opened(batch.column(0)[i].as_py())):
                    own = {n: headers.get(h.lower()) for n, h in names.items()}
                    own["digest"] = own["digest"] and own["digest"].removeprefix("sha1:")
                    if own["type"] == "response" and re.fullmatch("[0-9a-f]{40}", own["digest"] or "") and hashlib.sha1(payload).hexdigest() != own["digest"]:
                        raise ValueError(f"payload of {own['id']} does not match its digest")
                    found.append([*own.values(), payload])
                    if len(found) >= 500:
                        yield rows(found)
                        found = []
                if found:
                    yield rows(found)

    def rows(found):
        kinds = [*[pa.string()] * len(names), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=[*names, "payload"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"{n} string" for n in names) + ", payload binary")


def revisits_resolved(archive: DataFrame) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to): revisits have the payload of the response they refer to."""
    heads = written(archive.select("id", "type", "key", "digest", "refers_id", F.octet_length("payload").cast("long").alias("size")))
    responses = heads.where("type = 'response'").groupBy(F.col("id").alias("refers_id")).agg(F.first("key").alias("to"), F.first("size").alias("full"))
    found = heads.where("type = 'revisit'").join(responses, "refers_id", "left").select("key", F.col("full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("to").alias("refers_to"))
    return heads.where("type = 'response'").select("key", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("string").alias("refers_to")).unionByName(found)


def round_trip(df: DataFrame, *, key: str, url: str, payload: str, least: int = LEAST, path: str | None = None) -> DataFrame:
    """Write `df` as deduplicated archives under `path` (a new folder in the shared one) and read them back."""
    spark = df.sparkSession
    path = path or new_path(spark, "warc")
    write(df, path, key=key, url=url, payload=payload, least=least)
    return revisits_resolved(read(spark, path))
