"""WARC archives with revisit records.

Headers are shuffled by payload digest to find, of equal payloads, the one that stays a response; the others
become revisit records that name it. Spark's own text writer puts the records out, with the record separator
as its line separator, so archives go to any file system that Spark writes; the reader parses whole archive
files inside tasks and joins revisits to their responses.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartlake.llm.common import reshuffled, staged

#: Fixed values of the WARC 1.1 format.
VERSION, END = "WARC/1.1", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "record_id string, record_type string, page_id long, url string, refers_to_id string, payload_digest string, payload binary"


def _record_id(page_id: Column, digest: Column) -> Column:
    return F.regexp_replace(F.md5(F.concat_ws("/", page_id.cast("string"), digest).cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def resolve(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Revisits only: page_id, digest, and the page_id, url of the response they refer to.

    Of payloads that are equal and have min_bytes at least, the smallest page_id is the response.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    heads = pages.select("page_id", "url", F.sha2(payload, 256).alias("digest"), F.length(payload).alias("n")).where(F.col("n") >= min_bytes).drop("n")
    first = heads.where("page_id is not null").groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("c"))
    return heads.drop("url").join(reshuffled(first), "digest").where(~F.col("page_id").eqNullSafe(F.col("first.page_id"))).select("page_id", "digest", F.col("first.page_id").alias("to_page"), F.col("first.url").alias("to_url")).distinct()


def write_archives(pages: DataFrame, path: str, min_bytes: int = 100, date: str = "2020-01-01T00:00:00Z", max_records: int = 20_000) -> None:
    """Write a record per page (page_id, url, html) to gzipped archive files under path.

    A null html is an empty payload; a null url is left out of the header. Rows repeated with the same page_id
    and payload are all written as responses. An empty table writes an archive without records. Very long pages are
    written whole; other columns, whatever their names, are not read. The reader holds one compressed archive file and one record
    at a time, so max_records times the mean size of a page should stay well below 2 GB.
    """
    text = F.coalesce(F.col("html"), F.lit(""))
    digest = F.sha2(text.cast("binary"), 256)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace("url", r"[\r\n]", "").alias("url"), text.alias("html"), digest.alias("digest"))
    rev = resolve(pages.select("page_id", "url", "html"), min_bytes).select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), "to_page", "to_url", F.lit(True).alias("revisit"))
    p = p.join(rev, p["page_id"].eqNullSafe(rev["__page"]) & (p["digest"] == rev["__digest"]), "left")
    again = F.coalesce("revisit", F.lit(False))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(again, "").otherwise(F.col("html")))
    record = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit(f"\r\nWARC-Date: {date}\r\n"),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))), line("WARC-Target-URI", F.col("url")), line("WARC-Page-ID", F.col("page_id")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), F.lit("Content-Type: application/http; msgtype=response\r\n"),
        F.when(again, F.concat(F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\n"), line("WARC-Refers-To", _record_id(F.col("to_page"), F.col("digest"))), line("WARC-Refers-To-Target-URI", F.regexp_replace("to_url", r"[\r\n]", "")))).otherwise(""),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
    )
    p.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max_records).text(path)


def records_in(archive: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an uncompressed archive, read one record at a time."""
    while version := archive.readline():
        if version != f"{VERSION}\r\n".encode():
            raise ValueError(f"no WARC record at {version[:40]!r}")
        head: dict[str, str] = {}
        while (line := archive.readline()) != b"\r\n":
            if not line:
                raise ValueError("the archive ends within a header")
            name, value = line.decode().removesuffix("\r\n").split(": ", 1)
            head[name] = value
        block = archive.read(int(head["Content-Length"]))
        if archive.read(4) != END.encode():
            raise ValueError(f"the record {head.get('WARC-Record-ID')} has a wrong length")
        yield head, block


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["record_id", "record_type", "page_id", "url", "refers_to_id", "payload_digest", "payload"])

    for b in batches:
        for content in b.column(0):
            rows, held = [], 0
            for head, block in records_in(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                page = head.get("WARC-Page-ID")
                rows.append((head["WARC-Record-ID"], head["WARC-Type"], None if page is None else int(page), head.get("WARC-Target-URI"), head.get("WARC-Refers-To"), head["WARC-Payload-Digest"].removeprefix("sha256:"), payload))
                held += len(payload)
                if held > 4 << 20:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record under path: record_id, record_type, page_id, url, refers_to_id, payload_digest (of the header), payload (empty for revisits).

    A page id or url that the header lacks is null; repeated records are all returned; archives without records give no rows; a record is
    read whole, however long. Bytes that are no record, or a length that does not fit, end the read with an error.
    """
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(_parse, _RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """Per record page_id, payload_bytes, payload_digest, record_type, refers_to, where a revisit's figures are measured on its response's payload.

    Null page ids stay null, repeated rows stay repeated, no records give no rows; payloads are measured whole, however long; columns
    other than those of a record are not read. A revisit whose response is missing has null figures and refers to nothing.
    """
    # what follows reads the headers three times: they are staged, so that the archives are parsed once
    r = staged(records.select("record_id", "record_type", "page_id", "refers_to_id", F.length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest")), "heads")
    origin = r.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.min("page_id").alias("to_page"), F.min("bytes").alias("to_bytes"), F.min("digest").alias("to_digest"))
    # responses refer to nothing and are not joined
    own = r.where("record_type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = r.where("record_type <> 'response'").join(reshuffled(origin), "refers_to_id", "left").select("page_id", F.col("to_bytes").alias("payload_bytes"), F.col("to_digest").alias("payload_digest"), "record_type", F.col("to_page").alias("refers_to"))
    return own.unionByName(again)
