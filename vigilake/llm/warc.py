"""Legacy archives (ARC) to WARC, written and read back with Spark.

An ARC archive starts with a version block and goes on with records, one after the other: a header line of fields
parted by spaces, whose last is the length in bytes of what follows.  Version 1 has five fields, version 2 ten.  The
converter reads the version from the block, each header line by its version, and each payload by its declared
length; what can't be read is a reject.  It makes up what WARC needs besides: record identifier, timestamp, type and
payload digest.

WARC archives are written by Spark's text writer: records end with two line ends, which is how WARC parts them.
They are read back whole file by whole file by declared lengths; a file's bytes are bounded, but for single records.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.llm.scratch import Scratch

# Fixed values of the two formats.
ARC_FIELDS = {
    1: ["url", "ip", "date", "type", "length"],
    2: ["url", "ip", "date", "type", "result", "checksum", "location", "offset", "file", "length"],
}
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


ARC_NAMES = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}


def arc_header(version: int, url: str, date: str, kind: str, length: int) -> bytes:
    more = " 200 - - 0 legacy.arc" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} {kind}{more} {length}\n".encode()


def version_block(version: int, date: str) -> bytes:
    body = f"{version} 0 Legacy\n{ARC_NAMES[version]}\n\n".encode()
    return arc_header(version, "filedesc://legacy.arc", date, "text/plain", len(body)) + body


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str]]:
    """(fields, payload, why): the records of an archive in order; ``why`` is empty, or why a record can't be read.

    "version": no known version, the whole archive is one reject; "length": no length to go on by, or fewer bytes than
    declared, the rest is one reject; "fields": another number of fields than the version has.
    """
    stop = data.find(b"\n")
    size = data[:stop].rsplit(b" ", 1)[-1] if stop >= 0 else b""
    at = stop + 1 + int(size) if size.isdigit() else len(data)
    number = data[stop + 1 : stop + 3].strip()
    names = ARC_FIELDS.get(int(number)) if number.isdigit() else None
    if names is None:
        yield {}, data, "version"
        return
    while at < len(data):
        if data[at : at + 1] == b"\n":  # the line end behind a payload
            at += 1
            continue
        stop = data.find(b"\n", at)
        values = data[at : stop if stop >= 0 else len(data)].decode("utf-8", "replace").split(" ")
        size = values[-1]
        if stop < 0 or not size.isdigit() or stop + 1 + int(size) > len(data):
            yield {}, data[at:], "length"
            return
        payload = data[stop + 1 : stop + 1 + int(size)]
        fine = len(values) == len(names)
        yield dict(zip(names, values, strict=True)) if fine else {}, payload, "" if fine else "fields"
        at = stop + 1 + int(size)


def arc_archives(pages: DataFrame, id_col: str, url_col: str, body_col: str, date: str = "19990101000000", archive_bytes: int = 4 << 20) -> DataFrame:
    """(ids array<long>, content binary): pages as legacy archives of about ``archive_bytes``, versions in turn by id.

    ``ids`` names the records in order, as an index of the archive would.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, tuple[list, list]] = {}
        size = {1: 0, 2: 0}

        def done(version: int) -> pa.RecordBatch:
            ids, parts = open_.pop(version)
            size[version] = 0
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([b"".join([version_block(version, date), *parts])], pa.binary())], names=["ids", "content"])

        for batch in batches:
            for page, url, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                version = 1 if (page or 0) % 2 == 0 else 2
                payload = (body.as_py() or "").encode()
                ids, parts = open_.setdefault(version, ([], []))
                ids.append(page)
                parts += [arc_header(version, re.sub(r"\s", "%20", url) if url else "-", date, "text/html", len(payload)), payload, b"\n"]
                size[version] += len(payload) + 100
                if size[version] >= archive_bytes:
                    yield done(version)
        for version in list(open_):
            yield done(version)

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(body_col).alias("body"))
    return rows.mapInArrow(go, "ids array<long>, content binary")


def read_arc(archives: DataFrame) -> DataFrame:
    """(page_id, url, date, payload binary, why): the records of archives (ids, content); rejects say why."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string())
        for batch in batches:
            for ids, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = [(ids[n] if n < len(ids) else None, f.get("url"), f.get("date"), payload, why) for n, (f, payload, why) in enumerate(parse_arc(content.as_py()))]
                cols = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["page_id", "url", "date", "payload", "why"])

    return archives.mapInArrow(go, "page_id long, url string, date string, payload binary, why string")


def _record_id(page_id: Column, digest: Column) -> Column:
    """The record identifier of a page: made from its id and payload, so that revisits can name it."""
    h = F.md5(F.concat(F.lit("page "), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(" "), digest))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def revisits(digests: DataFrame, least: int) -> DataFrame:
    """(page_id, digest, size, refers_to): pages that share a payload of at least ``least`` bytes with a page of a larger id."""
    long = digests.filter((F.col("size") >= least) & F.col("page_id").isNotNull())
    groups = long.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return long.distinct().join(groups, ["digest", "size"]).filter("page_id <> refers_to")


def to_warc(parsed: DataFrame, least: int = 1000) -> DataFrame:
    """(record string, bytes long): WARC 1.1 records of legacy records that could be read, the type from ``revisits``."""
    sums = parsed.filter("why = ''").select("page_id", "url", "date", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    again = revisits(sums.select("page_id", "digest", "size"), least)
    rows = sums.join(again, ["page_id", "digest", "size"], "left")
    at = F.concat(F.substring("date", 1, 4), F.lit("-"), F.substring("date", 5, 2), F.lit("-"), F.substring("date", 7, 2), F.lit("T"), F.substring("date", 9, 2), F.lit(":"), F.substring("date", 11, 2), F.lit(":"), F.substring("date", 13, 2), F.lit("Z"))
    first = F.col("refers_to").isNull()
    body = F.when(first, F.col("payload").cast("string")).otherwise(F.lit(""))
    n = F.lit(len(HTTP_HEAD)) + F.when(first, F.col("size")).otherwise(0)
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(first, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), _record_id(F.col("page_id"), F.col("digest")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), at),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(~first, F.concat(F.lit("WARC-Refers-To: <urn:uuid:"), _record_id(F.col("refers_to"), F.col("digest")), F.lit(f">{END}WARC-Profile: {REVISIT_PROFILE}"))),
        F.concat(F.lit("Page-Id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("-"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), n.cast("string")),
    ]
    return rows.select(F.concat(F.concat_ws(END, *lines), F.lit(END + END + HTTP_HEAD), body).alias("record"), n.alias("bytes"))


# Records of so many bytes are written so many to a file: about 100 MB, or one record.
_TIERS = [(0, 1 << 18, 400), (1 << 18, 1 << 22, 25), (1 << 22, None, 1)]


def write_warc(records: DataFrame, path: str, largest: int | None = None) -> None:
    """Write (record, bytes) to archives of bounded size, compressed for speed.

    ``largest``: a bound on ``bytes``, if one is known: then tiers above it aren't looked for.
    """
    for lo, hi, most in _TIERS:
        if largest is not None and largest < lo:
            break
        rows = records.filter(F.col("bytes") >= lo) if hi is None else records.filter(F.col("bytes").between(lo, hi - 1))
        rows = records if largest is not None and hi and largest < hi and not lo else rows
        rows.select("record").write.mode("append").option("lineSep", END + END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", most).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by declared lengths."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:stop].decode().split(END)
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines)
        n = int(head["Content-Length"])
        yield head, data[stop + 4 : stop + 4 + n]
        at = stop + 4 + n + 4


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            out = []
            for head, block in parse_warc(gzip.decompress(content.as_py())):
                payload = block.split(b"\r\n\r\n", 1)[1]
                full = head["WARC-Type"] == "response"
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if full and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"digest of {head['WARC-Record-ID']} doesn't match")
                page = head["Page-Id"]
                out.append((None if page == "-" else int(page), head["WARC-Record-ID"], head["WARC-Type"], digest, len(payload) if full else None, head.get("WARC-Refers-To")))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["page_id", "record_id", "type", "digest", "size", "refers"])


def read_warc(spark, path: str) -> DataFrame:
    """(page_id, record_id, type, digest, size, refers): the records of archives; size is null for revisits."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read, "page_id long, record_id string, type string, digest string, size long, refers string")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 1000) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) per row of ``pages``, as read from archives.

    Null bodies are empty payloads, null urls "-".  Rows that repeat an id get a record each, of the same identifier
    if their payloads are equal, and then don't refer to themselves.  Rows with a null id are responses.  An
    empty table gives no rows.  Text is written as UTF-8; other columns are ignored.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "warc")
    path = scratch.path()
    largest = pages.agg(F.max(F.octet_length(body_col))).first()[0] or 0
    write_warc(to_warc(read_arc(arc_archives(pages, id_col, url_col, body_col)), least), path, largest + len(HTTP_HEAD))
    got = scratch.save(read_warc(spark, path))
    full = got.filter("type = 'response'").groupBy(F.col("record_id").alias("refers")).agg(F.max("page_id").alias("refers_to"), F.max("size").alias("full"))
    back = got.filter("type = 'revisit'").join(full, "refers")
    here = got.filter("type = 'response'").select("*", F.lit(None).cast("long").alias("refers_to"), F.col("size").alias("full"))
    return here.unionByName(back).select(F.col("page_id").alias(id_col), F.col("full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
