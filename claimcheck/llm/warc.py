"""WARC archives: written by Spark as plain files, read back by a reader that survives damage.

Equal payloads are stored once: the page with the smallest id gets the response, others a
revisit record that names it. The reader checks every record (version line, header, length,
digest, end mark). Where a check fails it searches for the next version line or compressed
member at which a whole record passes, goes on there, and logs the bytes between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimcheck.llm.shared import shared_dir, written

END = "\r\n\r\n"
ARCHIVE_BYTES = 16 << 20
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS = (
    "archive string, kind string, at long, length long, record_type string, record_id string, refers_to string, "
    "uri string, payload_digest string, payload_bytes long, payload binary"
)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 hex digits as eight groups of 20 bits, four letters each."""
    digest = F.sha1(payload)

    def group(i: Column) -> Column:
        bits = F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        letters = [F.shiftright(bits, 15 - 5 * j).bitwiseAND(F.lit(31)) for j in range(4)]
        return F.concat(*[F.substring(F.lit(BASE32), x + 1, F.lit(1)) for x in letters])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), group), "")


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def records(pages: DataFrame, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(record): the WARC record of each row of pages: page_id, url, html, without its end mark.

    Null html is an empty payload. Payloads of `min_bytes` and more that are equal share one
    response; rows that repeat the smallest page_id are all responses. Control characters and
    spaces in a url are percent-encoded; a null url is about:blank. Other columns are not read.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long"), F.coalesce("url", F.lit("about:blank")).alias("url"), html.alias("html"), base32_sha1(html).alias("digest")
    ).withColumn("n", F.octet_length("html"))
    # Written, so that the join knows its size: Spark broadcasts it only if it is small.
    leaders = written(
        rows.where(F.col("n") >= min_bytes)
        .groupBy("digest", "n")
        .agg(F.count("*").alias("copies"), F.min("page_id").alias("leader"))
        .where("copies > 1")
        .select(F.col("digest").alias("leader_digest"), F.col("n").alias("leader_n"), "leader"),
        "payload-leaders",
    )
    joined = rows.join(leaders, (rows["digest"] == leaders["leader_digest"]) & (rows["n"] == leaders["leader_n"]), "left")
    revisit = F.coalesce(F.col("leader") != F.col("page_id"), F.lit(False))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END)
    )
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("html")))
    url = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f]", "%20")
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("block")))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Refers-To", _urn(F.col("leader"))),
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ),
        ).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit(END),
    )
    return joined.withColumn("block", block).select(F.concat(header, F.col("block")).alias("record"))


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write the archives and return their folder. Files hold about `archive_bytes` each, and whole records."""
    folder = folder or shared_dir(pages.sparkSession, "warc")
    n, size = pages.agg(F.count("*"), F.sum(F.octet_length("html") + 600)).first()
    per_file = max(1, int(archive_bytes * n / (size or 1))) if n else 1
    # A text file whose line end is the end mark of a record is a WARC file.
    records(pages, min_bytes).write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(folder)
    return folder


def _base32(block: bytes) -> str:
    return base64.b32encode(hashlib.sha1(block).digest()).decode()


def parse_record(data: bytes, at: int) -> tuple[int, dict[str, str], bytes] | None:
    """(end, header, block) of the record at `at`, or None if any check fails."""
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0 or not data.startswith(b"WARC/1.", at):
        return None
    try:
        lines = data[at:stop].decode().split("\r\n")
        header = dict(line.split(": ", 1) for line in lines[1:])
        size = int(header["Content-Length"])
    except (ValueError, KeyError):
        return None
    begin, end = stop + 4, stop + 4 + size
    if size < 0 or data[end : end + 4] != b"\r\n\r\n":
        return None
    block = data[begin:end]
    claimed = header.get("WARC-Block-Digest", "")
    if claimed.startswith("sha1:") and claimed[5:] != _base32(block):
        return None
    return end + 4, header, block


def parse_member(data: bytes, at: int) -> tuple[int, list[tuple[dict[str, str], bytes]]] | None:
    """(end, records) of the compressed member at `at`, or None if it or a record in it is damaged."""
    machine = zlib.decompressobj(31)
    try:
        plain = machine.decompress(memoryview(data)[at:])
    except zlib.error:
        return None
    if not machine.eof:
        return None
    found, inner = [], 0
    while inner < len(plain):
        record = parse_record(plain, inner)
        if record is None:
            return None
        inner, *rest = record
        found.append(tuple(rest))
    return (len(data) - len(machine.unused_data), found) if found else None


START = re.compile(rb"WARC/1\.|\x1f\x8b\x08")


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict[str, str], bytes]]:
    """(kind, at, length, header, block) of every whole record, and of every gap that no record covers."""
    at = done = 0
    while done < len(data):
        found = parse_record(data, at) if data[at : at + 1] == b"W" else None
        end, inside = (found[0], [found[1:]]) if found else parse_member(data, at) or (0, [])
        if inside:
            if done < at:
                yield "gap", done, at - done, {}, b""
            for header, block in inside:
                yield "record", at, end - at, header, block
            at = done = end
            continue
        candidate = START.search(data, at + 1)
        if candidate is None:
            yield "gap", done, len(data) - done, {}, b""
            return
        at = candidate.start()


def _http(block: bytes) -> tuple[int | None, bytes]:
    """The length that an HTTP head states, and the body."""
    head, _, body = block.partition(b"\r\n\r\n")
    stated = re.search(rb"(?im)^content-length: *([0-9]+)", head)
    return (int(stated[1]) if stated else None), body


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records and gaps of all archives in `folder`: kind record or gap, `at` and `length` in bytes.

    payload_bytes is the full payload's length for revisits too. An empty file gives no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORDS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                path, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows, held = [], 0
                for kind, at, length, header, block in salvage(data):
                    stated, body = _http(block) if kind == "record" else (None, b"")
                    digest = header.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
                    urns = [header.get(f"WARC-{x}") for x in ("Record-ID", "Refers-To", "Target-URI")]
                    rows.append((path, kind, at, length, header.get("WARC-Type"), *urns, digest, stated, body))
                    held += length
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return files.mapInArrow(run, RECORDS)


def page_records(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of the archives' records."""
    number = lambda c: F.regexp_extract(c, r"urn:page:(-?[0-9]+)", 1).try_cast("long")
    return archives.where("kind = 'record'").select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number(F.coalesce("refers_to", F.lit(""))).alias("refers_to"),
        "payload",
    )
