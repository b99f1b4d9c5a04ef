"""WARC archives with an index: write records and their byte ranges first, then read selected ranges.

Every record is a gzip member of its own, so that a byte range holds a whole record. Each task writes archives under
names that no other attempt uses and returns index rows; the index is a table, and an archive of a lost attempt is in no
row of it. Reading sorts the selected index rows by file and offset and joins ranges that lie close into one read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covagrid.llm.common import byte_texts, cut, scratch_path

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
#: Fixed by the standard for records whose payload another record holds.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long"
READ = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, response: bool, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP head only and names the record that holds the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if response else head
    fields = [f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    fields += [f"WARC-Target-URI: {_uri(url)}"] * bool(url)
    fields += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Page-ID: {'' if page_id is None else page_id}"]
    if not response:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"Refers-To-Page-ID: {'' if refers_to is None else refers_to}"]
    return VERSION + b"\r\n" + "\r\n".join([*fields, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != VERSION.decode():
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(": "), "") for line in lines)
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record is longer or shorter than its Content-Length")
    return fields, rest[:size].partition(b"\r\n\r\n")[2]


def write_warc(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, roll_bytes: int = 1 << 28) -> DataFrame:
    """Write a record for every row of `pages` (page_id, url, html) under `folder` and return the index.

    Of rows with equal payloads of at least `min_revisit_bytes` that with the smallest page_id (nulls last; of rows that
    repeat it, one) is the response, the others revisit it. A null html is an empty payload, a null url has no target
    URI. Archives roll over at `roll_bytes`. An empty table gives an empty index.
    """
    staged = cut(
        pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), F.monotonically_increasing_id().alias("row_no")).withColumns({"sha1": F.unhex(F.sha1(F.encode("html", "UTF-8"))), "n": F.octet_length("html")}),
        "staged",
    )
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row_no")
    equal = staged.filter(F.col("n") >= min_revisit_bytes).groupBy("sha1").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("copies"))
    equal = cut(equal.filter("copies > 1").select("sha1", F.col("best.page_id").alias("first_page"), F.col("best.row_no").alias("first_row")), "firsts")
    rows = staged.join(equal, "sha1", "left").select("page_id", "url", "html", "first_page", (F.col("first_row").isNull() | (F.col("first_row") == F.col("row_no"))).alias("response"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = fs.FileSystem.from_uri(folder)
        files.create_dir(place, recursive=True)
        sink = None
        try:
            for batch in batches:
                out: list[tuple] = []
                columns = [batch.column(n).to_pylist() for n in ("page_id", "url", "first_page", "response")]
                for page_id, url, first, response, payload in zip(*columns, byte_texts(batch.column("html")), strict=True):
                    if sink is None or at >= roll_bytes:
                        if sink is not None:
                            sink.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        sink = files.open_output_stream(f"{place}/{name}", compression=None)
                        info = b"format: WARC File Format 1.1\r\n"
                        start = _gzip(VERSION + f"\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n")
                        sink.write(start)
                        at = len(start)
                    digest = sha1_base32(payload)
                    data = _gzip(record(page_id, url, payload, digest, response, first))
                    sink.write(data)
                    out.append((f"{folder}/{name}", at, len(data), url, digest, page_id, "response" if response else "revisit", None if response else first))
                    at += len(data)
                if out:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        finally:
            if sink is not None:
                sink.close()

    return cut(rows.mapInArrow(write, INDEX), "index")


def spans(rows: list[tuple[str, int, int]], gap: int, most: int) -> list[tuple[str, int, int, list[int]]]:
    """Reads (file, start, end, numbers of the rows inside) that cover sorted ranges; close ranges share a read."""
    out: list[list] = []
    for k, (file, offset, length) in enumerate(rows):
        last = out[-1] if out else None
        if last and last[0] == file and offset - last[2] <= gap and offset + length - last[1] <= most:
            last[2] = max(last[2], offset + length)
            last[3].append(k)
        else:
            out.append([file, offset, offset + length, [k]])
    return [tuple(x) for x in out]


def read_warc(index: DataFrame, payloads: bool = True, gap: int = 1 << 16, most: int = 1 << 23) -> DataFrame:
    """Read the records of the rows of `index`: page_id, record_type, refers_to, payload_bytes, payload_digest, payload.

    Reads are dealt out by the bytes of the records, of which a task gets about `most`: the index itself is far smaller.

    Bytes and digest of a response are those of the payload that was read, which must agree with its digest field. A
    revisit has the digest field's value and null bytes and payload. Rows that repeat an index row are read again.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(n).to_pylist() for n in ("file", "offset", "length")), strict=True))
            for file, start, end, inside in spans(rows, gap, most):
                if file != name:
                    files, place = fs.FileSystem.from_uri(file)
                    name, source = file, files.open_input_file(place)
                data = source.read_at(end - start, start)
                out = []
                for k in inside:
                    at = rows[k][1] - start
                    fields, payload = parse(zlib.decompress(data[at : at + rows[k][2]], 31))
                    response, said = fields["WARC-Type"] == "response", fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if response and sha1_base32(payload) != said:
                        raise ValueError(f"the payload in {file} at {rows[k][1]} disagrees with its digest")
                    number = [int(x) if (x := fields.get(f, "")) else None for f in ("Page-ID", "Refers-To-Page-ID")]
                    out.append((number[0], fields["WARC-Type"], number[1], len(payload) if response else None, said, payload if response and payloads else None))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in READ.split(", ")])

    tasks = (index.agg(F.sum("length")).first()[0] or 0) // most + 1
    selected = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return selected.mapInArrow(read, READ)


def warc_round_trip(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from the archives.

    A revisit's size is that of the response it refers to. `folder` is a new one in the shared folder unless given. Null
    page_ids and repeated rows are pages like any other, long pages are records like any other, and other columns are
    ignored whatever their names. An empty table gives an empty result.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    back = cut(read_warc(write_warc(pages, folder, min_revisit_bytes), payloads=False).drop("payload"), "read")
    held = back.filter("record_type = 'response'").select(F.col("page_id").alias("held_id"), F.col("payload_digest").alias("held_digest"), F.col("payload_bytes").alias("held_bytes"))
    revisits = back.filter("record_type = 'revisit'").drop("payload_bytes")
    resolved = revisits.join(held, (F.col("payload_digest") == F.col("held_digest")) & F.col("refers_to").eqNullSafe(F.col("held_id"))).withColumnRenamed("held_bytes", "payload_bytes")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return back.filter("record_type = 'response'").select(columns).unionByName(resolved.select(columns))
