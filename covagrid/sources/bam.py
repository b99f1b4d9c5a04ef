"""BAM files: BGZF blocks, records, and the BAI index that says where to start.

With an index beside it, a file is read by ranges of virtual offsets that begin at records, in parallel, and only those
ranges that the regions' bins name. Without one it is one stream, as no block tells where its first record begins.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from covagrid.errors import BadRecord
from covagrid.sources.regions import parse_regions
from covagrid.sources.sam import READS, open_path

# Fixed by the format.
OPS = "MIDNSHP=X"
NIBBLES = "=ACMGRSVTWYHKDBN"
_PAIRS = [a + b for a in NIBBLES for b in NIBBLES]
_TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
LINEAR_SHIFT = 14
SPLIT_BYTES = 1 << 23


class Blocks:
    """The uncompressed bytes from a virtual offset on, block by block."""

    def __init__(self, source: pa.NativeFile, virtual: int = 0):
        self.source, self.size = source, source.size()
        self.next, self.data, self.start = virtual >> 16, b"", virtual >> 16
        self.at = 0
        if self._load():
            self.at = virtual & 0xFFFF

    def _load(self) -> bool:
        while self.next < self.size:
            head = self.source.read_at(18, self.next)
            if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
                raise BadRecord(f"no BGZF block at byte {self.next}")
            extra, at, total = struct.unpack_from("<H", head, 10)[0], 12, None
            fields = head[12:] if extra <= 6 else self.source.read_at(extra, self.next + 12)
            while at - 12 < extra:
                tag, n = fields[at - 12 : at - 10], struct.unpack_from("<H", fields, at - 10)[0]
                if tag == b"BC":
                    total = struct.unpack_from("<H", fields, at - 8)[0] + 1
                at += 4 + n
            if total is None:
                raise BadRecord(f"the block at byte {self.next} has no size")
            packed = self.source.read_at(total, self.next)
            self.start, self.next, self.at = self.next, self.next + total, 0
            self.data = zlib.decompress(packed[12 + extra : -8], -15)
            if self.data:
                return True
        self.data, self.at = b"", 0
        return False

    def virtual(self) -> int:
        """Where the next byte is."""
        if self.at >= len(self.data) and not self._load():
            return self.size << 16
        return self.start << 16 | self.at

    def read(self, n: int) -> bytes:
        parts = []
        while n:
            if self.at >= len(self.data) and not self._load():
                raise BadRecord("the file ends inside a record")
            part = self.data[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
        return b"".join(parts)


def read_header(blocks: Blocks) -> list[tuple[int, str, int]]:
    if blocks.read(4) != b"BAM\1":
        raise BadRecord("not a BAM file")
    blocks.read(struct.unpack("<i", blocks.read(4))[0])
    refs = []
    for tid in range(struct.unpack("<i", blocks.read(4))[0]):
        name = blocks.read(struct.unpack("<i", blocks.read(4))[0])[:-1].decode("latin-1")
        refs.append((tid, name, struct.unpack("<i", blocks.read(4))[0]))
    return refs


def _bq(data: bytes, at: int) -> str | None:
    while at + 3 <= len(data):
        tag, kind = data[at : at + 2], chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            if tag == b"BQ":
                return data[at:end].decode("latin-1")
            at = end + 1
        elif kind == "B":
            at += 5 + _TAG_SIZES[chr(data[at])] * struct.unpack_from("<i", data, at + 1)[0]
        else:
            at += _TAG_SIZES[kind]
    return None


def decode(data: bytes, virtual: int, names: list[str]) -> tuple:
    """One record without its size, in the order of the reads' columns."""
    tid, pos, n_name, mapq, _, n_ops, flag, n_seq, mtid, mpos, tlen = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32 + n_name
    qname = data[32 : at - 1].decode("latin-1")
    cigar = [{"op": OPS[x & 15], "len": x >> 4} for x in struct.unpack_from(f"<{n_ops}I", data, at) if x >> 4]
    at += 4 * n_ops
    seq = "".join([_PAIRS[b] for b in data[at : at + (n_seq + 1) // 2]])[:n_seq]
    at += (n_seq + 1) // 2
    qual = list(data[at : at + n_seq])
    return virtual, qname, flag, tid, names[tid] if tid >= 0 else "*", pos, mapq, cigar, mtid, mpos, tlen, seq, qual, _bq(data, at + n_seq)


def read_index(data: bytes) -> list[tuple[dict[int, list[tuple[int, int]]], list[int]]]:
    """(chunks of each bin, linear index) of each reference."""
    if data[:4] != b"BAI\1":
        raise BadRecord("not a BAI index")
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        bins: dict[int, list[tuple[int, int]]] = {}
        (n,) = struct.unpack_from("<i", data, at)
        at += 4
        for _ in range(n):
            number, chunks = struct.unpack_from("<Ii", data, at)
            flat = struct.unpack_from(f"<{2 * chunks}Q", data, at + 8)
            at += 8 + 16 * chunks
            if number != 37450:  # that one holds counts
                bins[number] = list(zip(flat[::2], flat[1::2], strict=True))
        (n,) = struct.unpack_from("<i", data, at)
        out.append((bins, list(struct.unpack_from(f"<{n}Q", data, at + 4))))
        at += 4 + 8 * n
    return out


def bins_of(start: int, stop: int) -> list[int]:
    """The bins that may hold reads over [start, stop)."""
    out, last = [0], max(start, stop - 1)
    for first, shift in ((1, 26), (9, 23), (73, 20), (585, 17), (4681, 14)):
        out += range(first + (start >> shift), first + (last >> shift) + 1)
    return out


def ranges(index: list, first: int, end: int, wanted: list[tuple[int, int, int]] | None) -> list[tuple[int, int]]:
    """Virtual ranges to read: those of the regions (tid, start, stop), or the whole file cut at indexed records."""
    if wanted is None:
        marks = sorted({x for bins, linear in index for x in [*linear, *(a for chunks in bins.values() for a, _ in chunks)] if x > first})
        cuts = [first]
        for mark in marks:
            if (mark >> 16) - (cuts[-1] >> 16) >= SPLIT_BYTES:
                cuts.append(mark)
        return list(zip(cuts, [*cuts[1:], end], strict=True))
    found = []
    for tid, start, stop in wanted:
        bins, linear = index[tid]
        least = linear[min(start >> LINEAR_SHIFT, len(linear) - 1)] if linear else 0
        found += [(max(a, least), b) for number in bins_of(start, min(stop, 1 << 29)) for a, b in bins.get(number, []) if b > least]
    merged: list[list[int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [tuple(x) for x in merged]


def read_bam(spark: SparkSession, path: str, regions: str | None = None) -> tuple[DataFrame, list[tuple[int, str, int]]]:
    """Reads and references; read_ord is the record's virtual offset, which rises through the file."""
    files, place = open_path(path)
    with files.open_input_file(place) as source:
        blocks = Blocks(source)
        refs = read_header(blocks)
        first, end = blocks.virtual(), source.size() << 16
    parts = [(first, end)]
    bai = next((p for p in (f"{place}.bai", f"{place.removesuffix('.bam')}.bai") if files.get_file_info(p).type != fs.FileType.NotFound), None)
    if bai:
        by_name = {name: tid for tid, name, _ in refs}
        wanted = [(by_name[r.name], r.start, r.last + 1) for r in parse_regions(regions) if r.name in by_name] if regions else None
        with files.open_input_stream(bai) as source:
            parts = ranges(read_index(source.read()), first, end, wanted)
    names, uri = [name for _, name, _ in refs], path if "://" in path else f"file://{place}"
    kinds = READS

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = fs.FileSystem.from_uri(uri)
        with files.open_input_file(place) as source:
            for batch in batches:
                for begin, stop in zip(*(batch.column(n).to_pylist() for n in ("begin", "stop")), strict=True):
                    blocks, rows = Blocks(source, begin), []
                    while (virtual := blocks.virtual()) < stop:
                        rows.append(decode(blocks.read(struct.unpack("<i", blocks.read(4))[0]), virtual, names))
                        if len(rows) == 5000:
                            yield table(rows)
                            rows = []
                    if rows:
                        yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        cigar = pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())]))
        types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), cigar, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.string()]
        columns = ["read_ord", "qname", "flag", "tid", "rname", "pos", "mapq", "cigar", "mtid", "mpos", "tlen", "seq", "qual", "bq"]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], columns)

    spread = spark.createDataFrame(parts, "begin long, stop long").repartition(max(1, len(parts)))
    return spread.mapInArrow(read, kinds), refs
