"""BAM files written here are read back, and the command line prints rows."""

import struct
import zlib

import pytest
from covagrid.__main__ import main
from covagrid.errors import BadRecord
from covagrid.operators.outputs import Pileup
from covagrid.params import PileupParams
from covagrid.operators.filters import unsorted_reads
from covagrid.plans.engine import PileupEngine
from covagrid.plans.file_queries import write_sam
from covagrid.plans.read_view import REFS as REFS_OF_VIEW
from covagrid.plans.read_view import read_view
from covagrid.sources.bam import NIBBLES, OPS, bins_of, read_bam
from covagrid.sources.sam import is_bam, read_sam

REFS = [("x", 200_000), ("y", 50)]
RECORDS = [("a", 0, 0, 4, [("M", 3), ("I", 1), ("M", 2)], "ACGTAC"), ("b", 16, 0, 40_000, [("M", 4), ("D", 2), ("M", 1)], "GATTA"), ("c", 0, 0, 150_000, [("S", 1), ("M", 2)], "NRC"), ("d", 0, 1, 7, [("M", 2)], "")]


def block(data):
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def encoded(name, flag, tid, pos, cigar, seq):
    nibbles = [NIBBLES.index(c) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(nibbles[::2], nibbles[1::2], strict=True))
    body = struct.pack("<iiBBHHHiiii", tid, pos, len(name) + 1, 30, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
    body += b"".join(struct.pack("<I", n << 4 | OPS.index(o)) for o, n in cigar) + packed + bytes([25] * len(seq)) + b"NMi" + struct.pack("<i", 1) + b"XBBc" + struct.pack("<i", 2) + b"\1\2" + b"BQZ" + b"@" * len(seq) + b"\0"
    return struct.pack("<i", len(body)) + body


@pytest.fixture
def bam(tmp_path):
    """A BAM file with a block for each record, one of which is cut in two, and its index."""
    head = b"BAM\1" + struct.pack("<i", 3) + b"@CO" + struct.pack("<i", len(REFS))
    for name, n in REFS:
        head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n)
    out, spans = block(head), []
    for k, record in enumerate(RECORDS):
        data, start = encoded(*record), len(out)
        out += block(data[:20]) + block(data[20:]) if k == 1 else block(data)
        spans.append((start << 16, len(out) << 16))
    out += block(b"")
    path = tmp_path / "t.bam"
    path.write_bytes(out)
    index = b"BAI\1" + struct.pack("<i", len(REFS))
    for tid in range(len(REFS)):
        mine = [(4681 + (r[3] >> 14), s, r[3] >> 14) for r, s in zip(RECORDS, spans, strict=True) if r[2] == tid]
        index += struct.pack("<i", len(mine)) + b"".join(struct.pack("<IiQQ", b, 1, *s) for b, s, _ in mine)
        linear = [next(s[0] for _, s, w in mine if w >= k) for k in range(max(w for *_, w in mine) + 1)]
        index += struct.pack("<i", len(linear)) + struct.pack(f"<{len(linear)}Q", *linear)
    return path, index


def test_bam_without_and_with_index(spark, bam):
    path, index = bam
    for indexed in (False, True):
        if indexed:
            (path.parent / "t.bam.bai").write_bytes(index)
        reads, refs = read_bam(spark, str(path))
        assert refs == [(0, "x", 200_000), (1, "y", 50)]
        rows = reads.orderBy("read_ord").collect()
        assert [(r.qname, r.flag, r.tid, r.pos, [(c.op, c.len) for c in r.cigar], r.seq) for r in rows] == RECORDS
        assert [(r.qual, r.bq) for r in rows] == [([25] * len(r.seq), "@" * len(r.seq)) for r in rows]
    reads, _ = read_bam(spark, str(path), "x:39000-41000")
    assert [r.qname for r in reads.collect()] == ["b"]
    lines = [r.value for r in PileupEngine(spark, PileupParams(regions="x:40001-40002,y:8", min_base_quality=0)).submit(str(path)).text(Pileup()).collect()]
    assert lines == ["x\t40001\tN\t1\t^?g\t:", "x\t40002\tN\t1\ta\t:", "y\t8\tN\t1\t^?n\t!", "y\t9\tN\t1\tn$\t!"]


def test_broken_bam(spark, tmp_path):
    (tmp_path / "b.bam").write_bytes(b"not a block at all, but long enough")
    with pytest.raises(BadRecord):
        read_bam(spark, str(tmp_path / "b.bam"))


def test_bins():
    assert bins_of(0, 1) == [0, 1, 9, 73, 585, 4681]
    assert bins_of(1 << 14, (1 << 14) + 1)[-1] == 4682


def test_command_line(spark, tmp_path, capsys):
    sam = tmp_path / "a.sam"
    sam.write_text("@SQ\tSN:x\tLN:9\nr\t0\tx\t3\t40\t2M\t*\t0\t0\tAC\tII\n")
    assert main(["plp", str(sam)]) == 0
    assert capsys.readouterr().out == "x\t3\tN\t1\t^IA\tI\nx\t4\tN\t1\tC$\tI\n"
    assert main(["histo", str(sam), "-r", "x:3-3", "--ff", "unmapped"]) == 0
    assert capsys.readouterr().out == "x\t3\t1\t1\t0\t0\t0\t0\t0\t0\t[]\t[]\n"
    assert main(["plp", str(sam), "--aa", "-o", str(tmp_path / "out")]) == 0
    assert spark.read.text(str(tmp_path / "out")).count() == 9
    assert main(["plp", str(sam), "-B", "-E"]) == main(["plp"]) == main(["plp", str(tmp_path / "none.sam")]) == 1
    assert main(["plp", str(sam), "-r", "nowhere"]) == 1


def test_sam_in_parts(spark, small):
    """SAM is written by many tasks, none of which gets more than a share, and read in order."""
    reads = read_view(spark, small)
    path = write_sam(spark, reads, REFS_OF_VIEW)
    found, refs = read_sam(spark, path)
    assert refs == REFS_OF_VIEW and not is_bam(path)
    sizes = [r["count"] for r in spark.read.text(path).groupBy("_metadata.file_name").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 0.5 * sum(sizes) and sum(sizes) == reads.count() + 1 + len(refs)
    columns = ["tid", "pos", "qname", "flag", "mapq", "seq"]
    assert [r[:] for r in found.orderBy("read_ord").select("tid", "pos").collect()] == [r[:] for r in reads.orderBy("tid", "pos").select("tid", "pos").collect()]
    assert found.select(columns).exceptAll(reads.select(columns)).count() == 0
    assert found.select("read_ord").distinct().count() == sum(sizes) - 1 - len(refs)
    assert unsorted_reads(found).first() is None
