"""The engine against a plain walk over each read, and against hand-written rows."""

import math
import random

import pytest
from covagrid.errors import BadParameter, BadRegion, SourceNotFound
from covagrid.operators.depth import cap_depth
from covagrid.operators.filters import unsorted_reads
from covagrid.operators.outputs import Histogram, Pileup
from covagrid.operators.qualities import keeps_first, merge_mates
from covagrid.operators import realign
from covagrid.operators.realign import realigned
from covagrid.params import BY_REFERENCE, EVERYTHING, Flag, PileupParams, parse_flags
from covagrid.plans.engine import PileupEngine
from covagrid.sources.fasta import build_index, read_fasta
from covagrid.sources.regions import chunks, parse_region, parse_regions
from covagrid.sources.sam import READS, header_refs
from pyspark.sql import functions as F

REFS = [(0, "x", 60), (1, "y", 40)]
BASES = {"x": "".join("ACGTacgtNA"[k % 10] for k in range(60)), "y": "".join("GATTACA"[k % 7] for k in range(40))}
PLAIN = {"no_baq": True, "ignore_overlaps": True}


def a_read(k, tid, pos, cigar, seq, qual=None, flag=0, mapq=20, **more):
    base = {"read_ord": k, "qname": f"r{k}", "flag": flag, "tid": tid, "rname": REFS[tid][1] if tid >= 0 else "*", "pos": pos, "mapq": mapq, "cigar": cigar, "mtid": -1, "mpos": -1, "tlen": 0, "seq": seq, "qual": [30] * len(seq) if qual is None else qual, "bq": None}
    return base | more


def table(spark, reads):
    fields = [x.split()[0] for x in READS.replace("array<struct<op:string,len:int>>", "cigar_type").split(", ")]
    return spark.createDataFrame([tuple(r[f] for f in fields) for r in reads], READS)


def some_reads(seed, n=60):
    rng, reads = random.Random(seed), []
    for k in range(n):
        ops, length = [], 0
        for _ in range(rng.randint(1, 5)):
            op = rng.choice("MMMIDNP=X")
            if ops and ops[-1][0] == op:
                continue
            ops.append((op, rng.randint(1, 4)))
        if not any(o in "M=X" for o, _ in ops):
            ops.append(("M", 3))
        if rng.random() < 0.3:
            ops.insert(0, ("S", 2))
        length = sum(n for o, n in ops if o in "MIS=X")
        tid = rng.randint(0, 1)
        seq = "".join(rng.choice("ACGTN") for _ in range(length)) if rng.random() < 0.9 else ""
        reads.append(a_read(k, tid, rng.randint(0, 20), ops, seq, [rng.randint(0, 41) for _ in seq], flag=rng.choice([0, 16]), mapq=rng.randint(0, 60)))
    return sorted(reads, key=lambda r: (r["tid"], r["pos"], r["read_ord"]))


def walked(reads, bases, min_quality):
    """{(name, pos): (depth, bases, quals)} by walking each CIGAR one base at a time."""
    cells = {}
    for r in sorted(reads, key=lambda r: r["read_ord"]):
        name, back = REFS[r["tid"]][1], r["flag"] & 16
        case = str.lower if back else str.upper
        ref = bases.get(name, "")
        at, q = r["pos"], 0
        stop = r["pos"] + sum(n for o, n in r["cigar"] if o in "MDN=X")
        for k, (op, n) in enumerate(r["cigar"]):
            if op in "IS":
                q += n
            if op not in "MDN=X":
                continue
            for i in range(n):
                p, place = at + i, q + (i if op in "M=X" else 0)
                there = ref[p : p + 1]
                cell = "^" + chr(min(r["mapq"], 93) + 33) if p == r["pos"] else ""
                base = r["seq"][place : place + 1]
                if op == "N":
                    cell += "<" if back else ">"
                elif op == "D":
                    cell += "*"
                elif not base:
                    cell += "n"
                else:
                    cell += ("," if back else ".") if base.upper() == there.upper() else case(base)
                if i == n - 1:
                    rest = r["cigar"][k + 1 :]
                    run = []
                    for o, m in rest:
                        if o not in "IP":
                            break
                        run.append((o, m))
                    gap = 0
                    if rest and rest[0][0] == "D" and op != "D":
                        for o, m in rest:
                            if o != "D":
                                break
                            gap += m
                    elif any(o == "I" for o, _ in run):
                        text, inside = "", q + (n if op in "M=X" else 0)
                        for o, m in run:
                            if o == "P":
                                text += "*" * m
                            else:
                                text += case(r["seq"][inside : inside + m]).ljust(m, "n")
                                inside += m
                        cell += f"+{len(text)}{text}"
                        if len(rest) > len(run) and rest[len(run)][0] == "D":
                            gap = rest[len(run)][1]
                    if gap:
                        cell += f"-{gap}" + case(ref[p + 1 : p + 1 + gap].ljust(gap, "N"))
                if p == stop - 1:
                    cell += "$"
                quality = r["qual"][place] if place < len(r["qual"]) else 0
                found = cells.setdefault((name, p + 1), [])
                if quality >= min_quality:
                    found.append((cell, chr(quality + 33)))
            at += n
            q += n if op in "M=X" else 0
    return {k: (len(v), "".join(c for c, _ in v), "".join(m for _, m in v)) for k, v in cells.items()}


@pytest.mark.parametrize(("seed", "width", "with_bases"), [(1, 7, True), (2, 1000, True), (3, 16, False)])
def test_rows_equal_a_walk(spark, seed, width, with_bases):
    reads = some_reads(seed)
    reference = spark.createDataFrame(list(BASES.items()), "name string, seq string") if with_bases else None
    engine = PileupEngine(spark, PileupParams(**PLAIN, min_base_quality=13, bin_width=width), reference)
    rows = engine.submit(table(spark, reads).repartition(3, "seq"), REFS).plp().collect()
    clamped = {k: v for k, v in walked(reads, BASES if with_bases else {}, 13).items() if k[1] <= dict((n, x) for _, n, x in REFS)[k[0]]}
    assert {(r.chrom, r.pos): (r.depth, r.bases, r.quals) for r in rows} == clamped
    assert all(r.ref == (BASES[r.chrom][r.pos - 1] if with_bases else "N") for r in rows)


def test_histogram_agrees_with_rows(spark):
    reads = some_reads(4)
    query = PileupEngine(spark, PileupParams(**PLAIN, bin_width=9)).submit(table(spark, reads), REFS)
    text = {(r.chrom, r.pos): r.depth for r in query.plp().collect()}
    for r in query.histo().collect():
        assert r.depth == text[r.chrom, r.pos] == r.a + r.c + r.g + r.t + r.n + r.gap + r.refskip


def test_histogram_lists_indels_as_first_seen(spark):
    two, three, lost = [("M", 2), ("I", 2), ("M", 2)], [("M", 2), ("I", 3), ("M", 1)], [("M", 2), ("D", 2), ("M", 2)]
    reads = [a_read(0, 0, 0, three, "ACGGTA"), a_read(1, 0, 0, two, "ACTTAA"), a_read(2, 0, 0, three, "ACGGTA"), a_read(3, 0, 0, lost, "ACTA")]
    reference = spark.createDataFrame(list(BASES.items()), "name string, seq string")
    query = PileupEngine(spark, PileupParams(**PLAIN, regions="x:2-2"), reference).submit(table(spark, reads), REFS)
    assert [r.value for r in query.text(Histogram()).collect()] == ["x\t2\t4\t0\t0\t4\t0\t0\t0\t0\t[2GGT 1TT]\t[1GT]"]


def test_unknown_bases_are_an_error_unless_allowed(spark):
    reads = table(spark, [a_read(0, 0, 0, [("M", 2)], "AR")])
    with pytest.raises(Exception, match="none of A, C, G, T and N"):
        PileupEngine(spark, PileupParams(**PLAIN)).submit(reads, REFS).histo().collect()
    assert sum(r.n for r in PileupEngine(spark, PileupParams(**PLAIN, strict=False)).submit(reads, REFS).histo().collect()) == 1


def test_emission_modes(spark):
    reads = table(spark, [a_read(0, 0, 4, [("M", 3)], "ACG", [30, 2, 30])])
    lines = lambda **more: [r.value for r in PileupEngine(spark, PileupParams(**PLAIN, **more)).submit(reads, REFS).text(Pileup()).collect()]
    assert lines() == ["x\t5\tN\t1\t^5A\t?", "x\t6\tN\t0\t*\t*", "x\t7\tN\t1\tG$\t?"]
    assert len(lines(emit=BY_REFERENCE)) == 60
    assert len(lines(emit=EVERYTHING)) == 100
    assert lines(emit=EVERYTHING)[60] == "y\t1\tN\t0\t*\t*"
    assert lines(regions="y:1-5", emit=BY_REFERENCE) == []
    assert [x.split("\t")[1] for x in lines(regions="x:7,x:5-6,x:5")] == ["7", "5", "6", "5", "6", "7"]


def test_filters(spark):
    reads = [a_read(k, 0, 0, [("M", 1)], "A", flag=f) for k, f in enumerate([0, 1, 3, 4, 11, 256, 512, 1024, 2048, 16])]
    reads += [a_read(20, 0, 0, [("M", 1)], "A", mapq=5), a_read(21, 0, 0, [("I", 2)], "AC"), a_read(22, -1, 0, [("M", 1)], "A")]
    depth = lambda **more: sum(r.depth for r in PileupEngine(spark, PileupParams(**PLAIN, **more)).submit(table(spark, reads), REFS).plp().collect())
    assert depth() == 5  # 0, 3, 2048, 16 and the one of low mapping quality
    assert depth(min_mapping_quality=6) == 4
    assert depth(count_orphans=True) == 6  # a mate that is unmapped still drops its read
    assert depth(include_flags=16 | 2048) == 2
    assert depth(exclude_flags=16) == 7


def brute_cap(reads, most):
    live, kept, at, here = [], [], None, 0
    for r in sorted(reads, key=lambda r: (r["tid"], r["pos"], r["read_ord"])):
        stop = r["pos"] + sum(n for o, n in r["cigar"] if o in "MDN=X")
        if (r["tid"], r["pos"]) != at:
            live = [e for e in live if at and at[0] == r["tid"] and e >= r["pos"]]
            at, here = (r["tid"], r["pos"]), 0
        if here and len(live) >= most:
            continue
        live.append(stop)
        here += 1
        kept.append(r["read_ord"])
    return sorted(kept)


@pytest.mark.parametrize("most", [1, 3, 10, 1000])
def test_depth_cap(spark, most):
    rng = random.Random(most)
    reads = [a_read(k, rng.randint(0, 1), rng.choice([5, 6, 900, 1020, 1024, 1030, 5000]) + rng.randint(0, 3), [("M", rng.randint(1, 40))], "") for k in range(120)]
    capped = cap_depth(table(spark, reads).withColumn("stop", F.col("pos") + F.get("cigar", F.lit(0))["len"]), most)
    assert sorted(r.read_ord for r in capped.collect()) == brute_cap(reads, most)


def test_no_cap(spark):
    reads = table(spark, [a_read(k, 0, 0, [("M", 1)], "A") for k in range(30)])
    assert cap_depth(reads, 0) is reads


def test_mates_count_once(spark):
    pair = [a_read(0, 0, 0, [("M", 6)], "ACGTAC", [20] * 6, flag=3, qname="p", mtid=0, mpos=3, tlen=9), a_read(1, 0, 3, [("M", 6)], "TACGTA", [30] * 6, flag=19, qname="p", mtid=0, mpos=0, tlen=-9)]
    rows = PileupEngine(spark, PileupParams(no_baq=True)).submit(table(spark, pair), REFS).plp().orderBy("pos").collect()
    assert [r.depth for r in rows] == [1] * 9
    both = PileupEngine(spark, PileupParams(no_baq=True, ignore_overlaps=True)).submit(table(spark, pair), REFS).plp().collect()
    assert sorted(r.depth for r in both) == [1] * 6 + [2] * 3
    kept = [ord(r.quals) - 33 for r in rows if 4 <= r.pos <= 6]
    assert kept == [50, 50, 50]
    assert keeps_first("p") in (True, False)


def test_mates_that_differ_or_lie_over_a_gap():
    import numpy as np

    def mate(pos, cigar, seq, qual):
        ops = [{"op": o, "len": n} for o, n in cigar]
        return {"qname": "p", "pos": pos, "stop": pos + sum(n for o, n in cigar if o in "MDN"), "cigar": ops, "seq": np.frombuffer(seq, np.uint8), "qual": np.array(qual)}

    a, b = mate(0, [("M", 4)], b"AAAA", [10, 10, 40, 30]), mate(2, [("M", 2)], b"AC", [10, 35])
    merge_mates(a, b)
    first = keeps_first("p")
    assert (a["qual"].tolist(), b["qual"].tolist()) == (([10, 10, 50, 0], [0, 28]) if first else ([10, 10, 0, 0], [50, 28]))
    a, b = mate(0, [("M", 4)], b"AAAA", [10, 20, 30, 40]), mate(0, [("M", 1), ("D", 2), ("M", 1)], b"AA", [10, 40])
    merge_mates(a, b)
    assert a["qual"].tolist()[1:3] == ([16, 24] if first else [0, 0])


def test_quality_tags_apply_where_the_reference_is_known(spark):
    reads = table(spark, [a_read(0, 0, 0, [("M", 3)], "ACG", [30, 30, 5], bq="@JZ")])
    reference = spark.createDataFrame([("x", BASES["x"])], "name string, seq string")
    quals = lambda ref, **more: "".join(r.quals for r in PileupEngine(spark, PileupParams(min_base_quality=0, **more), ref).submit(reads, REFS).plp().orderBy("pos").collect())
    assert quals(reference) == "?5!"
    assert quals(reference, no_baq=True) == quals(None) == "??&"


def test_realignment_lowers_what_an_indel_would_explain(spark):
    bases = "ACGGTCATTGCAAGTCCTAGGATCTTACGAGCATGCCTTAAGGCTATCGAT"
    ops = [{"op": "M", "len": 30}]
    exact = realigned([(5, ops, bases[5:35], [30] * 30, bases, 0)])[0]
    assert exact[5:25] == [30] * 20
    shifted = bases[5:28] + bases[30:37]  # lacks two bases near its end, which the CIGAR passes over
    lowered = realigned([(5, ops, shifted, [30] * 30, bases, 0)])[0]
    assert lowered[5:18] == [30] * 13 and max(lowered[24:]) < 15
    for skip in ([{"op": "M", "len": 10}, {"op": "N", "len": 5}, {"op": "M", "len": 20}],):
        assert realigned([(5, skip, shifted, [30] * 30, bases, 0)])[0] == [30] * 30
    assert realigned([(0, ops, "", [], bases, 0)]) == [[]]
    reads = table(spark, [a_read(0, 0, 5, [("M", 30)], shifted), a_read(1, 1, 5, [("M", 3)], "ACG"), a_read(2, 0, 6, [("M", 2)], "")])
    reference = spark.createDataFrame([("x", bases + bases[:9])], "name string, seq string")
    rows = PileupEngine(spark, PileupParams(min_base_quality=0, bin_width=4), reference).submit(reads, REFS).usable_reads().orderBy("read_ord").collect()
    assert [r.qual for r in rows] == [lowered, [30] * 3, []]


def test_regions():
    assert parse_region("x") == type(parse_region("x"))("x", 0, (1 << 63) - 2)
    assert (parse_region("x:5").start, parse_region("x:0-7").start, parse_region("x:5-7").last) == (4, 0, 6)
    assert [(r.name, r.start) for r in parse_regions("a:1,000-2,000,b,c:7")] == [("a", 999), ("b", 0), ("c", 6)]
    for bad in ("", ":3", "x:", "x:-3", "x:3-", "x:9-3", "x:a", "x:1-b"):
        with pytest.raises(BadRegion):
            parse_regions(bad)


def test_unknown_region_and_clamped_end(spark):
    with pytest.raises(BadRegion):
        PileupEngine(spark, PileupParams(regions="z")).submit(table(spark, []), REFS)
    query = PileupEngine(spark, PileupParams(**PLAIN, regions="y:39-500", emit=EVERYTHING)).submit(table(spark, []), REFS)
    assert [r.pos for r in query.plp().orderBy("pos").collect()] == [39, 40]


def test_parameters_and_chunks():
    assert parse_flags("Read1,proper-pair,0x10") == 64 | 2 | 16
    with pytest.raises(BadParameter):
        parse_flags("sideways")
    with pytest.raises(BadParameter):
        PileupParams(no_baq=True, redo_baq=True)
    assert int(PileupParams().exclude_flags) == int(Flag.SECONDARY | Flag.QC_FAIL | Flag.DUPLICATE | Flag.UNMAPPED)
    assert chunks(100, 4) == [(0, 100)]
    assert chunks(1_000_000, 2) == [(0, 500001), (500001, 1000000)]


SAM = "@HD\tVN:1.6\n@SQ\tSN:x\tLN:60\n@SQ\tSN:y\tLN:40\nr1\t0\tx\t3\t40\t2M1I2M1D1M\t=\t3\t0\tACGTAC\tIIIIII\tNM:i:1\tBQ:Z:@@@@@@\nr2\t16\ty\t1\t9\t3M\t*\t0\t0\t*\t*\n"


def test_sam_and_fasta_files(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    (tmp_path / "r.fa").write_text(">x one\n" + BASES["x"][:25] + "\n" + BASES["x"][25:50] + "\n" + BASES["x"][50:] + "\n>y\n" + BASES["y"] + "\n")
    assert [(r[0], r[1]) for r in build_index(str(tmp_path / "r.fa"))] == [("x", 60), ("y", 40)]
    whole = {}
    for r in read_fasta(spark, str(tmp_path / "r.fa"), 7, 3).orderBy("name", "chunk").collect():
        assert r.seq == BASES[r.name][r.chunk * 7 : r.chunk * 7 + 10]
        whole[r.name] = whole.get(r.name, "") + r.seq[:7]
    assert whole == BASES
    query = PileupEngine(spark, PileupParams(min_base_quality=0), str(tmp_path / "r.fa")).submit(str(tmp_path / "a.sam"))
    lines = [r.value for r in query.text(Pileup()).collect()]
    assert lines[:6] == ["x\t3\tG\t1\t^IA\tI", "x\t4\tT\t1\tC+1G\tI", "x\t5\ta\t1\tT\tI", "x\t6\tc\t1\tA-1G\tI", "x\t7\tg\t1\t*\tI", "x\t8\tt\t1\tC$\tI"]
    assert lines[6] == "y\t1\tG\t1\t^*n\t!"
    query.write(str(tmp_path / "out"), Pileup())
    query.write(str(tmp_path / "out"), Pileup())
    assert spark.read.text(str(tmp_path / "out")).count() == len(lines)
    assert [r.pos for r in query.iterate(Pileup())] == [3, 4, 5, 6, 7, 8, 1, 2, 3]
    with pytest.raises(SourceNotFound):
        PileupEngine(spark).submit(str(tmp_path / "none.sam"))
    assert header_refs(["@SQ\tSN:q\tLN:5"]) == [(0, "q", 5)]


def test_unsorted_reads(spark):
    orders = [0, 1, 65536, 65540, 1 << 33, (1 << 33) + 1, 1 << 50]
    for places, wrong in (([1, 2, 3, 4, 5, 6, 7], []), ([1, 0, 3, 2, 1, 9, 8], [1, 65540, 1 << 33, 1 << 50])):
        rows = spark.createDataFrame([(o, 0, p) for o, p in zip(orders, places, strict=True)], "read_ord long, tid int, pos long")
        assert sorted(r.read_ord for r in unsorted_reads(rows).collect()) == wrong


def test_a_format_of_ones_own(spark):
    class Strands(Pileup):
        dealt = False

        def columns(self, cells):
            return cells

        def aggregates(self):
            return [F.count_if(~F.col("reverse")).alias("forward"), F.count_if("reverse").alias("backward")]

        def finish(self, rows):
            return rows

    reads = table(spark, [a_read(0, 0, 0, [("M", 2)], "AC"), a_read(1, 0, 1, [("M", 2)], "AC", flag=16)])
    rows = PileupEngine(spark, PileupParams(**PLAIN)).submit(reads, REFS).to_df(Strands()).orderBy("pos").collect()
    assert [(r.forward, r.backward) for r in rows] == [(1, 0), (1, 1), (0, 1)]


def plain_posterior(ref: str, query: str, qual: list[int], band: int) -> tuple[list[tuple[int, bool]], list[int]]:
    """For each read base: (place in `ref`, whether it is a match) of the likeliest state, and its quality."""
    n, m = len(query), len(ref)
    band = max(min(max(m, n), band), abs(m - n))
    error = [10 ** (-q / 10) for q in qual]
    start = stop = 1 / (2 * n + 2)
    mm, mi = (1 - 2 * realign.GAP_OPEN) * (1 - stop), realign.GAP_OPEN * (1 - stop)
    im, ii = (1 - realign.GAP_EXTEND) * (1 - stop), realign.GAP_EXTEND * (1 - stop)
    dm, dd = 1 - realign.GAP_EXTEND, realign.GAP_EXTEND

    def emit(i: int, k: int) -> float:
        a, b = query[i - 1], ref[k - 1]
        if a not in "ACGT" or b not in "ACGT":
            return 1.0
        return 1 - error[i - 1] if a == b else error[i - 1] * realign.MISMATCH

    def row() -> list[list[float]]:
        return [[0.0] * (m + 2) for _ in range(3)]

    def bounds(i: int) -> range:
        return range(max(1, i - band), min(m, i + band) + 1)

    forward, scale = [row()], [1.0]
    for i in range(1, n + 1):
        fm, fi, fd = now = row()
        gm, gi, gd = forward[-1]
        total = 0.0
        for k in bounds(i) if i > 1 else range(1, min(m, band + 1) + 1):
            if i == 1:
                fm[k], fi[k] = emit(1, k) * (1 - realign.GAP_OPEN) / m, realign.INSERTED * realign.GAP_OPEN / m
            else:
                fm[k] = emit(i, k) * (mm * gm[k - 1] + im * gi[k - 1] + dm * gd[k - 1])
                fi[k] = realign.INSERTED * (mi * gm[k] + ii * gi[k])
                fd[k] = mi * fm[k - 1] + dd * fd[k - 1]
            total += fm[k] + fi[k] + fd[k]
        forward.append([[x / total for x in state] for state in now])
        scale.append(total)
    last = sum(start * (forward[n][0][k] + forward[n][1][k]) for k in bounds(n))
    states, quals = [], []
    bm, bi, bd = row()
    for i in range(n, 0, -1):
        hm, hi = bm, bi
        bm, bi, bd = row()
        for k in reversed(bounds(i)):
            if i == n:
                bm[k] = bi[k] = stop / scale[n] / last
            else:
                ahead = emit(i + 1, k + 1) * hm[k + 1] if k < m else 0.0
                bm[k] = ahead * mm + realign.INSERTED * mi * hi[k] + mi * bd[k + 1]
                bi[k] = ahead * im + realign.INSERTED * ii * hi[k]
                bd[k] = (ahead * dm + dd * bd[k + 1]) if i > 1 else 0.0
        if i < n:
            for state in (bm, bi, bd):
                for k in bounds(i):
                    state[k] /= scale[i]
        total, best, at = 0.0, 0.0, (0, True)
        for k in bounds(i):
            for kind, (f, b) in enumerate(((forward[i][0], bm), (forward[i][1], bi))):
                z = f[k] * b[k]
                total += z
                if z > best:
                    best, at = z, (k - 1, kind == 0)
        share = best / total if total else 0.0
        value = int(-4.343 * math.log(1 - share) + 0.499) if share < 1 else 100
        states.append(at)
        quals.append(min(value, 99))
    return states[::-1], quals[::-1]


def test_reads_together_are_as_reads_alone():
    """The model over arrays of reads against loops over the cells of one."""
    rng = random.Random(3)
    for n in (1, 2, 5, 30, 60):
        for more in (-4, 0, 7, 12):
            if (m := n + more) < 1:
                continue
            refs = ["".join(rng.choice("ACGTN") for _ in range(m)) for _ in range(6)]
            reads = ["".join(c if rng.random() < 0.9 else "A" for c in (ref[max(0, more // 2) :] + "ACGT" * 20)[:n]) for ref in refs]
            quals = [[rng.randint(0, 41) for _ in range(n)] for _ in refs]
            places, matches, values = realign.posteriors(refs, reads, quals, 7)
            for k in range(len(refs)):
                states, wanted = plain_posterior(refs[k], reads[k], quals[k], 7)
                assert list(zip(places[k].tolist(), matches[k].tolist(), strict=True)) == states and values[k].tolist() == wanted


def test_model_runs_once_for_each_distinct_read(spark, monkeypatch):
    """copies of a read, also where the reference repeats, are one row of the model; results are those read by read."""
    written = []
    cut = realign.cut
    monkeypatch.setattr(realign, "cut", lambda df, tag: written.append(cut(df, tag)) or written[-1])
    bases = "GATTACACCGTTAGGCATAC" * 60
    ops, seq = [("M", 8), ("I", 2), ("M", 10)], bases[3:11] + "TT" + bases[11:21]
    places = [pos for pos in (403, 423, 603, 0, 1, 1185) for _ in range(20)]
    reads = [a_read(k, 0, pos, ops, seq) | {"rname": "x"} for k, pos in enumerate(places)] + [a_read(999, 0, 403, [("M", 8), ("N", 4), ("M", 12)], seq), a_read(1000, 0, 5, ops, "", [])]
    refs = [(0, "x", len(bases))]
    engine = PileupEngine(spark, PileupParams(ignore_overlaps=True, max_depth=0, bin_width=50), spark.createDataFrame([("x", bases)], "name string, seq string"))
    found = {r["read_ord"]: r["qual"] for r in engine.submit(table(spark, reads), refs).usable_reads().collect()}
    wanted = realigned([(r["pos"], [{"op": o, "len": n} for o, n in r["cigar"]], r["seq"], r["qual"], bases, 0) for r in reads])
    assert found == {r["read_ord"]: quals for r, quals in zip(reads, wanted, strict=True)}
    assert sum(w.count() for w in written) == 4  # three places look alike


def test_default_pileup_makes_no_read_twice_in_python(spark, small):
    """neither the cap nor the merge of mates runs the model again."""
    import __spark_entry__

    plan = __spark_entry__.queries()["plp_default"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow run(") == 1


def test_write_sorts_lines_not_cells(spark, tmp_path, monkeypatch):
    """sampling for the order reads lines that are written already; nothing of them stays."""
    from covagrid.plans import engine as module

    held, release = [], module.release
    monkeypatch.setattr(module, "release", lambda session, paths: held.extend((p, session.read.parquet(p).count()) for p in paths) or release(session, paths))
    reads = some_reads(5)
    query = PileupEngine(spark, PileupParams(**PLAIN, max_depth=0, min_base_quality=0)).submit(table(spark, reads), REFS)
    query.write(str(tmp_path / "out"), Pileup())
    lines = [r.value for r in query.text(Pileup()).collect()]
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).withColumn("at", F.monotonically_increasing_id()).orderBy(F.col("_metadata.file_name"), "at").select("value").collect()] == lines
    ((path, count),) = held
    assert count == len(lines) > 0
    from pathlib import Path

    assert not Path(path.removeprefix("file://")).exists()
