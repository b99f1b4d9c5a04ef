"""SAM text as a table of reads, and its header."""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covagrid.errors import BadRecord, SourceNotFound

CIGAR = "array<struct<op:string,len:int>>"
READS = f"read_ord long, qname string, flag int, tid int, rname string, pos long, mapq int, cigar {CIGAR}, mtid int, mpos long, tlen long, seq string, qual array<int>, bq string"


def header_refs(lines: list[str]) -> list[tuple[int, str, int]]:
    """(tid, name, length) of the @SQ lines, in header order."""
    out = []
    for line in lines:
        if line.startswith("@SQ"):
            fields = dict(part.split(":", 1) for part in line.rstrip("\r\n").split("\t")[1:] if ":" in part)
            if "SN" not in fields or not fields.get("LN", "").isdigit():
                raise BadRecord(f"an @SQ line lacks SN or LN: {line[:80]!r}")
            out.append((len(out), fields["SN"], int(fields["LN"])))
    return out


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        import os

        path = os.path.abspath(path)
    files, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if files.get_file_info(place).type == fs.FileType.NotFound:
        raise SourceNotFound(f"no such file: {path}")
    return files, place


def parts(path: str) -> tuple[fs.FileSystem, list[str]]:
    """The file at `path`, or the files of the folder there that hold something, by name, which is their order."""
    files, place = open_path(path)
    if files.get_file_info(place).type != fs.FileType.Directory:
        return files, [place]
    found = sorted(x.path for x in files.get_file_info(fs.FileSelector(place)) if x.type == fs.FileType.File and x.size and x.base_name[0] not in "._")
    if not found:
        raise SourceNotFound(f"no files with alignments: {path}")
    return files, found


def is_bam(path: str) -> bool:
    """Whether the file begins as a block of compressed alignments does; SAM text doesn't begin so."""
    files, (place, *_) = parts(path)
    with files.open_input_stream(place, compression=None) as source:
        return source.read(4) == b"\x1f\x8b\x08\x04"


def read_header(path: str) -> list[tuple[int, str, int]]:
    """References of a SAM file, or of the first of its parts; reads no further than the header."""
    files, (place, *_) = parts(path)
    lines, rest = [], b""
    with files.open_input_stream(place) as source:
        while piece := source.read(1 << 20):
            *done, rest = (rest + piece).split(b"\n")
            lines += [x.decode("latin-1") for x in done if x.startswith(b"@")]
            if any(x and not x.startswith(b"@") for x in done):
                break
    return header_refs(lines)


def parse_cigar(text: Column) -> Column:
    """The operations as (op, len); those of length zero and `*` give none."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.struct(F.substring(x, -1, 1).alias("op"), F.regexp_extract(x, r"^\d+", 0).cast("int").alias("len"))), lambda x: x["len"] > 0).cast(CIGAR)


def parse_qualities(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.ascii(c) - 33)


def parse_lines(lines: DataFrame, refs: list[tuple[int, str, int]]) -> DataFrame:
    """Reads from (read_ord, value) rows of SAM lines without the header. Unknown references have tid -1."""
    spark = lines.sparkSession
    named = spark.createDataFrame([(name, tid) for tid, name, _ in refs], "known string, known_tid int")
    cells = F.split("value", "\t")
    at = lambda k: F.get(cells, F.lit(k))
    seq, qual = F.when(at(9) == "*", "").otherwise(at(9)), at(10)
    qualities = F.when(qual == "*", F.array_repeat(F.lit(255), F.length(seq))).otherwise(parse_qualities(qual))
    tags = F.filter(F.slice(cells, 12, 1 << 20), lambda t: t.startswith("BQ:Z:"))
    rows = lines.select(
        "read_ord", at(0).alias("qname"), at(1).cast("int").alias("flag"), at(2).alias("rname"), (at(3).cast("long") - 1).alias("pos"), at(4).cast("int").alias("mapq"), parse_cigar(at(5)).alias("cigar"),
        F.when(at(6) == "=", at(2)).otherwise(at(6)).alias("mrname"), (at(7).cast("long") - 1).alias("mpos"), at(8).cast("long").alias("tlen"), seq.alias("seq"), qualities.alias("qual"),
        F.substring(F.get(tags, F.lit(0)), 6, 1 << 30).alias("bq"),
    )
    # references are a header's length; Spark sees the size and picks the join
    here, there = named, named.select(F.col("known").alias("mate"), F.col("known_tid").alias("mate_tid"))
    rows = rows.join(here, rows["rname"] == here["known"], "left").join(there, rows["mrname"] == there["mate"], "left")
    return rows.withColumns({"tid": F.coalesce("known_tid", F.lit(-1)), "mtid": F.coalesce("mate_tid", F.lit(-1))}).select([c.split()[0] for c in re.split(r", (?=[a-z_]+ )", READS)])


def read_sam(spark: SparkSession, path: str) -> tuple[DataFrame, list[tuple[int, str, int]]]:
    """Reads and references of a SAM file, or of a folder with one in parts, the header in the first. read_ord rises with the place."""
    refs, (_, found) = read_header(path), parts(path)
    text = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_name").alias("part"))
    # lines are longer than 22 bytes, so block starts plus counts within a task can't overtake each other: what shares
    # a task with other blocks is the end of its part, behind which the next part's numbers begin
    numbered = text.withColumn("read_ord", F.col("block") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    if len(found) > 1:
        ranks = spark.createDataFrame([(place.rpartition("/")[2], k << 40) for k, place in enumerate(found)], "part string, ahead long")
        numbered = numbered.join(F.broadcast(ranks), "part").withColumn("read_ord", F.col("read_ord") + F.col("ahead"))
    # null, not only filtered away: casts of a header's cells may be tried before a filter on them
    records = numbered.withColumn("value", F.when(~F.col("value").startswith("@") & (F.col("value") != ""), F.col("value")))
    return parse_lines(records.filter("value is not null").select("read_ord", "value"), refs), refs
