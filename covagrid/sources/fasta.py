"""FASTA references as a table of chunks, read by byte ranges of an index."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from covagrid.sources.sam import open_path

CHUNKS = "name string, chunk long, seq string"


def build_index(path: str) -> list[tuple[str, int, int, int, int]]:
    """(name, length, offset, bases a line, bytes a line) of each contig: from the .fai beside it, else by one scan."""
    files, place = open_path(path)
    if files.get_file_info(f"{place}.fai").type != fs.FileType.NotFound:
        with files.open_input_stream(f"{place}.fai") as source:
            rows = [line.split("\t") for line in source.read().decode().splitlines() if line.strip()]
        return [(r[0], *map(int, r[1:5])) for r in rows]
    out: list[list] = []
    at = 0
    with files.open_input_stream(place) as source:
        rest = b""
        while True:
            piece = source.read(1 << 22)
            *lines, rest = (rest + piece).split(b"\n") if piece else ([rest, b""] if rest else [b""])
            for line in lines:
                size, base = len(line) + 1, line.rstrip(b"\r")
                if line.startswith(b">"):
                    out.append([(line[1:].split() or [b""])[0].decode(), 0, at + size, 0, 0])
                elif out and base:
                    out[-1][1] += len(base)
                    if not out[-1][3]:
                        out[-1][3:] = [len(base), size]
                at += size
            if not piece:
                return [tuple(x) for x in out]


def read_fasta(spark: SparkSession, path: str, width: int, ahead: int) -> DataFrame:
    """(name, chunk, seq): the bases from ``chunk * width`` on, `width` of them and `ahead` more, case kept."""
    index = build_index(path)
    files, place = open_path(path)
    uri = path if "://" in path else f"file://{place}"
    requests = spark.createDataFrame([(n, length, o, b, s, "") for n, length, o, b, s in index if b], "name string, length long, off long, bases long, size long, seq string")
    rows = requests.selectExpr("name", "length", "off", "bases", "size", f"explode(sequence(0, (length - 1) div {width})) as chunk")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = fs.FileSystem.from_uri(uri)
        with files.open_input_file(place) as source:
            for batch in batches:
                names, chunks, seqs = [], [], []
                for row in batch.to_pylist():
                    start = row["chunk"] * width
                    stop = min(row["length"], start + width + ahead)
                    a, b = (row["off"] + p // row["bases"] * row["size"] + p % row["bases"] for p in (start, stop))
                    seqs.append(source.read_at(b - a, a).decode("latin-1").replace("\n", "").replace("\r", "")[: stop - start])
                    names.append(row["name"])
                    chunks.append(row["chunk"])
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(chunks, pa.int64()), pa.array(seqs)], ["name", "chunk", "seq"])

    return rows.mapInArrow(fetch, CHUNKS)


def chunked(refseq: DataFrame, width: int, ahead: int) -> DataFrame:
    """The same from a table (name, seq) of whole references."""
    return refseq.selectExpr("name", f"explode(sequence(0, (length(seq) - 1) div {width})) as n", "seq").selectExpr("name", "cast(n as bigint) as chunk", f"substring(seq, cast(n * {width} + 1 as int), {width + ahead}) as seq")
