"""Exact duplicates by composable polynomial fingerprints and a chunkwise comparison.

A text's white space (space, tab to carriage return) is deleted; its UTF-8 bytes are the digits of a number in base
256, reduced modulo a 127-bit prime. Fingerprints of adjoining chunks combine as ``h(a+b) = h(a) * 256**len(b) + h(b)``,
so the chunks of a huge document are hashed by different tasks. Equal fingerprints only nominate: the chunks of all
nominees are compared byte for byte, chunk by chunk, and a group in which one chunk differs is split by its SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covagrid.llm.common import byte_texts, cut, keep_numbered, map_batches

#: The first prime from the fractional bits of the square root of 2 on; unlike 2**127 - 1 it makes no chunk positions interchangeable.
PRIME = 140949571415070559626692937523481902439
WHITE = b" \t\n\x0b\x0c\r"
CHUNK = 1 << 16


def fingerprint(data: bytes, prime: int = PRIME, chunk: int = CHUNK) -> int:
    value = 0
    for at in range(0, len(data), chunk):
        part = data[at : at + chunk]
        value = combine(value, int.from_bytes(part, "big") % prime, len(part), prime)
    return value


def combine(left: int, right: int, right_length: int, prime: int = PRIME) -> int:
    """The fingerprint of two adjoining pieces, from theirs and the length of the second."""
    return (left * pow(256, right_length, prime) + right) % prime


_PRINTS = "row_no long, doc_id long, n_points long, norm_bytes long, text_sha256 string, print binary, piece_no int, body binary"


def _prints(docs: DataFrame, prime: int, huge_bytes: int) -> DataFrame:
    """A row per document with its fingerprint and bare bytes; one above `huge_bytes` has a row per piece, without print."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        points = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
        rows: list[tuple] = []
        for row_no, doc_id, n, raw in zip(batch.column("row_no").to_pylist(), batch.column("doc_id").to_pylist(), points, byte_texts(batch.column("text")), strict=True):
            data = raw.translate(None, WHITE)
            sha = hashlib.sha256(data).hexdigest()
            if len(data) <= huge_bytes:
                rows.append((row_no, doc_id, n, len(data), sha, fingerprint(data, prime).to_bytes(16, "big"), 0, data))
            else:
                rows += [(row_no, doc_id, n, len(data), sha, None, k, data[at : at + huge_bytes]) for k, at in enumerate(range(0, len(data), huge_bytes))]
        yield _batch(rows, _PRINTS)

    return map_batches(docs.select(F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").cast("long"), F.col("text").cast("string")), each, _PRINTS)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(v, _KINDS[k]) for v, k in zip(columns, kinds, strict=True)], list(names))


def _joined_pieces(pieces: DataFrame, prime: int) -> DataFrame:
    """Fingerprints of huge documents: their pieces are hashed wherever they lie and combined in order."""
    keys = ["row_no", "doc_id", "n_points", "norm_bytes", "text_sha256"]

    def hashed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data = batch.column("body").to_pylist()
        parts = [pa.array([fingerprint(x, prime).to_bytes(16, "big") for x in data], pa.binary()), pa.array([len(x) for x in data], pa.int64())]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in (*keys, "piece_no")), *parts], [*keys, "piece_no", "part", "part_bytes"])

    def joined(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for parts in batch.column("parts").to_pylist():
            value = 0
            for part in parts:
                value = combine(value, int.from_bytes(part["part"], "big"), part["part_bytes"], prime)
            out.append(value.to_bytes(16, "big"))
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keys), pa.array(out, pa.binary())], [*keys, "print"])

    whole = "row_no long, doc_id long, n_points long, norm_bytes long, text_sha256 string"
    parts = map_batches(pieces.repartition("row_no", "piece_no"), hashed, f"{whole}, piece_no int, part binary, part_bytes long")
    lists = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("piece_no", "part", "part_bytes"))).alias("parts"))
    return map_batches(lists, joined, f"{whole}, print binary")


_CHUNKS = "print binary, norm_bytes long, at long, chunk binary"


def _collisions(raw: DataFrame, prints: DataFrame, groups: DataFrame, chunk: int, huge_bytes: int) -> DataFrame:
    """Fingerprints under which some chunk differs. Equal chunks collapse before the shuffle, so a hot group stays small.

    The bytes of the nominees are picked by their rows' numbers where they lie; those of huge documents meet their print.
    """

    def chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns = (batch.column(n).to_pylist() for n in ("print", "norm_bytes", "piece_no", "body"))
        rows = [(p, n, piece * huge_bytes + at, data[at : at + chunk]) for p, n, piece, data in zip(*columns, strict=True) for at in range(0, len(data), chunk)]
        if rows:
            yield _batch(rows, _CHUNKS)

    nominees = prints.join(groups, ["print", "norm_bytes"]).select("row_no", "print")
    columns = ["print", "norm_bytes", "piece_no", "body"]
    small = keep_numbered(raw.filter("print is not null").select("row_no", *columns), nominees, "nominees", chunks, _CHUNKS)
    huge = raw.filter("print is null").drop("print").join(nominees, "row_no").select(columns)
    compared = small.unionByName(map_batches(huge, chunks, _CHUNKS)).groupBy("print", "norm_bytes", "at").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    return compared.filter("low <> high").select("print", "norm_bytes").distinct()


def exact_dedup(docs: DataFrame, prime: int = PRIME, huge_bytes: int = 1 << 23, chunk: int = CHUNK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of `docs` (doc_id, text; other columns are ignored).

    Of equal texts the row with the most code points stays, then the smallest doc_id. A null text counts as empty, and
    empty texts are equal. Null doc_ids come last. Rows are told apart by where they stand, so null and repeated doc_ids are
    rows like any other, of which one of a group is kept. Texts above `huge_bytes` are hashed and compared in pieces by
    different tasks. An empty table gives an empty result.
    """
    raw = cut(_prints(docs, prime, huge_bytes), "prints")
    whole = ["row_no", "doc_id", "n_points", "norm_bytes", "text_sha256", "print"]
    prints = raw.filter("print is not null").select(whole).unionByName(_joined_pieces(raw.filter("print is null"), prime).select(whole))
    prints = cut(prints, "rows")
    groups = prints.groupBy("print", "norm_bytes").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    groups = cut(groups, "groups")  # a join with a table, not with the aggregate itself, can split a hot group
    bad = cut(_collisions(raw, prints, groups, chunk, huge_bytes), "collisions").withColumn("split", F.lit(True))
    classed = prints.join(bad, ["print", "norm_bytes"], "left").withColumn("class", F.when(F.col("split"), F.concat("print", F.encode("text_sha256", "UTF-8"))).otherwise(F.col("print")))
    order = F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("row_no").alias("row_no"))
    best = classed.groupBy("class", "norm_bytes").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    best = cut(best, "best")
    return classed.join(best, ["class", "norm_bytes"]).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row_no") == F.col("best.row_no")).alias("kept"), "text_sha256")
