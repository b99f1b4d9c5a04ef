"""Base quality rewrites: alignment qualities from the BQ tag, and one vote for two mates over the same base."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covagrid.params import Flag

MATCHES = frozenset("M=X")
_WORD = 0xFFFFFFFF


def apply_bq(reads: DataFrame, has_reference: Column) -> DataFrame:
    """Qualities lowered by the BQ tag (its characters less 64) where the read's reference is known."""
    offsets = F.transform(F.split("bq", ""), lambda c: F.ascii(c) - 64)
    lowered = F.zip_with("qual", offsets, lambda q, b: F.greatest(q - F.coalesce(b, F.lit(0)), F.lit(0)))
    return reads.withColumn("qual", F.when(has_reference & F.col("bq").isNotNull() & (F.length("bq") == F.size("qual")), lowered).otherwise(F.col("qual")))


def keeps_first(qname: str) -> bool:
    """Whether the first of two mates keeps the quality: the low bit of Wang's integer hash of the X31 string hash."""
    data = qname.encode("latin-1", "replace")
    h = data[0] if data else 0
    for c in data[1:]:
        h = (h * 31 + c) & _WORD
    h = (h + ~(h << 15)) & _WORD
    h ^= h >> 10
    h = (h + (h << 3)) & _WORD
    h ^= h >> 6
    h = (h + ~(h << 11)) & _WORD
    h ^= h >> 16
    return bool(h & 1)


def _walk(pos: int, cigar: list[dict], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position of [low, high): the read's index there or -1, and whether a deletion lies there."""
    index, deleted = np.full(high - low, -1), np.zeros(high - low, bool)
    query = 0
    for op in cigar:
        kind, n = op["op"], op["len"]
        if kind in "MDN=X":
            a, b = max(pos, low), min(pos + n, high)
            if a < b and kind in MATCHES:
                index[a - low : b - low] = np.arange(query + a - pos, query + b - pos)
            elif a < b and kind == "D":
                deleted[a - low : b - low] = True
            pos += n
        if kind in "MIS=X":
            query += n
    return index, deleted


def merge_mates(a: dict, b: dict) -> None:
    """Rewrite the qualities of `a` and the later mate `b` where both lie over the same positions."""
    low, high = b["pos"], min(a["stop"], b["stop"])
    if low >= high:
        return
    (at_a, gap_a), (at_b, gap_b) = _walk(a["pos"], a["cigar"], low, high), _walk(b["pos"], b["cigar"], low, high)
    qa, qb = a["qual"], b["qual"]
    at_a, at_b = np.where(at_a < len(qa), at_a, -1), np.where(at_b < len(qb), at_b, -1)
    first = keeps_first(a["qname"])
    both = (at_a >= 0) & (at_b >= 0)
    i, j = at_a[both], at_b[both]
    x, y = qa[i], qb[j]
    same = a["seq"][i] == b["seq"][j]
    wins = np.where(same | (x == y), first, x > y)
    best = np.where(same, np.minimum(x + y, 200), (np.maximum(x, y) * 0.8).astype(np.int64))
    qa[i], qb[j] = np.where(wins, best, 0), np.where(wins, 0, best)
    # over the mate's deletion a base keeps less, or nothing if the mate is the one that counts
    alone = at_a[(at_a >= 0) & gap_b]
    qa[alone] = (qa[alone] * 0.8).astype(np.int64) if first else 0
    alone = at_b[(at_b >= 0) & gap_a]
    qb[alone] = 0 if first else (qb[alone] * 0.8).astype(np.int64)


def merge_overlaps(reads: DataFrame) -> DataFrame:
    """`reads` with the qualities of overlapping mates merged.

    Only properly paired reads whose mate may overlap take part. A waiting read is always the one ahead in order of its
    (tid, qname), so a read that overlaps neither neighbour there is as it was: neighbours are compared in the JVM, and only
    reads that meet one are dealt out and read in order, one waiting at a time. A name with very many reads so takes
    no more Python memory than one with two. The rest passes by.
    """
    eligible = (
        (F.col("flag").bitwiseAND(F.lit(int(Flag.PROPER_PAIR))) != 0)
        & ~((F.col("mtid") >= 0) & (F.col("mtid") != F.col("tid")))
        & ~((F.abs("tlen") >= 2 * F.length("seq")) & (F.col("mpos") >= F.col("stop")))
    )
    waits = (F.col("mpos") >= F.col("pos")) | ((F.col("flag").bitwiseAND(F.lit(int(Flag.PAIRED))) != 0) & (F.col("mpos") == -1))
    schema = reads.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict | None = None
        for batch in batches:
            plain = batch.drop_columns(["waits"])
            out: list[dict] = []
            may_wait = batch.column("waits").to_pylist()
            for row, may in zip(plain.to_pylist(), may_wait, strict=True):
                row["raw"], row["seq"] = row["seq"], np.frombuffer((row["seq"] or "").encode("latin-1", "replace"), np.uint8)
                row["qual"] = np.array(row["qual"] or [], np.int64)
                size = min(len(row["seq"]), len(row["qual"]))
                row["full"], row["qual"] = row["qual"], row["qual"][:size]
                if waiting is not None and (waiting["tid"], waiting["qname"]) != (row["tid"], row["qname"]):
                    out.append(waiting)
                    waiting = None
                if waiting is not None and waiting["stop"] <= row["pos"]:  # it left before this one came
                    out.append(waiting)
                    waiting = None
                if waiting is not None:
                    merge_mates(waiting, row)
                    out += [waiting, row]
                    waiting = None
                elif may:
                    waiting = row
                else:
                    out.append(row)
            if out:
                yield finished(out, plain.schema)
        if waiting is not None:
            yield finished([waiting], plain.schema)

    def finished(rows: list[dict], kinds: pa.Schema) -> pa.RecordBatch:
        for row in rows:
            row["qual"] = np.concatenate([row["qual"], row["full"][len(row["qual"]) :]]).tolist()
            row["seq"] = row["raw"]
        return pa.RecordBatch.from_pylist([{n: row[n] for n in kinds.names} for row in rows], kinds)

    eligible = F.coalesce(eligible, F.lit(False))
    order = Window.partitionBy("tid", "qname").orderBy("read_ord")
    meets = F.coalesce(F.lag("stop").over(order) > F.col("pos"), F.lit(False)) | F.coalesce(F.lead("pos").over(order) < F.col("stop"), F.lit(False))
    paired = reads.filter(eligible).withColumns({"waits": F.coalesce(waits, F.lit(False)), "meets": meets})
    met = paired.filter("meets").drop("meets").repartition("tid", "qname").sortWithinPartitions("tid", "qname", "read_ord")
    return reads.filter(~eligible).unionByName(paired.filter("not meets").drop("meets", "waits")).unionByName(met.mapInArrow(run, schema))
