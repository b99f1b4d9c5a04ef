"""Base alignment qualities by a banded pair hidden Markov model of read and reference.

Forward and backward probabilities over match, insertion and deletion give, for each read base, the probability that
it is aligned where the CIGAR says; its quality is lowered to that, between the best values to either side of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covagrid.scratch import cut, sized

# Fixed values of the published model.
GAP_OPEN, GAP_EXTEND, BAND = 0.001, 0.1, 7
MISMATCH, INSERTED = 0.33333333333, 0.25


_CODES = np.full(256, 4, np.int8)
_CODES[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
#: Cells of forward probabilities that are held at once.
_HELD_CELLS = 1 << 22
#: Bytes of distinct qualities that may be sent to every task.
SENT_BYTES = 64 << 20


def _codes(texts: list[str]) -> np.ndarray:
    return _CODES[np.frombuffer("".join(texts).encode("latin-1", "replace"), np.uint8)].reshape(len(texts), -1)


def posteriors(refs: list[str], queries: list[str], quals: list[list[int]], band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each base of reads of one length on references of one length: place in the reference of the likeliest state,
    whether that is a match, and its quality. All reads go through the model together, one row of it after the other."""
    a, b = _codes(queries), _codes(refs)
    (count, n), m = a.shape, b.shape[1]
    band = max(min(max(m, n), band), abs(m - n))
    error = 10 ** (-np.array(quals, float) / 10)
    start = stop = 1 / (2 * n + 2)
    mm, mi = (1 - 2 * GAP_OPEN) * (1 - stop), GAP_OPEN * (1 - stop)
    im, ii = (1 - GAP_EXTEND) * (1 - stop), GAP_EXTEND * (1 - stop)
    dm, dd = 1 - GAP_EXTEND, GAP_EXTEND

    def emit(i: int, low: int, high: int) -> np.ndarray:
        """Of base i at the places low to high; all from 1."""
        base, place, e = a[:, i - 1 : i], b[:, low - 1 : high], error[:, i - 1 : i]
        return np.where((base == 4) | (place == 4), 1.0, np.where(base == place, 1 - e, e * MISMATCH))

    def bounds(i: int) -> tuple[int, int]:
        return max(1, i - band), min(m, i + band)

    forward, scale = np.zeros((n + 1, 3, count, m + 2)), np.ones((n + 1, count, 1))
    for i in range(1, n + 1):
        fm, fi, fd = forward[i]
        gm, gi, gd = forward[i - 1]
        low, high = bounds(i) if i > 1 else (1, min(m, band + 1))
        if i == 1:
            fm[:, low : high + 1] = emit(1, low, high) * (1 - GAP_OPEN) / m
            fi[:, low : high + 1] = INSERTED * GAP_OPEN / m
        else:
            fm[:, low : high + 1] = emit(i, low, high) * (mm * gm[:, low - 1 : high] + im * gi[:, low - 1 : high] + dm * gd[:, low - 1 : high])
            fi[:, low : high + 1] = INSERTED * (mi * gm[:, low : high + 1] + ii * gi[:, low : high + 1])
            for k in range(low, high + 1):
                fd[:, k] = mi * fm[:, k - 1] + dd * fd[:, k - 1]
        now = forward[i, :, :, low : high + 1]
        scale[i] = now.sum(axis=(0, 2))[:, None]
        now /= scale[i]
    low, high = bounds(n)
    last = (start * (forward[n, 0, :, low : high + 1] + forward[n, 1, :, low : high + 1])).sum(axis=1, keepdims=True)
    places, matches, values = np.zeros((count, n), np.int64), np.ones((count, n), bool), np.zeros((count, n), np.int64)
    bm, bi = np.zeros((2, count, m + 2))
    for i in range(n, 0, -1):
        hm, hi = bm, bi
        bm, bi, bd = np.zeros((3, count, m + 2))
        low, high = bounds(i)
        here = slice(low, high + 1)
        if i == n:
            bm[:, here] = bi[:, here] = stop / scale[n] / last
        else:
            ahead = np.zeros((count, m + 2))
            top = min(high, m - 1)
            if top >= low:
                ahead[:, low : top + 1] = emit(i + 1, low + 1, top + 1) * hm[:, low + 1 : top + 2]
            if i > 1:
                for k in range(high, low - 1, -1):
                    bd[:, k] = ahead[:, k] * dm + dd * bd[:, k + 1]
            bm[:, here] = ahead[:, here] * mm + INSERTED * mi * hi[:, here] + mi * bd[:, low + 1 : high + 2]
            bi[:, here] = ahead[:, here] * im + INSERTED * ii * hi[:, here]
            bm[:, here] /= scale[i]
            bi[:, here] /= scale[i]
        both = np.stack([forward[i, 0, :, here] * bm[:, here], forward[i, 1, :, here] * bi[:, here]], axis=2).reshape(count, -1)
        best, total = both.argmax(axis=1), both.sum(axis=1)
        most = both[np.arange(count), best]
        places[:, i - 1] = np.where(most > 0, low + best // 2 - 1, 0)
        matches[:, i - 1] = (best % 2 == 0) | (most <= 0)
        share = np.divide(most, total, out=np.zeros(count), where=total > 0)
        sure = share >= 1
        values[:, i - 1] = np.where(sure, 99, np.minimum(99, (-4.343 * np.log(np.where(sure, 0.5, 1 - share)) + 0.499).astype(np.int64)))
    return places, matches, values


Part = tuple[str, int, int]


def _part(pos: int, cigar: list[dict], n: int, ref: str, ref_start: int) -> Part | None:
    """The reference that the read is held against, where that begins, and the band; None without aligned bases."""
    x, y, xb, xe, yb, ye = pos, 0, -1, -1, -1, -1
    for op in cigar:
        kind, size = op["op"], op["len"]
        if kind in "M=X":
            if yb < 0:
                xb, yb = x, y
            x, y = x + size, y + size
            xe, ye = x, y
        elif kind in "IS":
            y += size
        elif kind == "D":
            x += size
    if yb < 0:
        return None
    band = BAND if abs((xe - xb) - (ye - yb)) <= BAND else abs((xe - xb) - (ye - yb)) + 3
    xb, xe = max(0, xb - yb - band // 2), xe + n - ye + band // 2
    over = xe - xb - n - band
    if over > 0:
        xb += over // 2
        xe -= (xe - xb - n - band) // 2
    part = ref[xb - ref_start : xe - ref_start].upper()
    return (part, xb, band) if part else None


def _lowered(pos: int, cigar: list[dict], qual: list[int], begin: int, places: np.ndarray, matches: np.ndarray, values: np.ndarray) -> list[int]:
    own = np.array(qual)
    out, x, y = np.zeros(len(qual), np.int64), pos, 0
    for op in cigar:
        kind, size = op["op"], op["len"]
        if kind in "M=X":
            at = slice(y, y + size)
            here = np.where(matches[at] & (places[at] == np.arange(x - begin, x - begin + size)), values[at], 0)
            out[at] = np.minimum(np.maximum.accumulate(here), np.maximum.accumulate(here[::-1])[::-1])
            x, y = x + size, y + size
        elif kind in "IS":
            out[y : y + size] = own[y : y + size]
            y += size
        elif kind == "D":
            x += size
    return np.minimum(own, out).tolist()


Read = tuple[int, list[dict], str, list[int], str, int]


def realigned(reads: list[Read]) -> list[list[int]]:
    """The qualities of reads (pos, cigar, seq, qual, ref, where ref begins), lowered.

    As they are for reads that the model doesn't take: skips, no bases, no qualities, no reference. Reads of one length
    and band are held against references of one length together.
    """
    out = [read[3] for read in reads]
    groups: dict[tuple[int, int, int], list[tuple[int, str, int]]] = {}
    for k, (pos, cigar, seq, qual, ref, ref_start) in enumerate(reads):
        n = len(seq)
        if n and ref and len(qual) == n and qual[0] != 255 and all(op["op"] != "N" for op in cigar) and (found := _part(pos, cigar, n, ref, ref_start)):
            groups.setdefault((n, len(found[0]), found[2]), []).append((k, found[0], found[1]))
    for (n, m, band), members in groups.items():
        most = max(1, _HELD_CELLS // (3 * (n + 1) * (m + 2)))
        for at in range(0, len(members), most):
            some = members[at : at + most]
            states = posteriors([part for _, part, _ in some], [reads[k][2].upper() for k, _, _ in some], [reads[k][3] for k, _, _ in some], band)
            for (k, _, begin), *of_read in zip(some, *states, strict=True):
                out[k] = _lowered(reads[k][0], reads[k][1], reads[k][3], begin, *of_read)
    return out


def _margin() -> Column:
    """More than how far the model looks to either side of a read."""
    return F.length("seq") + F.greatest(F.length("seq").cast("long"), F.col("stop") - F.col("pos")) + 2 * BAND


def reach() -> Column:
    """How far a read and what the model sees to either side of it extend."""
    return F.col("stop") - F.col("pos") + 2 * _margin()


def realign(reads: DataFrame, chunks: DataFrame, needed: Column, width: int) -> DataFrame:
    """`reads` with lowered qualities where `needed`; chunks: (ref_name, ref_bin, ref_seq) reaching as far ahead as any read.

    What the model makes of a read depends on its CIGAR, bases, qualities and the reference around it, not on its place.
    So it is run once for each distinct set of these, which is written to the shared folder; reads look their qualities up
    by 128 bits of hash, and no read goes to Python.
    """
    has_bases = (F.length("seq") > 0) & (F.size("qual") == F.length("seq")) & (F.get("qual", F.lit(0)) != 255)
    taken = F.coalesce(needed & has_bases & ~F.exists("cigar", lambda x: x["op"] == "N"), F.lit(False))
    start = F.greatest(F.col("pos") - _margin(), F.lit(0))
    placed = reads.withColumns({"taken": taken, "ref_from": start, "first": F.floor(start / width)})
    joined = placed.join(chunks, F.col("taken") & (F.col("rname") == F.col("ref_name")) & (F.col("first") == F.col("ref_bin")), "left")
    around = F.substring("ref_seq", (F.col("ref_from") - F.col("first") * width + 1).cast("int"), (F.col("stop") - F.col("ref_from") + _margin()).cast("int"))
    joined = joined.withColumns({"ref_part": around, "ref_at": F.col("pos") - F.col("ref_from")}).drop("ref_name", "ref_bin", "ref_seq", "ref_from", "first")
    key = ("cigar", "seq", "qual", "ref_at", "ref_part")
    ids = {"id_a": F.xxhash64(*key), "id_b": F.xxhash64(F.lit("b"), *key)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("ref_at", "cigar", "seq", "qual", "ref_part")), strict=True)
            lowered = pa.array(realigned([(*row, 0) for row in rows]), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id_a"), batch.column("id_b"), lowered], ["id_a", "id_b", "lowered"])

    # in order of length, as reads of one length go through the model together
    distinct = joined.filter("taken and ref_part <> ''").select(*key).distinct().withColumns(ids)
    dealt = distinct.repartition("id_a").sortWithinPartitions(F.length("seq"), F.length("ref_part"))
    model = sized(cut(dealt.mapInArrow(run, "id_a long, id_b long, lowered array<int>"), "realigned"), SENT_BYTES)
    found = joined.withColumns({name: F.when(F.col("taken"), value) for name, value in ids.items()}).join(model, ["id_a", "id_b"], "left")
    return found.withColumn("qual", F.coalesce("lowered", "qual")).select(reads.columns)
