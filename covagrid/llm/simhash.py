"""Near duplicates by SimHash with anchor points of a covering code.

The 64 fingerprint bits are dealt to blocks. Of two fingerprints that differ in at most `threshold` bits, at least one
block differs in no more than ``t = threshold // blocks``. A block's anchors are the words of a covering code: Hamming
words (covering radius 1) on its first ``2**r - 1`` bits, every value on the rest. Each fingerprint lives at its nearest
anchor and is replicated to every anchor that lies within the radius plus `t`, so a linked pair meets where one of
the two lives. Anchors are compared one by one; per anchor only a spanning forest of the links leaves the task, and
anchors with very many members are compared in tiles that different tasks take.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covagrid.llm.common import byte_texts, cut, keep_numbered, made, map_batches, release

SEED = 42
#: Byte -> its eight bits in the eight byte lanes of a 64-bit word.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


def simhash(text: bytes, words: int = 4) -> int:
    """Majority of the XXH64 bits of all word shingles of `text`, repeats included; 0 without words."""
    tokens = text.lower().split()  # of bytes: only A-Z are lowered, only ASCII white space splits
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    counts, total = np.zeros(64, np.int64), len(tokens) - words + 1
    hashed = xxhash.xxh64_intdigest
    for start in range(0, total, 1 << 16):
        run = tokens[start : start + (1 << 16) + words - 1]
        shingles = map(b" ".join, zip(*(run[k:] for k in range(words)), strict=False))
        hashes = np.fromiter((hashed(s, SEED) for s in shingles), np.uint64)
        lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
        counts += np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, rows: bool = False) -> DataFrame:
    """doc_id and print (the 64 bits as a signed long) of every row; rows: and the whole row as a struct."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        prints = np.array([simhash(x, words) for x in byte_texts(batch.column("text"))], np.uint64).view(np.int64)
        carried = [batch.column(n) for n in names]
        yield pa.RecordBatch.from_arrays([*carried, pa.array(prints)], [*names, "print"])

    names = ["doc_id", *["row"] * rows]
    whole = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] * rows
    texts = docs.select(F.col("doc_id").cast("long"), *whole, F.col("text").cast("string"))
    schema = T.StructType([f for f in texts.schema.fields if f.name != "text"]).add("print", T.LongType())
    return map_batches(texts, each, schema)


@dataclass(frozen=True)
class Anchors:
    """Which bits a block has and how many of them the Hamming code spans."""

    threshold: int = 4
    blocks: int = 3
    hamming_r: int = 4

    def widths(self) -> list[tuple[int, int]]:
        """First bit and number of bits of each block."""
        cuts = [64 * k // self.blocks for k in range(self.blocks + 1)]
        return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]

    def of(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the print, anchor, whether it lives there), a row for each replica."""
        n, t = (1 << self.hamming_r) - 1, self.threshold // self.blocks
        near = _near(self.hamming_r, t)
        home = near[0][:, 0]
        index, anchor, lives = [], [], []
        every = np.arange(len(prints), dtype=np.int64)
        for block, (start, width) in enumerate(self.widths()):
            part = (prints >> np.uint64(start)) & np.uint64((1 << width) - 1)
            low, high = (part & np.uint64((1 << n) - 1)).astype(np.int64), (part >> np.uint64(n)).astype(np.int64)
            for flips in range(t + 1):
                words = near[t - flips]
                for bits in combinations(range(width - n), flips):
                    raw = high ^ sum(1 << b for b in bits)
                    for column in range(words.shape[1]):
                        word = words[low, column]
                        there = word >= 0
                        index.append(every[there])
                        anchor.append(((block << 40) | (raw << n) | word)[there])
                        lives.append(np.full(there.sum(), flips == 0) & (word == home[low])[there])
        return np.concatenate(index), np.concatenate(anchor), np.concatenate(lives)


@lru_cache
def _near(r: int, t: int) -> list[np.ndarray]:
    """near[d][u]: the Hamming words within 1 + d bits of u, the nearest first, padded with -1; d up to t."""
    n = (1 << r) - 1
    every = np.arange(1 << n, dtype=np.int64)
    syndrome = np.zeros_like(every)
    for bit in range(n):
        syndrome ^= np.where(every >> bit & 1, bit + 1, 0)
    flip = np.array([0, *(1 << b for b in range(n))], np.int64)
    nearest = every ^ flip[syndrome]
    out = []
    for d in range(t + 1):
        columns = [nearest]
        for size in range(1, 2 + d):
            for bits in combinations(range(n), size):
                word = every ^ sum(1 << b for b in bits)
                columns.append(np.where((syndrome[word] == 0) & (word != nearest), word, -1))
        table = np.stack(columns, axis=1)
        rest = -np.sort(-table[:, 1:], axis=1)
        keep = int((rest >= 0).sum(axis=1).max(initial=0))
        out.append(np.concatenate([table[:, :1], rest[:, :keep]], axis=1))
    return out


def _forest(prints: np.ndarray, homes: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of one anchor's link graph: those of `homes` (indexes) to any of `prints`."""
    label, links = np.arange(len(prints)), []
    for h in homes:
        linked = np.flatnonzero(np.bitwise_count(prints ^ prints[h]) <= threshold)
        found, first = np.unique(label[linked], return_index=True)
        if len(found) > 1:
            mine = label[h]
            links += [(int(prints[h]), int(prints[linked[k]])) for f, k in zip(found, first, strict=True) if f != mine]
            label[np.isin(label, found)] = mine
    return links


_SMALL = 64


def _compare(anchor: np.ndarray, lives: np.ndarray, prints: np.ndarray, threshold: int) -> tuple[list[int], list[int]]:
    """Links within each run of equal anchors."""
    bounds = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1], True])
    sizes = np.diff(bounds)
    left, right = [], []
    group = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(lives & (sizes[group] > 1) & (sizes[group] <= _SMALL))
    for lo in range(0, len(at), 1 << 15):
        homes = at[lo : lo + (1 << 15)]
        width = sizes[group[homes]]
        a = np.repeat(homes, width)
        b = np.repeat(bounds[group[homes]], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        ok = (np.bitwise_count(prints[a] ^ prints[b]) <= threshold) & (a != b)
        root: dict[int, int] = {}

        def top(x: int, root=root) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
            if (p := top(x)) != (q := top(y)):
                root[p] = q
                left.append(int(prints[x]))
                right.append(int(prints[y]))
    for g in np.flatnonzero(sizes > _SMALL):
        rows = slice(bounds[g], bounds[g + 1])
        for x, y in _forest(prints[rows], np.flatnonzero(lives[rows]), threshold):
            left.append(x)
            right.append(y)
    return left, right


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


_LINKS = "a long, b long, anchor long, print long, lives boolean"


def _links(replicas: DataFrame, key: str, threshold: int, most: int) -> DataFrame:
    """Links (a, b) of each run of equal `key` in sorted partitions; runs above `most` come back as they are."""

    def out(left: list, right: list) -> pa.RecordBatch:
        a, b = np.array(left, np.uint64).view(np.int64), np.array(right, np.uint64).view(np.int64)
        blank = pa.nulls(len(left), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), blank, blank, pa.nulls(len(left), pa.bool_())], ["a", "b", "anchor", "print", "lives"])

    def back(anchor: np.ndarray, lives: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        blank = pa.nulls(len(anchor), pa.int64())
        return pa.RecordBatch.from_arrays([blank, blank, pa.array(anchor), pa.array(prints.view(np.int64)), pa.array(lives)], ["a", "b", "anchor", "print", "lives"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.uint64))
        large: int | None = None  # the anchor whose rows are being handed back
        for batch in batches:
            new = _numbers(batch, key), _numbers(batch, "lives").astype(bool), _numbers(batch, "print").view(np.uint64)
            rows = tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            if large is not None:
                mine = rows[0] == large
                if mine.any():
                    yield back(*(x[mine] for x in rows))
                if mine.all():
                    held = tuple(x[:0] for x in rows)
                    continue
                rows, large = tuple(x[~mine] for x in rows), None
            last = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            yield from whole(*(x[:last] for x in rows))
            held = tuple(x[last:] for x in rows)
            if len(held[0]) > most:
                large = int(held[0][0])
                yield back(*held)
                held = tuple(x[:0] for x in held)
        yield from whole(*held)

    def whole(anchor: np.ndarray, lives: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(anchor):
            return
        _, inverse, sizes = np.unique(anchor, return_inverse=True, return_counts=True)
        wide = sizes[inverse] > most
        if wide.any():
            yield back(anchor[wide], lives[wide], prints[wide])
        left, right = _compare(anchor[~wide], lives[~wide], prints[~wide], threshold) if not wide.all() else ([], [])
        if left:
            yield out(left, right)

    return replicas.repartition(F.col(key)).sortWithinPartitions(key).select(key, "lives", "print").mapInArrow(run, _LINKS)


def links(prints: DataFrame, anchors: Anchors, most: int = 4096) -> DataFrame:
    """Distinct links (a < b) that connect every two of the distinct `prints` that are within the threshold.

    They join the right components; links that a chain of others implies may be missing. Anchors with more than `most`
    members are compared in square tiles of at most about `most` rows a side.
    """

    def spread(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values = _numbers(batch, "print").view(np.uint64)
        index, anchor, lives = anchors.of(values)
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(values[index].view(np.int64)), pa.array(lives)], ["anchor", "print", "lives"])

    threshold = anchors.threshold
    # a print is a few bytes but makes many replicas: adaptive execution would leave them to a task or two
    tasks = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), prints.sparkSession.sparkContext.defaultParallelism)
    replicas = map_batches(prints.select("print").repartition(tasks, "print"), spread, "anchor long, print long, lives boolean")
    first = cut(_links(replicas, "anchor", threshold, most), "links")
    wide = first.filter("anchor is not null").select("anchor", "print", "lives")
    sides = wide.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / F.lit(most / 2)).cast("int").alias("sides"))
    cell = F.pmod(F.xxhash64("print"), F.col("sides")).cast("int")
    dealt = wide.join(sides, "anchor").withColumn("cell", cell).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    # a tile holds the residents of one cell and the members of another; a resident in its own cell's tile is both
    member = dealt.select("anchor", F.col("other").alias("i"), F.col("cell").alias("j"), "print", (F.col("lives") & (F.col("other") == F.col("cell"))).alias("lives"))
    resident = dealt.filter(F.col("lives") & (F.col("other") != F.col("cell"))).select("anchor", F.col("cell").alias("i"), F.col("other").alias("j"), "print", "lives")
    tiles = member.unionByName(resident).withColumn("tile", F.xxhash64("anchor", "i", "j")).select("tile", "print", "lives")
    second = _links(tiles, "tile", threshold, 1 << 62).filter("a is not null").select("a", "b")
    return first.filter("a is not null").select("a", "b").unionByName(second).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that `edges` connect each of their nodes with.

    Alternating large-star and small-star steps, each over the edge table only, until the edges are stars.
    """
    now = cut(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct(), "edges")
    past = made()[-1]
    mark = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        root = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(root, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a < b").distinct()
        now = cut(small, "stars")
        release(now.sparkSession, [past])  # only this step read it
        past = made()[-1]
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _roots(prints: DataFrame, anchors: Anchors, most: int) -> DataFrame:
    """(print, root): the component of every distinct print."""
    nodes = prints.select("print").distinct()
    found = components(links(nodes, anchors, most))
    return nodes.join(found, nodes["print"] == found["node"], "left").select("print", F.coalesce("root", "print").alias("root"))


def simhash_groups(docs: DataFrame, words: int = 4, anchors: Anchors = Anchors(), most: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of `docs` (doc_id, text).

    component_id is the smallest doc_id that links reach, a fingerprint's own documents included. A null or empty
    text, or one of white space, has fingerprint zero and is linked like any other. Null doc_ids are passed over by the
    smallest; repeated rows are separate rows of one component. Long texts are read whole, and other columns are ignored
    whatever their names. An empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, words), "prints")
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("first"))
    rooted = cut(nodes.join(_roots(prints, anchors, most), "print"), "roots")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = cut(rooted.join(smallest, "root").select("print", "component_id"), "labels")
    return prints.join(labels, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, words: int = 4, anchors: Anchors = Anchors(), most: int = 4096) -> DataFrame:
    """The rows of `docs`, all columns, that stay: of each component the one with the smallest doc_id.

    Null doc_ids come last; of rows that tie one stays. Other columns may have any names.
    """
    rows = cut(fingerprints(docs, words, rows=True).withColumn("row_no", F.monotonically_increasing_id()), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no")
    first = rows.groupBy("print").agg(F.min(order).alias("first"))
    rooted = first.join(_roots(rows, anchors, most), "print")
    stay = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row_no").alias("row_no"))
    return keep_numbered(rows, stay, "stay").select("row.*")
