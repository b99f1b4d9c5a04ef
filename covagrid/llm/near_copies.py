"""Near copies by the Jaccard similarity of their sets of word shingles, found by SimHash with anchors of a covering code.

Texts with the same set are one. The stage's fingerprint is a wide SimHash of the set: `prints` words of 64 bits, cut in
blocks as `simhash.Anchors` says, each with a Hamming code of its own. A fingerprint lives at its anchor in every block.
Those that meet at an anchor, differ in few of the bits that they carry along and are of sizes that similar sets have are
nominated, and the exact similarity of their whole sets confirms them, in rounds: first each member with the smallest of the
smallest keys of its clusters, one row a member whatever the anchors at which it meets others; in clusters of several tiles
that this leaves open each member with the cluster's smallest key; last the members that the links found so far leave in
different components. Clusters of copies of one text so take no more comparisons than members. No pairs are written:
members are dealt in tiles of bounded size, which a task compares, and only links come out.

Why so wide: at similarity 0.8 the count vectors of two sets have a cosine of 8 / 9, so each bit differs with a probability
of 0.1515, 9.7 of 64 bits on average and 18 or more in one pair of 180. Anchors that find those within 17 of 64 bits
have to compare six blocks of 10 bits within 2 bits, 56 of 1024 values, so that 29 % of all pairs of texts meet. With 16 bits
to a block, 15 of them under the code, such a pair shares a block's anchor with a probability of 0.1265, unlike texts with
2 ** -12. All 88 blocks miss it with a probability of 7e-6, and 2 % of all pairs of texts meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covagrid.llm.common import byte_texts, cut, keep_numbered, map_batches, sized
from covagrid.llm.simhash import SEED, Anchors, components

_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Bands:
    """Of two sets of similarity 0.8 no block's anchor is the same with a probability of 7e-6, of more similar ones with less.

    `near` are the bits of the first `carried` words in which nominated sets may differ: 29 on average at 0.8, with a
    standard deviation of 5. A side of a tile has on average at most `tile_rows` members and `tile_hashes` hashes, unless
    one set has more; a task holds two sides. They change no result.
    """

    similarity: float = 0.8
    words: int = 5
    prints: int = 22
    anchors: Anchors = Anchors(threshold=0, blocks=4)
    carried: int = 3
    near: int = 56
    tile_rows: int = 1024
    tile_hashes: int = 1 << 20


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles, words as in `simhash`; a text of fewer words is one shingle."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), SEED)], np.uint64)
    shingles = set(map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False)))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles)))


@lru_cache
def _mixers(prints: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, (2, prints), np.uint64) | np.uint64(1)


def wide_print(hashes: np.ndarray, prints: int) -> np.ndarray:
    """SimHash of a set in `prints` words: the bits that over half the mixed hashes have.

    Each hash counts twice with different bits. With one vote each, 4 and 5 shingles differ in 0.19 of the bits, not 0.12.
    """
    (flip, factor), twice, counts = _mixers(prints), np.concatenate([hashes, ~hashes * _ODD]), np.zeros(64 * prints, np.int64)
    for start in range(0, len(twice), 255):  # so many fit a byte
        mixed = (twice[start : start + 255, None] ^ flip) * factor
        mixed ^= mixed >> np.uint64(32)
        mixed *= _ODD
        mixed ^= mixed >> np.uint64(32)
        counts += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(twice), bitorder="little").view(np.uint64)


def _apart(words: list[np.ndarray], a, b) -> np.ndarray:
    """In how many bits the fingerprints at `a` and `b` differ."""
    return sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int16) for w in words)


def _fit(a, b, similarity: float) -> np.ndarray:
    """Whether sets of sizes `a` and `b` can be similar: the smaller has at least that share of the larger."""
    return np.minimum(a, b) >= similarity * np.maximum(a, b)


def clusters(anchor: np.ndarray, words: list[np.ndarray], near: int, most: int = 256, set_sizes: np.ndarray | None = None, similarity: float = 0.0) -> list[np.ndarray]:
    """Of each run of equal anchors the components of two or more members that differences of up to `near` bits link.

    With the sets' sizes only members whose sets can be similar are linked. Runs of more than `most` members are grown
    member by member, so that a run of copies takes a step for each.
    """
    held = np.ones(len(anchor), np.int64) if set_sizes is None else set_sizes
    bounds = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1], True])
    sizes, out, root = np.diff(bounds), [], {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    ends = np.repeat(bounds[1:], sizes)
    at, step = np.flatnonzero(np.repeat(sizes <= most, sizes)), 0
    while len(at):
        step += 1
        at = at[at + step < ends[at]]
        linked = at[_apart(words, at, at + step) <= near]
        linked = linked[_fit(held[linked], held[linked + step], similarity)]
        for x, y in zip(linked.tolist(), (linked + step).tolist(), strict=True):
            root[top(x)] = top(y)
    found: dict[int, list[int]] = {}
    for x in list(root):
        found.setdefault(top(x), []).append(x)
    out += map(np.array, found.values())
    for g in np.flatnonzero(sizes > most):
        left = np.arange(bounds[g], bounds[g + 1])
        while len(left):
            grown, left, k = [left[0]], left[1:], 0
            while k < len(grown) and len(left):
                linked = (_apart(words, left, grown[k]) <= near) & _fit(held[left], held[grown[k]], similarity)
                if linked.any():
                    grown.extend(left[linked])
                    left = left[~linked]
                k += 1
            if len(grown) > 1:
                out.append(np.array(grown))
    return out


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).view(np.int64)))


def _keyed(docs: DataFrame, bands: Bands) -> DataFrame:
    """row (the whole row), doc_id, key (a hash of the set), size (of the set) and print (its fingerprint's bytes) of every row."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [shingle_set(x, bands.words) for x in byte_texts(batch.column("text"))]
        keys = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(keys), pa.array([len(s) for s in sets], pa.int64()), pa.array([wide_print(s, bands.prints).tobytes() for s in sets], pa.binary())], ["row", "doc_id", "key", "size", "print"])

    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = T.StructType([f for f in whole.schema.fields if f.name != "text"]).add("key", T.LongType()).add("size", T.LongType()).add("print", T.BinaryType())
    return map_batches(whole, each, schema)


def _clustered(nodes: DataFrame, bands: Bands) -> DataFrame:
    """(band, key, size) of the members of each cluster at an anchor; band is a hash of its members, so that equal ones are one.

    Sets too small for any other to be similar are left out; their fingerprints have few ones and would crowd anchors. A task
    holds the rows of one anchor, 48 bytes for a member. The size goes along: a text may be a member at every anchor, and
    to look it up later would take a join of all these rows.
    """
    names = [f"w{k}" for k in range(bands.carried)]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("anchor", "key", "size", *names)])

    def spread(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint64).reshape(-1, bands.prints)
        keys, sizes = batch.column("key").to_numpy(), batch.column("size").to_numpy()
        for w in range(bands.prints):
            index, anchor, _ = bands.anchors.of(words[:, w])
            yield pa.RecordBatch.from_arrays([pa.array(w << 48 | anchor), pa.array(keys[index]), pa.array(sizes[index]), *(pa.array(words[index, k].view(np.int64)) for k in range(bands.carried))], schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(anchor: np.ndarray, keys: np.ndarray, sizes: np.ndarray, *words: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = clusters(anchor, [w.view(np.uint64) for w in words], bands.near, set_sizes=sizes, similarity=bands.similarity) if len(anchor) else []
            members = [x[np.argsort(keys[x])] for x in found]
            if members:
                marks = np.array([xxhash.xxh64_intdigest(keys[m].tobytes(), SEED) for m in members], np.uint64).view(np.int64)
                all_ = np.concatenate(members)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(marks, [len(m) for m in members])), pa.array(keys[all_]), pa.array(sizes[all_])], ["band", "key", "size"])

        held = [np.empty(0, np.int64)] * len(schema)
        for batch in batches:
            rows = [np.concatenate([old, batch.column(n).to_numpy()]) for old, n in zip(held, schema.fieldNames(), strict=True)]
            last = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            yield from whole(*(x[:last] for x in rows))
            held = [x[last:] for x in rows]
        yield from whole(*held)

    # a fingerprint is a few bytes but makes many rows: adaptive execution would leave them to a task or two
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.sparkSession.sparkContext.defaultParallelism)
    able = nodes.filter((F.col("size") > 0) & (F.col("size") >= F.lit(bands.similarity) * (F.col("size") + 1)))
    dealt = map_batches(able.select("key", "size", "print").repartition(tasks, "key"), spread, schema)
    return cut(dealt.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "band long, key long, size long"), "clusters").distinct()


def _sides(members: DataFrame, group: str, bands: Bands) -> DataFrame:
    """(group, sides) of the groups that need more than one side."""
    needed = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(bands.tile_rows)), F.ceil(F.sum("size") / F.lit(bands.tile_hashes))).cast("int")
    return sized(cut(members.groupBy(group).agg(needed.alias("sides")).filter("sides > 1"), "sides"))


def _sets(nodes: DataFrame, rows: DataFrame, bands: Bands) -> DataFrame:
    """(key, set) of each of the keys `nodes`, from the text of one of its rows."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [shingle_set(x, bands.words) for x in byte_texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("key"), _lists(sets)], ["key", "set"])

    # a text may have any number of copies, so they are aggregated first; Catalyst would push a semi join below that
    numbers = rows.groupBy("key").agg(F.min("row_no").alias("row_no")).join(nodes, "key")
    texts = rows.select("row_no", "key", F.col("row.text").cast("string").alias("text"))
    return cut(keep_numbered(texts, numbers, "nominated", each, "key long, set array<long>"), "sets")


@dataclass
class _Member:
    side: int
    key: int
    root: int
    bands: np.ndarray
    set: np.ndarray


def tile_links(members: list[_Member], similarity: float, band: int | None) -> list[tuple[int, int]]:
    """Links (a, b) of similar members: of side 0 with those of side 1, of side 2 with each other.

    Only one for each two roots that they join. With a band, pairs that share a smaller one are left to that.
    """
    sides, sizes = np.array([m.side for m in members]), np.array([len(m.set) for m in members])
    label, out = np.unique([m.root for m in members], return_inverse=True)[1], []
    for x, one in enumerate(members):
        if one.side == 1:
            continue
        fits = (sides == 1) if one.side == 0 else (sides == 2) & (np.arange(len(members)) > x)
        fits &= (label != label[x]) & _fit(sizes, sizes[x], similarity)
        at = np.flatnonzero(fits)
        if band is not None and len(at):
            marks, ends = np.concatenate([members[k].bands for k in at]), np.cumsum([len(members[k].bands) for k in at])
            common = np.where(np.isin(marks, one.bands), marks, np.iinfo(np.int64).max)
            at = at[np.minimum.reduceat(common, np.r_[0, ends[:-1]]) == band]
        if not len(at):
            continue
        joined = np.concatenate([members[k].set for k in at])
        place = np.minimum(np.searchsorted(one.set, joined), len(one.set) - 1)
        shared = np.add.reduceat(one.set[place] == joined, np.cumsum(sizes[at]) - sizes[at], dtype=np.int64)
        for k in at[shared >= similarity * (sizes[at] + sizes[x] - shared)]:
            if label[k] != label[x]:
                out.append((min(one.key, members[k].key), max(one.key, members[k].key)))
                label[label == label[k]] = label[x]
    return out


def _confirmed(tiles: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) within the tiles (tile, side, key, root, band): rows of one tile meet in one task, which holds a tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, band, held = None, None, []

        def found() -> Iterator[pa.RecordBatch]:
            links = tile_links(held, similarity, band) if len(held) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            plain = zip(*(batch.column(c).to_pylist() for c in ("tile", "side", "key", "root", "band")), strict=True)
            lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column("bands"), batch.column("set"))]
            for k, (tile, side, key, root, of) in enumerate(plain):
                if tile != now:
                    yield from found()
                    now, band, held = tile, of, []
                marks, values = (all_[ends[k] : ends[k + 1]].copy() for ends, all_ in lists)
                held.append(_Member(side, key, root, marks, values.view(np.uint64)))
        yield from found()

    dealt = tiles.join(sets, "key").select("tile", "side", "key", "root", "band", "bands", "set")
    return cut(dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long").distinct(), "confirmed")


def _star_tiles(stars: DataFrame, bands: Bands) -> DataFrame:
    """Tiles of the pairs (a, b, size of b): an `a` with many partners meets them in several tiles."""
    part = F.pmod(F.xxhash64("b"), F.coalesce("sides", F.lit(1)))
    dealt = stars.join(_sides(stars, "a", bands), "a", "left").withColumn("tile", F.xxhash64("a", part))
    band = F.lit(None).cast("long").alias("band")
    partners = dealt.select("tile", F.lit(1).alias("side"), F.col("b").alias("key"), F.col("b").alias("root"), band)
    return partners.unionByName(dealt.select("tile", F.lit(0).alias("side"), F.col("a").alias("key"), F.col("a").alias("root"), band).distinct())


def _square_tiles(members: DataFrame, bands: Bands) -> DataFrame:
    """Tiles in which every two members of a band meet once: its members are dealt in cells, and any two cells are a tile."""
    dealt = members.join(_sides(members, "band", bands), "band", "left").withColumn("sides", F.coalesce("sides", F.lit(1)))
    dealt = dealt.withColumn("cell", F.pmod(F.xxhash64("key"), F.col("sides")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    side = F.when(F.col("cell") == F.col("other"), 2).when(F.col("cell") < F.col("other"), 0).otherwise(1)
    return dealt.select(F.xxhash64("band", F.least("cell", "other"), F.greatest("cell", "other")).alias("tile"), side.alias("side"), "key", "root", "band")


def _least(met: DataFrame) -> DataFrame:
    """Pairs (a, b, size of b): each key with the least of its bands' smallest keys, so that a key has one partner at most."""
    return met.filter("a < key").groupBy(F.col("key").alias("b")).agg(F.min("a").alias("a"), F.first("size").alias("size")).select("a", "b", "size")


def _open(met: DataFrame, found: DataFrame) -> DataFrame:
    """(band, key, size, root) of the bands whose members are not all in one of the components (node, root)."""
    rooted = met.join(found, met["key"] == found["node"], "left").select("band", "key", "size", F.coalesce("root", "key").alias("root"))
    ends = {"low": F.min("root").over(Window.partitionBy("band")), "high": F.max("root").over(Window.partitionBy("band"))}
    return cut(rooted.withColumns(ends).filter("low < high").select("band", "key", "size", "root"), "open")


def _roots(rows: DataFrame, bands: Bands) -> DataFrame:
    """(node, root) of the keys that have links."""
    nodes = cut(rows.select("key", "size", "print").dropDuplicates(["key"]), "nodes")
    met = cut(_clustered(nodes, bands).withColumn("a", F.min("key").over(Window.partitionBy("band"))).select("band", "a", "key", "size"), "met")
    sets = _sets(met.select("key").distinct(), rows, bands)
    bare = sets.withColumn("bands", F.array().cast("array<long>"))
    links = _confirmed(_star_tiles(cut(_least(met), "nominated"), bands), bare, bands.similarity)
    # members of one component are settled; tiles of a whole band grow with the square of their number, so that bands of
    # several tiles are first held against their smallest key
    still = _open(met, components(links))
    wide = _sides(still, "band", bands)
    if not wide.isEmpty():
        first = F.min(F.struct("key", "root")).over(Window.partitionBy("band"))
        stars = still.join(wide.select("band"), "band").withColumn("first", first).filter("first.root <> root").select(F.col("first.key").alias("a"), F.col("key").alias("b"), "size")
        links = links.unionByName(_confirmed(_star_tiles(cut(stars.distinct(), "nominated"), bands), bare, bands.similarity))
        still = _open(met, components(links))
    marked = sets.join(still.groupBy("key").agg(F.collect_list("band").alias("bands")), "key")
    more = _confirmed(_square_tiles(still, bands), marked, bands.similarity)
    return components(links.unionByName(more))


def near_dedup(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of `docs`, all columns, that stay: of each component of similar texts the one with the smallest doc_id.

    Null, empty and blank texts are similar to each other only. Null doc_ids come last; of rows that tie one stays.
    """
    rows = cut(_keyed(docs, bands).withColumn("row_no", F.monotonically_increasing_id()), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no")
    first = rows.groupBy("key").agg(F.min(order).alias("first"))
    found = _roots(rows, bands)
    rooted = first.join(found, first["key"] == found["node"], "left").select("first", F.coalesce("root", "key").alias("root"))
    stay = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row_no").alias("row_no"))
    return keep_numbered(rows, stay, "stay").select("row.*")
