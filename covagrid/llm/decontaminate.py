"""Benchmark passages in documents, found by the q-gram lemma and verified by banded alignment.

If a document holds an item of n characters with at most k edits, then at least ``n - q + 1 - q * k`` of the item's
q-grams stand in it, all on diagonals (text position minus item position) that differ by no more than k. So hits
are counted in diagonal bands of width 2 (k + 1) at steps of k + 1, of which one holds any such set; bands with
enough hits are kept, and only there the item is aligned, within the band; bands that touch are aligned together. In a
text of repeated characters a gram meets an item's grams everywhere; there hits are counted by runs, not one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covagrid.llm.common import keep_rows, map_batches

_STEP = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22


def normal(text: str | None) -> str:
    """Lower case, each run of white space one space, trimmed."""
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_hashes(values: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every run of `q` values, from those of shorter runs."""
    if len(values) < q:
        return np.empty(0, np.uint64)
    total, done, power, width, base, rest = None, 0, _STEP, 1, values + np.uint64(1), q
    with np.errstate(over="ignore"):
        while True:  # base: hashes of runs of `width`; power: the multiplier to the `width`
            if rest & 1:
                n = len(values) - done - width + 1
                total = base[:n].copy() if total is None else total[:n] * power + base[done : done + n]
                done += width
            rest >>= 1
            if not rest:
                return total[: len(values) - q + 1]
            base = base[:-width] * power + base[width:]
            power, width = power * power, width * 2


def _slot(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((hashes ^ (hashes >> np.uint64(29))) * _STEP) >> np.uint64(64 - _FILTER_BITS)


@dataclass
class Index:
    """The q-grams of those items of a block that are searched with the same `q`."""

    q: int
    numbers: list[int]  # of the items in the block
    texts: list[str]
    budgets: np.ndarray
    needed: np.ndarray
    grams: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    places: np.ndarray
    filter: np.ndarray


@dataclass
class Block:
    indexes: list[Index]
    short: list[tuple[int, str]]  # items that are looked for as whole words


def build_index(items: list[tuple[int, str]], q: int, share: float) -> Block:
    """`share`: the edits allowed, as a share of an item's length.

    An item of n characters and k edits is searched with grams of n // (k + 1) characters, if that is less than `q`: k
    edits then leave one of its grams at least. Items shorter than `q` that allow no edit are looked for as words.
    """
    texts = [normal(t) for _, t in items]
    groups: dict[int, list[int]] = {}
    short = []
    for k, text in enumerate(texts):
        edits = int(len(text) * share)
        if edits or len(text) >= q:
            groups.setdefault(min(q, len(text) // (edits + 1)), []).append(k)
        elif text:
            short.append((k, text))
    return Block([_grams(width, numbers, [texts[k] for k in numbers], share) for width, numbers in sorted(groups.items())], short)


def _grams(q: int, numbers: list[int], texts: list[str], share: float) -> Index:
    lengths = np.array([len(t) for t in texts], np.int64)
    budgets = (lengths * share).astype(np.int64)
    hashes = [gram_hashes(codes(t), q) for t in texts]
    flat = np.concatenate(hashes)
    order = np.argsort(flat, kind="stable")
    item = np.repeat(np.arange(len(texts)), [len(h) for h in hashes])[order]
    place = np.concatenate([np.arange(len(h)) for h in hashes])[order].astype(np.int64)
    grams, starts = np.unique(flat[order], return_index=True)
    bits = np.zeros(1 << _FILTER_BITS, bool)
    bits[_slot(grams)] = True
    return Index(q, numbers, texts, budgets, lengths - q + 1 - q * budgets, grams, np.append(starts, len(flat)), item, place, bits)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int, fixed: bool = False) -> tuple[int, int] | None:
    """Fewest edits between the item and a part of the text on diagonals low to high, and where that part ends.

    None above `budget`. fixed: the part starts at 0.
    """
    diagonals = np.arange(low, high + 1)
    far = len(item) + len(text) + 1
    outside = lambda at: (at < 0) | (at > len(text))
    row = np.where(outside(diagonals), far, 0 if not fixed else np.where(diagonals >= 0, diagonals, far))
    padded = np.concatenate([text, [np.uint64(0)]])
    for i in range(1, len(item) + 1):
        at = diagonals + i  # how much of the text is used
        same = padded[np.clip(at - 1, 0, len(text))] == item[i - 1]
        step = row + ~(same & (at >= 1) & (at <= len(text)))
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        step[outside(at)] = far
        row = np.minimum.accumulate(step - diagonals) + diagonals
        row[outside(at)] = far
        if row.min() > budget:
            return None
    best = int(row.argmin())
    return (int(row[best]), int(diagonals[best]) + len(item)) if row[best] <= budget else None


def _expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


_MANY = 1_000_000
Region = tuple[int, int, int, int]


def regions(texts: list[str], index: Index) -> list[Region]:
    """(text, item, lowest diagonal, highest) of what the counts leave; those of one text and item don't touch."""
    joined = "\0".join(texts)
    hashes = gram_hashes(codes(joined), index.q)
    at = np.flatnonzero(index.filter[_slot(hashes)])
    gram = np.minimum(np.searchsorted(index.grams, hashes[at]), len(index.grams) - 1)
    exact = index.grams[gram] == hashes[at]
    at, gram = at[exact], gram[exact]
    if not len(at):
        return []
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    sizes = index.starts[gram + 1] - index.starts[gram]
    owner = np.searchsorted(begins, at, side="right") - 1
    hits = np.bincount(owner, sizes, len(texts))
    found: list[np.ndarray] = []
    # whole texts at a time, so that no band is cut
    for text in np.flatnonzero(hits > _MANY):
        mine = owner == text
        found += _crowded(int(text), at[mine] - begins[text], gram[mine], index)
    few = hits[owner] <= _MANY
    parts = np.cumsum(np.where(hits > _MANY, 0, hits)) // _MANY
    for part in np.unique(parts[owner[few]]):
        mine = few & (parts[owner] == part)
        entry = _expand(index.starts[gram[mine]], sizes[mine])
        position, text = np.repeat(at[mine], sizes[mine]), np.repeat(owner[mine], sizes[mine])
        found.append(_bands(text, index.items[entry], position - begins[text] - index.places[entry], index, len(joined)))
    rows = np.concatenate(found)
    return [tuple(r) for r in _merged(rows).tolist()]


def _bands(text: np.ndarray, item: np.ndarray, diagonal: np.ndarray, index: Index, size: int) -> np.ndarray:
    """Rows (text, item, low, high) of the bands of 2 (k + 1) diagonals at steps of k + 1 with enough of the hits."""
    band = (diagonal + size) // (index.budgets[item] + 1)
    pair = text * len(index.texts) + item
    width = 2 * size + 8
    keys, counts = np.unique(np.concatenate([pair * width + band, pair * width + band - 1]), return_counts=True)
    pair, band = keys // width, keys % width
    item = pair % len(index.texts)
    ok = counts >= index.needed[item]
    pair, band, item = pair[ok], band[ok], item[ok]
    low = band * (index.budgets[item] + 1) - size
    return np.stack([pair // len(index.texts), item, low, low + 2 * index.budgets[item] + 1], axis=1)


def _merged(rows: np.ndarray) -> np.ndarray:
    """The rows with those of one text and item that touch made one."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    if len(rows) < 2:
        return rows
    # bands of one item have one width, so the order of lows is that of highs
    apart = (rows[1:, :2] != rows[:-1, :2]).any(axis=1) | (rows[1:, 2] > rows[:-1, 3] + 1)
    first = np.flatnonzero(np.r_[True, apart])
    last = np.r_[first[1:], len(rows)] - 1
    return np.concatenate([rows[first][:, :3], rows[last][:, 3:]], axis=1)


def _crowded(text: int, at: np.ndarray, gram: np.ndarray, index: Index) -> list[np.ndarray]:
    """Bands of a text with very many hits, item by item: over all diagonals at once where an item has more hits than that."""
    order = np.lexsort((at, gram))
    at, gram = at[order], gram[order]
    own, first, times = np.unique(gram, return_index=True, return_counts=True)
    entry = _expand(index.starts[own], index.starts[own + 1] - index.starts[own])
    which = np.repeat(np.arange(len(own)), index.starts[own + 1] - index.starts[own])  # the text's gram of each entry
    by_item = np.argsort(index.items[entry], kind="stable")
    entry, which = entry[by_item], which[by_item]
    items, starts = np.unique(index.items[entry], return_index=True)
    out = []
    for item, a, b in zip(items.tolist(), starts.tolist(), [*starts.tolist()[1:], len(entry)], strict=True):
        grams, places = which[a:b], index.places[entry[a:b]]
        sizes = times[grams]
        if sizes.sum() < index.needed[item]:
            continue
        if sizes.sum() <= _MANY:
            positions = at[_expand(first[grams], sizes)]
            diagonal = positions - np.repeat(places, sizes)
            same = np.full(len(diagonal), text), np.full(len(diagonal), item)
            out.append(_bands(*same, diagonal, index, int(at.max()) + len(index.texts[item]) + 1))
        else:
            out.append(_dense(text, item, at, first, times, grams, places, index))
    return out


def _runs(sorted_places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of consecutive places."""
    first = np.flatnonzero(np.r_[True, np.diff(sorted_places) != 1])
    return sorted_places[first], np.diff(np.r_[first, len(sorted_places)])


def _dense(text: int, item: int, at: np.ndarray, first: np.ndarray, times: np.ndarray, grams: np.ndarray, places: np.ndarray, index: Index) -> np.ndarray:
    """The bands of one item, from the number of hits on every diagonal.

    A run of a gram in the text and one in the item meet on a trapezoid of diagonals, four steps of its second difference.
    """
    n, step = len(index.texts[item]), int(index.budgets[item]) + 1
    size = int(at.max()) + n + 2 * step + 4
    single, bend = np.zeros(size, np.int64), np.zeros(size, np.int64)
    order = np.lexsort((places, grams))
    grams, places = grams[order], places[order]
    cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(grams) != 0]), len(grams)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        g = grams[a]
        begin, length = _runs(at[first[g] : first[g] + times[g]])
        for u, m in zip(*(x.tolist() for x in _runs(places[a:b])), strict=True):
            shift = begin - u + n
            lone = (length == 1) & (m == 1)
            np.add.at(single, shift[lone], 1)
            shift, long = shift[~lone], length[~lone]
            for place, sign in ((shift - m + 1, 1), (shift + 1, -1), (shift + long - m + 1, -1), (shift + long + 1, 1)):
                np.add.at(bend, place, sign)
    total = np.cumsum(np.r_[0, single + np.cumsum(np.cumsum(bend))])
    low = np.arange(0, size - 2 * step, step)
    ok = total[low + 2 * step] - total[low] >= index.needed[item]
    low = low[ok] - n
    return np.stack([np.full(len(low), text), np.full(len(low), item), low, low + 2 * step - 1], axis=1)


_WIDE = 1 << 16


def scan(texts: list[str], block: Block) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, start, end) of each item in each text: the place with the fewest edits, then the first found."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for index in block.indexes:
        values: dict[int, np.ndarray] = {}
        looked: set[tuple[int, int]] = set()
        for text, item, low, high in regions(texts, index):
            key, wanted = (text, index.numbers[item]), index.texts[item]
            if key not in looked:
                looked.add(key)
                if (start := texts[text].find(wanted)) >= 0:
                    best[key] = (0, start, start + len(wanted))
            if item not in values:
                values[item] = codes(wanted)
            budget = int(index.budgets[item])
            while low <= high:  # pieces of a wide region share enough diagonals for any match
                budget = min(budget, best[key][0] - 1) if key in best else budget
                if budget < 0:
                    break
                if hit := _place(values[item], texts[text], low, min(high, low + _WIDE + 2 * budget), budget):
                    best[key] = min(best.get(key, hit), hit)
                low += _WIDE
    for item, words in block.short:
        for text, whole in enumerate(texts):
            if (start := f" {whole} ".find(f" {words} ")) >= 0:
                best[text, item] = (0, start, start + len(words))
    return [(t, i, *rest) for (t, i), rest in sorted(best.items())]


def _place(item: np.ndarray, text: str, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of the item on diagonals low to high."""
    n = len(item)
    a, b = max(0, low - budget), max(0, min(len(text), high + n + budget))
    part = codes(text[a:b])
    hit = align(item, part, low - a, high - a, budget)
    if hit is None:
        return None
    edits, end = hit
    begin = max(0, end - n - budget)
    back = align(item[::-1], part[begin:end][::-1], -budget, budget, edits, fixed=True)
    return edits, a + end - (back[1] if back else n), a + end


MATCHES = "doc_id long, item_id long, edits int, start long, end long"
_GROUP_CHARS = 500_000


def _grouped(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, normal texts) of runs of about `_GROUP_CHARS` characters."""
    held, first, size = [], 0, 0
    for k, text in enumerate(texts):
        held.append(normal(text))
        size += len(held[-1])
        if size > _GROUP_CHARS or k == len(texts) - 1:
            yield first, held
            held, first, size = [], k + 1, 0


def _blocks(benchmark: DataFrame, q: int, share: float, block_chars: int) -> Iterator[tuple]:
    """Broadcast indexes of blocks of items; a block is bounded by `block_chars` and its longest item."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    for block in range(blocks):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        some = sorted(((r[0], r[1]) for r in some), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        yield benchmark.sparkSession.sparkContext.broadcast(build_index(some, q, share)), [i for i, _ in some]


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, q: int = 8, share: float = 0.1, block_chars: int = 1 << 22) -> DataFrame:
    """doc_id, item_id, edits, start, end: each benchmark item that a document holds with edits up to `share` of it.

    Texts are compared in lower case with runs of white space as one space; start and end (exclusive) are places in
    the text so written. Items that are empty match nothing; those shorter than `q` that allow no edit match whole words. The
    benchmark is a stated query set: it is taken in blocks of about `block_chars` characters, each of which goes to
    every task, and each block reads all documents. Null and empty texts hold nothing; null doc_ids and repeated rows
    give rows of their own; of rows that repeat an item_id each counts; other columns are ignored whatever their names. Texts are searched whole; a
    long one, also of one repeated character, takes time and memory in proportion. Empty tables give an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("text is not null")
    out = None
    for sent, item_ids in _blocks(benchmark, q, share, block_chars):

        def each(batch: pa.RecordBatch, sent=sent, item_ids=item_ids) -> Iterator[pa.RecordBatch]:
            ids = batch.column("doc_id").to_pylist()
            hits = [(ids[first + t], item_ids[i], *rest) for first, held in _grouped(batch.column("text").to_pylist()) for t, i, *rest in scan(held, sent.value)]
            if hits:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*hits, strict=True), kinds, strict=True)], ["doc_id", "item_id", "edits", "start", "end"])

        part = map_batches(texts, each, MATCHES)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, q: int = 8, share: float = 0.1, block_chars: int = 1 << 22) -> DataFrame:
    """The rows of `docs`, all columns, that hold no benchmark item by the rules of `benchmark_matches`."""
    for sent, _ in _blocks(benchmark, q, share, block_chars):

        def clean(texts: pa.Array, sent=sent) -> list[bool]:
            ok = [True] * len(texts)
            for first, held in _grouped(texts.to_pylist()):
                for hit in scan(held, sent.value):
                    ok[first + hit[0]] = False
            return ok

        docs = keep_rows(docs, clean)
    return docs
