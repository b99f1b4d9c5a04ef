"""Best-fit packing of tokenized documents into sequences of fixed capacity, in bulk-synchronous steps.

Only the length of a piece matters to a packing, and lengths are whole numbers up to the capacity. So documents are
sorted by length with a distributed counting sort (a count per task and length, prefix sums over tasks): each piece gets
its rank among those of its length. Gaps are kept sorted too, as runs of sequences with the same gap. A step takes the
longest length left, sweeps to its successor, the smallest gap that holds it, and matches a whole run at once: the
pieces' ranks decide which of them takes which sequence, several per sequence if the gap holds several. Gaps are updated
and the steps repeat. That is exactly best-fit decreasing, one step for many pieces. A step needs a table with a row
for each length and each run, which does not grow with the documents, so the sweep runs where that table is and only its
outcome, which ranks go where, is sent to the tasks that place the pieces.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from covagrid.llm.common import cut, sized

END_OF_DOCUMENT = 1
_LETTERS = "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == "L")
_NUMBERS = "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == "N")
#: How the vocabulary's own splitter cuts words, for the characters that `_PLAIN` allows.
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
#: Texts of these characters only: normal forms, lower case, white space and classes are the same in every library.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ňŊ-ŷŹ-ž]*")
_HELD_WORDS = 150_000  # twice as many with the older ones


class WordTokenizer:
    """Ids of a text as the tokenizer file gives them, as little-endian unsigned 32-bit numbers.

    The ids of a text are those of its words one after the other. So each new word is encoded once and held; texts
    with other than plain characters, or with the string of a special token, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.held: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != len(some):
                raise ValueError("the words and the tokenizer's ends of words disagree")
            data, start = ids.tobytes(), 0
            for word, stop in zip(some, stops.tolist(), strict=True):
                self.held[word] = data[start:stop]
                start = stop

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; new words of all of them are encoded together."""
        split = [None if _PLAIN.fullmatch(t) is None or any(s in t for s in self.special) else _WORDS.findall(t.lower()) for t in texts]
        if len(self.held) > _HELD_WORDS:  # words that come again move over, the others go the next time
            self.held, self.older = {}, self.held
        held, older = self.held, self.older
        new = set().union(*filter(None, split)).difference(held)
        for word in [w for w in new if w in older]:
            held[word] = older[word]
            new.discard(word)
        self.learn(list(new))
        return [
            np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if words is None else b"".join(map(held.__getitem__, words))
            for text, words in zip(texts, split, strict=True)
        ]


def _runs(texts: list[str | None], most: int = 1_000_000) -> Iterator[list[str]]:
    """The texts in runs of about `most` characters."""
    run, size = [], 0
    for text in texts:
        run.append(text or "")
        size += len(run[-1])
        if size > most:
            yield run
            run, size = [], 0
    if run:
        yield run


@lru_cache
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, keep_ids: bool = False) -> DataFrame:
    """The pieces of each document, at most `capacity` ids long, with their place among those of one task and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, task, seen = _tokenizer(tokenizer_path), TaskContext.get().partitionId(), {}
        end = np.array([END_OF_DOCUMENT], "<u4").tobytes()
        for batch in batches:
            rows = []
            texts = batch.column("text").to_pylist()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), (x for some in _runs(texts) for x in ids_of(some)), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    place = seen.get(n, 0)
                    seen[n] = place + 1
                    rows.append((doc_id, piece, at // 4, n, zlib.crc32(part), task, place, part)[: 8 if keep_ids else 7])
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=False)], names[: 8 if keep_ids else 7])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(run, _PIECES + ", ids binary" * keep_ids)


def best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Where pieces of each length go: rows (length, first rank, first sequence, pieces a sequence, offset in it).

    A row holds for the ranks up to the next row of its length.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, sequences)
    gaps, opened, out = 0, 0, []  # gaps: a bit for each gap that some run has

    def update(gap: int, first: int, n: int) -> None:
        nonlocal gaps
        if gap and n:
            runs.setdefault(gap, []).append((first, n))
            gaps |= 1 << gap

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            above = gaps >> length
            if above:
                gap = length + (above & -above).bit_length() - 1
                first, n = runs[gap].pop()
                if not runs[gap]:
                    gaps &= ~(1 << gap)
            else:
                gap, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            each = gap // length
            out.append((length, rank, first, each, capacity - gap))
            took = min(left, n * each)
            full, rest = divmod(took, each)
            update(gap - each * length, first, full)
            if rest:
                update(gap - rest * length, first + full, 1)
            update(gap, first + full + bool(rest), n - full - bool(rest))
            rank, left = rank + took, left - took
    return np.array(out, np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to `pieces` (any table with length, task and place that reads the same each time).

    Sequences are filled without gaps from 0; their numbers start at 0.
    """
    per_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    per_task = cut(per_task, "counts")
    ahead = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = sized(cut(per_task.select("length", "task", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before")), "ranks"))
    # one row for each length, so at most `capacity` rows
    counts = {r[0]: r[1] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit(counts, capacity)
    bounds = np.searchsorted(-plan[:, 0], [-n for n in range(capacity + 2)]) if len(plan) else np.zeros(capacity + 2, int)
    sent = pieces.sparkSession.sparkContext.broadcast((plan, bounds))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, bounds = sent.value
        key = plan[:, 0] * -(1 << 50) + plan[:, 1]  # ascending, as lengths fall and ranks rise
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            row = plan[np.searchsorted(key, length * -(1 << 50) + rank, side="right") - 1] if len(length) else plan[:0]
            nth = rank - row[:, 1]
            names = [n for n in batch.schema.names if n not in ("rank", "task", "place", "before")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length)], [*names, "sequence_id", "offset"])

    ranked = pieces.join(before, ["length", "task"]).withColumn("rank", F.col("place") + F.col("before")).drop("task", "place", "before")
    kept = [f for f in ranked.schema.fields if f.name != "rank"]
    return ranked.mapInArrow(place, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if kept) for every piece of every document.

    A null or empty text is its end mark alone. Null and repeated doc_ids are documents like any other, long texts are
    encoded whole and then cut, and other columns are ignored whatever their names. An empty table gives an empty result.
    """
    pieces = cut(token_pieces(docs, tokenizer_path, capacity, keep_ids), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids]
    return pack(pieces, capacity).select(columns)


def sequences(packed: DataFrame, capacity: int = 4096, pad: int = 0) -> DataFrame:
    """sequence_id, ids (array of `capacity` ints) and used (how many are not padding) from packed pieces with ids."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, used = [], []
            for parts in batch.column("parts").to_pylist():
                data = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int32)
                used.append(len(data))
                rows.append(np.pad(data, (0, capacity - len(data)), constant_values=pad))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(rows, pa.list_(pa.int32())), pa.array(used, pa.int32())], ["sequence_id", "ids", "used"])

    lists = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return lists.mapInArrow(fill, "sequence_id long, ids array<int>, used int")
