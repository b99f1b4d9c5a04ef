"""A quality classifier without labels: heuristic labellers, their accuracies by EM, and a hashed linear scorer.

Each labeller looks at one trait of a text and votes good, bad or not at all. Expectation-maximisation over the counts of
all vote patterns (3 to the number of labellers, whatever the corpus) estimates how each labeller votes on good and on
bad texts, and from that the posterior of each pattern. The posteriors are soft labels for a logistic scorer over hashed
words and word shapes, trained on a bounded sample; it then scores every whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covagrid.llm.common import byte_texts, cut, keep_rows, map_batches

SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"
CAPITALS = bytes(range(65, 91))
LETTERS = CAPITALS + bytes(range(97, 123)) + bytes(range(0xC3, 0xC6))
ENDS = (b".", b"!", b"?", b":", b'"', b"\xe2\x80\xa6", b"\xc2\xbb", b"\xe2\x80\x9d")
STOP_WORDS = frozenset(
    "the of and to in a is that it for as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so "
    "der die und das ist nicht ein eine zu den mit von sich auf dem des im für auch es an als wie bei oder aus "
    "le la les et est une un des du que dans qui pour pas sur au avec ce il sont plus par "
    "el los las y en que de un una es por con para no su al lo como más del se".encode().split()
)
DIMENSIONS = 1 << 18
_HELD_WORDS = 50_000
#: So many words count half.
EVIDENCE = 4
#: Words of a stretch in which variety is measured, so that it doesn't fall with the length of a text.
STRETCH = 100


def _vote(bad: bool, good: bool) -> int:
    return 2 if bad else 1 if good else 0


def _rate(count: float, total: int, neutral: float, weight: int) -> float:
    """A share with `weight` imagined cases of a neutral one, so that little evidence brings no vote, at no fixed size."""
    return (count + weight * neutral) / (total + weight)


def repeats(words: list[bytes]) -> int:
    """How many words the next word repeats."""
    return sum(map(eq, words, words[1:]))


def variety(words: list[bytes]) -> float:
    """The share of different words in stretches of STRETCH words, on average; the last one may overlap the one before."""
    n = len(words)
    if n <= STRETCH:
        return len(set(words)) / n
    starts = [*range(0, n - STRETCH, STRETCH), n - STRETCH]
    return sum([len(set(words[a : a + STRETCH])) for a in starts]) / (len(starts) * STRETCH)


def votes(text: bytes, words: list[bytes]) -> tuple[int, ...]:
    """One vote of each labeller: 0 none, 1 good, 2 bad. A text without words gets none."""
    n = len(words)
    if not n:
        return (0,) * LABELLERS
    solid = sum(map(len, words))
    letters = len(text) - len(text.translate(None, LETTERS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    symbols = _rate(len(text) - len(text.translate(None, SYMBOLS)), solid, 0.05, 10)
    capitals = _rate(len(text) - len(text.translate(None, CAPITALS)), letters, 0.25, 20)
    shouts = _rate(text.count(b"!"), n, 0.1, 2)
    length = _rate(solid, n, 9, 4)
    ended = _rate(sum(x.rstrip().endswith(ENDS) for x in lines), len(lines), 0.5, 3)
    stops = _rate(sum(map(STOP_WORDS.__contains__, words)), n, 0.06, 20)
    ragged = _rate(sum([w[-1] in SYMBOLS for w in words]), n, 0.1, 2)
    stutter = _rate(repeats(words), n, 0.05, 5)
    top = _rate(max(Counter(words).values()), n, 0.15, 20)
    varied = _rate(variety(words) * min(n, STRETCH), min(n, STRETCH), 0.4, 20)
    return (
        _vote(symbols > 0.1, symbols < 0.02),
        _vote(capitals > 0.4, capitals < 0.15),
        _vote(shouts > 0.2, shouts < 0.02),
        _vote(length > 12 or length < 2, 3 <= length <= 8),
        _vote(ended < 0.3, ended > 0.8),
        _vote(stops < 0.03, stops > 0.1),
        _vote(ragged > 0.2, ragged < 0.02),
        _vote(varied < 0.3, varied > 0.45),
        _vote(stutter > 0.15, stutter < 0.02),
        _vote(top > 0.2, top < 0.1),
    )


LABELLERS = 10
_POWERS = 3 ** np.arange(LABELLERS)


def _crc(data: bytes) -> int:
    return zlib.crc32(data) % DIMENSIONS


_RUNS = [(re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"([^aA0])\1+"), rb"\1")]


def shape(word: bytes) -> bytes:
    """The word with runs of small letters, capitals, digits and equal signs as one character each."""
    for run, short in _RUNS:
        word = run.sub(short, word)
    return b"\0" + word


class _Features(dict):
    """word -> (slot of the word, slot of its shape)"""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > _HELD_WORDS:
            self.clear()
        self[word] = found = (_crc(word.lower()), _crc(shape(word)))
        return found


_features = _Features()


_CELL = np.dtype([("slot", "<u4"), ("share", "<f4")])


def features(words: list[bytes]) -> np.ndarray:
    """The slots that a text has and how much of it each has; words make one half, shapes the other, and repeats have the last slot."""
    slots, counts = np.unique([s for w in words for s in _features[w]], return_counts=True)
    cells = np.empty(len(slots) + 1, _CELL)
    cells["slot"][:-1], cells["share"][:-1] = slots, counts / (2 * len(words))
    cells[-1] = DIMENSIONS, repeats(words) / len(words)
    return cells


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> np.ndarray:
    """P(good) of each vote pattern (rows of 0, 1, 2) by EM.

    Votes are independent given the class, but a bad text has a vote against it: of the class's patterns those without
    one never occur, and the EM completes them. Without that, EM would part a corpus without bad texts as well. A labeller
    that votes against most texts doesn't know their kind (stop words of a language it lacks) and is not heard.
    """
    total = counts.sum()
    if not total:
        return np.ones(len(patterns))
    patterns = np.where(((patterns == 2).T @ counts) * 2 > total, 0, patterns)
    against = (patterns == 2).sum(axis=1)
    good = 0.5**against * (against < patterns.shape[1])
    unseen = np.zeros((patterns.shape[1], 3))  # votes of the completed texts of the bad class
    for _ in range(rounds):
        prior = (counts @ good + 1) / (total + 2)
        logs = np.zeros((2, len(patterns)))
        shares = np.empty((2, patterns.shape[1], 3))
        for k, weight in enumerate((counts * good, counts * (1 - good))):
            for labeller in range(patterns.shape[1]):
                tallies = np.bincount(patterns[:, labeller], weight, 3) + 1 + k * unseen[labeller]
                shares[k, labeller] = tallies / tallies.sum()
                logs[k] += np.log(shares[k, labeller])[patterns[:, labeller]]
        silent = np.prod(1 - shares[1, :, 2])  # P(no vote against) before those are ruled out
        odds = np.log(1 - prior) + logs[1] - np.log1p(-silent) - np.log(prior) - logs[0]
        fresh = np.where(against == 0, 1.0, 1 / (1 + np.exp(np.clip(odds, -500, 500))))
        missing = counts @ (1 - fresh) * silent / (1 - silent)
        unseen = missing * shares[1] / (1 - shares[1][:, 2:])
        unseen[:, 2] = 0
        done = np.abs(fresh - good).max() < 1e-6
        good = fresh
        if done:
            break
    return good


def train(rows: list[np.ndarray], labels: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer by gradient steps over the texts' cells; both classes weigh the same."""
    weights, bias = np.zeros(DIMENSIONS + 1), 0.0
    good, bad = labels.sum(), (1 - labels).sum()
    if min(good, bad) < 1:  # one class only: nothing to learn
        return weights, 1.0 if good >= bad else -1.0
    cells = np.concatenate(rows)
    slots, slot = np.unique(cells["slot"], return_inverse=True)  # only slots that occur have weights
    owner, share = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), cells["share"].astype(float)
    balance = (labels / good + (1 - labels) / bad) / 2
    scale = 1 / (np.sqrt(np.bincount(slot, share * share * balance[owner], len(slots))) + 1e-3)
    own = np.zeros(len(slots))
    for step in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, share * own[slot], len(rows)) + bias, -30, 30)))
        error = (p - labels) * balance
        rate = 4 / (1 + step / 50)
        own -= rate * scale * (np.bincount(slot, share * error[owner], len(slots)) + 1e-4 * own)
        bias -= rate * float(error.sum())
    weights[slots] = own
    return weights, bias


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    posterior: dict[int, float]
    prior: float

    def beliefs(self, texts: list[bytes]) -> list[float]:
        """P(good) by the labellers' votes."""
        return [self.posterior.get(int(np.dot(votes(text, text.split()), _POWERS)), 1.0) for text in texts]

    def scores(self, texts: list[bytes]) -> list[float]:
        """P(good) by the scorer."""
        value, scores = _values, []
        for text in texts:
            words = text.split()
            if not words:
                scores.append(1.0)
                continue
            if value.get(b"") is not self or len(value) > _HELD_WORDS:
                value.clear()
                value[b""] = self
            for w in [w for w in set(words) if w not in value]:
                value[w] = float(self.weights[_crc(w.lower())] + self.weights[_crc(shape(w))])
            seen = sum(map(value.__getitem__, words)) / (2 * len(words)) + float(self.weights[-1]) * repeats(words) / len(words) + self.bias
            # classes weighed the same in training; a few words are little evidence against the share of good texts
            total = self.prior + seen * len(words) / (len(words) + EVIDENCE)
            scores.append(1 / (1 + math.exp(-min(max(total, -40.0), 40.0))))
        return scores


_values: dict = {}


def fit(docs: DataFrame, train_rows: int = 4096) -> Model:
    """Votes of all rows of `docs` and a scorer from the `train_rows` of them with the smallest hashes of doc_id and text."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    place = F.xxhash64("doc_id", "text")
    # a fourth more than are wanted by expectation, and some for small numbers; the smallest of them are taken
    share = min(1.0, (1.25 * train_rows + 100) / max(1, docs.count()))
    chosen = place <= F.lit(min((1 << 63) - 1, int(share * 2**64) - (1 << 63)))

    def look(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        patterns, held = [], []
        for text, wanted in zip(byte_texts(batch.column("text")), batch.column("chosen").to_pylist(), strict=True):
            words = text.split()
            patterns.append(int(np.dot(votes(text, words), _POWERS)))
            held.append(features(words).tobytes() if wanted and words else None)
        yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(patterns, pa.int32()), pa.array(held, pa.binary())], ["place", "pattern", "features"])

    seen = cut(map_batches(texts.select("text", place.alias("place"), chosen.alias("chosen")), look, "place long, pattern int, features binary"), "votes")
    counted = {r[0]: r[1] for r in seen.groupBy("pattern").count().collect()}  # at most 3 ** LABELLERS rows
    codes = np.array(sorted(counted), np.int64)
    good = estimate(codes[:, None] // _POWERS % 3, np.array([counted[c] for c in codes.tolist()], float))
    posterior = dict(zip(codes.tolist(), good.tolist(), strict=True))
    sample = seen.filter("features is not null").orderBy("place", "pattern", "features").limit(train_rows).collect()
    rows = [np.frombuffer(r["features"], _CELL) for r in sample]
    n = sum(counted.values())
    share = (sum(posterior[c] * k for c, k in counted.items()) + 1) / (n + 2)
    return Model(*train(rows, np.array([posterior[r["pattern"]] for r in sample])), posterior, math.log(share / (1 - share)))


def quality_scores(docs: DataFrame, train_rows: int = 4096, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, posterior, kept of every row of `docs` (doc_id, text; other columns are ignored).

    score: the scorer's P(good) of the whole text; posterior: that of its vote pattern; kept: a score of at least
    `threshold`. A null, empty or blank text has no words and score and posterior 1: nothing speaks against it. Null
    and repeated doc_ids are rows like any other, other columns are ignored whatever their names, and long texts are
    judged whole by the same rules as short ones. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, train_rows))

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data = byte_texts(batch.column("text"))
        scores, beliefs = sent.value.scores(data), sent.value.beliefs(data)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array(beliefs), pa.array([s >= threshold for s in scores])], ["doc_id", "score", "posterior", "kept"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(texts, score, "doc_id long, score double, posterior double, kept boolean")


def quality_filter(docs: DataFrame, train_rows: int = 4096, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, that `quality_scores` keeps."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, train_rows))
    return keep_rows(docs, lambda texts: [s >= threshold for s in sent.value.scores(byte_texts(texts))])
