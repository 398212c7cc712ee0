"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's features are the word itself and its character n-grams, hashed into one embedding table; the word's vector is
the mean of theirs, a window's vector is the mean of its words', and a linear softmax over the window's vector gives the
probability.  A misspelling that was never seen shares most of its n-grams with the word it comes from.  Insults are a
few words of a long text, so a text is scored by overlapping windows of a few words over its whole length: its logit is
that of its most toxic window.  Training does the same: of a toxic text it learns from the window that is most toxic so
far, of a clean one from the windows that are most toxic so far and from one at random.

The table and the softmax are trained together by Adagrad.  The first dimension starts from the shrunk odds of each feature
among toxic and clean texts, so that already the first pass looks at the right windows; the fewer toxic texts there are, the
smaller are the steps away from it.  After training each table row is projected on the difference
of the two classes' weights, for only that number enters a score: scoring a text is one table look-up per n-gram and
running sums, over code points, with no Python object per word.

Defined results: a null text counts as an empty one; a text without words has the score of the median clean text; repeated rows
are scored one by one; a null doc_id is scored and counted as not held out (null); an empty table gives an empty result;
columns other than doc_id and text are not read.  Without training rows of both classes every score is 0.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._frames import fold_of, in_batches, labelled_sample
from ._text import mix64, ranges, release, steps

#: Held-out rows have this remainder of crc32(doc_id) modulo FOLDS (fixed values).
FOLDS, HELD_OUT = 4, 2
#: A score from here on is predicted toxic.
DECISION = 0.3
#: Labelled training rows of each class, at most.
SAMPLE_PER_CLASS = 1200

DIMENSIONS = 12
BUCKETS = 1 << 18
#: Texts of the sample that a feature must occur in to be learned; a rarer one would only be memorised.
MIN_TEXTS = 2
SIZES = (3, 4, 5)
#: Texts of each class that a feature's odds are shrunk by.
SHRINK = 1.0
#: Toxic texts (or as large a share of clean ones) with a feature at which it counts half.
SUPPORT = 6.0
#: Step of the table's rows, the sum of squared gradients that they start from, which keeps first steps small, and the number
#: of toxic texts from which on the step is a whole one.
TABLE_RATE, TABLE_START, MANY_TOXIC = 0.5, 1e-2, 300
#: Words in a window, and words from one window to the next.
WINDOW, STRIDE = 12, 6
#: Windows of a clean text that a pass learns from, and the share of words seen without their whole form.
HARD, DROP = 3, 0.5
#: How much a clean text on the wrong side of the cut weighs against a toxic one; clean texts are the many.
CLEAN_WEIGHT = 3
#: Rows in a training step; passes over the sample, and more of them where it is small, up to a number of steps.
LOT, EPOCHS, MAX_EPOCHS, MIN_STEPS = 128, 14, 30, 400

_WORD = np.ones(0x3000, dtype=bool)
for _c in range(0x3000):
    _WORD[_c] = unicodedata.category(chr(_c))[0] in "LNM"
_BEGIN, _END = np.uint32(0x110001), np.uint32(0x110002)


@dataclass
class Bags:
    """Words of some texts as features: word i has features[at[i]:at[i + 1]]; text t has words first[t]:first[t + 1]."""

    features: np.ndarray
    at: np.ndarray
    first: np.ndarray


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    return points, np.concatenate([[0], np.cumsum(lengths + 1)])


def _marked(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, each between a begin and an end mark; spans of the words; words before each text."""
    points, offsets = _code_points([t.lower() for t in texts])
    inside = np.where(points < 0x3000, _WORD[np.minimum(points, 0x2FFF)], True)
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = end - start
    begin = np.concatenate([[0], np.cumsum(size + 2)])
    out = np.empty(begin[-1], dtype=np.uint32)
    out[begin[:-1]] = _BEGIN
    out[begin[1:] - 1] = _END
    out[np.repeat(begin[:-1] + 1 - start, size) + ranges(start, size)] = points[inside]
    begin, end, first = begin[:-1], begin[1:], np.searchsorted(start, offsets)
    # A word that only repeats the word before it is skipped, or one word that fills a window would outweigh its worth.
    whole = _whole(out, begin, end)
    keep = np.ones(len(begin), dtype=bool)
    keep[1:] = (whole[1:] != whole[:-1]) | (end[1:] - begin[1:] != end[:-1] - begin[:-1])
    keep[first[:-1][first[:-1] < len(keep)]] = True
    return out, begin[keep], end[keep], np.concatenate([[0], np.cumsum(keep)])[first]


def _grams(points: np.ndarray, size: int) -> np.ndarray:
    """A hash of the size code points from each place."""
    n = len(points) - size + 1
    total = np.full(max(n, 0), size, dtype=np.uint64)
    for k in range(size):
        total *= np.uint64(0x100000001B3)
        total += points[k : k + n] * np.uint64(0x9E3779B97F4A7C15) if n > 0 else total
    return mix64(total)


def _word_sums(points: np.ndarray, begin: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each word the mean of its features' values; the same features as in bags()."""
    total = np.zeros(len(begin))
    count = np.zeros(len(begin))
    for size in SIZES:
        hashed = (_grams(points, size) & np.uint64(BUCKETS - 1)).astype(np.int64)
        run = np.zeros(len(points) + 1)
        np.cumsum(value[hashed], out=run[1 : len(hashed) + 1])
        last = np.maximum(end - size + 1, begin)
        total += run[last] - run[begin]
        count += last - begin
    total += value[_whole(points, begin, end)]
    return total / (count + 1)


def _whole(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bucket of each whole word."""
    place = np.arange(len(points), dtype=np.int64)
    ahead = np.zeros(len(points), dtype=np.int64)
    ahead[begin] = np.diff(np.concatenate([[0], begin]))
    place = (place - np.cumsum(ahead)).astype(np.uint64)
    run = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(mix64(points + (place << np.uint64(32)) + np.uint64(1)), out=run[1:])
    return (mix64(run[end] - run[begin]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def bags(texts: list[str]) -> Bags:
    """Features of every word, for training."""
    points, begin, end, first = _marked(texts)
    parts, counts = [_whole(points, begin, end).astype(np.int32)], [np.ones(len(begin), np.int64)]
    for size in SIZES:
        hashed = (_grams(points, size) & np.uint64(BUCKETS - 1)).astype(np.int32)
        many = np.maximum(end - size + 1 - begin, 0)
        parts.append(hashed[ranges(begin, many)])
        counts.append(many)
    per_word = np.sum(counts, axis=0)
    at = np.concatenate([[0], np.cumsum(per_word)])
    out = np.empty(at[-1], dtype=np.int32)
    place = at[:-1].copy()
    for values, many in zip(parts, counts):
        out[ranges(place, many)] = values
        place += many
    return Bags(out, at, first)


def _windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the windows over every text's words; a text without words has none."""
    n = np.diff(first)
    many = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(n)), many)
    start = ranges(np.zeros(len(n), np.int64), many) * STRIDE + first[:-1][owner]
    # The last window ends with the text, so that it is as long as the others where the text allows it.
    start = np.maximum(np.minimum(start, first[1:][owner] - WINDOW), first[:-1][owner])
    return start, np.minimum(start + WINDOW, first[1:][owner]), owner


@dataclass
class Model:
    """What scoring needs: for each bucket the projection of its embedding, the bias, and the logit of no words at all."""

    value: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    bias: float = -50.0
    blank: float = -50.0

    def scores(self, texts: list[str]) -> np.ndarray:
        points, begin, end, first = _marked(texts)
        logits = np.full(len(texts), self.blank)
        if len(begin):
            run = np.concatenate([[0.0], np.cumsum(_word_sums(points, begin, end, self.value))])
            start, stop, owner = _windows(first)
            mean = (run[stop] - run[start]) / (stop - start)
            at = np.flatnonzero(np.diff(np.concatenate([[-1], owner])))
            logits[owner[at]] = self.bias + np.maximum.reduceat(mean, at)
        return 1.0 / (1.0 + np.exp(-np.clip(logits, -60, 60)))


def train(texts: list[str], target: np.ndarray, seed: int = 5) -> Model:
    """Embeddings and softmax from labelled texts, by Adagrad over chosen windows."""
    if len(set(target.tolist())) < 2:
        return Model()
    rng = np.random.default_rng(seed)
    b = bags(texts)
    start, stop, owner = _windows(b.first)
    at = np.flatnonzero(np.diff(np.concatenate([[-1], owner])))
    ends, of = np.append(at[1:], len(owner)), target[owner[at]]
    aside = rng.random(len(at)) < 0.2  # texts that only the passes to keep and the cut are chosen with
    if min(np.bincount(of[aside], minlength=2)) < 3 or min(np.bincount(of[~aside], minlength=2)) < 3:
        aside[:] = False
    texts_with = np.zeros((2, BUCKETS), np.int32)
    for i in owner[at]:
        texts_with[target[i], np.unique(b.features[b.at[b.first[i]] : b.at[b.first[i + 1]]])] += 1
    known = texts_with.sum(0) >= MIN_TEXTS
    per_word = np.diff(b.at)
    at = np.flatnonzero(np.diff(np.concatenate([[-1], owner])))
    ends = np.append(at[1:], len(owner))

    # The odds of a feature among toxic and clean texts, shrunk where few have it, are where the first dimension starts: a few
    # words make a text toxic, and nothing else says which.  A feature that few toxic texts have could only be memorised.
    texts_of = np.bincount(of, minlength=2)
    share = (texts_with + SHRINK) / (texts_of[:, None] + 2 * SHRINK)
    support = texts_with[1] + texts_with[0] * (texts_of[1] / texts_of[0])
    odds = np.where(known, (np.log(share[1]) - np.log(share[0])) * support / (support + SUPPORT), 0)
    table = rng.normal(0, 0.02, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weight = rng.normal(0, 0.3, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    table[:, 0], weight[0] = odds, (-1, 1)
    table[~known] = 0
    slow = [np.full(table.shape[0], TABLE_START, np.float32), np.full_like(weight, 1e-2), np.full_like(bias, 1e-2)]
    per_word = np.diff(b.at)

    def margins() -> np.ndarray:
        value = table @ (weight[:, 1] - weight[:, 0])
        word = np.add.reduceat(value[b.features], b.at[:-1]) / per_word
        run = np.concatenate([[0.0], np.cumsum(word)])
        return (run[stop] - run[start]) / (stop - start)

    def judged() -> tuple[np.ndarray, np.ndarray, float, float]:
        """(largest margin of every text, its label, the margins beside the best cut), of texts aside."""
        top = np.maximum.reduceat(margins(), at)
        y = of
        if aside.any():
            top, y = top[aside], y[aside]
        order = np.argsort(top)
        wrong = np.cumsum(y[order] == 1) + CLEAN_WEIGHT * ((y == 0).sum() - np.cumsum(y[order] == 0))
        best = int(np.argmin(wrong))
        return top, y, float(top[order[best]]), float(top[order[min(best + 1, len(order) - 1)]])

    # The fewer toxic texts there are, the less the passes may move what the odds say.
    step = TABLE_RATE * min(1.0, texts_of[1] / MANY_TOXIC)
    size = int(np.clip(len(at) // 16, 8, LOT))
    epochs = int(np.clip(MIN_STEPS * size / (3 * len(at)), EPOCHS, MAX_EPOCHS))
    for epoch in range(epochs):
        margin = margins() + rng.normal(0, 1e-6, len(start))
        chosen, truth = [], []
        for s, e in zip(at[~aside], ends[~aside]):
            y = int(target[owner[s]])
            pick = np.array([s + int(np.argmax(margin[s:e]))])
            if not y:
                # the windows of a clean text that look most toxic are what is left to learn
                hard = s + np.argsort(-margin[s:e])[:HARD]
                pick = np.unique(np.concatenate([hard, s + rng.integers(0, e - s, 1)]))
            chosen.append(pick)
            truth.append(np.full(len(pick), y))
        pick, truth = np.concatenate(chosen), np.concatenate(truth)
        order = rng.permutation(len(pick))
        balance = np.where(truth == 1, 0.5 * len(truth) / max(1, truth.sum()), 0.5 * len(truth) / max(1, (1 - truth).sum())).astype(np.float32)
        for lot in np.array_split(order, max(1, len(order) // size)):
            w, y, share = pick[lot], truth[lot], balance[lot]
            many = stop[w] - start[w]
            word = ranges(start[w], many)
            in_window = np.repeat(np.arange(len(w)), many)
            features = b.features[ranges(b.at[word], per_word[word])]
            scale = (1.0 / (per_word[word] * many[in_window])).astype(np.float32)
            row = np.repeat(in_window, per_word[word])
            part = np.repeat(scale, per_word[word])
            # Now and then a word is seen without its whole form, so that its n-grams learn to stand for it.
            whole = np.zeros(len(features), dtype=bool)
            whole[np.cumsum(per_word[word]) - per_word[word]] = True
            use = known[features] & ~(whole & (rng.random(len(features)) < DROP))
            features, row, part = features[use], row[use], part[use]
            unique, inverse = np.unique(features, return_inverse=True)
            matrix = np.bincount(row * len(unique) + inverse, weights=part, minlength=len(w) * len(unique)).reshape(len(w), -1).astype(np.float32)
            vector = matrix @ table[unique]
            logits = vector @ weight + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(w)), y] -= 1
            p *= share[:, None] / len(w)
            down = [matrix.T @ (p @ weight.T), vector.T @ p, p.sum(0)]
            slow[0][unique] += (down[0] ** 2).mean(1)
            table[unique] -= step * down[0] / np.sqrt(slow[0][unique])[:, None]
            for k, (what, rate) in enumerate(((weight, 0.1), (bias, 0.1)), 1):
                slow[k] += down[k] ** 2
                what -= rate * down[k] / np.sqrt(slow[k])
    # The bias is set where the largest margins of texts that were not learned from separate the classes best.
    top, y, low, high = judged()
    value = (table @ (weight[:, 1] - weight[:, 0])).astype(np.float32)
    # A text at the cut has the score of the decision, one at twice its distance from the clean median has a higher one.
    cut = (low + high) / 2
    clean = float(np.median(top[y == 0]))
    slope = 4.0 / max(float(cut) - clean, 1e-6)
    bias = float(np.log(DECISION / (1 - DECISION)) - slope * cut)
    return Model(value * slope, bias, bias + slope * clean)


def held_out(doc_id: Column) -> Column:
    return fold_of(doc_id, FOLDS) == HELD_OUT


def train_on(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model from a bounded sample of the labelled rows that are not held out."""
    got = labelled_sample(docs, labels, "toxic", fold_of(F.col("doc_id"), FOLDS) != HELD_OUT, per_class).toArrow()
    if not got.num_rows:
        return Model()
    got = got.sort_by("doc_id")
    model = train(got["text"].to_pylist(), got["target"].to_numpy())
    del got
    release()
    return model


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; one pass over the texts, no shuffle."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for a, b, _ in steps(column, 1 << 20):
                s = model.scores([x or "" for x in column.slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(s), pa.array((s >= DECISION).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
        release()

    rows = in_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id bigint, held_out boolean, score double, predicted int")
