"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is labelled good or bad.  Its unary score comes from features of the line and of its neighbouring lines
(symbols, capitals, marks, separators, repeated words, word lengths, repeated lines), and a transition score ties it to
the line before.  Forward-backward gives each line's marginal probability of being good; the marginals, weighted by the
lines' lengths, aggregate into the document's quality, which a one-variable logistic fit turns into a score.

Labels exist for documents only, so training gives every line its document's label first, then lets lines of bad
documents that the field itself calls good be good, and fits again.

Forward-backward runs over all texts of a step at once: line t of every text that has one is one array operation.

Defined results: a null text counts as an empty one, which is a single empty line; repeated rows are scored one by one; a
null doc_id is scored and has a null held_out; an empty table gives an empty result; columns other than doc_id and text
are not read (``keep_good`` carries them along).  Without training rows of both classes every score is 1, so that nothing
is dropped on no evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._chain import marginals
from ._frames import fold_of, in_batches, labelled_sample
from ._text import NOT_SPACE, Texts, Words, mix64, release, span_hashes, steps
from .rules import SYMBOLS, _lines

#: Held-out rows have this remainder of crc32(doc_id) modulo FOLDS (fixed values).
FOLDS, HELD_OUT = 5, 0
#: A score from here on is predicted good.
DECISION = 0.3
#: Labelled training rows of each class, at most.
SAMPLE_PER_CLASS = 1500

ROUNDS, STEPS, RATE, RIDGE = 2, 120, 0.1, 1e-3


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_CLASSES = (
    _table(SYMBOLS.replace(b"|", b"")),
    _table(b"|"),
    _table(b"!?"),
    _table(bytes(range(0x41, 0x5B))),
    _table(bytes(range(0x61, 0x7B))),
    _table(bytes(range(0x30, 0x3A))),
    _table(b".,;:"),
)
#: Own features of a line.
OWN = 11
#: Features of a line: its own, those of the line before and of the line after, and three constants.
WIDTH = 3 * OWN + 3


@dataclass
class Lines:
    """Lines of some texts: text i has lines first[i]:first[i + 1]."""

    features: np.ndarray
    length: np.ndarray
    first: np.ndarray


def line_features(texts: Texts) -> Lines:
    start, end, owner = _lines(texts)
    n = len(start)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    sums = []
    for table in _CLASSES:
        run = np.concatenate([[0], np.cumsum(table[texts.data], dtype=np.int64)])
        sums.append((run[end] - run[start]).astype(float))
    symbols, bars, marks, upper, lower, digits, stops = sums
    words = Words(texts, NOT_SPACE)
    at, upto = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    many = np.maximum(upto - at, 1).astype(float)
    hashes = words.hashes()
    same = np.zeros(len(hashes) + 1, dtype=np.int64)
    if len(hashes) > 1:
        same[2:] = hashes[1:] == hashes[:-1]
    run = np.cumsum(same)
    # repeats between two words of one line: the first word of a line is compared with no other
    repeats = np.where(upto > at, run[upto] - run[np.minimum(at + 1, len(run) - 1)], 0)
    length = (end - start).astype(float)
    keys = mix64(span_hashes(texts.data, start, end) ^ mix64(owner.astype(np.uint64) + np.uint64(1)))
    _, once = np.unique(keys, return_index=True)
    again = np.ones(n)
    again[once] = 0
    letters = np.maximum(upper + lower, 1)
    own = np.column_stack([
        np.log1p(20 * symbols / many),
        np.log1p(20 * bars / many),
        np.log1p(20 * marks / many),
        4 * upper / letters,
        np.log1p(20 * digits / many),
        np.log1p(20 * stops / many),
        4 * repeats / many,
        np.minimum(length / many, 30) / 5 - 1,
        again,
        np.log1p(length) / 5 - 1,
        (upto == at).astype(float),
    ])
    before, after = np.zeros_like(own), np.zeros_like(own)
    inner = np.ones(n, dtype=bool)
    inner[first[:-1]] = False
    before[inner] = own[np.flatnonzero(inner) - 1]
    last = np.ones(n, dtype=bool)
    last[first[1:] - 1] = False
    after[last] = own[np.flatnonzero(last) + 1]
    x = np.concatenate([own, before, after, np.ones((n, 1)), ~inner[:, None], ~last[:, None]], axis=1)
    return Lines(x, np.maximum(length, 1), first)


def _marginals(unary: np.ndarray, first: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the expected number of each transition; move holds the transition scores."""
    both, joint = marginals(np.column_stack([np.zeros(len(unary)), unary]), first, move)
    return both[:, 1], joint


@dataclass
class Field:
    """Weights of the features, transition scores, and the logistic fit from document quality to score."""

    weights: np.ndarray
    move: np.ndarray
    slope: float = 0.0
    shift: float = 50.0

    def quality(self, lines: Lines) -> np.ndarray:
        """Length-weighted mean of the lines' marginals, for each text."""
        good, _ = _marginals(lines.features @ self.weights, lines.first, self.move)
        run = np.concatenate([[0.0], np.cumsum(good * lines.length)])
        total = np.concatenate([[0.0], np.cumsum(lines.length)])
        return (run[lines.first[1:]] - run[lines.first[:-1]]) / (total[lines.first[1:]] - total[lines.first[:-1]])

    def scores(self, texts: Texts) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.quality(line_features(texts)) + self.shift, -60, 60)))


def _fit(lines: Lines, good: np.ndarray, weight: np.ndarray, start: Field) -> Field:
    """Penalised likelihood of the lines' labels, climbed by Adam; weight balances the documents."""
    w, move = start.weights.copy(), start.move.copy()
    head = np.zeros(len(good), dtype=bool)
    head[lines.first[:-1]] = True
    to = np.flatnonzero(~head)
    seen = np.zeros((2, 2))
    np.add.at(seen, (good[to - 1].astype(int), good[to].astype(int)), 1)
    theta = np.concatenate([w, move.ravel()])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, move = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
        p, joint = _marginals(lines.features @ w, lines.first, move)
        grad = np.concatenate([lines.features.T @ (weight * (good - p)), 0.2 * (seen - joint).ravel()]) / len(good) - RIDGE * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta = theta + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Field(theta[:WIDTH], theta[WIDTH:].reshape(2, 2))


def train(column: pa.Array, target: np.ndarray) -> Field:
    """A field from labelled texts."""
    none = Field(np.zeros(WIDTH), np.zeros((2, 2)))
    if len(set(target.tolist())) < 2:
        return none
    parts = [line_features(t) for _, _, t in steps(column)]
    lines = Lines(np.concatenate([p.features for p in parts]), np.concatenate([p.length for p in parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.first) for p in parts]))]))
    per_doc = np.diff(lines.first)
    doc_good = np.repeat(target == 1, per_doc)
    share = np.where(target == 1, 0.5 / max(1, per_doc[target == 1].sum()), 0.5 / max(1, per_doc[target == 0].sum())) * len(doc_good)
    weight = np.repeat(share, per_doc)
    good = doc_good.copy()
    field = none
    for _ in range(ROUNDS):
        field = _fit(lines, good.astype(float), weight, field)
        p, _ = _marginals(lines.features @ field.weights, lines.first, field.move)
        good = doc_good | (p > 0.5)
        # a bad document keeps its worst line bad
        for i in np.flatnonzero(target == 0):
            s = slice(lines.first[i], lines.first[i + 1])
            if good[s].all():
                good[s.start + int(np.argmin(p[s]))] = False
    quality = field.quality(lines)
    slope, shift = 0.0, 0.0
    y, balance = (target == 1).astype(float), np.where(target == 1, 0.5 / (target == 1).mean(), 0.5 / (target == 0).mean())
    for _ in range(50):  # Newton steps of a ridge logistic fit
        p = 1 / (1 + np.exp(-np.clip(slope * quality + shift, -60, 60)))
        r, h = balance * (y - p), balance * p * (1 - p)
        g = np.array([(r * quality).sum() - 0.02 * slope, r.sum() - 0.02 * shift])
        hess = np.array([[(h * quality**2).sum() + 0.02, (h * quality).sum()], [(h * quality).sum(), h.sum() + 0.02]])
        d = np.linalg.solve(hess, g)
        slope, shift = slope + float(np.clip(d[0], -5, 5)), shift + float(np.clip(d[1], -5, 5))
    field.slope, field.shift = slope, shift
    return field


def held_out(doc_id: Column) -> Column:
    return fold_of(doc_id, FOLDS) == HELD_OUT


def train_on(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Field:
    """A field from a bounded sample of the labelled rows that are not held out."""
    got = labelled_sample(docs, labels, "quality", fold_of(F.col("doc_id"), FOLDS) != HELD_OUT, per_class).toArrow()
    if not got.num_rows:
        return Field(np.zeros(WIDTH), np.zeros((2, 2)))
    got = got.sort_by("doc_id").combine_chunks()
    field = train(got["text"].combine_chunks(), got["target"].to_numpy())
    del got
    release()
    return field


def score_quality(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; one pass over the texts, no shuffle."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in steps(batch.column("text")):
                s = field.scores(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(s), pa.array((s >= DECISION).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
        release()

    rows = in_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of docs that are predicted good, with all their columns; one pass, no shuffle."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            good = [field.scores(texts) >= DECISION for _, _, texts in steps(column.cast(pa.string()))]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))
        release()

    return in_batches(docs).mapInArrow(keep, docs.schema)
