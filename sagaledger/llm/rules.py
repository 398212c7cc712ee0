"""Quality rules: exact rule statistics of every text and an isolation forest over them.

``rule_statistics`` counts, for each document, what classic quality rules look at.  A document that breaks a base rule
(too few words, or too many repeated three-word windows) fails outright.  For the others an isolation forest gives an
anomaly score: the mean path length over random splits of the rule statistics, as a number from 0 to 1.  The score above
which a document is dropped is calibrated from labelled rows.

The forest is that of all labelled rows.  Splits are drawn from the box that the rows lie in, and what a node weighs is counted
over every good row, a few levels of all trees in one pass; a node is split while it holds more than one in TREE_ROWS of them.
So a tree is what trees of TREE_ROWS rows drawn at random are on average.  The driver holds the trees, whose size TREES and
TREE_ROWS bound, and never rows.

Defined results: a null text counts as an empty one and has no words, so it fails the base rules; rows that repeat a
doc_id are judged one by one; a null doc_id stays null; an empty table gives an empty result; columns other than doc_id
and text are not read.  Without labelled rows there is no forest, and the base rules alone decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frames import discard, in_batches, stored
from ._text import LEADING, NOT_SPACE, Texts, Words, count_in, mix64, release, span_hashes, steps

# What counts as a symbol, and the base rules' limits.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Trees; a node that holds no more than one in TREE_ROWS of the rows is not split; levels that one pass over the rows adds.
TREES, TREE_ROWS, LEVELS = 100, 128, 4
#: Share of the labelled good rows that the threshold may drop at most.
MAX_GOOD_LOST = 0.0

_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_UPPER = np.zeros(256, dtype=bool)
_IS_UPPER[0x41:0x5B] = True
_IS_LETTER = _IS_UPPER.copy()
_IS_LETTER[0x61:0x7B] = True
_IS_MARK = np.zeros(256, dtype=bool)
_IS_MARK[list(b"!?")] = True
_IS_SPACE = ~NOT_SPACE
_IS_NEWLINE = np.zeros(256, dtype=bool)
_IS_NEWLINE[0x0A] = True

#: Statistics that the forest splits on.  Those of a text's length and repetition vary among good documents as well, so
#: they stay with the base rules.
FEATURES = ("symbols", "upper", "marks", "same_as_before")


@dataclass
class Statistics:
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    features: np.ndarray

    @property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words)


def _seen_twice(keys: np.ndarray) -> np.ndarray:
    """True for the keys that occur twice or more."""
    out = np.zeros(len(keys), dtype=bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        ordered = keys[order]
        same = ordered[1:] == ordered[:-1]
        hit = np.zeros(len(keys), dtype=bool)
        hit[1:] |= same
        hit[:-1] |= same
        out[order] = hit
    return out


def _per_text(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weights=weights, minlength=n).astype(np.int64)


def _lines(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the lines between newlines, and the text each belongs to."""
    cuts = np.flatnonzero(_IS_NEWLINE[texts.data])
    start = np.sort(np.concatenate([texts.offsets[:-1], cuts + 1]), kind="stable")
    end = np.sort(np.concatenate([texts.offsets[1:], cuts]), kind="stable")
    # A text has one line more than newlines; both lists are in order, so the i-th start and the i-th end are one line.
    owner = np.repeat(np.arange(len(texts)), 1 + np.diff(np.searchsorted(cuts, texts.offsets)))
    return start, end, owner


def rule_statistics(texts: Texts) -> Statistics:
    """Counts of all texts of one step, by array operations."""
    n = len(texts)
    words = Words(texts, NOT_SPACE)
    counts = words.counts.astype(np.int64)
    owner = words.owner()
    word_chars = count_in(texts, LEADING) - count_in(texts, _IS_SPACE)
    n_symbols = count_in(texts, _IS_SYMBOL)

    salt = mix64(np.arange(1, n + 1, dtype=np.uint64))
    start, end, line_owner = _lines(texts)
    filled = np.concatenate([[0], np.cumsum(NOT_SPACE[texts.data])])
    with_word = filled[end] > filled[start]
    start, end, line_owner = start[with_word], end[with_word], line_owner[with_word]
    line_keys = mix64(span_hashes(texts.data, start, end) ^ salt[line_owner])
    _, first_at = np.unique(line_keys, return_index=True)
    n_lines = _per_text(line_owner, n)
    n_dup_lines = n_lines - _per_text(line_owner[first_at], n)

    hashes = words.hashes()
    covered = np.zeros(n, dtype=np.int64)
    if len(hashes) >= 3:
        whole = owner[2:] == owner[:-2]
        windows = mix64(hashes[:-2] * np.uint64(3) + mix64(hashes[1:-1]) * np.uint64(5) + mix64(hashes[2:] ^ np.uint64(0x55)) * np.uint64(7))
        windows = mix64(windows ^ salt[owner[:-2]])
        at = np.flatnonzero(whole)
        at = at[_seen_twice(windows[at])]
        hit = np.zeros(len(hashes), dtype=bool)
        hit[at] = hit[at + 1] = hit[at + 2] = True
        covered = _per_text(owner[hit], n)
    same = np.zeros(len(hashes), dtype=bool)
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])

    many = np.maximum(counts, 1).astype(float)
    letters = np.maximum(count_in(texts, _IS_LETTER), 1)
    features = np.column_stack([
        np.log1p(50 * n_symbols / many),
        count_in(texts, _IS_UPPER) / letters,
        np.log1p(50 * count_in(texts, _IS_MARK) / many),
        np.log1p(50 * _per_text(owner[same], n) / many),
    ])
    return Statistics(counts, word_chars, n_symbols, n_dup_lines, covered, features)


@dataclass
class Forest:
    """Trees as flat arrays: feature -1 marks a leaf; depth is the path length it stands for."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray
    roots: np.ndarray
    rows: int
    threshold: float = 2.0

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree, the leaf that each row comes to."""
        every = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            live = every
            while len(live):
                f = self.feature[node[live]]
                live = live[f >= 0]
                f = f[f >= 0]
                at = node[live]
                node[live] = np.where(x[live, f] < self.cut[at], self.left[at], self.right[at])
            yield node

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score of each row: near 1 for short paths, near 0 for long ones."""
        total = np.zeros(len(x))
        for node in self.leaves(x):
            total += self.depth[node]
        return 2.0 ** (-(total / max(len(self.roots), 1)) / max(_mean_path(self.rows), 1e-9))


def _mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary search tree of n rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy() for c in FEATURES])


def leaf_counts(rows: DataFrame, forest: Forest) -> np.ndarray:
    """How many of the rows (FEATURES) come to each node of the forest as a leaf."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(forest.feature), dtype=np.int64)
        for batch in batches:
            for node in forest.leaves(_matrix(batch)):
                total += np.bincount(node, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["node", "n"])

    got = rows.select(*FEATURES).mapInArrow(count, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(forest.feature), dtype=np.int64)
    out[got["node"].to_numpy()] = got["n"].to_numpy()
    return out


def fit_forest(good: DataFrame, n: int, box: tuple[np.ndarray, np.ndarray], trees: int = TREES, rows: int = TREE_ROWS, seed: int = 11) -> Forest:
    """Random splits over all n rows of good (FEATURES).

    A split is drawn from the node's part of the box, which may reach beyond the rows: space in which no row lies is then cut
    off early, so a document in it has a short path even where all rows share one value of that statistic.
    """
    rng = np.random.default_rng(seed)
    rows = min(rows, n)
    limit = 2 * int(np.ceil(np.log2(max(rows, 2)))) + 2
    feature, cut, left, right, level = [-1] * trees, [0.0] * trees, [-1] * trees, [-1] * trees, [0] * trees
    boxes = [box] * trees
    mass = np.full(trees, n, dtype=np.int64)

    def split(me: int, levels: int) -> None:
        low, high = boxes[me]
        wide = np.flatnonzero(high > low)
        if not levels or level[me] >= limit or not len(wide):
            return
        f = int(rng.choice(wide))
        feature[me], cut[me] = f, float(rng.uniform(low[f], high[f]))
        edge = np.arange(len(low)) == f
        for side, part in ((left, (low, np.where(edge, cut[me], high))), (right, (np.where(edge, cut[me], low), high))):
            side[me] = len(feature)
            for column, value in ((feature, -1), (cut, 0.0), (left, -1), (right, -1), (level, level[me] + 1), (boxes, part)):
                column.append(value)
            split(side[me], levels - 1)

    def made(depth: np.ndarray) -> Forest:
        return Forest(*(np.array(v) for v in (feature, cut, left, right, depth, np.arange(trees))), rows=rows)

    live = list(range(trees)) if n > 1 else []
    while live:
        before = len(feature)
        for me in live:
            split(me, LEVELS)
        if len(feature) == before:
            break
        mass = leaf_counts(good, made(np.zeros(len(feature))))
        # Children stand behind their parents, so from the end on every node has what its children hold.
        for me in range(len(feature) - 1, -1, -1):
            if feature[me] >= 0:
                mass[me] = mass[left[me]] + mass[right[me]]
                if mass[me] * rows <= n:
                    feature[me] = -1
        reached, todo = [], list(range(trees))
        while todo:
            me = todo.pop()
            if feature[me] >= 0:
                todo += (right[me], left[me])
            elif mass[me] * rows > n:
                reached.append(me)
        live = reached
    return made(np.array([at + _mean_path(int(np.rint(m * rows / n))) for at, m in zip(level, mass.tolist())]))


#: Bins of scores that one pass tells apart.
BINS = 1024


def kth_highest(scores: DataFrame, k: int) -> float:
    """The k-th highest of the scores (score, in 0 to 1), by counts in ever narrower bins."""
    low, high = 0.0, 1.0
    while high > low:
        bin_ = F.least(F.floor((F.col("score") - low) / (high - low) * BINS), F.lit(BINS - 1)).alias("bin")
        bins = scores.filter(F.col("score").between(low, high)).groupBy(bin_).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
        for b in sorted(bins.collect(), key=lambda b: -b["bin"]):
            if k <= b["n"]:
                low, high = b["low"], b["high"]
                break
            k -= b["n"]
    return high


def calibrate(scored: DataFrame, max_good_lost: float = MAX_GOOD_LOST) -> float:
    """The lowest threshold that drops at most that share of the good rows, with half the gap to the next bad row as margin.
    scored has (score, good)."""
    good = scored.filter("good")
    n = good.count()
    if not n:
        return 2.0
    at = kth_highest(good, n - min(n, max(1, int(np.ceil((1 - max_good_lost) * n)))) + 1)
    above = scored.filter(~F.col("good") & (F.col("score") > at)).agg(F.min("score")).first()[0]
    return float(at + (above - at) / 2) if above is not None else float(at + 1e-9)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
TABLE = ", ".join(["doc_id bigint", *(f"{c} bigint" for c in COUNTS), "base_failed boolean", *(f"{c} double" for c in FEATURES)])


def statistics_table(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: its rule statistics and FEATURES.  One pass over the texts, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in steps(batch.column("text")):
                s = rule_statistics(texts)
                columns = [batch.column("doc_id").slice(a, b - a), *(pa.array(getattr(s, c)) for c in COUNTS), pa.array(s.base_failed), *map(pa.array, s.features.T.copy())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in TABLE.split(", ")])
        release()

    return in_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, TABLE)


def _scores(rows: DataFrame, forest: Forest) -> DataFrame:
    """rows (FEATURES among their columns) with anomaly, their score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.score(_matrix(batch)))], names=[*batch.schema.names, "anomaly"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("anomaly", T.DoubleType())]))


def train_on(statistics: DataFrame, labels: DataFrame) -> Forest | None:
    """A forest from all labelled rows of a table of statistics that pass the base rules; None without any.  Null ids, null
    targets and targets other than 0 and 1 are left out; an id with both targets counts as good."""
    known = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels["quality"].cast("int").alias("target"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("target").isin(0, 1)).groupBy("doc_id").agg((F.max("target") == 1).alias("good"))
    rows = stored(statistics.filter(~F.col("base_failed")).select("doc_id", *FEATURES).join(known, "doc_id").drop("doc_id"), "labelled")
    ends = [of(c).alias(f"{name}_{c}") for name, of in (("low", F.min), ("high", F.max)) for c in FEATURES]
    seen = rows.agg(F.count_if("good").alias("n"), *ends).first()
    if not seen["n"]:
        return None
    low, high = (np.array([seen[f"{name}_{c}"] for c in FEATURES]) for name in ("low", "high"))
    forest = fit_forest(rows.filter("good"), seen["n"], (low, high))
    scored = stored(_scores(rows, forest).select("good", F.col("anomaly").alias("score")), "scored")
    forest.threshold = calibrate(scored)
    discard(rows)
    discard(scored)
    return forest


def train_forest(docs: DataFrame, labels: DataFrame) -> Forest | None:
    """A forest from all labelled rows of docs that pass the base rules; None without any."""
    return train_on(statistics_table(docs), labels)


def judged(statistics: DataFrame, forest: Forest | None) -> DataFrame:
    """A table of statistics with whether each row is kept, and its anomaly score."""
    rows = statistics.withColumn("anomaly", F.lit(0.0)) if forest is None else _scores(statistics, forest)
    kept = ~F.col("base_failed") & (F.lit(True) if forest is None else F.col("anomaly") <= forest.threshold)
    return rows.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "anomaly")


def quality_rules(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """One row for each row of docs: its rule statistics, and whether it is kept.  One pass over the texts, no shuffle."""
    return judged(statistics_table(docs), forest)


def rules_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """quality_rules with the forest of docs' own labelled rows.  The texts are read once; their statistics are stored."""
    statistics = stored(statistics_table(docs), "statistics")
    return judged(statistics, train_on(statistics, labels))
