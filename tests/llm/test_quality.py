import itertools

import numpy as np
import pyarrow as pa
from helpers import SCHEMA, labels, rows, table

from sagaledger.llm import _chain as C
from sagaledger.llm import quality as Q
from sagaledger.llm._text import steps


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    first = np.array([0, 4, 5, 5, 8])
    up, move = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    got, joint = C.marginals(up, first, move)
    want, pairs = np.zeros_like(up), np.zeros((3, 3))
    for s, e in zip(first[:-1], first[1:]):
        total = 0.0
        part, moves = np.zeros((e - s, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=e - s):
            if not path:
                continue
            w = np.exp(sum(up[s + i, y] for i, y in enumerate(path)) + sum(move[a, b] for a, b in itertools.pairwise(path)))
            total += w
            for i, y in enumerate(path):
                part[i, y] += w
            for a, b in itertools.pairwise(path):
                moves[a, b] += w
        if total:
            want[s:e], pairs = part / total, pairs + moves / total
    assert np.allclose(got, want) and np.allclose(joint, pairs)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    up, move = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    enter, leave = rng.normal(size=3), rng.normal(size=3)
    value = lambda p: enter[p[0]] + leave[p[-1]] + sum(up[i, y] for i, y in enumerate(p)) + sum(move[a, b] for a, b in itertools.pairwise(p))
    assert tuple(C.viterbi(up, move, enter, leave)) == max(itertools.product(range(3), repeat=5), key=value)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = Q.train_on(docs, known)
    got = Q.score_quality(docs, field).filter("held_out").join(known, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)
    assert docs.count() - Q.keep_good(docs, field).count() < 0.25 * docs.count()


def test_neighbouring_lines_stay_within_their_text():
    column = pa.array(["one line", "first\nsecond\nthird"])
    (lines,) = [Q.line_features(t) for _, _, t in steps(column)]
    alone = Q.line_features(next(t for _, _, t in steps(column.slice(1))))
    assert np.allclose(lines.features[1:], alone.features) and lines.first.tolist() == [0, 1, 4]


def test_defined_results(spark):
    none = Q.train_on(table(spark), labels(spark))
    got = Q.score_quality(table(spark), none).collect()
    assert len(got) == len(rows()) and all(r.predicted == 1 and r.score > 0.99 for r in got)
    kept = Q.keep_good(table(spark), none)
    assert kept.columns == table(spark).columns and kept.count() == len(rows())
    empty = spark.createDataFrame([], SCHEMA)
    assert Q.score_quality(empty, none).collect() == [] and Q.keep_good(empty, none).collect() == []
